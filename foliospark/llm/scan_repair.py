"""Problem 1: repair of text read from scanned pages.

Lines are labelled as furniture (header, footer), body or break by a hidden Markov model with these three states.
What it sees of a line is how often the line returns in its document, where it stands, its form, how it goes on from
its neighbours, and its words. Emissions come from counts over all pages in a table of CELLS cells: lines repeated
for sure and numbers alone are the first furniture, headings and formulas the first breaks, and expectation steps
spread this to the other lines. The sequence of a page is decoded by Viterbi's algorithm.

Words are decided once per distinct word, by Spark: a word that the corpus doesn't know for sure is asked; asked
words meet the corpus' word counts by joins on the words one or two confusions away. Two halves of a word at a line
break are decided once per distinct pair in the same way. The tasks that read the pages hold the VOCABULARY most frequent words
only: as weights of the line model, and as words that need not be asked. Every other word is asked, so that bound
changes no result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import discard, materialize, settled
from .common import CONFUSIONS, map_rows
from .page_layout import FORMULA, NUMBER_ALONE, STRIP, FLOWS, FORMS, PLACES, REPETITIONS, Layout
from .page_text import BODY, BREAK, BREAKS, CELLS, FURNITURE, cell_of, layouts, page_pass, prepared
from .text_quality import distances, outliers

#: Words that the tasks hold: the most frequent ones.
VOCABULARY = 1 << 18
#: A word seen less often is no word to correct to.
LEAST_COUNT = 3
#: A word is a misreading of the word one confusion away that is this many times as frequent.
DOMINANCE = 20
#: Words of fewer letters are not changed in two places.
TWO_CHANGES_FROM = 5
#: Most log odds of a word, and of all words of a line.
WORD_ODDS, LINE_ODDS = 6.0, 9.0
#: Expectation steps of the line model.
EXPECTATIONS = 8
HYPHENS = "-‐­¬"
ODD = re.compile(r"[^\W\d_]*[€¢@|][^\W\d_]+|[^\W\d_]+[€¢@|!$][^\W\d_]+|[^\W\d_]+[€¢@|][^\W\d_]*|![^\W\d_]{2,}")
LETTER_IN_NUMBER = re.compile(r"^(?=.*\d)(?=.*[lOI|])[\dlOI|.,]+%?$")
AS_DIGITS = str.maketrans("lOI|", "1011")


# Confusions.


def variants(word: str) -> list[str]:
    """Words from which one confusion makes `word`."""
    return _changed(word, ((read, true) for true, read in CONFUSIONS))


def readings(word: str) -> list[str]:
    """Words that one confusion makes of `word`."""
    return _changed(word, CONFUSIONS)


def _changed(word: str, pairs) -> list[str]:
    out = set()
    for old, new in pairs:
        at = word.find(old)
        while at >= 0:
            out.add(word[:at] + new + word[at + len(old):])
            at = word.find(old, at + 1)
    out.discard(word)
    return sorted(out)


def _spread(words: DataFrame, near, name: str) -> DataFrame:
    """(word, n) with a row per word that `near` gives."""
    return map_rows(words.select("word", "n"), f"word string, n bigint, {name} string", lambda: lambda w, n: [(w, n, x) for x in near(w)])


def vocabulary(counts: DataFrame) -> DataFrame:
    """word (lower case), n of all words inside the body lines and in the breaks of all pages."""
    return counts.where("substring(what, 1, 1) in ('m', 'h')").groupBy(F.lower(F.expr("substring(what, 2)")).alias("word")).agg(F.sum("n").alias("n"))


def _best(found: DataFrame) -> DataFrame:
    """word, fixed: of the candidates (word, fixed, n_fixed) the most frequent, then the first in order."""
    return found.groupBy("word").agg(F.min_by("fixed", F.struct(-F.col("n_fixed"), "fixed")).alias("fixed"))


def corrections(asked: DataFrame, words: DataFrame) -> DataFrame:
    """word, fixed of the asked words that are misreadings. asked: word, distinct; words: vocabulary().

    A word is one confusion away from a word DOMINANCE times as frequent (at least LEAST_COUNT); if there is none,
    and it is long enough, two confusions away. Both sides of the second join list the words between them, so no
    word is tried against the whole vocabulary. A compound is corrected in its parts.
    """
    asked = asked.where(F.length("word") > 1)
    parts = asked.where("word like '%-%'").select(F.col("word").alias("compound"), F.posexplode(F.split("word", "-")).alias("part", "word"))
    whole = asked.unionByName(parts.select("word")).where(F.length("word") > 1).distinct()
    counted = materialize(whole.join(words, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    sure = words.where(F.col("n") >= LEAST_COUNT).select(F.col("word").alias("fixed"), F.col("n").alias("n_fixed"))
    one = _spread(counted, variants, "fixed").join(sure, "fixed").where(F.col("n_fixed") >= F.col("n") * DOMINANCE)
    first = materialize(_best(one))
    left = counted.where(F.length("word") >= TWO_CHANGES_FROM).join(first, "word", "left_anti")
    frequent = words.where((F.length("word") >= TWO_CHANGES_FROM) & (F.col("n") >= DOMINANCE))
    between = _spread(frequent, readings, "via").select("via", F.col("word").alias("fixed"), F.col("n").alias("n_fixed"))
    two = _spread(left, variants, "via").join(between, "via").where((F.col("n_fixed") >= F.col("n") * DOMINANCE) & (F.col("word") != F.col("fixed")))
    simple = materialize(first.unionByName(_best(two)))
    pieces = parts.join(simple, "word", "left").groupBy("compound").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("fixed", "word").alias("w")))), lambda x: x["w"]), "-").alias("fixed"), F.count("fixed").alias("n"))  # a word's parts
    compounds = pieces.where("n > 0").select(F.col("compound").alias("word"), "fixed").join(simple.select("word"), "word", "left_anti")
    return simple.unionByName(compounds)


# The line model.


def emissions(rows: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each cell in each state, and of the moves between states, from the counts of cells and moves.

    Place, form and flow of furniture are those of lines repeated for sure and of numbers alone; those of body and
    breaks are those of unrepeated lines. How often the lines of each state are repeated, and how frequent the states
    are, follows by expectation steps over all lines.
    """
    n = np.array([rows.get(f"c{i}", 0) for i in range(CELLS)], float)
    shape = (REPETITIONS, PLACES, FORMS, FLOWS)
    axes = np.unravel_index(np.arange(CELLS), shape)
    rep, form = axes[0], axes[2]
    number = form == NUMBER_ALONE
    sure = np.stack([(rep == 4) | number, (rep == 0) & ~number & ~np.isin(form, BREAKS), (rep == 0) & np.isin(form, BREAKS)], 1)

    def part(value, mass):
        n_seen = np.stack([np.bincount(value, mass[:, s], int(value.max()) + 1) + 0.5 for s in range(3)], 1)
        return np.log(n_seen / n_seen.sum(0))[value]

    counted = n[:, None] * sure
    seen = part(form, counted) + part(axes[1] * FLOWS + axes[3], counted)  # furniture inside a page cuts sentences, elsewhere it doesn't
    log, prior, repeated = seen, np.log(np.full(3, 1 / 3)), np.where(rep >= 3, 1.0, 0.1)[:, None] * [1, 0, 0] + np.where(rep < 2, 1.0, 0.1)[:, None] * [0, 1, 1]
    repeated = np.log(repeated)
    for _ in range(EXPECTATIONS):
        score = seen + repeated + prior
        p = np.exp(score - score.max(1, keepdims=True))
        mass = n[:, None] * np.where(sure.any(1, keepdims=True) & (rep == 4)[:, None], sure, p / p.sum(1, keepdims=True))
        repeated, prior = part(rep, mass), np.log((mass.sum(0) + 1) / (mass.sum() + 3))
        log = seen + repeated
    move = np.ones((3, 3)) + np.array([[rows.get(f"t{i}{j}", 0) for j in range(3)] for i in range(3)])
    return log, np.log(move / move.sum(1, keepdims=True))


def line_words(counts: DataFrame, words: DataFrame) -> tuple[dict[str, tuple[float, float]], set[str]]:
    """Log odds for furniture and for a break against body of the VOCABULARY most frequent words as written, and the words of them, in lower case, that need not be asked."""
    side = lambda *which: F.sum(F.when(F.expr("substring(what, 1, 1)").isin(*which), F.col("n")).otherwise(0))
    sides = counts.where("substring(what, 1, 1) in ('m', 'e', 'h', 'f')").groupBy(F.expr("substring(what, 2)").alias("word")).agg(side("f").alias("f"), side("h").alias("h"), side("m", "e").alias("b"))
    totals = [x or 1 for x in sides.agg(F.sum("f"), F.sum("h"), F.sum("b")).first()]
    n = F.col("f") + F.col("h") + F.col("b")
    most = sides.where(n >= LEAST_COUNT).orderBy(n.desc(), "word").limit(VOCABULARY).toArrow()
    f, h, b = (np.log(most.column(k).to_numpy() / total + 1 / sum(totals)) for k, total in zip("fhb", totals))  # one sighting is shared out evenly
    clipped = lambda x: np.clip(x, -WORD_ODDS, WORD_ODDS).tolist()
    frequent = materialize(words.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(VOCABULARY))
    doubtful = corrections(frequent.select("word"), words)
    clean = frequent.join(doubtful, "word", "left_anti").select("word").toArrow().column(0).to_pylist()
    return dict(zip(most.column("word").to_pylist(), zip(clipped(f - b), clipped(h - b)))), set(clean)


class Reader:
    """Labels the lines of pages, and asks for the words it isn't sure of."""

    def __init__(self, odds: dict[str, tuple[float, float]], clean: set[str], emission: np.ndarray, moves: np.ndarray):
        self.odds, self.clean, self.emission, self.moves = odds, clean, emission, moves

    def labels(self, page: Layout) -> np.ndarray:
        """FURNITURE, BODY or BREAK of every line: the likeliest sequence of states of each page."""
        odds = self.odds
        form, flow = page.context()
        none = (0.0, 0.0)
        word = np.array([odds.get(w) or odds.get(w.strip(STRIP), none) for w in page.words]).reshape(-1, 2)
        score = self.emission[cell_of(page, form, flow)].copy()
        for i, state in enumerate((FURNITURE, BREAK)):
            words = np.bincount(page.owner, word[page.token, i], len(page))
            score[:, state] += np.where(form == NUMBER_ALONE, 0.0, np.clip(words, -LINE_ODDS, LINE_ODDS))
        return viterbi(score, self.moves, page.start)

    def word(self, token: str) -> tuple[str, bool] | None:
        """(the word to ask for, or the correction; whether it is surely misread) of a token as printed; None if it is fine."""
        w = token.strip(STRIP)
        if not w:
            return None
        if len(w) < len(token) and token[0] == "!" and len(token) > 2 and token[1].isalpha():
            w = token[: len(token) - len(token.rstrip(STRIP)) or None].lstrip(STRIP.replace("!", ""))
        low = w.lower()
        if low in self.clean or not any(map(str.isalpha, low)):
            return None
        if LETTER_IN_NUMBER.match(w):
            return w.translate(AS_DIGITS), True
        return None if "(" in w or "=" in w or "/" in w or len(low) < 2 else (low, False)


def viterbi(score: np.ndarray, moves: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The likeliest states of many sequences at once; score: log probability per row and state, sequence i being rows start[i] to start[i + 1]."""
    lengths = np.diff(start)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = start[:-1][order], lengths[order]
    back, out = np.zeros(score.shape, np.int8), np.zeros(len(score), np.int8)
    active = int((lengths > 0).sum())
    best = score[first[:active]]
    final = np.zeros((len(lengths), score.shape[1]))
    final[:active] = best
    for t in range(1, int(lengths.max(initial=0))):
        active = int(np.searchsorted(-lengths, -t))  # sequences of more than t rows
        ways = best[:active, :, None] + moves
        at = first[:active] + t
        back[at] = ways.argmax(1)
        best = ways.max(1) + score[at]
        final[:active] = best
    state = final.argmax(1)
    for t in range(int(lengths.max(initial=0)) - 1, -1, -1):
        active = int(np.searchsorted(-lengths, -t))
        at = first[:active] + t
        out[at] = state[:active]
        state[:active] = back[at, state[:active]]
    return out


# One pass over the pages: labels for sure, and what is asked.

READ = "cache_seq bigint, line_no int, kind string, token int, word string, tail string, tail_line int, tail_word string, tail_odd boolean"
_READ = pa.schema([("cache_seq", pa.int64()), ("line_no", pa.int32()), ("kind", pa.string()), ("token", pa.int32()), ("word", pa.string()), ("tail", pa.string()), ("tail_line", pa.int32()), ("tail_word", pa.string()), ("tail_odd", pa.bool_())])


def read_page_lines(reader: Reader, seq: np.ndarray, page: Layout) -> list[pa.RecordBatch]:
    """Rows of kind furniture and break; misread (surely, word is the correction); ask (word); pair (word before a hyphen, tail after it)."""
    label = reader.labels(page)
    found = []

    def rows(kind, line, **more):
        n = len(line)
        columns = {"cache_seq": seq[page.page[line]], "line_no": page.line_no[line], "kind": pa.array([kind] * n, pa.string())} | more
        found.append(pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _READ], schema=_READ))

    rows("furniture", np.flatnonzero(label == FURNITURE))
    rows("break", np.flatnonzero(label == BREAK))
    own = np.flatnonzero(label != FURNITURE)
    if not len(own):
        return found
    follows = np.full(len(page), -1)
    follows[own[:-1]] = np.where(page.page[own[1:]] == page.page[own[:-1]], own[1:], -1)
    formula = page.form == FORMULA
    words = page.words
    hyphen = np.array([w[-1] in HYPHENS and len(w) > 1 for w in words], bool)
    ends = own[hyphen[page.token[page.last_token[own]]] & ~formula[own]]
    skip = np.zeros(len(page.token), bool)  # tokens that belong to a pair
    pairs = []
    for j in ends.tolist():
        last, k = page.last_token[j], int(follows[j])
        skip[last] = True
        head, tail, tail_word, odd = words[page.token[last]].rstrip(HYPHENS).strip(STRIP).lower(), None, None, False
        if k >= 0:
            first = page.token_start[k]
            skip[first] = True
            token = words[page.token[first]]
            tail = token.strip(STRIP).lower()
            asked = reader.word(token)
            tail_word, odd = (None, False) if asked is None else (None, True) if asked[1] else (asked[0], "-" not in asked[0] and ODD.search(asked[0]) is not None)
        pairs.append((j, int(last - page.token_start[j]), head, tail, int(page.line_no[k]) if k >= 0 else None, tail_word, odd))
    if pairs:
        j, token, head, tail, tail_line, tail_word, odd = map(list, zip(*pairs))
        rows("pair", np.array(j), token=token, word=head, tail=tail, tail_line=tail_line, tail_word=tail_word, tail_odd=odd)
    asked = [reader.word(w) for w in words]
    open_ = np.array([a is not None for a in asked], bool)
    at = np.flatnonzero(open_[page.token] & ~skip & ((label != FURNITURE) & ~formula)[page.owner])
    if len(at):
        of, which = page.owner[at], [asked[i] for i in page.token[at].tolist()]
        sure = np.array([x[1] for x in which], bool)
        for kind, here in (("misread", sure), ("ask", ~sure)):
            picked = np.flatnonzero(here)
            rows(kind, of[picked], token=(at - page.token_start[of])[picked], word=[which[i][0] for i in picked])
    return found


def trained(rows: DataFrame) -> tuple[Reader, DataFrame, DataFrame]:
    """The reader, the corpus' words and the rows that aren't prose."""
    passed = materialize(page_pass(rows, counting=True))
    none = materialize(outliers(distances(passed.where("cache_seq is not null").drop("what", "n"))))
    counts = materialize(passed.where("what is not null").groupBy("what").agg(F.sum("n").alias("n")))
    discard(passed)
    words = materialize(vocabulary(counts))
    cells = {r[0]: r[1] for r in counts.where("substring(what, 1, 1) in ('c', 't')").collect()}  # at most CELLS + 9 rows
    reader = Reader(*line_words(counts, words), *emissions(cells))
    discard(counts)
    return reader, words, none


def read_pages(rows: DataFrame, reader: Reader, none: DataFrame) -> DataFrame:
    """READ rows of the prose pages among the prepared rows."""
    shared = rows.sparkSession.sparkContext.broadcast(reader)

    def run(batches):
        for seq, page in layouts(batches):
            yield from read_page_lines(shared.value, seq, page)

    return materialize(rows.select("cache_seq", "text", "n_pages", "on_pages").mapInArrow(run, READ).join(none, "cache_seq", "left_anti"))


def read_corpus(ocr: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """READ rows of all prose pages, the corpus' words, the prepared rows, and the rows that aren't prose."""
    rows = settled(lambda: prepared(ocr, pages))
    reader, words, none = trained(rows)
    return read_pages(rows, reader, none), words, rows, none


# Deciding words and pairs.


def _matches(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


_L = r"\p{L}"
ODD_SQL = rf"{_L}*[€¢@|]{_L}+|{_L}+[€¢@|!$]{_L}+|{_L}+[€¢@|]{_L}*|!{_L}{{2,}}"


def decided(read: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache_seq, line_no, token, fixed of misread words; the pairs with split, head_fixed, tail_fixed, whole_fixed, null if nothing is to be changed)."""
    asks = read.where("kind = 'ask'").select("cache_seq", "line_no", "token", "word")
    occurring = read.where("kind = 'pair'").select("cache_seq", "line_no", "token", F.col("word").alias("head"), "tail", "tail_line", "tail_word", "tail_odd")
    pairs = materialize(occurring.select("head", "tail", "tail_word", "tail_odd").distinct())
    last, front = F.substring_index("head", "-", -1), F.substring_index("tail", "-", 1)
    roles = {"joined": F.concat(last, front), "compound": F.concat_ws("-", "head", "tail"), "short": F.concat_ws("-", last, front), "run": F.concat("head", "tail"), "last": last, "front": front, "head": F.col("head"), "tail": F.col("tail_word")}
    long = pairs.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.when(F.col("tail").isNotNull() | F.lit(k in ("last", "head", "tail")), v).alias("w")) for k, v in roles.items()])).alias("r")).select("head", "tail", "tail_word", "tail_odd", "r.*").where("w is not null")
    asked = materialize(asks.select("word").unionByName(long.where("role in ('joined', 'compound', 'last', 'head', 'tail')").select(F.col("w").alias("word"))).distinct())
    fixes = materialize(corrections(asked, words))
    known = long.join(words.select(F.col("word").alias("w"), "n"), "w", "left").join(fixes.select(F.col("word").alias("w"), "fixed"), "w", "left")
    key = ["head", "tail", "tail_word", "tail_odd"]
    of = lambda role, x: F.max(F.when(F.col("role") == role, x))
    sure = F.when(F.col("fixed").isNull() & (F.col("n") >= LEAST_COUNT), F.col("n")).otherwise(0)
    g = known.groupBy(*key).agg(*[F.coalesce(of(r, sure), F.lit(0)).alias(f"n_{r}") for r in ("joined", "compound", "short", "run", "last", "front")], *[of(r, F.col("fixed")).alias(f"f_{r}") for r in ("joined", "compound", "head", "tail")])
    able = _matches("head", r"(\p{L}|[5€¢@|!01])$") | _matches("head", ODD_SQL)
    n_compound = F.greatest("n_compound", "n_short")
    split = able & (F.when(F.col("tail").isNull(), F.col("n_last") == 0).when((F.col("n_joined") > 0) | (n_compound > 0), F.col("n_joined") > n_compound)
                    .when(F.col("f_joined").isNotNull() | F.col("head").contains("-") & (F.col("n_run") > 0), True).when(F.col("f_compound").isNotNull(), False)
                    .otherwise(~((F.col("n_last") >= DOMINANCE) & (F.col("n_front") >= DOMINANCE))))
    whole = F.when(F.col("split") & F.col("tail").isNotNull(), F.col("f_joined"))
    start, rest = F.substring(whole, F.lit(1), F.length(last)), F.substring(whole, F.greatest(F.length(whole) - F.length(front) + 1, F.lit(1)), F.length(front))
    odd_head = F.when(_matches("head", ODD_SQL), F.col("head"))
    head_fixed = F.when(F.col("split"), F.coalesce(F.when(start != last, whole), F.when(whole.isNull(), odd_head), F.when(F.col("head").contains("-"), F.col("f_head")))).otherwise(F.coalesce("f_head", odd_head))
    tail_fixed = F.when(F.col("split"), F.when(rest != front, whole)).otherwise(F.coalesce("f_tail", F.when(F.col("tail_odd"), F.coalesce("tail_word", "tail"))))
    verdict = g.withColumn("split", F.coalesce(split, F.lit(False)))
    verdict = verdict.select(*key, "split", head_fixed.alias("head_fixed"), tail_fixed.alias("tail_fixed"), whole.alias("whole_fixed"))
    same = [occurring[k].eqNullSafe(verdict[k]) for k in key]
    pairs_out = occurring.join(verdict, same).select(occurring["*"], "split", "head_fixed", "tail_fixed", "whole_fixed")
    odd = F.when(~F.col("word").contains("-") & _matches("word", ODD_SQL), F.col("word"))
    misread = asks.join(fixes, "word", "left").select("cache_seq", "line_no", "token", F.coalesce("fixed", odd).alias("fixed")).where("fixed is not null")
    return misread.unionByName(read.where("kind = 'misread'").select("cache_seq", "line_no", "token", F.col("word").alias("fixed"))), pairs_out


def scan_lines(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, line_no, kind (furniture, hyphen, misread) of the prose rows' lines.

    Rows that failed, null and blank texts and rows that aren't prose give none; equal rows give equal lines.
    """
    read, words, texts, none = read_corpus(ocr, pages)
    discard(texts, none)
    misread, pairs = decided(read, words)
    pairs = materialize(pairs)
    wrong = misread.select("cache_seq", "line_no").unionByName(pairs.where("head_fixed is not null").select("cache_seq", "line_no")).unionByName(
        pairs.where("tail_fixed is not null").select("cache_seq", F.col("tail_line").alias("line_no"))).distinct()
    return (read.where("kind = 'furniture'").select("cache_seq", "line_no", "kind").unionByName(pairs.where("split").select("cache_seq", "line_no", F.lit("hyphen").alias("kind")))
            .unionByName(wrong.withColumn("kind", F.lit("misread"))))


def paragraphs(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, paragraph_no, text: the prose rows' running text, split words joined and misread words corrected.

    A paragraph ends at a blank line, an indented line or a break, unless the sentence runs on.
    """
    read, words, texts, none = read_corpus(ocr, pages)
    misread, pairs = decided(read, words)
    edits = (read.where("kind in ('furniture', 'break')").select("cache_seq", F.struct("line_no", F.lit(-1).alias("token"), "kind", F.lit("").alias("word")).alias("e"))
             .unionByName(misread.select("cache_seq", F.struct("line_no", "token", F.lit("word").alias("kind"), F.col("fixed").alias("word")).alias("e")))
             .unionByName(pairs.where("split").select("cache_seq", F.struct("line_no", "token", F.lit("join").alias("kind"), F.coalesce("whole_fixed", F.lit("")).alias("word")).alias("e")))
             .unionByName(pairs.where("not split and head_fixed is not null").select("cache_seq", F.struct("line_no", "token", F.lit("word").alias("kind"), F.col("head_fixed").alias("word")).alias("e")))
             .unionByName(pairs.where("not split and tail_fixed is not null").select("cache_seq", F.struct(F.col("tail_line").alias("line_no"), F.lit(0).alias("token"), F.lit("word").alias("kind"), F.col("tail_fixed").alias("word")).alias("e"))))
    of_page = edits.groupBy("cache_seq").agg(F.array_sort(F.collect_list("e")).alias("e"))  # a few per line of a page
    whole = texts.select("cache_seq", "text").join(none, "cache_seq", "left_anti").join(of_page, "cache_seq", "left")
    flat = whole.select("cache_seq", "text", *[F.coalesce(F.col(f"e.{k}"), F.array()).alias(k) for k in ("line_no", "token", "kind", "word")])
    return map_rows(flat, "cache_seq bigint, paragraph_no int, text string", lambda: lambda seq, text, *e: [(seq, k + 1, p) for k, p in enumerate(joined(text, list(zip(*e))))])


def joined(text: str, edits: list[tuple[int, int, str, str]]) -> list[str]:
    """Paragraphs of a page from its edits: (line, token, furniture | break | word | join, correction)."""
    at: dict[int, list] = {}
    for line, *edit in edits:
        at.setdefault(line, []).append(edit)
    done, now, cut, blank, whole = [], "", False, False, ""
    for i, raw in enumerate(text.split("\n"), 1):
        s = raw.strip()
        mine = at.get(i, ())
        if not s:
            blank = True
            continue
        if any(e[1] == "furniture" for e in mine):
            continue
        heading, joins = any(e[1] == "break" for e in mine), [e for e in mine if e[1] == "join"]
        tokens = s.split()
        for token, kind, fixed in mine:
            w = tokens[token].strip(STRIP) if kind == "word" else ""
            if w and fixed.lower() != w.lower():
                tokens[token] = tokens[token].replace(w, fixed.capitalize() if w[:1].isupper() else fixed)
        starts = bool(now) and not cut and (heading or blank or raw[:2].isspace()) and (now[-1:] in ".?!:" or not s[0].islower())
        if starts:
            done.append(now)
            now = ""
        if cut and whole:  # both halves of the word give way to its correction
            before, _, half = now.rpartition(" ")
            rest = tokens[0][len(tokens[0].rstrip(STRIP)):]
            lead = half[: len(half) - len(half.lstrip(STRIP))]
            now, tokens[0] = f"{before} ".lstrip() + lead, (whole.capitalize() if half.strip(STRIP)[:1].isupper() else whole) + rest
        line = " ".join(tokens)
        now = now + line if cut or not now or now[-1] in HYPHENS else f"{now} {line}"
        cut, blank, whole = bool(joins), False, joins[0][2] if joins else ""
        if cut:
            now = now.rstrip(HYPHENS)
        if heading:
            done.append(now)
            now, cut = "", False
    return done + [now] if now else done
