"""Problems 1 and 2 share one pass over the page texts: statistics of the page and counts for the line model.

The pass emits, per row, the statistics of the text without its repeated lines and, per task, partial counts of
words and line shapes of all pages; only the counts are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FUNCTION_SETS, LEAST_SHARE
from .page_layout import EQUATION, FLOWS, FORMS, FORMULA, NUMBER_ALONE, PLACES, REPETITIONS, STRIP, Layout, as_array, sums
from .repeated_lines import line_counts

STATISTICS = ("log_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "digit_ratio", "words_per_line", "single_characters", "marked_lines", "broken_spacing")
#: Smallest standard deviation of each statistic: a statistic that never varies in prose must not decide alone.
FLOOR = (0.5, 0.25, 0.02, 0.12, 0.05, 0.03, 1.0, 0.02, 0.08, 0.05)
LANGUAGES = tuple(FUNCTION_SETS)
#: Rows worked on at once, and distinct words a task counts before it hands them on.
ROWS, WORDS = 1_000, 400_000


def prepared(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, text, n_pages, on_pages of rows with ocr_ok whose text isn't blank."""
    at = line_counts(ocr, pages).select("cache_seq", "n_pages", "on_pages")
    rows = ocr.where("ocr_ok and ocr_text rlike '\\\\S'").select("cache_seq", F.col("ocr_text").alias("text"))
    return rows.join(at, "cache_seq")


def layouts(batches) -> Iterator[tuple[np.ndarray, Layout]]:
    """(cache_seq, layout) of slices of Arrow batches of prepared rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0).to_numpy(), Layout(as_array(part.column(1)), part.column(3), part.column(2).to_numpy())


def own_lines(page: Layout, min_pages: int = 2, min_share: float = 0.1) -> np.ndarray:
    """Whether each line is neither repeated through the document nor a bare page number."""
    return (page.on < np.maximum(min_pages, min_share * page.n_pages)[page.page]) & ~page.number


def statistics(page: Layout) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language by function words and the statistics of each page, in the order of STATISTICS (zeros for no lines of its own); which lines are own.

    The language is the one whose function words are the largest share of the tokens, single letters aside; English
    if its share is a fifth; und below LEAST_SHARE.
    """
    own, m = own_lines(page), page.pages
    of = page.page[own]
    k = np.bincount(of, minlength=m).astype(float)
    mine = own[page.owner]
    token, at = page.token[mine], page.page[page.owner[mine]]
    n = np.bincount(at, minlength=m).astype(float)
    low = [w.lower() for w in page.words]
    single = np.array([len(w) == 1 for w in low], bool)
    n1, k1 = np.maximum(1, n), np.maximum(1, k)
    share = np.stack([sums(np.array([w in FUNCTION_SETS[name] and len(w) > 1 for w in low], bool)[token], at, m) / n1 for name in LANGUAGES], 1) if m else np.zeros((0, len(LANGUAGES)))
    english = sums(np.array([w in FUNCTION_SETS["en"] for w in low], bool)[token], at, m) / n1
    best = share.argmax(1)
    common = np.where(english >= 0.2, english, share.max(1, initial=0.0))
    lang = ["en" if e >= 0.2 else LANGUAGES[b] if s >= LEAST_SHARE else "und" for e, b, s in zip(english, best, common)]
    size, letters, digits, blanks = (x[own] for x in page.classes)
    chars = sums(page.length[own], of, m) + k - n
    symbols = sums(size - letters - digits - blanks, of, m)
    stops, marked = page.ends(".?!:;"), page.marked
    out = np.stack([
        np.log1p(n), np.minimum(20.0, chars / n1), symbols / np.maximum(1, chars), sums(stops[own], of, m) / k1, common, sums(digits, of, m) / np.maximum(1, chars),
        np.minimum(25.0, n / k1), sums(single[token], at, m) / n1, sums(marked[own], of, m) / k1, sums(page.spaced[own], of, m) / k1,
    ], 1)
    out[k == 0] = 0
    return ["und" if not x else y for x, y in zip(k, lang)], out, own


def kinds(page: Layout, stats: np.ndarray, own: np.ndarray) -> list[str]:
    """What each page looks like, should it be no prose: columns are a table, marked or indexed lines a list, anything else junk."""
    plain = (stats[:, 4] >= 0.24) & (stats[:, 8] <= 0.3) & (stats[:, 9] <= 0.3)
    out = np.where(stats[:, 8] >= stats[:, 9], "list", "table").astype(object)
    at = np.flatnonzero(own & ~plain[page.page])
    of, m = page.page[at], page.pages
    k = np.maximum(1, np.bincount(of, minlength=m))
    count = lambda x: sums(x, of, m)
    letters, length = page.classes[1][at], page.length[at]
    wordy = count((letters >= 3) & (letters > 0.25 * length))
    entries = page.entries[at]
    listed = count(page.marked[at] & ~entries)
    columns = count(page.spaced[at] & (length >= 2.5 * page.tokens[at]))
    rows, index = np.zeros(len(at), bool), np.zeros(len(at), bool)
    widths = np.zeros(len(at), np.int64)
    commas = np.flatnonzero(page.commas[at] >= 1)
    for i, s in zip(commas.tolist(), page.text.take(pa.array(at[commas])).to_pylist()):
        c = s.split(",")
        widths[i] = len(c)
        rows[i] = len(c) >= 3 and all(len(x.split()) <= 2 and (j == 0 or x[:1] == " ") for j, x in enumerate(c))
        if entries[i]:
            v = [int(x) for x in c[1:] if x.strip().isdigit()]
            index[i] = bool(v) and v == sorted(v)
    cells, index = count(rows), count(index)
    kinds_of_rows = np.bincount(np.unique(np.stack([of[rows], widths[rows]], 1), axis=0)[:, 0], minlength=m) if rows.any() else np.zeros(m)
    bare = (wordy < 0.35 * k) & (columns < 0.5 * k) & (cells < 0.5 * k)
    named = np.select(
        [bare & (listed >= 0.6 * k), bare, listed >= 0.5 * k, columns >= 0.5 * k, (cells >= 0.5 * k) & (index >= 0.7 * k) & (kinds_of_rows >= 2), cells >= 0.5 * k, (index >= 0.5 * k) | (listed >= 0.3 * k)],
        ["list", "junk", "list", "table", "list", "table", "list"], "junk")
    return np.where(plain, out, named).tolist()


# Counts for the line model. A cell is a line's repetition, place, form and flow.

CELLS = REPETITIONS * PLACES * FORMS * FLOWS
BREAKS = (EQUATION, 2, 3, FORMULA, 8)  # forms that break the running text: equations, capitals, headings, formulas, heads
FURNITURE, BODY, BREAK = 0, 1, 2


def cell_of(page: Layout, form: np.ndarray, flow: np.ndarray) -> np.ndarray:
    return ((page.repetition * PLACES + page.place) * FORMS + form) * FLOWS + flow


def first_states(page: Layout, form: np.ndarray) -> np.ndarray:
    """What a line surely or most simply is: repeated for sure or a number alone, of a breaking form, or body."""
    return np.where((page.repetition == 4) | (form == NUMBER_ALONE), FURNITURE, np.where(np.isin(form, BREAKS), BREAK, BODY))


class Counts:
    """Sums over a task's pages: cells, moves between first states, words inside body lines (m), at their ends (e), in breaks (h) and in sure furniture (f)."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.cells, self.moves, self.words = np.zeros(CELLS, np.int64), np.zeros((3, 3), np.int64), {k: Counter() for k in "mehf"}

    def add(self, page: Layout) -> None:
        form, flow = page.context()
        self.cells += np.bincount(cell_of(page, form, flow), minlength=CELLS)
        state = first_states(page, form)
        inner = page.page[1:] == page.page[:-1]
        np.add.at(self.moves, (state[:-1][inner], state[1:][inner]), 1)
        state = state[page.owner]
        at = np.arange(len(page.token))
        edge = (at == page.token_start[page.owner]) | (at == page.last_token[page.owner])
        for k, where in (("f", state == FURNITURE), ("h", state == BREAK), ("m", (state == BODY) & ~edge), ("e", (state == BODY) & edge)):
            n = np.bincount(page.token[where], minlength=len(page.words))
            counter = self.words[k]
            for i in np.flatnonzero(n).tolist():
                counter[page.words[i]] += int(n[i])

    def rows(self) -> list[tuple[str, int]]:
        out = Counter({f"c{i}": int(self.cells[i]) for i in np.flatnonzero(self.cells)} | {f"t{i}{j}": int(self.moves[i, j]) for i in range(3) for j in range(3) if self.moves[i, j]})
        for k in "mehf":
            for token, n in self.words[k].items():
                if (word := token.strip(STRIP)) and not (k == "f" and word[0].isdigit()):
                    out[k + word] += n
        self.clear()
        return list(out.items())


PASSED = "cache_seq bigint, lang string, kind string, stats array<double>, what string, n bigint"
_SCHEMA = pa.schema([("cache_seq", pa.int64()), ("lang", pa.string()), ("kind", pa.string()), ("stats", pa.list_(pa.float64())), ("what", pa.string()), ("n", pa.int64())])


def page_pass(rows: DataFrame, counting: bool = False) -> DataFrame:
    """One pass over the texts. Rows with cache_seq: lang, kind, stats of a page.

    With counting, also rows without cache_seq: partial counts `n` per `what` (see Counts), to be summed.
    """
    def run(batches):
        counts = Counts()

        def counted():
            found = counts.rows()
            none = [None] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((none, none, none, none, [x[0] for x in found], [x[1] for x in found]), _SCHEMA)], schema=_SCHEMA)

        for seq, page in layouts(batches):
            lang, stats, own = statistics(page)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, stats.shape[1]), pa.int32()), pa.array(stats.ravel()))
            none = pa.nulls(len(seq), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(lang, pa.string()), pa.array(kinds(page, stats, own), pa.string()), lists, none, pa.nulls(len(seq), pa.int64())], schema=_SCHEMA)
            if counting:
                counts.add(page)
                if sum(map(len, counts.words.values())) > WORDS:
                    yield counted()
        if counting:
            yield counted()

    return rows.select("cache_seq", "text", "n_pages", "on_pages").mapInArrow(run, PASSED)


def page_statistics(rows: DataFrame) -> DataFrame:
    """cache_seq, lang, kind, stats."""
    return page_pass(rows).drop("what", "n")
