"""Problem 4: values that lost text.

Intact values are cut artificially, at random places and with the endings a cut may get (an ellipsis, closed
quotes and brackets, blanks). A logistic regression over hashed features of each text's end - closing characters,
words, punctuation, open structure, length against the provider's usual limits - learns them from the intact
ones, and every value is scored by the most suspect of its ends: its own and those of the texts inside it.

The regression is fitted on at most SAMPLE values; each task fits its share and each weight is averaged over the tasks that saw its feature. All
rows are scored; the usual endings and limits come from all rows and are bounded by their least share.
"""

from __future__ import annotations

import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .common import map_rows

SAMPLE, PARTS, STEPS = 24_000, 6, 500
WIDTH = 1 << 15
#: An ending is usual from this many values and this share of them; a length is a limit from this share of a provider's values.
USUAL_COUNT, USUAL_SHARE = 12, 0.001
LIMIT_COUNT, LIMIT_SHARE, LIMIT_PEAK = 4, 0.004, 4
#: Characters of an end that the features see, and of the longest usual ending (longer ones are compared by no list).
TAIL, ENDING = 90, 80
THRESHOLD = 0.5
FIELDS = ("raw_response", "reasoning_content")

#: What may be put after a cut; no mark is longer than MARK_LENGTH.
MARK, MARK_LENGTH = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…|truncated|cut)\]|<truncated>|\(truncated\)|--)\Z", re.I), 16
PAIR = re.compile(r"""(?:"(\w+)"\s*:\s*"((?:[^"\\]|\\.)*)")|(?:'(\w+)'\s*:\s*'((?:[^'\\]|\\.)*)')|<p>(.*?)</p>()""", re.S)
STRING = re.compile(r'"(?:[^"\\]|\\.)*"')
NUMBER = re.compile(r"\d[\d.]*\d|\d")
SENTENCE = re.compile(r"(?:(?<=[.?!}`>])\s+|\n+)")

EQUAL_ITEMS = re.compile(r"(\S{1,80})(?:, \1)+")  # longer items make no usual ending


def _numbers(text: str) -> str:
    """Numbers as '#', those of three digits and more with their length: a handle cut short differs from a whole one."""
    return NUMBER.sub(lambda m: "#" if len(m[0]) < 3 or "." in m[0] else f"#{len(m[0])}", text)


def last_sentence(value: str) -> str:
    """The value's last sentence or line, numbers as '#', a list of equal items as one; '' for one of more than ENDING characters."""
    value, window = value.strip(), 200
    parts = SENTENCE.split(value[-window:])
    while len(parts) == 1 and window < len(value):  # the start lies further back
        window *= 4
        parts = SENTENCE.split(value[-window:])
    s = _numbers(parts[-1])
    if ", " in s:
        s = EQUAL_ITEMS.sub(r"\1", s)
    return s if len(s) <= ENDING else ""


def unmarked(text: str) -> tuple[str, bool]:
    """The text without blanks and a mark at its end, and whether there is a mark."""
    t = text.rstrip()
    m = MARK.search(t, max(0, len(t) - MARK_LENGTH))
    return (t[: m.start()].rstrip(), True) if m else (t, False)


def outside_strings(text: str) -> str:
    """The text without its quoted strings; a quote that isn't closed stays, with what follows."""
    if '\\"' in text:
        return STRING.sub("", text)
    parts = text.split('"')
    return "".join(parts[::2]) if len(parts) % 2 else "".join(parts[:-1:2]) + '"' + parts[-1]


def ends(value: str) -> list[tuple[str, str, str]]:
    """(kind, text up to its end, state) of the value itself and of each text inside it."""
    e, marked = unmarked(value)
    state = "m" if marked else "w" if value[-1:].isspace() else ""
    out = []
    if "{" in e or "(" in e or "[" in e or "<p>" in e:
        bare = outside_strings(e)
        if '"' in bare:
            state += "q"
        if bare.count("{") > bare.count("}") or bare.count("[") > bare.count("]") or bare.count("(") > bare.count(")"):
            state += "o"
        for m in PAIR.finditer(e):
            key = m[1] or m[3] or "p"
            text = m[2] or m[4] or m[5] or ""
            if " " in text or len(text) > 24:
                inner, cut_off = unmarked(text)
                out.append(("in:" + key, inner if cut_off else text, "m" if cut_off else ""))
    if "```" in e and e.count("```") % 2:
        state += "f"
    out.append(("json" if out or e[:1] in "{[`" else "text", e, state))
    return out


class _Numbered(dict):
    """Numbers of features by their names, kept for those seen before."""

    def __missing__(self, name: str) -> int:
        i = zlib.crc32(name.encode("utf-8", "replace")) % WIDTH
        if len(self) < 1_000_000:
            self[name] = i
        return i


_number = _Numbered()


def features(kind: str, text: str, state: str, usual: frozenset, at_limit: bool) -> list[int]:
    tail = text[-TAIL:]
    tokens = _numbers(tail).split()
    word = tokens[-1] if tokens else ""
    close = tail[-1:]
    c = "a" if close.isalpha() else "9" if close.isdigit() else close
    line = text[text.rfind("\n") + 1 :][:TAIL]
    note = line[:2] == "- "
    two = " ".join(tokens[-2:])
    plain = [f"k{kind}", f"c{kind}{c}", f"s{kind}{state}", f"n{note}{c}", f"w{kind[:2]}{word}", f"2{kind[:2]}{two}", f"4{close if not tail else tail[-4:]}", f"l{at_limit}{c}", f"m{state}{c}", f"cc{c}"]
    if kind[:3] != "in:":
        last = last_sentence(text)
        plain.append(f"u{last in usual}{kind}")
        plain.append(f"us{last + '…' in usual or last + '...' in usual}{'m' in state}")
    return [_number[x] for x in plain]


def intact(value: str, usual: frozenset) -> bool:
    """Surely complete, for training: closed structure whose prose ends in a stop, a final stop, or a usual ending."""
    t = value.strip()
    if len(t) < 40:
        return False
    body = re.sub(r"^.*?(?=\{)|(?<=\})[^}]*$", "", t, flags=re.S) if "{" in t else ""
    if body:
        try:
            found = json.loads(body)
        except ValueError:
            return t[-1] in ".?!>}" and t[0] in "{<" and '"' not in outside_strings(t) and t.count("{") == t.count("}")
        prose = [m[2] for m in PAIR.finditer(body) if m[2] and len(m[2].split()) >= 4]
        return isinstance(found, dict) and all(x[-1] in ".?!" for x in prose) and (t[-1] in "}`" or last_sentence(t) in usual)
    return (t[-1] in ".?!)`" or t[0] == "<" and t[-1] == ">") and not unmarked(t)[1] or last_sentence(t) in usual


def cut(value: str, rng: random.Random, lengths: tuple[int, ...] = ()) -> tuple[str, str | None] | None:
    """The value with text lost, and the kind of the end that shows it (None: the value's own); None if nothing fits.

    lengths: those at which the provider's values pile up; a longer value is cut at one of them every other time.
    """
    inner = [(m, i) for m in PAIR.finditer(value) for i in (2, 4, 5) if m[i] and len(m[i]) >= 30]
    tail = rng.choice(("", "", "", "…", "...", " ", "  ", "\n"))
    if inner and rng.random() < 0.4:
        m, i = rng.choice(inner)
        text = m[i][: rng.randint(8, len(m[i]) - 4)]
        if text[-1] in ".?! ":
            return None
        return value[: m.start(i)] + text + (tail if tail in ("…", "...") else "") + value[m.end(i) :], "in:" + (m[1] or m[3] or "p")
    if (lengths := [n for n in lengths if n < len(value)]) and rng.random() < 0.5:
        return value[: rng.choice(lengths)], None
    text = value[: rng.randint(int(len(value) * 0.2) + 1, max(int(len(value) * 0.2) + 2, len(value) - 4))]
    return None if not text.strip() or text.rstrip()[-1] in ".?!})`>" else (text + tail, None)


def _values(outputs: DataFrame) -> DataFrame:
    """output_id, provider, field, value: one row per non-blank text; repeated rows are one."""
    one = outputs.where("output_id is not null").select("output_id", F.coalesce("provider", F.lit("")).alias("provider"), *FIELDS)
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return one.select("output_id", "provider", F.explode(fields).alias("f")).select("output_id", "provider", "f.*").where("value rlike '\\\\S'")


def _limits(values: DataFrame) -> frozenset:
    """(provider, field, length) at which values pile up; each holds LIMIT_SHARE of its provider's values."""
    counted = values.groupBy("provider", "field", F.length("value").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("provider", "field").orderBy("length").rangeBetween(-12, 12)
    total = Window.partitionBy("provider", "field")
    peaks = counted.withColumns({"near": F.sum("n").over(near) - F.col("n"), "total": F.sum("n").over(total)})
    peaks = peaks.where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= F.col("total") * LIMIT_SHARE) & (F.col("n") * 24 >= F.col("near") * LIMIT_PEAK) & (F.col("length") >= 100))
    return frozenset((r[0], r[1], r[2]) for r in peaks.select("provider", "field", "length").collect())


def _usual(values: DataFrame, n: int) -> frozenset:
    last = map_rows(values.select("value"), "s string", lambda: lambda v: [(s,)] if (s := last_sentence(v)) else [])
    counted = last.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(USUAL_COUNT, n * USUAL_SHARE))
    return frozenset(r[0] for r in counted.select("s").collect())


def _weights(values: DataFrame, n: int, usual, limits) -> np.ndarray:
    share = min(1.0, SAMPLE / max(1, n))
    of: dict = {}
    for provider, field, length in sorted(limits):
        of[provider, field] = (*of.get((provider, field), ()), length)
    sample = values.where(F.pmod(F.xxhash64("output_id", "field"), F.lit(1_000_000)) < int(share * 1_000_000)).repartition(PARTS, "output_id")

    def run(batches):
        rows, label = [], []
        for batch in batches:
            for oid, provider, field, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not intact(value, usual):
                    continue
                rng, at = random.Random(oid * 2 + (field == FIELDS[1])), of.get((provider, field), ())
                for kind, text, state in ends(value):
                    rows.append(features(kind, text, state, usual, len(value) in at)), label.append(0.0)
                for _ in range(2):
                    if not (made := cut(value, rng, at)):
                        continue
                    shown = [x for x in ends(made[0]) if x[0] == made[1] or made[1] is None]
                    kind, text, state = shown[-1] if shown else ends(made[0])[-1]
                    rows.append(features(kind, text, state, usual, len(made[0]) in at)), label.append(1.0)
        w = fit(rows, np.array(label))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64()), pa.array(np.full(len(at), len(label)), pa.int64())], names=["i", "w", "n"])

    parts = sample.select("output_id", "provider", "field", "value").mapInArrow(run, "i int, w double, n bigint").collect()
    w, seen = np.zeros(WIDTH), np.zeros(WIDTH)
    for r in parts:
        w[r[0]] += r[1] * r[2]
        seen[r[0]] += r[2]
    return w / np.maximum(seen, 1)


def fit(rows: list[list[int]], label: np.ndarray) -> np.ndarray:
    """Logistic regression on rows of feature numbers, by adaptive gradient steps; zeros without both labels."""
    w = np.zeros(WIDTH)
    if not len(label) or label.min() == label.max():
        return w
    width = max(map(len, rows))
    x = np.array([r + [WIDTH] * (width - len(r)) for r in rows])
    w, g2 = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-2)
    balance = np.where(label > 0, 0.5 / label.mean(), 0.5 / (1 - label.mean()))
    order = np.random.default_rng(7)
    done = 0
    while done < STEPS:
        for at in np.array_split(order.permutation(len(label)), max(1, len(label) // 256)):
            done += 1
            p = 1 / (1 + np.exp(-np.clip(w[x[at]].sum(1), -30, 30)))
            g = np.bincount(x[at].ravel(), np.repeat((p - label[at]) * balance[at], width), WIDTH + 1) / len(at) + 1e-5 * w
            g[WIDTH] = 0
            g2 += g * g
            w -= 0.3 * g / np.sqrt(g2)
    return w[:WIDTH]


def scored(outputs: DataFrame) -> DataFrame:
    """output_id, provider, field, score of every non-blank value; repeated rows come once."""
    values = materialize(_values(outputs))
    n = values.count()
    usual, limits = _usual(values, n), _limits(values)
    shared = outputs.sparkSession.sparkContext.broadcast((_weights(values, n, usual, limits).astype(np.float32), usual, limits))

    def make():
        weights, usual, limits = shared.value
        weights = weights.tolist()

        def each(oid, provider, field, value):
            at_limit = (provider, field, len(value)) in limits
            score = max(sum(weights[i] for i in features(*e, usual, at_limit)) for e in ends(value))
            return [(oid, provider, field, float(1 / (1 + np.exp(-max(-30.0, min(30.0, score))))))]

        return each

    scores = map_rows(values.select("output_id", "provider", "field", "value"), "output_id bigint, provider string, field string, score double", make)
    return scores.groupBy("output_id", "field").agg(F.max("provider").alias("provider"), F.max("score").alias("score"))


def truncated(outputs: DataFrame) -> DataFrame:
    """output_id, field of the values that lost text. Null and blank values are none; repeated rows give one."""
    return scored(outputs).where(F.col("score") > THRESHOLD).select("output_id", "field")


def truncation_rates(outputs: DataFrame) -> DataFrame:
    """provider, field, n_values, n_truncated, share; a null provider is reported as ''."""
    hit = F.count_if(F.col("score") > THRESHOLD)
    return scored(outputs).groupBy("provider", "field").agg(F.count(F.lit(1)).alias("n_values"), hit.alias("n_truncated"), (hit / F.count(F.lit(1))).alias("share"))
