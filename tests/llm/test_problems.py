import datetime as dt
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliospark.llm import common, mixing, packing, reading_level, repeated_lines, scan_repair, text_quality, tokens, top_n, truncation
from foliospark.llm.page_layout import HEAD, IN_COLUMNS, INTERRUPTS, NUMBER_ALONE, RUNS_ON, Layout
from foliospark.llm.page_text import kinds, own_lines, statistics

WORDS = "page record reader summary table answer query section ranking window corpus margin budget signal pattern figure layout method".split()
VERBS = "removes follows covers reports separates updates".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} in the {rng.choice(WORDS)} {rng.choice(VERBS)} the {rng.choice(WORDS)} of each {rng.choice(WORDS)} when the {rng.choice(WORDS)} is final."


def wrapped(rng, n=6, width=60):
    text, lines, now = " ".join(sentence(rng) for _ in range(n)), [], ""
    for w in text.split():
        if len(now) + len(w) >= width:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}".strip()
    return lines + [now]


def scans(spark):
    """40 prose pages of one document with a running header and page numbers, one table, one list, one reversed page, planted errors, and failed, null and blank rows."""
    rng = random.Random(5)
    rows, pages, seq = [], [], 0
    for i in range(1, 41):
        body = wrapped(rng)
        if i == 7:
            body[2] = body[2].replace("the", "tbe", 1)
        if i == 8:
            head, _, rest = body[3].rpartition(" ")
            last = body[3] = head + " rank-"
            body[4] = "ing is final when the page follows the record."
        rows.append((i, f"p{i}", True, "\n".join(["Annual Digest Of Page Records", *body, f"Page {i}"])))
        pages.append((f"p{i}", "d", i))
    rows += [(41, "p41", True, "\n".join(["Word  Count  Share"] + [f"{w}  {i}  0.{i}" for i, w in enumerate(WORDS)])), (42, "p42", True, "\n".join(f"- short {w}" for w in WORDS)),
             (43, "p43", True, "\n".join(x[::-1] for x in wrapped(rng))), (44, "p44", False, "Page 3"), (45, "p45", True, None), (46, "p46", True, " \r\n \n"), (47, "p47", None, "x"), (48, "unknown", True, "\n".join(wrapped(rng)))]
    pages += [(f"p{i}", "d", i) for i in range(41, 48)] + [("p1", "d", 1), (None, "d", 9), ("p9x", None, 1)]
    ocr = spark.createDataFrame([(a, b, None, c, d, dt.datetime(2026, 1, 1)) for a, b, c, d in rows], "cache_seq bigint, page_id string, document_id string, ocr_ok boolean, ocr_text string, cached_at timestamp")
    return ocr, spark.createDataFrame(pages, "page_id string, document_id string, page_index int").withColumn("doc", F.lit("clash"))


def test_p5_against_brute_force(spark):
    ocr, pages = scans(spark)
    got = {tuple(r) for r in repeated_lines.repeated_lines(ocr, pages).collect()}
    assert got == {(i, 1) for i in range(1, 41)}
    clean = {r.cache_seq: r for r in repeated_lines.without_repeated_lines(ocr, pages).collect()}
    assert clean[3].removed == 1 and "Annual" not in clean[3].text and clean[3].text.endswith("Page 3")
    assert repeated_lines.repeated_lines(ocr.where("false"), pages).count() == 0 and repeated_lines.repeated_lines(ocr, pages.where("false")).count() == 0
    report = repeated_lines.repeated_line_report(ocr, pages).collect()
    assert len(report) == 1 and report[0].on_pages == 40 and report[0].clusters == 40 and report[0].dates == 1


def test_p5_keys_ignore_what_may_differ(spark):
    same = ["Fetched on 2025-03-04 by desk 12.", "FETCHED  ON 4.3.2025 BY DESK 7", "Fetchcd on 04/03/2025 by de5k 9", "Fetched ori 2025-01-01 by desk 3\r"]
    other = ["Fetched from 2025 by another desk", "Page 4", "- 5 -", "p@ge lO of 12", "", "  ", "xiv"]
    r = spark.createDataFrame([("\n".join(same + other),)], "t string").select(repeated_lines.line_keys(F.col("t")).alias("k")).first().k
    assert len(set(r[:4])) == 1 and r[0] != 0 and r[4] not in (0, r[0]) and set(r[5:]) == {0}


def test_p5_join_by_shuffle_agrees(spark, monkeypatch):
    ocr, pages = scans(spark)
    monkeypatch.setattr(repeated_lines, "BROADCAST_ENTRIES", 0)
    assert repeated_lines.repeated_lines(ocr, pages).count() == 40


def test_p5_copies_and_second_readings(spark):
    """A page published six times is one cluster on six pages; a page read twice counts once for lines of both readings."""
    same, rows = "A shared notice of the paper\nonly on the copied page here", []
    for i in range(1, 7):
        rows.append((i, f"p{i}", same))
    rows += [(7, "p7", "A shared notice of the paper\nfirst reading of this page"), (8, "p7", "A shared notice of the paper\nother words in the second"), (9, "p7", "A shared notice of the paper\nfirst reading of this page")]
    rows += [(20 + i, f"q{i}", f"Some {WORDS[i]} of its own {WORDS[i + 8]}\nA notice on four pages only" if i < 4 else f"Plain {WORDS[i]} text {WORDS[i + 8]} stands here") for i in range(8)]
    ocr = spark.createDataFrame([(a, b, True, c, dt.datetime(2026, 1, 1)) for a, b, c in rows], "cache_seq bigint, page_id string, ocr_ok boolean, ocr_text string, cached_at timestamp")
    pages = spark.createDataFrame([(p, "d") for p in sorted({r[1] for r in rows})], "page_id string, document_id string")
    got = {tuple(r) for r in repeated_lines.repeated_lines(ocr, pages).collect()}
    assert got == {(i, 1) for i in range(1, 10)} | {(i, 2) for i in range(1, 7)}
    counted = {r.on_pages: r.clusters for r in repeated_lines.count_lines(*repeated_lines.keyed_pages(ocr, pages)).collect()}
    assert counted == {7: 2, 6: 1, 4: 4}


def test_p5_short_lines_with_a_misread_character(spark):
    r = spark.createDataFrame([("Draft copy\nDraft c0py\nDraft cupy\nDrafts cop",)], "t string").select(repeated_lines.line_keys(F.col("t")).alias("k")).first().k
    assert r[0] == r[1] and len({r[0], r[2], r[3]}) == 3


def test_p2_and_p1(spark):
    ocr, pages = scans(spark)
    assert {tuple(r) for r in text_quality.not_prose(ocr, pages).collect()} == {(41, "table"), (42, "list"), (43, "junk")}
    got = {tuple(r) for r in scan_repair.scan_lines(ocr, pages).collect()}
    assert {r for r in got if r[2] == "hyphen"} == {(8, 5, "hyphen")}
    assert {r for r in got if r[2] == "misread"} == {(7, 4, "misread")}
    furniture = {r[:2] for r in got if r[2] == "furniture"}
    assert {(i, 1) for i in range(1, 41)} <= furniture and all(s <= 40 for s, _ in furniture)
    paragraphs = {r.cache_seq: r.text for r in scan_repair.paragraphs(ocr, pages).where("paragraph_no = 1").collect()}
    assert "ranking is final" in paragraphs[8] and "Annual" not in paragraphs[8] and "tbe" not in paragraphs[7]
    assert text_quality.not_prose(ocr.where("false"), pages).count() == 0 and scan_repair.scan_lines(ocr.where("false"), pages).count() == 0


def test_p2_contributions_add_up(spark):
    r = text_quality.report(*scans(spark)).where("cache_seq = 41").first()
    assert math.isclose(sum(r[c] for c in r.asDict() if c.endswith("_contribution")), r.d2, rel_tol=1e-6)


def test_p2_distance_decides(spark):
    """Symbols and digits between function words: no threshold on those words or on line shapes finds the row, its distance does."""
    ocr, pages = scans(spark)
    torn = "\n".join("the ##%$ 4471 of @@~^ 90817 and {}<> 5531 to" for _ in range(12))
    ocr = ocr.unionByName(ocr.where("cache_seq = 43").withColumns({"cache_seq": F.lit(60).cast("bigint"), "page_id": F.lit("p60"), "ocr_text": F.lit(torn)}))
    rows = {r.cache_seq: r for r in text_quality.report(ocr, pages).collect()}
    assert rows[60].common_words >= 0.3 and rows[60].marked_lines == 0 and rows[60].broken_spacing == 0
    assert rows[60].away > text_quality.CUTOFF > max(rows[i].away for i in range(1, 41))
    assert {r.cache_seq for r in text_quality.not_prose(ocr, pages).collect()} == {41, 42, 43, 60}


def page_of(*texts, on=None, n_pages=40):
    lists = on or [[0] * (t.count("\n") + 1) for t in texts]
    return Layout(pa.array(texts, pa.string()), pa.array(lists, pa.list_(pa.int32())), np.full(len(texts), n_pages))


def test_page_helpers():
    empty = page_of("\n \n")
    lang, stats, own = statistics(empty)
    assert lang == ["und"] and not stats.any() and not len(own) and kinds(empty, stats, own) == ["junk"]
    numbers = ["Page 3", "[12]", "- 4 -", "Page lO of 12", "xiv", "3/7", "Page encoders", "(7)"]
    assert own_lines(page_of("\n".join(numbers))).tolist() == [False] * 6 + [True] * 2
    two = page_of("Word | Count | Share\npage | 12 | 0.25\ntable | 3 | 0.5", "1) go\n2) stay\n3) run")
    assert kinds(two, *statistics(two)[1:]) == ["table", "list"]


def test_statistics_against_plain_python():
    rng = random.Random(3)
    texts = ["\n".join(wrapped(rng)) for _ in range(5)] + ["• ein Wort\n  der die das | x\n\n99% more", "  é à  \r\nle la les et", "xy z"]
    page = page_of(*texts)
    _, stats, own = statistics(page)
    for text, row in zip(texts, stats):
        lines = [x.strip() for x in text.split("\n") if x.strip()]
        tokens, body = " ".join(lines).split(), " ".join(lines)
        want = [math.log1p(len(tokens)), min(20.0, (len(body) - len(tokens) + 1) / len(tokens))]
        assert np.allclose(row[:2], want) and np.isclose(row[6], min(25.0, len(tokens) / len(lines))) and np.isclose(row[3], sum(x[-1] in ".?!:;" for x in lines) / len(lines))
        other = [b for b in body.encode() if not chr(b).isascii() or not (chr(b).isalnum() or chr(b) in " \t")]
        assert np.isclose(row[2], len(other) / (len(body) - len(tokens) + 1))


def test_p1_forms_of_lines():
    table = ["Word | Count | Share", "-----+-----+-----", "figure | 12 | 0.25", "page | - | 33", "2.1 Page layout", "Page 3"]
    form, _ = page_of("\n".join(table)).context()
    assert form[[0, 1, 4]].tolist() == [HEAD] * 3 and form[3] == IN_COLUMNS and form[5] == NUMBER_ALONE
    form, _ = page_of("Annual Digest | Print | Save\nfigure | 12 | 0.25", on=[[20, 0]]).context()
    assert form[0] != HEAD  # repeated: no head even above a table
    _, flow = page_of("The text goes on\nRunning Header\nin the next line.\nAnother one").context()
    assert flow.tolist()[1:3] == [INTERRUPTS, RUNS_ON]


def test_p1_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(2)
    moves, start = np.log(rng.dirichlet(np.ones(3), 3)), np.array([0, 4, 4, 5, 11])
    score = rng.normal(size=(11, 3))
    got = scan_repair.viterbi(score, moves, start)
    for a, b in zip(start[:-1], start[1:]):
        worth = lambda path: sum(score[a + i, s] for i, s in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:]))  # noqa: E731, B023
        assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=int(b - a)), key=worth)
    assert len(scan_repair.viterbi(np.zeros((0, 3)), moves, np.array([0]))) == 0


def test_p1_rare_true_words_stay(spark):
    """However large the corpus: a word is a misreading only beside one that is DOMINANCE times as frequent."""
    words = spark.createDataFrame([("the", 5_000_000), ("tbe", 40_000), ("form", 900_000), ("farm", 300_000), ("rare", 900), ("rarc", 30), ("marginal", 50_000), ("cavern", 40), ("cavem", 30)], "word string, n bigint")
    asked = spark.createDataFrame([(w,) for w in ("tbe", "form", "farm", "rarc", "cavem", "tbc", "tlic", "rnarg1nal", "unseen", "farm-tbe", "x")], "word string")
    got = {r.word: r.fixed for r in scan_repair.corrections(asked, words).collect()}
    assert got == {"tbe": "the", "rarc": "rare", "tbc": "tbe", "rnarg1nal": "marginal", "farm-tbe": "farm-the"} | ({"tlic": "the"} if len("tlic") >= scan_repair.TWO_CHANGES_FROM else {})


def test_p1_vocabulary_bound_changes_nothing(spark, monkeypatch):
    ocr, pages = scans(spark)
    kinds_of = lambda: {tuple(r) for r in scan_repair.scan_lines(ocr, pages).where("kind <> 'furniture'").collect()}
    whole = kinds_of()
    monkeypatch.setattr(scan_repair, "VOCABULARY", 5)
    assert kinds_of() == whole == {(8, 5, "hyphen"), (7, 4, "misread")}


def test_p3_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    scores = [0.0, -0.0, 1.5, 1.5, 2.0, -3.25, 1e308, -1e-300, float("nan"), float("inf"), None]
    items = ["a", "ab", "abc", "abcdefg", "abcdefgh", "abcdefg\0", "ü", "zz", "", None] + [f"page_{i:09d}" for i in range(60)]
    rows = [(rng.choice(["g", "g", "g", "h", None]), rng.choice(items), rng.choice(scores)) for _ in range(900)] + [("one", "x", 1.0), ("none", "x", None)]
    df = spark.createDataFrame(rows, "query_id string, page_handle string, score double").withColumn("lo", F.lit(1))
    monkeypatch.setattr(top_n, "BITS", 2)
    monkeypatch.setattr(top_n, "BROADCAST_CUTOFFS", 0)
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and math.isfinite(s):
            best.setdefault(g, {})[i] = max(s, best.get(g, {}).get(i, -math.inf))
    for n in (1, 10):
        want = {(g, i) for g, m in best.items() for i, _ in sorted(m.items(), key=lambda x: (-x[1], x[0].encode()))[:n]}
        assert {(r.query_id, r.page_handle) for r in top_n.top_n(df, "query_id", "page_handle", "score", n).collect()} == want
    assert top_n.top_n(df.where("false"), "query_id", "page_handle", "score", 3).count() == 0


def test_p4_held_out(spark):
    rng = random.Random(6)
    rows, cut = [], set()
    for i in range(1500):
        text = " ".join(sentence(rng) for _ in range(rng.randint(2, 5)))
        note = "\n".join("- " + sentence(rng)[:-1] for _ in range(3)) + "\n- nothing else to check"
        raw, reason = '{"action": "submit", "rationale": "%s"}' % text, note if i % 3 == 0 else text
        if i % 9 == 1:
            reason, _ = reason[: rng.randint(30, len(reason) - 20)].rstrip(" .") + rng.choice(["", "…"]), cut.add((i, "reasoning_content"))
        if i % 11 == 2:
            raw, _ = '{"action": "submit", "rationale": "%s"}' % text[: rng.randint(30, len(text) - 20)].rstrip(" ."), cut.add((i, "raw_response"))
        rows.append((i, rng.choice(["x", "y", None]), raw, reason))
    rows += [(rows[1][0], rows[1][1], rows[1][2], rows[1][3]), (5000, "x", None, ""), (5001, "x", "  ", None)]
    df = spark.createDataFrame(rows, "output_id bigint, provider string, raw_response string, reasoning_content string")
    got = {tuple(r) for r in truncation.truncated(df).collect()}
    hit = len(got & cut)
    assert hit / len(cut) > 0.95 and hit / len(got) > 0.95
    rates = truncation.truncation_rates(df).collect()
    assert sum(r.n_truncated for r in rates) == len(got) and {r.provider for r in rates} == {"", "x", "y"}
    assert truncation.truncated(df.where("false")).count() == 0


def test_p4_last_sentence_is_whole():
    few, many = ("Checked it. Handles: " + ", ".join(f"page_{i:06d}" for i in range(n)) for n in (3, 400))
    assert truncation.last_sentence(many) == truncation.last_sentence(few) == "Handles: page_#6"
    assert truncation.last_sentence("Done. " + "x" * 5000) == "" and truncation.last_sentence("First line " * 90 + "\n- next  \n") == "- next"


def test_p6_keeps_everything(spark):
    rng = random.Random(7)
    sizes = {str(i): rng.choice([0, 1, 5, 40, 99, 100, 101, 250, 400]) for i in range(1500)}
    items = spark.createDataFrame([*sizes.items(), (None, 5)], "item string, size int")
    got = packing.pack(items, [100, 300]).collect()
    for cap in (100, 300):
        fill, back, pieces = {}, {}, {}
        for r in got:
            if r.capacity == cap:
                fill[r.container] = fill.get(r.container, 0) + r["size"]
                back[r.item] = back.get(r.item, 0) + r["size"]
                pieces[r.item] = pieces.get(r.item, 0) + 1
        assert max(fill.values()) <= cap and back == {k: v for k, v in sizes.items() if v}
        assert all(n == -(-sizes[k] // cap) for k, n in pieces.items())
        assert len(fill) <= 1.05 * sum(sizes.values()) / cap + 1
    assert packing.pack(items.where("false"), [100]).count() == 0


def test_p6_found_packs_every_kind(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word another " * n) for i, n in enumerate([3, 40, 300, 5, 90] * 4)], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("small", 20), ("wide", 400), ("also_wide", 400), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    packed, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda items, capacities: packed.extend(capacities) or pack(items, capacities))
    got = sorted(r.doc_id for r in packing.oversize_documents(docs, kinds).collect())
    assert got == [2, 7, 12, 17] and sorted(packed) == [20, 400]


def test_invariants_hold(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, sentence(rng) * rng.randint(0, 6), rng.choice(["a", "A ", "b", None])) for i in range(200)] + [(900, None, "a")], "doc_id bigint, text string, source string")
    kinds = spark.createDataFrame([("small", 30), ("wide", 100), ("none", None)], "container_kind string, capacity_tokens int")
    n = docs.where("text <> ''").count()
    assert {tuple(r) for r in packing.packing_check(docs, kinds).collect()} == {("small", n, 0, 0, 0), ("wide", n, 0, 0, 0)}
    targets = spark.createDataFrame([("a", 0.2, 2), ("b", 0.7, 2), ("gone", 0.1, 1)], "source string, target_share double, max_repeats int")
    assert {tuple(r) for r in mixing.mixing_check(docs, targets).collect()} == {(s, 0, 0, False, False) for s in ("a", "b", "gone")}


def test_p6_crossover_keeps_items():
    rng = random.Random(8)
    sizes = [rng.randint(1, 60) for _ in range(80)]
    a, b = (packing.best_fit(rng.sample(range(80), 80), sizes, 100) for _ in range(2))
    child = packing.mutate(packing.crossover(a, b, sizes, 100, rng), sizes, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(80)) and all(sum(sizes[i] for i in x) <= 100 for x in child)


def test_p6_evolution_gains_on_best_fit():
    """Best fit leaves 232 bins here, as did six generations; the evolution goes on while it gains, and stops at the bound."""
    rng = random.Random(2)
    sizes = [min(511, int(rng.lognormvariate(5.3, 0.6))) for _ in range(512)]
    down = sorted(range(512), key=lambda i: -sizes[i])
    assert len(packing.best_fit(down, sizes, 512)) == 232
    bins = packing.evolve(sizes, 512, 1, [])
    fill = [0] * (max(bins) + 1)
    for i, k in enumerate(bins):
        fill[k] += sizes[i]
    assert len(fill) <= 231 and max(fill) <= 512 and min(fill) > 0
    assert packing.least_bins([60, 60, 60, 30], 100) == 3 and packing.least_bins([50, 50, 50, 50, 1], 100) == 3 and packing.least_bins([70, 70, 40, 40], 100) == 3


def test_p6_packs_as_before():
    """The packings of the slower evolution, in which every crossover searched all bins; lists of numbers come out of Arrow whole."""
    rng = random.Random(2)
    sizes = [min(511, int(rng.lognormvariate(5.3, 0.6))) for _ in range(512)]
    one, two = (packing.evolve(sizes, 512, seed, []) for seed in (1, 2))
    got = [one, two, packing.evolve(sizes, 512, 3, [one, two]), packing.evolve([s * 7 % 900 + 1 for s in sizes], 2048, 4, [])]
    assert [zlib.crc32(bytes(x)) for x in got] == [4236381333, 1327540481, 850864450, 1783183696]
    for rows in ([[1, 2], [], [3]], [[[1, 2], [3]], [], [[], [4]]]):
        column = pa.array(rows, pa.list_(pa.int32()) if rows[0][0] == 1 else pa.list_(pa.list_(pa.int32())))
        assert common.lists(column) == rows and common.lists(column[1:]) == rows[1:] and common.lists(column[:0]) == []


def test_p7_shares_and_repeats(spark):
    rng = random.Random(9)
    rows = [(i, "word " * rng.randint(5, 60), rng.choice(["big_one", "big-one ", "BIG_ONE", "small", "other", None])) for i in range(2000)] + [(9999, None, "small")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big_one", 0.4, 1), ("small", 0.3, 4), ("gone", 0.1, 3), ("other", 0.2, 1), ("zero", None, None)], "source string, target_share double, max_repeats int")
    got = {r.source: r for r in mixing.shares(docs, targets).collect()}
    assert abs(got["big_one"].tokens - got["big_one"].quota) < 70 and abs(got["small"].tokens - got["small"].quota) < 70 and got["small"].most_repeats == 2
    assert {s for s, r in got.items() if not r.reached} == {"gone", "other"} and got["gone"].tokens == 0
    assert mixing.shards_of(docs.selectExpr("16000000L * doc_id as quota").where("doc_id < 200")) == 9950
    mixed = mixing.mix(docs, targets).collect()
    assert len({(r.doc_id, r.repeat) for r in mixed}) == len(mixed) and {r.shard for r in mixed} == set(range(8))


def test_p7_tree_is_a_partition():
    import numpy as np

    counts = np.array([100, 7, 0, 1])
    walks = [mixing.split_counts(counts, 6, s, 1) for s in range(6)]
    assert (sum(n for _, n in walks) == counts).all()
    for k in range(4):
        assert sorted(x for a, n in walks for x in range(a[k], a[k] + n[k])) == list(range(counts[k]))


def test_p8_orders_levels(spark):
    rng = random.Random(10)
    easy = lambda: rng.choice(["They find it by hand.", "Look at the map on the desk.", "Can you keep the box?", "We hold the cup and read it."])
    hard = lambda: f"Notwithstanding the aforementioned considerations, the {rng.choice(['dimensionality', 'operationalisation', 'multiplicity'])} of the {rng.choice(WORDS)} presupposes an idiosyncratic decomposition."
    rows = [(i, " ".join((easy if i % 3 == 0 else hard if i % 3 == 1 else lambda: sentence(rng))() for _ in range(8))) for i in range(300)]
    rows += [(1000, "dimensionality, multiplicity, operationalisation"), (1001, None), (1002, " "), (1003, '{"step": 1, "tool": "read"}\n{"step": 2, "tool": "find"}'), (1004, "La page contient un tableau de lignes. Le lecteur trouve la bonne page au rang.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(i, f"r{i % 2}", {0: 1, 1: 5, 2: 3}[i % 3]) for i in range(60)] + [(3, "x", None), (77777, "x", 5)], "doc_id bigint, annotator string, level int")
    assert {r[0] for r in reading_level.demanding(docs, labels).collect()} == {i for i in range(300) if i % 3 == 1}
    assert reading_level.reading_levels(docs, labels.where("false")).count() == 0 and reading_level.reading_levels(docs.where("false"), labels).count() == 0


def test_p8_rare_words_count_the_same(spark, monkeypatch):
    rng = random.Random(11)
    docs = spark.createDataFrame([(i, " ".join(sentence(rng) for _ in range(4 + i % 5))) for i in range(60)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "r", 1 + i % 5) for i in range(40)], "doc_id bigint, annotator string, level int")
    levels = lambda: {r.doc_id: r.level for r in reading_level.reading_levels(docs, labels).collect()}
    whole = levels()
    rounds = reading_level.fit_report(docs, labels).orderBy("round").collect()
    assert [r.round for r in rounds] == [1, 2, 3] and {r.n_documents for r in rounds} == {60} and rounds[0].log_likelihood < rounds[1].log_likelihood < rounds[2].log_likelihood
    assert reading_level.fit_report(docs, labels.where("false")).count() == 0
    monkeypatch.setattr(reading_level, "VOCABULARY", 6)
    few = levels()
    assert len(whole) == 60 and whole.keys() == few.keys() and all(math.isclose(whole[k], few[k], rel_tol=1e-9) for k in whole)


def test_token_counts_of_long_texts():
    text = "word, another word. " * 20_000
    assert tokens.count_tokens(text) == len(tokens.encoder(tokens.TOKENIZER).encode_ordinary(text))


def test_token_counts_come_from_words(monkeypatch):
    """Words already met aren't encoded again (p6 and p7 did so with every text), and counts are those of whole texts."""
    encode, rng, met = tokens.encoder(tokens.TOKENIZER).encode_ordinary, random.Random(5), []
    bits = ["a", "Be", "é", "1", "²", "Ⅷ", "一", "'", "'s", "'ll", ".", "_", "!", "\u0301", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u200b", "word", " the"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(5000)] + ["", " ", "page 1", "page 1 \n\n two\n"]
    for most in (tokens.WORDS, 20, 0):
        monkeypatch.setattr(tokens, "WORDS", most)
        monkeypatch.setattr(tokens, "_words", {})
        assert [tokens.count_tokens(x) for x in texts] == [len(encode(x)) for x in texts]
        assert len(tokens._words[tokens.TOKENIZER]) <= most
    monkeypatch.setattr(tokens, "WORDS", 100)
    monkeypatch.setattr(tokens, "_words", {})
    text = "The page holds the answer, and the page is read. " * 50
    n = tokens.count_tokens(text.strip())
    words = tokens._words[tokens.TOKENIZER]
    words.encode = lambda x: met.append(x) or encode(x)
    assert tokens.count_tokens(text.strip()) == n == len(encode(text.strip())) and met == ["The"]
