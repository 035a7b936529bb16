"""Problem 5: lines repeated across one document's pages.

Copies are collapsed first: the pages of a document that hold the same content (one key per line) are one cluster,
of which a single page stays and carries the number of pages. A page read several times with different results is
no copy; its lines count once. Every distinct line is then counted over clusters (`clusters`) and, with their sizes,
over pages (`on_pages`), which is the number the test-data statement asks for.

Texts travel through no shuffle: a line is a 64-bit key of its normalised form, a page an array of keys. Counting
makes (document, page, line) distinct and sums them up, each with partial results before the shuffle, so that
neither a document that holds a third of all pages nor a line that stands on all of them meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

#: A line counts as repeated from this many pages on this share of the document's pages.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Other operators see the counts of lines on at least two pages and this share of the document's, whatever its size.
#: A page of k lines has at most k / REPEATED_SHARE such lines in its document, which bounds the counts per document.
REPEATED_SHARE = 0.05
#: Lines of which folding leaves fewer characters are folded letter by letter instead, and no letter is dropped.
LEAST_FOLDED = 8
#: Longer lines are never a bare page number.
BARE_PAGE_LENGTH = 40
#: Entries (24 bytes each) up to which the repeated lines are broadcast; beyond that they are joined by shuffle.
BROADCAST_ENTRIES = 400_000

# Chosen values: characters that stand for each other after a misreading; those that belong to a pair with a
# letter group (n-ri, m-rn, d-cl, u-ii, w-vv, h-li) are dropped on either side, d joins c.
FOLD_FROM_CHARS = "ce€¢d" + "tf7" + "s5$" + "a@" + "o0" + "gq9" + "il!|1rnmuhb68wvy"
FOLD_TO_CHARS = "ccccc" + "ttt" + "sss" + "aa" + "oo" + "ggg"
# Chosen values: the same for short lines, where every character keeps its place.
SHORT_FROM_CHARS = "ce€¢" + "tf7" + "s5$" + "a@" + "o0" + "gq9" + "il!|1" + "hb68" + "vy" + "nu"
SHORT_TO_CHARS = "cccc" + "ttt" + "sss" + "aa" + "oo" + "ggg" + "iiiii" + "bbbb" + "vv" + "nn"
SKIPPED_CHARS = " \t\r\u00a0.,;:-–—‐\u00ac\u00ad_()[]{}<>\"'*•?+=~^/\\%&"

#: Tokens of digits, dates and version numbers become one sign (in lower-case text).
NUMBER = r"(?<![\p{L}\p{N}@€¢|!])[loi|]*\p{N}[\p{N}loi|.:/-]*(?![\p{L}@€¢])"
BARE_PAGE = r"^(p[a@ao]?[gq]?[ec€¢]?|p[gq]|seite|página|página)?[#ivxlcdmo|!1]*((of|0f|o[ft]|/)[#ivxlcdmo|!1]*)?$"


def line_keys(text: Column) -> Column:
    """One key per line, 0 for blank lines and bare page numbers. Two misread copies of a line share the key.

    Lines are taken in lower case, without spacing and punctuation, numbers as '#'.
    """
    numbered = F.transform(F.split(F.lower(text), "\n"), lambda x: F.when(x.rlike(r"\p{N}"), F.regexp_replace(x, NUMBER, "#")).otherwise(x))
    folded = F.transform(numbered, lambda x: F.struct(x.alias("line"), F.translate(x, FOLD_FROM_CHARS + SKIPPED_CHARS, FOLD_TO_CHARS).alias("folded")))

    def key(x: Column) -> Column:
        bare = (F.length(x["line"]) < BARE_PAGE_LENGTH) & F.translate(x["line"], SKIPPED_CHARS, "").rlike(BARE_PAGE)
        short = F.translate(x["line"], SHORT_FROM_CHARS + SKIPPED_CHARS, SHORT_TO_CHARS)
        return F.when(bare, F.lit(0).cast("long")).when(F.length(x["folded"]) >= LEAST_FOLDED, F.xxhash64(x["folded"])).when(short == "", F.lit(0).cast("long")).otherwise(F.xxhash64(short))

    return F.transform(folded, key)


def page_documents(pages: DataFrame) -> DataFrame:
    """page_id -> doc. Repeated manifest rows are one page; the smallest id wins should they disagree."""
    return (pages.where("page_id is not null and trim(document_id) <> ''").groupBy("page_id").agg(F.min("document_id").alias("doc")))


def page_clusters(keyed: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, doc, stands_for: the pages a page stands for in counting, 0 for a copy of another page of its document.

    keyed: page_id, content. Only ids and hashes are handled here. Pages with several contents stand for themselves.
    """
    contents = keyed.where("page_id is not null").groupBy("page_id").agg(F.min("content").alias("least"), F.max("content").alias("most"))
    known = materialize(page_documents(pages).join(contents, "page_id").select("page_id", "doc", F.when(F.col("least") == F.col("most"), F.col("least")).alias("content")))
    copies = known.where("content is not null").groupBy("doc", "content").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = known.join(copies, ["doc", "content"], "left")
    stands_for = F.when(F.col("n").isNull(), 1).when(F.col("page_id") == F.col("first_page"), F.col("n")).otherwise(0)
    return materialize(joined.select("page_id", "doc", stands_for.cast("int").alias("stands_for")))


def keyed_pages(ocr: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cache_seq, page_id, doc, stands_for, keys of every row with ocr_ok; doc, n_pages). doc is null where `pages` lacks the page."""
    keys = F.coalesce(line_keys(F.col("ocr_text")), F.array().cast("array<bigint>"))
    keyed = materialize(ocr.where("ocr_ok").select("cache_seq", "page_id", keys.alias("keys")).withColumn("content", F.xxhash64("keys")))
    clusters = page_clusters(keyed.select("page_id", "content"), pages)
    sizes = materialize(clusters.groupBy("doc").agg(F.count(F.lit(1)).alias("n_pages")))
    return materialize(keyed.drop("content").join(clusters, "page_id", "left")), sizes


def count_lines(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc, n_pages, key, on_pages, clusters of the lines on two pages or more and on REPEATED_SHARE of the pages."""
    lines = (keyed.where("stands_for > 0").select(F.xxhash64("doc").alias("d"), F.xxhash64("page_id").alias("page"), "stands_for", F.explode(F.filter("keys", lambda k: k != 0)).alias("key"))
             .groupBy("d", "page", "key").agg(F.max("stands_for").alias("pages")))
    counted = lines.groupBy("d", "key").agg(F.sum("pages").alias("on_pages"), F.count(F.lit(1)).alias("clusters")).where("on_pages >= 2")
    return counted.join(sizes.withColumn("d", F.xxhash64("doc")), "d").where(F.col("on_pages") >= F.col("n_pages") * REPEATED_SHARE).drop("d")


def with_counts(keyed: DataFrame, counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """cache_seq, page_id, doc, n_pages and `on_pages`: for each line the pages it stands on (0: not repeated)."""
    per_doc = counted.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", F.col("on_pages").cast("int")))).alias("rep"))  # bounded, see REPEATED_SHARE
    per_doc = sizes.join(per_doc, "doc", "left")
    on = lambda: F.transform("keys", lambda k: F.coalesce(F.try_element_at("rep", k), F.lit(0)))
    spark = keyed.sparkSession
    docs, entries = sizes.count(), counted.count()
    if docs + entries <= BROADCAST_ENTRIES:
        joined = keyed.join(F.broadcast(per_doc), "doc", "left")
    else:  # a document may hold a third of the rows: its rows are spread over salted copies of its small map
        salts = max(8, spark.sparkContext.defaultParallelism)
        salted = per_doc.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("cache_seq"), F.lit(salts)).cast("int")).join(salted, ["doc", "salt"], "left")
    return joined.select("cache_seq", "page_id", "doc", F.coalesce("n_pages", F.lit(0)).cast("int").alias("n_pages"), on().alias("on_pages"))


def line_counts(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    keyed, sizes = keyed_pages(ocr, pages)
    counted = materialize(count_lines(keyed, sizes))
    return with_counts(keyed, counted, sizes)


def repeated_lines(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, line_no of every repeated line.

    Rows with ocr_ok false or null, null texts, and pages unknown to `pages` give none. Empty tables give no rows.
    Extra columns are ignored.
    """
    at = line_counts(ocr, pages).select("cache_seq", "n_pages", F.posexplode("on_pages").alias("pos", "on"))
    return at.where((F.col("on") >= MIN_PAGES) & (F.col("on") >= F.col("n_pages") * F.lit(MIN_SHARE))).select("cache_seq", (F.col("pos") + 1).cast("int").alias("line_no"))


def without_repeated_lines(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """cache_seq, removed, text: each page without its repeated lines; its other lines stay as they are."""
    at = line_counts(ocr, pages)
    joined = ocr.where("ocr_ok").select("cache_seq", "ocr_text").join(at.select("cache_seq", "n_pages", "on_pages"), "cache_seq")
    drop = lambda i: (F.get("on_pages", i) >= MIN_PAGES) & (F.get("on_pages", i) >= F.col("n_pages") * F.lit(MIN_SHARE))
    kept = F.filter(F.split("ocr_text", "\n"), lambda x, i: ~F.coalesce(drop(i), F.lit(False)))
    return joined.select("cache_seq", (F.size(F.split("ocr_text", "\n")) - F.size(kept)).alias("removed"), F.array_join(kept, "\n").alias("text"))


def repeated_line_report(ocr: DataFrame, pages: DataFrame) -> DataFrame:
    """doc, line, n_pages, on_pages, clusters, dates: each repeated line with the distinct clusters of pages and the dates it stands on."""
    keyed, sizes = keyed_pages(ocr, pages)
    counted = materialize(count_lines(keyed, sizes).where((F.col("on_pages") >= MIN_PAGES) & (F.col("on_pages") >= F.col("n_pages") * F.lit(MIN_SHARE))))
    at = with_counts(keyed, counted, sizes).select("cache_seq", "doc", F.posexplode("on_pages").alias("pos", "on")).where("on > 0").drop("on")
    texts = ocr.where("ocr_ok").select("cache_seq", F.to_date("cached_at").alias("date"), F.split("ocr_text", "\n").alias("lines"))
    stripped = F.translate(F.lower(F.regexp_replace("line", r"\p{N}+", "#")), " \t\r.", "")
    long = at.join(texts, "cache_seq").withColumn("line", F.get("lines", F.col("pos"))).withColumn("key", line_keys(F.col("line"))[0])
    lines = long.groupBy("doc", "key").agg(F.max(stripped).alias("line"), F.countDistinct("date").alias("dates"))
    return counted.join(lines, ["doc", "key"]).select("doc", "line", "n_pages", "on_pages", "clusters", "dates")
