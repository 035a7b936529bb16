"""Queries of the numbered problems, each over its whole tables."""

from __future__ import annotations

from ..session import table as t
from . import mixing, packing, reading_level, repeated_lines, scan_repair, text_quality, top_n, truncation


def _ocr(op):
    return lambda spark, d: op(t(spark, d, "ocr_cache"), t(spark, d, "pages"))


def _packed(spark, d):
    return packing.packed_documents(t(spark, d, "documents"), t(spark, d, "containers"))


def _two(op, second: str):
    return lambda spark, d: op(t(spark, d, "documents"), t(spark, d, second))


def _ranked(spark, d):
    from pyspark.sql import Window, functions as F

    best = top_n.ranked_handles(t(spark, d, "predictions"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "page_handle")  # ten rows a query
    return best.select("query_id", "page_handle", "score", F.row_number().over(order).alias("place"))


def queries() -> dict:
    return {
        "p1_found": _ocr(scan_repair.scan_lines),
        "p1_paragraphs": _ocr(scan_repair.paragraphs),
        "p2_found": _ocr(text_quality.not_prose),
        "p2_statistics": _ocr(text_quality.report),
        "p3_found": lambda spark, d: top_n.ranked_handles(t(spark, d, "predictions")).select("query_id", "page_handle"),
        "p3_ranked_handles": _ranked,
        "p4_found": lambda spark, d: truncation.truncated(t(spark, d, "model_outputs")),
        "p4_rates": lambda spark, d: truncation.truncation_rates(t(spark, d, "model_outputs")),
        "p5_found": _ocr(repeated_lines.repeated_lines),
        "p5_clean_pages": _ocr(repeated_lines.without_repeated_lines),
        "p5_report": _ocr(repeated_lines.repeated_line_report),
        "p6_found": _two(packing.oversize_documents, "containers"),
        "p6_containers": _packed,
        "p6_fill": lambda spark, d: packing.fill_report(_packed(spark, d), t(spark, d, "containers")),
        "p6_check": _two(packing.packing_check, "containers"),
        "p7_found": _two(mixing.unreachable_sources, "mix_targets"),
        "p7_mix": _two(mixing.mix, "mix_targets"),
        "p7_shares": _two(mixing.shares, "mix_targets"),
        "p7_check": _two(mixing.mixing_check, "mix_targets"),
        "p8_found": _two(reading_level.demanding, "reading_labels"),
        "p8_levels": _two(reading_level.reading_levels, "reading_labels"),
        "p8_fit": _two(reading_level.fit_report, "reading_labels"),
        "p8_profile": _two(reading_level.profile, "reading_labels"),
    }


_BEST = """
with answers as (select query_id, unnest(ranked_answers) as a from predictions where query_id is not null),
best as (select query_id, a.page_handle as page_handle, max(a.relevance_score) as score from answers
         where a.page_handle is not null and isfinite(a.relevance_score) group by query_id, a.page_handle),
placed as (select query_id, page_handle, score + 0.0 as score, cast(row_number() over (partition by query_id order by score desc, page_handle) as int) as place from best)
"""


def oracle_sql() -> dict[str, str]:
    return {
        # invariants: every text is packed whole, no container is overfull, nothing is cut without need
        "p6_check": "select container_kind, (select count(*) from documents where doc_id is not null and text <> '') as n_documents, 0 as n_overfull, 0 as n_incomplete, 0 as n_cut from containers where capacity_tokens > 0",
        # invariants: no record is used too often or twice in one repeat, and quotas are met within a record
        "p7_check": "select source, 0 as n_overused, 0 as n_repeated, false as over_quota, false as short from mix_targets where source is not null",
        "p3_found": _BEST + "select query_id, page_handle from placed where place <= 10",
        "p3_ranked_handles": _BEST + "select query_id, page_handle, score, place from placed where place <= 10",
    }
