"""Text expressions; all stay in the JVM unless said otherwise."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

#: Letters, numbers and the underscore; combining marks end a token.
WORD = r"([\p{L}\p{N}_]+)"


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def strip(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def image_mime(path: Column) -> Column:
    s = path_suffix(path)
    return F.when(s == "png", "image/png").when(s == "webp", "image/webp").when(s == "gif", "image/gif").otherwise("image/jpeg")


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")


def truncated(text: Column, limit: int = 2400, marker: str = "...[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts, one a line; a null part is an empty line."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def finite(x: Column) -> Column:
    """The number, null where it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def backoff(attempt: Column, base: float = 1.0, retry_after: Column | None = None) -> Column:
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0.0)))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds, or an HTTP date relative to now; never negative, null if neither."""
    date = F.try_to_timestamp(F.substring(value, 6, 64), F.lit("dd MMM yyyy HH:mm:ss z"))
    return F.greatest(F.lit(0.0), F.coalesce(value.try_cast("double"), (F.unix_timestamp(date) - F.unix_timestamp(now)).cast("double")))


def first_json_object(text: str | None, keep: int = 1000) -> tuple[str | None, str, bool]:
    """(the action named by the text's first JSON object, what follows the object up to `keep` characters, whether there is one). A broken first object is none."""
    start = (text or "").find("{")
    if start < 0:
        return None, "", False
    try:
        found, end = json.JSONDecoder().raw_decode(text, start)
    except ValueError:
        return None, "", False
    action = found.get("action")
    return (str(action) if action is not None else None), text[end:].strip().removesuffix("```").strip()[:keep], True
