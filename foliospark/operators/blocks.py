"""Text blocks out of nested results: objects of any depth with a text, and results written as labelled lines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

# The names that a block's text, place and certainty go by.
TEXTS, PLACES, CERTAINTIES = ("text", "transcription", "content"), ("bbox", "box", "coordinate", "poly", "points"), ("confidence", "score")
LABEL, PLACE = re.compile(r"^label:(.*)$", re.M), re.compile(r"^bbox:(.*)$", re.M)
CONTENT = re.compile(r"^content:(.*?)(?=^#{17}|^label:|^bbox:|\Z)", re.M | re.S)
BLOCK = "array<struct<text: string, bbox: string, label: string, confidence: double>>"


def _first(x: dict, names: tuple[str, ...]):
    return next((x[k] for k in names if x.get(k)), None)


def labelled_lines(text: str) -> dict | None:
    """The block that lines beginning with label:, bbox: and content: describe; content may go on over lines, up to a line of signs."""
    content = "\n".join(part.strip() for part in CONTENT.findall(text)).strip()
    place = PLACE.search(text)
    if not content or not place:
        return None
    label = LABEL.search(text)
    return {"text": content, "bbox": place[1].strip(), "label": label[1].strip() if label else "", "confidence": None}


def blocks_of(value: str | None, names: tuple[str, ...] = TEXTS) -> Iterator[dict]:
    """Blocks of a JSON text, or of labelled lines, in reading order. Nesting of any depth is walked with a list, not by recursion."""
    try:
        todo = [json.loads(value or "null")]
    except (ValueError, RecursionError):
        todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if found := labelled_lines(x):
                yield found
        elif isinstance(x, dict):
            text, place, sure = _first(x, names), _first(x, PLACES), _first(x, CERTAINTIES)
            if isinstance(text, str) and text.strip():
                yield {"text": text.strip(), "bbox": None if place is None else json.dumps(place), "label": None, "confidence": float(sure) if isinstance(sure, int | float) else None}
            todo += reversed(list(x.values()))
        elif isinstance(x, list):
            todo += reversed(x)


def text_blocks(value: Column, names: tuple[str, ...] = TEXTS) -> Column:
    """array of blocks (text, bbox as JSON, label, confidence) of a JSON column; null and broken JSON have none."""

    @F.pandas_udf(BLOCK)
    def blocks(values: pd.Series) -> pd.Series:
        return pd.Series([list(blocks_of(v, names)) for v in values])

    return blocks(value)


def assembled(blocks: Column) -> Column:
    """The distinct texts of the blocks, one a line."""
    return F.array_join(F.array_distinct(F.transform(blocks, lambda b: b["text"])), "\n")
