"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re

from pyspark.sql import DataFrame

from .common import map_rows

#: Byte-level BPE ranks; the file is read where tasks run and is never part of this package.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_loaded: dict = {}
#: Longer texts are encoded in pieces cut before a space: no token of this vocabulary spans such a cut.
PIECE = 100_000
#: Words whose tokens a task remembers, and the longest that it remembers; all others are encoded each time.
WORDS, WORD_CHARS = 2**16, 64
#: A space between two characters that are none: the pattern never goes across it. Python's blanks include all of the pattern's.
CUT = re.compile(r" (?=\S)(?<=\S )")
_words: dict = {}


def encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


class Words(dict):
    """Tokens of words with the space before them, for words that neither begin nor end with a blank."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = encoder(path).encode_ordinary

    def count(self, text: str) -> int:
        """Tokens of a text; what isn't remembered is encoded at once, with the first word, which has no space before it."""
        first, *rest = text.split(" ")
        known, new = self._look_up(rest)
        if not first or first[-1].isspace() or not all(new) or any([x[0].isspace() or x[-1].isspace() for x in new]):
            first, *rest = CUT.split(text)
            known, new = self._look_up(rest)
        others = [first]
        for x in new:
            if x in self:
                known += self[x]
            elif len(self) < WORDS and len(x) <= WORD_CHARS and not x[-1].isspace():
                known += self.setdefault(x, len(self.encode(" " + x)))
            else:
                others.append(x)
        return known + len(self.encode(" ".join(others)))

    def _look_up(self, words: list[str]) -> tuple[int, list[str]]:
        found = [*map(self.get, words)]
        return sum(filter(None, found)), [x for x, n in zip(words, found) if n is None] if None in found else []


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    if path not in _words:
        _words[path] = Words(path)
    count = _words[path].count
    n, start = 0, 0
    while len(text) - start > PIECE:
        end = text.rfind(" ", start + 1, start + PIECE)
        while end > start and not (text[end - 1].isalnum() and text[end + 1 : end + 2].isalnum()):
            end = text.rfind(" ", start + 1, end)
        if end <= start:
            break
        n += count(text[start:end])
        start = end
    return n + count(text[start:])


def with_tokens(df: DataFrame, id_col: str, *keep: str, path: str = TOKENIZER) -> DataFrame:
    """id, kept columns and `tokens` of each row; a null text has 0. Kept columns are strings."""
    ddl = f"{id_col} bigint, {''.join(k + ' string, ' for k in keep)}tokens bigint"

    def make():
        return lambda text, *rest: [(*rest, count_tokens(text, path) if text else 0)]

    return map_rows(df.select("text", id_col, *keep), ddl, make)
