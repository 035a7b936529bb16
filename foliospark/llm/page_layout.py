"""Lines of page texts and what their layout shows, for a whole Arrow batch of pages at once.

Lines and tokens are flat arrays over all pages of the batch; what depends on a token alone is worked out once per
distinct token of the batch. Blank lines are left out, but line numbers count them.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Forms of a line by itself; of HEAD (a table's head or a numbered section) and IN_COLUMNS by its neighbours too.
NUMBER_ALONE, EQUATION, CAPITALS, HEADING, FORMULA, LONG, SENTENCE_END, OTHER, HEAD, IN_COLUMNS = range(10)
FORMS = 10
#: Flow: a line in lower case after an open line or after a stop, or one that stands between the halves of a sentence.
NO_FLOW, RUNS_ON, AFTER_STOP, INTERRUPTS = range(4)
FLOWS, REPETITIONS, PLACES = 4, 5, 5
STRIP = ".,;:()[]{}\"'?!“”‘’"

_NO_WORD = r"[^\pL\pN_]*"
PAGE_NUMBER = rf"(?i)^{_NO_WORD}(?:p[a@][gq][ec€¢])?{_NO_WORD}(?:[\dlOoI|!]{{1,6}}|[ivxlc]{{1,7}}){_NO_WORD}(?:(?:of|0f|/){_NO_WORD}[\dlOoI|!]{{1,6}}{_NO_WORD})?$"
EQUATION_NUMBER = r"^\(\s*[\dlOoI|]{1,4}\s*\)$"
MARKED = r"(?i)^(?:[•\-*–·▪◦]\s|\(?\d{1,3}[.)]\s|\[\d{1,4}\]\s|\([a-zivx]{1,4}\)\s|[a-z]\)\s|step\s+\d)"
LEADERS = r"\.\.\.\.|\. \. \. \."
ENTRIES = r"^[\pL\pN_-]+(?:,\s*\d+)+$"
SPACED = r"  |\t| \||^\|"
GAPS = r"\t|\s{2,}|\s\|\s?|^\|"
RULE = r"^[^\pL\pN]{5,}$"
SECTION = r"^\d{1,2}(?:\.\d{1,2})+\.?\s+\pL"

# Bytes are counted by kind in one sum: ASCII letters in its low, digits in its middle, blanks in its high bits.
_KIND = np.zeros(256, np.int64)
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
_KIND[[*b"0123456789"]] = 1 << 21
_KIND[[*b" \t"]] = 1 << 42


def as_array(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def mask(a) -> np.ndarray:
    return as_array(pc.fill_null(a, False)).to_numpy(zero_copy_only=False)


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n owners."""
    return np.bincount(owner, values, n)


class Layout:
    """Pages (texts, which aren't null; the pages each line stands on; the pages of their documents) as flat arrays.

    page, line_no (from 1), text, length, on, repetition (0 unrepeated, 1 below a tenth of the document's pages, 2
    below a fifth, 3 a fifth of a short document, 4 repeated for sure), place (0 first, 1 near the top, 2 inside, 3
    near the end, 4 last) and form of every line; start: the first line of every page, one more at the end.
    token, owner: the number of every token in `words`, and its line; token_start: the first token of every line.
    """

    def __init__(self, texts: pa.Array, on_pages: pa.ListArray, n_pages: np.ndarray):
        m = self.pages = len(texts)
        lists = pc.split_pattern(texts, "\n")
        lengths = np.diff(lists.offsets.to_numpy())
        page = np.repeat(np.arange(m), lengths)
        line_no = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        stripped = pc.utf8_trim_whitespace(lists.flatten())
        kept = np.flatnonzero(mask(pc.greater(pc.binary_length(stripped), 0)))
        self.page, line_no, self.text = page[kept], line_no[kept], stripped.take(pa.array(kept))
        self.line_no = line_no + 1
        counts, offsets = on_pages.flatten().to_numpy(zero_copy_only=False), on_pages.offsets.to_numpy()
        at, there = offsets[self.page] - offsets[0] + line_no, line_no < np.diff(offsets)[self.page]
        self.on = np.where(there, counts[np.where(there, at, 0)], 0) if len(counts) else np.zeros(len(kept), np.int64)
        self.n_pages = n_pages
        self.start = np.concatenate(([0], np.cumsum(np.bincount(self.page, minlength=m))))
        self.length = as_array(pc.utf8_length(self.text)).to_numpy()
        self._tokens()
        self._forms()

    def __len__(self) -> int:
        return len(self.page)

    def matches(self, pattern: str, among: np.ndarray | None = None) -> np.ndarray:
        """Whether each line (of those among) matches."""
        if among is None:
            return mask(pc.match_substring_regex(self.text, pattern))
        out, at = np.zeros(len(self), bool), np.flatnonzero(among)
        if len(at):
            out[at] = mask(pc.match_substring_regex(self.text.take(pa.array(at)), pattern))
        return out

    def ends(self, chars: str) -> np.ndarray:
        return mask(pc.is_in(self.last, pa.array(list(chars))))

    @cached_property
    def commas(self) -> np.ndarray:
        return as_array(pc.count_substring(self.text, ",")).to_numpy().astype(np.int64)

    def _tokens(self) -> None:
        lists = pc.utf8_split_whitespace(self.text)
        n = np.diff(lists.offsets.to_numpy())
        coded = as_array(lists.flatten().dictionary_encode())
        self.token, self.words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        self.owner = np.repeat(np.arange(len(self)), n)
        self.tokens = n
        self.token_start = np.cumsum(n) - n
        self.last_token = self.token_start + n - 1

    def _forms(self) -> None:
        first, self.last = pc.utf8_slice_codeunits(self.text, 0, 1), pc.utf8_slice_codeunits(self.text, -1)
        self.first = first
        self.lower, self.alpha, self.digit = mask(pc.utf8_is_lower(first)), mask(pc.utf8_is_alpha(first)), mask(pc.utf8_is_digit(first))
        self.stops, self.closes = self.ends(".?!"), self.ends(".?!:")
        short = self.length < 24
        equation = self.matches(EQUATION_NUMBER, short)
        self.number = self.matches(PAGE_NUMBER, short) & ~equation
        self.spaced = self.matches(SPACED)
        heads = pc.utf8_slice_codeunits(pa.array(self.words, pa.string()), 0, 1)
        alpha, upper = mask(pc.utf8_is_alpha(heads)), mask(pc.utf8_is_upper(heads))
        alpha, upper = alpha[self.token], upper[self.token]
        n_alpha, n_upper = sums(alpha, self.owner, len(self)), sums(alpha & upper, self.owner, len(self))
        letters = np.append(np.flatnonzero(alpha), len(alpha))
        first_letter = letters[np.searchsorted(letters, self.token_start)]
        first_upper = np.append(upper, False)[first_letter] & (first_letter <= self.last_token)
        second_upper = np.append(upper, False)[self.token_start + 1] & (self.tokens > 1) if len(upper) else np.zeros(0, bool)
        capitals = ~self.lower & ~self.ends(".,;:-") & (second_upper | self.digit) & (n_alpha >= 2) & first_upper & (n_upper >= 0.7 * n_alpha)
        order = np.lexsort((self.length, self.page))
        m = np.diff(self.start)
        width = np.zeros(self.pages)
        some = np.flatnonzero(m)
        width[some] = self.length[order][self.start[some] + m[some] * 2 // 3]
        formula = (self.length < 60) & mask(pc.match_substring(self.text, "="))
        long = self.length > 0.7 * width[self.page]
        heading = ~self.lower & (n_alpha >= 1) & (n_alpha <= 6)
        self.form = np.select([equation, self.number, formula, capitals, long, self.stops, heading], [EQUATION, NUMBER_ALONE, FORMULA, CAPITALS, LONG, SENTENCE_END, HEADING], OTHER)
        of = self.n_pages[self.page]
        share = self.on / np.maximum(1, of)
        self.repetition = np.select([self.on < 2, (self.on >= 5) & (share >= 0.2), share >= 0.2, share >= 0.1], [0, 4, 3, 2], 1)
        j = np.arange(len(self)) - self.start[self.page]
        end = m[self.page] - 1
        self.place = np.select([j == 0, j == end, j <= 2, j == end - 1], [0, 4, 1, 3], 2)

    # Neighbours on the same page; where there is none, `other` stands.

    def before(self, x: np.ndarray, other) -> np.ndarray:
        out = np.concatenate(([other], x[:-1])) if len(x) else x.copy()
        out[self.start[:-1][np.diff(self.start) > 0]] = other
        return out

    def after(self, x: np.ndarray, other) -> np.ndarray:
        out = np.concatenate((x[1:], [other])) if len(x) else x.copy()
        out[self.start[1:][np.diff(self.start) > 0] - 1] = other
        return out

    @cached_property
    def cells(self) -> np.ndarray:
        """Cells of each line as a row of columns, by gaps and bars, else by commas; 1 for running text."""
        out = self.commas + 1
        at = np.flatnonzero(self.spaced)
        if len(at):
            lists = pc.split_pattern_regex(self.text.take(pa.array(at)), GAPS)
            filled = mask(pc.greater(pc.binary_length(pc.utf8_trim_whitespace(lists.flatten())), 0))
            out[at] = sums(filled, np.repeat(np.arange(len(at)), np.diff(lists.offsets.to_numpy())), len(at))
        return out

    def context(self) -> tuple[np.ndarray, np.ndarray]:
        """Form with HEAD and IN_COLUMNS, and flow of each line."""
        cells, form = self.cells, self.form.copy()
        rule = self.matches(RULE, ~self.alpha & (self.length > 4))
        below, below2 = self.after(cells, 0), self.after(self.after(cells, 0), 0)
        next_rule = self.after(rule, False)
        row = np.where(next_rule, np.where(self.after(next_rule, False), 0, below2), below)  # cells of the next row that is no rule
        above = self.before(cells, 0)
        head = np.where(rule, (above == below) & (below > 1), (cells == row) & (row > 1)) & ((form == CAPITALS) | self.spaced | rule)
        section = self.matches(SECTION, self.digit)
        number = form == NUMBER_ALONE
        beside = lambda shift: (shift(cells, 0) == cells) & ~shift(number, True)
        columns = number & (cells > 1) & (beside(self.before) | beside(self.after)) & mask(pc.equal(self.first, "p"))
        form[(head | section) & (self.repetition <= 1) & ~np.isin(form, (NUMBER_ALONE, EQUATION, FORMULA))] = HEAD
        form[columns] = IN_COLUMNS
        opened = ~self.before(self.stops, True)
        started = self.before(np.ones(len(self), bool), False)
        runs = self.lower & started & (self.before(self.form, OTHER) != HEADING)
        interrupts = started & ~self.lower & ~self.before(self.closes, True) & self.after(self.lower, False)
        return form, np.select([runs & opened, runs, interrupts], [RUNS_ON, AFTER_STOP, INTERRUPTS], NO_FLOW)

    @cached_property
    def entries(self) -> np.ndarray:
        """Entries of an index: a word and page numbers."""
        return self.matches(ENTRIES, mask(pc.utf8_is_digit(self.last)))

    @cached_property
    def marked(self) -> np.ndarray:
        """Bullets, numbers, references, steps, leaders and index entries."""
        return self.matches(MARKED) | self.matches(LEADERS) | self.entries

    @cached_property
    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, ASCII letters, digits, blanks) of each line."""
        if not len(self):
            return (np.zeros(0, np.int64),) * 4
        offsets = np.frombuffer(self.text.buffers()[1], np.int32)[self.text.offset : self.text.offset + len(self) + 1]
        data = np.frombuffer(self.text.buffers()[2], np.uint8)
        size = np.diff(offsets)
        if size.max() < 1 << 21:
            summed = np.add.reduceat(_KIND[data[offsets[0] : offsets[-1]]], offsets[:-1] - offsets[0])
            part = lambda i: (summed >> (21 * i)) & ((1 << 21) - 1)
            return size, part(0), part(1), part(2)
        kinds = [np.add.reduceat((_KIND[data[offsets[0] : offsets[-1]]] == 1 << (21 * i)).astype(np.int64), offsets[:-1] - offsets[0]) for i in range(3)]
        return size, *kinds
