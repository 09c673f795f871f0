"""Counting segments between Unicode word boundaries (annex 29) of whole columns of texts at once.

Every code point has a class, looked up in a table; a boundary then depends on the classes of at most four neighbours, which is array
arithmetic over all texts that lie end to end. No loop over characters or texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# The classes of the Unicode standard's annex 29.
NAMES = (
    "Other", "CR", "LF", "Newline", "Extend", "ZWJ", "Format", "Katakana", "Hebrew_Letter", "ALetter", "Single_Quote", "Double_Quote", "MidNumLet", "MidLetter", "MidNum", "Numeric",
    "ExtendNumLet", "Regional_Indicator", "WSegSpace",
)
_NUMBER = {name: i for i, name in enumerate(NAMES)}
#: Bits besides the class: of pictures that join behind a zero-width joiner, of white space, and of code points looked up so far.
PICTURE, SPACE, KNOWN = 32, 64, 128
#: Bytes of texts that are counted together; a longer text is cut where a word begins behind a space.
AT_ONCE = 1 << 18
_CUT = re.compile(rb"[ \n](?=[A-Za-z])")


#: The table of class and bits by code point, filled as code points are met, and the tests that fill it; a task's own.
_MADE: dict[str, object] = {}


def _table() -> np.ndarray:
    if "table" not in _MADE:
        _MADE["table"] = np.zeros(0x110000, np.uint8)
    return _MADE["table"]


def _properties() -> tuple[list[tuple[int, object]], object, object]:
    if "tests" not in _MADE:
        import regex

        kinds = [(i, regex.compile(rf"\p{{Word_Break={name}}}")) for name, i in _NUMBER.items() if i]
        _MADE["tests"] = kinds, regex.compile(r"\p{Extended_Pictographic}"), regex.compile(r"\p{White_Space}")
    return _MADE["tests"]


def classes(points: np.ndarray) -> np.ndarray:
    """Class and bits of each code point."""
    table = _table()
    found = table[points]
    if not found.all():
        kinds, picture, space = _properties()
        for p in np.unique(points[found == 0]).tolist():
            c = chr(p)
            kind = next((i for i, test in kinds if test.match(c)), 0)
            table[p] = kind | KNOWN | (PICTURE if picture.match(c) else 0) | (SPACE if space.match(c) else 0)
        found = table[points]
    return found


def _among(*names: str) -> np.ndarray:
    out = np.zeros(32, bool)
    out[[_NUMBER[n] for n in names]] = True
    return out


_END, _SKIP = _among("CR", "LF", "Newline"), _among("Extend", "Format", "ZWJ")
_LETTER, _MID_LETTER, _MID_NUMBER = _among("ALetter", "Hebrew_Letter"), _among("MidLetter", "MidNumLet", "Single_Quote"), _among("MidNum", "MidNumLet", "Single_Quote")
_JOINED = _among("ALetter", "Hebrew_Letter", "Numeric", "Katakana")
_HEBREW, _KATAKANA, _DIGIT, _UNDER, _FLAG, _QUOTE, _QUOTES = (_NUMBER[n] for n in ("Hebrew_Letter", "Katakana", "Numeric", "ExtendNumLet", "Regional_Indicator", "Single_Quote", "Double_Quote"))


def _boundaries(kinds: np.ndarray, bits: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Whether a segment begins at each character; ``begins`` tells where a text does."""
    skipped = _SKIP[kinds] & ~begins
    skipped[1:] &= ~_END[kinds[:-1]]
    at = np.flatnonzero(~skipped)
    k, new = kinds[at], begins[at]
    # Neighbours among the characters that aren't skipped, 31 (no class) beyond a text's ends.
    before, after, before2 = np.full_like(k, 31), np.full_like(k, 31), np.full_like(k, 31)
    before[1:] = np.where(new[1:], 31, k[:-1])
    after[:-1] = np.where(new[1:], 31, k[1:])
    before2[1:] = np.where(new[1:], 31, before[:-1])
    letter, digit, left, left_digit = _LETTER[k], k == _DIGIT, _LETTER[before], before == _DIGIT
    join = (letter | digit) & (left | left_digit)
    join |= left & _MID_LETTER[k] & _LETTER[after]
    join |= letter & _MID_LETTER[before] & _LETTER[before2]
    join |= (before == _HEBREW) & ((k == _QUOTE) | (k == _QUOTES) & (after == _HEBREW))
    join |= (before2 == _HEBREW) & (before == _QUOTES) & (k == _HEBREW)
    join |= digit & _MID_NUMBER[before] & (before2 == _DIGIT)
    join |= left_digit & _MID_NUMBER[k] & (after == _DIGIT)
    join |= (before == _KATAKANA) & (k == _KATAKANA)
    join |= (k == _UNDER) & (_JOINED[before] | (before == _UNDER)) | (before == _UNDER) & _JOINED[k]
    flags = np.flatnonzero((k == _FLAG) & (before == _FLAG))
    if len(flags):  # every second of a run joins the one before it
        first = np.flatnonzero((k == _FLAG) & (before != _FLAG))
        join[flags] |= (flags - first[np.searchsorted(first, flags, "right") - 1]) % 2 == 1
    # What counts for the very characters that stand side by side.
    raw = np.full_like(kinds, 31)
    raw[1:] = np.where(begins[1:], 31, kinds[:-1])
    raw = raw[at]
    join |= (raw == _NUMBER["CR"]) & (k == _NUMBER["LF"])
    join |= (raw == _NUMBER["ZWJ"]) & (bits[at] & PICTURE > 0)
    join |= (raw == _NUMBER["WSegSpace"]) & (k == _NUMBER["WSegSpace"])
    out = np.zeros(len(kinds), bool)
    out[at] = ~join
    out |= begins
    return out


def _counted(data: bytes, sizes: list[int]) -> np.ndarray:
    """Segments that aren't white space of texts of so many bytes each, which lie end to end."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) and raw.max() < 0x80:
        points, ends = raw, np.cumsum(sizes)
    else:
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        ends = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[np.cumsum(sizes)]
    found = classes(points)
    starts = np.concatenate([[0], ends[:-1]])
    begins = np.zeros(len(points) + 1, bool)
    begins[starts] = True
    begin = _boundaries(found & 31, found, begins[:-1])
    # A segment counts once, at its first character that isn't white space.
    solid = np.flatnonzero(found & SPACE == 0)
    segment = np.cumsum(begin)[solid]
    firsts = solid[np.flatnonzero(np.diff(segment, prepend=0))]
    return np.diff(np.searchsorted(firsts, np.concatenate([[0], ends])))


def _pieces(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(row, bytes) of texts; long ones in parts that no word spans."""
    for row, text in enumerate(texts.cast(pa.large_binary())):  # one text at a time as bytes
        text, a = text.as_py(), 0
        while text is not None and len(text) - a > AT_ONCE and (cut := _CUT.search(text, a + AT_ONCE)):
            yield row, text[a : cut.end()]
            a = cut.end()
        if text:
            yield row, text[a:] if a else text


def count(texts: pa.Array) -> pa.Array:
    """For each text the segments between word boundaries that aren't white space; 0 for null."""
    out = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        if held:
            np.add.at(out, rows, _counted(b"".join(held), [len(h) for h in held]))
            rows.clear()
            held.clear()

    for row, piece in _pieces(texts):
        rows.append(row)
        held.append(piece)
        size += len(piece)
        if size >= AT_ONCE:
            flush()
            size = 0
    flush()
    pa.default_memory_pool().release_unused()  # workers live on
    return pa.array(out)
