"""A plain reading of the word boundary rules of Unicode's annex 29, as a check."""

import regex

CLASSES = "CR LF Newline Extend ZWJ Format Katakana Hebrew_Letter ALetter Single_Quote Double_Quote MidNumLet MidLetter MidNum Numeric ExtendNumLet Regional_Indicator WSegSpace".split()
_CLASS = [(name, regex.compile(rf"\p{{Word_Break={name}}}")) for name in CLASSES]
_PICTURE, _SPACE = regex.compile(r"\p{Extended_Pictographic}"), regex.compile(r"\p{White_Space}*")
LETTERS, QUOTES, SKIPPED, LINE_ENDS = {"ALetter", "Hebrew_Letter"}, {"MidNumLet", "Single_Quote"}, {"Extend", "Format", "ZWJ"}, {"CR", "LF", "Newline"}


def class_of(c):
    return next((name for name, p in _CLASS if p.match(c)), "Other")


def is_boundary(text, kinds, i):
    left, right = kinds[i - 1], kinds[i]
    if left in LINE_ENDS or right in LINE_ENDS:
        return not (left == "CR" and right == "LF")
    if left == "ZWJ" and _PICTURE.match(text[i]):
        return False
    if left == right == "WSegSpace":
        return False
    if right in SKIPPED:
        return False
    before = [k for j, k in enumerate(kinds[:i]) if k not in SKIPPED or j == 0 or kinds[j - 1] in LINE_ENDS]
    after = [k for k in kinds[i:] if k not in SKIPPED]
    left, left2 = before[-1], before[-2] if len(before) > 1 else None
    right2 = after[1] if len(after) > 1 else None
    if left in LETTERS and right in LETTERS:
        return False
    if left in LETTERS and right in {"MidLetter", *QUOTES} and right2 in LETTERS:
        return False
    if left2 in LETTERS and left in {"MidLetter", *QUOTES} and right in LETTERS:
        return False
    if left == "Hebrew_Letter" and (right == "Single_Quote" or right == "Double_Quote" and right2 == "Hebrew_Letter"):
        return False
    if left2 == "Hebrew_Letter" and left == "Double_Quote" and right == "Hebrew_Letter":
        return False
    if left in {"Numeric", *LETTERS} and right in {"Numeric", *LETTERS}:
        return False
    if left2 == "Numeric" and left in {"MidNum", *QUOTES} and right == "Numeric":
        return False
    if left == "Numeric" and right in {"MidNum", *QUOTES} and right2 == "Numeric":
        return False
    if left == right == "Katakana":
        return False
    if left in {*LETTERS, "Numeric", "Katakana", "ExtendNumLet"} and right == "ExtendNumLet" or left == "ExtendNumLet" and right in {*LETTERS, "Numeric", "Katakana"}:
        return False
    if left == right == "Regional_Indicator":
        run = 0
        while run < len(before) and before[-1 - run] == "Regional_Indicator":
            run += 1
        return run % 2 == 0
    return True


def count(text):
    """Segments that are not white space."""
    kinds = [class_of(c) for c in text]
    cuts = [0, *(i for i in range(1, len(text)) if is_boundary(text, kinds, i)), len(text)]
    return sum(a < b and not _SPACE.fullmatch(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
