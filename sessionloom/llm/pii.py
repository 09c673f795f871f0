"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole candidate spans.

The field scores segments of at most MOST_TOKENS tokens by features of the whole segment; dynamic programming chooses
boundaries and types together, in one pass that holds a bounded stretch of a text. It is trained by maximum likelihood with exact segment marginals.
"""

from __future__ import annotations

import random
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_sample, flat_bytes, fresh, mapped, slices
from ._spans import FOUND, FOUND_TYPE, Span, lookup, rows_of

TYPES = ("email", "ip", "card", "phone")
KINDS = (*TYPES, *(f"crf_{t}" for t in TYPES))
MOST_TOKENS = 16
#: Tokens before a segment that may hold its cue, and tokens after which a long stretch gives up those whose segmentation is settled.
CUE_TOKENS, HELD = 4, 4096
#: Rows at most of which those with digits or @ train the field, characters of each, and examples made besides.
TRAIN_ROWS, TRAIN_CHARS, MADE = 3000, 4000, 240

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the patterns, found in one pass each: an e-mail address by its @, the others by their first digit."""
    found: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((a, m.end(), 0))
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return found


# ---- the field ----

_CUES = {"mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "server": 1, "card": 2, "visa": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3}
#: The features from RULES on say that a segment can't be of a type; their weights are fixed.
RULES = 42
N_FEATURES, NEVER = RULES + len(TYPES), -1e6
_JOINS = "+.@-_%"


def features(s: str, left: str, right: str, cue: str) -> list[int]:
    """Numbers of the features that hold for a whole segment between the two characters ``left`` and the two ``right``."""
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    n = len(digits)
    size = 1 + sum(n >= k for k in (4, 7, 9, 10, 12, 13, 16, 17, 20))
    out = [0, size, 11 + min(len(groups), 6)]
    local, at, domain = s.partition("@")
    if at:
        out += [18] + [19] * bool(local) + [20] * bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain)) + [21] * bool(re.search(r"\s", s))
    if len(groups) == 4 and s.count(".") == 3:
        out += [22] + [23] * all(len(g) <= 3 and int(g) <= 255 for g in groups) + [24] * (sum(map(len, groups)) + 3 == len(s))
    out += [25] * (12 <= n <= 19 and luhn(digits)) + [26] * (s[:1] == "+") + [27] * ("(" in s) + [28] * ("-" in s) + [29] * (" " in s) + [30] * ("." in s)
    out += [31] * (len(groups) > 1 and all(len(g) == 4 for g in groups)) + [32] * (len(groups) > 2 and len(groups[-1]) == 4 and len(groups[-2]) == 3)
    out += [33] * (left[-1:].isalnum() or left[-1:] in _JOINS and left[-1:] != "") + [34] * (right[:1].isalnum() or right[:1] in _JOINS and right[1:].isalnum())
    out += [40] * (left[-1:] in (" ", "(") and left[:-1].isdigit()) + [41] * (right[:1] in (" ", ")") and right[1:].isdigit())
    return out + ([35 + _CUES[cue]] if cue in _CUES else []) + [39] * (s.isdigit()) + [RULES + y for y, may in enumerate(possible(s, digits, groups)) if not may]


_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def possible(s: str, digits: str, groups: list[str]) -> tuple[bool, bool, bool, bool]:
    """What a segment may be: an address has a domain, an ip four parts up to 255, a card passes Luhn, a phone number has 7 to 15 digits,
    more than 11 only behind a plus or 00, and neither an address' nor a book number's form."""
    local, _, domain = s.partition("@")
    ip = s.count(".") == 3 and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and sum(map(len, groups)) + 3 == len(s)
    card = 12 <= len(digits) <= 19 and luhn(digits) and all(c in "0123456789 -" for c in s)
    plain = bool(re.fullmatch(r"[0-9+() .-]+", s)) and not (s.count(".") == 3 and len(groups) == 4) and "+" not in s[1:]
    phone = plain and 7 <= len(digits) <= (15 if s[:1] == "+" or digits[:2] == "00" else 11) and len(groups[-1]) > 1
    return bool(local and _EMAIL_DOMAIN.fullmatch(domain)), ip, card, phone


@dataclass
class Window:
    """Tokens of a stretch of text, and the candidate segments (first token, end token, features) in it."""

    starts: list[int]
    ends: list[int]
    segments: list[tuple[int, int, list[int]]]


def windows(text: str) -> Iterator[Window]:
    """Stretches around digits and @ with their candidates; they end where 16 tokens have neither. For training texts."""
    if not re.search("[0-9@]", text):
        return
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    hot = [i for i, (a, _) in enumerate(tokens) if text[a] in _HOT]
    i = 0
    while i < len(hot):
        j = i
        while j + 1 < len(hot) and hot[j + 1] - hot[j] <= MOST_TOKENS:
            j += 1
        part = tokens[max(0, hot[i] - MOST_TOKENS - CUE_TOKENS) : hot[j] + MOST_TOKENS + 1]
        kinds = [kind_of(text[a]) for a, _ in part]
        if segments := [(k, end, f) for k in range(len(part)) for end, f in candidates(text, part, kinds, k)]:
            yield Window([a for a, _ in part], [b for _, b in part], segments)
        i = j + 1


_HOT = "0123456789@"


def kind_of(c: str) -> str:
    """A token's kind by its first character: a digit, letter, white space or the character itself."""
    return "d" if c in "0123456789" else "a" if c.isascii() and c.isalpha() else "s" if c.isspace() else c


def candidates(text: str, part: list[tuple[int, int]], kind: list[str], i: int) -> Iterator[tuple[int, list[int]]]:
    """Candidate segments that begin with token ``i`` of a stretch: the end token and the features of each."""
    if kind[i] not in "da+(":
        return
    digits = ats = letters = dots = 0
    for j in range(i, min(len(part), i + MOST_TOKENS)):
        c = kind[j]
        a, b = part[j]
        if c == "d":
            digits += b - a
        elif c == "@":
            ats += 1
        elif c == "a":
            letters += 1
        elif c == ".":
            dots += 1
        elif c not in "+()-_%s":
            break
        if c == "s" and (ats or letters or text[a] == "\n"):
            break
        if ats > 1 or digits > 24:
            break
        if c in "da" and (ats == 1 and i < j or not letters and (digits >= 7 or dots == 3 and digits >= 4)):
            first = part[i][0]
            if text[first] not in "+(" or not ats:
                before = [text[x:y].lower() for x, y in part[max(0, i - CUE_TOKENS) : i]]
                cue = next((w for w in reversed(before) if w.isalpha()), "")
                yield j + 1, features(text[first:b], text[max(0, first - 2) : first], text[b : b + 2], cue)


def scores(w: Window, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[:, f].sum(1) for _, _, f in w.segments])


class Stretch:
    """The highest-scoring segmentation of tokens that come one by one; tokens outside score 0, a tie goes to no span, then to the earlier start.

    A token's segments are scored once MOST_TOKENS tokens follow it. ``back`` holds, by place between tokens, where the best segmentation up to there
    comes from and with which type (-1: outside). After HELD tokens the part that all open segmentations share is given out.
    """

    def __init__(self, text: str, weights: np.ndarray):
        self.text, self.weights = text, weights
        self.tokens: list[tuple[int, int]] = []
        self.kinds: list[str] = []
        self.top, self.back = [0.0], [(0, -1)]
        self.done, self.most = 0, HELD

    def add(self, token: tuple[int, int]) -> list[Span]:
        self.tokens.append(token)
        self.kinds.append(kind_of(self.text[token[0]]))
        if len(self.tokens) - self.done >= MOST_TOKENS:
            self._score()
        return self._settled() if len(self.tokens) >= self.most else []

    def _score(self) -> None:
        """Best ways that go on from place ``done``, outside or by a segment."""
        i, top, back = self.done, self.top, self.back
        while len(top) < i + MOST_TOKENS + 1:
            top.append(-np.inf)
            back.append((0, -1))
        if top[i] >= top[i + 1]:
            top[i + 1], back[i + 1] = top[i], (i, -1)
        for end, found in candidates(self.text, self.tokens, self.kinds, i):
            each = self.weights[:, found].sum(1)
            y = int(each.argmax())
            if (v := top[i] + float(each[y])) > top[end]:
                top[end], back[end] = v, (i, y)
        self.done += 1

    def _until(self, end: int) -> list[Span]:
        found = []
        while end > 0:
            start, y = self.back[end]
            if y >= 0:
                found.append((self.tokens[start][0], self.tokens[end - 1][1], y))
            end = start
        return found[::-1]

    def _settled(self) -> list[Span]:
        """Spans of the part that is the same in all segmentations still open, which goes but for the tokens that a cue may need."""
        open_ = {e for e in range(self.done, len(self.top)) if self.top[e] > -np.inf}
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(self.back[last][0])
        at = open_.pop()
        spans = self._until(at)
        cut = at - CUE_TOKENS
        if cut > HELD // 2:
            base = self.top[at]
            self.tokens, self.kinds = self.tokens[cut:], self.kinds[cut:]
            self.top = [0.0] * (CUE_TOKENS + 1) + [v - base for v in self.top[at + 1 :]]
            self.back = [(max(0, k - 1), -1) for k in range(CUE_TOKENS + 1)] + [(start - cut, y) for start, y in self.back[at + 1 :]]
            self.done -= cut
            self.most = max(HELD, 2 * len(self.tokens))
            return spans
        self.most = 2 * len(self.tokens)
        return []

    def finish(self) -> list[Span]:
        while self.done < len(self.tokens):
            self._score()
        return self._until(len(self.tokens))


def field_spans(text: str, weights: np.ndarray) -> Iterator[Span]:
    """The field's spans in a whole text. Stretches around digits and @ end where 16 tokens have neither."""
    recent: deque[tuple[int, int]] = deque(maxlen=MOST_TOKENS + CUE_TOKENS)
    stretch, cold, end = None, 0, 0
    for m in _TOKEN.finditer(text):
        token = m.span()
        hot = text[token[0]] in _HOT
        if stretch is None and hot:
            stretch = Stretch(text, weights)
            for t in recent:
                if t[0] >= end:
                    stretch.add(t)
        if stretch is None:
            recent.append(token)
            continue
        found = stretch.add(token)
        recent.append(token)
        cold = 0 if hot else cold + 1
        if cold > MOST_TOKENS:
            found, stretch = found + stretch.finish(), None
        for span in found:
            end = span[1]
            yield span
    if stretch is not None:
        yield from stretch.finish()


def marginals(w: Window, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each candidate as each type, and the log of the partition function."""
    score = scores(w, weights)
    n = len(w.starts)
    each = np.logaddexp.reduce(score, axis=1)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_start: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (a, e, _) in enumerate(w.segments):
        by_end[e].append(k)
        by_start[a].append(k)
    ahead, after = np.zeros(n + 1), np.zeros(n + 1)
    for e in range(1, n + 1):
        ahead[e] = np.logaddexp.reduce([ahead[e - 1], *(ahead[w.segments[k][0]] + each[k] for k in by_end[e])])
    for a in range(n - 1, -1, -1):
        after[a] = np.logaddexp.reduce([after[a + 1], *(after[w.segments[k][1]] + each[k] for k in by_start[a])])
    outside = np.array([ahead[a] + after[e] - ahead[n] for a, e, _ in w.segments])
    return np.exp(score + outside[:, None]), float(ahead[n])


def fit(examples: list[tuple[str, list[Span]]], rounds: int = 30, rate: float = 1.0, decay: float = 1e-3) -> np.ndarray:
    """Weights by type and feature of highest likelihood for texts with their spans (AdaGrad steps, L2 decay)."""
    data = []
    for text, spans in examples:
        for w in windows(text):
            gold = {(a, b): y for a, b, y in spans}
            data.append((w, [(k, gold[x]) for k, (i, j, _) in enumerate(w.segments) if (x := (w.starts[i], w.ends[j - 1])) in gold]))
    weights = np.zeros((len(TYPES), N_FEATURES))
    weights[:, 0] = -2.0
    rules = np.arange(len(TYPES))
    weights[rules, RULES + rules] = NEVER
    seen = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        grad = -decay * weights * len(data)
        grad[:, RULES:] = 0
        for w, gold in data:
            p, _ = marginals(w, weights)
            for k, y in gold:
                p[k, y] -= 1
            for k in np.flatnonzero(np.abs(p).sum(1) > 1e-4).tolist():
                grad[:, [f for f in w.segments[k][2] if f < RULES]] -= p[k][:, None]
        seen += grad**2
        weights += rate * grad / np.sqrt(seen)
    return weights


def made_examples(n: int = MADE, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Labelled examples, always the same ones: personal data in more forms than the patterns know, and other numbers."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = "4" + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        if r.random() < 0.4:  # forms of other places stand behind a word that tells
            d = "0" + r.choice("123456789")
            form = r.choice([f"{d}{num(1)} {num(7)}", f"{d}{num(2)} {num(7)}", f"{d} {num(2)} {num(2)} {num(2)} {num(2)}", f"{d}{num(2)}-{num(6)}", f"{d} {num(4)} {num(4)}"])
            return ("cue", form)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+{num(2)} {num(2)} {num(4)} {num(4)}"])

    plain = [lambda: num(r.randint(5, 11)), lambda: f"{num(1)}.{num(7)}", lambda: f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{num(3)},{num(3)},{num(3)}", lambda: num(24), lambda: f"@{word()}", lambda: f"{num(4)} {num(4)}", lambda: f"0{num(2)} {num(7)}", lambda: f"0{num(1)} {num(4)} {num(4)}", lambda: f"{num(3)} {num(4)}", lambda: f"{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"]
    typed = [lambda: f"{word()}.{num(2)}@{word()}.example.{r.choice(['com', 'org'])}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), card, phone]
    out = []
    for _ in range(n):
        text, spans = word(), []
        for _ in range(r.randint(1, 3)):
            y = r.randrange(8)
            s = typed[y]() if y < 4 else r.choice(plain)()
            text += " "
            if isinstance(s, tuple):
                text, s = f"{text}{r.choice(['tel', 'phone', 'call', 'fax'])}{r.choice([' ', ': ', '. '])}", s[1]
            if y < 4:
                spans.append((len(text), len(text) + len(s), y))
            text += s + r.choice(["", ",", "."]) + " " + " ".join(word() for _ in range(r.randint(1, 6)))
        out.append((text, spans))
    return out


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Fits the field to made examples and to rows labelled by the patterns: those of ``train_rows`` rows, of lowest hash of id and text, that have a digit or @."""
    texts = [t for t in bounded_sample(docs, id_col, text_col, train_rows, "pii", TRAIN_CHARS) if re.search("[0-9@]", t)]
    return fit(made_examples() + [(t, base_spans(t)) for t in texts])


def spans_of(text: str, weights: np.ndarray) -> list[Span]:
    """Base spans, and the field's spans that overlap none of them, by start and kind."""
    base = base_spans(text)
    taken = np.zeros(len(text) + 1, bool)
    for a, b, _ in base:
        taken[a:b] = True
    more = [(a, b, len(TYPES) + y) for a, b, y in field_spans(text, weights) if not taken[a:b].any()]
    return sorted(base + more, key=lambda s: (s[0], s[2]))


_DIGIT, _AT = lookup("0123456789"), lookup("@")


def _possible(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Rows with an @ or at least four digits; no span is possible in others."""
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])[offsets]
    rows = np.flatnonzero(np.diff(digits) >= 4)
    return np.union1d(rows, rows_of(np.flatnonzero(_AT[data]), offsets)).tolist()


def scan(docs: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id by default) with found: an array of (kind, start, end), in code points, end exclusive.

    ``email``, ``ip``, ``card`` and ``phone`` come from the patterns, leftmost and non-overlapping each; ``crf_<type>`` are
    the field's further spans. A null or empty text has none; repeated rows give equal results, an empty table an empty one. Rows without @ and with
    under four digits are passed over. The field holds a bounded stretch of a text, so besides the text itself memory grows with its spans only.
    """
    keep = [c for c in (keep or [id_col]) if c != "found"]
    name = fresh("text", keep)
    schema = docs.select(*keep).schema.add("found", FOUND_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, name):
                data, offsets = flat_bytes(some.column(name))
                found: list[list[dict]] = [[]] * some.num_rows
                for i in _possible(data, offsets):
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    found[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(text, weights)]
                yield pa.record_batch([*(some.column(c) for c in keep), pa.array(found, FOUND)], [*keep, "found"])

    return docs.select(*keep, F.col(text_col).cast("string").alias(name)).transform(mapped, run, schema)


def redact(docs: DataFrame, weights: np.ndarray, *, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span of personal data replaced by its type in angle brackets; ``length_col`` follows if it is there.

    Overlapping spans are replaced as one, named after the first. Other rows and columns stay as they are: null and empty texts, null ids,
    repeated rows each for itself; an empty table gives an empty result.
    """
    schema = docs.schema
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, text_col):
                data, offsets = flat_bytes(some.column(text_col))
                rows = _possible(data, offsets)
                columns = list(some.columns)
                if rows:
                    texts = columns[at].to_pylist()
                    sizes = columns[names.index(length_col)].to_pylist() if length_col in names else None
                    for i in rows:
                        text, out, end = texts[i], [], 0
                        for a, b, k in spans_of(text, weights):
                            if a >= end:
                                out += [text[end:a], f"<{TYPES[k % len(TYPES)].upper()}>"]
                            end = max(end, b)
                        if out:
                            texts[i] = "".join(out) + text[end:]
                            if sizes is not None:
                                sizes[i] = len(texts[i])
                    columns[at] = pa.array(texts, columns[at].type)
                    if sizes is not None:
                        columns[names.index(length_col)] = pa.array(sizes, columns[names.index(length_col)].type)
                yield pa.record_batch(columns, names)

    return docs.transform(mapped, run, schema)
