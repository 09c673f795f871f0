"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spans import FOUND, FOUND_TYPE, Span, lookup, rows_of, runs
from ._shared import bounded_sample, flat_bytes, fresh, mapped, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Characters of a candidate, and its least length.
TOKEN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
#: Nats by which the model of random strings must be ahead.
AHEAD = 15.0
#: Rows (expected) whose words train the models, and random strings made for them.
TRAIN_ROWS, MADE = 400, 400


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(m.start(), m.end(), 2) for m in HEX.finditer(text) if len(m[0]) >= 24]


@dataclass
class Model:
    """ratio: log likelihood ratio of each pair of character classes; row 0 also stands for a string's begin."""

    classes: np.ndarray
    ratio: np.ndarray

    def strings(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of maximal candidate strings."""
        start, end = runs(self.classes[data] > 0, offsets)
        long = end - start >= LEAST
        return start[long], end[long]

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of each of these strings, on its own."""
        if not len(start):
            return np.zeros(0)
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) - np.repeat(first - start, size)
        before = self.classes[data[np.maximum(at - 1, 0)]]
        before[first] = 0
        return np.add.reduceat(self.ratio[before, self.classes[data[at]]], first)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (bytes) and log-likelihood ratios of maximal candidate strings that are ahead."""
        start, end = self.strings(data, offsets)
        score = self.scores(data, start, end)
        ahead = score >= AHEAD
        return start[ahead], end[ahead], score[ahead]


def parts_between(start: int, end: int, cuts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted ``cuts`` leave of a string, in parts of at least LEAST."""
    out = []
    for a, b in [*cuts, (end, end)]:
        if min(a, end) - start >= LEAST:
            out.append((start, min(a, end)))
        start = max(start, b)
    return out


def fit(random_strings: list[str], ordinary: list[str]) -> Model:
    """Bigram models over the candidates' characters, each row smoothed towards the single characters' shares."""
    classes = np.zeros(256, np.int64)
    for k, c in enumerate(TOKEN):
        classes[ord(c)] = k + 1
    logs = []
    for strings in (random_strings, ordinary):
        seen = np.zeros((len(TOKEN) + 1, len(TOKEN) + 1))
        for s in strings:
            cls = classes[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
            np.add.at(seen, (np.concatenate([[0], cls[:-1]])[: len(cls)], cls), 1)
        single = seen[:, 1:].sum(0) + 0.5
        seen = seen[:, 1:] + 4 * single / single.sum()
        logs.append(np.log(seen / seen.sum(1, keepdims=True)))
    ratio = np.zeros((len(TOKEN) + 1, len(TOKEN) + 1))
    ratio[:, 1:] = logs[0] - logs[1]
    return Model(classes, ratio)


def made_strings(n: int, seed: int = 1) -> list[str]:
    """Random strings of the usual alphabets, always the same ones."""
    r = random.Random(seed)
    kinds = ("0123456789abcdef", TOKEN[:62], TOKEN[:26] + TOKEN[52:62], TOKEN[26:62], TOKEN)
    return ["".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randint(20, 48))) for i in range(n)]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    """Labelled samples: values in base matches and made strings are random; other words of ``train_rows`` rows at most are ordinary.

    Ordinary samples include words joined as identifiers often are: by ``_`` or ``-``, in camel case, with a short number.
    The sample is the rows of lowest hash of id and text, each with at most 4,000 characters; equal rows count once.
    """
    texts = bounded_sample(docs, id_col, text_col, train_rows, "secrets", 4000)
    hidden, ordinary = made_strings(MADE), ["get_value", "max-length", "HttpRequestHandler", "user_id_2024", "index.html"]
    r = random.Random(2)
    for t in texts:
        spans = base_spans(t)
        hidden += [m[1] for m in ASSIGN.finditer(t) if len(m[1]) >= 6] + [t[a:b] for a, b, k in spans if k]
        words = [m[0] for m in re.finditer(r"[A-Za-z0-9+/_=-]+", t) if not any(a < m.end() and m.start() < b for a, b, _ in spans)]
        ordinary += words
        for i in range(0, len(words) - 2, 8):
            ordinary += [r.choice("_-").join(words[i : i + 3]), "".join(w.capitalize() for w in words[i : i + 3]), f"{words[i]}{r.choice('_-')}{r.randint(1, 2030)}"]
    return fit(hidden, ordinary)


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id by default) with found: an array of (kind, start, end), in code points, end exclusive.

    ``assign``, ``access`` and ``hex`` come from the patterns, leftmost and non-overlapping each; ``random`` are maximal
    strings of at least LEAST characters, or what these spans leave of one in parts of that length, that by the models are
    random, each on its own. A null or empty text has
    no spans; repeated rows give equal results, an empty table an empty one. Rows with nothing to look at are passed over through whole-batch byte masks.
    """
    keep = [c for c in (keep or [id_col]) if c != "found"]
    name = fresh("text", keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("found", FOUND_TYPE)
    mark = lookup(":=")
    hexes = lookup("0123456789abcdef")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for some in slices(batch, name):
                data, offsets = flat_bytes(some.column(name))
                first, last = runs(hexes[data], offsets)
                akia = np.fromiter((x.start() for x in re.finditer(b"AKIA", data)), np.int64)
                start, end = m.strings(data, offsets)
                ahead = m.scores(data, start, end) >= AHEAD
                rows = rows_of(np.concatenate([first[last - first >= 24], akia, np.flatnonzero(mark[data]), start[ahead]]), offsets)
                found: list[list[dict] | None] = [[]] * some.num_rows
                for i in rows.tolist():
                    raw = data[offsets[i] : offsets[i + 1]]
                    spans = base_spans(raw.tobytes().decode())
                    lo, hi = np.searchsorted(start, offsets[i : i + 2])
                    if lo < hi and (spans or ahead[lo:hi].any()):
                        places = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw)) + offsets[i]
                        cuts = sorted((int(places[a]), int(places[b])) for a, b, _ in spans)
                        begin, most = np.array([a for a, _ in cuts], np.int64), np.maximum.accumulate(np.array([b for _, b in cuts], np.int64))
                        # Cuts before ``upto`` begin before the string's end; of these, those from ``since`` on may reach into it.
                        since, upto = np.searchsorted(most, start[lo:hi], "right"), np.searchsorted(begin, end[lo:hi])
                        whole = (since >= upto) & ahead[lo:hi]
                        parts = [(a, b) for a, b in zip(start[lo:hi][whole].tolist(), end[lo:hi][whole].tolist(), strict=True)]
                        left = [p for k in np.flatnonzero(since < upto).tolist() for p in parts_between(int(start[lo + k]), int(end[lo + k]), cuts[since[k] : upto[k]])]
                        ends = np.array(left, np.int64).reshape(-1, 2)
                        parts += [p for p, s in zip(left, m.scores(data, ends[:, 0], ends[:, 1]).tolist(), strict=True) if s >= AHEAD]
                        spans += [(int(np.searchsorted(places, a)), int(np.searchsorted(places, b)), 3) for a, b in parts]
                    found[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]
                yield pa.record_batch([*(some.column(c) for c in keep), pa.array(found, FOUND)], [*keep, "found"])

    return docs.select(*keep, F.col(text_col).cast("string").alias(name)).transform(mapped, run, schema)
