"""Byte-level BPE by the ranks of a given vocabulary: texts to ids and back.

Two tiers: a minimal perfect hash resolves pre-tokens that are in the vocabulary; the others are merged pair by pair, by a heap over
linked bytes.
"""

from __future__ import annotations

import base64
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import fresh, mapped, table_file

#: Code points of texts whose pre-tokens are resolved together, and bytes that a task's memo of resolved pre-tokens may hold, about. Both only save time.
AT_ONCE, MEMO_BYTES = 1 << 19, 80 << 20
#: A vocabulary is broadcast; a larger file than this is an error.
VOCABULARY_BYTES = 64 << 20

#: Pre-tokens of texts in Latin-1, as the public pattern splits them: fixed values are its letters, numbers and white space below U+0100.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_ABOVE = re.compile("[^\x00-\xff]")
#: No pre-token holds white space behind another character, so a text may be cut before it.
_CUT = regex.compile(r"(?<=\S)\s")


def _mixed(h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
    """A 64-bit finalizer of hashes and displacements."""
    x = h ^ (np.asarray(d, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Tokens as bytes with their ranks, and a minimal perfect hash over them.

    Tokens fall into buckets by one part of their hash; each bucket, largest first, gets the first displacement that sends its tokens to
    free slots, of which there are as many as tokens. A single token gets a free slot outright.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        tokens = sorted(ranks, key=ranks.__getitem__)
        self.n = len(tokens)
        self.data, self.starts = _flat(tokens)
        self.lengths = np.diff(self.starts)
        self.ids = np.array([ranks[t] for t in tokens], np.uint32)
        self.longest = int(self.lengths.max())
        for seed in range(1, 100):
            self.powers = np.cumprod(np.full(self.longest, 2 * seed + 0x5851F42D4C957F2D, np.uint64))
            h = self.hashes(self.data, self.starts)
            if len(np.unique(h)) == self.n:
                break
        else:
            raise ValueError("no hash tells all tokens apart")
        self.place(h)

    def hashes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of byte strings that lie end to end, none of them empty or longer than the longest token."""
        lengths = np.diff(starts)
        at = np.arange(len(data)) - np.repeat(starts[:-1], lengths)
        return _mixed(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * self.powers[at], starts[:-1]), 0)

    def place(self, h: np.ndarray) -> None:
        buckets = self.n // 4 + 1
        bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(buckets + 1))
        free = np.ones(self.n, bool)
        self.shift, self.slots = np.zeros(buckets, np.int64), np.zeros(self.n, np.int64)
        singles = []
        for b in np.argsort(first[:-1] - first[1:], kind="stable").tolist():
            members = order[first[b] : first[b + 1]]
            if len(members) < 2:
                singles += [(b, m) for m in members.tolist()]
                continue
            at = 0
            while True:
                tries = np.arange(at, at + 128)
                slot = (_mixed(h[members][None, :], tries[:, None]) % np.uint64(self.n)).astype(np.int64)
                good = free[slot].all(axis=1)
                good[good] = [len(set(s)) == len(s) for s in slot[good].tolist()]
                if good.any():
                    k = int(good.argmax())
                    break
                at += 128
            self.shift[b], self.slots[slot[k]] = at + k, members
            free[slot[k]] = False
        for (b, m), slot in zip(singles, np.flatnonzero(free).tolist(), strict=True):
            self.shift[b], self.slots[slot] = -1 - slot, m

    def find(self, words: list[bytes]) -> np.ndarray:
        """Places of words among the tokens, -1 for others."""
        out = np.full(len(words), -1, np.int64)
        rows = np.array([i for i, w in enumerate(words) if 0 < len(w) <= self.longest], np.int64)
        if not len(rows):
            return out
        data, starts = _flat([words[i] for i in rows.tolist()])
        h = self.hashes(data, starts)
        shift = self.shift[((h >> np.uint64(33)) % np.uint64(len(self.shift))).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, (_mixed(h, np.maximum(shift, 0)) % np.uint64(self.n)).astype(np.int64))
        token = self.slots[slot]
        alike = np.flatnonzero(self.lengths[token] == np.diff(starts))
        if not len(alike):
            return out
        n = self.lengths[token[alike]]
        ends = np.cumsum(n)
        within = np.arange(ends[-1]) - np.repeat(ends - n, n)
        same = data[np.repeat(starts[alike], n) + within] == self.data[np.repeat(self.starts[token[alike]], n) + within]
        alike = alike[np.logical_and.reduceat(same, ends - n)]
        out[rows[alike]] = token[alike]
        return out

    def tokens(self) -> list[bytes]:
        data, starts = self.data.tobytes(), self.starts.tolist()
        return [data[a:b] for a, b in zip(starts, starts[1:], strict=False)]


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return np.frombuffer(b"".join(words), np.uint8), starts


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: of all neighbours that form a token, those of the least rank merge first, the leftmost of equals.

    A heap holds rank and place of each pair, bytes are linked to their neighbours, and a pair that is no longer there is passed over. Takes
    n log n steps for n bytes.
    """
    n = len(word)
    get, none = ranks.get, 1 << 62
    rank = [get(word[i : i + 2], none) for i in range(n - 1)]
    rank.append(none)
    after, before = list(range(1, n + 1)), list(range(-1, n))
    if n > 4096:
        rank, after, before = array("q", rank), array("q", after), array("q", before)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [r << bits | i for i, r in enumerate(rank) if r != none]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i = x & mask
        if rank[i] != x >> bits:
            continue
        j = after[i]
        k = after[j]
        rank[j] = none
        after[i] = k
        before[k] = i
        r = get(word[i : after[k]], none) if k < n else none
        rank[i] = r
        if r != none:
            heapq.heappush(heap, r << bits | i)
        if i:
            h = before[i]
            r = rank[h] = get(word[h:k], none)
            if r != none:
                heapq.heappush(heap, r << bits | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Ids of parts of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        import public_tokenizers

        self.latin = pattern == public_tokenizers.PATTERN
        self.ranks = dict(zip(vocabulary.tokens(), vocabulary.ids.tolist(), strict=True))
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def words(self, text: str) -> list[str]:
        if self.latin and not _ABOVE.search(text):
            return _LATIN.findall(text)
        return self.pattern.findall(text)

    def resolve(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.memo]
        raw = [w.encode() for w in new]
        ids = self.vocabulary.ids
        for word, b, at in zip(new, raw, self.vocabulary.find(raw).tolist(), strict=True):
            if at < 0:
                found = merged(b, self.ranks)
                self.memo[word] = packed = struct.pack(f"<{len(found)}I", *found)
            else:
                self.memo[word] = packed = struct.pack("<I", ids[at])
            self.held += len(b) + len(packed) + 200

    def __call__(self, parts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.memo, self.held = {}, 0
        split = [self.words(p) for p in parts]
        self.resolve(set().union(*split))
        return [b"".join(map(self.memo.__getitem__, words)) for words in split]


def parts(text: str) -> Iterator[str]:
    """A text cut where no pre-token is, into pieces of AT_ONCE code points or as few more as there are before the next such place."""
    a = 0
    while len(text) - a > AT_ONCE:
        at = _CUT.search(text, a + AT_ONCE)
        if not at:
            break
        yield text[a : at.start()]
        a = at.start()
    yield text[a:]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with a token in base64 and its rank a line."""
    with open(table_file(path, VOCABULARY_BYTES), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode(docs: DataFrame, *, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Columns ``keep`` (all, if not given) and ``out``: the ids of each text, binary, little-endian unsigned 32-bit numbers.

    A null or empty text has no ids; repeated rows get equal ids; a column named ``out`` is replaced. Texts of any length are whole: they are cut only
    where the pattern cuts anyway, so ``pattern`` must be of the public kind, whose matches cover a text and hold white space at their beginning
    only. The driver reads the vocabulary, of at most VOCABULARY_BYTES, and sends it out. A pre-token of n bytes that is no token takes about 100 n bytes of memory.
    """
    import public_tokenizers

    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path or default_path())))
    pattern = pattern or public_tokenizers.PATTERN
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        for batch in batches:
            found: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            held: list[tuple[int, str]] = []
            size = 0

            def flush(found: list[list[bytes]] = found, held: list[tuple[int, str]] = held) -> None:
                for (row, _), ids in zip(held, encoder([p for _, p in held]), strict=True):
                    found[row].append(ids)
                held.clear()

            for row in range(batch.num_rows):
                for part in parts(batch.column(n)[row].as_py() or ""):
                    held.append((row, part))
                    size += len(part)
                    if size >= AT_ONCE:
                        flush()
                        size = 0
            flush()
            ids = pa.array([b"".join(x) for x in found], pa.binary())
            yield pa.record_batch([*batch.columns[:n], ids], [*keep, out])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(fresh("_text", keep)))
    return mapped(rows, run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def decode(rows: DataFrame, *, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Adds ``out``: the bytes of all ids, binary; replaces a column of that name. Null ids are none; an id that is no token's is an error."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path or default_path())))
    keep = [c for c in rows.columns if c != out]
    n, at = len(keep), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = dict(zip(vocabulary.value.ids.tolist(), vocabulary.value.tokens(), strict=True))
        for batch in batches:
            texts = [b"".join(map(tokens.__getitem__, array("I", ids or b""))) for ids in batch.column(n).to_pylist()]
            yield pa.record_batch([*batch.columns[:n], pa.array(texts, pa.binary())], [*keep, out])

    kept = rows.select(*[F.col(f"`{c}`") for c in keep])
    ready = rows.select(*kept.columns, F.col(f"`{rows.columns[at]}`").alias(fresh("_ids", keep)))
    return mapped(ready, run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))
