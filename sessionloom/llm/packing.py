"""Packing tokenized documents into sequences: Martello-Toth dominance reduction, then best fit for the rest.

The plan depends only on how many pieces have each length, at most ``seq_len`` numbers however large the corpus is.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut, mapped, ranks_within, slices

#: A group of equal sequences: how many, and (length, how often) of what each holds, longest first.
Group = tuple[int, list[tuple[int, int]]]

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries of each of the two tables of an encoder, and bytes of the longest key; they only save time. Both hold at most about 170 MB a task, if it meets so many different words.
CACHE_ENTRIES, CACHE_BYTES = 500_000, 40
#: Bytes of a text that are split into words at once.
AT_ONCE = 1 << 22
_SPACE = re.compile(rb"\s")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes each byte as one printable character: itself where it is printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Words of these characters alone are lower-cased and split here exactly as the tokenizer does it; any other goes to it whole.
_SIMPLE, _ALL_SIMPLE = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+"), re.compile(r"[\n\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\na-z0-9ß-öø-ÿ]+")


class Lately:
    """``now``: keys with what ``make`` made of them, for all keys of the last call of ``learn`` and those before of at most CACHE_BYTES; once there are more than
    half of CACHE_ENTRIES, those not asked for since the last time go."""

    def __init__(self, make: Callable[[list], list[bytes]]):
        self.make, self.now, self.before, self.long = make, {}, {}, []

    def learn(self, keys: set) -> None:
        for key in self.long:
            del self.now[key]
        if len(self.now) >= CACHE_ENTRIES // 2:
            self.before, self.now = self.now, {}
        new = keys.difference(self.now)  # looks each key up, where a minus would go through the whole table
        self.long = [k for k in new if len(k) > CACHE_BYTES]
        self.now.update({k: self.before[k] for k in new if k in self.before})
        if new := list(new.difference(self.now)):
            self.now.update(zip(new, self.make(new), strict=True))


#: Between the ids of words: no id has a highest byte that isn't 0, so none ends or begins within it.
_BETWEEN = b"\xff" * 4


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, by a tokenizer that splits at white space and parts of words.

    Its normalizer (NFC, white space, lower case) and splitting never look past white space, so the ids of a text are those
    of its words in turn. Words and parts that a call meets for the first time are looked up all together; short ones seen lately come from
    two tables of about CACHE_ENTRIES entries at most.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.words, self.parts = Lately(self.of_words), Lately(self.of_parts)
        self.table = str.maketrans({chr(b): c for b, c in _byte_chars().items()})

    def of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; a line end's are what goes between words."""
        tokenize, flat, ends = self.model.tokenize, [], [0]
        for p in parts:
            flat += [t.id for t in tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(self.table))]
            ends.append(4 * len(flat))
        ids = np.array(flat, "<u4").tobytes()
        return [_BETWEEN if p == "\n" else ids[a:b] for p, a, b in zip(parts, ends, ends[1:], strict=False)]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: of its parts, or by the tokenizer."""
        told = b"\n".join(words).decode()
        if not told:
            return [b""] * len(words)
        if _ALL_SIMPLE.fullmatch(told) and "<|" not in told:
            flat = _PARTS.findall(told.lower())
            self.parts.learn(set(flat))
            return b"".join(map(self.parts.now.__getitem__, flat)).split(_BETWEEN)
        kinds = [_SIMPLE.fullmatch(s) is not None and "<|" not in s for s in told.split("\n")]
        simple = [w for w, k in zip(words, kinds, strict=True) if k]
        ids = iter(self.of_words(simple) if simple else [])
        return [next(ids) if k else np.array(self.tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w, k in zip(words, kinds, strict=True)]

    def _joined(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, by the ids of the words that differ."""
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        coded = words.flatten().dictionary_encode()
        known = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.words.learn(set(known))
        found = [self.words.now[w] for w in known]
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)
        code = coded.indices.to_numpy()
        size = sizes[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], size)
        return np.split(ids[at], ends[words.offsets.to_numpy()[1:-1]])

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text; long texts go in pieces that end at white space."""
        out: list[list[bytes]] = [[] for _ in texts]
        rows: list[int] = []
        held: list[bytes] = []
        size = 0

        def flush() -> None:
            for row, ids in zip(rows, self._joined(held) if held else [], strict=True):
                out[row].append(ids.tobytes())
            rows.clear()
            held.clear()

        for row, text in enumerate(texts):
            a = 0
            while a < len(text):
                at = _SPACE.search(text, min(len(text), a + AT_ONCE))
                b = at.start() if at else len(text)
                rows.append(row)
                held.append(text[a:b])
                size += b - a
                a = b
                if size >= AT_ONCE:
                    flush()
                    size = 0
        flush()
        return [b"".join(ids) for ids in out]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece (from 0), start, length, ids_crc32.

    A document is the ids of its text, then ``end_id``; only longer ones than ``seq_len`` are cut. A null or empty text is
    the end id alone. Null and repeated ids are kept as they are. ``path`` must be readable on every executor.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)  # a task's own: a reused worker keeps nothing of it
        for batch in batches:
            for some in slices(batch, "_text", AT_ONCE):
                texts = some.column(1).fill_null("").cast(pa.binary()).to_pylist()
                out = [], [], [], [], []
                for i, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * seq_len)):
                        part = ids[s : s + 4 * seq_len]
                        for column, x in zip(out, (i, k, s // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            column.append(x)
                types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).transform(mapped, run, PIECES)


def _fitting(lengths: list[int], count: dict[int, int], room: int, less: dict[int, int]) -> list[int]:
    """Lengths of at most ``room`` that are left once ``less`` is taken, ascending."""
    return [w for w in lengths[: bisect.bisect_right(lengths, room)] if count[w] > less.get(w, 0)]


def dominant_set(lengths: list[int], count: dict[int, int], room: int, less: dict[int, int]) -> list[int] | None:
    """What to put beside a piece so that no other filling of ``room`` can be better; None if none is proven.

    Proven are (Martello and Toth): nothing, if nothing fits; one piece that fills the room; the largest that fits, where
    no two fit or no two have more than its length; and the largest with the largest that still fits beside it, where no three fit
    and the smaller of any two that fit is no longer than the second.
    """
    fit = _fitting(lengths, count, room, less)
    if not fit:
        return []
    top = fit[-1]
    if top == room:
        return [top]
    smallest: list[int] = []
    for w in fit:
        smallest += [w] * min(3 - len(smallest), count[w] - less.get(w, 0))
        if len(smallest) == 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return [top]
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    best, second = 0, 0  # the most that two take, the longest of the shorter ones of two
    j = len(fit) - 1
    for i, w in enumerate(fit):
        while j >= 0 and w + fit[j] > room:
            j -= 1
        if j < i or (j == i and count[w] - less.get(w, 0) < 2):
            if j == i and i:  # w with itself isn't there: w was met as the longer one already
                pass
            break
        best, second = max(best, w + fit[j]), max(second, w)
    if top >= best:
        return [top]
    beside = _fitting(lengths, count, room - top, {**less, top: less.get(top, 0) + 1})
    if beside and beside[-1] >= second:
        return [top, beside[-1]]
    return None


def plan_groups(histogram: dict[int, int], seq_len: int) -> tuple[list[Group], int]:
    """Groups of equal sequences for so many pieces of each length, and how many sequences the reduction fixed."""
    count = {w: n for w, n in sorted(histogram.items()) if n > 0}
    lengths = sorted(count)
    groups: list[Group] = []
    last = len(lengths) - 1
    while last >= 0:
        w = lengths[last]
        beside = dominant_set(lengths, count, seq_len - w, {w: 1})
        if beside is None:  # stays, and may still go beside a shorter one
            last -= 1
            continue
        need: dict[int, int] = {}
        for x in [w, *beside]:
            need[x] = need.get(x, 0) + 1
        times = min(count[x] // n for x, n in need.items())
        if beside and w + sum(beside) < seq_len:  # the proof holds again while more than three of each are left
            times = max(1, times - 4)
        groups.append((times, sorted(need.items(), reverse=True)))
        for x, n in need.items():
            count[x] -= times * n
            if not count[x]:
                del count[x]
                gone = bisect.bisect_left(lengths, x)
                lengths.pop(gone)
                last -= gone <= last and (gone < last or x == w)
        last = min(last, len(lengths) - 1)
    rest = dict(count)
    fixed = sum(n for n, _ in groups)
    room: dict[int, list[Group]] = {}
    free: list[int] = []

    def put(left: int, group: Group) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(free, left)
        room[left].append(group)

    for w in sorted(rest, reverse=True):
        n = rest[w]
        while n:
            k = bisect.bisect_left(free, w)
            if k < len(free):
                left = free[k]
                bins, held = room[left].pop()
                if not room[left]:
                    del room[left]
                    free.pop(k)
            else:
                left, held = seq_len, []
                bins = -(-n // (seq_len // w))
            each = left // w
            full = min(bins, n // each)
            if full:
                put(left - each * w, (full, [*held, (w, each)]))
                n -= full * each
            if n and full < bins:
                put(left - n * w, (1, [*held, (w, n)]))
                full, n = full + 1, 0
            if bins > full and held:
                put(left, (bins - full, held))
    return groups + [g for gs in room.values() for g in gs], fixed


def slots(groups: list[Group]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence, pieces a sequence, offset of the first, of every place for that length."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for n, held in groups:
        offset = 0
        for w, each in held:
            found.setdefault(w, []).append((ranks.get(w, 0), first, each, offset))
            ranks[w] = ranks.get(w, 0) + n * each
            offset += w * each
        first += n
    return {w: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for w, rows in found.items()}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces (see ``pieces``) with sequence_id and offset; sequences hold at most ``seq_len`` ids without gaps.

    Pieces of one length are interchangeable; they are ranked by a hash, then id, and take the places planned for that
    length in turn. Equal rows get different places. An empty table gives an empty result. To the driver comes one count a length; the plan sent back has
    at most a place for each length and group of equal sequences, bounded through ``seq_len`` alone.
    """
    spark = docs.sparkSession
    all_pieces = cut(pieces(docs, id_col=id_col, text_col=text_col, seq_len=seq_len, path=path, end_id=end_id))
    histogram = {r.length: r.n for r in all_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.sparkContext.broadcast(slots(plan_groups(histogram, seq_len)[0]))
    spread = (F.xxhash64("doc_id", "piece") % (1 << 30) / float(1 << 31) + 0.5).cast("double")
    ranked = ranks_within(all_pieces, "length", spread, ["doc_id", "piece", "ids_crc32"], F.lit(1), "_rank", "_all").drop("_all")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for w in np.unique(length).tolist():
                rows = np.flatnonzero(length == w)
                start, first, each, begin = at[w]
                k = np.searchsorted(start, rank[rows], "right") - 1
                nth = rank[rows] - start[k]
                sequence[rows] = first[k] + nth // each[k]
                offset[rows] = begin[k] + nth % each[k] * w
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_rank").cast("long")).transform(mapped, run, f"{PIECES}, sequence_id long, offset long")
