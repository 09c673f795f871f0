"""Language identification by cross-parsing: the language whose text needs the fewest normalised phrases wins.

A suffix automaton of labelled text per language accepts exactly the substrings of that text. A text is parsed greedily into
longest matches; each costs log2 of the labelled text's length. All blocks of a batch are walked in step, one byte at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._shared import BATCH_BYTES, cut, flat_bytes, fresh, mapped, slices

#: Rows a language at most that train, and characters of each, from a place that depends on id and text.
TRAIN_ROWS, TRAIN_CHARS = 128, 400
#: Languages of a model. Each takes about 1.2 MB at most; where there are more, a worker holds one model at a time.
AT_ONCE = 64
#: Bytes of a table of names that is broadcast.
SENT_BYTES = 1 << 20
#: A longer text is parsed in blocks of so many bytes; a block's end also ends a phrase.
BLOCK = 1024


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start, and every path from it spells a substring."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = cur
    return moves


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of transitions laid over one another: row s goes by class c to target[base[s] + c] if owner[base[s] + c] is s, else it has none.

    Rows with several transitions go first, where they fit; single ones fill the gaps, so nearly every place is in use.
    """
    size = sum(map(len, rows)) * 2 + 2 * width
    base, owner, target = np.zeros(len(rows), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    used = bytearray(size)
    hint = 0

    def put(s: int, at: int) -> None:
        base[s] = at
        for c, to in rows[s].items():
            used[at + c] = 1
            owner[at + c], target[at + c] = s, to

    for s in sorted((s for s, to in enumerate(rows) if len(to) > 1), key=lambda s: -len(rows[s])):
        at, classes = hint, list(rows[s])
        while any(used[at + c] for c in classes):
            at += 1
        hint = max(hint, at - width)
        put(s, at)
    free = width
    for s, to in enumerate(rows):
        if len(to) == 1:
            free = used.index(0, free)
            put(s, free - next(iter(to)))
    end = len(used.rstrip(b"\0")) + width
    return base, owner[:end].copy(), target[:end].copy()


@dataclass
class Model:
    """classes: of each byte. base, owner, target: the automata's transitions (see ``displaced``), in all about 8 bytes each and 4 a state.

    start: by language and class, the state of a phrase that begins so; fresh: by language, where none has begun.
    """

    languages: list[str]
    classes: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    start: np.ndarray
    fresh: np.ndarray
    bits: np.ndarray

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of phrases of each text in each language; texts lie end to end."""
        n = len(offsets) - 1
        cls, offsets = self.normal(data, offsets)
        sizes = np.diff(offsets)
        per = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(n), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        start = offsets[:-1][owner] + nth * BLOCK
        size = np.minimum(BLOCK, offsets[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        state = np.repeat(self.fresh[:, None], len(owner), 1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
        for p, m in enumerate(live.tolist()):
            c, now = cls.take(start[:m] + p), state[:, :m]
            at = self.base.take(now) + c
            begins = self.owner.take(at) != now
            count[:, :m] += begins
            state[:, :m] = np.where(begins, self.start.take(c, axis=1), self.target.take(at))
        out = np.zeros((len(self.languages), n), np.int64)
        for k, c in enumerate(count):
            out[k] = np.bincount(owner, c, n)
        return out

    def normal(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes of the bytes, a run of anything but letters as one separator."""
        cls = self.classes[data]
        keep = cls != 0
        if len(keep):
            keep[1:] |= cls[:-1] != 0
            keep[0] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        return cls[keep], kept[offsets]

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the best language's place, its cost, and the second's (infinite where there is none)."""
        cost = self.phrases(data, offsets) * self.bits[:, None]
        best = cost.argmin(0)
        low = cost[best, np.arange(cost.shape[1])]
        return best, low, np.partition(cost, 1, axis=0)[1] if len(cost) > 1 else np.full(len(low), np.inf)


def predict(models: Iterable[Model], data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Names and scores by models of different languages, in order of names; of equal costs the first counts."""
    n = len(offsets) - 1
    names, low, second, known = [""] * n, np.full(n, np.inf), np.full(n, np.inf), 0
    for m in models:
        best, own, next_ = m.costs(data, offsets)
        better = own < low
        second = np.minimum(np.minimum(second, next_), np.where(better, low, own))
        low = np.where(better, own, low)
        known += len(m.languages)
        for i in np.flatnonzero(better).tolist():
            names[i] = m.languages[best[i]]
    return names, np.ones(n) if known == 1 else np.clip(1 - low / np.maximum(second, 1e-9), 0, 1)


def build_model(samples: dict[str, bytes]) -> Model:
    """Automata of lower-case UTF-8 text by language."""
    languages = sorted(samples)
    used = sorted({b for t in samples.values() for b in t if b >= 0x80})
    classes = np.zeros(256, np.int32)
    classes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    classes[0x80:] = 27
    classes[used] = np.arange(28, 28 + len(used))
    width = 28 + len(used)
    rows: list[dict[int, int]] = []
    start, fresh, bits, none = np.zeros((len(languages), width), np.int32), [], [], np.zeros(0, np.int32)
    blank = Model(languages, classes, none, none, none, start, none, none)
    for k, name in enumerate(languages):
        raw = np.frombuffer(samples[name], np.uint8)
        text, _ = blank.normal(raw, np.array([0, len(raw)]))
        moves = suffix_automaton(text.tolist())
        first = len(rows)
        rows += [{c: first + to for c, to in row.items()} for row in moves] + [{}]
        fresh.append(len(rows) - 1)
        start[k] = fresh[-1]
        start[k, list(moves[0])] = [first + to for to in moves[0].values()]
        bits.append(math.log2(max(2, len(text))))
    return Model(languages, classes, *displaced(rows, width), start, np.array(fresh, np.int32), np.array(bits))


def sampled(rows: DataFrame, lang: str, mark: str, train_rows: int) -> DataFrame:
    """Of each language the ``train_rows`` rows of lowest mark, rows of one mark once.

    Rows are thinned before they are ranked, by their language's count. Only a language that many repeated rows leave with too few is read
    again, its marks put together first.
    """
    counts = cut(rows.groupBy(lang).agg(F.count(F.lit(1)).alias("_n")))
    # A dirty column may have names without end; only a small table of them is sent to all executors.
    small = counts.agg(F.coalesce(F.sum(F.length(lang) + 32), F.lit(0))).first()[0] <= SENT_BYTES
    sent = lambda df: F.broadcast(df) if small else df
    columns = [c for c in rows.columns if c not in (lang, mark)]
    one_each = lambda df: df.groupBy(lang, mark).agg(*[F.first(c).alias(c) for c in columns])
    ranked = lambda df: df.withColumn("_k", F.row_number().over(W.partitionBy(lang).orderBy(mark))).where(F.col("_k") <= train_rows).drop("_k")
    share = F.least(F.lit(1.0), 4.0 * train_rows / F.col("_n"))
    thinned = rows.join(sent(counts.withColumnRenamed(lang, "_of")), F.col(lang) == F.col("_of")).where(F.pmod(mark, F.lit(1 << 30)) < share * (1 << 30))
    quick = cut(ranked(one_each(thinned.select(*rows.columns))))
    got = quick.groupBy(F.col(lang).alias("_of")).agg(F.count(F.lit(1)).alias("_got"))
    short = counts.join(got, F.col(lang) == F.col("_of"), "left").where(F.coalesce("_got", F.lit(0)) < F.least(F.lit(train_rows), F.col("_n")))
    short = cut(short.select(F.col(lang).alias("_of")))
    if short.isEmpty():
        return quick
    rest = ranked(one_each(rows.join(sent(short), F.col(lang) == F.col("_of"), "left_semi")))
    return quick.join(sent(short), F.col(lang) == F.col("_of"), "left_anti").unionByName(rest)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, at_once: int = AT_ONCE) -> list[Broadcast]:
    """Models of ``at_once`` languages each, learned from rows with text and lang that are not held out: ``train_rows`` a language at most, those of
    lowest hash of id and text, so also of rows without or with equal ids.

    Null texts, languages and held-out rows teach nothing; rows of one id and text count once; an empty table gives no model. The driver holds the
    names of all languages, and samples and automata of ``at_once`` of them.
    """
    lang = F.col(lang_col).cast("string")
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    mark = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col), F.lit("language"))
    place = F.pmod(mark, F.greatest(F.lit(1), F.length(text_col) - train_chars + 1)).cast("int") + 1
    part = F.lower(F.substring(F.col(text_col), place, F.lit(train_chars)))
    sample = cut(sampled(rows.select(lang.alias("lang"), mark.alias("mark"), part.alias("part")), "lang", "mark", train_rows))
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())
    models = []
    for i in range(0, len(names), at_once):
        texts: dict[str, list[bytes]] = {}
        for r in sample.where(F.col("lang").isin(names[i : i + at_once])).collect():
            texts.setdefault(r.lang, []).append(r.part.encode())
        models.append(docs.sparkSession.sparkContext.broadcast(build_model({k: b" ".join(sorted(v)) for k, v in texts.items()})))
    return models


def one_by_one(models: list[Broadcast]) -> Iterator[Model]:
    """The models, of which only a single one is kept in memory between calls."""
    if len(models) == 1:
        yield models[0].value
        return
    for m in models:
        yield m.load_from_path(m._path)


def identify(docs: DataFrame, models: list[Broadcast], *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with lang_pred and score added.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text where nothing was learned (no ``models``). The
    score is 1 - cost of the best / cost of the second language (1 where only one was learned); a tie goes to the
    smaller name with score 0. Columns of these names that are there already are replaced. The whole text counts. Repeated rows give
    equal results, an empty table an empty one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    asked = F.when(F.col(text_col).rlike(r"\p{L}"), F.lower(text_col))
    name = fresh("asked", keep)
    rows = docs.select(*keep, asked.alias(name))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Several models are loaded in turn, so for as many texts at once as the batch holds.
            for some in slices(batch, name, 1 << 20 if len(models) < 2 else BATCH_BYTES):
                asked = some.column(name)
                names, score = ["und"] * some.num_rows, np.zeros(some.num_rows)
                if models:
                    names, score = predict(one_by_one(models), *flat_bytes(asked))
                    known = asked.is_valid().to_numpy(zero_copy_only=False)
                    names = [x if k else "und" for x, k in zip(names, known.tolist(), strict=True)]
                    score = np.where(known, score, 0.0)
                columns = [some.column(c) for c in keep]
                yield pa.record_batch([*columns, pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return rows.transform(mapped, run, schema)
