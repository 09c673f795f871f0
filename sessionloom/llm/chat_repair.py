"""Least edits that make conversations well formed: a system turn or none, then users and assistants in turn, an assistant last.

A conversation is a chain of states: nothing yet, system, user, assistant. Rows are kept, given another role or deleted, turns are inserted;
costs are small integers, so Dial's bucket queue finds the distances to the end, and walking the arcs that lose no distance, letter by letter in
order, gives the least audit. Rows are ordered by range over all conversations and cut into blocks; a block is a matrix of distances between
states, blocks of a conversation are chained by these, so none is too long for a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, mapped

#: Rows of a block: 2 to this power.
BLOCK_BITS = 10
BLANK = " \t\n\x0b\x0c\r"

# States by number: nothing yet, system, user, assistant. What follows each, by an inserted or a changed row, and by a kept row of role s, u, a or another.
_NEXT = (2, 2, 3, 2)
_KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_ROLES = {2: "user", 3: "assistant"}
#: Costs; a truncated row that stays adds one.
CHANGE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Distance from each state to the end where no row is left: a conversation ends as nothing or with an assistant; the inserts that it takes.
END, TAIL = (0, 6, 3, 0), ("", "II", "I", "")
#: A row is one letter: role s, u, a or another, as it is, truncated, or to be deleted.
CODES = "abcdefghijkl"


def _arcs(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, state after, cost) of what may be done with a row, in order of letters; an insert stays before the row."""
    role, kind = code % 4, code // 4
    out = [("D", state, DELETE), ("I", _NEXT[state], INSERT)]
    if kind < 2:
        more = TRUNCATED * kind
        if _KEPT[state][role] >= 0:
            out.append(("K", _KEPT[state][role], more))
        out.append(("R", _NEXT[state], CHANGE + more))
    return out


_ARCS = {c: [_arcs(i, s) for s in range(4)] for i, c in enumerate(CODES)}
#: Backwards: (state before, cost) into a state past a row, and into a state before one by an insert.
_INTO = {c: [[(s, cost) for s in range(4) for letter, t, cost in _ARCS[c][s] if t == into and letter != "I"] for into in range(4)] for c in CODES}
_INSERTED = [[s for s in range(4) if _NEXT[s] == into] for into in range(4)]
_FAR = 1 << 50


def distances(codes: str, after: tuple[int, ...]) -> list[int]:
    """From each state before each row (place 4 * row + state) to the end, where ``after`` holds the states' distances behind the last row.

    Dial's queue: a ring of buckets by distance, wider than any arc and than what the given distances differ by. Inserts behind the last row aren't
    made here: the next block makes them before its first row.
    """
    n = len(codes)
    given = [d for d in after if d < _FAR]
    low, wide = min(given), max(max(given) - min(given), CHANGE + TRUNCATED, DELETE) + 1
    dist = [_FAR] * (4 * n + 4)
    ring: list[list[int]] = [[] for _ in range(wide)]
    waiting = 0
    for s, d in enumerate(after):
        if d < _FAR:
            dist[4 * n + s] = d
            ring[d % wide].append(4 * n + s)
            waiting += 1
    now = low
    while waiting:
        bucket = ring[now % wide]
        while bucket:
            at = bucket.pop()
            waiting -= 1
            if dist[at] != now:
                continue
            i, s = at >> 2, at & 3
            if i < n:
                for t in _INSERTED[s]:
                    if now + INSERT < dist[4 * i + t]:
                        dist[4 * i + t] = now + INSERT
                        ring[(now + INSERT) % wide].append(4 * i + t)
                        waiting += 1
            if i:
                for t, cost in _INTO[codes[i - 1]][s]:
                    if now + cost < dist[4 * i - 4 + t]:
                        dist[4 * i - 4 + t] = now + cost
                        ring[(now + cost) % wide].append(4 * i - 4 + t)
                        waiting += 1
        now += 1
    return dist


@lru_cache(20_000)
def transfer(codes: str) -> list[int]:
    """Distances from each state before a block to each behind it, row by row."""
    to = [distances(codes, tuple(0 if s == t else _FAR for s in range(4)))[:4] for t in range(4)]
    return [to[t][s] for s in range(4) for t in range(4)]


@lru_cache(20_000)
def walks(codes: str, after: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """For each state before a block: the least of the cheapest audits, and the state behind it."""
    dist = distances(codes, after)
    audits, exits = [], []
    for s in range(4):
        i, audit = 0, []
        while i < len(codes):
            for letter, t, cost in _ARCS[codes[i]][s]:
                to = 4 * i + t if letter == "I" else 4 * i + 4 + t
                if dist[4 * i + s] == cost + dist[to]:
                    break
            audit.append(letter)
            i, s = to >> 2, t
        audits.append("".join(audit))
        exits.append(s)
    return audits, exits


def applied(codes: str, audit: str, state: int) -> Iterator[tuple[int, str, str | None]]:
    """(row, letter, role that it gets) of each edit; a kept or deleted row's own role stays, None."""
    i = 0
    for letter in audit:
        if letter in "IR":
            state = _NEXT[state]
            yield i, letter, _ROLES[state]
        else:
            if letter == "K":
                state = _KEPT[state][CODES.index(codes[i]) % 4]
            yield i, letter, None
        i += letter != "I"


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [transfer(c) for c in batch.column("codes").to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(made, pa.list_(pa.int64()))], [*batch.schema.names, "matrix"])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation, the last first: what each has behind it, and its cost from the first state."""
    last: object = batches  # no conversation's id
    after: list[int] = []
    for batch in batches:
        found, costs, ends = [], [], []
        for conv, m in zip(batch.column("conv").to_pylist(), batch.column("matrix").to_pylist(), strict=True):
            ends.append(conv != last)
            if conv != last:
                after = list(END)
            found.append(after)
            after = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
            costs.append(after[0])
            last = conv
        kept = [batch.column(c) for c in ("conv", "block", "low", "codes")]
        yield pa.record_batch([*kept, pa.array(found, pa.list_(pa.int64())), pa.array(costs, pa.int64()), pa.array(ends, pa.bool_())], ["conv", "block", "low", "codes", "after", "cost", "ends"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for codes, after in zip(batch.column("codes").to_pylist(), batch.column("after").to_pylist(), strict=True):
            made.append(walks(codes, tuple(d - min(after) for d in after)))
        names = ["conv", "block", "low", "codes", "cost", "ends"]
        yield pa.record_batch([*[batch.column(c) for c in names], pa.array([a for a, _ in made], pa.list_(pa.string())), pa.array([e for _, e in made], pa.list_(pa.int32()))], [*names, "audits", "exits"])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation in order: the state before each, its audit, and pairs of roles that may not stand together, that with the row before it included."""
    last: object = batches
    state, before = 0, ""
    legal = {a + b for a in "su" for b in "ua" if (a, b) in {("s", "u"), ("u", "a")}} | {"au"}
    names = "sua?" * 3
    for batch in batches:
        out: list[list] = [[], [], [], []]
        rows = zip(*[batch.column(c).to_pylist() for c in ("conv", "codes", "cost", "ends", "audits", "exits")], strict=True)
        for conv, codes, cost, ends, audits, exits in rows:
            if first := conv != last:
                state, before = 0, ""
            said = before + "".join(names[CODES.index(c)] for c in codes)
            exit_state = exits[state]
            illegal = sum(said[i : i + 2] not in legal for i in range(len(said) - 1))
            for column, x in zip(out, (state, audits[state] + (TAIL[exit_state] if ends else ""), illegal, cost if first else 0), strict=True):
                column.append(x)
            state, before, last = exit_state, said[-1:], conv
        kept = [batch.column(c) for c in ("conv", "block", "low", "codes")]
        types = pa.int32(), pa.string(), pa.int64(), pa.int64()
        yield pa.record_batch([*kept, *[pa.array(c, t) for c, t in zip(out, types, strict=True)]], ["conv", "block", "low", "codes", "state", "audit", "illegal", "cost"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, at, nth, letter, role) of rows that stay and turns that are put in; ``nth`` orders those at one place, the row last."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        rows = zip(*[batch.column(c).to_pylist() for c in ("low", "codes", "state", "audit")], strict=True)
        for k, (low, codes, state, audit) in enumerate(rows):
            for nth, (i, letter, role) in enumerate(applied(codes, audit, state)):
                if letter != "D":
                    for column, x in zip(out, (k, low + i, nth, letter, role), strict=True):
                        column.append(x)
        conv = batch.column("conv").take(pa.array(out[0], pa.int32()))
        yield pa.record_batch([conv, pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string()), pa.array(out[4], pa.string())], ["conv", "at", "nth", "letter", "role"])


def _by_conversation(blocks: DataFrame, last_first: bool) -> DataFrame:
    return blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block") if last_first else F.asc("block"))


def _pick(places: Column) -> Column:
    return F.substr(F.lit(CODES), places.cast("int"), F.lit(1))


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired): a row a conversation with gaps, blank, duplicate, truncated, illegal, cost and audit; and the repaired turns in order of ``at``, ``nth``.

    Rows go by turn, nulls first, those of one turn by a hash of role and text, so equal ones stand together. A null role or text is one space; an
    empty role can't be kept; rows of a null id are one conversation. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated (its last character
    that isn't blank is none of ``.!?``). An empty table gives no rows; other columns play no part.

    Only slim rows are put in order; texts are read once more for the rows that stay. An audit must fit in a row.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumn("key", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    end = F.right(F.rtrim("text", F.lit(BLANK)), F.lit(1))
    initial = F.substr("role", F.lit(1), F.lit(1))
    role = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(4)
    slim = rows.select("conv", "turn", "key", role.alias("role"), F.when(end == "", 1).when(~end.isin(".", "!", "?"), 3).otherwise(0).alias("fault"))
    slim = slim.groupBy("conv", "turn", "key", "role", "fault").agg(F.count(F.lit(1)).alias("n"))
    # Equal rows of several turns: all but the first are duplicates.
    seen = slim.groupBy(F.col("conv").alias("_conv"), F.col("key").alias("_key")).agg(F.min(F.struct("turn")).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    slim = slim.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")), "left")
    slim = slim.select("conv", "turn", "key", "role", "fault", (F.col("_n").isNotNull() & ~F.col("turn").eqNullSafe(F.col("_first.turn"))).alias("late"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    fault = F.when(F.col("fault") == 1, 1).when(F.col("late") | (F.col("copy") > 1), 2).otherwise(F.col("fault"))
    order = ["conv", "turn", "key", "copy"]
    placed = slim.withColumn("fault", fault).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select("conv", "turn", "key", "role", "fault", F.monotonically_increasing_id().alias("at")))

    code = _pick(F.col("role") + F.when(F.col("fault") == 3, 4).when(F.col("fault") > 0, 8).otherwise(0))
    told = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))
    blocks = placed.groupBy("conv", F.shiftright("at", block_bits).alias("block")).agg(F.min("at").alias("low"), F.array_join(F.transform(told, lambda x: x["code"]), "").alias("codes"))
    conv = placed.schema["conv"].dataType.simpleString()
    block = f"conv {conv}, block long, low long, codes string"
    chained = mapped(blocks, _transfers, f"{block}, matrix array<long>")
    chained = mapped(_by_conversation(chained, True), _backward, f"{block}, after array<long>, cost long, ends boolean").repartition("conv", "block")
    chained = mapped(chained, _walked, f"{block}, cost long, ends boolean, audits array<string>, exits array<int>")
    solved = cut(mapped(_by_conversation(chained, False), _forward, f"{block}, state int, audit string, illegal long, cost long"))

    parts = F.array_sort(F.collect_list(F.struct("block", "audit")))
    audits = solved.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(parts, lambda x: x["audit"]), "").alias("audit"))
    faults = [F.sum((F.col("fault") == i).cast("long")).alias(name) for i, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))]
    by_turn = placed.groupBy("conv", "turn").agg(*faults)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    counts = by_turn.groupBy(F.col("conv").alias("_conv")).agg(gaps, *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")])
    audits = audits.join(counts, F.col("conv").eqNullSafe(F.col("_conv")))
    audits = audits.select(F.col("conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = mapped(solved.select("conv", "low", "codes", "state", "audit"), _edits, f"conv {conv}, at long, nth int, letter string, role string")
    # Of equal rows of a conversation one stays at most, so a key has one text.
    texts = rows.groupBy(F.col("conv").alias("_conv"), F.col("key").alias("_key")).agg(F.first("role").alias("_role"), F.first("text").alias("_text"))
    stay = edits.where("letter <> 'I'").join(placed.select("at", "turn", "key"), "at").join(texts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")))
    stay = stay.select("conv", "at", "nth", "turn", "letter", F.coalesce("role", "_role").alias("role"), F.col("_text").alias("text"))
    put = edits.where("letter = 'I'").select("conv", "at", "nth", F.lit(None).cast("long").alias("turn"), "letter", "role", F.lit("").alias("text"))
    repaired = stay.unionByName(put).withColumnRenamed("letter", "edit")
    return audits, repaired.select(F.col("conv").alias(conv_col), "at", "nth", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "edit")


def digests(repaired: DataFrame, *, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conversation, sha256) over ``role:text`` of repaired turns in order, joined by line feeds.

    A digest takes a conversation's rows one after the other, so they go through one task, which holds a batch of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = batches
        digest = hashlib.sha256()
        schema = None
        for batch in batches:
            schema = batch.schema.field("conv").type
            out: list[tuple] = []
            for conv, line in zip(batch.column("conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv != last:
                    if last is not batches:
                        out.append((last, digest.hexdigest()))
                    digest, last = hashlib.sha256(), conv
                else:
                    digest.update(b"\n")
                digest.update(line.encode())
            yield pa.record_batch([pa.array([c for c, _ in out], schema), pa.array([d for _, d in out], pa.string())], ["conv", "sha256"])
        if schema is not None and last is not batches:
            yield pa.record_batch([pa.array([last], schema), pa.array([digest.hexdigest()], pa.string())], ["conv", "sha256"])

    lines = repaired.select(F.col(conv_col).alias("conv"), "at", "nth", F.concat_ws(":", role_col, text_col).alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "at", "nth").select("conv", "line")
    out = mapped(lines, run, f"conv {lines.schema['conv'].dataType.simpleString()}, sha256 string")
    return out.withColumnRenamed("conv", conv_col)
