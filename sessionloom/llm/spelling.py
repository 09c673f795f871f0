"""Words that differ by one edit, found by forward and backward minimal acyclic automata with word numbers.

Two such words of at most n letters share their first or their last n // 2. So words that share so many are dealt together, as they are
and reversed; a task builds a minimal automaton of a bounded number of them, follows the shared half exactly and completes the rest with one
error. What both directions find is kept in the first only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import cut, keyed_groups, mapped

#: Words of an automaton, and letters of all its words, unless a single word has more.
BLOCK_WORDS, BLOCK_LETTERS = 1 << 15, 1 << 20
RUN = r"[A-Za-zÀ-ÿ]"


def words_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points and ``least`` occurrences in whole texts.

    Words are maximal runs of RUN, A-Z in lower case. Where ``every`` divides the checksum of ``<id>:<run>``, the run's code point at checksum
    modulo length goes. A null text has no words, a null id counts as an empty one, repeated rows count each. Runs shorter than ``shortest`` can't
    become words, so they aren't even matched.
    """
    found = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({RUN}{{{shortest},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("run"))
    runs = runs.select("_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    h, size = F.crc32(F.concat("_id", F.lit(":"), F.col("run"))), F.length("run")
    at = (h % size).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, size))
    words = runs.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word")).where(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of distinct words, rows of a matrix of letters from 1 on, filled up with 0; numbers its words in order.

    States are told apart by a hash of all that follows them, which is then proven: states of one hash must have the same arcs.
    """

    def __init__(self, words: np.ndarray):
        wide = words.astype(">u4")
        order = np.lexsort(wide.T[::-1]) if words.shape[1] else np.arange(len(words))
        words = words[order]
        fresh = np.ones(len(words), bool)
        fresh[1:] = (words[1:] != words[:-1]).any(axis=1)
        self.order, words = order[fresh], words[fresh]
        for seed in range(100):
            if self.build(words, seed):
                return
        raise ValueError("no hash tells all states apart")

    def build(self, words: np.ndarray, seed: int) -> bool:
        rows, longest = words.shape
        size = (words > 0).sum(axis=1)
        shared = np.zeros(rows, np.int64)  # letters shared with the word before
        if rows > 1:
            differ = words[1:] != words[:-1]
            shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
            shared[0] = -1
        else:
            shared[:] = -1
        multiply, odd = np.uint64(0x9E3779B97F4A7C15 + 2 * seed), np.uint64(0xBF58476D1CE4E5B9)

        def mix(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(29))) * odd
            return x ^ (x >> np.uint64(32))

        # States of the tree by depth, deepest first: which words begin them, their hash and count of words; arcs (hash from, letter, hash to).
        hashes, counts, finals, arcs = [], [], [], []
        below: tuple[np.ndarray, ...] = ()
        for depth in range(longest, -1, -1):
            here = np.flatnonzero(size >= depth)
            starts = here[shared[here] < depth]
            # A word that leaves this depth in between can't part words that share a longer beginning, as words are in order.
            final = size[starts] == depth
            h, n = np.where(final, multiply, np.uint64(1)), final.astype(np.int64)
            if below:
                child, child_h, child_n = below
                owner = np.searchsorted(starts, child, "right") - 1
                letter = words[child, depth].astype(np.int64)
                part = mix(child_h * multiply + letter.astype(np.uint64))
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                h[owner[first]] += np.add.reduceat(part, first)
                n[owner[first]] += np.add.reduceat(child_n, first)
            h = mix(h)
            if below:
                arcs.append((h[owner], letter, child_h))
            hashes.append(h)
            counts.append(n)
            finals.append(final)
            below = (starts, h, n) if len(starts) else ()
        every, at = np.unique(np.concatenate(hashes), return_index=True)
        self.final, self.count = np.concatenate(finals)[at], np.concatenate(counts)[at]
        state = lambda h: np.searchsorted(every, h)
        self.root = int(state(hashes[-1])[0])
        if not arcs:
            self.source = self.letter = self.target = np.zeros(0, np.int64)
        else:
            source, letter, target = state(np.concatenate([a[0] for a in arcs])), np.concatenate([a[1] for a in arcs]), state(np.concatenate([a[2] for a in arcs]))
            degree = np.zeros(len(every), np.int64)
            of_tree = np.zeros(sum(map(len, hashes)), np.int64)
            placed = np.concatenate([state(h) for h in hashes])
            # Proof that a hash stands for one state: its arcs are one for each letter, and each of its places in the tree has all of them.
            table = np.unique(np.stack([source, letter, target]), axis=1)
            self.source, self.letter, self.target = table
            if (np.diff(self.source * (words.max() + 1) + self.letter) <= 0).any():
                return False
            np.add.at(degree, self.source, 1)
            np.add.at(of_tree, placed, 1)
            if not (np.bincount(source, minlength=len(every)) == degree * of_tree[: len(every)]).all():
                return False
        if not (np.concatenate(finals) == self.final[np.concatenate([state(h) for h in hashes])]).all():
            return False
        self.letters = int(words.max()) + 1 if words.size else 1
        self.key = self.source * self.letters + self.letter
        self.first = np.searchsorted(self.source, np.arange(len(every) + 1))
        # Words before an arc's: the state's own, and those of arcs of lower letters.
        total = np.cumsum(np.concatenate([[0], self.count[self.target]]))
        self.before = self.final[self.source] + total[:-1] - total[self.first[self.source]]
        return True

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Arcs by these letters, and which exist."""
        key = state * self.letters + letter
        arc = np.searchsorted(self.key, key)
        arc[arc == len(self.key)] = 0
        return arc, (self.key[arc] == key) & (letter < self.letters) if len(self.key) else np.zeros(len(key), bool)

    def near(self, queries: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word number) of the words that share ``half`` letters and get from the query by replacing or deleting one of the others, each once."""
        who = np.arange(len(queries))
        state, number = np.full(len(who), self.root), np.zeros(len(who), np.int64)
        size = (queries > 0).sum(axis=1)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.zeros(0, np.int64)
        one, one_state, one_number = none, none, none  # after the error
        for p in range(queries.shape[1]):
            one, one_state, one_number = self.ended(one, one_state, one_number, size, p, found)
            if p >= half:
                live = size[who] > p
                who, state, number = who[live], state[live], number[live]
                letter = queries[who, p]
                arc, good = self.step(one_state, queries[one, p])
                moved = one[good], self.target[arc[good]], one_number[good] + self.before[arc[good]]
                # Replace: every other arc. Delete: stay, unless the letter before is the same, which was deleted already.
                degree = self.first[state + 1] - self.first[state]
                owner = np.repeat(np.arange(len(who)), degree)
                ends = np.cumsum(degree)
                arcs = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - degree, degree) + np.repeat(self.first[state], degree)
                other = self.letter[arcs] != letter[owner]
                owner, arcs = owner[other], arcs[other]
                gone = np.flatnonzero(letter != queries[who, p - 1]) if p > half else np.arange(len(who))
                one = np.concatenate([moved[0], who[owner], who[gone]])
                one_state = np.concatenate([moved[1], self.target[arcs], state[gone]])
                one_number = np.concatenate([moved[2], number[owner] + self.before[arcs], number[gone]])
            arc, good = self.step(state, queries[who, p])
            who, state, number = who[good], self.target[arc[good]], number[good] + self.before[arc[good]]
        self.ended(one, one_state, one_number, size, queries.shape[1], found)
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)

    def ended(self, one: np.ndarray, state: np.ndarray, number: np.ndarray, size: np.ndarray, p: int, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        done = size[one] == p
        hit = done & self.final[state]
        found.append((one[hit], number[hit]))
        return one[~done], state[~done], number[~done]


def _matrix(words: list[str]) -> np.ndarray:
    """Letters of words as numbers from 1 on in order of code points, filled up with 0."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    every, dense = np.unique(flat, return_inverse=True)
    out = np.zeros((len(words), int(size.max(initial=0))), np.uint32 if len(every) > 65_000 else np.uint16)
    out[np.arange(out.shape[1]) < size[:, None]] = dense + 1
    return out


def neighbours(words: list[str], listed: np.ndarray, asks: np.ndarray, half: int, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in ``words``: of asking words and those listed ones that they become by one replaced or deleted code point outside
    their first (backward: last) ``half`` ones. Backward leaves out what forward finds."""
    matrix = _matrix([w[::-1] for w in words] if backward else words)
    held = np.flatnonzero(listed)
    automaton = Automaton(matrix[held])
    asking = np.flatnonzero(asks)
    q, number = automaton.near(matrix[asking], half)
    a, b = asking[q], held[automaton.order[number]]
    if backward:
        new = np.array([words[i][:half] != words[j][:half] for i, j in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[new], b[new]
    return a, b


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows by half, direction, group and part: for each word and block, how many near words, and the first of the most frequent."""
    names = ["word", "n_near", "best_n", "best"]

    def solve(half: int, backward: bool, rows: pa.RecordBatch) -> pa.RecordBatch:
        words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
        listed, asks = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("listed", "asks"))
        a, b = neighbours(words, listed, asks, half, backward)
        size = np.array([len(w) for w in words])
        shorter = size[b] < size[a]  # a deletion is found from the longer word only
        a, b = np.concatenate([a, b[shorter]]), np.concatenate([b, a[shorter]])
        rank = np.empty(len(words), np.int64)
        rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
        order = np.lexsort([rank[b], -n[b], a])
        a, b = a[order], b[order]
        first = np.flatnonzero(np.diff(a, prepend=-1))
        count = np.diff(np.append(first, len(a)))
        return pa.record_batch([pa.array([words[i] for i in a[first].tolist()], pa.string()), pa.array(count, pa.int64()), pa.array(n[b[first]], pa.int64()), pa.array([words[i] for i in b[first].tolist()], pa.string())], names)

    held: list[pa.RecordBatch] = []
    kind, rows, letters = None, 0, 0
    for group in keyed_groups(batches, ["half", "backward", "group", "part"]):
        here = group.column("half")[0].as_py(), group.column("backward")[0].as_py()
        alone = group.column("alone")[0].as_py()
        more = group.num_rows * (2 * here[0] + 1)
        if held and (here != kind or alone or rows + group.num_rows > BLOCK_WORDS or letters + more > BLOCK_LETTERS):
            yield solve(*kind, pa.concat_batches(held))
            held, rows, letters = [], 0, 0
        held.append(group)
        kind, rows, letters = here, rows + group.num_rows, letters + more
        if alone:
            yield solve(*kind, pa.concat_batches(held))
            held, rows, letters = [], 0, 0
    if held:
        yield solve(*kind, pa.concat_batches(held))


def near_words(words: DataFrame, *, block: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) for words of (word, n) that have near words: how many, and the most frequent of them, of equals the first.

    Words must be distinct and of at least two code points. A group of words that share a half and are more than ``block`` is cut into parts by
    hash: each listed word goes to one part, each asking word to all, so automata stay bounded and nothing is lost.
    """
    size = F.length("word")

    def rows(half: Column, backward: bool) -> Column:
        shared = F.reverse(F.substr("word", size - half + 1, half)) if backward else F.substr("word", F.lit(1), half)
        return F.struct(half.cast("int").alias("half"), F.lit(backward).alias("backward"), F.xxhash64(half, F.lit(backward), shared).alias("group"), (size >= 2 * half).alias("asks"))

    # A word of n letters asks words of n and n - 1 by its half, n // 2; so it is listed for words of n and n + 1.
    short, long = F.floor(size / 2).cast("int"), F.floor((size + 1) / 2).cast("int")
    dealt = F.array(rows(short, False), rows(short, True), rows(long, False), rows(long, True))
    dealt = words.select("word", "n", F.inline(F.when(short == long, F.slice(dealt, 1, 2)).otherwise(dealt)))
    large = dealt.groupBy("group").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block).select(F.col("group").alias("_group"), F.ceil(F.col("_rows") / block).cast("int").alias("parts"))
    dealt = dealt.join(large, F.col("group") == F.col("_group"), "left").withColumn("own", F.pmod(F.hash("word"), F.col("parts")))
    everywhere = F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)
    at = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asks"), everywhere).otherwise(F.array("own"))
    dealt = dealt.select("word", "n", "half", "backward", "group", "asks", "own", F.col("parts").isNotNull().alias("alone"), F.explode(at).alias("part"))
    listed = F.col("own").isNull() | (F.col("own") == F.col("part"))
    dealt = dealt.select("word", "n", "half", "backward", "group", "part", "asks", listed.alias("listed"), "alone")
    dealt = dealt.repartition("group", "part").sortWithinPartitions("half", "backward", "group", "part")
    found = mapped(dealt, _found, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.m")).alias("best_n"), "f.best")


def variants(words: DataFrame, *, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n and root for (word, n): the form is the most frequent near word, if it is at least ``times`` as frequent.

    Roots follow forms to the last; each step is ``times`` as frequent, so paths have a few steps, and each round doubles what is followed.
    An empty table gives no rows.
    """
    words = cut(words)
    near = near_words(words)
    form = F.col("best_n") >= times * F.col("n")
    rows = cut(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n")))
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        # Words whose root has no form are done; the others go twice as far.
        roots = cut(roots.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return rows.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
