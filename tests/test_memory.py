"""BM25 memory over a store: against plain scoring, in blocks, added to in parts."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionloom import memory
from sessionloom.memory import MemoryRef, RetrievalQuery, TableMemory
from sessionloom.sources.store import Store

ROWS = "session_id string, item_id string, kind string, content string, token_count long"


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def plain(rows, session, query, k):
    """Scores by the formula, every item of the session looked at."""
    texts = {i: words(t) for s, i, t in rows if s == session}
    average = sum(map(len, texts.values())) / max(1, len(texts))
    df = Counter(w for t in texts.values() for w in set(t))
    scores = {}
    for i, t in texts.items():
        tf = Counter(t)
        s = sum(math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in set(words(query)) if tf[w])
        if any(tf[w] for w in set(words(query))):
            scores[i] = s
    return sorted((-s for s in scores.values()))[:k], scores


def made(n=240):
    pick = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Über", "naïve", "42"]
    return [(pick.choice("ab"), f"i{i}", " ".join(pick.choices(vocabulary, weights=range(1, 64), k=pick.randint(0, 40))) + ("." if i % 3 else "!")) for i in range(n)] + [("a", "empty", ""), ("a", "none", None), ("c", "alone", "w1 w1")]


@pytest.mark.parametrize("block", [7, 1024])
def test_search_equals_plain_scoring(spark, monkeypatch, block):
    monkeypatch.setattr(memory, "BLOCK_ITEMS", block)
    rows = made()
    df = spark.createDataFrame([(s, i, "Other", t, 1) for s, i, t in rows], ROWS)
    asked = [("q1", "a", "w1 w59 über", 5), ("q2", "b", "naïve 42 w3 w3 w3", 3), ("q3", "a", "nothing here", 5), ("q4", "c", "w1", 9), ("q5", "b", " ".join(f"w{i}" for i in range(60)), 200), ("q6", "x", "w1", 5)]
    found = memory.search(*memory.indexed(df), spark.createDataFrame(asked, "query_id string, session_id string, query string, max_results int")).collect()
    for q, session, query, k in asked:
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        best, scores = plain(rows, session, query, k)
        assert [r["rank"] for r in got] == list(range(1, len(best) + 1)), q
        assert [-r.score for r in got] == pytest.approx(best, abs=1e-8)
        assert all(r.score == pytest.approx(scores[r.item_id], abs=1e-8) for r in got)


def test_blocks_are_passed_over(spark, monkeypatch):
    """A rare word in a few items: of the common word's long list only blocks that can reach them are read."""
    monkeypatch.setattr(memory, "BLOCK_ITEMS", 20)
    rows = [("s", f"i{i}", "rare rare word" if i in (3, 300) else "word " + "filler " * 30) for i in range(600)]
    df = spark.createDataFrame([(s, i, "Other", t, 1) for s, i, t in rows], ROWS)
    out = memory.search(*memory.indexed(df), spark.createDataFrame([("q", "s", "rare word", 2)], "query_id string, session_id string, query string, max_results int"))
    assert sorted(r.item_id for r in out.collect()) == ["i3", "i300"]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("part", [300, 24 << 20])
def test_many_queries_at_once_equal_plain_scoring(spark, monkeypatch, part):
    """More pairs than MANY_PAIRS go to groups of parts, also of one session in many parts, with ties, and with more ties than places."""
    monkeypatch.setattr(memory, "MANY_PAIRS", 0)
    monkeypatch.setattr(memory, "PART_BYTES", part)
    rows = made() + [("t", f"same{i}", "w1 w2") for i in range(90)] + [("t", "near", "w1 w2 w3"), ("t", "far", "w9")]
    df = spark.createDataFrame([(s, i, "Other", t, 1) for s, i, t in rows], ROWS)
    asked = [(f"{q}-{s}", s, q, k) for s in ("a", "b", "t", "x") for q, k in (("w1 w59 über", 5), ("naïve 42 w3 w3", 3), ("nothing here", 5), ("w1 w2", 7), (" ".join(f"w{i}" for i in range(60)), 200), ("w9", 0))]
    items, postings = memory.indexed(df)
    out = memory.search(items, postings, spark.createDataFrame(asked, "query_id string, session_id string, query string, max_results int"))
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    found, keys = out.collect(), {(r.session_id, r.item_id): r.key for r in items.collect()}
    for q, session, query, k in asked:
        _, scores = plain(rows, session, query, k)
        best = sorted((-round(x, 9), keys[session, i]) for i, x in scores.items())[:k]
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r.key for r in got] == [key for _, key in best], q
        assert [-r.score for r in got] == pytest.approx([x for x, _ in best], abs=2e-9)
        assert [r["rank"] for r in got] == list(range(1, len(best) + 1)) and all(keys[session, r.item_id] == r.key for r in got)


def test_memory_in_a_store(spark):
    table = TableMemory(Store.temporary(spark))
    rows = made(60)
    df = spark.createDataFrame([(s, i, "Other", t, 1) for s, i, t in rows], ROWS)
    uris = {}
    for part in (df.where("item_id < 'i4'"), df.where("item_id >= 'i3'"), df.limit(5)):
        uris |= {r.item_id: r.uri for r in table.store(part).collect()}
    assert table.tables.read("memory_items").count() == len(rows) and len(set(uris.values())) == len(rows)
    best, scores = plain(rows, "a", "w59 w58 w57", 5)
    got = table.retrieve(RetrievalQuery("a", "w59 w58 w57")).collect()
    assert [-r.score for r in got] == pytest.approx(best, abs=1e-8) and got[0].content in {t for _, _, t in rows}
    ref = MemoryRef("tables", got[0].key)
    assert ref.uri() in uris.values() and table.get(ref).first().content == got[0].content == table.get(ref, "a").first().content
    assert table.get(MemoryRef("none", got[0].key)).count() == 0 and table.retrieve(RetrievalQuery("zz", "w1")).count() == 0
    assert df.select(F.count_distinct("item_id")).first()[0] == len(uris)
