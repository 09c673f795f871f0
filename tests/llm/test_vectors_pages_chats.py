"""Operators over embeddings, pages and conversations."""

import random
import time
from datetime import date

import numpy as np
import pytest

from sessionloom.llm import chat_format, embedding_dedup, exact_topk, near_dedup, url_filters

VECTORS = "vec_id long, embedding array<float>, label int, id string, x int, score string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, "d") for i, v, label in rows], VECTORS)


def clustered(n=220, dim=12, seed=2):
    g = np.random.default_rng(seed)
    base = g.standard_normal((9, dim))
    out = []
    for i in range(n):
        v = base[i % 9] + g.standard_normal(dim) * (0.05 if i % 4 else 0.6)
        out.append((i * 2, [float(np.float32(x)) for x in v * g.uniform(0.5, 2)], int(i % 9 % 3)))
    return out + [(1000 + i, out[5][1], out[5][2]) for i in range(6)]


ODD = [(2001, None, 1), (2002, [], 1), (2003, [0.0] * 12, 1), (2004, [NAN] * 12, 1), (2005, [INF] + [1.0] * 11, 1), (2006, [None] + [1.0] * 11, 1), (2007, [1.0] * 12, None), (2008, [1.0, 2.0], 1), (2009, [2.0, 4.0], 1)]


def brute_links(rows, cosine):
    ok = [(i, np.array(v, float), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    links = {i: [] for i, _, _ in rows}
    for a in range(len(ok)):
        for b in range(len(ok)):
            (i, x, p), (j, y, q) = ok[a], ok[b]
            if a != b and p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i].append(j)
    comp = {i: i for i in links}
    for _ in range(len(comp)):
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in comp}
        if new == comp:
            break
        comp = new
    return {i: (len(links[i]), comp[i]) for i in links}


@pytest.mark.parametrize("block", [512, 8])
def test_embedding_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", block)
    monkeypatch.setattr(embedding_dedup, "BLOCK_DOCS", block)
    rows = clustered() + ODD
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute_links(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embedding_edges(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("None", 0, None, False)]
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def brute_topk(rows, every, k):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, width - len(v)))) for i, v in ok]
    out = set()
    for i, q in ok:
        if i % every == 0:
            best = sorted((-int(q @ x), j) for j, x in ok if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK", block)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "HEAD", 4)
    rows = clustered() + ODD
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(vectors(spark, rows), head=4).collect()}
    assert got == brute_topk(rows, 50, 5)


def test_topk_edges(spark):
    assert exact_topk.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert exact_topk.search(vectors(spark, [(0, [1.0], 1)])).count() == 0
    assert exact_topk.search(vectors(spark, [(1, [1.0], 1)])).count() == 0
    rows = [(0, [-1.0], 1), (50, [0.5], 1), (3, [], 1), (None, [1.0], 1)]
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_topk.search(vectors(spark, rows)).collect()}
    assert got == brute_topk(rows, 50, 5)


def test_url_filters(spark):
    d = lambda m, day=1: date(2024, m, day)
    entries = [
        ("bad.com", "add", d(1)), ("bad.com", "remove", d(3)), ("bad.com", "add", d(5)), ("bad.com", "add", d(5)), ("www.bad.com", "add", d(2)), ("ok.org/spam", "add", d(2)), ("ok.org/spam", "remove", d(2)),
        (None, "add", d(1)), ("zip", "add", None), ("zip", None, d(4)), ("evil.zip", "add", d(1)),
    ]
    pages = [
        (1, "http://bad.com/", d(1)), (2, "http://bad.com", d(3)), (3, "https://u:p@WWW.Bad.com.:80/a", d(2)), (4, "http://notbad.com/", d(2)), (5, "http://ok.org/spam/x?y#z", d(2)), (6, "http://ok.org/spammy", d(2)),
        (7, None, d(2)), (8, "nonsense", d(2)), (9, "http://bad.com/", None), (10, "http://bad.com/", date(2023, 12, 31)), (11, "http://x.bad.com", d(6)), (12, "http://a.evil.zip/", d(6)), (1, "http://bad.com/", d(1)),
    ]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, fetched date, pattern string, host string")
    ent = spark.createDataFrame(entries, "pattern string, action string, at date")
    rows = url_filters.evaluate(df, ent).collect()
    got = {r.page_id: (r.blocked, r.n_entries, r.pattern, r.since) for r in rows}
    no = (False, 0, None, None)
    assert len(rows) == 13
    assert got == {
        1: (True, 1, "bad.com", d(1)), 2: no, 3: (True, 2, "www.bad.com", d(2)), 4: no, 5: (True, 1, "ok.org/spam", d(2)), 6: no, 7: no, 8: no, 9: no, 10: no, 11: (True, 1, "bad.com", d(5)), 12: (True, 1, "evil.zip", d(1)),
    }
    assert url_filters.evaluate(df.where("false"), ent).count() == 0 and url_filters.evaluate(df, ent.where("false")).where("blocked").count() == 0


def test_long_urls_and_null_ids(spark):
    """One URL of a million characters, in path parts, one of as many labels, and a list that reaches deep into the first."""
    deep = "http://deep.org/" + "a/" * 500_000 + "end"
    wide = "http://" + "x." * 200_000 + "bad.com/"
    pages = spark.createDataFrame([(1, deep, date(2024, 1, 2)), (2, wide, date(2024, 1, 2)), (None, "http://bad.com/z", date(2024, 1, 2)), (None, None, None)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("deep.org/a", "add", date(2024, 1, 1)), ("deep.org/" + "a/" * 999 + "a", "add", date(2024, 1, 1)), ("deep.org/a/b", "add", date(2024, 1, 1)), ("bad.com", "add", date(2024, 1, 1))], "pattern string, action string, at date")
    start = time.perf_counter()
    got = sorted((r.page_id or 0, r.blocked, r.n_entries) for r in url_filters.evaluate(pages, entries).collect())
    assert got == [(0, False, 0), (0, True, 1), (1, True, 2), (2, True, 1)]
    assert time.perf_counter() - start < 60


def test_url_patterns_are_brought_into_normal_form(spark):
    day = date(2024, 1, 1)
    entries = [("Bad.COM", "add", day), ("bad.com.", "remove", date(2024, 1, 3)), ("OK.org//Ads/", "add", day), ("late.net./x", "add", day), ("/ads", "add", day), ("slash.de/", "add", day), ("", "add", day)]
    ent = spark.createDataFrame(entries, "pattern string, action string, at date")
    pages = [(1, "http://a.bad.com/", day), (2, "http://bad.com/", date(2024, 1, 3)), (3, "http://ok.org/Ads/1", day), (4, "http://ok.org/ads/1", day), (5, "http://late.net/x", day), (6, "http://slash.de/ads", day)]
    rows = url_filters.evaluate(spark.createDataFrame(pages, "page_id long, url string, fetched date"), ent).collect()
    assert {r.page_id: r.pattern for r in rows} == {1: "bad.com", 2: None, 3: "ok.org/Ads", 4: None, 5: "late.net/x", 6: None}


def test_url_hosts_in_brackets(spark):
    day = date(2024, 1, 1)
    ent = spark.createDataFrame([("[2001:db8::1]", "add", day), ("[::3]/ads", "add", day)], "pattern string, action string, at date")
    urls = ["http://[2001:DB8::1]:80/x", "http://[::2]/", "ftp://u@[::3]/ads/1", "http://[::3]/", "http://[broken/"]
    rows = url_filters.evaluate(spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date"), ent).collect()
    assert {r.page_id: (r.host, r.pattern) for r in rows} == {0: ("[2001:db8::1]", "[2001:db8::1]"), 1: ("[::2]", None), 2: ("[::3]", "[::3]/ads"), 3: ("[::3]", None), 4: ("[broken", None)}


def test_chat_format(spark):
    r = random.Random(6)
    convs = {0: [("user", "a"), ("assistant", "b")], 1: [("user", "a"), ("assistant", "b"), ("user", "c")], 2: [("user", "a"), ("assistant", "b"), ("user", "c")], 3: [("user", "b"), ("assistant", "a")], 4: [(None, None)], 5: [("", "")], 6: [("user", "x" * 100_000)]}
    for i in range(10, 90):
        convs[i] = [(r.choice(["user", "assistant"]), r.choice("ab")) for _ in range(r.randint(1, 5))]
    rows = [(c, t, role, text, "z", 1) for c, turns in convs.items() for t, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string, n int")
    got = {x.conv_id: (x.n_turns, x.chat) for x in chat_format.render(df).collect()}
    norm = {c: [(a or "", b or "") for a, b in t] for c, t in convs.items()}
    keep = [c for c, t in norm.items() if not any((len(u) > len(t) and u[: len(t)] == t) or (u == t and d < c) for d, u in norm.items() if d != c)]
    assert got == {c: (len(norm[c]), "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in norm[c])) for c in keep}
    assert chat_format.render(df.where("false")).count() == 0
    odd = spark.createDataFrame([(None, 0, "user", "n"), (1, None, "user", "q"), (1, 2, "user", "r"), (1, 2, "user", "r")], "conv_id long, turn long, role string, text string")
    assert {(x.conv_id, x.n_turns) for x in chat_format.render(odd).collect()} == {(None, 1), (1, 3)}
    # Turns without an id: each for itself, equal ones once, none that begins a conversation.
    loose = spark.createDataFrame([(None, i, "user", t) for i, t in enumerate(["hi", "hi", "go", "stay", None])] + [(7, 0, "user", "go"), (7, 1, "assistant", "ok"), (8, 0, "user", "stay")], odd.schema)
    assert sorted((x.conv_id or 0, x.n_turns, x.chat.count("<|im_start|>"), "hi" in x.chat) for x in chat_format.render(loose).collect()) == [(0, 1, 1, False), (0, 1, 1, True), (7, 2, 2, False), (8, 1, 1, False)]
