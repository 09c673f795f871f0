"""Spelling variants, byte-level BPE and conversation repair against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import byte_bpe, chat_repair, queries, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---- spelling ----


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def spelled(docs):
    """Rows of op11 by their definition, every pair compared."""
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    rows = {}
    for w in n:
        others = sorted((o for o in n if o != w and near(w, o)), key=lambda o: (-n[o], o))
        form = others[0] if others and n[others[0]] >= 10 * n[w] else None
        rows[w] = [n[w], len(others), form, n.get(form)]
    for w in rows:
        root = w
        while rows[root][2]:
            root = rows[root][2]
        rows[w].append(root)
    return sorted((w, *r) for w, r in rows.items())


def found_by(rows):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect())


def test_spelling_by_brute_force(spark):
    pick = random.Random(5)
    words = ["".join(pick.choices("abcé×", k=pick.choice([6, 7, 8, 9, 10]))) for _ in range(400)] + ["Frequent", "frequens", "frequenz"]
    docs = [(i, " ".join(pick.choices(words, k=30)) + " Frequent" * 9 + "-frequent" * (i % 5)) for i in range(300)]
    docs += [(None, "frequens frequens"), (1, None), (2, ""), (3, "12 34"), (3, "frequenz " * 4), (3, "frequenz " * 4)]
    want = spelled(docs)
    assert any(r[3] for r in want) and any(r[2] > 1 for r in want)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(7)).repartition(5)
    counted = spelling.words_of(rows)
    assert found_by(spelling.variants(counted)) == want
    # Groups of a shared half that are cut into parts find the same.
    got = spelling.near_words(counted, block=3).collect()
    assert {r.word: (r.n_near, r.best if r.best_n >= 10 * dict((w[0], w[1]) for w in want)[r.word] else None) for r in got} == {w[0]: (w[2], w[3]) for w in want if w[2]}


def test_spelling_chains_long_words_and_empty_tables(spark):
    rows = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20000), ("x" * 3000, 5), ("x" * 2999, 50), ("x" * 1500 + "y" + "x" * 1499, 3)]
    found = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert found["aaaaaaa"].root == "aaabbbb" and found["aaaaaaa"].form == "aaaaaab" and found["aaabbbb"].form is None
    assert (found["x" * 3000].n_near, found["x" * 3000].root, found["x" * 2999].n_near) == (2, "x" * 2999, 2)
    # Equal counts: the smaller word by code points.
    tie = spelling.variants(spark.createDataFrame([("abcdefgh", 1), ("abcdefgé", 10), ("abcdefgz", 10), ("abcdefg", 9)], "word string, n long"))
    assert {r.word: r.form for r in tie.collect()}["abcdefgh"] == "abcdefgz"
    none = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.words_of(none)).count() == 0


def test_automaton_is_minimal_and_numbers_words(spark):
    pick = random.Random(2)
    words = sorted({"".join(pick.choices("ab", k=pick.choice([3, 4, 5]))) for _ in range(40)})
    a = spelling.Automaton(spelling._matrix(words))
    endings = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            endings[w[:i]].add(w[i:])
    assert len(a.final) == len({frozenset(e) for e in endings.values()})
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
    for number, w in enumerate(words):
        state, got = np.array([a.root]), 0
        for c in w:
            arc, good = a.step(state, np.array([letters[c]]))
            assert good.all()
            state, got = a.target[arc], got + int(a.before[arc][0])
        assert a.final[state[0]] and got == number


# ---- byte-level BPE ----


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.default_path()), special_tokens={})


def test_bpe_as_the_library(spark, library):
    pick = random.Random(7)
    odd = "ab cdé's 12²\t\n\x0b\x1c\x85\xa0 ​日本語ñ\U0001f600'll<|endoftext|>.,!"
    texts = ["".join(pick.choices(odd, k=pick.randint(1, 60))) for _ in range(300)]
    texts += [None, "", " ", "\n\n\n x", "a" * 30_000, "<>" * 4_000, " " * 3_000 + "x", "été " * 5_000, "the quick brown fox isn't here", "the quick brown fox isn't here", "﻿x\x00y"]
    rows = spark.createDataFrame([(i, t, "clash", b"clash") for i, t in enumerate(texts)], "doc_id long, text string, _text string, ids binary").repartition(3)
    found = byte_bpe.decode(byte_bpe.encode(rows))
    assert found.columns == ["doc_id", "text", "_text", "ids", "decoded"]
    for r in found.collect():
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_bpe_of_real_texts_and_of_parts(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op12_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 5)
    for text in ["ab  cd\n\n e", "x" * 40, "  " * 20 + "a b", *list(texts.values())[:20]]:
        cut = list(byte_bpe.parts(text or ""))
        assert "".join(cut) == (text or "")
        pattern = byte_bpe.Encoder(byte_bpe.Vocabulary(library._mergeable_ranks), library._pat_str).pattern if text == "ab  cd\n\n e" else pattern
        assert [w for p in cut for w in pattern.findall(p)] == pattern.findall(text or "")


def test_perfect_hash_is_minimal_and_rejects(spark, library):
    v = byte_bpe.Vocabulary(library._mergeable_ranks)
    tokens = v.tokens()
    assert sorted(v.slots.tolist()) == list(range(v.n)) and (v.find(tokens) == np.arange(v.n)).all()
    pick = random.Random(1)
    words = [bytes(pick.choices(b"abcdefgh \xc3\xa9", k=pick.randint(1, 200))) for _ in range(5_000)] + [b""]
    assert [int(x) >= 0 for x in v.find(words)] == [w in library._mergeable_ranks for w in words]
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.Vocabulary({b"a": 0})


def test_bpe_of_an_empty_table(spark):
    none = spark.createDataFrame([], DOCS)
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0


# ---- conversation repair ----


def cheapest(rows):
    """(cost, audit, lines) by trying every edit of rows of (role, text, fault); the role's initials must match the wanted pattern."""
    best = None

    def may(out):
        return re.fullmatch("s?(ua)*u?", out) is not None

    def go(i, out, cost, audit, lines):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost + 1,), (cost, audit, lines))
        if not audit.endswith("II"):
            for name in ("user", "assistant"):
                if may(out + name[0]):
                    go(i, out + name[0], cost + 3, audit + "I", [*lines, f"{name}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, out, cost + 4, audit + "D", lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role and may(out + role[0]):
                    go(i + 1, out + role[0], cost + more, audit + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    if may(out + name[0]):
                        go(i + 1, out + name[0], cost + 3 + more, audit + "R", [*lines, f"{name}:{text}"])

    go(0, "", 0, "", [])
    return best


def repaired_by_hand(turns):
    said = defaultdict(list)
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        said[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), turn, role, text))
    out = {}
    for conv, rows in said.items():
        rows.sort(key=lambda r: r[:3])
        seen, faults = set(), []
        for *_, role, text in rows:
            t = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
            seen.add((role, text))
        found = cheapest([(r[-2], r[-1], f) for r, f in zip(rows, faults, strict=True)])
        numbers = [r[3] for r in rows if r[3] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[-2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, found[0], found[1], hashlib.sha256("\n".join(found[2]).encode()).hexdigest())
    return out


def made_turns():
    pick = random.Random(11)
    texts = ["Hi.", "Hi.", "What?", "cut off", "", " \n", None, "Yes! ", "so\n"]
    rows = [(c if c else None, pick.choice([None, *range(9)]), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), pick.choice(texts)) for c in range(120) for _ in range(pick.randint(0, 6))]
    return rows + rows[:7]


@pytest.mark.parametrize("bits", [0, 1, 10])
def test_repair_by_brute_force(spark, bits):
    turns = made_turns()
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(1)).withColumn("key", F.lit("k")).repartition(6)
    audits, repaired = chat_repair.repair(rows, block_bits=bits)
    digest = {r.conv_id: r.sha256 for r in chat_repair.digests(repaired).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, empty)) for r in audits.collect()}
    assert got == repaired_by_hand(turns)


def test_repair_of_a_long_conversation(spark):
    """One conversation of most rows, many of them equal: cut into blocks, its repaired form is legal and costs what its audit says."""
    pick = random.Random(3)
    turns = [(7, i, pick.choice(["user", "assistant"]), pick.choice(["ok.", f"number {i}.", "cut"])) for i in range(6_000)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    audits, repaired = chat_repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), block_bits=7)
    rows = {r.conv_id: r for r in audits.collect()}
    assert (rows[8].audit, rows[8].cost) == ("KK", 0)
    said = [r.role for r in repaired.where("conv_id = 7").orderBy("at", "nth").collect()]
    assert said == ["user", "assistant"] * (len(said) // 2) and len(said) % 2 == 0
    audit = rows[7].audit
    assert audit.count("K") + audit.count("R") + audit.count("I") == len(said) and audit.count("D") + audit.count("K") + audit.count("R") == 6_000
    whole = chat_repair.repair(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), block_bits=20)[0]
    assert {r.conv_id: r for r in whole.collect()} == rows


def test_repair_of_empty_and_emptied_tables(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    audits, repaired = chat_repair.repair(spark.createDataFrame([], schema))
    assert audits.count() == 0 and chat_repair.digests(repaired).count() == 0
    # A conversation whose rows are all dropped stays, with nothing.
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], schema).write.parquet(str(tmp_path / "conversations.parquet"))
    (r,) = queries.op13_chat_repair(spark, str(tmp_path)).collect()
    assert (r.conv_id, r.gaps, r.illegal, r.cost, r.audit, r.repaired_sha256) == (gone, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
