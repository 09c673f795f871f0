import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.functions import budget, reducers, scoring
from sessionloom.functions.text import content_hash, lines, token_count
from sessionloom.schema import PRESSURES, Config, ConfigError, Context, Model, Reserve, load_config

from word_breaks import count


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1)).select(column.alias("x")).first().x


def long(n):
    return F.lit(n).cast("long")


def test_usable_and_pressure(spark):
    u = budget.usable(long(9_000), long(1_500), long(500))
    assert one(spark, u) == 7_000
    assert one(spark, budget.pressure(long(2_800), u)) == pytest.approx(0.4, abs=1e-7)
    assert one(spark, budget.usable(long(5), long(9), long(1))) == 0
    assert math.isinf(one(spark, budget.pressure(long(1), long(0))))


def test_states_just_below_and_at_each_threshold(spark):
    c = Context(observe=0.1, trim=0.2, compact=0.3, aggressive=0.4, emergency=0.5)
    marks = [np.float32(x) for x in (c.observe, c.trim, c.compact, c.aggressive, c.emergency)]
    for i, mark in enumerate(marks):
        below = float(np.nextafter(mark, np.float32(0)))
        assert one(spark, budget.pressure_state(F.lit(below).cast("float"), c)) == PRESSURES[i]
        assert one(spark, budget.pressure_state(F.lit(float(mark)).cast("float"), c)) == PRESSURES[i + 1]
    assert one(spark, budget.pressure_state(F.lit(float("inf")).cast("float"), c)) == PRESSURES[-1]


@pytest.mark.parametrize(
    ("text", "n"),
    [("hello world", 2), ("", 0), (None, 0), ("  \n\t ", 0), ("it's 3.14, ok.", 5), ("a.b c_d 1,000", 3), ("x--y", 4), ("a b", 2), ("naïve Ünder", 2), ("artifact://file/cgc-00000000-0000-0000-0000-000000000000", None), ("a:b 1:2", 4)],
)
def test_token_count(spark, text, n):
    got = one(spark, token_count(F.lit(text).cast("string")))
    assert got == n if n is not None else got > 0


#: Letters of scripts with and without spaces, digits, joiners, marks, format characters, quotes, flags, pictures and spaces.
ALPHABET = [*"aZ\u00e91 9_.,:;'\"!-\n\r\t", *"\u0301\u200d\u00ad\u200b\u6f22\u5b57\u3072\u30ab\u30ca\u30fc\u0e01\u0e32\u0e34\ud55c\u05d0\u05d1\U0001f600\U0001f469\U0001f1e9\U0001f1ea\u2764\ufe0f\U0001f3fd\u00a0\u2009\u202f\u0663\u066c\u00b7\u2019\u03a9\u203f\u2122\u3000\uff9e\uff76"]


def test_token_count_by_the_rules(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    known = {"\u6f22\u5b57\u8a9e": 3, "\u65e5\u672c\u8a9e\u306e\u6587": 5, "\U0001f468\u200d\U0001f469\u200d\U0001f467": 1, "\U0001f1e9\U0001f1ea\U0001f1eb\U0001f1f7": 2, "\ud55c\uad6d\uc5b4 \ub9d0": 2, "\u30ab\u30bf\u30ab\u30ca": 1}
    df = spark.createDataFrame(list(enumerate([*known, *texts])), "i int, t string").repartition(4)
    got = {x.t: x.n for x in df.select("t", token_count(F.col("t")).alias("n")).collect()}
    assert {t: got[t] for t in known} == known
    assert {t: n for t, n in got.items() if n != count(t)} == {}


def test_token_count_of_long_words(spark):
    df = spark.createDataFrame([("a" * 300_000,), ("a." * 100_000,), ("\u6f22" * 100_000,), ("\u00e91_" * 100_000,)], "t string")
    assert [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()] == [1, 2, 100_000, 1]


def test_hash_and_lines(spark):
    assert one(spark, content_hash(F.lit("hello"))) == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert one(spark, lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert one(spark, lines(F.lit("a\n\n"))) == ["a", ""]
    assert one(spark, lines(F.lit(""))) == []
    assert one(spark, lines(F.lit("a\r"))) == ["a\r"]


def reduce(spark, which, name, text, command=None, code=None):
    return one(spark, reducers.apply(which, F.lit(name), F.lit(text), F.lit(command).cast("string"), F.lit(code).cast("int")))


def test_shell_reducer(spark):
    text = "\x1b[32mBuilding\x1b[0m\n| / - \\\n\n45% done\nDone\nDone\nstep\n"
    assert reduce(spark, "reduce", "shell", text) == "Building\nDone\nstep"
    assert reduce(spark, "extract", "shell", "ok\nerror: x\nerror: x\nend", "make", 2) == "command: make\nexit_code: 2\nerrors:\n  error: x\nfinal_status:\n  ok\n  error: x\n  end"
    assert reduce(spark, "extract", "shell", "") == "errors:\n  <none>"


def test_test_reducer(spark):
    text = "test a ... ok\ntest b ... ok\ntest c ... ok\ntest result: ok. finished in 0.1s"
    assert reduce(spark, "reduce", "test", text) == "3 tests passed\n0 failed\nduration test result: ok. finished in 0.1s"
    assert reduce(spark, "reduce", "test", "test a ... FAILED\ntest b ... ok\nfailures:\n---- a ----") == "test a ... FAILED\nfailures:\n---- a ----"
    assert reduce(spark, "reduce", "test", "nothing here") == ""
    many = "\n".join(f"test t{i} ... FAILED" for i in range(300))
    assert len(reduce(spark, "reduce", "test", many).split("\n")) == 201


def test_compiler_reducer_and_choice(spark):
    text = "Compiling app\n  error[X7] : no such name\n  --> lib/one.rs:10:3\n  --> lib/one.rs:10:3\n   | let y\nERROR: stopped\nwarning: unused\n--> lib/two:9"
    assert reduce(spark, "reduce", "compiler", text) == "  error[X7] : no such name\n  --> lib/one.rs:10:3\nERROR: stopped"
    name = lambda kind, text: one(spark, reducers.reducer_name(F.lit(kind), F.lit(text)))
    assert name("Error", text) == "compiler"
    assert name("CommandOutput", "Downloading 3%") == "shell"
    assert name("CommandOutput", "test a ... ok") == "test"
    assert name("TestResult", "?") == "test"
    assert name("FileContent", "x") is None


def test_reducers_take_time_in_proportion_to_lines(spark):
    """A log of 50,000 lines, more errors and failures than are kept, and as many repeats."""
    log = "\n".join(f"step {i // 2}\n{i % 100}% done\nerror: bad {i}\ntest t{i} ... {'FAILED' if i % 2 else 'ok'}\n\x1b[1mnote\x1b[0m" for i in range(10_000))
    start = time.perf_counter()
    out = reduce(spark, "extract", "shell", log, "make", 1).split("\n")
    assert out[:4] == ["command: make", "exit_code: 1", "errors:", "  error: bad 0"] and len(out) == 3 + 20 + 4 and out[-4:] == ["final_status:", "  error: bad 9999", "  test t9999 ... FAILED", "  note"]
    assert len(reduce(spark, "reduce", "shell", log).split("\n")) == 40_000
    assert len(reduce(spark, "reduce", "test", log).split("\n")) == 201
    assert len(reduce(spark, "reduce", "compiler", log).split("\n")) == 10_000
    assert time.perf_counter() - start < 60


@pytest.mark.parametrize(("text", "yes"), [("you MUST do it", True), ("don't", True), ("mustard", False), ("only this", True), ("hello", False)])
def test_constraints(spark, text, yes):
    df = spark.createDataFrame([(text,)], "content string")
    assert df.select(scoring.looks_like_constraint().alias("x")).first().x is yes


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[context]\ncompact_pressure = 0.7\nmax_context_window = 100000\n[prediction]\nema_alpha = 0.5\n[unknown]\nx = 1\n")
    c = load_config(str(path))
    assert c.context.compact == 0.7 and c.context.max_context_window == 100_000 and c.prediction.ema_alpha == 0.5 and c.context.trim == 0.60
    for bad in (Config(context=Context(trim=0.99)), Config(context=Context(target_pressure=2)), Config(context=Context(max_context_window=10), reserve=Reserve(5, 5))):
        with pytest.raises(ConfigError):
            bad.validate()
    with pytest.raises(ConfigError):
        Model("m", 1, 1).check(Config())


def test_counts_get_texts_in_small_batches(spark):
    """However many rows of long texts a task has, a worker that counts gets a few MB of them at once."""
    import pyarrow as pa

    from sessionloom.functions import text

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(1 << 30))
    try:
        rows = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))
        counted = rows.select(text.token_count(F.col("text")).alias("n"), F.arrow_udf(lambda x: pa.array([x.nbytes] * len(x)), "long")("text").alias("held"))
        assert counted.agg(F.min("n"), F.max("n"), F.max("held") < 2 * text.BATCH_BYTES).first()[:] == (4000, 4000, True)
    finally:
        spark.conf.set(name, old)
