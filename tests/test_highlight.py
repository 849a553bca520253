import random
import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from timberline.operators import highlight
from timberline.operators.highlight import highlight_spans, merge_spans, regex_spans

CASES = [
    ("information about info", "info", [(0, 4), (18, 4)]),
    ("connection refused", "conection", [(0, 10)]),
    ("Bağlantı koptu", "bağlantı", [(0, 8)]),
    ("Bağlantı koptu", "lant", [(3, 4)]),
    ("aXbXX", "X+", [(1, 1), (3, 2)]),
    ("aXbXX", "X*", [(1, 1), (3, 2)]),
    ("xax", "(?=a)|a", [(1, 1)]),
    ("aaa", "[a]", [(0, 3)]),
    ("ab", "|a", [(0, 1)]),
    ("foo bar", "zzz", []),
    ("foo bar", "", []),
    ("foo bar", "   ", []),
    ("foo bar", "bar foo", [(0, 3), (4, 3)]),
    ("foobar", "bar foo", [(3, 3)]),
    ("x foo ﷐foo", "foo", [(2, 3), (7, 3)]),
    ("ERRORé ERROR", r"\bERROR\b", [(0, 5), (7, 5)]),
    ("", "a+", []),
    ("ab" * 700, "[b]", [(2 * i + 1, 1) for i in range(700)]),
    ("ab é" * 400, "ab", [(4 * i, 2) for i in range(400)]),
]


@pytest.mark.parametrize("text,search,want", CASES)
def test_spans(spark, text, search, want):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    rows = [r[0] for r in df.select(highlight_spans(spark, F.col("t"), search)).collect()]
    assert [(s.start, s.length) for s in rows[0]] == want
    assert rows[1] is None


def test_regex_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1 é") for _ in range(rng.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    for pattern in ["a+b", r"(?<=a)b|1", r"[ab]{2}", r"\d", "a*?b", "(?=a)"]:
        for n, spans in df.select("n", highlight_spans(spark, F.col("t"), pattern)).collect():
            want = []
            for m in re.finditer(pattern, texts[n], re.A):
                if m.end() == m.start():
                    continue
                if want and m.start() <= want[-1][1]:
                    want[-1][1] = max(want[-1][1], m.end())
                else:
                    want.append([m.start(), m.end()])
            assert [[s.start, s.start + s.length] for s in spans] == want, (pattern, texts[n])


def test_merge(spark):
    rng = random.Random(5)
    rows = [(n, [(rng.randint(0, 30), rng.randint(1, 6)) for _ in range(rng.randint(0, 8))]) for n in range(100)]
    df = spark.createDataFrame(rows, "n int, s array<struct<start:int,length:int>>")
    for n, got in df.select("n", merge_spans(F.col("s"))).collect():
        covered = sorted({p for a, k in rows[n][1] for p in range(a, a + k)})
        edges = {a for a, _ in rows[n][1]}
        want = []
        for p in covered:
            if want and p == sum(want[-1]):
                want[-1][1] += 1
            else:
                want.append([p, 1])
        assert [[s.start, s.length] for s in got] == want and edges <= set(covered)


def test_merging_very_many_spans(spark):
    n = 50_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        (i * 3).cast("int").alias("start"), F.when(i % 2 == 0, 3).otherwise(1).alias("length"))).alias("s"))
    got = df.select(merge_spans(F.col("s")).alias("m")).select(F.size("m"), F.col("m")[0], F.element_at("m", -1)).first()
    assert (got[0], tuple(got[1]), tuple(got[2])) == (n // 2, (0, 4), ((n - 2) * 3, 4))


def test_each_pattern_is_searched_once_for_a_merge(spark):
    text = F.col("t")
    df = spark.createDataFrame([("ab",)], "t string").select(
        merge_spans(F.concat(regex_spans(text, "a+"), regex_spans(text, "[bc]"))).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2 and "aggregate(" not in plan


def test_runs_of_long_lines(spark, monkeypatch):
    """Lines that are looked through in several runs, characters of one to four bytes, nulls and empty lines between."""
    monkeypatch.setattr(highlight, "_TEXT_BYTES", 1000)
    monkeypatch.setattr(highlight, "_SPANS", 50)
    rng = random.Random(8)
    texts = [None if n % 9 == 0 else "".join(rng.choice("abcé日🙂 ") for _ in range(rng.choice([0, 1, 30, 3000]))) for n in range(120)]
    arrays = pa.array(["".join(re.sub("[ab]+|🙂|日(?=c)", lambda m: f"﷐{m[0]}﷐", t)).replace("﷐" * 2, "") if t else t for t in texts])
    run = lambda part: highlight._between_marks(part, True)
    got = highlight._by_runs(arrays, pc.binary_length(arrays), highlight._TEXT_BYTES, run)
    assert got.equals(run(arrays)) and got.slice(7, 50).to_pylist() == run(arrays.slice(7, 50)).to_pylist()
    for text, spans in zip(texts, got.to_pylist()):
        assert (spans is None) == (text is None)
        want = [(m.start(), m[0]) for m in re.finditer("(?:[ab]|🙂|日(?=c))+", text or "")]
        assert [(s["start"], s["word"]) for s in spans or []] == want
        assert all(s["length"] == len(s["word"]) for s in spans or [])
    bare = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    spans = {r.n: r.s for r in bare.select("n", regex_spans(F.col("t"), "[ab]+|🙂").alias("s")).collect()}
    for n, text in enumerate(texts):
        want = None if text is None else [(m.start(), m.end() - m.start()) for m in re.finditer("(?:[ab]|🙂)+", text)]
        assert (spans[n] if spans[n] is None else [(s.start, s.length) for s in spans[n]]) == want
