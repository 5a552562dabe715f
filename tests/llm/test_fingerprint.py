import hashlib
import random

from pyspark.sql import functions as F

from cuelight.llm import fingerprint as P


def shingle_set(text):
    words = text.lower().split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_estimates(spark):
    rng = random.Random(2)
    rows = []
    for i in range(160):
        words = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randint(1, 300))]
        other = [w if rng.random() < 0.97 else "z" + w for w in words]
        rows.append((i, " ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    df = P.fingerprinted(P.fingerprinted(df, "a", "fa"), "b", "fb")
    got = df.select("k", P.likeness("fa", "fb").alias("x"), P.told("fa").alias("t")).collect()
    errors = []
    for r in got:
        a, b = shingle_set(rows[r["k"]][1]), shingle_set(rows[r["k"]][2])
        errors.append(r["x"] - len(a & b) / len(a | b))
        assert len(r["t"]) == 256
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_edited_texts(spark):
    texts = {1: "one two three four five six", 2: "zażółć", 4: None, 9: "", 12: "b" * 41, 13: "one two three four five six"}
    df = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], "doc_id long, text string, __text int").repartition(3)
    out = P.edited_pairs(df.select("doc_id", "text")).select(
        "doc_id", "__text", "__edited", P.told("__fp").alias("f"), P.likeness("__fp", "__next___fp").alias("near"), F.col("__next___text").alias("n")
    )
    got = {r["doc_id"]: r for r in out.collect()}
    order = sorted(texts, reverse=True)
    for k, nxt in zip(order, [*order[1:], order[0]]):
        t, n = texts[k] or "", texts[nxt] or ""
        half = len(t) // 2
        assert got[k]["n"] == n and got[k]["__edited"] == t[: len(t) - half] + n[:half]
    assert got[1]["f"] == got[13]["f"] and got[1]["near"] == 1.0
    assert got[4]["f"] == "" and hashlib.sha256(got[12]["__edited"].encode()).hexdigest()


def test_next_over_many_buckets(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-50_000, 50_000), 700)
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["__next_text"] for r in P.with_next(df, ["text"], 64).collect()}
    order = sorted(ids, reverse=True)
    assert got == {a: str(b) for a, b in zip(order, [*order[1:], order[0]])}


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c")]
    got = P.with_next(spark.createDataFrame(rows, "doc_id long, text string"), ["text"], 8).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["__next_text"]) for r in got) == [(0, "c", "b"), (1, "a", "a"), (1, "a", "c"), (1, "b", "a")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.edited_pairs(empty).count() == 0
    one = P.edited_pairs(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert one["__edited"] == "abab"
    plan = P.edited_pairs(spark.createDataFrame(rows, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
