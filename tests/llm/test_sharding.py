import collections

import numpy as np
from pyspark.sql import functions as F

from cuelight.llm import sharding


def test_matrix_has_its_margins():
    sent, wanted = [5, 0, 7, 4], [4, 4, 4, 4]
    m = sharding.communication_matrix(sent, wanted, 3)
    assert m.sum(axis=1).tolist() == sent and m.sum(axis=0).tolist() == wanted


def test_matrix_follows_the_hypergeometric_law():
    draws = collections.Counter(int(sharding.communication_matrix([3, 3], [2, 4], s)[0, 0]) for s in range(3000))
    expected = {0: 3 * 1 / 15, 1: 9 / 15, 2: 3 / 15}  # C(3,k) C(3,2-k) / C(6,2)
    assert all(abs(draws[k] / 3000 - p) < 0.04 for k, p in expected.items())


def test_large_populations():
    """The draw beyond numpy's limit follows the same law, and margins of 10^11 rows are met."""
    rng = np.random.default_rng(5)
    for good, bad, n in [(30, 50, 20), (3, 4, 5), (200, 100, 150), (1, 9, 9)]:
        ours = np.array([sharding.drawn(rng, good, bad, n, limit=0) for _ in range(4000)])
        assert ours.min() >= max(0, n - bad) and ours.max() <= min(good, n)
        mean = n * good / (good + bad)
        spread = (mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)) ** 0.5
        assert abs(ours.mean() - mean) < 5 * spread / 4000**0.5
        assert abs(ours.std() - spread) < 0.06 * spread + 1e-9
    draws = collections.Counter(sharding.drawn(rng, 2, 4, 3, limit=0) for _ in range(4000))
    assert all(abs(draws[k] / 4000 - p) < 0.04 for k, p in {0: 0.2, 1: 0.6, 2: 0.2}.items())
    sent, wanted = [40 * 10**9, 35 * 10**9, 25 * 10**9], [100 * 10**9 // 64] * 64
    m = sharding.communication_matrix(sent, wanted, 9)
    assert m.sum(axis=1).tolist() == sent and m.sum(axis=0).tolist() == wanted
    # 40 % of a cell of 1.6 billion rows, give or take
    assert (np.abs(m[0] / wanted[0] - 0.4) < 1e-4).all() and len(set(m[0].tolist())) > 50


def test_a_task_draws_the_row_of_the_whole_matrix():
    sent, wanted = [5, 0, 7, 4, 9, 1, 2], [4, 4, 4, 4, 12]
    whole = sharding.communication_matrix(sent, wanted, 3)
    assert all((sharding.matrix_row(sent, wanted, 3, i) == whole[i]).all() for i in range(7))


def test_many_partitions_and_cells(spark):
    df = spark.range(4000).repartition(60)
    got = sharding.uniform_shards(df, 16, rows_per_cell=4).collect()
    assert len({r["id"] for r in got}) == 4000
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(250))


def shards(df, seed=17, cell=5):
    return sharding.uniform_shards(df, 4, seed=seed, rows_per_cell=cell)


def test_exact_sizes_and_slots(spark):
    rows = [(i % 7 if i % 5 else None, None if i % 3 else f"t{i % 2}", i) for i in range(203)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, k long").repartition(6)
    got = shards(df).collect()
    assert sorted(r["k"] for r in got) == list(range(203))
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [50, 51, 51, 51]
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_places_are_uniform(spark):
    df = spark.range(24).repartition(3)
    seen = np.zeros((24, 4))
    for seed in range(40):
        for r in shards(df, seed, 3).collect():
            seen[r["id"], r["shard"]] += 1
    assert abs(seen.mean(axis=0) - 10).max() < 1e-9
    assert ((seen - 10) ** 2 / 10).sum() < 72 + 5 * 12**0.5 * 2  # chi square of 72 degrees, 5 deviations


def test_empty_and_digests(spark):
    df = spark.createDataFrame([(1, "aé"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.document_digests(df).collect()}
    import zlib

    assert got == {1: (4, zlib.crc32("aé".encode())), 2: (1, 0)}
    assert shards(df.limit(0)).count() == 0
    assert shards(df.select(F.col("doc_id"))).count() == 2
