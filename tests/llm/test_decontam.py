import math
import random

import pytest

from cuelight.llm import decontam as D


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [[word() for _ in range(n)] for n in (9, 20, 40, 30, 5)]
    docs, truth = [], set()
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k = rng.randrange(4)
            part = items[k][:]
            if i % 2:  # substitutions, at most one in eight words
                for j in range(3, len(part), 8):
                    part[j] = word()
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
            truth.add((i, k))
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else ", ".join(body)))
    return docs, [(k, " ".join(x)) for k, x in enumerate(items)], truth


@pytest.mark.parametrize("broadcast_mb", [64, 0])
def test_planted_items(spark, broadcast_mb):
    docs, items, truth = texts()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.leaks(d, b, D.Overlap(broadcast_mb=broadcast_mb)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == truth
    for r in got:
        words = docs[r["doc_id"]][1].lower().replace(",", "").split()
        item = items[r["item_id"]][1].split()
        equal = sum(words[r["doc_start"] + i] == w for i, w in enumerate(item) if 0 <= r["doc_start"] + i < len(words))
        assert equal == r["n_equal"]


def overlaps(docs, items, shortest=4):
    """Brute force without seeds: all offsets of all items along all documents."""
    expected = set()
    for i, t in docs:
        words = t.split()
        for k, item in items:
            own = item.split()
            if len(own) < shortest:
                continue
            window = min(13, len(own))
            for shift in range(-len(own) + 1, len(words)):
                equal = [words[shift + j] == w for j, w in enumerate(own) if 0 <= shift + j < len(words)]
                best = max(sum(equal[j : j + window]) for j in range(max(1, len(equal) - window + 1)))
                if best >= 0.8 * window:
                    expected.add((i, k))
    return expected


@pytest.mark.parametrize("how", [D.Overlap(), D.Overlap(broadcast_mb=0), D.Overlap(shortest=1)])
def test_brute_force_on_random_windows(spark, how):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "c"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(12)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 18)))) for k in range(30)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b, how).collect()}
    assert found == overlaps(docs, items, how.shortest) and len(found) > 30


@pytest.mark.parametrize("n", range(4, 14))
def test_masks_find_every_pattern_of_substitution(n):
    """Some mask lies on equal words, whichever words are substituted, as far as the similarity allows."""
    from itertools import combinations

    how = D.Overlap()
    masks = how.masks if n >= D.SHORT else how.short_masks(n)
    for changed in combinations(range(n), n - math.ceil(0.8 * n)):
        assert any(
            all(c == "0" or at + i not in changed for i, c in enumerate(m)) for m in masks for at in range(n - len(m) + 1)
        )


def test_large_items_and_clashing_columns(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    items = [(1, " ".join(words[:2000])), (2, " ".join(f"x{i}" for i in range(1500)))]
    near = words[500:1500]
    near[3::9] = ["other"] * len(near[3::9])
    docs = [(1, " ".join(near), 1, 2, 3), (2, "nothing of it", 1, 2, 3), (None, "no id, no item", 1, 2, 3), (None, " ".join(near), 1, 2, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, __held int, __own int, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for how in (D.Overlap(), D.Overlap(broadcast_mb=0)):
        assert {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b, how).collect()} == {(1, 1), (None, 1)}
        kept = D.clean(d, b, how)
        assert kept.columns == d.columns
        assert sorted(r["text"] for r in kept.collect()) == ["no id, no item", "nothing of it"]


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine"
    d = spark.createDataFrame([(1, item), (1, item), (None, item), (2, None), (3, ""), (4, "other words")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in D.leaks(d, b).collect())
    assert got == [(0, 1), (1, 1)]
    assert sorted(r["doc_id"] for r in D.clean(d, b).collect()) == [2, 3, 4]
    assert D.leaks(d.limit(0), b).count() == 0 and D.leaks(d, b.limit(0)).count() == 0
    plan = D.leaks(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
