import random
import zlib
from collections import Counter

import numpy as np

from cuelight.llm import toxicity as T


def index(vectors, labels, **more):
    n = max((max(v) for v in vectors), default=0) + 1
    return T.Index(
        vocabulary={f"t{i}": i for i in range(n)},
        idf=np.linspace(1, 2, n),
        ids=np.arange(len(vectors)),
        toxic=np.array(labels, float),
        drawn=np.ones(len(vectors)),
        settings=T.Settings(neighbours=5, block=4, **more),
        blank=0.1,
    ).build([Counter(v) for v in vectors])


def test_nearest_is_exact():
    rng = random.Random(8)
    vectors = [{rng.randrange(12): rng.randint(1, 4) for _ in range(rng.randint(1, 4))} for _ in range(90)]
    ix = index(vectors, [rng.randint(0, 1) for _ in vectors])
    dense = np.zeros((90, len(ix.idf)))
    for row, i in enumerate(ix.ids):
        at, w = ix.vector(Counter(vectors[i]))
        dense[row, at] = w
    for _ in range(60):
        q = Counter({rng.randrange(12): rng.randint(1, 3) for _ in range(rng.randint(1, 4))})
        at, w = ix.vector(q)
        exact = sorted((-round(s, 12), i) for i, s in enumerate(dense[:, at] @ w) if s > 0)[:5]
        got = ix.nearest(at, w)
        assert [i for _, i in got] == [i for _, i in exact]
        assert np.allclose([s for s, _ in got], [-s for s, _ in exact])


def corpus(n=420, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 60))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["vilefoo", "quuxvo" + word(), "Grobzart"]))
        rows.append((i, " ".join(words), "en"))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_whole_texts(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score string").repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    ix = T.fitted(docs, known)
    got = {r["doc_id"]: r["__score"] for r in T.scored(docs.drop("__score"), ix).collect()}
    truth = dict(labels)
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= 0.7) == bool(truth[i]) for i in held)
    assert len(held) > 40 and right / len(held) > 0.95
    assert not set(ix.ids.tolist()) & set(held)
    long_text = "word " * 50_000 + "vilefoo vilefoo grobzart quuxvoxx"
    more = spark.createDataFrame([(1, long_text), (2, None), (3, ""), (4, "vilefoo grobzart"), (4, "vilefoo grobzart")], "doc_id long, text string")
    out = T.scored(more, ix).collect()
    score = [r["__score"] for r in out]
    assert score[0] >= 0.7 and score[1] == score[2] == ix.blank and score[3] == score[4]
    assert out[3]["__evidence"] and not out[1]["__evidence"]
    assert T.accepted(more, known.limit(0)).count() == 5
    assert T.scored(more.limit(0), ix).count() == 0


def test_the_share_of_toxic_terms_counts(spark):
    """Clean texts use a toxic term now and then; only a text that is full of them is toxic."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        words = [word() for _ in range(rng.randint(40, 400))]
        shown = max(2, len(words) // 12) if bad else int(rng.random() < 0.2)
        for _ in range(shown):
            words.insert(rng.randrange(len(words) + 1), "quuxvo")
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    ix = T.fitted(docs, docs)
    got = {r["doc_id"]: r["__score"] >= 0.7 for r in T.scored(docs, ix).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(y for _, y in held) > 20
    assert sum(got[i] for i, y in held if y) >= 0.95 * sum(y for _, y in held)
    assert sum(got[i] for i, y in held if not y) <= 0.02 * len(held)


def test_isotonic_is_the_best_rising_function():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        x, y, w = np.arange(n) / 10, rng.integers(0, 2, n).astype(float), rng.integers(1, 4, n).astype(float)
        at, value = T.isotonic(x, y, w, 0.0)
        got = np.array([value[np.abs(at - v).argmin()] if v in at else np.nan for v in x])
        assert (np.diff(value) > 0).all()
        # max over starts of min over ends of the mean of a stretch
        mean = lambda a, b: (w[a:b] * y[a:b]).sum() / w[a:b].sum()
        best = [max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(sorted(set(np.round(best, 9))), value)
        assert np.isnan(got).any() or np.allclose(got, best)
    at, value = T.isotonic(np.arange(6.0), np.array([0, 0, 1, 1, 1, 1.0]), np.ones(6), 3.0)
    assert len(at) == 2 and value[0] < value[1]


def test_scores_mean_what_they_say(spark):
    """Texts that hold a term by a share of chance: scores of held-out rows are near the rate of label 1."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdeginorst") for _ in range(rng.randint(3, 8)))
    rows = []
    for i in range(1500):
        shown = i % 3 == 0
        words = [word() for _ in range(30)] + ["quuxvo", "vilefoo"] * (3 if shown else 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(rng.random() < 0.6) if shown else 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["doc_id"]: r["__score"] for r in T.scored(docs, T.fitted(docs, docs)).collect()}
    held = [i for i, _, _ in rows if i % 3 == 0 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 100 and abs(sum(got[i] for i in held) / len(held) - 0.6) < 0.15


def test_clashing_columns_and_null_ids(spark):
    rows = [(i, "vilefoo grobzart word" if i % 2 else "plain kind word", i % 2) for i in range(300)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    odd = [(None, "vilefoo grobzart word", 1.0, 2, 3), (None, "plain", 1.0, 2, 3), (8, None, 1.0, 2, 3)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, __score double, __got int, __evidence int")
    kept = T.accepted(docs, known.select("doc_id", "toxic"), T.Settings())
    assert kept.columns == docs.columns and kept.count() == 3  # none of these labels has its text here
    both = docs.unionByName(known.select("doc_id", "text", *[known.doc_id.cast(t).alias(c) for c, t in (("__score", "double"), ("__got", "int"), ("__evidence", "int"))]))
    kept = T.accepted(both, known.select("doc_id", "toxic"))
    assert kept.columns == docs.columns
    assert sorted(r["text"] or "" for r in kept.where("doc_id is null or text is null").collect()) == ["", "plain"]
    assert T.scored(docs, T.fitted(both, known)).columns.count("__score") == 1
