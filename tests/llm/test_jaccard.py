import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelight.llm import common, jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(rows):
    """Brute force: doc_id -> (set size, smallest doc_id in reach)."""
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def planted(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = [word() for _ in range(30)]
    texts = ["", " \t\n", "one", "One", "one two three four", "one two three four five"]
    base = [word() for _ in range(80)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5:  # near copies, chains of edits
            copy = base[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.4:
                base = copy
            texts.append(" ".join(copy).title() if rng.random() < 0.2 else "  ".join(copy))
        elif kind < 0.8:
            texts.append(" ".join([word() for _ in range(rng.randint(3, 60))] + passage))
        else:
            texts.append(rng.choice(texts))
    return list(enumerate(texts))


@settings(max_examples=300, deadline=None)
@given(st.text("aB é\t\n\x0b\x1c\x85\xa0", max_size=30))
def test_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, hashes = WORD.findall(lower), common.word_hashes(text).tolist()
    assert len(words) == len(hashes) and len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))


def test_long_texts_and_words():
    text = ("ab cd " * 300_000) + "x" * 2_500_000 + " ab"
    got = common.word_hashes(text)
    assert len(got) == 600_002 and len(set(got.tolist())) == 3 and got[0] == got[-1]
    vocabulary = [f"{a}{b}{c}" for a in "abcé" for b in range(300) for c in "xyzw"]
    assert len(set(common.word_hashes(" ".join(vocabulary)).tolist())) == len(vocabulary)


@pytest.mark.parametrize("n", range(1, 200, 7))
def test_prefixes_are_long_enough(n):
    how = J.Threshold()
    for m in range(n, n * 5 // 4 + 1):  # m is the larger set
        need = -(-4 * (n + m) // 9)
        assert how.common(n, m) == need
        assert how.probe_prefix(m) >= m - need + 1 and how.index_prefix(n) >= n - need + 1


@pytest.mark.parametrize("seed, hot", [(1, 2000), (2, 0)])
def test_against_brute_force(spark, seed, hot):
    rows = planted(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(3)
    got = J.classes(docs, J.Threshold(hot=hot, counters=14, heavy_copies=2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(rows)


def test_shuffled_paths_and_small_cells(spark, monkeypatch):
    """Nothing is few enough to be broadcast, and no cell holds more than two sets of a shingle."""
    monkeypatch.setattr(common, "SMALL", -1)
    monkeypatch.setattr(J, "SMALL", -1)
    rows = planted(3, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.classes(docs, J.Threshold(counters=14, heavy_copies=2, told_rows=-1, cell=2)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(rows)


def test_a_group_of_loose_copies_makes_pairs_in_proportion(spark, monkeypatch):
    """Copies with three edits each share nearly all prefixes and are hardly ever linked."""
    made = []
    whole = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *a: made.append(pairs.count()) or whole(pairs, *a))
    for n in (150, 300):
        rng = random.Random(4)
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
        base, rows = [word() for _ in range(100)], []
        for i in range(n):
            copy = base[:]
            for k in rng.sample(range(100), 3):
                copy[k] = word()
            rows.append((i, " ".join(copy)))
        got = J.classes(spark.createDataFrame(rows, "doc_id long, text string"), J.Threshold(counters=14)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes(rows)
    assert max(made) < 300


def test_hashes_have_no_period(spark):
    turn = ["a"]
    for _ in range(11):
        turn = turn + ["b" if c == "a" else "a" for c in turn]
    other = ["b" if c == "a" else "a" for c in turn]
    words = ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "".join(turn), "".join(other), "ab" * 32, "ba" * 32]
    assert len({int(common.word_hashes(w)[0]) for w in words}) == len(words)
    assert common.word_hashes("A" * 100)[0] == common.word_hashes("a" * 100)[0]


def test_clashing_keys_are_told_apart(spark, monkeypatch):
    """Sets whose first hash is the same are still two sets."""
    keys = J._keys
    monkeypatch.setattr(J, "_keys", lambda own: (7, keys(own)[1]))
    alike = {7}
    import numpy as np

    a, b = np.array([1], np.uint64), np.array([2], np.uint64)
    assert J._told_apart(a, alike) != J._told_apart(b, alike) and J._told_apart(a, set()) == 7


def test_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in J.classes(docs).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (5, 2, 1), (7, 0, 7), (8, 0, 8)]
    kept = J.representatives(docs).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 1, 7, 8]
    assert J.classes(docs.limit(0)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    names = ["key", "rep", "n", "component", "tok", "size", "cls", "sig", "check", "__cell"]
    rows = [(3, "a b c d e f", *range(10)), (3, "a b c d e f", *range(1, 11)), (4, "A b c d e f", *range(10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    kept = [J.representatives(docs.repartition(k)).collect() for k in (1, 3)]
    assert len(kept[0]) == 1 and kept[0] == kept[1] and kept[0][0]["doc_id"] == 3
    assert kept[0][0].__fields__ == docs.columns


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(30)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}


def test_tree_sum(spark):
    import numpy as np

    rows = [(c, t, common.packed(np.full(3, t + c))) for c in range(2) for t in range(10)]
    parts = spark.createDataFrame([(c, t, bytearray(b)) for c, t, b in rows], "chunk int, task int, counts binary")
    assert common.summed(parts, 10, fan_in=3).tolist() == [45] * 3 + [55] * 3
