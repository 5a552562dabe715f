import random

import numpy as np
import pytest

from cuelight.llm import licenses as L
from cuelight.llm import packing
from cuelight.llm import token_scan as S
from cuelight.llm.common import WordHashes


def expected(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [1, 3, 64])
def test_flat_files(spark, tmp_path, block):
    rng = random.Random(block)
    files = {}
    for name, n in (("a", 0), ("b", 1), ("c", 64), ("d", 205)):
        ids = [rng.choice([7, 7, 7, 1, 2, 3, 4]) for _ in range(n)]
        files[f"{name}.bin"] = ids
        np.array(ids, "<u2").tofile(tmp_path / f"{name}.bin")
    blocks = S.read_token_files(spark, f"file://{tmp_path}", block_tokens=block)
    got = {}
    for r in S.token_counts(blocks, end_id=7, block_tokens=block).orderBy("ordinal").collect():
        got.setdefault(r["file"].rsplit("/")[-1], []).append((r["start"], r["n_tokens"], r["terminated"]))
    assert got == {k: e for k, v in files.items() if (e := expected(v, 7))}


def test_a_cut_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="multiple"):
        S.read_token_files(spark, f"file://{tmp_path}").count()


def test_documents_round_trip(spark):
    texts = ["", None, "hello <|endoftext|> there", "word " * 700, "x"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, file string").repartition(2)
    blocks, order = S.written(docs, packing.tokenizer_paths(), block_tokens=16)
    got = {r["doc_id"]: r["n_tokens"] for r in S.token_counts(blocks, block_tokens=16).join(order, ["file", "ordinal"]).collect()}
    tok = packing.Tokenizer(*packing.tokenizer_paths())
    assert got == {i: len(tok.plain_ids(t)) for i, t in enumerate(texts)}
    none, order = S.written(docs.limit(0), packing.tokenizer_paths())
    assert S.token_counts(none).count() == 0 and order.count() == 0


def test_one_file_of_many_blocks(spark):
    """A single file, cut in small blocks that many windows scan, some of them without any separator."""
    import numpy as np

    rng = np.random.default_rng(3)
    ids = rng.integers(8, 90, 60_000).astype("<u2")
    ids[rng.choice(60_000, 300, replace=False)] = 7
    ids[20_000:34_000][ids[20_000:34_000] == 7] = 8
    rows = [("one", k, bytearray(ids[at : at + 4].tobytes())) for k, at in enumerate(range(0, 60_000, 4))]
    blocks = spark.createDataFrame(rows, "file string, block long, payload binary").repartition(5)
    got = S.token_counts(blocks, end_id=7, block_tokens=4).orderBy("ordinal").collect()
    ends = np.flatnonzero(ids == 7).tolist()
    starts = [0, *[e + 1 for e in ends]]
    expected = [(k, a, b - a, b < 60_000) for k, (a, b) in enumerate(zip(starts, [*ends, 60_000])) if b < 60_000 or b > a]
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["terminated"]) for r in got] == expected


def passages(text):
    return L.found(text, L.Index(L.TEMPLATES, L.Scan()), WordHashes(), {})


def test_every_template_is_found():
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("abcde") for _ in range(5))
    for name, template in L.TEMPLATES.items():
        before = " ".join(word() for _ in range(rng.randint(0, 30)))
        text = f"{before} {template}. {word()} {word()}"
        got = passages(text)
        # a notice that another template contains is told as the longer one
        best = [g for g in got if g[0] == name or len(L.TEMPLATES[g[0]]) >= len(template)]
        assert best and best[0][1] >= 0.8
        assert text[got[0][3] : got[0][4]] in template


def test_edited_templates_and_clean_texts():
    words = L.TEMPLATES["MIT grant"].split()
    words[10] = "whichever"
    del words[20]
    words.insert(30, "extra")
    got = passages("Some text. " + " ".join(words))
    assert got[0][0] == "MIT grant" and 0.9 < got[0][1] < 1
    for clean in (None, "", "the licensed software", "words " * 1000, "Licensed under the"):
        assert passages(clean) == []


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    for n in range(0, 40):
        h = rng.integers(0, 9, n).astype(np.uint64)
        kept = set(L.winnowed(h, 4))
        assert all(kept & set(range(i, i + 4)) for i in range(n - 3))


def test_alignment_against_full_table():
    rng = random.Random(3)
    for _ in range(60):
        t = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        w = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        table = [[0] * (len(w) + 1) for _ in range(len(t) + 1)]
        for i in range(1, len(t) + 1):
            table[i][0] = table[i - 1][0] - 1
            for j in range(1, len(w) + 1):
                table[i][j] = max(table[i - 1][j - 1] + (2 if t[i - 1] == w[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        got = L.aligned(t, w, 0, 20)
        assert all(t[a] == w[b] for a, b in got) and got == sorted(set(got))
        assert 2 * len(got) >= max(table[-1])


def test_scan_of_a_table(spark):
    rows = [(1, "x\nReleased under the MIT License."), (1, "x\nReleased under the MIT License."), (None, None), (3, "")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "doc_id long, text string, template string")
    got = L.scanned(docs).collect()
    assert [(r["doc_id"], r["template"], r["start"], r["end"]) for r in got] == [(1, "MIT notice", 2, 32)] * 2
    assert L.scanned(docs.limit(0)).count() == 0 and L.scanned(docs, {}).count() == 0


@pytest.mark.parametrize("name", list(L.TEMPLATES))
@pytest.mark.parametrize("between", ["\n", " x\n", " one two three\n", " a b c d e f g h i\n"])
def test_every_one_of_adjacent_repeats_is_found(name, between):
    template = L.TEMPLATES[name]
    one = passages(template)
    for n in (2, 3, 5, 9):
        got = passages("Before. " + (template + between) * n)
        starts = [8 + i * len(template + between) for i in range(n)]
        assert [(t, a, b) for t, _, _, a, b in got] == [(t, a + at, b + at) for at in starts for t, _, _, a, b in one]


def test_repeats_among_other_notices_and_edits():
    mit, apache, cc = (L.TEMPLATES[k] for k in ("MIT notice", "Apache-2.0 notice", "CC-BY-4.0 notice"))
    edited = "Released under our the MIT License"
    parts = [mit, mit, apache, apache, cc, cc, mit, edited, mit, "Some prose.", apache]
    got = passages(" ".join(parts))
    # the edit leaves a fingerprint of the other notice of the license
    assert [t.removesuffix(" 2") for t, *_ in got] == ["MIT notice"] * 2 + ["Apache-2.0 notice"] * 2 + ["CC-BY-4.0 notice"] * 2 + ["MIT notice"] * 3 + ["Apache-2.0 notice"]
    assert len(passages(f"{mit}\n" * 3000)) == 3000
