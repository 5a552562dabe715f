from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelight.functions import geometry, text
from cuelight.operators.entities import normalise


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]


def test_normalised_text(spark):
    cases = {"  J0hn\tSm1th! ": "JOHN SMITH", "ﬁne": "FINE", "JOHN SMlTH": "JOHN SMLTH", "«5|»": "SI", None: "", "...": ""}
    for given_text, expected in cases.items():
        assert one(spark, given_text, text.normalised) == expected
        assert normalise(given_text) == expected


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=12), st.text("ab c", max_size=12))
def test_common_subsequence(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert text.common_subsequence(a, b) == rows[-1][-1]


def test_similarity_of_a_misread_name(spark):
    assert text.ratio("JOHN SMLTH", "JOHN SMITH") == 90.0
    row = spark.createDataFrame([("JOHN SMLTH", "JOHN SMITH")], "a string, b string")
    assert row.select(text.similarity("a", "b").alias("x")).first()["x"] == 90.0
    assert row.select(text.may_be_similar(F.col("a"), F.col("b")).alias("x")).first()["x"]


def test_words_and_symbols(spark):
    assert sorted(one(spark, "HotelCentral www.Hotel.com MPEGFile of 123abc", text.words)) == ["abc", "central", "file", "hotel", "mpeg"]
    assert one(spark, "a1 é²!", text.count_alphanumeric) == 4
    assert one(spark, "##@@ ~~", text.is_symbol_heavy) and not one(spark, "Hotel Central!", text.is_symbol_heavy)


def test_time_stamps(spark):
    for seconds, expected in [(271.5, "00:04:31.500"), (3661.2345, "01:01:01.234"), (-1.0, "00:00:00.000"), (None, "00:00:00.000"), (360000.0, "100:00:00.000")]:
        assert one(spark, seconds, text.time_stamp, "double") == expected
    for value, expected in [("271.5", 271.5), ("04:31", 271.0), ("1:01:01.25", 3661.25), ("1:60", None), ("", None), ("x", None), ("-3", None)]:
        assert one(spark, value, text.parse_time_stamp) == expected
    assert one(spark, "01:00:02,500", text.caption_time) == 3602.5
    assert one(spark, "02:03.004", text.caption_time) == 123.004
    assert one(spark, 1234.0625, lambda c: text.fixed(c, 3), "double") == "1234.062"


def test_boxes(spark):
    row = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 10.0, 10.0)], "x double, y double, w double, h double, bx double, by double, bw double, bh double")
    a, b = geometry.box(), geometry.box("b")
    got = row.select(geometry.iou(a, b).alias("i"), geometry.centre_ratio(a, b, F.lit(3), F.lit(4)).alias("c")).first()
    assert abs(got["i"] - 25 / 175) < 1e-12 and abs(got["c"] - 50**0.5 / 5) < 1e-12
    for box, where in [((900, 500, 100, 40), "Center"), ((0, 0, 1300, 10), "Multiple / Large Area"), ((0, 0, 10, 10), "Upper Left"), ((900, 1000, 50, 20), "Lower Center")]:
        df = spark.createDataFrame([tuple(map(float, box))], "x double, y double, w double, h double")
        assert df.select(geometry.position(a, F.lit(1920), F.lit(1080)).alias("p")).first()["p"] == where
    corners = spark.createDataFrame([([1.0, 2.0, 4.0, 6.0],), ([9.0, 9.0, 4.0, 6.0],)], "v array<double>")
    assert [tuple(r["b"]) for r in corners.select(geometry.box_of_numbers(F.col("v")).alias("b")).collect()] == [(1, 2, 3, 4), (9, 9, 4, 6)]
    empty = spark.createDataFrame([([],)], "v array<array<double>>")
    assert tuple(empty.select(geometry.polygon_box(F.col("v")).alias("b")).first()["b"]) == (0, 0, 0, 0)


def test_whole_documents_are_normalised(spark, tmp_path):
    import __spark_entry__ as entry

    texts = {1: "  J0hn\tSm1th!\n second   line ", 2: "Ä 015|\nﬁne ½\u00a0№\n", 3: None, 4: "", 5: "\nonly\nbelow «»"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["norm"] for r in entry.queries()["normalize_text"](spark, str(tmp_path)).collect()}
    assert got == {i: normalise(t) for i, t in texts.items()} and got[1] == "JOHN SMITH! SECOND LINE"


def test_given_documents_are_normalised_whole(spark, small):
    import __spark_entry__ as entry

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r["doc_id"]: r["norm"] for r in entry.queries()["normalize_text"](spark, small).collect()}
    assert got == {i: normalise(t) for i, t in texts.items()}


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_items_are_compared(spark, tmp_path):
    import __spark_entry__ as entry

    long = "one two three four five six seven eight nine ten "
    texts = {1: long + "eleven", 2: "xx" + long + "eleven", 3: "Äh " + long + "ﬁfty", 4: long + "z" * 40, 5: None, 6: "Äh " + long + "fifty"}
    spark.createDataFrame(list(texts.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    norm = {i: normalise(t) for i, t in texts.items()}
    pairs = [(i, j) for i in texts for j in texts if i < j]
    got = {(r["item_id"], r["other_id"]): r["similarity"] for r in entry.queries()["text_similarity_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(i, j): round(text.ratio(norm[i], norm[j]), 9) for i, j in pairs}
    assert got[1, 2] >= 86 and got[3, 6] == 100 and got[1, 4] < 86
    rows = {(r["item_id"], r["other_id"]): r for r in entry.queries()["text_prefilter_pairs"](spark, str(tmp_path)).collect()}
    assert {k: r["distance"] for k, r in rows.items()} == {(i, j): plain_distance(norm[i], norm[j]) for i, j in pairs}
    assert all(rows[k]["may_be_similar"] for k, v in got.items() if v >= 86) and not rows[1, 4]["may_be_similar"]


def test_all_given_items_are_compared(spark, small):
    import __spark_entry__ as entry

    n = spark.read.parquet(f"{small}/benchmark.parquet").count()
    assert entry.queries()["text_similarity_pairs"](spark, small).count() == n * (n - 1) // 2
    assert entry.queries()["text_prefilter_pairs"](spark, small).count() == n * (n - 1) // 2
