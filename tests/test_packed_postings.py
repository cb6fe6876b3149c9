"""An index packs a word's postings of neighbouring documents into a row, and tells a document's columns once."""

from pyspark.sql import functions as F

from siltstone.operators import inverted as V

PAGE = "doc long, version int, title string, body string, machine boolean, deleted boolean"


def held(spark, index, segment):
    rows = spark.read.parquet(f"{index.path}/{segment}/postings").where("term <> ''")
    return rows, rows.select("term", F.inline("postings"))


def test_a_row_holds_a_words_documents(spark, tmp_path):
    index = V.Index(str(tmp_path / "index"), buckets=4)
    V.apply(index, spark.createDataFrame([(i, 0, "red", f"red blue w{i}", i % 2 == 0, False) for i in range(40)], PAGE).coalesce(1), "a")
    rows, postings = held(spark, index, V.manifest(spark, index)[0]["segment"])
    assert {(r.term, r.n) for r in rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("term IN ('red', 'blue')").collect()} == {("red", 1), ("blue", 1)}
    assert postings.count() == 120 and set(postings.columns) == {"term", "doc", "title", "body"}
    red = V.postings(spark, index, [("red", False)], ("words", "machine")).collect()
    assert sorted((r.doc, r.title, r.body, r.words, r.machine) for r in red) == [(i, [0], [0], 7.0, i % 2 == 0) for i in range(40)]


def test_compaction_leaves_nothing_of_what_is_gone_inside_a_row(spark, tmp_path):
    index = V.Index(str(tmp_path / "index"), buckets=4)
    V.apply(index, spark.createDataFrame([(i, 0, None, "red blue", False, False) for i in range(9)] + [(None, 0, None, "red", False, False)], PAGE).coalesce(1), "a")
    V.apply(index, spark.createDataFrame([(4, 1, None, None, False, True), (5, 1, None, "green", True, False)], PAGE), "b")
    rows, postings = held(spark, index, V.compacted(spark, index))
    want = {("red", i) for i in (None, 0, 1, 2, 3, 6, 7, 8)} | {("blue", i) for i in (0, 1, 2, 3, 6, 7, 8)} | {("green", 5)}
    assert {(r.term, r.doc) for r in postings.collect()} == want and rows.count() < len(want)
    assert {(r.doc, r.machine) for r in V.postings(spark, index, [("red", False), ("green", False)], ("machine",)).collect()} == {(i, i == 5) for i in (None, 0, 1, 2, 3, 5, 6, 7, 8)}


def test_words_are_found_alike_in_either_way():
    for text in ("naïve Ａ日本 éa x_y", "𝒳y 𐍈z é", "٣٤ ²½ à", " a‍b ﬁ"):
        assert V._found(text) == V._WORD.findall(text)
