"""Callers' own code, other kinds of tables, refusals, and saved contents."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from wordloom.functions import text
from wordloom.operators import hooks, order
from wordloom.sources import records, settings, sinks


def test_filter_of_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (None, "a")], "id long, name string")
    assert sorted(r["name"] for r in hooks.keep_records(df, lambda b: pc.equal(b.column("name"), "a")).collect()) == ["a", "a"]
    assert hooks.keep_records(df.limit(0), lambda b: pc.equal(b.column("name"), "a")).columns == ["id", "name"]


def test_merge_with_ranks(spark):
    sets = [spark.createDataFrame(rows, "id long, by int") for rows in ([(5, 9), (6, 1), (7, 1)], [(7, 3)], [])]

    def compute(batch: pa.RecordBatch):
        assert batch.schema.names == ["id", "rank0", "rank1", "rank2", "match0", "match1", "match2"]
        return [pc.coalesce(batch.column("rank0"), pa.scalar(-1, pa.int64())), batch.column("match1")]

    got = {r["id"]: (r["first"], r["second"]) for r in hooks.merge_with(sets, "by", compute, "first long, second boolean").collect()}
    assert got == {5: (2, False), 6: (0, False), 7: (1, True)}


def test_blobs_of_any_size(spark):
    big = b"x" * (hooks.HELD + 5)
    df = spark.createDataFrame([(1, b"ab"), (2, None), (3, b""), (4, big), (5, b"z")], "id long, data binary")
    got = {r["id"]: None if r["data"] is None else bytes(r["data"]) for r in hooks.change_blobs(df, "data", lambda b: b[::-1]).collect()}
    assert got == {1: b"ba", 2: None, 3: b"", 4: big, 5: b"z"}


def test_settings_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ini").write_text("k = 1 // one\n[ S ]\n x= y=z\nbad\n//x=1\n[T\nempty=\n", encoding="utf-8")
    (tmp_path / "sub" / "b.ini").write_text("[S]\r\nx=é\r\n", encoding="utf-8")
    (tmp_path / "_done").write_text("no=1")
    df = records.open_table(spark, f"settings:{tmp_path}")
    assert sorted(tuple(r) for r in df.collect()) == [("a.ini", 1, "", "k", "1"), ("a.ini", 3, "S", "x", "y=z"), ("a.ini", 7, "T", "empty", ""), ("b.ini", 2, "S", "x", "é")]
    assert df.rdd.getNumPartitions() == 2
    one = spark.read.format("settings").load(f"file://{tmp_path}/sub/b.ini")
    assert [tuple(r) for r in one.collect()] == [("b.ini", 2, "S", "x", "é")]
    assert list(settings.pairs(["a==b", "=x", "[", "c=d"])) == [(1, "", "a", "=b"), (2, "", "", "x"), (4, "", "c", "d")]


def test_kinds(spark):
    records.add_kind("numbers", lambda session, name, base: session.range(int(name)))
    assert records.open_table(spark, "numbers:3").count() == 3
    with pytest.raises(ValueError):
        records.add_kind("native", lambda *a: None)
    del records.KINDS["numbers"]
    with pytest.raises(ValueError):
        records.open_table(spark, "numbers:3")


def test_refusals(spark):
    df = spark.range(5).withColumnRenamed("id", "rid")
    assert records.point_read(df, "rid", 4, must_exist=True).count() == 1
    with pytest.raises(LookupError):
        records.point_read(df, "rid", 5, must_exist=True)
    assert order.slice_rows(df, "rid", 3, 2, within=5).count() == 2
    for start, count in ((3, 3), (-1, 2), (0, -1)):
        with pytest.raises(IndexError):
            order.slice_rows(df, "rid", start, count, within=5)
    assert records.fields(df.withColumn("x", F.array(F.lit("a")))) == [(0, "rid", "bigint"), (1, "x", "array<string>")]


def test_saved_contents(spark, tmp_path):
    df = spark.createDataFrame([("<a>\n<b/></a>", None)], "xml string, html string")
    sinks.save_content(df, str(tmp_path))
    assert [r[0] for r in spark.read.text(f"{tmp_path}/content.xml").collect()] == ["<a> <b/></a>"]
    assert [r[0] for r in spark.read.text(f"{tmp_path}/content.html").collect()] == [""]


def test_bytes_and_points(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(text.decoded(F.lit(b"a\xffb"))) == "a�b" and one(text.decoded(F.lit("é".encode()), strict=True)) == "é"
    with pytest.raises(Exception, match="UTF"):
        one(text.decoded(F.lit(b"\xc3"), strict=True))
    for s in ("", "aé😀\n", "\u0000x"):
        points = one(text.points_of(F.lit(s)))
        assert points == [ord(c) for c in s] and one(text.from_points(F.array(*map(F.lit, points)) if points else F.array().cast("array<int>"))) == s
