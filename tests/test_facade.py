import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import display
from tessera.sources import facade, samples


def test_bytes_path_and_request_agree(spark, tmp_path):
    photo = samples.all_samples()["gps.jpg"]
    (tmp_path / "a [1].jpg").write_bytes(photo)
    whole = json.loads(facade.extract(spark, photo, name="a.jpg").first().json)
    by_path = json.loads(facade.extract(spark, f"file://{tmp_path}", view="full").first().json)
    assert whole["input"]["path"] == "a.jpg" and by_path["normalized"] == whole["normalized"] and by_path["raw"] == whole["raw"]
    escaped = facade.object_path({"bucket": "b", "key": "a [1].jpg"})
    assert escaped == r"s3a://b/a \[1\].jpg"
    by_key = facade.extract(spark, f"file://{tmp_path}/" + escaped.rsplit("/", 1)[1], view="normalized").first()
    assert json.loads(by_key.json)["normalized"] == whole["normalized"]
    seen = json.loads(facade.probe(spark, photo, "a.jpg").first().json)
    assert seen["containers"] == whole["raw"]["containers"] and [i["code"] for i in seen["report"]["issues"]] == ["no_metadata_entries"]


def test_requests_and_views_that_do_not_exist(spark):
    assert facade.object_path({"path": "/x", "bucket": "b"}) == "/x"
    for request in ({}, {"bucket": "b"}, {"key": "k"}, {"path": "", "bucket": "", "key": "k"}):
        with pytest.raises(ValueError):
            facade.object_path(request)
    with pytest.raises(ValueError):
        facade.extract(spark, b"", "everything")


def test_contents_that_are_no_media_are_rows_of_the_table_function(spark):
    facade.register(spark)
    df = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"none")), (4, bytearray(b"\x89PNG\r\n\x1a\n"))], "id int, content binary")
    got = spark.sql("SELECT a.id, m.status, m.entries FROM {a} a, LATERAL decode_media(a.content) m", a=df).collect()
    assert {r.id: r.status for r in got} == {1: "io_error", 2: "unsupported_format", 3: "unsupported_format", 4: "ok"} and not any(r.entries for r in got)


@pytest.mark.parametrize(
    "raw,said",
    [("2024-01-02T03:04:05.25+02:00", "Jan 2, 2024 · 03:04:05.25 +02:00"), ("2024:12:31 23:59:59", "Dec 31, 2024 · 23:59:59"), ("2024-13-01T00:00:00", "2024-13-01T00:00:00"), ("noon", "noon"), ("2024-01-02 03:04:05", "2024-01-02 03:04:05")],
)
def test_moments(spark, raw, said):
    assert spark.range(1).select(display.moment(F.lit(raw)).alias("t")).first().t == said


def test_values_without_units_and_missing_ones(spark):
    from tessera.schemas import VALUE

    values = [("x", None, "—"), ("FNumber", ("rational", None, None, None, (0, 0), None, None, None), "f/0/0"), ("ExposureTime", ("rational", None, None, None, (10, 4), None, None, None), "10/4s"), ("audio sample rate", ("integer", None, 44100, None, None, None, None, None), "44,100 Hz"), ("x", ("bytes", None, None, None, None, None, bytearray(b"\1\2"), None), "[1,2]"), ("x", ("float", None, None, 0.5, None, None, None, None), "0.5")]
    df = spark.createDataFrame([(i, n, v) for i, (n, v, _) in enumerate(values)], f"i int, name string, v {VALUE}")
    got = {r.i: r.t for r in df.select("i", display.shown(F.col("name"), F.col("v")).alias("t")).collect()}
    assert got == {i: said for i, (_, _, said) in enumerate(values)}
