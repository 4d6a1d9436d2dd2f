import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import views
from tessera.sources import assets, samples
from tessera.sources.decode import decode

SAMPLES = samples.all_samples()


@pytest.fixture(scope="module")
def decoded(spark):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in SAMPLES.items()] + [("null", None)], "path string, content binary").repartition(3)
    return assets.decode_assets(assets.memory_assets(df)).cache()


@pytest.fixture(scope="module")
def fields(decoded):
    rows = views.normalize(assets.entries_of(decoded)).join(decoded.select("asset_id", "path"), "asset_id").collect()
    out = {}
    for r in rows:
        out.setdefault(r.path, {})[r.field] = r
    return out


def plain(row):
    v = row["value"]
    return {"string": v.s, "timestamp": v.s, "integer": v.i, "float": v.d, "rational": v.r and tuple(v.r), "coordinates": v.c and tuple(v.c)}[v.kind]


def test_formats_and_status(decoded):
    got = {r.path: (r.status, r.detected_format) for r in decoded.collect()}
    assert got["gps.jpg"] == ("ok", "jpeg") and got["big.tif"] == ("ok", "tiff") and got["mixed.png"] == ("ok", "png")
    assert [got[p][1] for p in ("both.webp", "still.heic", "clip.mp4", "clip.mov", "song.m4a", "song.flac", "song.aiff", "song.ogg", "song.opus")] == ["webp", "heif", "mp4", "mov", "m4a", "flac", "aiff", "ogg", "ogg"]
    assert got["raw.dng"] == ("ok", "dng")
    assert got["none.bin"] == ("unsupported_format", None) and got["badtiff.jpg"][0] == "parse_error" and got["null"][0] == "io_error"


def test_normalised_photo(fields):
    f = {k: plain(r) for k, r in fields["gps.jpg"].items()}
    assert f["captured_at"] == "2024-04-16T12:34:56" and f["exposure.iso"] == 200 and f["exposure.aperture"] == (56, 10)
    assert f["exposure.shutter_speed"] == (1, 250) and f["exposure.focal_length_mm"] == 50.0 and f["device.make"] == "SampleCam"
    assert f["location"] == pytest.approx((40.4462, -79.9821)) and (f["dimensions.width"], f["dimensions.height"]) == (800, 600)
    assert {k: plain(r) for k, r in fields["big.tif"].items()} == {k: v for k, v in f.items() if k != "location"}


def test_normalised_media(fields):
    f = {k: plain(r) for k, r in fields["clip.mp4"].items()}
    assert f["duration"] == 12.0 and f["video.framerate"] == pytest.approx(23.976, abs=1e-3) and f["video.bitrate"] == 24_000_000
    assert (f["codec.video"], f["codec.audio"], f["audio.channels"], f["audio.sample_rate"]) == ("avc1", "mp4a", 2, 48000)
    assert f["location"] == pytest.approx((40.7922, -73.9584)) and f["drone.flight.yaw_deg"] == 175.5 and f["device.model"] == "FC3682"
    assert f["created_at"] == "2024-04-16T12:34:56"
    f = {k: plain(r) for k, r in fields["song.opus"].items()}
    assert f == {"duration": 1.0, "codec.audio": "opus", "audio.channels": 2, "audio.sample_rate": 48000}
    f = {k: plain(r) for k, r in fields["song.ogg"].items()}
    assert f["duration"] == 1.0 and f["audio.bit_depth"] == 16
    assert {plain(fields[p]["audio.sample_rate"]) for p in ("song.flac", "song.aiff")} == {44100}
    f = {k: plain(r) for k, r in fields["still.heic"].items()}
    assert f["dimensions.width"] == 800 and f["device.model"] == "One"
    assert plain(fields["song.m4a"]["author"]) == "Kai"


def test_reconciliation_and_conflicts(decoded, fields):
    f = fields["rich.jpg"]
    assert plain(f["device.model"]) == "One" and plain(f["author"]) == "K & Co" and plain(f["headline"]) == "Head"
    assert plain(f["keywords"]) == "sea, sky, a, b" and plain(f["color.profile.name"]) == "Sample RGB"
    assert f["device.model"].notes == ["selected Model from exif over 1 competing candidate(s)"]
    c = views.conflicts(assets.entries_of(decoded)).join(decoded.select("asset_id", "path"), "asset_id").where("path = 'rich.jpg'").orderBy("ord").collect()
    assert [r.field for r in c] == ["captured_at", "device.model", "author", "dimensions.width"]
    assert c[1].message == "selected Model from exif over 1 competing candidate(s)" and [s["value"].s for s in c[1].sources] == ["One", "Two"]


def test_issues(decoded):
    got = {}
    for r in assets.issues_of(decoded).join(decoded.select("asset_id", "path"), "asset_id").orderBy("ord").collect():
        got.setdefault(r.path, []).append(r.code)
    assert got["broken.jpg"] == ["jpeg_segment_length_invalid", "no_metadata_entries"]
    assert got["noend.png"] == ["png_missing_iend", "no_metadata_entries"]
    probed = decode(SAMPLES["gps.jpg"], "jpeg", probe=True)
    assert [i["code"] for i in probed["issues"]] == ["no_metadata_entries"] and not probed["entries"] and len(probed["nodes"]) == 3


def test_envelopes(decoded, spark):
    for view in views.VIEWS:
        rows = views.to_json(views.analysis(decoded, view)).collect()
        assert len(rows) == len(SAMPLES) + 1
        for r in rows:
            doc = json.loads(r.json)
            assert set(doc) - {"status", "error_message", "schema_version", "input", "report"} == ({"raw", "interpreted", "normalized"} if view == "full" else {view} - {"report"})
            assert {"issues", "conflicts"} == set(doc["report"])
    docs = {d["input"].get("path"): d for d in (json.loads(r.json) for r in views.to_json(views.analysis(decoded)).collect())}
    photo = docs["gps.jpg"]
    assert photo["schema_version"] == "0.1.0" and "status" not in photo and docs["none.bin"]["status"] == "unsupported_format"
    by = {f["field"]: f for f in photo["normalized"]["fields"]}
    assert by["captured_at"]["confidence"] == 0.949999988079071 and by["captured_at"]["value"] == {"kind": "timestamp", "value": "2024-04-16T12:34:56"}
    assert by["exposure.aperture"]["value"] == {"kind": "rational", "value": {"numerator": 56, "denominator": 10}} and set(by["location"]["value"]["value"]) == {"latitude", "longitude"}
    assert by["device.make"]["sources"][0]["path"] == "ifd0" and "notes" not in by["device.make"]
    assert photo["raw"]["metadata"] == photo["interpreted"]["metadata"] and photo["raw"]["containers"][0]["label"] == "jpeg"
    assert [len(c["sources"]) for c in docs["rich.jpg"]["report"]["conflicts"]] == [2, 2, 2, 2]
    with pytest.raises(ValueError):
        views.analysis(decoded, "other")
    shallow = assets.decode_assets(assets.memory_assets(spark.createDataFrame([("x.jpg", bytearray(SAMPLES["gps.jpg"]))], "path string, content binary")), probe=True)
    assert [i["code"] for i in json.loads(views.probe(shallow).first().json)["report"]["issues"]] == ["no_metadata_entries"]
    assert views.capabilities(decoded).where("detected_format = 'm4a' and namespace = 'itunes'").count() == 1


@pytest.mark.parametrize("name", sorted(SAMPLES))
def test_decoding_never_raises(name, spark):
    rng = random.Random(name)
    fmt = {"jpg": "jpeg", "tif": "tiff", "dng": "dng", "heic": "heif", "opus": "ogg", "bin": "jpeg"}.get(name.split(".")[1], name.split(".")[1])
    b = SAMPLES[name]
    for k in range(150):
        x = bytearray(b[: rng.randint(0, len(b))] if k % 2 else b)
        for _ in range(rng.randint(0, 6) if x else 0):
            x[rng.randrange(len(x))] = rng.randrange(256)
        assert decode(bytes(x), fmt)["status"] in ("ok", "parse_error"), (name, k, decode(bytes(x), fmt)["error_message"])


def test_files_and_stream(spark, tmp_path):
    from tessera.streaming.ingest import ingest

    for k, v in SAMPLES.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / k).write_bytes(v)
    batch = assets.decode_assets(assets.read_assets(spark, str(tmp_path / "in"), "*.jpg"))
    assert batch.count() == 5 and batch.where("status = 'ok'").count() == 4
    ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "normalized").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).where(F.size("normalized.fields") > 0).count() >= 12
