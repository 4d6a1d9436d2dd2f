import struct
import zlib

from tessera.operators import views
from tessera.sources import assets, samples
from tessera.sources.decode import decode


def decode_all(spark, files):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    return {r.path: r for r in assets.decode_assets(assets.memory_assets(df)).collect()}


MOVIE = samples.movie()[20:]  # without ftyp
BRANDS = {"heif": [b"heim", b"heis", b"avif", b"avis"], "m4a": [b"M4P "], "mp4": [b"M4V ", b"3gp4", b"3gp5", b"3g2a"]}


def branded(major, *others, pad=0):
    d = major + b"\0\0\0\0" + b"none" * pad + b"".join(others)
    return samples.box(b"ftyp", d) + MOVIE


def test_brands_of_each_family(spark):
    files = {f"{f} {b.decode()}": branded(b, b) for f, brands in BRANDS.items() for b in brands}
    files |= {f"{f} {b.decode()} compatible": branded(b"none", b) for f in ("heif", "mp4") for b in BRANDS[f]}
    files |= {"heif far": branded(b"none", b"avif", pad=2000), "mp4 far": branded(b"none", b"3gp4", pad=2000)}
    files["None outside"] = samples.box(b"ftyp", b"none\0\0\0\0") + b"isomfree"
    files["None size"] = b"\xff\xff\xff\xffftypnone\0\0\0\0none"
    files["None short"] = b"\0\0\0\x14ftyp"
    files["mp4 large"] = struct.pack(">I4sQ", 1, b"ftyp", 28) + b"none\0\0\0\0isom" + MOVIE
    got = decode_all(spark, files)
    assert {k: str(r.detected_format) for k, r in got.items()} == {k: k.split()[0] for k in files}
    assert all(r.status == "ok" and r.entries for k, r in got.items() if not k.startswith("None"))
    # The reference detects these as MP4, but its parser does not list them among supported brands.
    odd = {k for k, r in got.items() if any(i.code == "isobmff_unrecognized_brand" for i in r.issues)}
    assert odd == {k for k in files if k[:3] == "mp4" and k != "mp4 large"}


IIM = samples.iptc((105, "Head"), (80, "Kai"), (25, "sea"))
TAGS = ["Headline", "Author", "Keywords"]


def heif_items(*items, boxes=b""):
    """Items (kind, content type or None, bytes) in mdat before meta."""
    ftyp, at = samples.box(b"ftyp", b"heic\0\0\0\0mif1"), 24 + 4
    infe, iloc = b"", b""
    for k, (kind, mime, d) in enumerate(items, 1):
        infe += samples.box(b"infe", b"\2\0\0\0", struct.pack(">HH", k, 0), kind + b"name\0" + (mime + b"\0" if mime else b""))
        iloc += struct.pack(">HHHII", k, 0, 1, at, len(d))
        at += len(d)
    meta = samples.box(b"meta", b"\0" * 4, samples.box(b"iinf", struct.pack(">IH", 0, len(items)), infe), samples.box(b"iloc", struct.pack(">IBBH", 0, 0x44, 0, len(items)), iloc), boxes)
    return ftyp + samples.box(b"mdat", *(d for *_, d in items)) + meta


def tags(row, namespace):
    return [e["tag_name"] for e in row["entries"] if e["namespace"] == namespace]


def test_iptc_items():
    for item in ((b"iptc", None, IIM), (b"mime", b"application/x-iptc", IIM)):
        row = decode(heif_items(item), "heif")
        assert tags(row, "iptc") == TAGS and row["entries"][0]["provenance"]["path"] == "heif_iptc" and not row["issues"]
    assert [i["code"] for i in decode(heif_items((b"iptc", None, b"none")), "heif")["issues"]] == ["iptc_decode_empty", "no_metadata_entries"]


def test_xmp_items_and_boxes():
    doc = samples.xmp(model="Two")
    for mime in (b"application/rdf+xml", b"application/xml", b"text/xml"):
        assert tags(decode(heif_items((b"mime", mime, doc)), "heif"), "xmp") == ["Model", "Author"]
        row = decode(heif_items(boxes=samples.box(b"mime", mime + b"\0" + doc)), "heif")
        assert tags(row, "xmp") == ["Model", "Author"] and not row["issues"]
    for d in (b"text/plain\0" + doc, b"text/xml\0", b"text/xml", b""):
        assert decode(heif_items(boxes=samples.box(b"mime", d)), "heif")["issues"][0]["code"] == "isobmff_mime_payload_unsupported"


def test_png_iptc_naa():
    for chunk in ((b"tEXt", b"IPTC-NAA\0" + IIM), (b"zTXt", b"IPTC-NAA\0\0" + zlib.compress(IIM)), (b"iTXt", b"IPTC-NAA\0\0\0\0\0" + IIM)):
        assert tags(decode(samples.png(chunk), "png"), "iptc") == TAGS


RTMD = b"""<?xml version="1.0" encoding="UTF-8"?>
<NonRealTimeMeta lastUpdate="2026-04-16T06:34:34-08:00">
  <CreationDate value="2026-04-16T06:34:34-08:00"/>
  <VideoFormat>
    <VideoFrame videoCodec="AVC_3840_2160_HP@L51" captureFps="23.98p" formatFps="23.98p"/>
    <VideoLayout pixel="3840" numOfVerticalLine="2160" aspectRatio="16:9"/>
  </VideoFormat>
  <AudioFormat numOfChannel="2"><AudioRecPort port="DIRECT" audioCodec="LPCM16"/></AudioFormat>
  <Device manufacturer="Sony" modelName="ZV-E10"/>
  <RecordingMode type="normal"/>
  <AcquisitionRecord><Group name="CameraUnitMetadataSet"><Item name="Other" value="x"/><Item value="rec709-xvycc" name="CaptureGammaEquation"/></Group></AcquisitionRecord>
</NonRealTimeMeta>"""
#: The entries of the reference's real-camera snapshot: tag, kind, value, end of the note.
SNAPSHOT = [
    ("MetadataDate", "timestamp", "2026-04-16T06:34:34-08:00", "lastUpdate"), ("CreateDate", "timestamp", "2026-04-16T06:34:34-08:00", "CreationDate"),
    ("Make", "string", "Sony", "Device manufacturer"), ("Model", "string", "ZV-E10", "Device modelName"),
    ("CaptureFps", "string", "23.98p", "VideoFrame captureFps"), ("FormatFps", "string", "23.98p", "VideoFrame formatFps"), ("VideoCodecProfile", "string", "AVC_3840_2160_HP@L51", "VideoFrame videoCodec"),
    ("ImageWidth", "integer", 3840, "VideoLayout pixel"), ("ImageHeight", "integer", 2160, "VideoLayout numOfVerticalLine"), ("AspectRatio", "string", "16:9", "VideoLayout aspectRatio"),
    ("AudioChannels", "integer", 2, "AudioFormat numOfChannel"), ("AudioCodecName", "string", "LPCM16", "AudioRecPort audioCodec"), ("RecordingMode", "string", "normal", "RecordingMode type"),
    ("CaptureGammaEquation", "string", "rec709-xvycc", "AcquisitionRecord item"),
]


def test_rtmd_equals_snapshot():
    row = decode(samples.movie() + samples.box(b"meta", b"\0" * 4, samples.box(b"xml ", b"\0" * 4 + RTMD)), "mp4")
    got = [e for e in row["entries"] if e["namespace"] == "rtmd"]
    assert [(e["tag_name"], e["value"]["kind"], e["value"].get("s", e["value"].get("i")), *e["notes"]) for e in got] == [(*x[:3], "decoded from NonRealTimeMeta " + x[3]) for x in SNAPSHOT]
    assert {e["provenance"]["path"] for e in got} == {"non_real_time_meta"} and not tags(row, "xmp")


def test_large_files_are_read_by_path(spark, tmp_path):
    for k, v in samples.all_samples().items():
        (tmp_path / k.replace(".", " large.")).write_bytes(v)
    whole, ranged = ({r.path: r for r in assets.decode_assets(assets.read_assets(spark, str(tmp_path), max_bytes=n)).collect()} for n in (1 << 30, 10))
    assert len(whole) == len(samples.all_samples()) and whole == ranged
    only = assets.decode_assets(assets.read_assets(spark, str(tmp_path), max_bytes=10), formats=["mp4"]).collect()
    assert [r.path.rsplit("/")[-1] for r in only] == ["clip large.mp4"]
    ftyp, moov = samples.movie()[:20], samples.movie()[20:]
    with open(tmp_path / "huge.mov", "wb") as f:  # sparse, beyond what a binary column holds
        f.write(ftyp + struct.pack(">I4sQ", 1, b"mdat", 3 << 30))
        f.seek(20 + (3 << 30))
        f.write(moov)
    row = assets.decode_assets(assets.read_assets(spark, str(tmp_path), "huge.mov")).first()
    assert row.status == "ok" and row.detected_format == "mp4" and row.size_bytes > 3 << 30
    assert {e.tag_name for e in row.entries} == {e["tag_name"] for e in decode(samples.movie(), "mp4")["entries"]}
    (tmp_path / "huge.mov").unlink()
    gone = spark.createDataFrame([(1, str(tmp_path / "huge.mov"), 5, None)], "asset_id long, path string, size_bytes long, content binary")
    assert assets.decode_assets(gone).first().status == "io_error"


def test_dng_is_told_in_the_jvm(spark):
    files = {k: v for k, v in samples.all_samples().items() if k in ("raw.dng", "big.tif", "gps.jpg")}
    files |= {"cut.tif": b"II*\0\x08\0\0\0\xff\xff", "far.tif": b"MM\0*\xff\xff\xff\xff", "short.tif": b"II*\0", "big.dng": samples.tiff([(0xC612, 1, 4, b"\1\4\0\0")], order=">")}
    df = assets.memory_assets(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary"))
    told = df.select("path", assets.detect_format(df["content"]).alias("f")).collect()
    assert {r.path: r.f for r in told} == {k: {"jpg": "jpeg", "tif": "tiff", "dng": "dng"}[k[-3:]] for k in files}
    only = assets.decode_assets(df, formats=["dng"]).collect()
    assert {(r.path, r.detected_format, r.status) for r in only} == {("raw.dng", "dng", "ok"), ("big.dng", "dng", "ok")}


def test_whole_streams_boxes_and_packets():
    icc = samples.icc("N" * 60) + bytes(65 << 20)
    row = decode(samples.png((b"iCCP", b"p\0\0" + zlib.compress(icc))), "png")
    assert "ProfileDescription" in tags(row, "icc")
    cut = decode(samples.png((b"iCCP", b"p\0\0" + zlib.compress(samples.icc())[:-9])), "png")
    assert not tags(cut, "icc")
    far = samples.box(b"uuid", b"\0" * 16, b" " * 9000, samples.xmp(model="Two"))
    assert "Model" in tags(decode(samples.movie() + far, "mp4"), "xmp")
    deep = samples.movie()[20:]
    for _ in range(60):
        deep = samples.box(b"moov", deep)
    assert "DurationSeconds" in tags(decode(samples.movie()[:20] + deep, "mp4"), "quicktime")
    for _ in range(200):
        deep = samples.box(b"moov", deep)
    assert "isobmff_nesting_too_deep" in [i["code"] for i in decode(samples.movie()[:20] + deep, "mp4")["issues"]]


def test_directories_are_read_exif_before_gps():
    b = bytearray(samples.camera_tiff(gps=True))
    n = int.from_bytes(b[8:10], "little")
    slots = [10 + 12 * k for k in range(n)]
    x, y = (next(s for s in slots if b[s : s + 2] == t) for t in (b"\x69\x87", b"\x25\x88"))
    b[x : x + 12], b[y : y + 12] = b[y : y + 12], b[x : x + 12]
    rest = [[e["tag_name"] for e in decode(x, "tiff")["entries"] if e["tag_name"] not in ("GPSInfo", "ExifOffset")] for x in (bytes(b), samples.camera_tiff(gps=True))]
    assert rest[0] == rest[1] and "GPSLatitude" in rest[0]


def test_rates_of_unlisted_codecs_are_not_read():
    row = decode(samples.movie().replace(b"mp4a", b"abcd"), "mp4")
    assert "AudioSampleRate" not in tags(row, "quicktime") and "AudioCodec" in tags(row, "quicktime")


def test_an_asset_is_decoded_once_without_shuffles(spark, tmp_path):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in samples.all_samples().items()], "path string, content binary")
    for view in views.VIEWS:
        plan = views.to_json(views.analysis(assets.decode_assets(assets.memory_assets(df)), view))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan
