import plistlib
import random
import struct

from tessera.sources import samples
from tessera.sources.decode import decode, makernotes


def photo(make: str, note) -> dict:
    """Decode a JPEG whose EXIF directory holds note(where it lies in the TIFF data)."""
    build = lambda n: samples.tiff([samples.text(0x010F, make)], [(0x927C, 7, len(n), n)])
    size = len(note(0))
    at = build(b"\xaa" * size).index(b"\xaa" * size)
    out = decode(samples.jpeg(samples.exif_app1(build(note(at)))), "jpeg")
    return {e["tag_name"]: e["value"].get("s", e["value"].get("i", e["value"].get("d"))) for e in out["entries"] if e["namespace"] == make.lower()}


def directory(entries, base: int, head: bytes) -> bytes:
    at, body, extra = base + len(head) + 2 + 12 * len(entries), b"", b""
    for tag, kind, count, raw in entries:
        if len(raw) > 4:
            body += struct.pack("<HHII", tag, kind, count, at + len(extra))
            extra += raw
        else:
            body += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return head + struct.pack("<H", len(entries)) + body + extra


def test_apple():
    run = plistlib.dumps({"flags": 3, "value": 12345, "epoch": 0, "timescale": 1000000000}, fmt=plistlib.FMT_BINARY)
    i = struct.Struct("<i").pack
    entries = [(1, 9, 1, i(14)), (3, 7, len(run), run), (4, 9, 1, i(1)), (7, 9, 1, i(0)), (8, 10, 3, struct.pack("<6i", 1, 2, -1, 4, 3, 1)), (0x14, 9, 1, i(10)), (0x21, 10, 1, struct.pack("<2i", 3, 2)), (0x23, 9, 2, struct.pack("<2i", 7, (2 << 28) | 9)), (0x2B, 2, 5, b"A-B\0\0"), (0x2E, 9, 1, i(6)), (0x2D, 9, 1, i(5000))]
    got = photo("Apple", lambda at: directory(entries, 0, makernotes.APPLE_HEAD + b"\0\1" + b"II"))
    assert got == {"MakerNoteVersion": 14, "RunTimeFlags": "Valid, Has been rounded", "RunTimeValue": 12345, "RunTimeEpoch": 0, "RunTimeScale": 1000000000, "AEStable": "Yes", "AFStable": "No", "AccelerationVector": "0.50000000000 -0.2500000000 3.0000000000", "ImageCaptureType": "Photo", "HDRHeadroom": 1.5, "AFPerformance": "7 2 9", "PhotoIdentifier": "A-B", "CameraType": "Front", "ColorTemperature": 5000}


def test_decipher_table_is_a_permutation():
    t = makernotes.decipher_table()
    assert sorted(t) == list(range(256)) and all(t[b**3 % 249] == b for b in range(249)) and t[249:] == bytes(range(249, 256))


def enciphered(size: int, **at) -> bytes:
    t = bytearray(size)
    for k, v in at.items():
        k = int(k[1:], 16)
        t[k : k + len(v)] = v
    back = bytearray(256)
    for i, x in enumerate(makernotes.decipher_table()):
        back[x] = i
    return bytes(t).translate(bytes(back))


def test_sony():
    h = struct.Struct("<H").pack
    t9405 = enciphered(0x100, x4=h(14 * 256), xa=h(12 * 256), xe=h(16 * 256 + 2048), x10=struct.pack("<HH", 1, 250), x16=h(22 * 256), x48=b"\7", x52=b"\xff", x60=h(32793))
    t9402 = enciphered(0x30, x2=b"\xff", x4=b"\xfb", x16=b"\x82", x17=b"\x0c", x2d=b"\x21")
    entries = [
        (0x0104, 10, 1, struct.pack("<2i", 3, 10)), (0x2002, 4, 1, struct.pack("<I", 5)), (0x2009, 3, 1, h(256)), (0x200A, 4, 1, struct.pack("<I", 0x10011)), (0x201B, 1, 1, b"\2"), (0x2028, 3, 2, h(0) * 2), (0x202A, 7, 14, b"\0\2" + struct.pack("<6H", 640, 480, 1, 2, 3, 4)),
        (0xB000, 1, 4, bytes([3, 0, 1, 2])), (0xB027, 4, 1, struct.pack("<I", 0xFFFF)), (0xB02A, 7, 8, bytes.fromhex("8300160050355600")), (0xB02B, 4, 2, struct.pack("<II", 4000, 6000)), (0xB041, 3, 1, h(6)), (0x9402, 7, len(t9402), t9402), (0x9405, 7, len(t9405), t9405),
    ]
    got = photo("SONY", lambda at: directory(entries, at, makernotes.SONY_HEAD))
    want = {"FlashExposureComp": "3", "Rating": 5, "HighISONoiseReduction": "Auto", "HDR": "1.5 EV; HDR image (good)", "FocusMode": "AF-S", "VariableLowPassFilter": "n/a", "FileFormat": "ARW 4.3.1", "LensType": "E-Mount, T-Mount, Other Lens or no lens", "LensSpec": "E 16-50mm F3.5-5.6 OSS", "FullImageSize": "6000x4000", "ExposureMode": "Auto"}
    want |= {"FocalPlaneAFPointsUsed": 2, "FocalPlaneAFPointArea": "640 480", "FocalPlaneAFPointLocation1": "1 2", "FocalPlaneAFPointLocation2": "3 4", "AmbientTemperature": "-5 C", "AFAreaMode": "Expanded Flexible Spot", "FocusPosition2": 33}
    want |= {"SonyISO": 400, "StopsAboveBaseISO": 4.0, "SonyExposureTime2": "1/256", "ExposureTime": "1/250", "SonyMaxApertureValue": "8.0", "ExposureProgram": "Aperture-priority AE", "Sharpness": -1, "LensType2": "Sony E PZ 16-50mm F3.5-5.6 OSS"}
    assert {k: got.get(k) for k in want} == want
    assert "DistortionCorrParams" in got and "LensZoomPosition" not in got


def test_broken_notes_never_raise():
    rng = random.Random(1)
    for make, head in (("Apple", makernotes.APPLE_HEAD + b"\0\1II"), ("SONY", makernotes.SONY_HEAD)):
        for _ in range(200):
            tags = [rng.choice([*makernotes.SONY_PLAIN, *makernotes.SONY_TABLES, *makernotes.APPLE_FIELDS, 3, 0x202A, 0x9401]) for _ in range(8)]
            entries = [(t, rng.choice([1, 2, 3, 4, 7, 8, 9, 10, 99]), rng.randint(0, 9), rng.randbytes(rng.randint(0, 40))) for t in tags]
            photo(make, lambda at: directory(entries, 0 if make == "Apple" else at, head))  # noqa: B023
