"""Maker notes of two camera makers: fields as data, read by a few small readers. A value that is too short is left out."""

from __future__ import annotations

import plistlib
from functools import cache

from .base import Out, integer, number, sint, stamp, text, uint
from .namespaces import SIZES, Tiff


def c_string(b: bytes) -> str:
    return b.split(b"\0")[0].decode("utf-8", "replace").strip()


def plain_number(v: float) -> str:
    return f"{v:.0f}" if v == int(v) else f"{v:.1f}"


def maker_note(out: Out, tiff: Tiff) -> bytes | None:
    return next((v for _, tag, _, _, v, _, _ in tiff.slots if tag == 0x927C and v is not None), None)


def _put(out: Out, ns: str, path: str, tag: int, name: str, value) -> None:
    """value: text, int, float, or a tagged value."""
    if value is not None:
        kind = text if isinstance(value, str) else integer if isinstance(value, int) else number if isinstance(value, float) else dict
        out.entry(ns, f"0x{tag:04X}", name, kind(value), path)


def _slots(b: bytes, at: int, order: str):
    """(tag, type, count, raw 4 bytes, offset) of a directory."""
    for k in range(uint(b, at, 2, order) or 0):
        s = at + 2 + 12 * k
        if s + 12 > len(b):
            return
        yield uint(b, s, 2, order), uint(b, s + 2, 2, order), uint(b, s + 4, 4, order), b[s + 8 : s + 12], uint(b, s + 8, 4, order)


# --- Apple --------------------------------------------------------------------------------------

APPLE_HEAD = b"Apple iOS\0"
# Labels of codes.
CAPTURE_TYPES = {1: "ProRAW", 2: "Portrait", 10: "Photo", 11: "Manual Focus", 12: "Scene"}
CAMERA_TYPES = {0: "Back Wide Angle", 1: "Back Normal", 6: "Front"}
RUN_FLAGS = {1: "Valid", 2: "Has been rounded", 4: "Positive infinity", 8: "Negative infinity", 16: "Indefinite"}
# Fixed values: (tag, name, how it is read).
APPLE_FIELDS = {
    0x0001: ("MakerNoteVersion", "int"), 0x0004: ("AEStable", "yes"), 0x0005: ("AETarget", "int"), 0x0006: ("AEAverage", "int"), 0x0007: ("AFStable", "yes"), 0x0008: ("AccelerationVector", "vector"), 0x0014: ("ImageCaptureType", "capture"), 0x0017: ("LivePhotoVideoIndex", "long"),
    0x001F: ("PhotosAppFeatureFlags", "int"), 0x0021: ("HDRHeadroom", "ratio"), 0x0023: ("AFPerformance", "performance"), 0x0027: ("SignalToNoiseRatio", "ratio"), 0x002B: ("PhotoIdentifier", "text"), 0x002D: ("ColorTemperature", "int"), 0x002E: ("CameraType", "camera"), 0x002F: ("FocusPosition", "int"),
    0x0030: ("HDRGain", "ratio"), 0x0038: ("AFMeasuredDepth", "int"), 0x003D: ("AFConfidence", "int"),
}


def _apple_value(how: str, b: bytes, order: str):
    def ratio(at):
        n, d = sint(b, at, 4, order), sint(b, at + 4, 4, order)
        return n / d if d else None

    i = sint(b, 0, 4, order)
    if how == "text":
        return c_string(b)
    if how == "ratio":
        return ratio(0)
    if how == "vector":
        v = [ratio(k) for k in (0, 8, 16)]
        return None if None in v else f"{v[0]:.11f} {v[1]:.10f} {v[2]:.10f}"
    if how == "long":
        return sint(b, 0, 8, order)
    if how == "performance":
        j = sint(b, 4, 4, order)
        return None if j is None else f"{i} {j >> 28} {j & 0x0FFFFFFF}"
    if i is None:
        return None
    return {"int": i, "yes": "Yes" if i else "No", "capture": CAPTURE_TYPES.get(i, str(i)), "camera": CAMERA_TYPES.get(i, str(i))}[how]


def apple(out: Out, tiff: Tiff) -> None:
    note = maker_note(out, tiff)
    if not note or not note.startswith(APPLE_HEAD):
        return
    at = len(APPLE_HEAD) + 2
    order = {b"II": "little", b"MM": "big"}.get(note[at : at + 2])
    if not order:
        return
    for tag, kind, count, packed, where in _slots(note, at + 2, order):
        unit = SIZES.get(kind, 8 if kind == 16 else 0)
        size = unit * count
        b = packed[:size] if size <= 4 else note[where : where + size] if where >= at else b""
        if not unit or len(b) < size:
            continue
        if tag == 0x0003:
            try:
                run = plistlib.loads(b)
            except Exception:  # any malformed list counts as absent
                continue
            if not isinstance(run, dict):
                continue
            whole = lambda k: run[k] if type(run.get(k)) is int else None  # noqa: B023, E731
            flags = whole("flags")
            if flags is not None:
                _put(out, "apple", "apple_runtime", tag, "RunTimeFlags", ", ".join(s for bit, s in RUN_FLAGS.items() if flags & bit) or str(flags))
            for name, key in (("RunTimeValue", "value"), ("RunTimeEpoch", "epoch"), ("RunTimeScale", "timescale")):
                _put(out, "apple", "apple_runtime", tag, name, whole(key))
        elif tag in APPLE_FIELDS:
            name, how = APPLE_FIELDS[tag]
            _put(out, "apple", "apple_makernote", tag, name, _apple_value(how, b, order))


# --- Sony ---------------------------------------------------------------------------------------

SONY_HEAD = b"SONY DSC \0\0\0"

# Labels of codes by kind; other codes are told as decimals.
LABELS = {
    "long_exposure": {0: "Off", 1: "On (unused)", 0x10001: "On (dark subtracted)"},
    "high_iso": {0: "Off", 1: "Low", 2: "Normal", 3: "High", 256: "Auto"},
    "scene": {16: "Auto"},
    "zone": {0: "ISO Setting Used"},
    "dro": {0: "Off", 1: "Standard", 2: "Advanced Auto", 3: "Auto"},
    "off_on": {0: "Off", 1: "On"},
    "standard": {0: "Standard"},
    "off": {0: "Off"},
    "normal": {0: "Normal"},
    "auto": {0: "Auto"},
    "quality": {0: "RAW", 1: "Super Fine", 2: "Fine", 3: "Standard", 4: "Economy", 5: "Extra Fine", 6: "RAW + JPEG/HEIF", 7: "Compressed RAW", 8: "Compressed RAW + JPEG", 9: "Light"},
    "white_balance": {0: "Auto", 1: "Color Temperature/Color Filter", 0x10: "Daylight", 0x20: "Cloudy", 0x30: "Shade", 0x40: "Tungsten", 0x50: "Flash", 0x60: "Fluorescent", 0x70: "Custom", 0x80: "Underwater"},
    "soft_skin": {0: "Off", 1: "Low", 2: "Mid", 3: "High"},
    "correction": {0: "Off", 2: "Auto"},
    "flash_action": {0: "Did not fire", 1: "Flash Fired", 2: "External Flash Fired", 3: "Wireless Controlled Flash Fired"},
    "focus": {0: "Manual", 2: "AF-S", 3: "AF-C", 4: "AF-A", 6: "DMF", 7: "AF-D"},
    "af_area_setting": {0: "Wide", 1: "Center", 3: "Flexible Spot", 4: "Flexible Spot (LA-EA4)", 8: "Zone", 9: "Center (LA-EA4)", 11: "Zone", 12: "Expanded Flexible Spot", 13: "Custom AF Area"},
    "af_point": {0: "n/a", 1: "Center", 2: "Top", 3: "Upper-right", 4: "Right", 5: "Lower-right", 6: "Bottom", 7: "Lower-left", 8: "Left", 9: "Upper-left"},
    "metering2": {256: "Multi-segment"},
    "raw_type": {0: "Compressed RAW"},
    "exposure_mode": {6: "Auto"},
    "release": {2: "Continuous"},
    "quality2": {0: "JPEG", 1: "RAW", 2: "RAW + JPEG", 3: "JPEG + MPO", 4: "HEIF", 6: "RAW + HEIF"},
    "af_area": {0: "Multi", 1: "Center", 2: "Spot", 3: "Flexible Spot", 10: "Selective (for Miniature effect)", 11: "Zone", 12: "Expanded Flexible Spot", 13: "Custom AF Area", 14: "Tracking", 15: "Face Tracking", 20: "Animal Eye Tracking", 21: "Human Eye Tracking", 255: "Manual"},
    "distortion": {0: "None", 1: "Applied"},
    "distortion_number": {11: "11 (APS-C)", 16: "16 (Full-frame)"},
    "mount2": {0: "Unknown", 1: "A-mount (1)", 4: "E-mount", 5: "A-mount (5)"},
    "mount": {0: "Unknown", 1: "A-mount", 2: "E-mount", 3: "A-mount (3)"},
    "lens_format": {0: "Unknown", 1: "APS-C", 2: "Full-frame"},
    "lens2": {32793: "Sony E PZ 16-50mm F3.5-5.6 OSS"},
    "lens": {0xFFFF: "E-Mount, T-Mount, Other Lens or no lens"},
    "flash_status": {0: "No Flash present", 2: "Flash Inhibited", 64: "Built-in Flash present", 65: "Built-in Flash Fired", 66: "Built-in Flash Inhibited", 128: "External Flash present", 129: "External Flash Fired"},
    "flash_mode": {0: "Autoflash", 1: "Fill-flash", 2: "Flash Off", 3: "Slow Sync", 4: "Rear Sync", 6: "Wireless"},
    "self_timer": {0: "Off", 1: "Self-timer 5 or 10 s", 2: "Self-timer 2 s"},
    "orientation": {1: "Horizontal (normal)", 3: "Rotate 180", 6: "Rotate 90 CW", 8: "Rotate 270 CW"},
    "sequence": {0: "Continuous", 1: "1 shot", **{n: f"{n} shots" for n in (2, 3, 4, 5, 6, 7, 9, 10, 12, 16)}, 100: "Continuous - iSweep Panorama", 200: "Continuous - Sweep Panorama"},
    "hdr": {0: "Off", 1: "HDR Auto", **{2 * n + 1: f"HDR {n} EV" for n in range(1, 7)}},
    "effect2": {0: "Off", 1: "Toy Camera", 2: "Pop Color", 3: "Posterization", 4: "Retro Photo", 5: "Soft High Key", 6: "Partial Color", 7: "High Contrast Monochrome", 8: "Soft Focus", 9: "HDR Painting", 10: "Rich-tone Monochrome", 11: "Miniature", 12: "Water Color", 13: "Illustration"},
    "metering": {0: "Multi-segment", 2: "Center-weighted average", 3: "Spot", 4: "Average", 5: "Highlight"},
    "aspect": {0: "16:9", 1: "4:3", 2: "3:2", 3: "1:1", 5: "Panorama"},
    "anti_blur": {0: "Off", 1: "On (Continuous)", 2: "On (Shooting)"},
    "release2": {0: "Normal", 1: "Continuous", 2: "Continuous - Exposure Bracketing", 3: "DRO or White Balance Bracketing", 5: "Continuous - Burst", 6: "Single Frame - Capture During Movie", 7: "Continuous - Sweep Panorama", 8: "Continuous - Anti-Motion Blur, Hand-held Twilight", 9: "Continuous - HDR", 10: "Continuous - Background defocus", 13: "Continuous - 3D Sweep Panorama", 15: "Continuous - High Resolution Sweep Panorama", 16: "Continuous - 3D Image", 17: "Continuous - Burst 2", 18: "Normal - iAuto+", 19: "Continuous - Speed/Advance Priority", 20: "Continuous - Multi Frame NR", 23: "Single-frame - Exposure Bracketing", 26: "Continuous Low", 27: "Continuous - High Sensitivity", 28: "Smile Shutter", 146: "Single Frame - Movie Capture"},
    "program": {0: "Program AE", 1: "Portrait", 2: "Beach", 3: "Sports", 4: "Snow", 5: "Landscape", 6: "Auto", 7: "Aperture-priority AE", 8: "Shutter speed priority AE", 9: "Night Scene / Twilight", 10: "Hi-Speed Shutter", 11: "Twilight Portrait", 12: "Soft Snap/Portrait", 13: "Fireworks", 14: "Smile Shutter", 15: "Manual", 18: "iAuto"},
    "style": {0: "Standard", 1: "Vivid", 2: "Neutral", 3: "Portrait", 4: "Landscape", 5: "B&W", 6: "Clear", 7: "Deep", 8: "Light", 9: "Sunset", 10: "Night View/Portrait", 11: "Autumn Leaves", 13: "Sepia", 15: "FL", 16: "VV2", 17: "IN", 18: "SH", 19: "FL2", 20: "FL3", 255: "Off"},
    "profile": {0: "Gamma Still - Standard/Neutral (PP2)", 1: "Gamma Still - Portrait", 3: "Gamma Still - Night View/Portrait", 4: "Gamma Still - B&W/Sepia", 5: "Gamma Still - Clear", 6: "Gamma Still - Deep", 7: "Gamma Still - Light", 8: "Gamma Still - Vivid", 9: "Gamma Still - Real", 10: "Gamma Movie (PP1)", 22: "Gamma ITU709 (PP3 or PP4)", 24: "Gamma Cine1 (PP5)", 25: "Gamma Cine2 (PP6)", 26: "Gamma Cine3", 27: "Gamma Cine4", 28: "Gamma S-Log2 (PP7)", 29: "Gamma ITU709 (800%)", 31: "Gamma S-Log3 (PP8 or PP9)", 33: "Gamma HLG2 (PP10)", 34: "Gamma HLG3", 36: "Off", 37: "FL", 38: "VV2", 39: "IN", 40: "SH", 48: "FL2", 49: "FL3"},
    "yes": {0: "No"},
}
HDR_MODES = {0: "Off", 1: "Auto", **{0x10 + n: f"{1 + n / 2:.1f} EV" for n in range(11)}}
HDR_IMAGES = {0: "Uncorrected image", 1: "HDR image (good)", 2: "HDR image (fail 1)", 3: "HDR image (fail 2)"}
# Lens features as (mask, value, name, before the focal length?), in groups of which one at most holds.
LENS_FEATURES = (
    ((0x0300, 0x0100, "DT", True), (0x0300, 0x0200, "FE", True), (0x0300, 0x0300, "E", True)),
    ((0x4000, 0, "PZ", True),),
    ((0x0020, 0, "STF", True), (0x0040, 0, "Reflex", True), (0x0080, 0, "Fisheye", True)),
    ((0x0004, 0, "ZA", False), (0x0008, 0, "G", False)),
    ((0x0001, 0, "SSM", False), (0x0002, 0, "SAM", False)),
    ((0x8000, 0, "OSS", False),),
    ((0x2000, 0, "LE", False),),
    ((0x0800, 0, "II", False),),
)


def label(kind: str, code: int | None) -> str | None:
    return None if code is None else "Yes" if kind == "yes" and code else LABELS[kind].get(code, str(code))


def exposure(seconds: float) -> str:
    return "Bulb" if not seconds else f"1/{int(1 / seconds + 0.5)}" if seconds < 1 else plain_number(seconds)


def features(flags: int) -> list[tuple[str, bool]]:
    out = []
    for group in LENS_FEATURES:
        hit = next(((n, first) for mask, value, n, first in group if (flags & mask == value if value else flags & mask)), None)
        out += [hit] if hit else []
    return out


def bcd(b: bytes) -> int:
    return int(b.hex()) if b.hex().isdigit() else 0


def lens_spec(b: bytes) -> str:
    if len(b) != 8:
        return b.hex()
    found = features(b[0] << 8 | b[7])
    f0, f1, a0, a1 = bcd(b[1:3]), bcd(b[3:5]), bcd(b[5:6]) / 10, bcd(b[6:7]) / 10
    middle = []
    if f0 and a0:
        middle = [(f"{f0}-{f1}mm" if f1 and f1 != f0 else f"{f0}mm") + " " + (f"F{a0:.1f}-{a1:.1f}" if a1 and a1 != a0 else f"F{a0:.1f}")]
    return " ".join([n for n, first in found if first] + middle + [n for n, first in found if not first]) or b.hex()


@cache
def decipher_table() -> bytes:
    """Inverse of b -> b ** 3 mod 249 below 249; larger bytes stand for themselves."""
    table = list(range(256))
    for b in range(249):
        table[b**3 % 249] = b
    return bytes(table)


def _at(how: str, b: bytes, at: int):
    """A value inside a table, little-endian; None if b ends before it."""
    u = lambda n=2, k=at: uint(b, k, n, "little")
    kind, _, more = how.partition(":")
    if kind == "b":
        return label(more, u(1))
    if kind == "w":
        return label(more, u())
    v = {"u8": 1, "u16": 2, "u32": 4, "count": 4, "shots": 4, "s8": 1, "percent": 1, "year": 1, "focus7": 1, "celsius": 1, "fahrenheit": 1}.get(kind, 2)
    x = u(v)
    if x is None:
        return None
    if kind == "s8":
        return x - 256 * (x > 127)
    if kind in ("shorts", "words"):
        n = int(more)
        read = sint if kind == "shorts" else uint
        vs = [read(b, at + 2 * k, 2, "little") for k in range(n)]
        return None if None in vs else " ".join(map(str, vs))
    if kind == "ratio":
        d = uint(b, at + 2, 2, "little")
        return exposure(x / d) if d else None
    if kind == "triplet":
        vs = [uint(b, at + 2 * k, 2, "little") for k in range(3)]
        return None if None in vs else "Mechanical ({} {} {})".format(*vs)
    if kind in ("hex", "cstring", "features"):
        raw = b[at : at + int(more)]
        if len(raw) < int(more):
            return None
        if kind == "features":
            return " ".join(n for n, _ in features(raw[0] << 8 | raw[1])) or raw.hex()
        return raw.hex() if kind == "hex" else c_string(raw)
    stops = 16 - x / 256
    return {
        "u8": lambda: x, "u16": lambda: x, "u32": lambda: x, "count": lambda: x & 0xFFFFFF, "shots": lambda: x + 1, "percent": lambda: f"{x}%", "year": lambda: 2000 + x, "focus7": lambda: label("focus", x & 0x7F),
        "celsius": lambda: f"{x - 256 * (x > 127)} C", "fahrenheit": lambda: f"{(x - 32) / 1.8:.1f} C", "iso": lambda: int(100 * 2.0**stops + 0.5), "stops": lambda: stops, "shutter": lambda: exposure(2.0**stops if x else 0.0), "fnumber": lambda: f"{2.0 ** (-stops / 2):.1f}",
        "brightness": lambda: x / 256 - 56.6, "ev": lambda: -(x - 65536 * (x > 32767)) / 256, "mm": lambda: f"{x / 10:.1f} mm", "mm0": lambda: f"{x / 10:.1f} mm" if x else None, "zoom": lambda: f"{x / 10.24:.0f}%", "version": lambda: f"{x >> 8:x}.{x & 255:02x}", "firmware": lambda: f"Ver.{x >> 8:02x}.{x & 255:03d}",
    }[kind]()


# Plain fields, tag -> (name, type wanted or 0, how).
SONY_PLAIN = {
    0x0102: ("Quality", 4, "quality"), 0x0104: ("FlashExposureComp", 0, "tenths"), 0x0112: ("WhiteBalanceFineTune", 4, "int"), 0x0115: ("WhiteBalance", 4, "white_balance"),
    0x2002: ("Rating", 4, "int"), 0x2004: ("Contrast", 0, "sint"), 0x2005: ("Saturation", 0, "sint"), 0x2006: ("Sharpness", 0, "sint"), 0x2007: ("Brightness", 0, "sint"), 0x2008: ("LongExposureNoiseReduction", 4, "long_exposure"), 0x2009: ("HighISONoiseReduction", 3, "high_iso"), 0x200A: ("HDR", 4, "hdr_pair"), 0x200B: ("MultiFrameNoiseReduction", 4, "off_on"), 0x200E: ("PictureEffect", 3, "off"), 0x200F: ("SoftSkinEffect", 4, "soft_skin"),
    0x2011: ("VignettingCorrection", 4, "correction"), 0x2012: ("LateralChromaticAberration", 4, "correction"), 0x2013: ("DistortionCorrectionSetting", 4, "correction"), 0x2014: ("WBShiftAB_GM", 0, "spair"), 0x2016: ("AutoPortraitFramed", 3, "yes"), 0x2017: ("FlashAction", 4, "flash_action"), 0x201A: ("ElectronicFrontCurtainShutter", 4, "off_on"), 0x201B: ("FocusMode", 1, "focus"), 0x201C: ("AFAreaModeSetting", 1, "af_area_setting"), 0x201D: ("FlexibleSpotPosition", 0, "words2"), 0x201E: ("AFPointSelected", 1, "af_point"),
    0x2021: ("AFTracking", 1, "off_on"), 0x2023: ("MultiFrameNREffect", 4, "normal"), 0x2026: ("WBShiftAB_GM_Precise", 0, "spair2"), 0x2027: ("FocusLocation", 0, "words4"), 0x2028: ("VariableLowPassFilter", 0, "words2na"), 0x2029: ("RAWFileType", 3, "raw_type"), 0x202B: ("PrioritySetInAWB", 1, "standard"), 0x202C: ("MeteringMode2", 3, "metering2"), 0x202D: ("ExposureStandardAdjustment", 0, "sixths"), 0x202F: ("PixelShiftInfo", 0, "hexna"),
    0xB000: ("FileFormat", 0, "arw"), 0xB001: ("SonyModelID", 3, "int"), 0xB020: ("CreativeStyle", 0, "text"), 0xB021: ("ColorTemperature", 4, "auto"), 0xB022: ("ColorCompensationFilter", 0, "sint"), 0xB023: ("SceneMode", 4, "scene"), 0xB024: ("ZoneMatching", 4, "zone"), 0xB025: ("DynamicRangeOptimizer", 4, "dro"), 0xB026: ("ImageStabilization", 4, "off_on"), 0xB027: ("LensType", 4, "lens16"), 0xB029: ("ColorMode", 4, "standard"), 0xB02A: ("LensSpec", 0, "lens_spec"), 0xB02B: ("FullImageSize", 0, "size"), 0xB02C: ("PreviewImageSize", 0, "size"),
    0xB041: ("ExposureMode", 3, "exposure_mode"), 0xB048: ("FlashLevel", 0, "level"), 0xB049: ("ReleaseMode", 3, "release"), 0xB04A: ("SequenceNumber", 3, "int"), 0xB04B: ("Anti-Blur", 3, "anti_blur"), 0xB04F: ("DynamicRangeOptimizer", 3, "dro"), 0xB052: ("IntelligentAuto", 3, "off_on"),
}

# Tables, tag -> (path, enciphered?, fields (name, offset, how)).
SONY_TABLES = {
    0x3000: ("sony_shot_info", False, [("FaceInfoOffset", 2, "u16"), ("SonyDateTime", 6, "cstring:20"), ("SonyImageHeight", 0x1A, "u16"), ("SonyImageWidth", 0x1C, "u16"), ("FacesDetected", 0x30, "u16"), ("FaceInfoLength", 0x32, "u16"), ("MetaVersion", 0x34, "cstring:16")]),
    0x9400: ("sony_tag9400", True, [("SequenceImageNumber", 0x12, "shots"), ("SequenceLength", 0x16, "b:sequence"), ("SequenceFileNumber", 0x1A, "shots"), ("CameraOrientation", 0x29, "b:orientation"), ("Quality2", 0x2A, "b:quality2"), ("ModelReleaseYear", 0x53, "year")]),
    0x9402: ("sony_tag9402", True, [("AmbientTemperature", 4, "celsius"), ("FocusMode", 0x16, "focus7"), ("AFAreaMode", 0x17, "b:af_area"), ("FocusPosition2", 0x2D, "u8")]),
    0x9405: ("sony_tag9405", True, [("SonyISO", 4, "iso"), ("BaseISO", 6, "iso"), ("StopsAboveBaseISO", 0xA, "stops"), ("SonyExposureTime2", 0xE, "shutter"), ("ExposureTime", 0x10, "ratio"), ("SonyMaxApertureValue", 0x16, "fnumber"), ("SequenceImageNumber", 0x24, "shots"), ("SonyImageWidthMax", 0x3E, "u16"), ("SonyImageHeightMax", 0x40, "u16"), ("PictureEffect2", 0x46, "b:effect2"), ("ExposureProgram", 0x48, "b:program"), ("Sharpness", 0x52, "s8"), ("DistortionCorrParamsPresent", 0x5A, "b:yes"), ("DistortionCorrection", 0x5B, "b:distortion"), ("LensFormat", 0x5D, "b:lens_format"), ("LensMount", 0x5E, "b:mount"), ("LensType2", 0x60, "w:lens2"), ("DistortionCorrParams", 0x64, "shorts:16"), ("LensZoomPosition", 0x34E, "zoom"), ("VignettingCorrParams", 0x35C, "shorts:16"), ("ChromaticAberrationCorrParams", 0x3B8, "shorts:32")]),
    0x9406: ("sony_tag9406", True, [("BatteryTemperature", 5, "fahrenheit"), ("BatteryLevel", 7, "percent")]),
    0x940C: ("sony_tag940c", True, [("LensMount2", 8, "b:mount2"), ("LensType3", 9, "w:lens2"), ("CameraE-mountVersion", 0xB, "version"), ("LensE-mountVersion", 0xD, "version"), ("LensFirmwareVersion", 0x14, "firmware")]),
    0x9050: ("sony_tag9050", True, [("Shutter", 0x26, "triplet"), ("FlashStatus", 0x39, "b:flash_status"), ("ShutterCount", 0x3A, "count"), ("SonyExposureTime", 0x46, "shutter"), ("SonyFNumber", 0x48, "fnumber"), ("ReleaseMode2", 0x4B, "b:release2"), ("ShutterCount2", 0x50, "count"), ("InternalSerialNumber", 0x88, "hex:6"), ("LensMount", 0x105, "b:mount"), ("LensFormat", 0x106, "b:lens_format"), ("LensType2", 0x107, "w:lens2"), ("DistortionCorrParamsPresent", 0x10B, "b:yes"), ("LensSpecFeatures", 0x116, "features:2"), ("ShutterCount3", 0x19F, "count")]),
    0x2010: ("sony_tag2010", True, [("ReleaseMode3", 0x204, "b:release2"), ("SelfTimer", 0x210, "b:self_timer"), ("FlashMode", 0x211, "b:flash_mode"), ("StopsAboveBaseISO", 0x217, "stops"), ("BrightnessValue", 0x219, "brightness"), ("HDRSetting", 0x21F, "b:hdr"), ("ExposureCompensation", 0x223, "ev"), ("PictureProfile", 0x237, "b:profile"), ("PictureEffect2", 0x23C, "b:effect2"), ("Quality2", 0x247, "b:quality2"), ("MeteringMode", 0x24B, "b:metering"), ("ExposureProgram", 0x24C, "b:program"), ("WB_RGBLevels", 0x252, "words:3"), ("FocalLength", 0x30A, "mm"), ("MinFocalLength", 0x30C, "mm"), ("MaxFocalLength", 0x30E, "mm0"), ("SonyISO", 0x320, "iso"), ("DistortionCorrParams", 0x17D0, "shorts:16"), ("LensFormat", 0x17F1, "b:lens_format"), ("LensMount", 0x17F2, "b:mount"), ("LensType2", 0x17F3, "w:lens2"), ("DistortionCorrParamsPresent", 0x17F8, "b:yes"), ("DistortionCorrParamsNumber", 0x17F9, "b:distortion_number"), ("AspectRatio", 0x188C, "b:aspect")]),
    0x9416: ("sony_tag9416", True, [("SonyISO", 4, "iso"), ("StopsAboveBaseISO", 6, "stops"), ("SonyExposureTime2", 0xA, "shutter"), ("SonyMaxApertureValue", 0x12, "fnumber"), ("SequenceImageNumber", 0x1D, "shots"), ("ReleaseMode2", 0x2B, "b:release2"), ("ExposureProgram", 0x35, "b:program"), ("CreativeStyle", 0x37, "b:style"), ("LensMount", 0x48, "b:mount"), ("LensFormat", 0x49, "b:lens_format"), ("LensType2", 0x4B, "w:lens2"), ("DistortionCorrParams", 0x4F, "shorts:16"), ("PictureProfile", 0x70, "b:profile"), ("FocalLength", 0x71, "mm"), ("MinFocalLength", 0x73, "mm"), ("MaxFocalLength", 0x75, "mm"), ("VignettingCorrParams", 0x891, "shorts:16"), ("ChromaticAberrationCorrParams", 0x83B, "shorts:32")]),
}
# Where ISO settings are in table 0x9401, by its version.
ISO_PLACES = {68: 0x634, 73: 0x636, 74: 0x636, 78: 0x64C, 90: 0x653, 93: 0x678, 94: 0x678, 100: 0x6B8, 103: 0x6B8, 124: 0x6DE, 125: 0x6DE, 127: 0x6E7, 128: 0x6E7, 130: 0x6E7, 144: 0x59D, 146: 0x59D, 148: 0x498, 152: 0x4A2, 154: 0x4A2, 155: 0x4A2, 160: 0x4A1, 164: 0x4A1, 167: 0x49D, 178: 0x44E, 181: 0x3E2, 185: 0x3F4, 186: 0x3F4, 187: 0x3F4, 198: 0x453}


def _plain(how: str, b: bytes, kind: int, order: str):
    whole = uint(b, 0, {1: 1, 3: 2, 4: 4}.get(kind, 4), order)
    pairs = lambda n, read, size: [read(b, size * k, size, "little") for k in range(n)]
    if how in LABELS:
        return label(how, whole)
    if how == "int":
        return whole
    if how == "sint":
        return sint(b, 0, 4, order)
    if how == "level":
        return label("normal", sint(b, 0, 2, order))
    if how == "text":
        return c_string(b)
    if how == "lens16":
        return label("lens", None if whole is None else whole & 0xFFFF)
    if how == "lens_spec":
        return lens_spec(b)
    if how == "hdr_pair":
        return None if whole is None else f"{HDR_MODES.get(whole & 0xFFFF, 'Unknown')}; {HDR_IMAGES.get(whole >> 16, 'Unknown')}"
    if how == "arw":
        return f"ARW {b[3] + 2}.{b[0]}.{b[2]}" if len(b) == 4 else b.hex()
    if how == "hexna":
        return b.hex() if any(b) else "n/a"
    n, read, size = {"words2": (2, uint, 2), "words2na": (2, uint, 2), "words4": (4, uint, 2), "size": (2, uint, 4)}.get(how, (2, sint, 4))
    vs = pairs(n, read, size)
    if None in vs:
        return None
    if how in ("tenths", "sixths"):
        return plain_number(vs[0] / vs[1] * (10.0 if how == "tenths" else 6.0)) if vs[1] else None
    if how == "size":
        return f"{vs[1]}x{vs[0]}"
    if how == "spair2":
        return f"{vs[0]:.2f} {vs[1]:.2f}"
    return "n/a" if how == "words2na" and not any(vs) else " ".join(map(str, vs))


def sony(out: Out, tiff: Tiff) -> None:
    slot = next((s for s in tiff.slots if s[1] == 0x927C and s[4] is not None and s[6] is not None), None)
    if not slot or not slot[4].startswith(SONY_HEAD):
        return
    b, order = tiff.data, tiff.order
    found: dict[int, tuple[int, bytes, int, int]] = {}
    for tag, kind, count, packed, where in _slots(b, slot[6] + len(SONY_HEAD), order):
        size = SIZES.get(kind, 2 if kind == 8 else 1) * count
        raw = packed[:size] if size <= 4 else b[where : where + size]
        if len(raw) < size:
            continue
        found.setdefault(tag, (kind, raw, where, count))
        if tag in SONY_PLAIN:
            name, wanted, how = SONY_PLAIN[tag]
            if wanted in (0, 1, kind):
                _put(out, "sony", "sony_makernote", tag, name, _plain(how, raw, 1 if wanted == 1 else kind, order))

    def table(tag: int, secret: bool) -> bytes | None:
        if tag not in found:
            return None
        _, raw, where, count = found[tag]
        return b[where : where + count].translate(decipher_table()) if secret else raw

    def read(tag: int) -> None:
        path, secret, fields = SONY_TABLES[tag]
        t = table(tag, secret)
        if t is None:
            return
        for name, at, how in fields:
            if name == "AmbientTemperature" and t[2:3] != b"\xff":
                continue
            value = _at(how, t, at)
            if value is None and (tag, name) == (0x9416, "VignettingCorrParams"):
                value = _at(how, t, 0x88F)
            _put(out, "sony", path, tag, name, stamp(value) if name == "SonyDateTime" and value is not None else value)

    read(0x3000)
    t = table(0x202A, False)
    if t is not None:
        n = t[1] if len(t) > 1 else 0
        _put(out, "sony", "sony_af_points", 0x202A, "FocalPlaneAFPointsUsed", n)
        area = _at("words:2", t, 2)
        _put(out, "sony", "sony_af_points", 0x202A, "FocalPlaneAFPointArea", area)
        for k in range(min(n, 15)):
            _put(out, "sony", "sony_af_points", 0x202A, f"FocalPlaneAFPointLocation{k + 1}", _at("words:2", t, 6 + 4 * k))
    t = table(0x9401, True)
    if t and t[0] in ISO_PLACES:
        for k, name in enumerate(("ISOSetting", "ISOAutoMin", "ISOAutoMax")):
            _put(out, "sony", "sony_tag9401", 0x9401, name, _at("b:auto", t, ISO_PLACES[t[0]] + 2 * k))
    for tag in (0x9400, 0x9402, 0x9405, 0x9406, 0x940C, 0x9050, 0x2010, 0x9416):
        read(tag)


def maker_notes(out: Out, tiff: Tiff) -> None:
    """Fields of the maker that the EXIF entries name."""
    make = next((e["value"].get("s") for e in out.entries if e["namespace"] == "exif" and e["tag_name"] == "Make"), None)
    if make and make.lower() == "apple":
        apple(out, tiff)
    elif make and make.lower() == "sony":
        sony(out, tiff)
