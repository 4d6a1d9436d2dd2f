"""Namespaces: payload bytes to entries. Each function returns how many entries it made."""

from __future__ import annotations

import re

from .base import Out, integer, number, raw, rational, rationals, sint, stamp, text, uint, utf8

# EXIF tags.
EXIF_TAGS = {
    0x0001: "GPSLatitudeRef", 0x0002: "GPSLatitude", 0x0003: "GPSLongitudeRef", 0x0004: "GPSLongitude",
    0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "ModifyDate", 0x013C: "HostComputer", 0x0213: "YCbCrPositioning",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8769: "ExifOffset", 0x8822: "ExposureProgram", 0x8825: "GPSInfo", 0x8827: "ISO", 0x8830: "SensitivityType", 0x8832: "RecommendedExposureIndex",
    0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel",
    0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue", 0x9204: "ExposureCompensation", 0x9205: "MaxApertureValue", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized",
    0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA005: "InteroperabilityOffset", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFormat", 0xA406: "SceneCaptureType", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness", 0xA432: "LensInfo", 0xA433: "LensMake", 0xA434: "LensModel", 0xA460: "CompositeImage",
}
STAMPS = {0x0132, 0x9003, 0x9004}
SIZES = {1: 1, 2: 1, 7: 1, 3: 2, 4: 4, 9: 4, 5: 8, 10: 8}
POINTERS = {0x8769: "exif_ifd", 0x8825: "gps_ifd"}


class Tiff:
    """Directories of a TIFF structure: slots (directory, tag, type, count, data or None, slot offset). No next-directory chain."""

    def __init__(self, data: bytes, base: int = 0):
        self.data, self.base, self.slots, self.issues = data, base, [], []
        order = {b"II": "little", b"MM": "big"}.get(data[:2])
        if not order or uint(data, 2, 2, order) != 42 or len(data) < 8:
            raise ValueError("not a TIFF header")
        self.order, self.directories, self._seen = order, [], set()
        self._walk(uint(data, 4, 4, order), "ifd0")

    def _walk(self, at: int, name: str) -> None:
        d, o = self.data, self.order
        if at in self._seen:
            self.issues.append(("tiff_ifd_cycle", "directory was read before", self.base + at))
            return
        self._seen.add(at)
        n = uint(d, at, 2, o)
        if n is None:
            self.issues.append(("tiff_ifd_out_of_bounds", "directory lies outside the data", self.base + at))
            return
        self.directories.append((name, self.base + at, self.base + min(len(d), at + 2 + 12 * n)))
        later = {}
        for k in range(n):
            slot = at + 2 + 12 * k
            if slot + 12 > len(d):
                self.issues.append(("tiff_entry_out_of_bounds", "directory entry lies outside the data", self.base + slot))
                break
            tag, kind, count = uint(d, slot, 2, o), uint(d, slot + 2, 2, o), uint(d, slot + 4, 4, o)
            size = SIZES.get(kind, 1) * count
            start = slot + 8 if size <= 4 else uint(d, slot + 8, 4, o)
            value = d[start : start + size] if start + size <= len(d) else None
            if value is None:
                self.issues.append(("tiff_value_out_of_bounds", "value lies outside the data", self.base + slot))
            self.slots.append((name, tag, kind, count, value, slot, start if size > 4 else None))
            if tag in POINTERS:
                later[tag] = uint(d, slot + 8, 4, o)
        for tag in POINTERS:  # the last pointer of a kind counts
            if tag in later:
                self._walk(later[tag], POINTERS[tag])

    def payload(self, tag: int):
        """(start, bytes) of the first out-of-line value of a tag."""
        for _, t, _, _, value, _, start in self.slots:
            if t == tag and start is not None and value is not None:
                return start, value
        return None


def exif(out: Out, tiff: Tiff) -> int:
    for directory, tag, kind, count, b, slot, _ in tiff.slots:
        if b is None or not count and kind != 2:
            continue
        o = tiff.order
        if kind == 2:
            s = b.split(b"\0")[0].decode("utf-8", "replace").strip()
            value = stamp(s) if tag in STAMPS else text(s)
        elif kind in (3, 4):
            value = integer(uint(b, 0, SIZES[kind], o))
        elif kind in (8, 9):
            value = integer(sint(b, 0, min(len(b), 4 if kind == 9 else 2), o))
        elif kind in (5, 10):
            read = sint if kind == 10 else uint
            pairs = [(read(b, i, 4, o), read(b, i + 4, 4, o)) for i in range(0, 8 * count, 8)]
            value = rational(*pairs[0]) if count == 1 else rationals(pairs)
        else:
            value = raw(b)
        out.entry("exif", f"0x{tag:04X}", EXIF_TAGS.get(tag, "UnknownTag"), value, directory, tiff.base + slot, tiff.base + slot + 12)
    return len(tiff.slots)


# --- XMP ----------------------------------------------------------------------------------------

# Fixed values: (tag, kind, property names in order of preference).
XMP = [
    ("CreateDate", "s", ("xmp:CreateDate", "photoshop:DateCreated")), ("ModifyDate", "s", ("xmp:ModifyDate",)), ("MetadataDate", "s", ("xmp:MetadataDate",)), ("DateTimeOriginal", "t", ("exif:DateTimeOriginal",)),
    ("Make", "s", ("tiff:Make",)), ("Model", "s", ("tiff:Model",)), ("Orientation", "i", ("tiff:Orientation",)), ("ImageWidth", "i", ("tiff:ImageWidth", "exif:PixelXDimension")), ("ImageHeight", "i", ("tiff:ImageLength", "exif:PixelYDimension")),
    ("GPSLatitude", "s", ("exif:GPSLatitude",)), ("GPSLongitude", "s", ("exif:GPSLongitude",)), ("Software", "s", ("xmp:CreatorTool",)), ("Author", "s", ("dc:creator",)), ("Copyright", "s", ("dc:rights",)), ("Headline", "s", ("photoshop:Headline",)), ("Description", "s", ("dc:description", "photoshop:Caption-Abstract")),
]
DJI_FLOATS = ("AbsoluteAltitude", "RelativeAltitude", "GimbalRollDegree", "GimbalYawDegree", "GimbalPitchDegree", "FlightRollDegree", "FlightYawDegree", "FlightPitchDegree", "FlightXSpeed", "FlightYSpeed", "FlightZSpeed")
DJI_INTEGERS = ("CamReverse", "GimbalReverse", "RtkFlag")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def unescape(s: str) -> str:
    for a, b in ENTITIES:
        s = s.replace(a, b)
    return s


def element(doc: str, name: str) -> str | None:
    m = re.search(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", doc, re.S)
    return m and m[1]


def find(doc: str, names) -> str | None:
    for name in names:
        m = re.search(rf'{re.escape(name)}="([^"]*)"', doc)
        if m:
            return unescape(m[1])
        body = element(doc, name)
        if body is not None:
            li = re.search(r'<rdf:li[^>]*xml:lang="x-default"[^>]*>(.*?)</rdf:li>', body, re.S) or re.search(r"<rdf:li[^>]*>(.*?)</rdf:li>", body, re.S)
            return unescape((li[1] if li else body).strip())
    return None


def parse_number(s: str) -> float | None:
    return float(s) if re.fullmatch(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf(inity)?|nan)\s*", s, re.I) else None


def xmp(out: Out, payload: bytes, start: int) -> int:
    doc, before = utf8(payload), len(out.entries)
    if doc is None:
        return 0
    at = {"path": "xmp_packet", "start": start, "end": start + len(payload)}
    for tag, kind, names in XMP:
        s = find(doc, names)
        if s is None or not s.strip():
            continue
        if kind == "i":
            if re.fullmatch(r"\s*[+-]?\d+\s*", s):
                out.entry("xmp", tag, tag, integer(int(s)), **at)
        else:
            out.entry("xmp", tag, tag, stamp(s) if kind == "t" else text(s), **at)
    for item in re.findall(r"<rdf:li[^>]*>(.*?)</rdf:li>", element(doc, "dc:subject") or "", re.S):
        if item.strip():
            out.entry("xmp", "Keywords", "Keywords", text(unescape(item.strip())), **at)
    for tag in (*DJI_FLOATS, *DJI_INTEGERS, "SelfData"):
        s = find(doc, (f"drone-dji:{tag}",))
        if s is None:
            continue
        v = parse_number(s)
        if tag == "SelfData":
            out.entry("dji", tag, tag, text(s), **at)
        elif tag in DJI_FLOATS and v is not None:
            out.entry("dji", tag, tag, number(v), **at)
        elif tag in DJI_INTEGERS and re.fullmatch(r"\s*[+-]?\d+\s*", s):
            out.entry("dji", tag, tag, integer(int(s)), **at)
    return len(out.entries) - before


# Fixed values: (tag, element, attribute) of camera side-car XML in media files.
RTMD = [
    ("MetadataDate", "NonRealTimeMeta", "lastUpdate"), ("CreateDate", "CreationDate", "value"), ("Make", "Device", "manufacturer"), ("Model", "Device", "modelName"), ("CaptureFps", "VideoFrame", "captureFps"), ("FormatFps", "VideoFrame", "formatFps"),
    ("VideoCodecProfile", "VideoFrame", "videoCodec"), ("ImageWidth", "VideoLayout", "pixel"), ("ImageHeight", "VideoLayout", "numOfVerticalLine"), ("AspectRatio", "VideoLayout", "aspectRatio"), ("AudioChannels", "AudioFormat", "numOfChannel"),
    ("AudioCodecName", "AudioRecPort", "audioCodec"), ("RecordingMode", "RecordingMode", "type"),
]
# Instants among them, and what their notes name.
RTMD_STAMPS = {"MetadataDate": "lastUpdate", "CreateDate": "CreationDate"}


def rtmd(out: Out, payload: bytes, start: int) -> int:
    doc, before = utf8(payload), len(out.entries)
    if doc is None or "<NonRealTimeMeta" not in doc:
        return 0
    where = ("non_real_time_meta", start, start + len(payload))
    for tag, name, attribute in RTMD:
        m = re.search(rf'<{name}\b[^>]*?\b{attribute}="([^"]*)"', doc)
        if m and m[1].strip():
            whole = tag in ("ImageWidth", "ImageHeight", "AudioChannels") and m[1].strip().isdigit()
            value = integer(int(m[1])) if whole else stamp(unescape(m[1])) if tag in RTMD_STAMPS else text(unescape(m[1]))
            out.entry("rtmd", tag, tag, value, *where, [f"decoded from NonRealTimeMeta {RTMD_STAMPS.get(tag, f'{name} {attribute}')}"])
    for item in re.findall(r"<Item\b[^>]*", doc):
        m = re.search(r'\bvalue="([^"]*)"', item)
        if re.search(r'\bname="CaptureGammaEquation"', item):
            if m and m[1].strip():
                out.entry("rtmd", "CaptureGammaEquation", "CaptureGammaEquation", text(unescape(m[1])), *where, ["decoded from NonRealTimeMeta AcquisitionRecord item"])
            break
    return len(out.entries) - before


# --- IPTC, ICC, Vorbis comments -----------------------------------------------------------------

# Datasets of record 2.
IPTC = {25: "Keywords", 80: "Author", 105: "Headline", 116: "Copyright", 120: "Description"}


def photoshop_resource(b: bytes, wanted: int = 0x0404) -> bytes | None:
    at = 14 if b.startswith(b"Photoshop 3.0\0") else 0
    while b[at : at + 4] == b"8BIM":
        ident, name = uint(b, at + 4, 2), uint(b, at + 6, 1)
        if name is None:
            return None
        body = at + 6 + (name + 2) // 2 * 2
        size = uint(b, body, 4)
        if size is None or body + 4 + size > len(b):
            return None
        if ident == wanted:
            return b[body + 4 : body + 4 + size]
        at = body + 4 + size + size % 2
    return None


def iptc(out: Out, payload: bytes, start: int, path: str) -> int:
    before, b, at = len(out.entries), photoshop_resource(payload) or payload, 0
    while (at := b.find(b"\x1c", at)) >= 0 and at + 5 <= len(b):
        record, dataset, size = b[at + 1], b[at + 2], uint(b, at + 3, 2)
        body = b[at + 5 : at + 5 + size]
        if len(body) < size:
            break
        s = (utf8(body) or "").strip()
        if record == 2 and dataset in IPTC and s:
            out.entry("iptc", f"2:{dataset}", IPTC[dataset], text(s), path, start, start + len(payload), [f"decoded IPTC dataset {record}:{dataset}"])
        at += 5 + size
    return len(out.entries) - before


# Profile classes, and fields of the header.
ICC_CLASSES = {b"mntr": "display", b"prtr": "output", b"scnr": "input", b"link": "device_link", b"spac": "color_space", b"abst": "abstract", b"nmcl": "named_color"}
ICC_FIELDS = [("ProfileClass", "profile_class", 12), ("ColorSpace", "color_space", 16), ("ConnectionSpace", "connection_space", 20), ("DeviceManufacturer", "device_manufacturer", 48), ("DeviceModel", "device_model", 52)]


def icc(out: Out, payload: bytes, start: int, path: str) -> int:
    before, b = len(out.entries), payload
    if b.startswith(b"ICC_PROFILE\0"):
        b = b[14:]
    if len(b) < 128:
        return 0
    for name, ident, at in ICC_FIELDS:
        s = ICC_CLASSES.get(b[at : at + 4]) if name == "ProfileClass" else None
        s = s or (utf8(b[at : at + 4]) or "").strip()
        if s:
            out.entry("icc", ident, name, text(s), path, start, start + len(payload))
    for k in range(min(uint(b, 128, 4) or 0, (len(b) - 132) // 12)):
        base = 132 + 12 * k
        if b[base : base + 4] == b"desc":
            at, size = uint(b, base + 4, 4), uint(b, base + 8, 4)
            tag = b[at : at + size]
            n = uint(tag, 8, 4)
            if tag[:4] == b"desc" and len(tag) == size and n is not None and 12 + n <= len(tag):
                s = (utf8(tag[12 : 12 + n].split(b"\0")[0]) or "").strip()
                if s:
                    out.entry("icc", "profile_description", "ProfileDescription", text(s), path, start, start + len(payload), ["decoded from ICC desc tag"])
            break
    return len(out.entries) - before


# Names of usual comments; other keys stay as they are, in upper case.
VORBIS = {"TITLE": "Title", "ARTIST": "Artist", "ALBUM": "Album", "DATE": "Date", "GENRE": "Genre", "TRACKNUMBER": "TrackNumber", "COMMENT": "Comment", "COMPOSER": "Composer", "ALBUMARTIST": "AlbumArtist"}


def vorbis_comment(out: Out, b: bytes, start: int) -> int:
    before, at = len(out.entries), 0

    def part():
        nonlocal at
        n = uint(b, at, 4, "little")
        if n is None or at + 4 + n > len(b):
            return None
        at += 4 + n
        return b[at - n : at]

    where = {"path": "vorbis_comment", "start": start, "end": start + len(b)}
    vendor = part()
    if vendor is None:
        return 0
    if utf8(vendor):
        out.entry("vorbis_comment", "Vendor", "Vendor", text(utf8(vendor)), **where)
    count = uint(b, at, 4, "little") or 0
    at += 4
    for _ in range(count):
        item = part()
        if item is None:
            break
        key, eq, value = (utf8(item) or "").partition("=")
        if eq and key:
            out.entry("vorbis_comment", key.upper(), VORBIS.get(key.upper(), key.upper()), text(value), **where)
    return len(out.entries) - before
