"""ISO base media files: HEIF, MP4, MOV and M4A."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime, timedelta

from . import namespaces as N
from .base import Out, ParseError, fourcc, integer, number, raw, stamp, text, uint, utf8
from .images import _named, _tiff

# Boxes that hold boxes, and how many bytes come before those.
PARENTS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"udta": 0, b"iprp": 0, b"ipco": 0, b"dinf": 0, b"edts": 0, b"meta": 4, b"ilst": 0}
EPOCH = datetime(1904, 1, 1, tzinfo=UTC)

# Item keys of media libraries.
ITUNES_TEXT = {"©nam": "Title", "©ART": "Artist", "©alb": "Album", "©day": "Year", "©gen": "Genre", "©cmt": "Comment", "©wrt": "Composer", "©lyr": "Lyrics", "©too": "Encoder", "aART": "AlbumArtist"}
ITUNES_PAIRS = {"trkn": "TrackNumber", "disk": "DiskNumber"}
QUICKTIME_TEXT = {"©ART": "Author", "©too": "Software", "©nam": "Title"}
UDTA_DJI = {"©fpt": "FlightPitchDegree", "©fyw": "FlightYawDegree", "©frl": "FlightRollDegree", "©gpt": "GimbalPitchDegree", "©gyw": "GimbalYawDegree", "©grl": "GimbalRollDegree", "©xsp": "SpeedX", "©ysp": "SpeedY", "©zsp": "SpeedZ"}
UDTA_DJI_TEXT = {"©mdl": "Model", "©csn": "SerialNumber"}
UDTA_KEYS = {*UDTA_DJI, *UDTA_DJI_TEXT, "©xyz"}
BRANDS = (b"heic", b"heix", b"hevc", b"heim", b"heis", b"mif1", b"msf1", b"avif", b"avis", b"isom", b"iso2", b"mp41", b"mp42", b"avc1", b"qt  ", b"M4A ", b"M4B ", b"M4P ")
# What items and boxes of a content type hold.
MIMES = {b"application/rdf+xml": "xmp", b"application/xml": "xmp", b"text/xml": "xmp", b"application/x-iptc": "iptc"}


def iso_time(seconds: int | None) -> str | None:
    try:
        at = EPOCH + timedelta(seconds=seconds) if seconds else None
    except OverflowError:
        return None
    return at.strftime("%Y-%m-%dT%H:%M:%S") if at and at.year >= 1970 else None


# Sample entries that tell channels and rate.
AUDIO = (b"mp4a", b"ac-3", b"ec-3", b"alac", b"twos", b"sowt", b"lpcm", b"in24", b"in32", b"fl32", b"fl64", b"ulaw", b"alaw")
LEVELS = 200


class Media:
    """Boxes of a file, and what they say."""

    def __init__(self, b: bytes, out: Out):
        self.b, self.out = b, out
        self.tracks, self.items, self.places, self.spans, self.links = [], {}, {}, [], {}
        self.primary = self.idat = self.movie = None
        self.payloads, self.atoms = [], []
        self.walk(0, len(b), "", out.container)

    def walk(self, at: int, end: int, path: str, parent: str) -> None:
        out, b = self.out, self.b
        while at < end:
            if at + 8 > end:
                out.issue("isobmff_box_header_out_of_bounds", "box header lies outside its parent", at)
                return
            size, kind, head = uint(b, at, 4), b[at + 4 : at + 8], 8
            if size == 1:
                size, head = uint(b, at + 8, 8), 16
                if size is None or at + 16 > end:
                    out.issue("isobmff_large_size_header_truncated", "64-bit size lies outside the data", at)
                    return
            elif size == 0:
                size = end - at
            if size < head:
                out.issue("isobmff_box_size_invalid", "box is smaller than its header", at)
                return
            if at + size > end:
                out.issue("isobmff_box_size_out_of_bounds", "box exceeds its parent", at)
                return
            name = fourcc(kind)
            label = f"{path}/{name}" if path else name
            out.node("box", label, at, at + size, parent)
            self.box(kind, name, at + head, at + size, label)
            if kind in PARENTS and label.count("/") >= LEVELS:
                out.issue("isobmff_nesting_too_deep", f"boxes below {LEVELS} levels are not read", at)
            elif kind in PARENTS:
                if kind == b"trak":
                    self.tracks.append({"at": at})
                skip = PARENTS[kind]
                if kind == b"meta" and b[at + head + 4 : at + head + 8] == b"hdlr":
                    skip = 0
                if head + skip > size:
                    out.issue("isobmff_meta_header_truncated", "meta box is too short", at)
                else:
                    self.walk(at + head + skip, at + size, label, label)
            at += size

    def cut(self, name: str, at: int) -> None:
        self.out.issue(f"isobmff_{name}_truncated", f"{name} box is too short", at)

    def box(self, kind: bytes, name: str, a: int, e: int, label: str) -> None:
        d = self.b[a:e] if kind not in (b"mdat", b"free", b"skip", b"wide") else b""
        track = self.tracks[-1] if self.tracks and "/trak/" in f"/{label}/" else None
        if kind == b"ftyp":
            if not any(x in BRANDS for x in (d[:4], *(d[i : i + 4] for i in range(8, len(d), 4)))):
                self.out.issue("isobmff_unrecognized_brand", "no known brand", a, "info")
        elif kind in (b"mvhd", b"mdhd"):
            wide = bool(d[:1] and d[0])
            w = 8 if wide else 4
            times = [uint(d, 4, w), uint(d, 4 + w, w), uint(d, 4 + 2 * w, 4), uint(d, 8 + 2 * w, w)]
            if times[3] is None:
                return self.cut(name, a)
            if kind == b"mvhd":
                self.movie = times
            elif track is not None:
                track["times"] = times
        elif kind == b"tkhd" and track is not None:
            if len(d) < 84:
                return self.cut(name, a)
            track["size"] = (uint(d, len(d) - 8, 4) >> 16, uint(d, len(d) - 4, 4) >> 16)
        elif kind == b"hdlr" and track is not None:
            if len(d) < 12:
                return self.cut(name, a)
            track["kind"] = d[8:12]
        elif kind == b"stsd" and track is not None:
            if len(d) < 16:
                return self.cut(name, a)
            entry = d[8 : 8 + uint(d, 8, 4)]
            track["codec"] = fourcc(entry[4:8])
            if entry[4:8] in AUDIO:
                track["channels"], track["rate"] = uint(entry, 24, 2), uint(entry, 32, 4)
            i = entry.find(b"btrt")
            if i >= 4 and (rate := uint(entry, i + 12, 4)):
                track["average"] = rate
        elif kind == b"btrt" and track is not None and uint(d, 8, 4):
            track["average"] = uint(d, 8, 4)
        elif kind == b"stts" and track is not None:
            if len(d) < 16:
                return self.cut(name, a)
            track["delta"] = uint(d, 12, 4)
        elif kind == b"stsz" and track is not None:
            fixed, n = uint(d, 4, 4), uint(d, 8, 4)
            if n is None:
                return self.cut(name, a)
            track["bytes"] = fixed * n if fixed else sum(int.from_bytes(d[i : i + 4], "big") for i in range(12, min(len(d), 12 + 4 * n), 4))
        elif kind == b"pitm":
            self.primary = uint(d, 4, 4 if d[:1] > b"\0" else 2)
            if self.primary is None:
                self.cut(name, a)
        elif kind == b"iinf":
            at = 8 if d[:1] > b"\0" else 6
            if len(d) < at:
                return self.cut(name, a)
            self.walk(a + at, e, label, label)
        elif kind == b"infe":
            if d[:1] >= b"\2":
                w = 4 if d[:1] > b"\2" else 2
                if len(d) < 8 + w:
                    return self.cut(name, a)
                mime = d[10 + w :].split(b"\0")[1] if d[6 + w : 10 + w] == b"mime" and d.count(b"\0", 10 + w) else b""
                self.items.setdefault(uint(d, 4, w), (d[6 + w : 10 + w], mime))
        elif kind == b"iloc":
            self.locate(d, a)
        elif kind == b"ipma":
            self.associate(d, a)
        elif kind == b"ispe":
            if len(d) < 12:
                return self.cut(name, a)
            self.spans.append((uint(d, 4, 4), uint(d, 8, 4)))
        elif kind == b"idat":
            self.idat = (a, e)
        elif kind == b"colr":
            if len(d) < 4:
                return self.cut(name, a)
            if d[:4] in (b"prof", b"rICC"):
                self.payloads.append(("icc", a + 4, d[4:], "colr_icc"))
        elif kind == b"Exif":
            self.payloads.append(("exif", a, d, "exif"))
        elif kind == b"mime":
            mime, nul, body = d.partition(b"\0")
            if body and MIMES.get(mime) == "xmp":
                self.payloads.append(("xmp", e - len(body), body, "mime"))
            else:
                self.out.issue("isobmff_mime_payload_unsupported", "content type is not read", a, "info")
        elif kind == b"xml ":
            self.payloads.append(("xmp", a + 4, d[4:], "xml"))
        elif kind == b"uuid" and b"<x:xmpmeta" in d[16:]:
            self.payloads.append(("xmp", a + 16, d[16:], "uuid"))
        elif kind == b"iref":
            self.out.issue("isobmff_structure_recognized_uninterpreted", "item references are not read", a, "info")
        elif "ilst/" in label and name in {*ITUNES_TEXT, *ITUNES_PAIRS, "cpil", "tmpo", "covr"}:
            self.atoms.append(("ilst", name, a, e, d))
        elif "udta/" in label and "ilst" not in label and name in UDTA_KEYS:
            self.atoms.append(("udta", name, a, e, d))

    def locate(self, d: bytes, a: int) -> None:
        version = d[0] if d else 0
        sizes = uint(d, 4, 2)
        if sizes is None:
            return self.cut("iloc", a)
        off_n, len_n, base_n, idx_n = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
        w = 4 if version > 1 else 2
        count, at = uint(d, 6, w), 6 + w

        def take(n):
            nonlocal at
            v = uint(d, at, n) if n else 0
            if v is None:
                raise ParseError("item locations end early")
            at += n
            return v

        for _ in range(count or 0):
            item = take(w)
            method = take(2) & 15 if version else 0
            take(2)
            base, extents = take(base_n), []
            for _ in range(take(2)):
                take(idx_n)
                extents.append((base + take(off_n), take(len_n)))
            self.places.setdefault(item, (method, extents, a))

    def associate(self, d: bytes, a: int) -> None:
        count, at = uint(d, 4, 4), 8
        if count is None:
            return self.cut("ipma", a)
        w, wide = (4 if d[0] else 2), bool(d[3] & 1)
        for _ in range(count):
            item, n = uint(d, at, w), uint(d, at + w, 1)
            if n is None:
                raise ParseError("property associations end early")
            at += w + 1
            props = [(uint(d, at + k * (1 + wide), 1 + wide) or 0) & (0x7FFF if wide else 0x7F) for k in range(n)]
            at += n * (1 + wide)
            self.links.setdefault(item, props)

    def item_payloads(self) -> None:
        """Payloads of items, by joining items to their places."""
        out = self.out
        for item, (kind, mime) in self.items.items():
            if kind not in (b"Exif", b"iptc", b"mime") or item not in self.places:
                continue
            what = {b"Exif": "exif", b"iptc": "iptc"}.get(kind) or MIMES.get(mime)
            if not what:
                out.issue("isobmff_mime_payload_unsupported", "content type is not read", None, "info")
                continue
            method, extents, a = self.places[item]
            if len(extents) != 1:
                out.issue("isobmff_item_multi_extent_unsupported", "item has not one extent", a, "info")
                continue
            if method > 1:
                out.issue("isobmff_item_construction_unsupported", "construction method is not read", a, "info")
                continue
            if method == 1 and not self.idat:
                out.issue("isobmff_item_idat_missing", "item data box is missing", a, "info")
                continue
            start = extents[0][0] + (self.idat[0] if method else 0)
            stop = start + extents[0][1]
            if stop > (self.idat[1] if method else len(self.b)):
                out.issue("isobmff_item_payload_out_of_bounds", "item lies outside the data", a)
                continue
            self.payloads.append((what, start, self.b[start:stop], "item"))


def _exif(out: Out, d: bytes, at: int) -> None:
    for skip in ((uint(d, 0, 4) or 0) + 4, 0):
        if d[skip : skip + 2] in (b"II", b"MM"):
            if t := _tiff(out, d[skip:], at + skip, False, False):
                N.exif(out, t)
            return


def _data_box(d: bytes) -> tuple[int, bytes] | None:
    size = uint(d, 0, 4)
    return ((uint(d, 8, 4) & 0xFFFFFF), d[16:size]) if size and 16 <= size <= len(d) and d[4:8] == b"data" else None


def _itunes(out: Out, name: str, a: int, e: int, d: bytes) -> None:
    found = _data_box(d)
    if not found:
        return
    kind, body = found
    put = lambda tag, v: out.entry("itunes", name, tag, v, "itunes_ilst", a, e, [f"decoded from itunes {name}"])
    if name in ITUNES_TEXT:
        if s := (utf8(body) or "").strip("\0"):
            put(ITUNES_TEXT[name], text(s))
    elif name in ITUNES_PAIRS and len(body) >= 6:
        put(ITUNES_PAIRS[name], text(f"{uint(body, 2, 2)}/{uint(body, 4, 2)}"))
    elif name == "cpil" and body:
        put("Compilation", integer(int(body[0] != 0)))
    elif name == "tmpo" and len(body) in (1, 2, 4, 8):
        put("BeatsPerMinute", integer(int.from_bytes(body, "big", signed=True)))
    elif name == "covr" and body:
        put("CoverArt", raw(body))


def _udta_text(d: bytes) -> str | None:
    n = uint(d, 0, 2)
    for b in ([d[4 : 4 + n]] if n is not None and 4 + n <= len(d) else []) + [d]:
        s = (utf8(b) or "").rstrip("\0")
        if s and all(" " <= c <= "~" for c in s):
            return s
    return None


def _udta(out: Out, name: str, a: int, e: int, d: bytes) -> None:
    s = _udta_text(d)
    if s is None:
        return
    put = lambda ns, tag, v, ident=None: out.entry(ns, ident or tag, tag, v, f"udta/{name}", a, e, [f"decoded from classic udta text atom {name}"], "quicktime-udta")
    if name == "©xyz":
        parts = [N.parse_number(x.rstrip("/")) for x in re.findall(r"^[^+-]+|[+-][^+-]*", s)]
        for tag, v in zip(("GPSLatitude", "GPSLongitude", "GPSAltitude"), parts):
            if v is not None:
                put("quicktime", tag, number(v))
    elif name in UDTA_DJI:
        if (v := N.parse_number(s)) is not None:
            put("dji", UDTA_DJI[name], number(v))
    elif name in UDTA_DJI_TEXT:
        put("dji", UDTA_DJI_TEXT[name], text(s))
    else:
        put("quicktime", name, text(s))


def isobmff(b: bytes, fmt: str, deep: bool) -> Out:
    out = Out("isobmff", len(b), deep)
    m = Media(b, out)
    m.item_payloads()
    if not deep:
        return out
    for kind, at, d, path in m.payloads:
        if kind == "exif":
            _exif(out, d, at)
        elif kind == "xmp" and not N.rtmd(out, d, at):
            N.xmp(out, d, at)
    for kind, at, d, path in m.payloads:
        if kind == "icc":
            _named(out, "icc", N.icc(out, d, at, path))
    for kind, at, d, path in m.payloads:
        if kind == "iptc":
            _named(out, "iptc", N.iptc(out, d, at, "heif_iptc"))
    for where, name, a, e, d in m.atoms:
        if where == "ilst" and name in QUICKTIME_TEXT and (found := _data_box(d)) and (s := (utf8(found[1]) or "").strip("\0")):
            out.entry("quicktime", name, QUICKTIME_TEXT[name], text(s), "ilst", a, e)
    for where, name, a, e, d in m.atoms:
        if where == "udta":
            _udta(out, name, a, e, d)
    fact = lambda ns, tag, v, note: out.entry(ns, tag, tag, v, notes=[note])
    if fmt == "heif":
        spans = [m.spans[k - 1] for k in m.links.get(m.primary, ()) if 0 < k <= len(m.spans)]
        for tag, v in zip(("ImageWidth", "ImageHeight"), spans[0] if spans else ()):
            fact("heif", tag, integer(v), "derived from primary item properties")
    video = next((t for t in m.tracks if t.get("kind") == b"vide"), None)
    audio = next((t for t in m.tracks if t.get("kind") == b"soun"), None)
    if video and all(video.get("size", (0, 0))):
        for tag, v in zip(("ImageWidth", "ImageHeight"), video["size"]):
            fact("quicktime", tag, integer(v), "derived from video track header")
    seconds = lambda t: t[3] / t[2] if t and t[2] and t[3] else None
    duration = seconds(m.movie) or max((x for t in m.tracks if (x := seconds(t.get("times")))), default=None)
    if duration is not None:
        fact("quicktime", "DurationSeconds", number(duration), "derived from mvhd or media track timing")
    if video and video.get("codec"):
        fact("quicktime", "VideoCodec", text(video["codec"]), "derived from video track sample description")
    if audio and audio.get("codec"):
        fact("quicktime", "AudioCodec", text(audio["codec"]), "derived from audio track sample description")
    if video and video.get("delta") and video.get("times"):
        fact("quicktime", "VideoFrameRate", number(video["times"][2] / video["delta"]), "derived from video track timing")
    if video:
        rate, span = video.get("average"), seconds(video.get("times"))
        if not rate and video.get("bytes") and span:
            rate = math.floor(video["bytes"] * 8 / span + 0.5)
        if rate and 1 <= rate < 1 << 32:
            fact("quicktime", "VideoBitrate", integer(rate), "derived from video track metadata")
    if audio and audio.get("channels"):
        fact("quicktime", "AudioChannels", integer(audio["channels"]), "derived from audio track sample entry")
    if audio and audio.get("rate") and audio["rate"] >> 16:
        fact("quicktime", "AudioSampleRate", integer(audio["rate"] >> 16), "derived from audio track sample entry")
    for tag, k, what in (("CreateDate", 0, "creation"), ("ModifyDate", 1, "modification")):
        if m.movie and (s := iso_time(m.movie[k])):
            fact("quicktime", tag, stamp(s), f"derived from movie header {what} time")
    if fmt == "m4a":
        for where, name, a, e, d in m.atoms:
            if where == "ilst":
                _itunes(out, name, a, e, d)
    return out
