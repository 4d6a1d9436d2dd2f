"""JPEG, TIFF, PNG and WebP containers."""

from __future__ import annotations

import re
import zlib

from . import makernotes
from . import namespaces as N
from .base import Out, ParseError, uint


def _named(out: Out, what: str, made: int) -> None:
    if not made:
        out.issue(f"{what}_decode_empty", f"recognized {what.upper()} payload but decoded no entries", severity="warning", context=what)


def _tiff(out: Out, data: bytes, base: int, fatal: bool, report: bool = True) -> N.Tiff | None:
    try:
        t = N.Tiff(data, base)
    except ValueError as e:
        if fatal:
            raise ParseError(str(e)) from e
        return None
    if report:
        for code, message, at in t.issues:
            out.issue(code, message, at)
    return t


def tiff(b: bytes, name: str, deep: bool) -> Out:
    out = Out(name, len(b), deep)
    t = _tiff(out, b, 0, True)
    for label, a, e in t.directories:
        out.node("ifd", label, a, e, "tiff")
    if deep:
        N.exif(out, t)
        makernotes.maker_notes(out, t)
        if p := t.payload(0x02BC):
            _named(out, "xmp", N.xmp(out, p[1], p[0]))
        if p := t.payload(0x8773):
            _named(out, "icc", N.icc(out, p[1], p[0], "icc_profile"))
        if p := t.payload(0x83BB):
            _named(out, "iptc", N.iptc(out, p[1], p[0], "iptc"))
    return out


def is_dng(b: bytes) -> bool:
    try:
        return any(tag == 0xC612 and d == "ifd0" for d, tag, *_ in N.Tiff(b).slots)
    except ValueError:
        return False


XMP_HEAD = b"http://ns.adobe.com/xap/1.0/\0"


def jpeg(b: bytes, _: str, deep: bool) -> Out:
    out, at, apps = Out("jpeg", len(b), deep), 2, []
    while at + 2 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xD9:
            out.node("segment", "EOI", at, at + 2, "jpeg")
            break
        if marker == 0xDA:
            out.node("segment", "SOS", at, len(b), "jpeg")
            break
        size = uint(b, at + 2, 2)
        if size is None or size < 2 or at + 2 + size > len(b):
            out.issue("jpeg_segment_length_invalid", "segment length exceeds the data or is below 2", at)
            break
        app = 0xE0 <= marker <= 0xEF
        out.node("segment", f"APP{marker - 0xE0:X}" if app else f"marker_{marker:02X}", at, at + 2 + size, "jpeg")
        if app:
            apps.append((marker - 0xE0, at + 4, b[at + 4 : at + 2 + size]))
        at += 2 + size
    first = next(((s, d) for k, s, d in apps if k == 1 and d.startswith(b"Exif\0\0")), None)
    t = _tiff(out, first[1][6:], first[0] + 6, True) if first else None
    if not deep:
        return out
    if t:
        N.exif(out, t)
        makernotes.maker_notes(out, t)
    for k, s, d in apps:
        if k == 2 and d.startswith(b"ICC_PROFILE\0"):
            _named(out, "icc", N.icc(out, d, s, "app2_icc"))
    for k, s, d in apps:
        if k == 13 and d.startswith(b"Photoshop 3.0\0"):
            _named(out, "iptc", N.iptc(out, d, s, "app13_iptc"))
    for k, s, d in apps:
        if k == 1 and d.startswith(XMP_HEAD):
            _named(out, "xmp", N.xmp(out, d[len(XMP_HEAD) :], s + len(XMP_HEAD)))
    return out


def _inflate(b: bytes) -> bytes | None:
    """The whole inflated stream; None if it is broken or cut."""
    try:
        stream = zlib.decompressobj()
        out = stream.decompress(b)
        return out if stream.eof else None
    except zlib.error:
        return None


def _png_text(kind: bytes, d: bytes) -> tuple[bytes, bytes] | None:
    """Keyword and text of a text chunk."""
    key, nul, rest = d.partition(b"\0")
    if not nul:
        return None
    if kind == b"tEXt":
        return key, rest
    if kind == b"zTXt":
        body = _inflate(rest[1:])
        return None if body is None else (key, body)
    packed, parts = rest[:1], rest[2:].split(b"\0", 2)
    if len(parts) < 3:
        return None
    body = _inflate(parts[2]) if packed == b"\1" else parts[2]
    return None if body is None else (key, body)


def _raw_profile(b: bytes) -> bytes | None:
    """Bytes of a hexadecimal profile with name and length before it; b itself if it is not one."""
    m = re.match(rb"\s*[A-Za-z0-9]+\s+(\d+)\s+([0-9A-Fa-f\s]+)$", b)
    if not m:
        return b
    digits = re.sub(rb"\s", b"", m[2])
    return bytes.fromhex(digits.decode()) if len(digits) % 2 == 0 else None


def png(b: bytes, _: str, deep: bool) -> Out:
    out, at, chunks, ended = Out("png", len(b), deep), 8, [], False
    while at < len(b):
        if at + 8 > len(b):
            out.issue("png_chunk_header_out_of_bounds", "chunk header lies outside the data", at)
            break
        size, kind = uint(b, at, 4), b[at + 4 : at + 8]
        if at + 12 + size > len(b):
            out.issue("png_chunk_length_invalid", "chunk length exceeds the data", at)
            break
        out.node("chunk", kind.decode("utf-8", "replace"), at, at + 12 + size, "png")
        chunks.append((kind, at + 8, b[at + 8 : at + 8 + size]))
        at += 12 + size
        if kind == b"IEND":
            ended = True
            break
    if not ended:
        out.issue("png_missing_iend", "no IEND chunk", at)
    if not deep:
        return out
    for kind, s, d in chunks:
        if kind == b"eXIf" and (t := _tiff(out, d, s, False, False)):
            N.exif(out, t)
    texts = [(s, _png_text(k, d), len(d)) for k, s, d in chunks if k in (b"iTXt", b"tEXt", b"zTXt")]
    for s, t, _n in texts:
        if t and t[0] == b"XML:com.adobe.xmp":
            N.xmp(out, t[1], s)
    for s, t, _n in texts:
        if t and (t[0] == b"IPTC-NAA" or t[0].lower() in (b"raw profile type iptc", b"iptc", b"raw profile type 8bim")):
            body = _raw_profile(t[1])
            if body is None:
                out.issue("png_iptc_payload_invalid", "IPTC profile is not hexadecimal", s, context="iptc")
            else:
                _named(out, "iptc", N.iptc(out, body, s, "png_iptc"))
    for kind, s, d in chunks:
        if kind == b"iCCP":
            body = _inflate(d.partition(b"\0")[2][1:])
            if body is None:
                out.issue("png_icc_payload_invalid", "ICC profile cannot be inflated", s, context="icc")
            else:
                _named(out, "icc", N.icc(out, body, s, "iCCP"))
    return out


def webp(b: bytes, _: str, deep: bool) -> Out:
    out, at, chunks = Out("webp", len(b), deep), 12, []
    if (size := uint(b, 4, 4, "little")) is not None and size + 8 != len(b):
        out.issue("riff_size_mismatch", "RIFF size differs from the data's", 4)
    while at < len(b):
        if at + 8 > len(b):
            out.issue("riff_chunk_header_out_of_bounds", "chunk header lies outside the data", at)
            break
        kind, size = b[at : at + 4], uint(b, at + 4, 4, "little")
        if at + 8 + size > len(b):
            out.issue("riff_chunk_length_invalid", "chunk length exceeds the data", at)
            break
        out.node("chunk", kind.decode("utf-8", "replace"), at, at + 8 + size, "webp")
        chunks.append((kind, at + 8, b[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    if not deep:
        return out
    for want in (b"XMP ", b"EXIF", b"IPTC", b"ICCP"):
        for kind, s, d in chunks:
            if kind != want:
                continue
            if kind == b"XMP ":
                N.xmp(out, d, s)
            elif kind == b"EXIF":
                skip = 6 if d.startswith(b"Exif\0\0") else 0
                if t := _tiff(out, d[skip:], s + skip, False, False):
                    N.exif(out, t)
            elif kind == b"IPTC":
                _named(out, "iptc", N.iptc(out, d, s, "webp_iptc"))
            else:
                _named(out, "icc", N.icc(out, d, s, "webp_icc"))
    return out
