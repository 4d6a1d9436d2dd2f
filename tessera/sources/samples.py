"""Small synthetic media files, built byte by byte: for tests, and for a query that needs media without having any."""

from __future__ import annotations

import struct
import zlib


def tiff(ifd0: list, exif: list = (), gps: list = (), order: str = "<") -> bytes:
    """Directories of (tag, type, count, bytes or int)."""
    dirs = [("", list(ifd0))]
    if exif:
        dirs.append((0x8769, list(exif)))
    if gps:
        dirs.append((0x8825, list(gps)))
    for tag, _ in dirs[1:]:
        dirs[0][1].append((tag, 4, 1, 0))
    at, starts = 8, []
    for _, entries in dirs:
        starts.append(at)
        at += 6 + 12 * len(entries)
    body, extra = b"", b""
    for k, (_, entries) in enumerate(dirs):
        rows = b""
        for tag, kind, count, value in sorted(entries, key=lambda e: e[0]):
            if k == 0 and tag in (0x8769, 0x8825):
                value = starts[[t for t, _ in dirs].index(tag)]
            raw = value if isinstance(value, bytes) else struct.pack(order + ("H" if kind == 3 else "I"), value)
            if len(raw) > 4:
                raw, extra = struct.pack(order + "I", at + len(extra)), extra + raw + b"\0" * (len(raw) % 2)
            rows += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
        body += struct.pack(order + "H", len(entries)) + rows + b"\0\0\0\0"
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body + extra


def text(tag: int, s: str):
    b = s.encode() + b"\0"
    return (tag, 2, len(b), b)


def ratio(tag: int, *pairs, order: str = "<"):
    return (tag, 5, len(pairs), b"".join(struct.pack(order + "II", *p) for p in pairs))


def camera_tiff(order: str = "<", gps: bool = False, **how) -> bytes:
    r = lambda tag, *p: ratio(tag, *p, order=order)
    ifd0 = [text(0x010F, "SampleCam"), text(0x0110, how.get("model", "One")), text(0x0131, "SampleGen"), (0x0100, 4, 1, 800), (0x0101, 4, 1, 600), (0x0112, 3, 1, 1), text(0x0132, "2024:04:16 12:34:56")]
    exif = [text(0x9003, "2024:04:16 12:34:56"), text(0x9004, "2024:04:16 12:34:56"), r(0x829A, (1, 250)), r(0x829D, (56, 10)), (0x8827, 3, 1, 200), r(0x920A, (50, 1)), text(0xA434, "Sample 50mm F2")]
    exif += [text(t, s) for t, s in how.get("more", ())]
    where = [text(1, "N"), r(2, (40, 1), (26, 1), (4632, 100)), text(3, "W"), r(4, (79, 1), (58, 1), (5556, 100))]
    return tiff(ifd0, exif, where if gps else (), order)


def xmp(**properties) -> bytes:
    names = {"model": "tiff:Model", "created": "xmp:CreateDate", "tool": "xmp:CreatorTool", "width": "tiff:ImageWidth"}
    attributes = " ".join(f'{names[k]}="{v}"' for k, v in properties.items() if k in names)
    items = "".join(f"<rdf:li>{x}</rdf:li>" for x in properties.get("keywords", ()))
    return f'<x:xmpmeta><rdf:RDF><rdf:Description {attributes}><dc:creator><rdf:Seq><rdf:li>K &amp; Co</rdf:li></rdf:Seq></dc:creator><dc:subject><rdf:Bag>{items}</rdf:Bag></dc:subject></rdf:Description></rdf:RDF></x:xmpmeta>'.encode()


def iptc(*datasets) -> bytes:
    return b"".join(bytes([0x1C, 2, k]) + struct.pack(">H", len(s.encode())) + s.encode() for k, s in datasets)


def icc(name: str = "Sample RGB") -> bytes:
    b = bytearray(128)
    for at, s in ((12, b"mntr"), (16, b"RGB "), (20, b"XYZ "), (48, b"SMPL"), (52, b"TEST")):
        b[at : at + 4] = s
    raw = name.encode() + b"\0"
    desc = b"desc\0\0\0\0" + struct.pack(">I", len(raw)) + raw
    return bytes(b) + struct.pack(">I4sII", 1, b"desc", 144, len(desc)) + desc


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(bytes([0xFF, 0xE0 + k]) + struct.pack(">H", len(d) + 2) + d for k, d in segments) + b"\xff\xd9"


def exif_app1(t: bytes) -> tuple[int, bytes]:
    return 1, b"Exif\0\0" + t


def png(*chunks: tuple[bytes, bytes], end: bool = True) -> bytes:
    all_ = [(b"IHDR", b"\0" * 13), *chunks] + [(b"IEND", b"")] * end
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in all_)


def webp(*chunks: tuple[bytes, bytes]) -> bytes:
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind: bytes, *parts: bytes) -> bytes:
    d = b"".join(parts)
    return struct.pack(">I", len(d) + 8) + kind + d


def movie(brand: bytes = b"isom", created: int = 2082844800 + 1713270896, udta: bytes = b"", ilst: bytes = b"") -> bytes:
    head = lambda scale, n: struct.pack(">IIIII", 0, created, created, scale, n)
    tkhd = lambda w, h: b"\0" * 76 + struct.pack(">II", w << 16, h << 16)
    hdlr = lambda k: b"\0" * 8 + k + b"\0" * 12
    avc = struct.pack(">I", 86 + 20) + b"avc1" + b"\0" * 78 + box(b"btrt", struct.pack(">III", 0, 0, 24_000_000))
    mp4a = struct.pack(">I", 36) + b"mp4a" + b"\0" * 16 + struct.pack(">HHI", 2, 16, 0) + struct.pack(">I", 48000 << 16)
    trak = lambda w, h, k, scale, entry, delta: box(b"trak", box(b"tkhd", tkhd(w, h)), box(b"mdia", box(b"mdhd", head(scale, scale * 12)), box(b"hdlr", hdlr(k)), box(b"minf", box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1) + entry), box(b"stts", struct.pack(">IIII", 0, 1, 288, delta))))))
    meta = box(b"meta", b"\0" * 4, box(b"ilst", ilst)) if ilst else b""
    extra = box(b"udta", udta + meta) if udta or meta else b""
    moov = box(b"moov", box(b"mvhd", head(1000, 12000)), trak(1920, 1080, b"vide", 24000, avc, 1001), trak(0, 0, b"soun", 48000, mp4a, 1024), extra)
    return box(b"ftyp", brand, b"\0\0\2\0", brand) + moov


def data_atom(key: bytes, value: bytes, kind: int = 1) -> bytes:
    return box(key, box(b"data", struct.pack(">II", kind, 0), value))


def heif(exif: bytes) -> bytes:
    """One primary item with a size, and an Exif item in the file's data."""
    item = struct.pack(">I", 0) + exif

    def build(at: int) -> bytes:
        infe = lambda n, k: box(b"infe", b"\2\0\0\0", struct.pack(">HH", n, 0), k + b"\0")
        iloc = box(b"iloc", struct.pack(">IBBH", 0, 0x44, 0, 1), struct.pack(">HHHII", 2, 0, 1, at, len(item)))
        iprp = box(b"iprp", box(b"ipco", box(b"ispe", struct.pack(">III", 0, 320, 240))), box(b"ipma", struct.pack(">IIHBB", 0, 1, 1, 1, 1)))
        meta = box(b"meta", b"\0" * 4, box(b"hdlr", b"\0" * 24), box(b"pitm", struct.pack(">IH", 0, 1)), box(b"iinf", struct.pack(">IH", 0, 2), infe(1, b"hvc1"), infe(2, b"Exif")), iloc, iprp)
        return box(b"ftyp", b"heic", b"\0\0\0\0", b"mif1") + meta

    return build(len(build(0)) + 8) + box(b"mdat", item)


def vorbis_comments(*items: str) -> bytes:
    part = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return part("sample") + struct.pack("<I", len(items)) + b"".join(map(part, items))


def flac() -> bytes:
    bits = 44100 << 44 | 1 << 41 | 15 << 36 | 44100
    block = lambda k, d, last=0: bytes([last << 7 | k]) + struct.pack(">I", len(d))[1:] + d
    return b"fLaC" + block(0, b"\0" * 10 + bits.to_bytes(8, "big") + b"\0" * 16) + block(4, vorbis_comments("TITLE=Song", "mood=calm"), 1)


def aiff() -> bytes:
    comm = struct.pack(">hIh", 2, 44100, 16) + bytes.fromhex("400eac44000000000000")
    body = b"AIFF" + b"COMM" + struct.pack(">I", len(comm)) + comm
    return b"FORM" + struct.pack(">I", len(body)) + body


def page(granule: int, *packets: bytes, serial: int = 7) -> bytes:
    lacing = b"".join(bytes([255] * (len(p) // 255) + [len(p) % 255]) for p in packets)
    return b"OggS\0\0" + struct.pack("<qIII", granule, serial, 0, 0) + bytes([len(lacing)]) + lacing + b"".join(packets)


def ogg() -> bytes:
    ident = b"\x01vorbis" + struct.pack("<IBI", 0, 2, 44100) + b"\0" * 14
    return page(0, ident) + page(44100, b"\x03vorbis" + vorbis_comments("ARTIST=Me", "X=" + "y" * 600))


def opus() -> bytes:
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, 44100, 0, 0)
    return page(0, head) + page(48312, b"OpusTags" + vorbis_comments("TITLE=Opus"))


def all_samples() -> dict[str, bytes]:
    photo = camera_tiff()
    return {
        "plain.jpg": jpeg(exif_app1(photo)),
        "gps.jpg": jpeg(exif_app1(camera_tiff(gps=True))),
        "rich.jpg": jpeg(exif_app1(photo), (2, b"ICC_PROFILE\0\1\1" + icc()), (13, b"Photoshop 3.0\0" + b"8BIM\x04\x04\0\0" + struct.pack(">I", len(d := iptc((105, "Head"), (80, "Kai"), (25, "sea"), (25, "sky")))) + d), (1, b"http://ns.adobe.com/xap/1.0/\0" + xmp(model="Two", created="2024-04-16T12:34:56", width=640, keywords=["a", "b"]))),
        "broken.jpg": b"\xff\xd8\xff\xe1\xff\xff",
        "badtiff.jpg": jpeg(exif_app1(b"XX")),
        "big.tif": camera_tiff(">"),
        "raw.dng": tiff([text(0x010F, "RawCam"), (0x0100, 4, 1, 800), (0x0101, 4, 1, 600), (0xC612, 1, 4, b"\1\4\0\0")], [(0x8827, 3, 1, 400)]),
        "mixed.png": png((b"eXIf", photo), (b"iTXt", b"XML:com.adobe.xmp\0\0\0\0\0" + xmp(model="Two", created="2024-04-16T12:34:56")), (b"iCCP", b"p\0\0" + zlib.compress(icc()))),
        "noend.png": png(end=False),
        "both.webp": webp((b"XMP ", xmp(model="Two", created="2024-04-16T12:34:56")), (b"EXIF", photo)),
        "still.heic": heif(photo),
        "clip.mp4": movie(udta=box(b"\xa9xyz", struct.pack(">HH", 17, 0) + b"+40.7922-073.9584") + box(b"\xa9fyw", struct.pack(">HH", 7, 0) + b"+175.50") + box(b"\xa9mdl", struct.pack(">HH", 6, 0) + b"FC3682")),
        "clip.mov": movie(b"qt  "),
        "song.m4a": movie(b"M4A ", ilst=data_atom(b"\xa9nam", b"Song") + data_atom(b"\xa9ART", b"Kai") + data_atom(b"trkn", b"\0\0\0\3\0\7\0\0", 0) + data_atom(b"cpil", b"\1", 21)),
        "song.flac": flac(),
        "song.aiff": aiff(),
        "song.ogg": ogg(),
        "song.opus": opus(),
        "none.bin": b"no media at all",
    }
