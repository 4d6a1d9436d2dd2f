"""FLAC, AIFF and Ogg containers."""

from __future__ import annotations

from . import namespaces as N
from .base import Out, integer, number, text, uint


def _fact(out: Out, tag, value, path, note):
    out.entry(out.container, tag, tag, value, path, notes=[note])


def flac(b: bytes, _: str, deep: bool) -> Out:
    out, at, last, comments, pictures = Out("flac", len(b), deep), 4, False, [], []
    names = {0: "STREAMINFO", 1: "PADDING", 2: "APPLICATION", 3: "SEEKTABLE", 4: "VORBIS_COMMENT", 5: "CUESHEET", 6: "PICTURE"}
    info = None
    while not last and at < len(b):
        if at + 4 > len(b):
            out.issue("flac_block_header_out_of_bounds", "block header lies outside the data", at)
            break
        last, kind, size = bool(b[at] & 0x80), b[at] & 0x7F, uint(b, at + 1, 3)
        if at + 4 + size > len(b):
            out.issue("flac_malformed_block", "block length exceeds the data", at)
            break
        d = b[at + 4 : at + 4 + size]
        out.node("block", names.get(kind, f"BLOCK_{kind}"), at, at + 4 + size, "flac")
        if kind == 0 and info is None:
            if size < 18:
                out.issue("flac_streaminfo_invalid", "STREAMINFO is too short", at)
            else:
                bits = int.from_bytes(d[10:18], "big")
                info = (bits >> 44, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1)
                if not info[0]:
                    out.issue("flac_streaminfo_sample_rate_zero", "STREAMINFO has a sample rate of 0", at)
        elif kind == 4:
            comments.append((at + 4, d))
        elif kind == 6:
            pictures.append((at + 4, d))
        at += 4 + size
    if not last:
        out.issue("flac_last_block_flag_missing", "no block is marked as the last", at)
    if not deep:
        return out
    if info and info[0]:
        rate, channels, depth, samples = info
        note = "derived from STREAMINFO block"
        _fact(out, "AudioSampleRate", integer(rate), "streaminfo", note)
        _fact(out, "AudioChannels", integer(channels), "streaminfo", note)
        _fact(out, "AudioBitDepth", integer(depth), "streaminfo", note)
        if samples:
            _fact(out, "DurationSeconds", number(samples / rate), "streaminfo", "derived from STREAMINFO total_samples / sample_rate")
    for s, d in comments:
        if not N.vorbis_comment(out, d, s):
            out.issue("vorbis_comment_decode_empty", "recognized VORBIS_COMMENT block but decoded no entries", s, context="vorbis_comment")
    for s, d in pictures:
        mime = uint(d, 4, 4)
        label = uint(d, 8 + mime, 4) if mime is not None else None
        width, height = (uint(d, 12 + mime + label + k, 4) for k in (0, 4)) if label is not None else (None, None)
        if height is None:
            out.issue("flac_picture_invalid", "PICTURE block is too short", s)
            continue
        note = "derived from PICTURE block"
        _fact(out, "PictureMimeType", text(d[8 : 8 + mime].decode("utf-8", "replace")), "picture", note)
        _fact(out, "PictureWidth", integer(width), "picture", note)
        _fact(out, "PictureHeight", integer(height), "picture", note)
    return out


def extended(b: bytes) -> float:
    """An 80-bit float."""
    head, mantissa = int.from_bytes(b[:2], "big"), int.from_bytes(b[2:10], "big")
    sign, exponent = (-1.0 if head >> 15 else 1.0), head & 0x7FFF
    if not exponent and not mantissa:
        return 0.0
    if exponent == 0x7FFF:
        return sign * float("inf") if not mantissa << 1 & (1 << 64) - 1 else float("nan")
    try:
        return sign * mantissa * 2.0 ** (exponent - 16383 - 63)
    except OverflowError:
        return sign * float("inf")


def aiff(b: bytes, _: str, deep: bool) -> Out:
    out, at, comm = Out("aiff", len(b), deep), 12, None
    end = min(len(b), 8 + (uint(b, 4, 4) or 0))
    if 8 + (uint(b, 4, 4) or 0) > len(b):
        out.issue("aiff_form_size_truncated", "FORM size exceeds the data", 4)
    while at < end:
        if at + 8 > end:
            out.issue("aiff_chunk_header_truncated", "chunk header lies outside the form", at)
            break
        kind, size = b[at : at + 4], uint(b, at + 4, 4)
        if at + 8 + size > end:
            out.issue("aiff_chunk_length_invalid", "chunk length exceeds the form", at)
            break
        out.node("chunk", kind.decode("utf-8", "replace"), at, at + 8 + size, "aiff")
        if kind == b"COMM" and comm is None:
            comm = (at, b[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    if comm is None:
        out.issue("aiff_comm_missing", "no COMM chunk")
        return out
    at, d = comm
    if len(d) < 18:
        out.issue("aiff_comm_invalid", "COMM chunk is too short", at)
        return out
    rate = extended(d[8:18])
    good = 0 < rate < float("inf")
    if not good:
        out.issue("aiff_comm_invalid_rate", "COMM sample rate is not a positive number", at)
    if deep:
        note = "derived from AIFF COMM chunk"
        if good:
            _fact(out, "AudioSampleRate", integer(int(rate + 0.5)), "comm", note)
        _fact(out, "AudioChannels", integer(uint(d, 0, 2)), "comm", note)
        _fact(out, "AudioBitDepth", integer(uint(d, 6, 2)), "comm", note)
        if good:
            _fact(out, "DurationSeconds", number(uint(d, 2, 4) / rate), "comm", "derived from AIFF COMM num_sample_frames / sample_rate")
    return out


def ogg(b: bytes, _: str, deep: bool) -> Out:
    out, at, serial, granule, others = Out("ogg", len(b), deep), 0, None, None, False
    packets, open_, started = [], b"", None
    while at < len(b):
        if b[at : at + 4] != b"OggS":
            out.issue("ogg_page_magic_mismatch", "no page begins here", at)
            break
        n = uint(b, at + 26, 1)
        if n is None or at + 27 + n > len(b):
            out.issue("ogg_page_truncated", "page header lies outside the data", at)
            break
        if b[at + 4]:
            out.issue("ogg_page_version_unsupported", "page version is not 0", at)
            break
        lacing = b[at + 27 : at + 27 + n]
        body = at + 27 + n
        stop = body + sum(lacing)
        if stop > len(b):
            out.issue("ogg_page_truncated", "page body lies outside the data", at)
            break
        out.node("page", "OggS", at, stop, "ogg")
        mine = uint(b, at + 14, 4, "little")
        serial = mine if serial is None else serial
        if mine == serial:
            granule = int.from_bytes(b[at + 6 : at + 14], "little", signed=True)
            for size in lacing:
                started = body if not open_ else started
                if len(packets) < 2:
                    open_ += b[body : body + size]
                body += size
                if size < 255 and len(packets) < 2:
                    packets.append((started, open_))
                    open_ = b""
        elif not others:
            others = True
            out.issue("ogg_multiplexed_streams_unsupported", "only the first stream is read", at, "info")
        at = stop
    if not packets:
        out.issue("ogg_no_primary_packet", "no complete packet")
        return out
    start, head = packets[0]
    rest = packets[1] if len(packets) > 1 else None
    if head.startswith(b"\x01vorbis"):
        if len(head) < 28 or not uint(head, 12, 4, "little"):
            out.issue("ogg_vorbis_ident_invalid", "identification packet is invalid", start)
            return out
        codec, rate, channels, skip, prefix = "vorbis", uint(head, 12, 4, "little"), head[11], 0, b"\x03vorbis"
        facts = [("AudioSampleRate", integer(rate)), ("AudioChannels", integer(channels)), ("AudioBitDepth", integer(16)), ("AudioCodec", text(codec))]
    elif head.startswith(b"OpusHead"):
        if len(head) < 19:
            out.issue("ogg_opus_ident_invalid", "identification packet is invalid", start)
            return out
        codec, rate, channels, skip, prefix = "opus", 48000, head[9], uint(head, 10, 2, "little"), b"OpusTags"
        facts = [("AudioSampleRate", integer(rate)), ("AudioChannels", integer(channels)), ("AudioCodec", text(codec)), ("OpusInputSampleRate", integer(uint(head, 12, 4, "little")))]
    else:
        out.issue("ogg_codec_unrecognized", "first packet is of an unknown codec", start)
        return out
    if granule is None or granule < 0:
        out.issue("ogg_granule_missing", "no granule position")
        granule = None
    if deep:
        for tag, value in facts:
            _fact(out, tag, value, f"{codec}_ident", f"derived from {codec} identification packet")
        if granule is not None:
            _fact(out, "DurationSeconds", number(max(granule - skip, 0) / rate), f"{codec}_ident", "derived from last granule position")
    if rest:
        if not rest[1].startswith(prefix):
            out.issue("ogg_vorbis_comment_prefix_missing" if codec == "vorbis" else "ogg_opus_tags_prefix_missing", "second packet has no comment prefix", rest[0])
        elif deep and not N.vorbis_comment(out, rest[1][len(prefix) :], rest[0] + len(prefix)):
            out.issue("ogg_vorbis_comment_decode_empty", "recognized comment packet but decoded no entries", rest[0], context="vorbis_comment")
    return out
