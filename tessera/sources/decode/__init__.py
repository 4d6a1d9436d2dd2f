"""Decoding of one asset: never raises, always one result."""

from __future__ import annotations

from . import audio, boxes, images
from .base import Out, ParseError
from .ranged import Ranged, detect

DECODERS = {"jpeg": images.jpeg, "png": images.png, "webp": images.webp, "tiff": images.tiff, "dng": images.tiff, "flac": audio.flac, "aiff": audio.aiff, "ogg": audio.ogg, **dict.fromkeys(("heif", "mp4", "mov", "m4a"), boxes.isobmff)}
EMPTY = {"status": None, "error_message": None, "detected_format": None, "container": None, "nodes": [], "entries": [], "issues": []}


def decode(content: bytes | None, fmt: str | None, probe: bool = False) -> dict:
    """fmt: as told by leading bytes. status: ok, io_error, unsupported_format, parse_error or internal_error."""
    if content is None:
        return EMPTY | {"status": "io_error", "error_message": "no content"}
    if fmt is None:
        return EMPTY | {"status": "unsupported_format", "error_message": "no known signature"}
    try:
        if fmt == "tiff" and images.is_dng(content):
            fmt = "dng"
        out: Out = DECODERS[fmt](content, fmt, not probe)
    except ParseError as e:
        return EMPTY | {"status": "parse_error", "error_message": str(e), "detected_format": fmt}
    except Exception as e:  # one bad asset must not fail a job over many
        return EMPTY | {"status": "internal_error", "error_message": f"{type(e).__name__}: {e}", "detected_format": fmt}
    if not out.entries:
        out.issue("no_metadata_entries", "no metadata entries were decoded", severity="info")
    return EMPTY | {"status": "ok", "detected_format": fmt, "container": out.container, "nodes": out.nodes, "entries": out.entries, "issues": out.issues}


def decode_file(path: str, probe: bool = False, formats=None) -> dict | None:
    """The same for a file read in ranges; None if its format is not among formats."""
    try:
        content = Ranged(path)
    except Exception as e:
        return EMPTY | {"status": "io_error", "error_message": f"no content, and not read by path: {type(e).__name__}: {e}"}
    try:
        fmt = detect(content)
        if fmt == "tiff" and images.is_dng(content):
            fmt = "dng"
        return None if formats and fmt not in formats else decode(content, fmt, probe)
    except OSError as e:
        return EMPTY | {"status": "io_error", "error_message": f"{type(e).__name__}: {e}"}
    finally:
        content.close()
