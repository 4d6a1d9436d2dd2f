"""Large files read by path, in the ranges that a decoder asks for."""

from __future__ import annotations

from urllib.parse import quote

from pyarrow import fs

from ...functions.scalars import HEIF_BRANDS, M4A_BRANDS, MP4_BRANDS
from .base import uint

BLOCK = 1 << 16


class Ranged:
    """A file that is sliced like bytes; the last block is kept."""

    def __init__(self, path: str):
        scheme, colon, rest = path.partition(":")
        if not colon or scheme == "file":
            system, name = fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
        else:
            system, name = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + quote(rest))
        self.file = system.open_input_file(name)
        self.size, self.at, self.block = self.file.size(), 0, b""

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, k):
        if isinstance(k, slice):
            a, e, _ = k.indices(self.size)
            return self.read(a, e) if a < e else b""
        k += self.size if k < 0 else 0
        if not 0 <= k < self.size:
            raise IndexError(k)
        return self.read(k, k + 1)[0]

    def read(self, a: int, e: int) -> bytes:
        if e - a > BLOCK:
            return self.file.read_at(e - a, a)
        if not self.at <= a <= e <= self.at + len(self.block):
            self.at, self.block = a, self.file.read_at(min(BLOCK, self.size - a), a)
        return self.block[a - self.at : e - self.at]

    def startswith(self, b: bytes) -> bool:
        return self[: len(b)] == b

    def find(self, b: bytes, at: int = 0, end: int | None = None) -> int:
        end = self.size if end is None else min(end, self.size)
        while at + len(b) <= end:
            part = self[at : min(at + 64 * BLOCK, end)]
            if (k := part.find(b)) >= 0:
                return at + k
            at += max(1, len(part) - len(b) + 1)
        return -1

    def close(self) -> None:
        self.file.close()


def detect(b) -> str | None:
    """The format as functions.scalars.detect_format tells it."""
    head = b[:16]
    # Signatures.
    for name, at, mark in (("jpeg", 0, b"\xff\xd8"), ("png", 0, b"\x89PNG\r\n\x1a\n"), ("tiff", 0, b"II*\0"), ("tiff", 0, b"MM\0*"), ("flac", 0, b"fLaC"), ("ogg", 0, b"OggS")):
        if head[at : at + len(mark)] == mark:
            return name
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "webp"
    if head[:4] == b"FORM" and head[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if head[4:8] != b"ftyp":
        return None
    size = uint(head, 0, 4)
    size = min(uint(head, 8, 8) if size == 1 else size or len(b), len(b))
    has = lambda names: head[8:12] in names or any(b[k : k + 4] in names for k in range(16, size - 3, 4))
    return "heif" if has(HEIF_BRANDS) else "mov" if head[8:12] == b"qt  " else "m4a" if head[8:12] in M4A_BRANDS else "mp4" if has(MP4_BRANDS) else None
