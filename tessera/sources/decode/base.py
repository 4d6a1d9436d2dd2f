"""What a decoder collects, and bounds-checked reads. Plain Python: called per asset inside one Arrow stage."""

from __future__ import annotations


class ParseError(Exception):
    """The asset as a whole cannot be read."""


def uint(b: bytes, at: int, n: int, order: str = "big") -> int | None:
    return int.from_bytes(b[at : at + n], order) if at >= 0 and at + n <= len(b) else None


def sint(b: bytes, at: int, n: int, order: str = "big") -> int | None:
    return int.from_bytes(b[at : at + n], order, signed=True) if at >= 0 and at + n <= len(b) else None


def fourcc(b: bytes) -> str:
    return "".join("©" if c == 0xA9 else chr(c) if c < 128 else "�" for c in b)


def utf8(b: bytes) -> str | None:
    try:
        return b.decode("utf-8")
    except UnicodeDecodeError:
        return None


class Value(dict):
    """A tagged value as a row."""


def text(s: str) -> Value:
    return Value(kind="string", s=s)


def stamp(s: str) -> Value:
    return Value(kind="timestamp", s=s)


def integer(i: int) -> Value:
    return Value(kind="integer", i=i)


def number(d: float) -> Value:
    return Value(kind="float", d=d)


def rational(n: int, d: int) -> Value:
    return Value(kind="rational", r={"numerator": n, "denominator": d})


def rationals(pairs) -> Value:
    return Value(kind="rational_list", rl=[{"numerator": n, "denominator": d} for n, d in pairs])


def raw(b: bytes) -> Value:
    return Value(kind="bytes", b=bytes(b))


class Out:
    """Nodes, entries and issues of an asset, in order. deep: whether namespaces are decoded (not for a probe)."""

    def __init__(self, container: str, size: int, deep: bool = True):
        self.container, self.deep = container, deep
        self.nodes, self.entries, self.issues = [], [], []
        self.node("container", container, 0, size)

    def node(self, kind, label, start, end, parent=None):
        self.nodes.append({"ord": len(self.nodes), "kind": kind, "label": label, "offset_start": start, "offset_end": end, "parent_label": parent})

    def issue(self, code, message, offset=None, severity="warning", context=None):
        self.issues.append({"ord": len(self.issues), "severity": severity, "code": code, "message": message, "offset": offset, "context": context})

    def entry(self, namespace, tag_id, tag_name, value, path=None, start=None, end=None, notes=(), source=None):
        at = {"container": self.container, "namespace": source or namespace, "path": path, "offset_start": start, "offset_end": end, "notes": []}
        self.entries.append({"ord": len(self.entries), "namespace": namespace, "tag_id": tag_id, "tag_name": tag_name, "value": dict(value), "provenance": at, "notes": list(notes)})
