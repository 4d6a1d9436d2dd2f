"""Edit-aware token counts.

A document is kept as a segment tree over leaves of whole pre-tokens: leaves are cut before a single space between two
other characters, where no pre-token of the pattern can go across, so the tokens of a text are the sum over its leaves.
An edit replaces the leaves that it touches; where the new text would no longer be cut safely from a neighbour, the
neighbour joins the region (boundary context). Only the region is encoded again, and the sums above it are updated.

The vocabulary (ranks of a byte-level BPE) is read once on the driver from a path that is a parameter, and broadcast.

Edge cases: a null or empty text has 0 tokens and no edits; special tokens' strings are ordinary text; a text without a
safe cut is one leaf; repeated rows and null ids are ordinary rows; an empty table gives an empty result; extra columns are
ignored. Edits must lie in the text and not overlap.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 1024
#: Times its size to which a leaf may grow by edits.
GROWN = 4
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: What the query's edits mask.
MASKS = ((re.compile(r"[\w.+-]{1,64}@[\w-]{1,64}(?:\.[\w-]{1,64})+"), "<email>"), (re.compile(r"(?<![\w.])\+?\(?\d{1,4}\)?(?:[ .()-]{1,2}\d{2,4}){2,4}(?![\w.])"), "<phone>"))


@lru_cache(2)
def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def leaves(text: str, size: int = LEAF) -> list[str]:
    """Parts of a text of about `size` characters, cut where no pre-token goes across."""
    out, at = [], 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    if at < len(text):
        out.append(text[at:])
    return out


def safe(left: str, right: str) -> bool:
    """May a leaf that ends with left be followed by one that begins with right?"""
    return bool(left) and not left[-1].isspace() and right[:1] == " " and len(right) > 1 and not right[1].isspace()


class TokenTree:
    """Counts of one document that follow its edits."""

    def __init__(self, text: str, count, size: int = LEAF):
        """count: text -> number of tokens."""
        self.count, self.size, self.encoded = count, size, 0
        self._build([(x, self._encode(x)) for x in leaves(text, size)])
        self.encoded = 0

    @classmethod
    def kept(cls, text: str, chars, tokens, count, size: int = LEAF) -> TokenTree:
        """The tree of a text whose leaves were counted before; nothing is encoded."""
        tree, at, parts = cls("", count, size), 0, []
        for c, n in zip(chars, tokens):
            parts.append((text[at : at + c], n))
            at += c
        if at != len(text):
            raise ValueError("the kept leaves are not those of the text")
        tree._build(parts)
        tree.encoded = 0
        return tree

    def leaf_counts(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves with text."""
        have = [i for i in range(self.base, 2 * self.base) if self.chars[i]]
        return [self.chars[i] for i in have], [self.tokens[i] for i in have]

    def _encode(self, x: str) -> int:
        self.encoded += len(x)
        return self.count(x)

    def _build(self, parts: list[tuple[str, int]]) -> None:
        self.base = 1
        while self.base < max(1, len(parts)):
            self.base *= 2
        self.texts = [x for x, _ in parts] + [""] * (self.base - len(parts))
        self.chars = [0] * self.base + [len(x) for x in self.texts]
        self.tokens = [0] * self.base + [n for _, n in parts] + [0] * (self.base - len(parts))
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds the character at `at`, and where it begins; the last leaf with text for the end."""
        at = min(at, max(0, self.n_chars - 1))
        i, start = 1, 0
        while i < self.base:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.base, start

    def _near(self, k: int, step: int) -> int:
        """Next leaf with text, or -1."""
        k += step
        while 0 <= k < self.base and not self.texts[k]:
            k += step
        return k if 0 <= k < self.base else -1

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end."""
        if not 0 <= start <= end <= self.n_chars:
            raise ValueError("edit outside the text")
        a, first = self._find(start)
        b, last = self._find(max(start, end - 1))
        region = "".join(self.texts[a : b + 1])
        region = region[: start - first] + new + region[end - first :]
        while (k := self._near(a, -1)) >= 0 and not safe(self.texts[k], region):
            a, region = k, self.texts[k] + region
        while (k := self._near(b, 1)) >= 0 and not safe(region, self.texts[k]):
            b, region = k, region + self.texts[k]
        parts = [(x, self._encode(x)) for x in leaves(region, self.size)]
        extra = parts[b - a :]  # a leaf may grow to some times its size before the tree does
        if len(extra) > 1 and sum(len(x) for x, _ in extra) <= GROWN * self.size:
            parts = [*parts[: b - a], ("".join(x for x, _ in extra), sum(n for _, n in extra))]
        if len(parts) > b - a + 1:
            whole = [(self.texts[i], self.tokens[self.base + i]) for i in range(self.base) if self.texts[i] and not a <= i <= b]
            k = sum(1 for i in range(a) if self.texts[i])
            self._build(whole[:k] + parts + whole[k:])
            return
        for i in range(a, b + 1):
            x, n = parts[i - a] if i - a < len(parts) else ("", 0)
            self.texts[i] = x
            self._set(i, len(x), n)

    def _set(self, i: int, chars: int, tokens: int) -> None:
        i += self.base
        more, plus = chars - self.chars[i], tokens - self.tokens[i]
        while i and (more or plus):
            self.chars[i] += more
            self.tokens[i] += plus
            i //= 2


def mask_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask mail addresses and telephone numbers, last first."""
    out = []
    for pattern, name in MASKS:
        if name != "<email>" or "@" in text:
            out += [(m.start(), m.end(), name) for m in pattern.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for e in sorted(out):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept[::-1]


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_edits", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_chars", pa.int64()), ("n_chars_encoded_again", pa.int64())])


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, edits=mask_edits, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_chars and n_chars_encoded_again of each document.

    edits: text -> edits (start, end, new), last first; they are applied to the document's tree.
    """
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(ranks.value).encode_ordinary
        count = lambda x: len(encode(x))
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                tree = TokenTree(text, count, leaf)
                before, todo = tree.n_tokens, edits(text)
                for e in todo:
                    tree.edit(*e)
                out.append((doc, before, len(todo), tree.n_tokens, len(text), tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), SCHEMA)] if out else [pa.nulls(0, f.type) for f in SCHEMA], schema=SCHEMA)

    return keyed(documents).select("doc_id", "text").mapInArrow(run, ", ".join(f"{f.name} long" for f in SCHEMA))


TREES = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32())), ("n_chars_encoded_again", pa.int64())])
TREES_DDL = "doc_id long, text string, n_tokens long, leaf_chars array<int>, leaf_tokens array<int>, n_chars_encoded_again long"


def _trees(ranks, leaf):
    """Batches of (doc_id, text, leaf_chars, leaf_tokens, edits) to trees; without leaves the text is encoded whole."""

    def run(batches):
        encode = encoder(ranks.value).encode_ordinary
        count = lambda x: len(encode(x))
        for batch in batches:
            out = []
            for doc, text, chars, tokens, edits in zip(*(c.to_pylist() for c in batch.columns)):
                tree = TokenTree(text or "", count, leaf) if chars is None else TokenTree.kept(text or "", chars, tokens, count, leaf)
                for e in edits or ():
                    tree.edit(e["start"], e["end"], e["new"])
                out.append((doc, tree.text if text is not None or edits else None, tree.n_tokens, *tree.leaf_counts(), tree.encoded))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), TREES)] if out else [pa.nulls(0, f.type) for f in TREES], schema=TREES)

    return run


def token_trees(documents: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Trees to keep: doc_id, text, n_tokens, leaf_chars, leaf_tokens, n_chars_encoded_again (0). doc_id is to be unique."""
    with open(vocabulary, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    none = F.lit(None)
    rows = keyed(documents).select("doc_id", "text", none.cast("array<int>").alias("chars"), none.cast("array<int>").alias("tokens"), none.cast("array<struct<start:int,end:int,new:string>>").alias("edits"))
    return rows.mapInArrow(_trees(ranks, leaf), TREES_DDL)


def edit_trees(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """Kept trees after edits (doc_id, ord, start, end, new), applied in order of ord to the text as it then is.

    Only what an edit touches, with its boundary, is encoded; documents without edits are not encoded at all. Edits of
    documents that have no tree, and null edits, do nothing; an edit outside the text fails.
    """
    with open(vocabulary, "rb") as f:
        ranks = trees.sparkSession.sparkContext.broadcast(f.read())
    one = F.struct("ord", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("new", F.lit("")).alias("new"))
    todo = edits.where("start is not null and end is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.array_sort(F.collect_list(one)).alias("edits"))
    rows = trees.join(todo, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    plain = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["new"].alias("new")))
    return rows.select("doc_id", "text", "leaf_chars", "leaf_tokens", plain.alias("edits")).mapInArrow(_trees(ranks, leaf), TREES_DDL)


def total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_tokens_edited").alias("n_tokens_edited"))
