import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import common, suffix


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        hit = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                hit[i : i + length] = True
        kept = bytes(x for x, h in zip(r, hit) if not h)
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((len(r), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def split(text):
    return re.findall(r"[^ \t\n\x0b\f\r]+", text)


def kept_words(texts, length):
    """Words of each text outside the strings of `length` words that also start elsewhere."""
    all_words = [split(t or "") for t in texts]
    low = [[w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in x] for x in all_words]
    seen = Counter(tuple(x[i : i + length]) for x in low for i in range(len(x) - length + 1))
    for words, x in zip(all_words, low):
        hit = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if seen[tuple(x[i : i + length])] > 1:
                hit[i : i + length] = True
        yield [w for w, h in zip(words, hit) if not h]


@pytest.mark.parametrize("symbol,shards", [(1, 3), (4, 2), (5, 5), (20, 1)])
def test_merged_transforms_equal_direct_count(symbol, shards):
    rng = random.Random(symbol)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 60))).encode() for _ in range(12)]
    strings += strings[:2]
    flags, c = suffix.repeated(strings, np.ones(len(strings), int), 20, symbol, shards)
    seen = Counter(s[i : i + 20] for s in strings for i in range(len(s) - 19))
    for k, s in enumerate(strings):
        for i in range(len(s) + 1):
            assert flags[c.first[k] + i] == (i + 20 <= len(s) and seen[s[i : i + 20]] > 1)


def test_common_prefixes_of_a_merge():
    c = suffix.Collection([b"abcabd", b"abcx"], 1)
    slots, lcp = suffix.merge_bwts(c, [0, 7, 11], 4)
    raw = b"abcabd\0abcx\0"
    ends = {0: 6, 1: 11}
    suf = [raw[s : ends[int(c.owner[s])]] for s in slots]
    for k in range(1, len(suf)):
        if suf[k] and suf[k - 1]:
            n = 0
            while n < min(len(suf[k]), len(suf[k - 1]), 4) and suf[k][n] == suf[k - 1][n]:
                n += 1
            assert lcp[k] == n


@pytest.mark.parametrize("hot", [2048, 3])
def test_whole_operator_against_brute_force(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(40)
    texts = [prose(rng.randint(1, 60)) for _ in range(20)]
    texts += [prose(20) + shared + prose(20) for _ in range(12)]
    texts += [shared[: 20 * k] + prose(9) for k in range(3, 8)] + [texts[0]] * 3 + [None, "", "x" * 900, "ab" * 300, shared * 3]
    rows = [(i, t, "k") for i, t in enumerate(texts)] + [(None, texts[1], "k"), (3, texts[3], "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = suffix.suffix_dedup(df, 40, gram=8, symbol=10, hot=hot).collect()
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows], 40)))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PIECE", 256)
    off = np.array([0, 1000, 1010, 1700])
    seen = Counter((row, s) for g in suffix._pieces(off, 40) for row, a, e in g for s in range(a, e - 39))
    assert seen == Counter([(0, s) for s in range(961)] + [(2, s) for s in range(1010, 1661)])


def test_empty_and_text_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n int")
    assert suffix.suffix_dedup(empty).count() == 0
    a = "é" * 30
    df = spark.createDataFrame([(1, a + "x", 7), (2, "y" + a, 8), (3, None, 9)], "doc_id long, text string, n int")
    out = {r.doc_id: r for r in suffix.dedup_text(df, 40, gram=8, symbol=10).collect()}
    assert (out[1].text, out[2].text, out[3].text) == ("x", "y", None) and out[3].n == 9


@pytest.mark.parametrize("hot,rows", [(2048, 100_000), (3, 5)])
def test_words_against_brute_force(spark, monkeypatch, hot, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "HOT_ROWS", 4)
    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice(["ab", "Cé", "x", "yy", "q."]) + rng.choice("abcdef") for _ in range(n))
    shared = prose(30)
    texts = [prose(rng.randint(0, 90)) for _ in range(20)] + [f"{prose(15)}\t{shared}\n {prose(15)}" for _ in range(12)]
    texts += [" ".join(shared.split()[k:]) + " " + prose(9) for k in range(8)] + [texts[0]] * 3 + [None, "", "z " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in suffix.dedup_text(df, 10, words=True, gram=3, symbol=5, hot=hot).collect()}
    for k, want in enumerate(kept_words(texts, 10)):
        assert split(got[k] or "") == want, k


@pytest.mark.parametrize("merge", [suffix.MERGE, 1])
def test_short_worded_passages_are_counted_and_stay(spark, monkeypatch, merge):
    """Passages of over 50 words are found below 400 bytes as well; the contract's columns keep to 400 bytes."""
    monkeypatch.setattr(suffix, "MERGE", merge)
    rng = random.Random(11)
    prose = lambda n, m: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, m))) for _ in range(n))
    short, long = prose(55, 4), prose(70, 12)
    assert len(short) < 300 and len(long) > 400
    texts = [f"{prose(30, 9)} {short} {prose(20 + k, 9)} {short if k % 2 else long}" for k in range(6)]
    texts += [f"{prose(9, 9)}\n{short.upper().replace(' ', '  ')}", prose(90, 9), " ".join(short.split()[:49]), f"{prose(60, 9)} {long}", "", None]
    rows = list(enumerate(texts)) + [(None, texts[1]), (0, texts[0])]
    got = suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter()
    for (doc, text), plain, kept in zip(rows, brute([t for _, t in rows], 400), kept_words([t for _, t in rows], 50)):
        want[doc, *plain, len(split(text or "")) - len(kept)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.n_passage_words) for r in got) == want
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[6].n_removed, by[6].n_passages, by[6].n_passage_words, by[7].n_passages, by[8].n_passages) == (0, 1, 55, 0, 0)
    assert [(x.start, x.end) for x in by[3].passages] == [(30, 85), (108, 163)] and by[11].n_passages == 0


def test_query_tells_of_passages_below_400_bytes(spark, tmp_path):
    from tessera.llm.queries import QUERIES

    words = " ".join(f"w{k % 10}{chr(97 + k // 10)}" for k in range(60))
    rows = [(1, f"alpha beta {words} gamma"), (2, f"delta {words} zeta eta"), (3, "theta iota")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.n_passages, r.n_passage_words) for r in QUERIES["op2_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, 1, 60), 2: (0, 1, 60), 3: (0, 0, 0)}
