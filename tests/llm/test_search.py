import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, topk, urlfilter


def brute_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in {(i, tuple(v)) for i, v in ok if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("block,bucket", [(8192, 512), (3, 16)])
def test_top_k_equals_brute_force(spark, block, bucket):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.lognormal()]) for i in range(400)]
    rows += [(400 + i, rows[i][1]) for i in range(30)] + [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (550, [float("nan")] * 6), (600, [0.0] * 6), (None, [1.0] * 6), (650, [1.0, 2.0]), (651, [3.0, 1.0]), (700, [1e6] * 6), (701, [-9e4] * 6)]
    rows = [(i, v if i != 700 else [9e4] * 6) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, q string").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, bucket=bucket).collect()
    assert {tuple(r) for r in got} == brute_top(rows) and len(got) == len(set(got))
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def brute_leaks(docs, items, window=10):
    cut = decontaminate.words
    wins = {}
    for i, t in items:
        w = cut((t or "").encode())
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, its = cut((t or "").encode()), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    its |= wins[tuple(w[s : s + n])]
        out.append((d, len(w), len(hit), tuple(sorted(str(x) for x in its if x is not None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice(["Aa", "b", "ç1", "dd", "e'e"]) for _ in range(n))
    items = [(i, prose(rng.randint(1, 30))) for i in range(8)] + [(8, None), (9, "--"), (10, "zz top"), (None, "lone item words"), (3, "again")]
    docs = [(i, prose(40) + " " + (rng.choice(items)[1] or "") + ", " + prose(5)) for i in range(40)] + [(40, None), (41, ""), (None, "zz Top!"), (42, "lone ITEM words"), (42, "lone ITEM words")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, runs int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(d, b, block_bytes=block_bytes).collect()
    have = sorted(((r.doc_id, r.n_words, sum(x.end - x.start for x in r.runs), tuple(r["items"])) for r in got), key=str)
    assert have == brute_leaks(docs, items)
    kept = decontaminate.clean(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns and kept.count() == sum(1 for x in brute_leaks(docs, items) if not x[2])
    assert decontaminate.digest(decontaminate.contamination(d, b.limit(0))).where("contaminated").count() == 0


def test_url_rules_and_exact_list(spark):
    urls = ["http://WWW.Example.com/en/x", "https://a.example.com/en/?q", "http://example.org/en", "http://b.net/es/1", "http://b.net/de/1/", "https://b.net/de/1#x", "http://xcom/", "http://q.com", "http://q.com/", "nothing", None, "://net/fr/", "http://h?x=/fr/"]
    df = spark.createDataFrame([(i, u, "y") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_filter(df, urlfilter.recrawled(df)).collect()}
    assert got[0] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("example.org", "/en", None, "allow")
    assert got[3][2:] == ("net/es/", "block") and got[4][2:] == got[5][2:] == (None, "block")
    assert got[6][2:] == (None, "allow") and got[7] == ("q.com", "", None, "block") and got[8][2:] == ("com/", "allow")
    assert got[9] == got[10] == ("", "", None, "allow") and got[11] == ("net", "/fr/", "net/fr/", "block") and got[12][:2] == ("h", "")


def test_bloom_passes_all_listed_and_few_others(spark):
    urls = spark.range(5000).selectExpr("concat('h.org/', id) url")
    bloom = urlfilter.bloom_table(urls, 5000 * 16 // 256)
    pages = spark.range(10000).selectExpr("id page_id", "concat('http://h.org/', id) url")
    out = urlfilter.url_filter(pages, urls)
    assert out.where("listed").count() == 5000 and bloom.count() <= 313
    assert out.where("(page_id < 5000) <> listed").count() == 0
