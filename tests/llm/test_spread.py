import random
from collections import Counter

import pytest

from tessera.llm import common, decontaminate, topk, urlfilter


@pytest.fixture
def shuffled(monkeypatch):
    """Nothing is small enough for a broadcast, and three rows of a key are hot."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, monkeypatch, how):
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 40 + [2] * 5 + [3] + [None] * 4 + [9] * 6)], "k int, i int").repartition(3)
    other = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "k int, v string")
    want = Counter(map(tuple, big.join(other, ["k"], how).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    assert Counter(map(tuple, common.spread_join(big, other, ["k"], ["i"], how).select("k", "i", "v").collect())) == want


def test_url_filter_over_shuffled_joins(spark, shuffled):
    rng = random.Random(6)
    urls = ["https://www.a.net/x", "http://a.net/x/", "https://b.org/?q", "c", None, "", "http://d.net/fr/1", "https://E.com/p", "http://b.org"]
    rows = [(i, rng.choice(urls), "k", 7, 1) for i in range(200)] + [(None, urls[0], None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, canonical string, block int, w0 int").repartition(3)
    listed = urlfilter.recrawled(df)
    got = Counter((r.page_id, r.rule, r.verdict, r.listed) for r in urlfilter.url_filter(df, listed).collect())

    def judge(u):
        if u is None or "://" not in u:
            return None, "allow", False
        host = u.split("://")[1].lower()
        rule = "net/fr/" if host.startswith("d.net/fr/") else "com/" if host.startswith("e.com") else None
        return rule, {"net/fr/": "block", "com/": "allow"}.get(rule, "block"), True

    assert got == Counter((i, *judge(u)) for i, u, *_ in rows)
    assert urlfilter.url_filter(df.limit(0), listed).count() == 0
    none = urlfilter.url_filter(df, listed.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.listed for r in none)


def test_blocks_of_queries_and_items_change_nothing(spark):
    rng = random.Random(2)
    vectors = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(120)], "vec_id long, embedding array<double>")
    query = vectors["vec_id"] % 5 == 0
    assert sorted(topk.top_k(vectors, query, block=5).collect()) == sorted(topk.top_k(vectors, query).collect())
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(30)] + [(40, None)], "doc_id long, text string")
    texts = [r.text for r in docs.limit(8).collect()]
    items = spark.createDataFrame([(f"i{k}", " ".join(t.split()[k * 9 : k * 9 + 14])) for k, t in enumerate(texts)] + [("none", ""), ("odd", "w1 zz")], "item_id string, text string")
    one, many = (decontaminate.digest(decontaminate.contamination(docs, items, block_bytes=n)).collect() for n in (1 << 20, 64))
    assert sorted(one) == sorted(many) and sum(r.contaminated for r in one) >= 8
