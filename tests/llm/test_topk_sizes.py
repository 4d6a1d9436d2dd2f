from fractions import Fraction
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import topk

LONG = 1 << 63


def brute(rows, k=5):
    ok = [(i, [floor(Fraction(x) * 256) for x in v]) for i, v in rows]
    out = set()
    for i, q in ((i, v) for i, v in ok if i % 50 == 0):
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r + 1, j, max(-LONG, min(-x, LONG - 1))) for r, (x, j) in enumerate(s)}
    return out


@pytest.mark.parametrize("sizes", [[], [1e6], [3e7, 1e6], [1e8, 1e9, 3e10], [1e18, 1e6, 7e7], [1e160, 1e20], [1e307, 1.7e308, 1e9]])
@pytest.mark.parametrize("block,bucket", [(8192, 512), (3, 16)])
def test_vectors_of_any_size_rank_exactly(spark, sizes, block, bucket):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.lognormal()]) for i in range(300)]
    rows += [(700, [1e6] * 6), (701, [-9e4] * 6)]
    for n, size in enumerate(sizes):
        rows += [(1000 + 50 * n + i, [float(x) for x in np.sign(rng.normal(size=6)) * size]) for i in range(8)]
        rows += [(1008 + 50 * n + i, [size, 3.0, 0.0, -size, float(i // 2), 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, bucket=bucket).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(set(got))


def test_order_of_keys():
    n = sorted([0, 1, -1, 255, 256, -256, -257, LONG, -LONG, 1 << 2000, -(1 << 2000), (1 << 2000) + 1])
    assert sorted(n, key=topk.ordered) == n
