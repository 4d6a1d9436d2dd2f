import random
import re
from collections import defaultdict

from tessera.llm import mixing


def fill(sizes):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * sizes[s]]
        for s in over or free:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        if not over:
            break
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


def test_targets_and_copies(spark):
    rng = random.Random(4)
    rows = [(i, " \t".join(["w x"] * rng.choice([0, 1, 5, 30, 30, 200])), rng.choice(["a", "a", "a", "b", "B", "", "é", None]), 0) for i in range(3000)]
    rows += [(None, "one two", "a", 1), (99999, None, "z", 2), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(7)).collect()), key=str)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want = fill(sizes)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        taken[s] += r.taken
    for s in want:
        assert abs(taken[s] - want[s]) <= max(31, 0.01 * want[s]), s


def test_rates_are_tilted_and_empty_tables_work(spark):
    rows = [(i, "w " * (1 + i % 9), "st"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, weights=(1, 9), share=0.8).select("size", "source_size", "target", "rate").distinct().collect()
    import math

    for t in {r.target for r in got}:
        odds = {r.size: math.log(r.rate / (2 - r.rate)) / r.size for r in got if r.target == t and 0 < r.rate < 2}
        assert not odds or max(odds.values()) - min(odds.values()) < 1e-9
    assert mixing.mix_sources(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix_sources(df.selectExpr("doc_id", "cast(null as string) text", "source")).collect()} == {0}
