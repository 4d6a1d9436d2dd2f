"""Mixing sources to target weights by entropy balancing.

Targets: sources in order of code points (null last) weigh 5, 2, 1, 5, ...; they share `share` times all words by
weight, and a target stops at `cap` times its source's words, the excess going to the others (water filling).

Rates: of all document rates r in (0, cap) that give a source its target, the ones of least entropy against equal rates
are exponentially tilted, r / (cap - r) = exp(tilt * size / mean size). The convex dual has one unknown tilt a source;
Newton rounds, safeguarded by a bracket, run over exact counts of (source, size), which hold all that the dual needs.

Copies: a document's j-th copy has score j - rate - u, with u in [0, 1) from a hash of the row, so scores up to 0 are
an unbiased rounding. Copies are taken in order of score weighted by size until the source's target is met as nearly as
whole copies allow; the cut is found from two nested histograms, not by sorting documents.

DataFrame functions only. A hot source is summed before it is shuffled; documents meet their source's row by a
broadcast if the counted sources are few, else by a join which Spark may split.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, '' another; rows equal in
doc_id and text share u, so they are taken alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_key, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
FINE = 4096
ROUNDS = 100
CLOSE = 1e-7


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, docs, source_size, target from rows (source, docs, source_size). Sorts the sources, not the documents."""
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * float(cap)).withColumn("ratio", F.col("limit") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()) * float(share))
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum("limit").over(above), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source"))).over(Window.partitionBy())
    rows = rows.withColumn("level", level)
    return rows.select("source", "docs", "source_size", F.least("limit", F.col("weight") * F.coalesce("level", F.col("ratio"))).alias("target"))


def rate(tilt: Column, x: Column, cap: float = CAP) -> Column:
    return F.lit(float(cap)) / (1 + F.exp(F.greatest(F.least(-tilt * x, F.lit(700.0)), F.lit(-700.0))))


def solve(counts: DataFrame, wanted: DataFrame, cap: float = CAP, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """wanted with tilt: the dual solution of each source; null where the target is 0 or the cap (then rates need no tilt).

    counts: source, size, n. Each round is one grouped sum over counts; only the largest relative error comes back.
    """
    full = F.col("source_size") * float(cap)
    inside = (F.col("target") > 0) & (F.col("target") < full * (1 - 1e-12))
    state = wanted.withColumn("mean", F.col("source_size") / F.col("docs"))
    start = F.when(inside, F.log(F.col("target") / (full - F.col("target"))))
    state = state.select("*", start.alias("tilt"), F.when(inside, F.lit(-1e6)).alias("lo"), F.when(inside, F.lit(1e6)).alias("hi"))
    state = written(state, "tilts")
    for k in range(rounds):
        x = F.col("size") / F.col("mean")
        r = rate(F.col("tilt"), x, cap)
        rows = counts.join(small(state.where("tilt is not null")).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        sums = rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * x * r * (1 - r / float(cap))).alias("slope"))
        sums = sums.withColumnRenamed("source", "of")
        both = written(state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "round")
        worst = both.agg(F.max(F.abs(F.col("got") / F.col("target") - 1))).first()[0]
        if worst is None or worst < close:
            break
        if k == rounds - 1:
            raise RuntimeError(f"the dual did not settle in {rounds} rounds; largest relative error {worst}")
        high = F.col("got") > F.col("target")
        lo, hi = F.when(high, F.col("lo")).otherwise(F.col("tilt")), F.when(high, F.col("tilt")).otherwise(F.col("hi"))
        step = F.col("tilt") - (F.col("got") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        held = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
        state = both.select(*wanted.columns, "mean", F.when(F.col("tilt").isNotNull(), held).alias("tilt"), F.when(F.col("tilt").isNotNull(), lo).alias("lo"), F.when(F.col("tilt").isNotNull(), hi).alias("hi"))
    return state.drop("lo", "hi").withColumn("tilt", F.round("tilt", 6))  # sums of doubles differ in their last bits from run to run


def _cut(jumps: DataFrame, bucket: str, before: Column) -> DataFrame:
    """For each source, words by bucket and words up to and with each bucket."""
    w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    rows = jumps.groupBy("source", bucket).agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first(before).alias("before"))
    return rows.withColumn("upto", F.col("before") + F.sum("words").over(w))


def mix_sources(documents: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate of each document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.col("source").cast("string").alias("source"), words("text").alias("size"))
    rows = written(rows, "sizes")
    counts = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = solve(counts.where("size > 0"), targets(sizes, weights, share, cap), cap)
    wanted = written(wanted, "wanted")

    per_source = small(wanted.withColumnRenamed("source", "of"))
    rows = rows.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    u = F.pmod(F.xxhash64("doc_id", "tkey", F.lit(3)), F.lit(1 << 40)) / float(1 << 40)
    tilted = rate(F.col("tilt"), F.col("size") / F.col("mean"), cap)
    rows = rows.withColumn("rate", F.when(F.col("tilt").isNotNull(), tilted).otherwise(F.when(F.col("target") > 0, float(cap)).otherwise(0.0))).withColumn("u", u)
    score = lambda j: (j - F.col("rate") - F.col("u")) * F.col("size")
    place = lambda j: (score(j) / (F.col("mean") + F.abs(score(j))) + 1) * (FINE / 2)  # noqa: E731  from 0 to FINE, in order of score
    open_ = F.col("tilt").isNotNull() & (F.col("size") > 0)
    jumps = rows.where(open_).select("source", "size", "target", F.explode(F.array(*(place(j) for j in range(1, cap + 1)))).alias("p"))
    jumps = jumps.select("source", "size", "target", F.floor("p").alias("b1"), F.floor((F.col("p") - F.floor("p")) * FINE).alias("b2"))
    coarse = _cut(jumps, "b1", F.lit(0))
    at = coarse.where(F.col("upto") >= F.col("target")).groupBy("source").agg(F.min_by(F.struct("b1", (F.col("upto") - F.col("words")).alias("before")), "b1").alias("c")).select(F.col("source").alias("of"), "c.b1", "c.before")
    at = written(at, "coarse")
    near = small(at.withColumnRenamed("b1", "k1"))
    inner = jumps.join(near, F.col("source").eqNullSafe(F.col("of")) & (F.col("b1") == F.col("k1"))).drop("of", "k1", "b1")
    fine = _cut(inner, "b2", F.col("before"))
    miss = F.abs(F.col("upto") - F.col("target"))
    fine = fine.groupBy("source").agg(F.min_by(F.struct("b2", miss.alias("miss")), F.struct(miss, "b2")).alias("f"), F.first(F.abs(F.col("before") - F.col("target"))).alias("none"))
    fine = fine.select(F.col("source").alias("of2"), F.when(F.col("none") <= F.col("f.miss"), F.lit(-1)).otherwise(F.col("f.b2")).alias("k2"))
    cuts = written(at.join(fine, F.col("of").eqNullSafe(F.col("of2"))).select("of", F.col("b1").alias("k1"), "k2"), "cuts")
    rows = rows.join(small(cuts), F.col("source").eqNullSafe(F.col("of")), "left")

    def taken(j):
        b1 = F.floor(place(j))
        b2 = F.floor((place(j) - b1) * FINE)
        return ((b1 < F.col("k1")) | ((b1 == F.col("k1")) & (b2 <= F.col("k2")))).cast("int")

    copies = F.when(F.col("size") == 0, 0).when(F.col("tilt").isNull(), F.when(F.col("target") > 0, cap).otherwise(0)).otherwise(sum((taken(j) for j in range(2, cap + 1)), taken(1)))
    rows = rows.withColumn("copies", F.coalesce(copies, F.lit(0)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
