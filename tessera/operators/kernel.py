"""Operators on the entries of an asset.

Each works on one asset's entries as an array column (structs of ord, namespace, tag_id, tag_name, value, provenance, in
order of ord), inside the asset's row: nothing is joined or shuffled, and what an operator compares is bounded by one
asset. The functions that take a frame of entries gather each asset's entries (the only shuffle) and apply the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import rules as R

KEEP = ("namespace", "tag_id", "tag_name", "value", "provenance")


def let(x: Column, f) -> Column:
    """f(x), with x computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def in_order(rows: Column) -> Column:
    return F.array_sort(rows, lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def gather(rows: DataFrame, *columns: str, name: str = "es") -> DataFrame:
    """(asset_id, array of the rows' columns in order of ord)."""
    return rows.groupBy("asset_id").agg(in_order(F.collect_list(F.struct("ord", *columns))).alias(name))


def gathered(entries: DataFrame) -> DataFrame:
    """(asset_id, es) of a frame of entries; tag_id and provenance may be missing."""
    have = set(entries.columns)
    for c in ("tag_id", "provenance"):
        if c not in have:
            entries = entries.withColumn(c, F.lit(None).cast("string"))
    return gather(entries, *KEEP)


def spread(assets: DataFrame, items: Column) -> DataFrame:
    """A row (asset_id, members of the item) for each item."""
    return assets.select("asset_id", F.explode(items).alias("_x")).select("asset_id", "_x.*")


def side(e: Column) -> Column:
    return F.struct(*(e[k].alias(k) for k in KEEP))


# --- reconciliation -----------------------------------------------------------------------------


def chooser_accepts(chooser: Column, v: Column) -> Column:
    text = v["kind"].isin("string", "timestamp")
    return (
        F.when(chooser.isin("string", "timestamp"), text)
        .when(chooser == "float_like", S.numeric_value(v).isNotNull())
        .when(chooser == "any", F.lit(True))
        .otherwise(v["kind"] == chooser)
    )


def reconciled(es: Column, rules=R.RULES) -> Column:
    """Fields of an asset: (rule_ord, field, chooser, winner, n_candidates, differing, conflict_note, notes).

    A rule's winner is the entry preferred by namespace, else the first; one of the wrong kind suppresses the field.
    """

    def rank(r, e):
        return F.coalesce(F.nullif(F.array_position(r["prefs"], e["namespace"]), F.lit(0)), F.lit(999))

    def judged(x):
        best = F.array_min(F.transform(x["cands"], lambda e, i: F.struct(rank(x["r"], e).alias("rank"), i.alias("i"))))
        return let(F.get(x["cands"], best["i"]), lambda w: F.struct(x["r"].alias("r"), w.alias("w"), F.size(x["cands"]).alias("n"), F.filter(x["cands"], lambda e: (e["ord"] != w["ord"]) & ~S.typed_equal(e["value"], w["value"])).alias("differing")))

    def field(x):
        r, w = x["r"], x["w"]
        note = F.concat(F.lit("selected "), w["tag_name"], F.lit(" from "), w["namespace"], F.lit(" over "), (x["n"] - 1).cast("string"), F.lit(" competing candidate(s)"))
        note = F.when(F.size(x["differing"]) > 0, note)
        icc = F.startswith(r["field"], F.lit("color.")) & (w["namespace"] == "icc")
        notes = F.array_compact(F.array(note, F.when(icc, "selected bounded ICC metadata as authoritative color-profile source")))
        return F.struct(r["rule_ord"].alias("rule_ord"), r["field"].alias("field"), r["chooser"].alias("chooser"), w.alias("winner"), x["n"].alias("n_candidates"), x["differing"].alias("differing"), note.alias("conflict_note"), notes.alias("notes"))

    found = F.transform(R.rule_column(rules), lambda r: F.struct(r.alias("r"), F.filter(es, lambda e: F.array_contains(r["tags"], e["tag_name"])).alias("cands")))
    found = F.transform(F.filter(found, lambda x: F.size(x["cands"]) > 0), judged)
    return F.transform(F.filter(found, lambda x: chooser_accepts(x["r"]["chooser"], x["w"]["value"])), field)


def reconcile(entries: DataFrame, rules=R.RULES) -> DataFrame:
    return spread(gathered(entries), reconciled(F.col("es"), rules))


# --- conflicts ----------------------------------------------------------------------------------


def _conflict(source: int, rule: Column, n: Column, field: Column, message: Column, sources: Column) -> Column:
    ord_ = F.struct(F.lit(source).alias("source"), rule.alias("rule"), n.alias("n"))
    return F.struct(ord_.alias("ord"), field.alias("field"), message.alias("message"), sources.alias("sources"))


def policy(fields: Column) -> Column:
    """Conflicts of reconciled fields: the winner first, then what differs from it."""
    rows = F.filter(fields, lambda f: F.size(f["differing"]) > 0)
    return F.transform(rows, lambda f: _conflict(1, f["rule_ord"], F.lit(0), f["field"], f["conflict_note"], F.transform(F.concat(F.array(f["winner"]), f["differing"]), side)))


def _members(es: Column, g: Column, keep) -> Column:
    return F.filter(es, lambda e: F.array_contains(g["keys"], F.concat(e["namespace"], F.lit("\t"), e["tag_name"])) & keep(e))


def _said(e: Column, value) -> Column:
    return F.concat(e["namespace"], F.lit(":"), e["tag_name"], F.lit("="), value(e["value"]))


def _each_group(groups, family: int, find, message) -> Column:
    """find(g): struct (a, b) of the entries that a group's conflict is about, or null."""
    found = F.transform(R.group_column(groups), lambda g: F.struct(g.alias("g"), find(g).alias("p")))
    found = F.filter(found, lambda x: x["p"].isNotNull())
    return F.transform(found, lambda x: _conflict(0, F.lit(family), x["g"]["group_ord"], x["g"]["field"], message(x["p"]["a"], x["p"]["b"]), F.array(side(x["p"]["a"]), side(x["p"]["b"]))))


def disagreeing(es: Column, groups=R.SEMANTIC, folded=R.FOLDED) -> Column:
    """Groups whose texts have two or more canonical values: the first entries of the two smallest."""

    def find(g):
        def canon(e):
            t = S.trimmed(S.string_value(e["value"]))
            return F.when(F.array_contains(F.array(*map(F.lit, folded)), g["field"]), F.lower(t)).otherwise(t) if folded else t

        rows = F.transform(_members(es, g, lambda e: S.string_value(e["value"]).isNotNull()), lambda e: F.struct(canon(e).alias("c"), e.alias("e")))

        def two(x):
            texts = F.transform(x, lambda r: r["c"])
            least = let(F.array_min(texts), lambda c0: F.struct(c0.alias("c0"), F.array_min(F.filter(texts, lambda c: c > c0)).alias("c1")))
            first = lambda text: F.get(F.filter(x, lambda r: r["c"] == text), F.lit(0))["e"]
            return let(least, lambda k: F.when(k["c1"].isNotNull(), F.struct(first(k["c0"]).alias("a"), first(k["c1"]).alias("b"))))

        return let(rows, two)

    return _each_group(groups, 0, find, lambda a, b: F.concat(_said(a, S.string_value), F.lit(" vs "), _said(b, S.string_value)))


def pairs(rows: Column, differ) -> Column:
    """Pairs (a, b) of rows, a before b, for which differ(a, b), in order."""
    return F.flatten(F.transform(rows, lambda a, i: F.transform(F.filter(rows, lambda b, j: (j > i) & differ(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _first_pair(rows: Column, differ) -> Column:
    first = let(rows, lambda x: F.get(pairs(x, differ), F.lit(0)))
    return F.when(first.isNotNull(), F.struct(first["a"]["e"].alias("a"), first["b"]["e"].alias("b")))


def offset_differing(es: Column, groups=R.SEMANTIC[:1]) -> Column:
    """Equal wall clocks with different offsets, or with one only: the first pair of an asset."""

    def find(g):
        text = lambda e: S.string_value(e["value"])
        rows = F.transform(_members(es, g, lambda e: S.wall_clock(text(e)).isNotNull()), lambda e: F.struct(S.wall_clock(text(e)).alias("wall"), S.offset_minutes(text(e)).alias("off"), e.alias("e")))
        return _first_pair(rows, lambda a, b: (a["wall"] == b["wall"]) & ~a["off"].eqNullSafe(b["off"]))

    return _each_group(groups, 1, find, lambda a, b: F.concat(F.lit("timezone offset disagreement: "), _said(a, S.string_value), F.lit(" vs "), _said(b, S.string_value)))


def numbers_differing(es: Column, groups=R.NUMERIC, tolerance: float = R.TOLERANCE) -> Column:
    """Numbers that differ by more than tolerance of the larger: the first pair of each group."""

    def find(g):
        rows = F.transform(_members(es, g, lambda e: S.numeric_value(e["value"]).isNotNull()), lambda e: F.struct(S.numeric_value(e["value"]).alias("v"), e.alias("e")))
        return _first_pair(rows, lambda a, b: S.relative_mismatch(a["v"], b["v"], tolerance))

    number = lambda v: F.regexp_replace(S.numeric_value(v).cast("string"), r"\.0$", "")
    return _each_group(groups, 2, find, lambda a, b: F.concat(_said(a, number), F.lit(" vs "), _said(b, number)))


def deduped(conflicts: Column) -> Column:
    """One conflict for each field and set of sources: the first, or the first that names a selection; in first-seen place."""
    mark = lambda c: F.array_sort(F.transform(c["sources"], lambda s: F.struct(s["namespace"], s["tag_id"])))
    rows = F.transform(conflicts, lambda c, i: F.struct(i.alias("i"), F.struct(c["field"], mark(c)).alias("key"), c.alias("c")))

    def once(rows):
        same = lambda x, y: x["key"].eqNullSafe(y["key"])
        firsts = F.filter(rows, lambda x: ~F.exists(rows, lambda y: (y["i"] < x["i"]) & same(x, y)))
        chosen = lambda x: F.coalesce(F.get(F.filter(rows, lambda y: same(x, y) & F.contains(y["c"]["message"], F.lit("selected"))), F.lit(0)), x)["c"]
        return F.transform(firsts, lambda x: let(chosen(x), lambda c: F.struct(x["c"]["ord"].alias("ord"), c["field"].alias("field"), c["message"].alias("message"), c["sources"].alias("sources"))))

    return let(rows, once)


def report(es: Column, fields: Column) -> Column:
    """Validation, then policy, deduplicated."""
    return deduped(F.concat(disagreeing(es), offset_differing(es), numbers_differing(es), policy(fields)))


def disagreements(entries: DataFrame, groups=R.SEMANTIC, folded=R.FOLDED) -> DataFrame:
    return spread(gathered(entries), disagreeing(F.col("es"), groups, folded))


def offset_mismatches(entries: DataFrame, groups=R.SEMANTIC[:1]) -> DataFrame:
    return spread(gathered(entries), offset_differing(F.col("es"), groups))


def dedupe(conflicts: DataFrame) -> DataFrame:
    return spread(gather(conflicts, "field", "message", "sources", name="cs"), deduped(F.col("cs")))


# --- others -------------------------------------------------------------------------------------


def first_of(es: Column, *tags: str) -> Column:
    """The first entry with one of the tags; null without one."""
    return F.get(F.filter(es, lambda e: e["tag_name"].isin(*tags)), F.lit(0))


def first_by_tag(entries: DataFrame, tags: dict[str, tuple[str, ...]]) -> DataFrame:
    return gathered(entries).select("asset_id", *(first_of(F.col("es"), *t).alias(k) for k, t in tags.items()))


def empty_assets(assets: DataFrame, entries: DataFrame) -> DataFrame:
    """Info issues of assets without entries."""
    none = assets.join(entries.select("asset_id").distinct(), "asset_id", "left_anti")
    return none.select("asset_id", F.lit("info").alias("severity"), F.lit("no_metadata_entries").alias("code"))


def enum_decode(df: DataFrame, column: str, labels: dict[int, str], name: str) -> DataFrame:
    """Label of a code, else its decimal text."""
    table = F.broadcast(df.sparkSession.createDataFrame(list(labels.items()), "code_ int, label_ string"))
    return df.join(table, F.col(column) == F.col("code_"), "left").withColumn(name, F.coalesce("label_", F.col(column).cast("string"))).drop("code_", "label_")


def capability_matrix(observed: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs on one side only, with which."""
    o, d = observed.select(*keys).distinct(), declared.select(*keys).distinct()
    return o.join(d, keys, "left_anti").withColumn("status", F.lit("undeclared")).unionByName(d.join(o, keys, "left_anti").withColumn("status", F.lit("unobserved")))
