"""Normalised fields as text to read: group, label and value with units. All in the JVM, within the asset's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import tagged

# Groups of fields by the first part of their name; the rest are General.
GROUPS = {"device": "Device", "dimensions": "Dimensions", "exposure": "Exposure", "lens": "Lens", "video": "Media", "audio": "Media", "codec": "Media", "color": "Color", "location": "Location", "headline": "Editorial", "description": "Editorial", "keywords": "Editorial"}
# Part of a field's or tag's name, prefix, suffix, digits grouped by thousands. The first that fits counts.
UNITS = [("focal", "", " mm", False), ("sample rate", "", " Hz", True), ("frame rate", "", " fps", False), ("bitrate", "", " bps", True)]


def group_title(field: Column) -> Column:
    titles = F.create_map(*(F.lit(x) for pair in GROUPS.items() for x in pair))
    return F.coalesce(titles[F.substring_index(field, ".", 1)], F.lit("General"))


def label(field: Column) -> Column:
    """exposure.focal_length_mm is Exposure · Focal Length Mm."""
    parts = F.transform(F.split(F.replace(field, F.lit("_"), F.lit(" ")), r"\."), lambda p: F.initcap(p))
    return F.array_join(parts, " · ")


def _plain(d: Column, digits: int, grouped: bool = False) -> Column:
    """A number with up to `digits` decimals, without trailing zeros."""
    text = F.format_number(d, digits)
    text = text if grouped else F.replace(text, F.lit(","), F.lit(""))
    return F.regexp_replace(text, r"\.?0+$", "") if digits else text


def _number(d: Column) -> Column:
    """A whole number without decimals, any other as its shortest text."""
    return F.when((F.abs(d) < 1e15) & (d == F.floor(d)), d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def moment(s: Column) -> Column:
    """2024-04-16T12:34:56Z is Apr 16, 2024 · 12:34:56 Z; what is not a time stays."""
    pattern = r"^(\d{4})[-:](0[1-9]|1[0-2])[-:](\d{2})[T ](\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    part = lambda k: F.regexp_extract(s, pattern, k)
    month = F.substring(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), part(2).cast("int") * 3 - 2, F.lit(3))
    zone = F.when(part(6) != "", F.concat(F.lit(" "), part(6))).otherwise("")
    said = F.concat(month, F.lit(" "), part(3).cast("int").cast("string"), F.lit(", "), part(1), F.lit(" · "), part(4), part(5), zone)
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}T") | s.rlike(r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(iso & s.rlike(pattern), said).otherwise(s)


def place(c: Column) -> Column:
    """40.4462° N, 79.9821° W"""
    axis = lambda d, plus, minus: F.concat(_plain(F.abs(d), 6, True), F.lit("° "), F.when(d >= 0, plus).otherwise(minus))
    return F.concat(axis(c["latitude"], "N", "S"), F.lit(", "), axis(c["longitude"], "E", "W"))


def ratio(r: Column) -> Column:
    """A rational as a number with up to three decimals; with a zero part as it is."""
    n, d = r["numerator"], r["denominator"]
    raw = F.concat(n.cast("string"), F.lit("/"), d.cast("string"))
    return F.when((n == 0) | (d == 0), raw).when(d == 1, n.cast("string")).otherwise(_plain(F.try_divide(n.cast("double"), d.cast("double")), 3))


def text(v: Column) -> Column:
    """A value without units; lists and bytes as JSON."""
    by = [("string", v["s"]), ("timestamp", v["s"]), ("integer", v["i"].cast("string")), ("float", _number(v["d"])), ("rational", ratio(v["r"]))]
    pair = F.concat(_number(v["c"]["latitude"]), F.lit(", "), _number(v["c"]["longitude"]))
    kinds = [F.when(v["kind"] == k, said) for k, said in by] + [F.when(v["kind"] == "coordinates", pair)]
    return F.coalesce(*kinds, F.get_json_object(tagged(v), "$.value"))


def shown(name: Column, v: Column) -> Column:
    """A value as text, by the name of its field or tag."""
    key, plain = F.lower(name), text(v)
    n, d = v["r"]["numerator"], v["r"]["denominator"]
    whole = (v["kind"] == "rational") & (n != 0) & (d != 0)
    aperture = F.when(whole, F.replace(F.format_number(F.try_divide(n.cast("double"), d.cast("double")), 1), F.lit(","), F.lit(""))).otherwise(plain)
    shutter = F.when(whole, F.concat(n.cast("string"), F.lit("/"), d.cast("string"))).otherwise(plain)
    out = F.when(v.isNull(), "—").when(v["kind"] == "timestamp", moment(v["s"])).when(v["kind"] == "coordinates", place(v["c"]))
    out = out.when(key.contains("aperture") | (key == "fnumber"), F.concat(F.lit("f/"), aperture))
    out = out.when(key.contains("shutter") | (key == "exposuretime"), F.concat(shutter, F.lit("s")))
    for part, before, after, grouped in UNITS:
        number = plain.try_cast("double")
        said = F.when(number.isNotNull() & ~F.isnan(number), _plain(number, 3, True)).otherwise(plain) if grouped else plain
        out = out.when(key.contains(part), F.when(plain == "", plain).otherwise(F.concat(F.lit(before), said, F.lit(after))))
    return out.otherwise(plain)


def pretty(analysed: DataFrame) -> DataFrame:
    """asset_id, path, title, label, value: a row for each normalised field, for people to read; sort by title and label to show."""
    f = F.col("f")
    rows = analysed.select("asset_id", "path", F.explode("normalized.fields").alias("f"))
    return rows.select("asset_id", "path", group_title(f["field"]).alias("title"), label(f["field"]).alias("label"), shown(f["field"], f["value"]).alias("value"))


__all__ = ["group_title", "label", "moment", "place", "pretty", "ratio", "shown", "text"]
