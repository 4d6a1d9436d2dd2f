"""Normalised fields, reports and JSON envelopes of decoded assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans import rules as R
from ..schemas import VALUE
from . import kernel as K

VIEWS = ("full", "raw", "interpreted", "normalized", "report")
SCHEMA_VERSION = "0.1.0"

# Fixed values: (field, base tag, subsecond tag, offset tag).
STAMPS = [("captured_at", "DateTimeOriginal", "SubSecTimeOriginal", "OffsetTimeOriginal"), ("created_at", "CreateDate", "SubSecTimeDigitized", "OffsetTimeDigitized"), ("modified_at", "ModifyDate", "SubSecTime", "OffsetTime")]


def _value(kind: str, **parts: Column) -> Column:
    names = ("s", "i", "d", "r", "rl", "b", "c")
    return F.struct(F.lit(kind).alias("kind"), *(parts.get(n, F.lit(None)).alias(n) for n in names)).cast(VALUE)


def _field(place: Column, field: Column, value: Column, confidence: float, sources: Column, notes: Column) -> Column:
    return F.struct(place.alias("place"), field.alias("field"), value.alias("value"), F.lit(confidence).cast("float").alias("confidence"), sources.alias("sources"), notes.cast("array<string>").alias("notes"))


def _times(es: Column) -> Column:
    """Times composed from a base, subseconds and an offset: (field, s, note)."""

    def whole(field, base, sub, off):
        def made(x):
            note = F.concat(F.lit(f"enriched from EXIF {base}"), F.when(x["sub"].isNotNull(), f", {sub}").otherwise(""), F.when(x["off"].isNotNull(), f", {off}").otherwise(""))
            note = F.when(x["sub"].isNotNull() | x["off"].isNotNull(), note)
            return F.when(x["base"].isNotNull(), F.struct(F.lit(field).alias("field"), S.compose_timestamp(x["base"], x["sub"], x["off"]).alias("s"), note.alias("note")))

        said = (S.string_value(K.first_of(es, tag)["value"]).alias(name) for tag, name in ((base, "base"), (sub, "sub"), (off, "off")))
        return K.let(F.struct(*said), made)

    return F.filter(F.array(*(whole(*s) for s in STAMPS)), lambda t: t["s"].isNotNull())


def normalized(es: Column, fields: Column) -> Column:
    """(place, field, value, confidence, sources, notes): reconciled fields, enriched times, dimensions, location, keywords."""

    def plain(f):
        w = f["winner"]["value"]
        return F.when(f["chooser"] == "timestamp", _value("timestamp", s=S.normalize_timestamp(w["s"]))).when(f["chooser"] == "float_like", _value("float", d=S.numeric_value(w))).otherwise(w)

    def enriched(f, times):
        def of(t):
            value = F.when(t.isNotNull(), _value("timestamp", s=t["s"])).otherwise(plain(f))
            notes = F.when(t["note"].isNotNull(), F.concat(f["notes"], F.array(t["note"]))).otherwise(f["notes"])
            return _field(f["rule_ord"], f["field"], value, 0.95, F.array(f["winner"]["provenance"]), notes)

        return K.let(F.get(F.filter(times, lambda t: t["field"] == f["field"]), F.lit(0)), of)

    base = K.let(_times(es), lambda times: F.transform(fields, lambda f: enriched(f, times)))
    tags = {"w": ("ImageWidth", "ExifImageWidth"), "h": ("ImageHeight", "ExifImageHeight"), "lat": ("GPSLatitude",), "lon": ("GPSLongitude",), "latr": ("GPSLatitudeRef",), "lonr": ("GPSLongitudeRef",)}
    none = F.array().cast("array<string>")

    def derived(x):
        v = lambda c: x[c]["value"]
        both = (v("w")["kind"] == "integer") & (v("h")["kind"] == "integer")
        sides = [F.when(both, _field(F.lit(100 + i), F.lit(f"dimensions.{n}"), v(c), 0.95, F.array(x[c]["provenance"]), none)) for i, (n, c) in enumerate((("width", "w"), ("height", "h")))]
        dms = [S.dms_to_decimal(v(c)["rl"], v(f"{c}r")["s"]) for c in ("lat", "lon")]
        text = [S.parse_double(F.when(v(c)["kind"] == "string", v(c)["s"])) for c in ("lat", "lon")]
        number = [F.when(v(c)["kind"] == "float", v(c)["d"]) for c in ("lat", "lon")]
        pair = lambda p: F.when(p[0].isNotNull() & p[1].isNotNull(), F.struct(p[0].alias("latitude"), p[1].alias("longitude")))
        location = lambda at: F.when(at.isNotNull(), _field(F.lit(200), F.lit("location"), _value("coordinates", c=at), 0.9, F.array(x["lat"]["provenance"], x["lon"]["provenance"]), none))
        return F.array(*sides, K.let(F.coalesce(pair(dms), pair(text), pair(number)), location))

    more = K.let(F.struct(*(K.first_of(es, *t).alias(k) for k, t in tags.items())), derived)
    words = F.filter(es, lambda e: (e["tag_name"] == "Keywords") & (e["value"]["kind"] == "string"))
    joined = lambda w: F.array_join(F.transform(w, lambda e: e["value"]["s"]), ", ")
    keywords = K.let(words, lambda w: F.when(F.size(w) > 0, _field(F.lit(300), F.lit("keywords"), _value("string", s=joined(w)), 0.9, F.array(F.get(w, F.lit(0))["provenance"]), F.array(F.lit("derived from repeated Keywords metadata")))))
    fresh = lambda have: F.concat(have, F.filter(F.array_compact(more), lambda x: ~F.exists(have, lambda h: h["field"] == x["field"])), F.array_compact(F.array(keywords)))
    return K.let(base, fresh)


def normalize(entries: DataFrame, rules=R.RULES) -> DataFrame:
    """The normalised fields of a frame of entries, a row each."""
    rows = K.gathered(entries).withColumn("fields", K.reconciled(F.col("es"), rules))
    return K.spread(rows, normalized(F.col("es"), F.col("fields")))


def conflicts(entries: DataFrame, rules=R.RULES) -> DataFrame:
    rows = K.gathered(entries).withColumn("fields", K.reconciled(F.col("es"), rules))
    return K.spread(rows, K.report(F.col("es"), F.col("fields")))


def tagged(v: Column) -> Column:
    """A value as JSON text {"kind", "value"}; bytes are a list of numbers."""
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(v["b"])), lambda i: F.conv(F.hex(F.substring(v["b"], i, F.lit(1))), 16, 10).cast("int"))
    octets = F.when(F.octet_length(v["b"]) > 0, octets).otherwise(F.array().cast("array<int>"))
    parts = [("string", v["s"]), ("timestamp", v["s"]), ("integer", v["i"]), ("float", v["d"]), ("rational", v["r"]), ("rational_list", v["rl"]), ("bytes", octets), ("coordinates", v["c"])]
    return F.coalesce(*(F.when(v["kind"] == k, F.to_json(F.struct(v["kind"].alias("kind"), x.alias("value")))) for k, x in parts))


def _some(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def _source(p: Column) -> Column:
    return F.struct(*(p[k].alias(k) for k in ("container", "namespace", "path", "offset_start", "offset_end")), _some(p["notes"]).alias("notes"))


def _entry_json(e: Column, *more: str) -> Column:
    extra = [_some(e["notes"]).alias("notes")] if "notes" in more else []
    return F.struct(*(e[k].alias(k) for k in ("namespace", "tag_id", "tag_name")), F.parse_json(tagged(e["value"])).alias("value"), _source(e["provenance"]).alias("provenance"), *extra)


def analysis(decoded: DataFrame, view: str = "full", rules=R.RULES) -> DataFrame:
    """asset_id, path, detected_format, status, error_message, raw, interpreted, normalized, report and schema_version of each asset, by view.

    All within the asset's row: an asset is decoded once, and nothing is shuffled.
    """
    if view not in VIEWS:
        raise ValueError(f"unknown view {view}")
    es, fields = F.col("_es"), F.col("_fields")
    rows = decoded.withColumn("_es", F.transform("entries", lambda e: F.struct(e["ord"].alias("ord"), *(e[k].alias(k) for k in K.KEEP))))
    rows = rows.withColumn("_fields", K.reconciled(es, rules))
    cols = [F.struct(F.col("issues"), K.report(es, fields).alias("conflicts")).alias("report")]
    if view in ("full", "normalized"):
        cols.append(F.struct(normalized(es, fields).alias("fields")).alias("normalized"))
    if view in ("full", "raw"):
        cols.append(F.struct(F.col("nodes").alias("containers"), F.col("entries").alias("metadata")).alias("raw"))
    if view in ("full", "interpreted"):
        cols.append(F.struct(F.col("entries").alias("metadata")).alias("interpreted"))
    return rows.select("asset_id", "path", "size_bytes", "detected_format", "container", "status", "error_message", F.lit(SCHEMA_VERSION).alias("schema_version"), *cols)


def to_json(analysed: DataFrame, pretty: bool = False) -> DataFrame:
    """asset_id and json: the documents of fixed version. Absent and empty members are left out, but a report's lists are always there."""
    without = lambda a, *names: F.transform(a, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    metadata = lambda a: F.transform(a, lambda e: _entry_json(e, "notes"))
    have = analysed.columns
    doc = [F.col("schema_version"), F.struct("path", "detected_format", "container").alias("input")]
    doc += [F.when(F.col("status") != "ok", F.col(c)).alias(c) for c in ("status", "error_message")]
    if "raw" in have:
        doc.append(F.struct(without(F.col("raw.containers"), "kind", "label", "offset_start", "offset_end", "parent_label").alias("containers"), metadata(F.col("raw.metadata")).alias("metadata")).alias("raw"))
    if "interpreted" in have:
        doc.append(F.struct(metadata(F.col("interpreted.metadata")).alias("metadata")).alias("interpreted"))
    if "normalized" in have:
        field = lambda f: F.struct(f["field"].alias("field"), F.parse_json(tagged(f["value"])).alias("value"), f["confidence"].cast("double").alias("confidence"), F.transform(f["sources"], _source).alias("sources"), _some(f["notes"]).alias("notes"))
        doc.append(F.struct(F.transform("normalized.fields", field).alias("fields")).alias("normalized"))
    conflict = lambda c: F.struct(c["field"].alias("field"), c["message"].alias("message"), F.transform(c["sources"], lambda x: _entry_json(x)).alias("sources"))
    doc.append(F.struct(without(F.col("report.issues"), "severity", "code", "message", "offset", "context").alias("issues"), F.transform("report.conflicts", conflict).alias("conflicts")).alias("report"))
    return analysed.select("asset_id", F.to_json(F.struct(*doc), {"pretty": "true"} if pretty else {}).alias("json"))


def probe(decoded: DataFrame) -> DataFrame:
    """asset_id and json of assets decoded with probe=True: containers and issues, no namespaces."""
    without = lambda a, *names: F.transform(a, lambda x: F.struct(*(x[n].alias(n) for n in names)))
    nodes = without(F.col("nodes"), "kind", "label", "offset_start", "offset_end", "parent_label").alias("containers")
    issues = without(F.col("issues"), "severity", "code", "message", "offset", "context").alias("issues")
    report = F.struct(issues, F.array().cast("array<string>").alias("conflicts")).alias("report")
    return decoded.select("asset_id", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct("path", "detected_format", "container").alias("input"), nodes, report)).alias("json"))


def capabilities(decoded: DataFrame) -> DataFrame:
    """Namespaces seen for each format."""
    rows = decoded.select("detected_format", F.explode(F.array_distinct(F.transform("entries", lambda e: e["namespace"]))).alias("namespace"))
    return rows.distinct()


__all__ = ["analysis", "capabilities", "conflicts", "normalize", "normalized", "probe", "tagged", "to_json"]
