"""Queries that exercise the metadata operators over the driver's tables, treated as evidence about assets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import display as D
from .operators import kernel as K
from .operators import views as V
from .plans import rules as R
from .schemas import ENTRY, ISSUE, NODE, VALUE

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def value(kind, s=None, i=None, d=None):
    """A tagged value from columns."""
    none = F.lit(None)
    return F.struct(kind.alias("kind"), (none if s is None else s).cast("string").alias("s"), (none if i is None else i).cast("bigint").alias("i"), (none if d is None else d).cast("double").alias("d"), none.alias("r"), none.alias("rl"), none.alias("b"), none.alias("c")).cast(VALUE)


def days(spark, sf) -> DataFrame:
    """Entries: the asset is a user's day, the namespace an event's type, the value the event's k: an integer if even, else a text."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    asset = F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    e = e.select(asset.alias("asset_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("namespace"), F.lit("Event").alias("tag_name"), k.alias("k"))
    even = F.col("k") % 2 == 0
    return e.withColumn("value", value(F.when(even, "integer").otherwise("string"), F.when(~even, F.col("k")), F.when(even, F.col("k"))))


DAYS = """WITH d AS (SELECT CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d') asset_id, event_id ord, event_type ns, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events),
"""


def rule(prefs, chooser="any"):
    return [("value", chooser, ["Event"], prefs)]


def _winner(spark, sf, prefs):
    w = K.reconcile(days(spark, sf), rule(prefs))
    return w.select("asset_id", F.col("winner.ord").alias("winner_ord"), F.col("winner.namespace").alias("winner_namespace"), F.col("n_candidates").cast("bigint").alias("n_candidates"))


def _winner_sql(rank, where=""):
    return DAYS + f"""w AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {rank}, ord) rn, count(*) OVER (PARTITION BY asset_id) n_candidates,
 max(CASE WHEN ns = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id) bought FROM d)
SELECT asset_id, ord winner_ord, ns winner_namespace, n_candidates FROM w WHERE rn = 1 {where}"""


FIRST = "CASE WHEN ns = 'purchase' THEN 0 ELSE 1 END"


@query(_winner_sql(FIRST))
def reconcile_winner(spark, sf):
    return _winner(spark, sf, ["purchase"])


@query(_winner_sql(FIRST, "AND bought = 0"))
def reconcile_fallback_first(spark, sf):
    return _winner(spark, sf, ["purchase"]).where("winner_namespace <> 'purchase'")


@query(_winner_sql("CASE ns WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END"))
def reconcile_multi_pref(spark, sf):
    return _winner(spark, sf, ["purchase", "signup"])


DIFF = DAYS + f"""w AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {FIRST}, ord) rn FROM d),
p AS (SELECT a.asset_id, a.ord winner_ord, a.ns, a.k, count(*) - 1 competing, sum(CASE WHEN b.ord <> a.ord AND b.k <> a.k THEN 1 ELSE 0 END) n_differing
      FROM w a JOIN w b ON a.asset_id = b.asset_id WHERE a.rn = 1 GROUP BY ALL)
"""


@query(DIFF + "SELECT asset_id, winner_ord, CAST(competing AS BIGINT) competing, CAST(n_differing AS BIGINT) n_differing, n_differing > 0 has_conflict FROM p")
def material_difference(spark, sf):
    f = K.reconcile(days(spark, sf), rule(["purchase"]))
    return f.select("asset_id", F.col("winner.ord").alias("winner_ord"), (F.col("n_candidates") - 1).cast("bigint").alias("competing"), F.size("differing").cast("bigint").alias("n_differing"), (F.size("differing") > 0).alias("has_conflict"))


@query(DIFF + "SELECT asset_id, winner_ord, k AS value, CASE WHEN n_differing > 0 THEN 'selected Event from ' || ns || ' over ' || competing || ' competing candidate(s)' END AS note FROM p WHERE k % 2 = 0")
def kind_mismatch_suppression(spark, sf):
    f = K.reconcile(days(spark, sf), rule(["purchase"], "integer"))
    return f.select("asset_id", F.col("winner.ord").alias("winner_ord"), F.col("winner.value.i").alias("value"), F.col("conflict_note").alias("note"))


@query(DAYS + f"""w AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY {FIRST}, ord) rn FROM d)
SELECT a.asset_id, a.ns || '=' || a.k || ',' || string_agg(b.ns || '=' || b.k, ',' ORDER BY b.ord) sides FROM w a JOIN w b ON a.asset_id = b.asset_id WHERE a.rn = 1 AND b.ord <> a.ord AND b.k <> a.k GROUP BY a.asset_id, a.ns, a.k""")
def conflict_sides(spark, sf):
    assets = K.gathered(days(spark, sf))
    found = K.spread(assets, K.policy(K.reconciled(F.col("es"), rule(["purchase"]))))
    said = F.transform("sources", lambda e: F.concat(e["namespace"], F.lit("="), F.coalesce(e["value"]["s"], e["value"]["i"].cast("string"))))
    return found.select("asset_id", F.array_join(said, ",").alias("sides"))


@query(DIFF + """SELECT asset_id, concat_ws(' | ', CASE WHEN n_differing > 0 THEN 'selected Event from ' || CASE ns WHEN 'purchase' THEN 'icc' ELSE ns END || ' over ' || competing || ' competing candidate(s)' END,
 CASE WHEN ns = 'purchase' THEN 'selected bounded ICC metadata as authoritative color-profile source' END) notes FROM p""")
def icc_note(spark, sf):
    e = days(spark, sf).withColumn("namespace", F.when(F.col("namespace") == "purchase", "icc").otherwise(F.col("namespace")))
    return K.reconcile(e, [("color.space", "any", ["Event"], ["icc"])]).select("asset_id", F.array_join("notes", " | ").alias("notes"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events), c(chooser, kinds) AS (VALUES ('string', [0, 1]), ('timestamp', [0, 1]), ('integer', [2]), ('float', [3]), ('rational', [4]), ('float_like', [2, 3, 4]), ('any', [0, 1, 2, 3, 4, 5]))
SELECT event_id asset_id, chooser AS field FROM e JOIN c ON list_contains(kinds, CAST(k % 6 AS INTEGER)) AND NOT (chooser = 'float_like' AND k % 12 = 4)""")
def chooser_kinds(spark, sf):
    """Which choosers accept a value of each kind; a rational over 0 is no number."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("asset_id"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    case = F.col("k") % 6
    kind = F.element_at(F.array(*map(F.lit, ("string", "timestamp", "integer", "float", "rational", "bytes"))), (case + 1).cast("int"))
    ratio = F.struct(F.col("k").alias("numerator"), F.when(F.col("k") % 12 == 4, 0).otherwise(1).cast("bigint").alias("denominator"))
    v = value(kind, F.when(case < 2, F.col("k")), F.when(case == 2, F.col("k")), F.when(case == 3, F.col("k"))).withField("r", F.when(case == 4, ratio)).withField("b", F.when(case == 5, F.lit(b"x")))
    rows = e.select("asset_id", F.lit(0).alias("ord"), F.lit("x").alias("namespace"), F.lit("Event").alias("tag_name"), v.alias("value"))
    choosers = ("string", "timestamp", "integer", "float", "rational", "float_like", "any")
    return K.reconcile(rows, [(c, c, ["Event"], ["x"]) for c in choosers]).select("asset_id", "field")


@query(DAYS + "f AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ord) rn FROM d) SELECT asset_id, CASE WHEN k % 2 = 0 THEN k END AS value FROM f WHERE rn = 1")
def first_by_tag_kind(spark, sf):
    f = K.first_by_tag(days(spark, sf), {"e": ("Event",)})
    return f.select("asset_id", F.when(F.col("e.value.kind") == "integer", F.col("e.value.i")).alias("value"))


def _two_sources(spark, sf, first, second):
    """Entries of two namespaces, x and y, for each page id."""
    a, b = (f.select(F.col("id").alias("asset_id"), F.lit(o).alias("ord"), F.lit(ns).alias("namespace"), F.lit("Text").alias("tag_name"), value(F.lit("string"), F.col("v")).alias("value")).where("value.s is not null") for o, ns, f in ((0, "x", first), (1, "y", second)))
    return a.unionByName(b)


PAIR = [("device.text", [("x", "Text"), ("y", "Text")])]


@query("""WITH x AS (SELECT doc_id id, lang a, regexp_extract(html, 'lang="([^"]*)"', 1) b FROM documents JOIN pages ON doc_id = page_id)
SELECT id asset_id, CASE WHEN lower(trim(a)) < lower(trim(b)) THEN 'x:Text=' || a || ' vs y:Text=' || b ELSE 'y:Text=' || b || ' vs x:Text=' || a END message FROM x WHERE b <> '' AND lower(trim(a)) <> lower(trim(b))""")
def cross_source_disagreement(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), S.find_text(F.col("html"), "lang").alias("v"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("v")).join(pages.select("id"), "id", "left_semi")
    return K.disagreements(_two_sources(spark, sf, docs, pages), PAIR, folded=("device.text",)).select("asset_id", "message")


@query("SELECT count(*) n_assets, CAST(coalesce(sum(CASE WHEN trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) <> trim(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)) THEN 1 ELSE 0 END), 0) AS BIGINT) n_conflicts FROM pages")
def cross_source_agreement(spark, sf):
    pages = table(spark, sf, "pages")
    one, two = (pages.select(F.col("page_id").alias("id"), S.find_text(F.col("html"), n).alias("v")) for n in ("title", "h1"))
    found = K.disagreements(_two_sources(spark, sf, one, two), PAIR)
    return pages.agg(F.count(F.lit(1)).alias("n_assets")).crossJoin(found.agg(F.count(F.lit(1)).alias("n_conflicts")))  # one row each


def lines(spark, sf) -> DataFrame:
    """Entries: the asset is an order, its lines in a total order, the value a discount."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    x = table(spark, sf, "lineitem").withColumn("ord", F.row_number().over(order))
    return x.select(F.col("l_orderkey").alias("asset_id"), "ord", F.lit("exif").alias("namespace"), F.lit("FNumber").alias("tag_name"), value(F.lit("float"), d=F.col("l_discount") + F.lit(0.0)).alias("value"))


LINES = """WITH l AS (SELECT l_orderkey asset_id, l_discount + 0.0 v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) ord FROM lineitem),
p AS (SELECT a.asset_id, a.ord a_ord, b.ord b_ord, a.v a_value, b.v b_value FROM l a JOIN l b ON a.asset_id = b.asset_id AND a.ord < b.ord
      WHERE greatest(abs(a.v), abs(b.v)) <> 0 AND abs(a.v - b.v) / greatest(abs(a.v), abs(b.v)) > 0.005)
"""


def _pairs(spark, sf) -> DataFrame:
    """For each order, the pairs of lines whose numbers differ."""
    rows = F.transform("es", lambda e: F.struct(e["ord"].alias("ord"), S.numeric_value(e["value"]).alias("v")))
    return K.gathered(lines(spark, sf)).select("asset_id", K.pairs(rows, lambda a, b: S.relative_mismatch(a["v"], b["v"])).alias("p"))


@query(LINES + "SELECT asset_id, count(*) n_pairs FROM p GROUP BY asset_id")
def numeric_precision_mismatch(spark, sf):
    found = _pairs(spark, sf).select("asset_id", F.size("p").cast("bigint").alias("n_pairs"))
    return found.where("n_pairs > 0")


@query(LINES + "SELECT asset_id, a_ord, b_ord, a_value, b_value FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY a_ord, b_ord) rn FROM p) WHERE rn = 1")
def numeric_pair_first(spark, sf):
    first = _pairs(spark, sf).select("asset_id", F.get("p", F.lit(0)).alias("p")).where("p is not null")
    return first.select("asset_id", F.col("p.a.ord").cast("bigint").alias("a_ord"), F.col("p.b.ord").cast("bigint").alias("b_ord"), F.col("p.a.v").alias("a_value"), F.col("p.b.v").alias("b_value"))


@query("""WITH o AS (SELECT o_orderkey k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') w FROM orders),
x AS (SELECT k, w || CASE k % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END a, w || CASE k % 4 WHEN 0 THEN '+00:00' WHEN 1 THEN '+0200' WHEN 2 THEN '-05:30' ELSE '' END b,
 CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 120 END oa, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 120 WHEN 2 THEN -330 END ob FROM o)
SELECT k asset_id, 'timezone offset disagreement: exif:DateTimeOriginal=' || a || ' vs xmp:CreateDate=' || b message FROM x WHERE oa IS DISTINCT FROM ob""")
def timestamp_offset_mismatch(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("w"))
    pick = lambda m, names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % m + 1).cast("int"))
    a, b = F.concat("w", pick(3, ["Z", "+02:00", ""])), F.concat("w", pick(4, ["+00:00", "+0200", "-05:30", ""]))
    rows = o.select(F.col("k").alias("asset_id"), F.explode(F.array(F.struct(F.lit(0).alias("ord"), F.lit("exif").alias("namespace"), F.lit("DateTimeOriginal").alias("tag_name"), a.alias("t")), F.struct(F.lit(1).alias("ord"), F.lit("xmp").alias("namespace"), F.lit("CreateDate").alias("tag_name"), b.alias("t")))).alias("e"))
    rows = rows.select("asset_id", "e.ord", "e.namespace", "e.tag_name", value(F.lit("timestamp"), F.col("e.t")).alias("value"))
    return K.offset_mismatches(rows).select("asset_id", "message")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS value FROM orders")
def timestamp_normalize(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.normalize_timestamp(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")).alias("value"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || CAST(event_id % 1000 AS VARCHAR) || CASE event_id % 3 WHEN 0 THEN '+01:00' ELSE '' END END AS value FROM events""")
def timestamp_compose(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id") % 3
    base, sub = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.concat(F.lit(" .."), (F.col("event_id") % 1000).cast("string"))
    return e.select("event_id", S.compose_timestamp(base, sub, F.when(k == 0, "+01:00").when(k == 2, "UTC")).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END wall, CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN -330 WHEN 2 THEN 120 END AS INTEGER) AS minutes FROM orders""")
def timestamp_parse_offset(spark, sf):
    tail = F.element_at(F.array(*map(F.lit, ["Z", "-05:30", "+0200", "", "noon"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = table(spark, sf, "orders").withColumn("t", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), tail))
    return o.select("o_orderkey", S.wall_clock(F.col("t")).alias("wall"), S.offset_minutes(F.col("t")).alias("minutes"))


KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


@query(f"""SELECT {KEYS}, CASE WHEN l_linenumber = 7 THEN NULL ELSE round((CASE WHEN l_suppkey % 2 = 0 THEN -1 ELSE 1 END) * (l_partkey % 90 + l_linenumber / 60.0 + l_quantity / 100.0 / 3600), 12) END AS degrees FROM lineitem""")
def gps_dms_decimal(spark, sf):
    r = lambda n, d: F.struct(n.cast("bigint").alias("numerator"), d.cast("bigint").alias("denominator"))
    one = F.lit(1)
    dms = F.array(r(F.col("l_partkey") % 90, one), r(F.col("l_linenumber"), F.when(F.col("l_linenumber") == 7, 0).otherwise(1)), r(F.col("l_quantity"), F.lit(100)))
    return table(spark, sf, "lineitem").select(*KEYS.split(", "), F.round(S.dms_to_decimal(dms, F.when(F.col("l_suppkey") % 2 == 0, "S").otherwise("N")), 12).alias("degrees"))


@query("""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k, value v FROM events)
SELECT event_id, CASE k % 4 WHEN 0 THEN 'rational' WHEN 1 THEN 'string' WHEN 2 THEN 'float' END kind, CASE WHEN k % 4 = 3 THEN NULL ELSE CAST(k AS DOUBLE) END AS degrees FROM e""")
def coordinate_fallback(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = table(spark, sf, "events").select("event_id", k.alias("k"))
    case = F.col("k") % 4
    kind = F.when(case == 0, "rational").when(case == 2, "float").otherwise("string")
    text = F.when(case == 1, F.concat(F.lit(" "), F.col("k").cast("string"), F.lit("\t"))).when(case == 3, F.concat(F.col("k").cast("string"), F.lit("d")))
    dms = F.array(*(F.struct(x.cast("bigint").alias("numerator"), F.lit(1).cast("bigint").alias("denominator")) for x in (F.col("k"), F.lit(0), F.lit(0))))
    v = value(kind, text, d=F.when(case == 2, F.col("k"))).withField("rl", F.when(case == 0, dms))
    tags = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(t).alias("tag_name")) for i, t in enumerate(("GPSLatitude", "GPSLongitude")))))
    rows = e.select(F.col("event_id").alias("asset_id"), F.lit("exif").alias("namespace"), v.alias("value"), kind.alias("provenance"), tags.alias("t")).select("*", "t.*")
    found = V.normalize(rows).where("field = 'location'").select(F.col("asset_id").alias("event_id"), F.get("sources", F.lit(0)).alias("kind"), F.col("value.c.latitude").alias("degrees"))
    return e.select("event_id").join(found, "event_id", "left")


@query("""SELECT c_custkey, CAST(CASE WHEN c_acctbal < 0 THEN '-' ELSE '+' END || CAST(CAST(floor(abs(c_acctbal)) AS BIGINT) AS VARCHAR) || '.5' AS DOUBLE) latitude, CAST(-(c_custkey % 180) AS DOUBLE) longitude, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 7 AS DOUBLE) END altitude FROM customer""")
def iso6709_split(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise("+"), F.floor(F.abs("c_acctbal")).cast("string"), F.lit(".5-"), (F.col("c_custkey") % 180).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("+"), (F.col("c_custkey") % 7).cast("string"))).otherwise(""), F.lit("/"))
    part = lambda k: F.try_element_at(S.iso6709(text), F.lit(k)) + F.lit(0.0)
    return c.select("c_custkey", part(1).alias("latitude"), part(2).alias("longitude"), part(3).alias("altitude"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(to_timestamp(o_orderkey * 1000)::TIMESTAMP, '%Y-%m-%dT%H:%M:%S') END AS value FROM orders")
def qt_epoch_iso(spark, sf):
    at = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") * 1000 + S.QT_EPOCH)
    return table(spark, sf, "orders").select("o_orderkey", S.qt_seconds_to_iso(at).alias("value"))


@query(f"SELECT {KEYS}, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity / (l_linenumber % 3) END AS seconds FROM lineitem")
def duration_seconds(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS.split(", "), S.duration_seconds(F.col("l_quantity"), F.col("l_linenumber") % 3).alias("seconds"))


@query(f"SELECT {KEYS}, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_partkey = 0 THEN NULL ELSE CAST(floor(l_partkey * 8.0 / (l_linenumber % 3) + 0.5) AS BIGINT) END AS bits FROM lineitem")
def bitrate_derive(spark, sf):
    return table(spark, sf, "lineitem").select(*KEYS.split(", "), S.bitrate(F.col("l_partkey"), (F.col("l_linenumber") % 3).cast("double")).alias("bits"))


@query("""SELECT page_id, regexp_extract(html, 'lang="([^"]*)"', 1) lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) title FROM pages""")
def attr_then_element_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.find_text(F.col("html"), "lang").alias("lang"), S.find_text(F.col("html"), "headline", "title").alias("title"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) l FROM pages), y AS (SELECT page_id, unnest(l) item, unnest(range(len(l))) pos FROM x) SELECT page_id, CAST(pos AS INTEGER) pos, item FROM y""")
def list_element_scan(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(S.find_list(F.col("html"), "li")).alias("pos", "item"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(replace(html || '&lt;' || page_id || '&quot;&apos;&amp;lt;', '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&')) digest FROM pages""")
def xml_unescape(spark, sf):
    text = F.concat("html", F.lit("&lt;"), F.col("page_id").cast("string"), F.lit("&quot;&apos;&amp;lt;"))
    return table(spark, sf, "pages").select("page_id", F.md5(S.xml_unescape(text).cast("binary")).alias("digest"))


@query(DAYS + "x AS (SELECT 1) SELECT asset_id, string_agg(ns, ', ' ORDER BY ord) keywords FROM d GROUP BY asset_id")
def keywords_concat(spark, sf):
    rows = days(spark, sf).withColumn("tag_name", F.lit("Keywords")).withColumn("value", value(F.lit("string"), F.col("namespace")))
    return V.normalize(rows).where("field = 'keywords'").select("asset_id", F.col("value.s").alias("keywords"))


def _conflicts(spark, sf):
    """A conflict for each line of an order; its message names a selection for odd parts."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    x = table(spark, sf, "lineitem").withColumn("n", F.row_number().over(order))
    message = F.concat(F.when(F.col("l_partkey") % 2 == 1, "selected ").otherwise("pair "), F.col("n").cast("string"))
    source = F.array(F.struct(F.lit("exif").alias("namespace"), F.col("l_linenumber").cast("string").alias("tag_id")))
    return x.select(F.col("l_orderkey").alias("asset_id"), F.struct(F.lit(0).alias("source"), F.lit(0).alias("rule"), "n").alias("ord"), F.lit("line").alias("field"), message.alias("message"), source.alias("sources"))


@query("""WITH x AS (SELECT l_orderkey asset_id, l_linenumber line, l_partkey % 2 odd, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) n FROM lineitem),
y AS (SELECT *, row_number() OVER (PARTITION BY asset_id, line ORDER BY 1 - odd, n) rn, min(n) OVER (PARTITION BY asset_id, line) place FROM x)
SELECT asset_id, CAST(place AS INTEGER) place, CASE WHEN odd = 1 THEN 'selected ' ELSE 'pair ' END || n message FROM y WHERE rn = 1""")
def conflict_dedupe(spark, sf):
    return K.dedupe(_conflicts(spark, sf)).select("asset_id", F.col("ord.n").alias("place"), "message")


@query(DIFF + """, v AS (SELECT asset_id, arg_min(k, ord) k0, count(DISTINCT k) n FROM d GROUP BY asset_id HAVING count(DISTINCT k) > 1),
u AS (SELECT asset_id, 0 source FROM v UNION ALL SELECT asset_id, 1 FROM p WHERE n_differing > 0)
SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY source) AS INTEGER) place, source FROM u""")
def report_union(spark, sf):
    from pyspark.sql import Window

    e = days(spark, sf).withColumn("value", value(F.lit("string"), F.col("k")))
    groups = [("value", [(ns, "Event") for ns in ("purchase", "signup", "click", "view", "error")])]
    checks = K.disagreements(e, groups).select("asset_id", F.col("ord.source").alias("source"))
    policy = K.spread(K.gathered(days(spark, sf)), K.policy(K.reconciled(F.col("es"), rule(["purchase"])))).select("asset_id", F.col("ord.source").alias("source"))
    place = F.row_number().over(Window.partitionBy("asset_id").orderBy("source"))
    return checks.unionByName(policy).select("asset_id", place.alias("place"), "source")


@query("SELECT o_orderkey asset_id, 'info' severity, 'no_metadata_entries' code FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def empty_asset_issue(spark, sf):
    return K.empty_assets(table(spark, sf, "orders").select(F.col("o_orderkey").alias("asset_id")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("asset_id")))


@query("""WITH o AS (SELECT DISTINCT event_type, CAST(hour(ts) AS INTEGER) h FROM events), d AS (SELECT * FROM (VALUES ('purchase'), ('refund')) t(event_type), (SELECT CAST(unnest(range(0, 12)) AS INTEGER) h))
SELECT event_type, h, 'undeclared' status FROM (SELECT * FROM o EXCEPT SELECT * FROM d) UNION ALL SELECT event_type, h, 'unobserved' FROM (SELECT * FROM d EXCEPT SELECT * FROM o)""")
def capability_matrix(spark, sf):
    observed = table(spark, sf, "events").select("event_type", F.hour("ts").alias("h"))
    declared = spark.createDataFrame([(t, h) for t in ("purchase", "refund") for h in range(12)], "event_type string, h int")
    return K.capability_matrix(observed, declared, ["event_type", "h"])


@query(DAYS + "n AS (SELECT asset_id, count(*) n_raw FROM d GROUP BY asset_id) SELECT asset_id, n_raw, CAST(1 AS BIGINT) n_normalized FROM n")
def view_projection_json(spark, sf):
    entry = F.struct(F.col("ord").cast("int").alias("ord"), "namespace", F.lit("").alias("tag_id"), "tag_name", "value", F.lit(None).alias("provenance"), F.lit(None).alias("notes"))
    assets = days(spark, sf).groupBy("asset_id").agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e"))), lambda a, b: (a["ord"] - b["ord"]).cast("int")).alias("e"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    made = {"path": F.col("asset_id"), "size_bytes": F.lit(0).cast("bigint"), "detected_format": F.lit("events"), "container": F.lit("events"), "status": F.lit("ok"), "error_message": F.lit(None).cast("string"), "nodes": none(NODE), "issues": none(ISSUE), "entries": F.transform("e", lambda x: x["e"]).cast(f"array<{ENTRY}>")}
    text = V.to_json(V.analysis(assets.withColumns(made), "full", rule(["purchase"])))
    size = lambda path: F.json_array_length(F.get_json_object("json", path)).cast("bigint")
    return text.select("asset_id", size("$.raw.metadata").alias("n_raw"), size("$.normalized.fields").alias("n_normalized"))


# Leading bytes and the format they tell, as text; a brand stands first, or last among others.
HEADS = """jpeg FFD8
png 89504E470D0A1A0A
tiff 49492A00
tiff 4D4D002A
webp 524946460000000057454250
flac 664C6143
aiff 464F524D0000000041494646
aiff 464F524D0000000041494643
ogg 4F676753
none 524946460000000057415645
none 6E6F6E65"""
BRANDS = """heif major mif1 msf1 heic heix hevc heim heis avif avis
heif other mif1 msf1 heic heix hevc heim heis avif avis
mov major qt
none other qt
m4a major M4A M4B M4P
none other M4A M4B M4P
mp4 major isom iso2 mp41 mp42 avc1 M4V 3gp4 3gp5 3g2a
mp4 other isom iso2 mp41 mp42 avc1 M4V 3gp4 3gp5 3g2a
none major hevx jpeg"""


def _heads():
    """(format, bytes) of each signature and brand."""
    out = [(name, bytes.fromhex(h)) for name, h in (line.split() for line in HEADS.split("\n"))]
    for name, where, *brands in (line.split() for line in BRANDS.split("\n")):
        for b in (x.ljust(4).encode() for x in brands):
            out.append((name, b"\0\0\0\x18ftyp" + (b + b"\0\0\0\0zzzzzzzz" if where == "major" else b"zzzz\0\0\0\0zzzz" + b)))
    return out


@query("SELECT doc_id, CASE doc_id % " + str(len(_heads())) + " " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(_heads()) if name != "none") + " END format FROM documents")
def magic_detect(spark, sf):
    heads = [h for _, h in _heads()]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % len(heads) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", S.detect_format(F.concat(head, F.col("text").cast("binary"))).alias("format"))


@query(f"SELECT {KEYS}, CASE l_linenumber WHEN 1 THEN 'Horizontal' WHEN 3 THEN 'Rotate 180' WHEN 6 THEN 'Rotate 90 CW' ELSE CAST(l_linenumber AS VARCHAR) END AS label FROM lineitem")
def enum_decode(spark, sf):
    labels = {1: "Horizontal", 3: "Rotate 180", 6: "Rotate 90 CW"}
    return K.enum_decode(table(spark, sf, "lineitem").select(*KEYS.split(", ")), "l_linenumber", labels, "label")


@query("SELECT upper(r_name) grp, count(*) n, string_agg(n_name, ', ' ORDER BY n_name) members FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def group_catalog(spark, sf):
    x = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return x.groupBy(F.upper("r_name").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("members"))


# Expected values of the built samples, as text: field, kind, JSON of the value.
MOMENT = """captured_at timestamp "2024-04-16T12:34:56"
created_at timestamp "2024-04-16T12:34:56"
modified_at timestamp "2024-04-16T12:34:56"
"""
PHOTO = MOMENT + """device.make string "SampleCam"
device.model string "One"
software string "SampleGen"
orientation integer 1
dimensions.width integer 800
dimensions.height integer 600
exposure.iso integer 200
exposure.aperture rational {"numerator":56,"denominator":10}
exposure.shutter_speed rational {"numerator":1,"denominator":250}
exposure.focal_length_mm float 50.0
lens.model string "Sample 50mm F2"
"""
CREATOR = """author string "K & Co"
"""
PROFILE = """color.profile.name string "Sample RGB"
color.profile.class string "display"
color.space string "RGB"
"""
CLIP = MOMENT + """dimensions.width integer 1920
dimensions.height integer 1080
duration float 12.0
video.framerate float 23.976023976023978
video.bitrate integer 24000000
codec.video string "avc1"
codec.audio string "mp4a"
audio.channels integer 2
audio.sample_rate integer 48000
"""
SOUND = """duration float 1.0
audio.channels integer 2
audio.sample_rate integer 44100
"""
DEPTH = """audio.bit_depth integer 16
"""
EXPECTED = {
    "plain.jpg": PHOTO,
    "gps.jpg": PHOTO + 'location coordinates {"latitude":40.4462,"longitude":-79.9821}',
    "rich.jpg": PHOTO + CREATOR + PROFILE + 'headline string "Head"\nkeywords string "sea, sky, a, b"',
    "big.tif": PHOTO,
    "raw.dng": 'device.make string "RawCam"\ndimensions.width integer 800\ndimensions.height integer 600\nexposure.iso integer 400',
    "mixed.png": PHOTO + CREATOR + PROFILE,
    "both.webp": PHOTO + CREATOR,
    "still.heic": PHOTO,
    "clip.mp4": CLIP + 'device.model string "FC3682"\ndrone.flight.yaw_deg float 175.5\nlocation coordinates {"latitude":40.7922,"longitude":-73.9584}',
    "clip.mov": CLIP,
    "song.m4a": CLIP + 'author string "Kai"',
    "song.flac": SOUND + DEPTH,
    "song.aiff": SOUND + DEPTH,
    "song.ogg": SOUND + DEPTH + 'codec.audio string "vorbis"',
    "song.opus": SOUND.replace("44100", "48000") + 'codec.audio string "opus"',
}
# Expected formats, statuses, issue codes and fields in conflict of the samples.
OUTCOMES = """plain.jpg jpeg ok - -
gps.jpg jpeg ok - -
rich.jpg jpeg ok - captured_at,device.model,author,dimensions.width
broken.jpg jpeg ok jpeg_segment_length_invalid,no_metadata_entries -
badtiff.jpg jpeg parse_error - -
big.tif tiff ok - -
raw.dng dng ok - -
mixed.png png ok - captured_at,device.model
noend.png png ok png_missing_iend,no_metadata_entries -
both.webp webp ok - captured_at,device.model
still.heic heif ok - dimensions.width,dimensions.height
clip.mp4 mp4 ok - -
clip.mov mov ok - -
song.m4a m4a ok - -
song.flac flac ok - -
song.aiff aiff ok - -
song.ogg ogg ok - -
song.opus ogg ok - -
none.bin - unsupported_format - -"""


def _values(rows, columns: str) -> str:
    cell = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


def _expected():
    for path, lines_ in EXPECTED.items():
        for line in lines_.strip().split("\n"):
            field, kind, said = line.split(" ", 2)
            yield path, field, kind, f'{{"kind":"{kind}","value":{said}}}'


def _analysed(spark):
    from .sources import assets, samples

    df = spark.createDataFrame([(k, bytearray(v)) for k, v in samples.all_samples().items()], "path string, content binary")
    return V.analysis(assets.decode_assets(assets.memory_assets(df)), "normalized")


@query(_values(_expected(), "path, field, kind, value"))
def media_decode_synth(spark, sf):
    """The whole binary pipeline on built samples of every container: normalised fields by file."""
    fields = _analysed(spark).select("path", F.explode("normalized.fields").alias("f"))
    return fields.select("path", "f.field", F.col("f.value.kind").alias("kind"), V.tagged(F.col("f.value")).alias("value"))


@query(_values(([None if x == "-" else x for x in line.split()] for line in OUTCOMES.split("\n")), "path, format, status, issues, conflicts"))
def media_report_synth(spark, sf):
    """Formats, statuses, issues and conflicts of the same samples."""
    names = lambda a, k: F.nullif(F.array_join(F.transform(a, lambda x: x[k]), ","), F.lit(""))
    return _analysed(spark).select("path", F.col("detected_format").alias("format"), "status", names("report.issues", "code").alias("issues"), names("report.conflicts", "field").alias("conflicts"))


# Expected titles, labels and texts of a photo's and a clip's fields, tab-separated.
DISPLAY = {
    "gps.jpg": """General	Captured At	Apr 16, 2024 · 12:34:56
General	Created At	Apr 16, 2024 · 12:34:56
General	Modified At	Apr 16, 2024 · 12:34:56
General	Software	SampleGen
General	Orientation	1
Device	Device · Make	SampleCam
Device	Device · Model	One
Dimensions	Dimensions · Width	800
Dimensions	Dimensions · Height	600
Exposure	Exposure · Iso	200
Exposure	Exposure · Aperture	f/5.6
Exposure	Exposure · Shutter Speed	1/250s
Exposure	Exposure · Focal Length Mm	50 mm
Lens	Lens · Model	Sample 50mm F2
Location	Location	40.4462° N, 79.9821° W""",
    "song.opus": """General	Duration	1
Media	Codec · Audio	opus
Media	Audio · Channels	2
Media	Audio · Sample Rate	48000""",
}


@query(_values(((path, *line.split("\t")) for path, said in DISPLAY.items() for line in said.split("\n")), "path, title, label, value"))
def display_synth(spark, sf):
    """Fields of two samples as text to read."""
    return D.pretty(_analysed(spark)).where(F.col("path").isin(*DISPLAY)).select("path", "title", "label", "value")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%b ') || day(o_orderdate) || strftime(o_orderdate, ', %Y · %H:%M:%S') || CASE WHEN o_orderkey % 2 = 0 THEN ' Z' ELSE '' END AS moment, format('{:,}', o_orderkey) || ' bps' AS bitrate,
 'f/' || format('{:.1f}', o_custkey / 10.0) AS aperture, regexp_replace(format('{:.3f}', o_custkey / 8.0), '\\.?0+$', '') AS ratio,
 o_custkey % 90 || '° N, ' || regexp_replace(format('{:.6f}', (o_orderkey % 180 + 0.25)), '\\.?0+$', '') || '° W' AS place FROM orders WHERE o_custkey > 0""")
def display_text(spark, sf):
    """Times, numbers with units, rationals and coordinates as text."""
    o = table(spark, sf, "orders").where("o_custkey > 0")
    ratio = lambda d: value(F.lit("rational")).withField("r", F.struct(F.col("o_custkey").cast("bigint").alias("numerator"), F.lit(d).cast("bigint").alias("denominator")))
    time = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(""))
    at = F.struct((F.col("o_custkey") % 90).cast("double").alias("latitude"), (-(F.col("o_orderkey") % 180 + 0.25)).cast("double").alias("longitude"))
    parts = {"moment": ("captured_at", value(F.lit("timestamp"), time)), "bitrate": ("video.bitrate", value(F.lit("integer"), i=F.col("o_orderkey"))), "aperture": ("exposure.aperture", ratio(10)), "ratio": ("other", ratio(8)), "place": ("location", value(F.lit("coordinates")).withField("c", at))}
    return o.select("o_orderkey", *(D.shown(F.lit(name), v).alias(c) for c, (name, v) in parts.items()))


@query(_values(((p, f, s) for p, f, s, _, _ in ([None if x == "-" else x for x in line.split()] for line in OUTCOMES.split("\n"))), "path, format, status"))
def decode_media_sql(spark, sf):
    """The table function in SQL, over the samples."""
    from .sources import facade, samples

    facade.register(spark)
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in samples.all_samples().items()], "path string, content binary")
    return spark.sql("SELECT a.path, m.detected_format AS format, m.status FROM {assets} a, LATERAL decode_media(a.content) m", assets=df)


# Expected raw entries of the samples, as text: namespace, tag, kind, JSON of the value. Offsets follow from the directories' sizes.
CAMERA = """exif ImageWidth integer 800
exif ImageHeight integer 600
exif Make string "SampleCam"
exif Model string "One"
exif Orientation integer 1
exif Software string "SampleGen"
exif ModifyDate timestamp "2024:04:16 12:34:56"
exif ExposureTime rational {"numerator":1,"denominator":250}
exif FNumber rational {"numerator":56,"denominator":10}
exif ISO integer 200
exif DateTimeOriginal timestamp "2024:04:16 12:34:56"
exif CreateDate timestamp "2024:04:16 12:34:56"
exif FocalLength rational {"numerator":50,"denominator":1}
exif LensModel string "Sample 50mm F2"
"""
PLAIN = CAMERA + """exif ExifOffset integer 110
"""
GPS = """exif ExifOffset integer 122
exif GPSInfo integer 212
exif GPSLatitudeRef string "N"
exif GPSLatitude rational_list [{"numerator":40,"denominator":1},{"numerator":26,"denominator":1},{"numerator":4632,"denominator":100}]
exif GPSLongitudeRef string "W"
exif GPSLongitude rational_list [{"numerator":79,"denominator":1},{"numerator":58,"denominator":1},{"numerator":5556,"denominator":100}]"""
ICC = """icc ProfileClass string "display"
icc ColorSpace string "RGB"
icc ConnectionSpace string "XYZ"
icc DeviceManufacturer string "SMPL"
icc DeviceModel string "TEST"
icc ProfileDescription string "Sample RGB"
"""
XMP = """xmp CreateDate string "2024-04-16T12:34:56"
xmp Model string "Two"
xmp Author string "K & Co"
"""
TRACKS = """quicktime ImageWidth integer 1920
quicktime ImageHeight integer 1080
quicktime DurationSeconds float 12.0
quicktime VideoCodec string "avc1"
quicktime AudioCodec string "mp4a"
quicktime VideoFrameRate float 23.976023976023978
quicktime VideoBitrate integer 24000000
quicktime AudioChannels integer 2
quicktime AudioSampleRate integer 48000
quicktime CreateDate timestamp "2024-04-16T12:34:56"
quicktime ModifyDate timestamp "2024-04-16T12:34:56"
"""
VENDOR = """vorbis_comment Vendor string "sample"
"""
ENTRIES = {
    "plain.jpg": PLAIN,
    "gps.jpg": CAMERA + GPS,
    "rich.jpg": PLAIN + ICC + XMP + """iptc Headline string "Head"
iptc Author string "Kai"
iptc Keywords string "sea"
iptc Keywords string "sky"
xmp ImageWidth integer 640
xmp Keywords string "a"
xmp Keywords string "b\"""",
    "big.tif": PLAIN,
    "raw.dng": """exif ImageWidth integer 800
exif ImageHeight integer 600
exif Make string "RawCam"
exif ExifOffset integer 74
exif UnknownTag bytes [1,4,0,0]
exif ISO integer 400""",
    "mixed.png": PLAIN + XMP + ICC,
    "both.webp": XMP + PLAIN,
    "still.heic": PLAIN + "heif ImageWidth integer 320\nheif ImageHeight integer 240",
    "clip.mp4": TRACKS + """quicktime GPSLatitude float 40.7922
quicktime GPSLongitude float -73.9584
dji FlightYawDegree float 175.5
dji Model string "FC3682\"""",
    "clip.mov": TRACKS,
    "song.m4a": TRACKS + """quicktime Title string "Song"
quicktime Author string "Kai"
itunes Title string "Song"
itunes Artist string "Kai"
itunes TrackNumber string "3/7"
itunes Compilation integer 1""",
    "song.flac": VENDOR + """flac AudioSampleRate integer 44100
flac AudioChannels integer 2
flac AudioBitDepth integer 16
flac DurationSeconds float 1.0
vorbis_comment Title string "Song"
vorbis_comment MOOD string "calm\"""",
    "song.aiff": """aiff AudioSampleRate integer 44100
aiff AudioChannels integer 2
aiff AudioBitDepth integer 16
aiff DurationSeconds float 1.0""",
    "song.ogg": VENDOR + """ogg AudioSampleRate integer 44100
ogg AudioChannels integer 2
ogg AudioBitDepth integer 16
ogg AudioCodec string "vorbis"
ogg DurationSeconds float 1.0
vorbis_comment Artist string "Me"
vorbis_comment X string "LONG\"""".replace("LONG", "y" * 600),
    "song.opus": VENDOR + """ogg AudioSampleRate integer 48000
ogg AudioChannels integer 2
ogg AudioCodec string "opus"
ogg OpusInputSampleRate integer 44100
ogg DurationSeconds float 1.0
vorbis_comment Title string "Opus\"""",
}


def _entries():
    for path, said in ENTRIES.items():
        for line in said.strip().split("\n"):
            namespace, tag, kind, v = line.split(" ", 3)
            yield path, namespace, tag, f'{{"kind":"{kind}","value":{v}}}'


@query(_values(_entries(), "path, namespace, tag_name, value"))
def entry_decode_synth(spark, sf):
    """Raw entries of the samples; interpreted metadata is the same."""
    from .sources import assets, samples

    df = spark.createDataFrame([(k, bytearray(v)) for k, v in samples.all_samples().items()], "path string, content binary")
    full = V.analysis(assets.decode_assets(assets.memory_assets(df)), "interpreted")
    e = full.select("path", F.explode("interpreted.metadata").alias("e"))
    return e.select("path", "e.namespace", "e.tag_name", V.tagged(F.col("e.value")).alias("value"))
