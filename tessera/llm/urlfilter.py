"""URL filters: host and path rules, and a blocked Bloom filter of listed canonical URLs before an exact join.

The Bloom filter has blocks of four 64-bit words; a URL sets one bit in each word of its block. It is a table
(block, four words) made by a grouped bitwise or. Pages look their block up, and only possible hits meet the list in an
exact hash join, which removes false positives. Filter and list are broadcast only if they were counted and are small;
otherwise both joins are shuffled: pages that cannot be hits get a key of their own instead of meeting in one task, and the
pages of a hot block or URL are salted by their count.
DataFrame functions only.

Edge cases: a null URL, or one without `://`, has an empty host, path and canonical form, fits no rule and is allowed;
repeated rows and null ids are judged like any others; repeated list entries count once, null ones not at all; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MAX_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """pages (any columns, with url) plus _host and _path."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END")
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", group), F.lit(""))
    return pages.withColumns({"_host": F.translate(part(1), UPPER, LOWER), "_path": part(2)})


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. and path without trailing slashes; scheme, query and fragment do not matter."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null without one."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules for one expression; list exact URLs instead")
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _bits(url: str) -> list[Column]:
    h = F.xxhash64(url, F.lit(7))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]


def bloom_table(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w3) of a one-column DataFrame `url`."""
    block = F.pmod(F.xxhash64("url"), F.lit(blocks)).alias("block")
    return listed.groupBy(block).agg(*(F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits("url"))))


def url_filter(pages: DataFrame, listed: DataFrame, rules=RULES, bits_per_url: int = 16) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (is the canonical URL in the list?) of each page.

    listed: a DataFrame with a column url of canonical URLs. Without a rule, a listed page is blocked, others allowed.
    """
    urls = written(listed.select(F.col("url").cast("string").alias("url")).where("url is not null and url <> ''").distinct(), "listed")
    n = urls.count()
    blocks = max(1, -(-n * bits_per_url // 256))
    bloom = written(bloom_table(urls, blocks).withColumnRenamed("block", "probe"), "bloom")
    rows = split_url(pages.select("page_id", "url")).withColumn("canonical", canonical(F.col("_host"), F.col("_path")))
    rows = rows.withColumn("probe", F.pmod(F.xxhash64("canonical"), F.lit(blocks)))
    rows = spread_join(rows, bloom, ["probe"], ["page_id", "canonical"], "left")
    maybe = F.lit(True)
    for i, b in enumerate(_bits("canonical")):
        maybe = maybe & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(b) != 0)
    key = F.when(maybe, F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "canonical").cast("string")))
    rows = spread_join(rows.withColumn("key", key), urls.select(F.col("url").alias("key"), F.col("url").alias("hit")), ["key"], ["page_id"], "left")
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    is_listed = F.col("hit").isNotNull()
    return rows.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"))


def recrawled(pages: DataFrame) -> DataFrame:
    """A list to filter by: canonical URLs that more than one page carries."""
    return split_url(pages.select("url")).select(canonical(F.col("_host"), F.col("_path")).alias("url")).where("url <> ''").groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url")


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END rest FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
             coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') path FROM p),
c AS (SELECT *, concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '/+$', '')) canonical FROM q),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END rule FROM c),
l AS (SELECT canonical FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END verdict,
       l.canonical IS NOT NULL listed
FROM r LEFT JOIN l ON r.canonical = l.canonical
"""
