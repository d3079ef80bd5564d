"""WARC revisits: a not-modified capture is resolved by an as-of join to the latest earlier full response of its URL.

Validators must agree, and only permitted headers of the 304 reply update the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, load, settle

#: Headers that a 304 reply may update; everything that describes the stored body itself stays as it was.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=.*)?$"


def canonical(url: Column) -> Column:
    """A URL without scheme, www. or m., default port, fragment, tracking parameters and last slash; the rest of the query sorted.

    The host is in lower case; null stays null, and what has no host is only trimmed.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    pairs = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_join(F.array_sort(F.filter(pairs, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def header(lines: Column, name: str) -> Column:
    """The value of the first header of that name in a block of lines, null without one."""
    v = F.regexp_extract(lines, rf"(?im)^{name}[ \t]*:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.nullif(v, F.lit(""))


def merged(stored: Column, fresh: Column) -> Column:
    """Stored header lines updated by the permitted ones of a 304 reply: sorted by name, one line each, names in lower case."""

    def as_lines(block: Column) -> Column:
        lines = F.transform(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"[ \t]+$", ""))
        named = F.filter(lines, lambda x: x.rlike(r"^[^:\s]+[ \t]*:"))
        return F.transform(named, lambda x: F.concat(F.lower(F.regexp_extract(x, r"^([^:\s]+)", 1)), F.lit(": "), F.regexp_extract(x, r"^[^:]+:[ \t]*(.*)$", 1)))

    def name(x: Column) -> Column:
        return F.substring_index(x, ":", 1)

    new = F.filter(as_lines(fresh), lambda x: name(x).isin(*PERMITTED))
    names = F.transform(new, name)
    return F.array_join(F.array_sort(F.concat(F.filter(as_lines(stored), lambda x: ~F.array_contains(names, name(x))), new)), "\n")


#: Types of captured_at that are numbers; others are times.
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: Captures of one URL beyond which its time is cut into stretches of about so many.
RUN = 100_000


def resolve(records: DataFrame, run: int = RUN) -> DataFrame:
    """(record_id, canonical_url, captured_at, source_id, status, headers) for every revisit.

    records has record_id, url, captured_at, kind (response or revisit) and headers (lines of name: value). source_id is
    the latest response of the same canonical URL captured strictly earlier, of equal times the largest id. status is
    resolved if the validators agree (ETags compared weakly where both have one, else equal Last-Modified), mismatch if
    they differ, unverified if they can't be compared, missing without an earlier response. headers are merged if
    resolved, else the revisit's own. A revisit with a null URL or time is missing, such responses resolve nothing;
    repeated rows give rows of their own, other kinds and columns are ignored, and so are responses without a record_id.
    captured_at is a number, a date or a time, ids are whole numbers. An empty table gives none. A URL of more than `run` captures is worked on
    in stretches of its time, each a task of its own.
    """
    r = records.select(
        col("record_id").cast("long").alias("record_id"), canonical(col("url")).alias("canonical_url"), col("captured_at").alias("captured_at"),
        col("kind").alias("kind"), col("headers").cast("string").alias("headers"),
    ).where(F.col("kind").isin("response", "revisit"))
    usable = (F.col("kind") == "response") & F.col("canonical_url").isNotNull() & F.col("captured_at").isNotNull() & F.col("record_id").isNotNull()
    # A URL of many captures is several stretches of time; what comes before a stretch is the last response of earlier ones.
    at = F.col("captured_at").cast("double") if dict(r.dtypes)["captured_at"] in NUMBERS or dict(r.dtypes)["captured_at"].startswith("decimal") else F.col("captured_at").cast("timestamp").cast("double")
    r = r.withColumn("__t", at)
    ranges = r.where(F.col("canonical_url").isNotNull()).groupBy(F.col("canonical_url").alias("__u")).agg(F.count(F.lit(1)).alias("__n"), F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    hot = settle(ranges.where((F.col("__n") > run) & (F.col("__hi") > F.col("__lo"))))
    split = hot.limit(1).count() > 0
    if split:
        place = F.floor((F.col("__t") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.ceil(F.col("__n") / run)).cast("long")
        r = r.join(hot, F.col("canonical_url") == F.col("__u"), "left").withColumn("__b", F.coalesce(place, F.lit(0).cast("long"))).drop("__u", "__n", "__lo", "__hi")
    else:
        r = r.withColumn("__b", F.lit(0).cast("long"))
    # At one time revisits come first, so that they only see what is strictly earlier.
    asof = Window.partitionBy("canonical_url", "__b").orderBy("captured_at", F.col("kind") == "response", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A null URL is no URL: its rows get a key of their own, so that they don't gather in one task.
    none = r.where(F.col("canonical_url").isNull() & (F.col("kind") == "revisit")).withColumn("__s", F.lit(None).cast("struct<id:bigint,headers:string>"))
    some = r.where(F.col("canonical_url").isNotNull())
    some = some.withColumn("__s", F.last(F.when(usable, F.struct(F.col("record_id").alias("id"), "headers")), ignorenulls=True).over(asof)).where(F.col("kind") == "revisit")
    if split:
        last = F.max(F.when(usable, F.struct("captured_at", F.col("record_id").alias("id"), "headers")))
        # only URLs of several stretches have any to carry over; each stretch is one row here
        cut = r.join(hot.select("__u"), F.col("canonical_url") == F.col("__u"), "left_semi")
        ends = cut.groupBy("canonical_url", "__b").agg(last.alias("__e"))
        earlier = Window.partitionBy("canonical_url").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("canonical_url").alias("__u"), F.col("__b").alias("__v"), F.last("__e", ignorenulls=True).over(earlier).alias("__w")).where(F.col("__w").isNotNull())
        some = some.join(carried, (F.col("canonical_url") == F.col("__u")) & (F.col("__b") == F.col("__v")), "left")
        some = some.withColumn("__s", F.coalesce("__s", F.when(F.col("__w").isNotNull(), F.struct(F.col("__w.id").alias("id"), F.col("__w.headers").alias("headers"))))).drop("__u", "__v", "__w")
    both = some.unionByName(none).withColumn("__s", F.when(F.col("captured_at").isNotNull(), F.col("__s")))
    weak = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    s, h = F.col("__s.headers"), F.col("headers")
    agree = F.coalesce(weak(s) == weak(h), header(s, "last-modified") == header(h, "last-modified"))
    status = F.when(F.col("__s").isNull(), "missing").when(agree.isNull(), "unverified").when(agree, "resolved").otherwise("mismatch")
    both = both.withColumn("status", status)
    return both.select("record_id", "canonical_url", "captured_at", F.col("__s.id").alias("source_id"), "status", F.when(F.col("status") == "resolved", merged(s, h)).otherwise(merged(h, h)).alias("headers"))


def with_payload(resolved: DataFrame, payloads: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """The resolved revisits with the payload of their source; the others have null.

    Of payloads that share an id the smallest counts, null ids are nobody's; an empty table of payloads gives null to all.
    """
    p = payloads.select(col(id_col).cast("long").alias("__id"), col(payload_col).alias("__p")).where(F.col("__id").isNotNull())
    p = p.groupBy("__id").agg(F.min("__p").alias("payload"))
    use = F.when(F.col("status") == "resolved", F.col("source_id"))
    return resolved.join(p, use == F.col("__id"), "left").drop("__id")


def captures(pages: DataFrame) -> DataFrame:
    """WARC-like records of a crawl of pages: each page's full response, and a conditional request for it 40 days later.

    Page n is captured n minutes after the start of 2024 and has record id 2n; its revisit has 2n+1. Validators follow from
    the body: an ETag is its digest, weak for some; some only have Last-Modified, and a few servers send neither with the
    304. Pages whose canonical URL was captured again in between get a mismatch, as in a real crawl.
    """
    tag = F.md5(F.coalesce("html", F.lit("")))
    kind = F.conv(F.substring(tag, 1, 2), 16, 10).cast("int") % 8
    at = F.lit(1704067200).cast("long") + F.col("page_id") * 60
    quoted = F.concat(F.when(kind == 1, "W/").otherwise(""), F.lit('"'), tag, F.lit('"'))
    modified = F.concat(F.lit("day "), F.col("page_id"))
    lines = lambda *x: F.concat_ws("\r\n", *x)
    full = lines(
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.length("html")), F.concat(F.lit("Date: "), at),
        F.when(kind != 2, F.concat(F.lit("ETag: "), quoted)), F.concat(F.lit("Last-Modified: "), modified), F.lit("Cache-Control: max-age=60"),
    )
    late = lines(
        F.concat(F.lit("Date: "), at + 3456000), F.when(~kind.isin(2, 3, 4), F.concat(F.lit("etag: "), F.lit('"'), tag, F.lit('"'))),
        F.when(kind.isin(2, 4), F.concat(F.lit("Last-Modified: "), modified)), F.lit("Cache-Control: max-age=3600"), F.lit("Content-Length: 0"), F.lit("Server: edge"),
    )
    both = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), at.alias("captured_at"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), (at + 3456000).alias("captured_at"), F.lit("revisit").alias("kind"), late.alias("headers")),
    )
    return pages.select("url", F.explode(both).alias("r")).select("r.record_id", "url", "r.captured_at", "r.kind", "r.headers")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of every page, with the payload that it stands for."""
    pages = load(spark, sf_dir, "pages")
    payloads = pages.select((F.col("page_id") * 2).alias("record_id"), "html")
    return with_payload(resolve(captures(pages)), payloads, "record_id", "html")


_NAMES = ", ".join(f"'{n}'" for n in PERMITTED)
SQL = rf"""
WITH p AS (SELECT page_id, url, html, md5(coalesce(html, '')) AS tag, CAST('0x' || md5(coalesce(html, ''))[1:2] AS INT) % 8 AS kind, 1704067200 + page_id * 60 AS seen,
  regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)\.', '')
  || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&') AS params FROM p),
u AS (SELECT *, place || CASE WHEN params <> '' THEN '?' || params ELSE '' END AS canonical_url FROM c),
r AS (SELECT *, seen + 3456000 AS captured_at FROM u),
j AS (SELECT r.*, s.page_id AS sid, s.tag AS stag, s.kind AS skind, s.html AS shtml,
  row_number() OVER (PARTITION BY r.page_id ORDER BY s.seen DESC, s.page_id DESC) AS k
  FROM r LEFT JOIN u s ON r.canonical_url = s.canonical_url AND s.seen < r.captured_at),
b AS (SELECT *, CASE WHEN kind NOT IN (2, 3, 4) AND skind <> 2 THEN tag = stag WHEN kind IN (2, 4) THEN page_id = sid END AS agree FROM j WHERE k = 1),
z AS (SELECT *, CASE WHEN sid IS NULL THEN 'missing' WHEN agree IS NULL THEN 'unverified' WHEN agree THEN 'resolved' ELSE 'mismatch' END AS status FROM b)
SELECT page_id * 2 + 1 AS record_id, canonical_url, captured_at, sid * 2 AS source_id, status,
  CASE WHEN status = 'resolved' THEN
    'cache-control: max-age=3600' || chr(10) || 'content-length: ' || length(shtml) || chr(10) || 'content-type: text/html; charset=utf-8' || chr(10) || 'date: ' || captured_at
    || CASE WHEN kind NOT IN (2, 3, 4) THEN chr(10) || 'etag: "' || tag || '"' WHEN skind <> 2 THEN chr(10) || 'etag: ' || CASE WHEN skind = 1 THEN 'W/' ELSE '' END || '"' || stag || '"' ELSE '' END
    || chr(10) || 'last-modified: day ' || CASE WHEN kind IN (2, 4) THEN page_id ELSE sid END
  ELSE 'cache-control: max-age=3600' || chr(10) || 'content-length: 0' || chr(10) || 'date: ' || captured_at
    || CASE WHEN kind NOT IN (2, 3, 4) THEN chr(10) || 'etag: "' || tag || '"' ELSE '' END
    || CASE WHEN kind IN (2, 4) THEN chr(10) || 'last-modified: day ' || page_id ELSE '' END || chr(10) || 'server: edge' END AS headers,
  CASE WHEN status = 'resolved' THEN shtml END AS payload
FROM z
"""
