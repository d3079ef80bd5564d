"""Document fingerprints: threshold-scaled sketches of word shingles.

Every distinct shingle hash below a fixed fraction of the hash space is kept, so a sketch grows with its document, two
sketches can be merged by union, and the containment of a short text in a far longer one can be estimated from them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import coded, col, digests, load, settle, slices, texts, tune, word_lists

#: Words of a shingle; one shingle in SCALE is kept.
WORDS, SCALE = 5, 16
P1, P2, B1, B2 = 2147483647, 2147483629, 1000003, 998244353


def shingle_hashes(codes: np.ndarray, off: np.ndarray, digest: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number and both 31-bit polynomial hashes of every shingle; a shorter text is one shingle."""
    wide = digest.astype(np.int64)
    head = (wide[:, 0] << 24) | (wide[:, 1] << 16) | (wide[:, 2] << 8) | wide[:, 3]
    tail = (wide[:, 4] << 24) | (wide[:, 5] << 16) | (wide[:, 6] << 8) | wide[:, 7]
    a, b = (head >> 4)[codes], (((wide[:, 3] & 15) << 24) | (tail >> 8))[codes]  # hex digits 1-7 and 8-14
    n = np.diff(off)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    at = np.arange(len(doc)) - np.repeat(first, count) + off[:-1][doc]
    end = off[1:][doc]
    x, y = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    short = bool((n[count > 0] < k).any()) if len(n) else False
    for t in range(k):
        i = at + t
        if short:
            ok = i < end
            i = np.where(ok, i, at)
            x, y = np.where(ok, (x * B1 + a[i]) % P1, x), np.where(ok, (y * B2 + b[i]) % P2, y)
        else:
            x, y = (x * B1 + a[i]) % P1, (y * B2 + b[i]) % P2
    return doc, x, y


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, scale: int = SCALE) -> DataFrame:
    """(id, n_shingles, sketch) for every row: sketch is the sorted distinct kept hashes.

    Words are lower-cased runs of letters and digits. A text of 1 to k-1 words is one shingle; a text without words has
    n_shingles 0 and an empty sketch; a null text has both null. Repeated rows and null ids give rows of their own, other
    columns are ignored, an empty table gives none. Ids are whole numbers or texts of such; any other is an error.
    """
    tune(docs.sparkSession)
    below = P1 // scale
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    out = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        for b in slices(batches, "text", 8_000_000):
            t = texts(b, "text")
            flat, off = word_lists(t)
            codes, names = coded(flat)
            null = np.asarray(t.is_null())
            doc, x, y = shingle_hashes(codes, off, digests(names, cache), k)
            n = np.bincount(doc, minlength=b.num_rows)
            kept = x < below
            doc, full = doc[kept], (x[kept] << 31) | y[kept]
            order = np.lexsort((full, doc))
            doc, full = doc[order], full[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (full[1:] != full[:-1])
            doc, full = doc[new], full[new]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(full, pa.int64()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64(), mask=null), lists], schema=out)

    return slim.mapInArrow(run, "id long, n_shingles long, sketch array<long>").withColumnRenamed("id", id_col)


def merge(sketched: DataFrame, by: list[str], sketch_col: str = "sketch") -> DataFrame:
    """(by..., sketch_col): one sketch for each group, the same as that of all its texts taken together as a set of shingles.

    Null keys are a group like any other. Null sketches add nothing; a group of only null or empty sketches gets an empty
    one; repeated rows change nothing; an empty table gives none.
    """
    h = "__h"
    while h in by:
        h += "_"
    one = sketched.select(*[col(c) for c in by], F.explode_outer(col(sketch_col)).alias(h)).distinct()
    return one.groupBy(*[col(c) for c in by]).agg(F.sort_array(F.collect_list(col(h))).alias(sketch_col))


def containment(left: DataFrame, right: DataFrame, left_id: str, right_id: str, at_least: float = 0.5, sketch_col: str = "sketch") -> DataFrame:
    """(left_id, right_id, shared, containment): the share of the left sketch's hashes that the right one has too.

    Every row of both sides takes part. Rows that share an id are one document, with all their hashes; null ids are one
    too. Empty and null sketches have no containment and no rows. If both ids have one name, the right one's gets `_right`.

    A pair that shares enough must share one of the left's rarest hashes: of n, all but the commonest that it could do
    without. Only those are joined, and what they bring together is counted in full, so that a shingle that thousands of
    documents hold pairs none of them by itself.
    """
    a = left.select(col(left_id).alias("__a"), F.explode(col(sketch_col)).alias("__h")).distinct()
    b = right.select(col(right_id).alias("__b"), F.explode(col(sketch_col)).alias("__g")).distinct()
    held = b.groupBy("__g").agg(F.count(F.lit(1)).alias("__k"))
    known = a.join(held, F.col("__h") == F.col("__g"), "left").select("__a", "__h", F.coalesce("__k", F.lit(0)).alias("__k"))
    listed = known.groupBy("__a").agg(F.array_sort(F.collect_list(F.struct("__k", "__h"))).alias("__l")).withColumn("__n", F.size("__l"))
    need = F.greatest(F.ceil(F.col("__n") * at_least - 1e-9), F.lit(1))
    rare = listed.select("__a", F.explode(F.slice("__l", F.lit(1), (F.col("__n") - need + 1).cast("int"))).alias("__x")).where("__x.__k > 0").select("__a", F.col("__x.__h").alias("__h"))
    pairs = rare.join(b, F.col("__h") == F.col("__g")).select("__a", "__b").distinct()
    whole = b.groupBy(F.col("__b").alias("__c")).agg(F.collect_list("__g").alias("__r"))
    mine = listed.select(F.col("__a").alias("__d"), "__n", F.transform("__l", lambda x: x["__h"]).alias("__m"))
    met = pairs.join(mine, F.col("__a").eqNullSafe(F.col("__d"))).join(whole, F.col("__b").eqNullSafe(F.col("__c")))
    both = met.select("__a", "__b", F.size(F.array_intersect("__m", "__r")).cast("long").alias("shared"), "__n")
    named = right_id if right_id != left_id else f"{right_id}_right"
    return both.select(col("__a").alias(left_id), col("__b").alias(named), "shared", (F.col("shared") / F.col("__n")).alias("containment")).where(F.col("containment") >= at_least)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch of every document, its hashes joined by commas."""
    s = sketches(load(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_shingles", F.size("sketch").cast("long").alias("n_kept"), F.array_join("sketch", ",").alias("sketch"))


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items of which half or more stands in a document, by their sketches, with the document."""
    items, docs = sketches(load(spark, sf_dir, "benchmark"), "item_id"), sketches(load(spark, sf_dir, "documents"))
    found = containment(settle(items), settle(docs), "item_id", "doc_id")
    return found.select("item_id", "doc_id", "shared", F.round("containment", 6).alias("containment"))


def _horner(h: str, base: int, p: int) -> str:
    s = "0"
    for t in range(WORDS):
        v = h if t == 0 else f"{h}{t}"
        s = f"(CASE WHEN {v} IS NULL THEN {s} ELSE ({s} * {base} + {v}) % {p} END)" if t else f"{v}"
    return s


def _kept(table: str, key: str, x: str) -> str:
    """Tables whose names end in x: the last, g, has n_shingles and the kept hashes k of each text that has any."""
    return rf"""
w{x} AS (
  SELECT {key}, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), ' ') AS words
  FROM {table} WHERE text IS NOT NULL),
t{x} AS (SELECT {key}, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w{x} WHERE words[1] <> ''),
h{x} AS (SELECT {key}, pos, CAST(('0x' || md5(word)[1:7]) AS BIGINT) AS a, CAST(('0x' || md5(word)[8:14]) AS BIGINT) AS b FROM t{x}),
l{x} AS (SELECT {key}, pos, a, b, {", ".join(f"lead(a, {t}) OVER d AS a{t}, lead(b, {t}) OVER d AS b{t}" for t in range(1, WORDS))}
  FROM h{x} WINDOW d AS (PARTITION BY {key} ORDER BY pos)),
s{x} AS (SELECT {key}, {_horner("a", B1, P1)} AS x, {_horner("b", B2, P2)} AS y FROM l{x} WHERE a{WORDS - 1} IS NOT NULL OR pos = 0),
g{x} AS (SELECT {key}, count(*) AS n_shingles, list_sort(list(DISTINCT x * 2147483648 + y) FILTER (WHERE x < {P1 // SCALE})) AS k FROM s{x} GROUP BY {key})"""


SQL = f"""
WITH {_kept("documents", "doc_id", "")}
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(g.n_shingles, 0) END AS n_shingles,
  CASE WHEN d.text IS NOT NULL THEN coalesce(len(g.k), 0) END AS n_kept,
  CASE WHEN d.text IS NOT NULL THEN coalesce(array_to_string(g.k, ','), '') END AS sketch
FROM documents d LEFT JOIN g USING (doc_id)
"""
CONTAINED = f"""
WITH {_kept("benchmark", "item_id", "_i")}, {_kept("documents", "doc_id", "_d")},
i AS (SELECT item_id, len(k) AS n, unnest(k) AS v FROM g_i), d AS (SELECT doc_id, unnest(k) AS v FROM g_d)
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / n, 6) AS containment FROM i JOIN d USING (v) GROUP BY item_id, doc_id, n HAVING count(*) / n >= 0.5
"""
