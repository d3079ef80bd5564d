"""Mixing sources to target weights by systematic sampling.

Expected copies are prefix-summed within each source, one random offset is added, and a document is emitted once for
every integer boundary that its interval crosses. All arithmetic is in whole billionths, so runs agree to the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, every, load

#: A copy in billionths; rows of a source that one task sums; the exponent that flattens the sources' sizes.
UNIT, RUN, FLATTEN, SEED = 1_000_000_000, 4_000, 0.7, 42
#: Copies that one row can't reach.
MOST = 1_000_000_000


def bucket(key: Column, n: Column) -> Column:
    """A place for an id among n, by arithmetic that any SQL engine has; null goes to 0."""
    return F.coalesce(F.pmod(F.pmod(key, F.lit(1000003)) * 7919, n), F.lit(0).cast("long"))


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in billionths, from 0 to below one copy."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % UNIT


def expected(docs: DataFrame, source: Column, weights: dict[str, float] | None, total: float | None, flatten: float) -> DataFrame:
    """(__s, __e, __b): each source's expected copies of a document in billionths, and how many runs it is summed in.

    The shares are the given weights, or the sources' sizes to the power `flatten`. As many rows as there are sources.
    """
    sized = docs.groupBy(source.alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    if weights is None:
        share = F.pow(F.col("__n").cast("double"), F.lit(flatten))
    else:
        if any(not 0 <= float(v) < float("inf") for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        share = F.coalesce(*[F.when(F.col("__s") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sized = sized.withColumn("__share", share)
    sums = sized.agg(F.sum("__n").cast("double").alias("__rows"), F.sum("__share").alias("__shares"))
    want = F.lit(float(total)) if total is not None else F.col("__rows")
    part = F.when(F.col("__shares") > 0, F.col("__share") / F.col("__shares")).otherwise(0.0)
    return sized.crossJoin(F.broadcast(sums)).select(
        "__s", F.rint(part * want / F.col("__n") * UNIT).cast("long").alias("__e"), F.ceil(F.col("__n") / RUN).cast("long").alias("__b")
    )


def counted(docs: DataFrame, id_col: str, source_col: str, weights: dict[str, float] | None, total: float | None, flatten: float, seed: int, copies_col: str | None) -> DataFrame:
    """(__row, __n): every row packed, and how often it is to be emitted."""
    row = docs.select(F.struct(*every(docs)).alias("__row"), col(id_col).cast("long").alias("__id"), col(source_col).alias("__s"))
    plan = expected(docs, col(source_col), weights, total, flatten).withColumnRenamed("__s", "__t")
    if copies_col is not None:
        asked = F.nanvl(F.coalesce(F.col("__row").getField(copies_col).cast("double"), F.lit(0.0)), F.lit(0.0))
        own = F.when(asked >= MOST, F.raise_error(F.lit(f"no row can be emitted {MOST} times or more"))).otherwise(F.rint(F.greatest(asked, F.lit(0.0)) * UNIT))
        row, plan = row.withColumn("__e", own.cast("long")), plan.drop("__e")
    known = row.join(F.broadcast(plan) if few(docs, source_col) else plan, F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    # a null id comes first of all, but many of them are several runs, by what else the rows hold
    plain = [F.col("__row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    known = known.withColumn("__k", F.when(F.col("__id").isNull(), -1 - F.pmod(F.xxhash64(*plain), F.col("__b"))).otherwise(bucket(F.col("__id"), F.col("__b"))))
    # a source under a name that is never null, so that the sums are joined where the windows have put the rows
    known = known.withColumn("__g", F.concat(F.when(F.col("__s").isNull(), "0").otherwise("1"), F.coalesce(F.col("__s").cast("string"), F.lit(""))))
    # only the fraction of a copy matters of what comes before, so nothing overflows
    runs = known.groupBy("__g", "__k").agg((F.sum("__e") % UNIT).alias("__sum"))
    before = Window.partitionBy("__g").orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(F.col("__g").alias("__t"), F.col("__k").alias("__j"), ((F.sum("__sum").over(before) - F.col("__sum")) % UNIT).alias("__base"))
    within = Window.partitionBy("__g", "__k").orderBy("__id", "__e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = known.withColumn("__here", F.sum("__e").over(within))
    summed = summed.join(runs, (F.col("__g") == F.col("__t")) & (F.col("__k") == F.col("__j")))
    summed = summed.withColumn("__end", F.col("__base") + F.col("__here") + offset(F.col("__s"), seed))
    return summed.select("__row", F.expr(f"__end div {UNIT} - (__end - __e) div {UNIT}").cast("int").alias("__n"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
    total: float | None = None, flatten: float = FLATTEN, seed: int = SEED, copies_col: str | None = None,
) -> DataFrame:
    """The rows of docs, each as often as systematic sampling emits it, columns as they are.

    The target shares are `weights` (a source that it lacks gets 0), or without them the sources' sizes to the power
    `flatten`; `total` is the expected number of rows, by default as many as there are. `copies_col` gives expected
    copies for each row instead (null, NaN or negative: 0; a billion or more: an error). Negative weights are an error. A source is summed in the order of a bucket of the id, then the
    id, nulls first; rows that share an id follow each other. Null is a source like any other. An empty table gives none.
    Ids are whole numbers or texts of such; any other is an error.
    """
    got = counted(docs, id_col, source_col, weights, total, flatten, seed, copies_col)
    return got.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__n")))).select("__row.*")


def numbered(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """(id, source, copy_no) for every copy that mix() emits of a row, numbered from 1."""
    o = {"weights": None, "total": None, "flatten": FLATTEN, "seed": SEED, "copies_col": None} | options
    slim = docs.select(col(id_col), col(source_col), *([] if o["copies_col"] is None else [col(o["copies_col"])]))
    got = counted(slim, id_col, source_col, **o)
    one = got.select("__row", F.posexplode(F.array_repeat(F.lit(0), F.col("__n"))).alias("__p", "__x"))
    return one.select(F.col("__row").getField(id_col).alias(id_col), F.col("__row").getField(source_col).alias(source_col), (F.col("__p") + 1).cast("long").alias("copy_no"))


def few(docs: DataFrame, source_col: str, most: int = 100_000) -> bool:
    """Whether the sources are few enough to send to every executor; counted, not assumed."""
    return docs.select(col(source_col)).distinct().limit(most + 1).count() <= most


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every emitted copy of a document, numbered from 1, at the sources' flattened sizes."""
    return numbered(load(spark, sf_dir, "documents"))


SQL = f"""
WITH n AS (SELECT source, count(*) AS n, pow(count(*), {FLATTEN}) AS w FROM documents GROUP BY source),
e AS (SELECT source, CAST(round_even(w / (SELECT sum(w) FROM n) * (SELECT CAST(sum(n) AS DOUBLE) FROM n) / n * {UNIT}, 0) AS BIGINT) AS e,
  CAST(ceil(n / {RUN}) AS BIGINT) AS b,
  CAST(('0x' || md5('{SEED}:' || coalesce(source, chr(0)))[1:12]) AS BIGINT) % {UNIT} AS u FROM n),
d AS (SELECT doc_id, d.source, e, u, coalesce(((((doc_id % 1000003) + 1000003) % 1000003) * 7919) % b, 0) AS k FROM documents d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
s AS (SELECT *, CAST(sum(e) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, e ROWS UNBOUNDED PRECEDING) AS BIGINT) + u AS x FROM d),
c AS (SELECT doc_id, source, x // {UNIT} - (x - e) // {UNIT} AS copies FROM s)
SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy_no FROM c WHERE copies > 0
"""
