"""Quality classifier: hierarchical empirical Bayes over document evidence, hosts and paths.

Binned text features give each document a likelihood ratio (naive Bayes, counted over all labelled rows). Soft votes of
all documents are summed by host and by path; a path's rate is shrunk towards its host's and a host's towards the global
one, as strongly as the spread between groups says, and the document itself is left out of its own prior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, load, settle, slices, texts, tune

#: Sites that are sent to every executor at most; bins of the features below; additive smoothing; the posterior below which a document is rejected; a vote's fineness.
FEW = 200_000
BINS = {"symbols": 13, "capitals": 11, "repeats": 11, "pipes": 8, "stutter": 11}
SMOOTH, REJECT, VOTE = 1.0, 0.5, 1_000_000


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """For every code point: 1 a letter, 2 a capital, 4 neither letter, digit, white space nor common punctuation, 8 a bar."""
    out = np.zeros(0x110000, np.uint8)
    common = set(" \t\n\x0b\f\r.,;:?'\"()+@/_=-")
    for i in range(0x110000):
        c = category(chr(i))
        out[i] = (c[0] == "L") + 2 * (c == "Lu") + 4 * (c[0] not in "LN" and chr(i) not in common)
    out[ord("|")] |= 8
    return out


def features(text: pa.Array) -> dict[str, np.ndarray]:
    """Bins in whole numbers: shares of odd symbols, of capitals, of lines that repeat, of table bars, and of words that repeat the one before."""
    t = text.fill_null("")
    off = np.frombuffer(t.buffers()[1], np.int64, len(t) + 1, t.offset * 8)
    raw = (t.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[off[0] : off[-1]]
    kind = kinds()[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
    ends = np.r_[0, np.cumsum(np.asarray(pc.utf8_length(t)).astype(np.int64))]
    per = lambda bit: np.diff(np.r_[0, np.cumsum(kind & bit > 0)][ends])
    n = np.maximum(np.diff(ends), 1)

    def parts(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The text that each part belongs to, its code, and the parts."""
        at = np.asarray(lists.offsets).astype(np.int64)
        flat = lists.values.slice(at[0], at[-1] - at[0])
        return np.repeat(np.arange(len(t)), np.diff(at)), np.asarray(flat.dictionary_encode().indices).astype(np.int64), flat

    doc, code, flat = parts(pc.split_pattern(t, "\n"))
    some = np.asarray(pc.not_equal(flat, ""))
    doc, code = doc[some], code[some]
    lines = np.bincount(doc, minlength=len(t))
    both = np.sort(doc << 32 | code)
    different = np.bincount(both[np.r_[True, both[1:] != both[:-1]]] >> 32, minlength=len(t)) if len(both) else lines
    # runs of blanks and breaks part words; a text of nothing else parts into two empty ones
    byte, at = np.frombuffer(raw, np.uint8), off - off[0]
    gap, edge = (byte == 32) | (byte == 10), np.zeros(len(byte) + 1, bool)
    edge[at] = True
    own = lambda i: np.searchsorted(at, i, side="right") - 1
    turn = np.r_[True, gap[1:] != gap[:-1]][: len(byte)] | edge[:-1]  # where a run of either begins
    words = np.bincount(own(np.flatnonzero(gap & turn)), minlength=len(t)) + 1
    first, final = np.flatnonzero(~gap & turn), np.flatnonzero(~gap & np.r_[turn[1:], True][: len(byte)]) + 1
    doc = own(first)
    inner = np.r_[0, np.cumsum(final - first)].astype(np.int64)
    code = np.asarray(pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(inner), pa.py_buffer(byte[~gap])).dictionary_encode().indices)
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (code[1:] == code[:-1])], minlength=len(t))
    again += (np.diff(at) > 0) & (np.bincount(doc, minlength=len(t)) == 0)
    return {
        "symbols": np.minimum(12, per(4) * 50 // n),
        "capitals": np.minimum(10, per(2) * 10 // np.maximum(per(1), 1)),
        "repeats": np.minimum(10, (lines - different) * 10 // np.maximum(lines, 1)),
        "pipes": np.minimum(7, per(8) * 100 // n),
        "stutter": np.minimum(10, again * 10 // np.maximum(words, 1)),
    }


def binned(docs: DataFrame, text_col: str, keep: bool) -> DataFrame:
    """docs with the bins of their text, which itself stays only if keep. One pass in Arrow batches; nothing is shuffled.

    Names of columns must be plain, as they are handed to a worker.
    """
    tune(docs.sparkSession)
    names = [c for c in docs.columns if keep or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 4_000_000):
            bins = [pa.array(x.astype(np.int32)) for x in features(texts(b, text_col)).values()]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + bins, names=[*names, *(f"__{f}" for f in BINS)])

    schema = docs.select(*names).schema
    for f in BINS:
        schema = schema.add(f"__{f}", "integer")
    return docs.mapInArrow(run, schema)


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1.0 - p)


def train(bins: DataFrame, labels: DataFrame, id_col: str, label_id: str, label_col: str) -> tuple[dict[str, list[float]], float]:
    """Each bin's log-likelihood ratio and the global log-odds, from counts over every labelled row.

    What reaches the driver has as many rows as there are bins. Without labels every ratio is 0.
    """
    y = labels.select(col(label_id).cast("long").alias("__id"), col(label_col).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull())
    seen = bins.join(y, "__id")
    long = seen.select("__y", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"__{f}").alias("b")) for f in BINS])).alias("x"))
    counts = {(r.f, r.b, r.y): r.n for r in long.groupBy(F.col("x.f").alias("f"), F.col("x.b").alias("b"), F.col("__y").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {y: sum(n for (f, _, k), n in counts.items() if k == y and f == "symbols") for y in (0, 1)}
    ratio = {
        f: [math.log((counts.get((f, b, 1), 0) + SMOOTH) / (total[1] + SMOOTH * size)) - math.log((counts.get((f, b, 0), 0) + SMOOTH) / (total[0] + SMOOTH * size)) for b in range(size)]
        for f, size in BINS.items()
    }
    return ratio, math.log((total[1] + 1) / (total[0] + 1))


def evidence(ratio: dict[str, list[float]]) -> Column:
    """A document's summed log-likelihood ratio, from the bins in the row."""
    parts = [F.element_at(F.array(*[F.lit(float(x)) for x in ratio[f]]), F.col(f"__{f}") + 1) for f in BINS]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def vote(ratio: dict[str, list[float]], prior: float) -> Column:
    """What a document says of its site: its posterior under the global prior, in whole millionths."""
    return F.rint(VOTE / (1.0 + F.exp(-(evidence(ratio) + prior)))).cast("long")


def strength(groups: DataFrame, n: str, s: str, centre: Column) -> DataFrame:
    """One row with k, the prior's weight in documents: the beta-binomial moment estimate from the groups' spread."""
    rate = F.col(s) / (F.col(n) * VOTE)
    sums = groups.agg(
        F.sum(F.col(n).cast("double")).alias("N"), F.count(F.lit(1)).cast("double").alias("M"), F.sum(F.col(n) * (rate - centre) * (rate - centre)).alias("q"),
        F.sum(F.col(n) * centre * (1.0 - centre)).alias("v"),
    )
    between = (F.col("q") - F.col("v") * F.col("M") / F.col("N")) / F.greatest(F.col("v"), F.lit(1e-9))
    rho = F.least(F.greatest(F.coalesce(between, F.lit(0.0)), F.lit(1e-4)), F.lit(0.9))
    return sums.select((1.0 / rho - 1.0).alias("k"))


def sites(votes: DataFrame) -> DataFrame:
    """(__h, __p, hn, hs, pn, ps, m, kh, kp) for each path: documents and votes of host and path, global rate, weights.

    votes has __h, __p and __v; null hosts and paths are sites of their own.
    """
    paths = votes.groupBy("__h", "__p").agg(F.count(F.lit(1)).alias("pn"), F.sum("__v").alias("ps"))
    host = Window.partitionBy("__h")
    paths = paths.withColumn("hn", F.sum("pn").over(host)).withColumn("hs", F.sum("ps").over(host))
    hosts = paths.groupBy("__h").agg(F.sum("pn").alias("n"), F.sum("ps").alias("s"))
    everything = hosts.agg((F.sum("s") / (F.sum("n") * VOTE)).alias("m"))
    kh = strength(hosts.crossJoin(F.broadcast(everything)), "n", "s", F.col("m")).withColumnRenamed("k", "kh")
    kp = strength(paths, "pn", "ps", F.col("hs") / (F.col("hn") * VOTE)).withColumnRenamed("k", "kp")
    return paths.crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(kh)).crossJoin(F.broadcast(kp))


def posterior(own: Column, llr: Column) -> Column:
    """The document's posterior under the prior of its path and host, both without its own vote."""
    host = (F.col("hs") - own + F.col("kh") * F.col("m") * VOTE) / (F.col("hn") - 1 + F.col("kh"))
    path = (F.col("ps") - own + F.col("kp") * host) / ((F.col("pn") - 1 + F.col("kp")) * VOTE)
    prior = F.least(F.greatest(path, F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return 1.0 / (1.0 + F.exp(-(llr + logit(prior))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_id: str, label_col: str):
    """The bins of every document (written once), the model, the table of sites, and the global log-odds.

    The sites are sent to every executor if they were counted to be few, else joined.
    """
    slim = docs.select(col(id_col).cast("long").alias("__id"), col(host_col).alias("__h"), col(path_col).alias("__p"), col(text_col).cast("string").alias("__text"))
    bins = settle(binned(slim, "__text", keep=False))
    ratio, prior = train(bins, labels, id_col, label_id, label_col)
    table = settle(sites(bins.select("__h", "__p", vote(ratio, prior).alias("__v"))).withColumnsRenamed({"__h": "__th", "__p": "__tp"}))
    return bins, ratio, F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table, prior


def at_home(host: Column, path: Column) -> Column:
    """A row's own site; a null is a host or path like any other."""
    return host.eqNullSafe(F.col("__th")) & path.eqNullSafe(F.col("__tp"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_id: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """(id, host, path, evidence, quality, keep) for every row: the likelihood ratio, the posterior, and whether to keep it.

    A null text counts as empty; null hosts and paths are sites of their own; labels other than 0 and 1 and those with
    null ids are left out; repeated rows each count. Ids are whole numbers or texts of such. Other columns are ignored; an empty table gives none; without any
    labels every document has the global prior of one half and is kept.
    """
    bins, ratio, table, prior = fit(docs, labels, id_col, text_col, host_col, path_col, label_id, label_col)
    own = bins.join(table, at_home(F.col("__h"), F.col("__p")))
    llr, p = evidence(ratio), posterior(vote(ratio, prior), evidence(ratio))
    return own.select(F.col("__id").alias(id_col), F.col("__h").alias(host_col), F.col("__p").alias(path_col), F.round(llr, 6).alias("evidence"), F.round(p, 6).alias("quality"), (p >= REJECT).alias("keep"))


def accepted(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    label_id: str = "doc_id", label_col: str = "quality",
) -> DataFrame:
    """The rows of docs that classify() keeps, all columns as they are.

    A null text counts as empty; repeated rows and null ids are rows of their own; an empty table stays empty. Bins are
    computed again beside the text, so no text is shuffled unless the sites are too many to broadcast.
    """
    _, ratio, table, prior = fit(docs, labels, id_col, text_col, host_col, path_col, label_id, label_col)
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = binned(docs.toDF(*plain.values()), plain[text_col], keep=True).join(table, at_home(F.col(plain[host_col]), F.col(plain[path_col])))
    return own.where(posterior(vote(ratio, prior), evidence(ratio)) >= REJECT).select(*plain.values()).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, posterior and verdict of every document; hosts are the sources, paths their languages."""
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


_LONG = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS f, {f} AS b FROM x" for f in BINS)
_GRID = " UNION ALL ".join(f"SELECT '{f}' AS f, unnest(range({n})) AS b, {n} AS size" for f, n in BINS.items())
_EVIDENCE = " + ".join(f"(SELECT r FROM ratio WHERE f = '{f}' AND b = x.{f})" for f in BINS)
SQL = rf"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, greatest(length(t), 1) AS n, regexp_replace(t, '[^\p{{L}}]+', '', 'g') AS letters,
  length(regexp_replace(t, '[\p{{L}}\p{{N}}\s.,;:?''"()+@/_=-]+', '', 'g')) AS symbols_n, list_filter(string_split(t, chr(10)), lambda w: w <> '') AS lines, string_split_regex(t, '[ \n]+') AS words FROM t),
v AS (SELECT *, length(regexp_replace(letters, '[^\p{{Lu}}]+', '', 'g')) AS upper_n, len(lines) AS count_n FROM w),
x AS (SELECT doc_id, source, lang, least(12, symbols_n * 50 // n) AS symbols, least(10, upper_n * 10 // greatest(length(letters), 1)) AS capitals,
  least(10, (count_n - len(list_distinct(lines))) * 10 // greatest(count_n, 1)) AS repeats,
  least(7, (length(t) - length(replace(t, '|', ''))) * 100 // n) AS pipes,
  least(10, len(list_filter(words, lambda w, i: i > 1 AND w = words[i - 1])) * 10 // len(words)) AS stutter FROM v),
y AS (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)),
k AS (SELECT f, b, count(*) FILTER (WHERE quality = 1) AS n1, count(*) FILTER (WHERE quality = 0) AS n0 FROM ({_LONG}) JOIN y USING (doc_id) GROUP BY f, b),
total AS (SELECT coalesce(sum(n1), 0) AS t1, coalesce(sum(n0), 0) AS t0 FROM k WHERE f = 'symbols'),
ratio AS (SELECT f, b, ln((coalesce(n1, 0) + {SMOOTH}) / (t1 + {SMOOTH} * size)) - ln((coalesce(n0, 0) + {SMOOTH}) / (t0 + {SMOOTH} * size)) AS r
  FROM ({_GRID}) LEFT JOIN k USING (f, b), total),
e AS (SELECT doc_id, source, lang, {_EVIDENCE} AS llr FROM x),
s AS (SELECT *, CAST(round_even({VOTE} / (1.0 + exp(-(llr + (SELECT ln((t1 + 1) / (t0 + 1)) FROM total)))), 0) AS BIGINT) AS own FROM e),
p AS (SELECT source, lang, count(*) AS pn, sum(own) AS ps FROM s GROUP BY source, lang),
h AS (SELECT source, sum(pn) AS hn, sum(ps) AS hs FROM p GROUP BY source),
g AS (SELECT sum(hs) / (sum(hn) * {VOTE}) AS m FROM h),
kh AS (SELECT 1.0 / least(greatest(coalesce((q - v * mm / nn) / greatest(v, 1e-9), 0), 1e-4), 0.9) - 1.0 AS kh FROM (
  SELECT sum(hn) AS nn, count(*) AS mm, sum(hn * (hs / (hn * {VOTE}) - m) * (hs / (hn * {VOTE}) - m)) AS q, sum(hn * m * (1.0 - m)) AS v FROM h, g)),
kp AS (SELECT 1.0 / least(greatest(coalesce((q - v * mm / nn) / greatest(v, 1e-9), 0), 1e-4), 0.9) - 1.0 AS kp FROM (
  SELECT sum(pn) AS nn, count(*) AS mm, sum(pn * (ps / (pn * {VOTE}) - c) * (ps / (pn * {VOTE}) - c)) AS q, sum(pn * c * (1.0 - c)) AS v
  FROM (SELECT p.*, hs / (hn * {VOTE}) AS c FROM p JOIN h ON p.source IS NOT DISTINCT FROM h.source))),
o AS (SELECT s.*, (ps - own + kp * ((hs - own + kh * m * {VOTE}) / (hn - 1 + kh))) / ((pn - 1 + kp) * {VOTE}) AS raw
  FROM s JOIN p ON s.source IS NOT DISTINCT FROM p.source AND s.lang IS NOT DISTINCT FROM p.lang JOIN h ON s.source IS NOT DISTINCT FROM h.source, g, kh, kp),
f AS (SELECT *, 1.0 / (1.0 + exp(-(llr + ln(least(greatest(raw, 1e-6), 1.0 - 1e-6)) - ln(1.0 - least(greatest(raw, 1e-6), 1.0 - 1e-6))))) AS post FROM o)
SELECT doc_id, source, lang, round(llr, 6) AS evidence, round(post, 6) AS quality, post >= {REJECT} AS keep FROM f
"""
