"""Toxicity: class-conditional Kneser-Ney models over the characters of words, compared by length-normalised likelihood.

Both models have counts of their own for n-grams of OWN to ORDER characters and share the counts below, so rare words
back off to the same estimates and only what one class really uses moves the comparison. Harsh words of a language with
few labelled texts look like its other words by their characters, so whole words that toxic documents share count as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import coded, col, load, settle, slices, texts, tune, word_lists

#: Longest n-gram; shortest with counts by class; words of a passage; labelled documents of a class that are used at most.
ORDER, OWN, PASSAGE, PER_CLASS = 6, 3, 2, 2000
#: Of the labelled documents, one in so many only sets the threshold; a clean document flagged there counts as so many missed.
HELD, COST = 4, 5.0
BASE = np.uint64(0x9E3779B97F4A7C15)
FALLBACK = 0.05
#: Distinct words that decide together; other toxic documents that must hold a word; documents that the classes' shares weigh
#: in a word's evidence; toxic documents a language needs for a limit of its own.
WORDS, SHARED, PRIOR, FEW = 2, 2, 6.0, 8


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character after the opening ^ of ^word$: its word, place, n-gram hashes and their contexts' (by length)."""
    text = "".join(f"^{w}$" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    full = np.zeros((ORDER + 1, len(code)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(1, ORDER + 1):  # the hash of the k characters that end here, from the k-1 before and this one
            full[k] = np.r_[np.zeros(1, np.uint64), full[k - 1][:-1]] * BASE + code * np.uint64(2 * k + 1)
            full[k] ^= full[k] >> np.uint64(31)
    inner = place > 0
    context = np.zeros_like(full)
    context[1:, 1:] = full[:-1, :-1]
    return owner[inner], place[inner], full[:, inner], context[:, inner]


class Counts:
    """One order's counts: of n-grams, and of their contexts the total and the number of different continuations."""

    def __init__(self, gram: np.ndarray, context: np.ndarray, n: np.ndarray):
        self.key, at = np.unique(gram, return_index=True)
        back = np.searchsorted(self.key, gram)
        self.n = np.bincount(back, weights=n).astype(np.float32)
        own = context[at]
        self.context = np.unique(own)
        back = np.searchsorted(self.context, own)
        self.total = np.bincount(back, weights=self.n).astype(np.float32)
        self.kinds = np.bincount(back).astype(np.float32)
        once, twice = (self.n == 1).sum(), (self.n == 2).sum()
        self.discount = np.float32(once / (once + 2 * twice) if once and twice else 0.5)

    def mixed(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Discounted probability plus what is left times the lower order's; unseen contexts leave the lower order alone."""
        if not len(self.key):
            return lower
        i = np.minimum(np.searchsorted(self.key, gram), len(self.key) - 1)
        n = np.where(self.key[i] == gram, self.n[i], 0)
        j = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        seen = self.context[j] == context
        total = np.where(seen, self.total[j], 1)
        p = (np.maximum(n - self.discount, 0) + self.discount * self.kinds[j] * lower) / total
        return np.where(seen, p, lower)


def counted(owner: np.ndarray, place: np.ndarray, full: np.ndarray, context: np.ndarray, n: np.ndarray, k: int) -> Counts:
    """Counts of order k from words that occur n times: of the longest and of those at a word's start as they are, of
    the others how many different characters precede them."""
    some = (place + 1 >= k) & (n[owner] > 0)
    own, ctx, times, at = full[k][some], context[k][some], n[owner][some].astype(np.float64), place[some]
    if k < ORDER:
        inside = at + 1 > k
        longer = full[k + 1][some][inside]
        _, first = np.unique(longer, return_index=True)
        own = np.r_[own[~inside], own[inside][first]]
        ctx = np.r_[ctx[~inside], ctx[inside][first]]
        times = np.r_[times[~inside], np.ones(len(first))]
    return Counts(own, ctx, times)


class Model:
    """The two class-conditional models."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray):
        g = grams(words)
        both = toxic + ordinary
        self.shared = [counted(*g, both, k) for k in range(1, OWN)]
        self.own = [[counted(*g, n, k) for k in range(OWN, ORDER + 1)] for n in (toxic, ordinary)]
        self.alphabet = max(64, len(self.shared[0].key))

    def ratio(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        owner, place, full, context = grams(words)
        low = np.full(len(owner), 1.0 / self.alphabet)
        for k, c in enumerate(self.shared, 1):
            low = np.where(place + 1 >= k, c.mixed(full[k], context[k], low), low)
        out = []
        for own in self.own:
            p = low
            for k, c in enumerate(own, OWN):
                p = np.where(place + 1 >= k, c.mixed(full[k], context[k], p), p)
            out.append(np.log(np.maximum(p, 1e-12)))
        return np.bincount(owner, weights=out[0] - out[1], minlength=len(words))


class Lexicon:
    """Words that several toxic documents hold, with the number of documents of either class that hold them."""

    def __init__(self, words: list[str], toxic: np.ndarray, ordinary: np.ndarray, n_toxic: int, n_ordinary: int):
        self.at = {w: i for i, w in enumerate(words)}
        self.toxic, self.ordinary = np.r_[toxic, 0.0], np.r_[ordinary, 0.0]  # the last stands for any other word
        self.share = n_toxic / (n_toxic + n_ordinary)

    def evidence(self, i: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Log odds of words over those of the classes, without the vote of the document itself; 0 unless toxic."""
        t, o = self.toxic[i] - (y == 1), self.ordinary[i] - (y == 0)
        odds = np.log((t + PRIOR * self.share) / (o + PRIOR * (1 - self.share))) - np.log(self.share / (1 - self.share))
        return np.where(t >= SHARED, np.maximum(odds, 0), 0)

    def score(self, codes: np.ndarray, names: list[str], off: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each text the evidence of its WORDS most toxic distinct words; y its class, -1 if it has no vote in the counts."""
        out = np.zeros(len(off) - 1)
        i = np.fromiter((self.at.get(w, -1) for w in names), np.int64, len(names))
        here = np.flatnonzero(i[codes] >= 0)
        doc = np.searchsorted(off, here, side="right") - 1
        pair = np.unique(doc * len(self.toxic) + i[codes[here]])
        doc, word = pair // len(self.toxic), pair % len(self.toxic)
        value = self.evidence(word, y[doc])
        order = np.lexsort((-value, doc))
        doc, value = doc[order], value[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        np.add.at(out, doc[rank < WORDS], value[rank < WORDS])
        return out


class Scorer:
    """Scores texts in one worker; words that were scored are remembered."""

    def __init__(self, model: Model, lexicon: Lexicon):
        self.model, self.lexicon, self.known = model, lexicon, {}

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_500_000:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        for i in range(0, len(fresh), 50_000):
            part = fresh[i : i + 50_000]
            self.known.update(zip(part, self.model.ratio(part).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))

    def score(self, text: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the length-normalised ratio of the whole, the largest of any passage and the evidence of whole words;
        nan without words. y is as in Lexicon.score."""
        flat, off = word_lists(text)
        codes, names = coded(flat)
        n = np.diff(off)
        whole, top, said = np.full(len(n), np.nan), np.full(len(n), np.nan), np.full(len(n), np.nan)
        if not len(codes):
            return whole, top, said
        ratio = self.of(names)[codes]
        size = np.array([len(w) + 1 for w in names], np.float64)[codes]
        r, s = np.r_[0, np.cumsum(ratio)], np.r_[0, np.cumsum(size)]
        end = np.repeat(off[1:], n)
        stop = np.minimum(np.arange(len(codes)) + PASSAGE, end)
        # a passage shorter than PASSAGE words counts only where the text itself is that short, or it would repeat a tail
        full = (stop - np.arange(len(codes)) == PASSAGE) | (np.arange(len(codes)) == np.repeat(off[:-1], n))
        mean = np.where(full, (r[stop] - r[:-1]) / (s[stop] - s[:-1]), -np.inf)
        some = np.flatnonzero(n)
        top[some] = np.maximum.reduceat(mean, off[:-1][some])
        whole[some] = (r[off[1:]] - r[off[:-1]])[some] / (s[off[1:]] - s[off[:-1]])[some]
        said[some] = self.lexicon.score(codes, names, off, y)[some]
        return whole, top, said


def scored(docs: DataFrame, model: Model, lexicon: Lexicon, counted_y: str | None = None) -> DataFrame:
    """(ratio, passage, words) in place of text for every row of docs: null for texts that are null or without words.

    counted_y is the column with the class of documents whose own vote is to be left out of the words' evidence.
    """
    tune(docs.sparkSession)
    kept = [c for c in docs.columns if c != "text"]
    at = docs.columns.index(counted_y) if counted_y else None
    names = [*kept, "ratio", "passage", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, lexicon)
        for b in slices(batches, "text", 8_000_000):
            y = np.full(b.num_rows, -1) if at is None else np.asarray(b.column(at))
            got = [pa.array(np.round(x, 6), from_pandas=True) for x in scorer.score(texts(b, "text"), y)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in kept] + got, names=names)

    schema = docs.select(*kept).schema
    for c in ("ratio", "passage", "words"):
        schema = schema.add(c, "double")
    return docs.mapInArrow(run, schema)


def slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, text); lang is null where there is no such column."""
    lang = col(lang_col) if lang_col in docs.columns else F.lit(None)
    return docs.select(col(id_col).cast("long").alias("id"), lang.cast("string").alias("lang"), col(text_col).cast("string").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, label_id: str, label_col: str, per_class: int) -> DataFrame:
    """(id, lang, text, y, held) of at most per_class labelled documents of each class, the first by the MD5 of their id."""
    y = labels.select(col(label_id).cast("long").alias("id"), col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    first = F.row_number().over(Window.partitionBy("y").orderBy(F.md5(F.col("id").cast("string")), "id"))
    # the smallest digits first, so that the window never sorts a class as a whole
    n = y.groupBy("y").count()
    share = y.join(F.broadcast(n), "y").where(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("double") <= 2.0 * per_class / F.col("count") * 2.0**32 + 2.0**22)
    some = share.withColumn("k", first).where(F.col("k") <= per_class).select(F.col("id").alias("__i"), "y", (F.col("k") % HELD == 0).alias("held"))
    d = slim(docs, id_col, text_col, lang_col).where(F.col("text").isNotNull())
    return settle(d.join(F.broadcast(some), F.col("id") == F.col("__i")).select("id", "lang", "text", "y", "held"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> tuple[Model, Lexicon, float, dict[str | None, float]] | None:
    """The models, the threshold for a passage and those for whole words; None if a class has no labelled documents.

    Three quarters of the sample are counted by characters (word counts are gathered, bounded by the sample), the rest sets
    the threshold for a passage. Whole words are counted in all of it, and each document without its own vote sets theirs.
    """
    chosen = sample(docs, labels, id_col, text_col, lang_col, label_id, label_col, per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 8_000_000):
            y, held = np.asarray(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            for c, h in ((0, False), (0, True), (1, False), (1, True)):
                part = texts(b, "text").filter(pa.array((y == c) & (held == h)))
                flat, off = word_lists(part)
                codes, names = coded(flat)
                n = np.bincount(codes, minlength=len(names)) * (not h)
                doc = np.repeat(np.arange(len(part)), np.diff(off))
                held_by = np.bincount(np.unique(doc * max(len(names), 1) + codes) % max(len(names), 1), minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c] * len(names), pa.int32()), pa.array(n, pa.int64()), pa.array(held_by, pa.int64())], names=["w", "y", "n", "d"])

    by = lambda v, y: F.sum(F.when(F.col("y") == y, F.col(v)).otherwise(0))
    w = chosen.select("text", "y", "held").mapInArrow(count, "w string, y int, n long, d long").groupBy("w").agg(by("n", 1).alias("t"), by("n", 0).alias("o"), by("d", 1).alias("dt"), by("d", 0).alias("do"))
    w = settle(w)
    got = w.where("t + o > 0").select("w", "t", "o").toPandas().sort_values("w")
    if not len(got) or not got.t.sum() or not got.o.sum():
        return None
    model = Model(got.w.tolist(), got.t.to_numpy(np.float64), got.o.to_numpy(np.float64))
    del got
    lex = w.where(F.col("dt") >= SHARED).select("w", "dt", "do").toPandas().sort_values("w")
    n = {r.y: r["count"] for r in chosen.groupBy("y").count().collect()}
    lexicon = Lexicon(lex.w.tolist(), lex.dt.to_numpy(np.float64), lex.do.to_numpy(np.float64), n[1], n[0])
    s = scored(chosen, model, lexicon, "y").select("lang", "y", "held", "passage", "words").toPandas().dropna(subset=["passage"])
    held = s[s.held]
    limit = threshold(held.passage.to_numpy(), held.y.to_numpy())
    left = s[s.passage <= limit]
    return model, lexicon, limit, limits(left.lang.tolist(), left.words.to_numpy(), left.y.to_numpy())


def limits(lang: list[str | None], words: np.ndarray, y: np.ndarray) -> dict[str | None, float]:
    """Thresholds for the words' evidence by language; under None the one for all languages with few toxic documents."""
    tag = np.array([x if isinstance(x, str) else "" for x in lang], object)
    own = [x for x in sorted(set(tag)) if x and (y[tag == x] == 1).sum() >= FEW and (y[tag == x] == 0).any()]
    out: dict[str | None, float] = {x: threshold(words[tag == x], y[tag == x]) for x in own}
    rest = ~np.isin(tag, own)
    out[None] = threshold(words[rest], y[rest]) if len(set(y[rest].tolist())) == 2 else np.inf
    return out


def threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Halfway between neighbouring scores where misses plus COST times false alarms are fewest; of equals the middle one."""
    if len(set(y.tolist())) < 2:
        return FALLBACK
    order = np.argsort(score)
    s, t = score[order], y[order]
    wrong = np.r_[0, np.cumsum(t)] + COST * (np.r_[0, np.cumsum(1 - t)][-1] - np.r_[0, np.cumsum(1 - t)])
    best = np.flatnonzero(wrong == wrong.min())
    k = best[len(best) // 2]
    return float((s[max(k - 1, 0)] + s[min(k, len(s) - 1)]) / 2)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS, lang_col: str = "lang") -> DataFrame:
    """(id, ratio, passage, words, toxic) for every row.

    ratio is the whole text's log-likelihood under the toxic model less that under the ordinary one, for each character;
    passage the largest ratio of any PASSAGE words in a row (of the whole text if it has fewer); words the log odds of its
    WORDS most toxic distinct words; toxic whether passage or words passes its threshold, the latter one by language where
    FEW toxic documents allow it. Null texts and texts without words have null scores and aren't toxic, as has every row if
    a class has no labelled texts. An id with several labels counts as toxic if any says so; other labels than 0 and 1 and
    null ids are left out. Repeated rows give rows of their own; other columns are ignored; an empty table gives none. Ids
    are whole numbers or texts of such; any other is an error.
    """
    tune(docs.sparkSession)
    got = fit(docs, labels, id_col, text_col, lang_col, label_id, label_col, per_class)
    if got is None:
        none = F.lit(None).cast("double")
        return docs.select(col(id_col).cast("long").alias(id_col), none.alias("ratio"), none.alias("passage"), none.alias("words"), F.lit(False).alias("toxic"))
    model, lexicon, limit, by_lang = got
    s = scored(slim(docs, id_col, text_col, lang_col), model, lexicon)
    own = F.lit(by_lang[None])
    for lang, at in by_lang.items():
        if lang is not None:
            own = F.when(F.col("lang") == lang, F.lit(at)).otherwise(own)
    return s.select(F.col("id").alias(id_col), "ratio", "passage", "words", F.coalesce((F.col("passage") > limit) | (F.col("words") > own), F.lit(False)).alias("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio, worst passage, worst words and verdict of every document."""
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
