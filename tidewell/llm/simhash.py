"""SimHash near-duplicates by bit-sliced comparison.

A document's 128-bit fingerprint is the sign of the sum of its distinct words' hashes. Equal fingerprints are one group at
once; the others meet in buckets of sampled bits, where bit planes stand vertically, 64 documents to a word: many
distances are counted at once by carry-save adders, and blocks of lanes are abandoned once all of them exceed the radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, union_find
from .common import coded, col, digests, every, load, settle, slices, texts, tune, word_lists

#: Bits of a fingerprint; the most that near-duplicates may differ in; tables of sampled bits, and bits of a key, at least.
BITS, RADIUS, TABLES, KEY_BITS = 128, 19, 48, 16
#: Fingerprints that share a key by chance, about, from which keys grow; rows of a bucket that one task compares.
CROWD, SPLIT = 256, 131_072
#: Ids, 8 bytes each, that are sent to every executor at most.
FEW = 2_000_000
#: Lanes from which a bucket is searched outwards from one document at a time instead of by shifts.
WIDE = 1024


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def fold(doc: np.ndarray, code: np.ndarray, bits: np.ndarray, n: int, step: int = 65_536) -> np.ndarray:
    """For n documents, in how many of their words each bit is set; doc is sorted.

    bits has a byte for each of a word's 128 bits, eight to a number: 255 words can be added before a byte is full.
    """
    out = np.zeros((n, BITS), np.int32)
    if not len(doc):
        return out
    at = np.arange(len(doc))
    new = np.r_[True, doc[1:] != doc[:-1]]
    run = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % 255 == 0)
    cut = np.r_[np.searchsorted(run, np.arange(0, len(doc), step)), len(run)]
    for i, j in zip(cut, cut[1:], strict=False):
        if i < j:
            s, e = run[i], run[j] if j < len(run) else len(doc)
            some = np.add.reduceat(bits[code[s:e]], run[i:j] - s, axis=0).view(np.uint8)
            d = doc[run[i:j]]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            out[d[first]] += np.add.reduceat(some, first, axis=0, dtype=np.int32)
    return out


def prints(text: pa.Array, cache: dict[str, bytes]) -> np.ndarray:
    """16 bytes for each text; one without words has the MD5 of what it is."""
    flat, off = word_lists(text)
    codes, names = coded(flat)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(text)), n)
    both = np.sort((doc.astype(np.int64) << 32) | codes)
    both = both[np.r_[True, both[1:] != both[:-1]]] if len(both) else both
    bits = np.unpackbits(digests(names, cache), axis=1).view(np.uint64)
    doc = both >> 32
    sums = fold(doc, both & 0xFFFFFFFF, bits, len(text))
    out = np.packbits(2 * sums > np.bincount(doc, minlength=len(text))[:, None], axis=1)
    for i in np.flatnonzero(n == 0):
        out[i] = np.frombuffer(hashlib.md5((text[int(i)].as_py() or "").encode(), usedforsecurity=False).digest(), np.uint8)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row with an id and a text: the 128-bit fingerprint as 16 bytes."""
    tune(docs.sparkSession)
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    out = pa.schema([("id", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, bytes] = {}
        for b in slices(batches, "text", 8_000_000):
            p = prints(texts(b, "text"), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(bytes, p)), pa.binary())], schema=out)

    return slim.mapInArrow(run, "id long, fp binary")


# ---- bit-sliced distances --------------------------------------------------------------------------------------------


def planes(fp: np.ndarray) -> np.ndarray:
    """Rows of 16 bytes as bit planes: 128 x words of 64 lanes."""
    n = len(fp)
    bits = np.zeros((BITS, -(-n // 64) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fp, axis=1).T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Counter:
    """Vertical counters of 8 bits for each lane, filled by carry-save adders, seven planes at a time."""

    def __init__(self, words: int):
        self.sum = [np.zeros(words, np.uint64) for _ in range(8)]

    @staticmethod
    def full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    def ripple(self, carry: np.ndarray, k: int) -> None:
        for i in range(k, 8):
            self.sum[i], carry = self.sum[i] ^ carry, self.sum[i] & carry

    def add(self, x: np.ndarray) -> None:
        """Add planes x (any number of rows) to the lanes' counts."""
        i = 0
        while i + 7 <= len(x):
            a, p = self.full(x[i], x[i + 1], x[i + 2])
            b, q = self.full(x[i + 3], x[i + 4], x[i + 5])
            a, r = self.full(a, b, x[i + 6])
            two, four = self.full(p, q, r)
            self.ripple(a, 0)
            self.ripple(two, 1)
            self.ripple(four, 2)
            i += 7
        for row in x[i:]:
            self.ripple(row, 0)

    def within(self, radius: int) -> np.ndarray:
        """The lanes whose count is at most the radius."""
        less, same = np.zeros_like(self.sum[0]), np.full_like(self.sum[0], ~np.uint64(0))
        for i in reversed(range(8)):
            if radius >> i & 1:
                less |= same & ~self.sum[i]
                same &= self.sum[i]
            else:
                same &= ~self.sum[i]
        return less | same

    def keep(self, words: np.ndarray) -> None:
        self.sum = [s[words] for s in self.sum]


def close(left, right, valid: np.ndarray, radius: int, step: int = 21) -> np.ndarray:
    """The lanes, among the valid ones, whose planes differ in at most `radius` bits.

    left and right give rows from-to of the planes for chosen words. Words in which no valid lane can still come within
    the radius are dropped after every `step` planes.
    """
    out = np.zeros_like(valid)
    at = np.flatnonzero(valid)
    live, c = valid[at], Counter(len(at))
    for k in range(0, BITS, step):
        if not len(at):
            return out
        c.add(left(k, min(k + step, BITS), at) ^ right(k, min(k + step, BITS), at))
        if k + step > radius:
            live = live & c.within(radius)
            some = live != 0
            if not some.all():
                at, live = at[some], live[some]
                c.keep(some)
    out[at] = live
    return out


def lanes(words: np.ndarray) -> np.ndarray:
    """The numbers of the lanes that are set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def shifted(p: np.ndarray, s: int, words: int) -> np.ndarray:
    """Planes moved so that lane i holds lane i+s, for the first words."""
    w, b = divmod(s, 64)
    part = p[:, w : w + words + 1]
    if part.shape[1] < words + 1:
        part = np.pad(part, ((0, 0), (0, words + 1 - part.shape[1])))
    low = part[:, :words]
    return low if b == 0 else (low >> np.uint64(b)) | (part[:, 1:] << np.uint64(64 - b))


def mask(n: int, words: int) -> np.ndarray:
    """Words whose first n lanes are set."""
    bits = np.zeros(words * 64, np.uint8)
    bits[:n] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def narrow_pairs(fp: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within the radius in the same bucket; rows stand bucket by bucket, the largest buckets first.

    size is the bucket's size for each row. All rows are compared at once with the row s places on, for s = 1, 2, ...;
    buckets of s rows or fewer are at the end, so the planes only get shorter.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(fp):
        return left[0], right[0]
    p = planes(fp)
    row = np.arange(len(fp))
    i, new = 0, []
    while i < len(fp):  # buckets of one size are laid out alike
        j = int(np.searchsorted(-size, -size[i], side="right"))
        new.append(i + (np.arange(j - i) // size[i] + 1) * size[i])
        i = j
    ends = np.concatenate(new)  # where each row's bucket ends
    s = 1
    while True:
        n = int(np.searchsorted(-size, -s, side="left"))  # rows in buckets of more than s
        if n <= s:
            break
        words = -(-n // 64)
        ok = np.zeros(words * 64, np.uint8)
        ok[:n] = row[:n] + s < ends[:n]
        valid = np.packbits(ok, bitorder="little").view(np.uint64)
        far = [shifted(p[k : k + 21], s, words) for k in range(0, BITS, 21)]
        hit = lanes(close(lambda a, b, at: p[a:b][:, at], lambda a, b, at, far=far: far[a // 21][:, at], valid, radius))
        left.append(hit)
        right.append(hit + s)
        s += 1
    return np.concatenate(left), np.concatenate(right)


def wide_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one large bucket, without every pair of a dense group.

    Each row is compared with all that no search has reached yet; those within the radius are reached and take their
    turn. Reached rows leave the planes, so a group of copies costs no more than a few passes over it.
    """
    left, right = [], []
    rows = np.arange(len(fp))
    p = planes(fp)
    alive = np.ones(len(fp), bool)
    turn: list[int] = []
    nxt = 0
    while True:
        if turn:
            q = turn.pop()
        else:
            while nxt < len(fp) and not alive[nxt]:
                nxt += 1
            if nxt == len(fp):
                break
            q = nxt
            alive[q] = False
        if not alive.any():
            break
        if alive.sum() * 2 < len(rows):  # close the gaps
            rows = np.flatnonzero(alive)
            p = planes(fp[rows])
        ok = np.zeros(p.shape[1] * 64, np.uint8)
        ok[: len(rows)] = alive[rows]
        bit = np.unpackbits(fp[q]).astype(bool)
        own = np.where(bit, ~np.uint64(0), np.uint64(0))[:, None]
        hit = rows[lanes(close(lambda a, b, at: p[a:b][:, at], lambda a, b, at: own[a:b], np.packbits(ok, bitorder="little").view(np.uint64), radius))]
        alive[hit] = False
        left.append(np.full(len(hit), q))
        right.append(hit)
        turn.extend(hit.tolist())
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def linked(fp: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links within the radius inside each bucket; the rows of a bucket must stand together."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(bucket)])
    per = np.repeat(size, size)
    order = np.argsort(-per, kind="stable")
    small = order[(per[order] > 1) & (per[order] < WIDE)]
    a, b = narrow_pairs(fp[small], per[small], radius)
    left, right = [small[a]], [small[b]]
    for s, n in zip(start[size >= WIDE], size[size >= WIDE], strict=True):
        a, b = wide_links(fp[s : s + n], radius)
        left.append(s + a)
        right.append(s + b)
    return np.concatenate(left), np.concatenate(right)


# ---- candidates and groups -------------------------------------------------------------------------------------------


def table_bits(tables: int = TABLES, key_bits: int = KEY_BITS) -> np.ndarray:
    """For each table, which bits of the fingerprint make its key; every bit is used about equally often."""
    rng = np.random.default_rng(20240229)
    out, pool = [], np.zeros(0, np.int64)
    for _ in range(tables):
        if len(pool) < key_bits:
            fresh = rng.permutation(BITS)
            pool = np.r_[pool, fresh[~np.isin(fresh, pool)]]
        out.append(np.sort(pool[:key_bits]))
        pool = pool[key_bits:]
    return np.array(out)


def tables_for(n: int, radius: int = RADIUS) -> tuple[int, int]:
    """(tables, key bits) for n fingerprints.

    Keys grow by a bit whenever n doubles, so that no more than CROWD fingerprints share one by chance and the work is in
    proportion to n. Longer keys meet less often, so tables are added until as few pairs at the radius are missed as by
    TABLES tables of KEY_BITS bits.
    """
    bits = max(KEY_BITS, int(np.ceil(np.log2(max(n, 1) / CROWD))))

    def alike(k: int) -> float:
        """How likely it is that none of k bits is among those that differ."""
        return float(np.prod((BITS - radius - np.arange(k)) / (BITS - np.arange(k))))

    if bits == KEY_BITS:
        return TABLES, bits
    # an eighth more, as fewer groups of one permutation fit side by side
    return int(np.ceil(1.125 * TABLES * np.log1p(-alike(KEY_BITS)) / np.log1p(-alike(bits)))), bits


def links(distinct: DataFrame, radius: int = RADIUS, tables: int | None = None, key_bits: int | None = None, split: int = SPLIT) -> DataFrame:
    """(a, b) with a < b: links between the ids of distinct fingerprints (id, fp) that connect near pairs.

    Fingerprints meet in a table if they agree in its sampled bits. The tables are permutations of disjoint groups of
    bits, so with 48 tables of 16 bits a pair at distance d is missed if it differs in all of them: never at 6, 1 in 33 at
    19. Of the near pairs that meet in a task, as many links come out as connect what they connect, so that copies of
    copies never make more links than there are rows. No bucket is cut short: one of more than about `split` rows, as a
    sample of the fingerprints counts them, is cut into blocks, every two of which meet in a task of their own.
    """
    if tables is None or key_bits is None:
        tables, key_bits = tables_for(distinct.count(), radius)
    chosen = table_bits(tables, key_bits)
    keyed = pa.schema([("bucket", pa.int64()), ("id", pa.int64()), ("fp", pa.binary())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, 16)
            bits = np.unpackbits(fp, axis=1)
            for t, own in enumerate(chosen):
                k = bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(k * tables + t), b.column(0), b.column(1)], schema=keyed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def solve(whole: bool) -> Iterator[pa.RecordBatch]:
            """Compare what is held; unless the input has ended, the last bucket waits."""
            nonlocal held, count
            k, i, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(k) if whole else int(np.searchsorted(k == k[-1], True)) if k[0] != k[-1] else 0
            if not whole and cut == 0:
                held, count = [(k, i, fp)], 0
                return
            a, b = linked(fp[:cut], k[:cut], radius)
            held, count = ([(k[cut:], i[cut:], fp[cut:])] if cut < len(k) else []), 0
            if len(a):
                near, root = union_find(i[a], i[b])
                far = near != root
                yield pa.RecordBatch.from_arrays([pa.array(root[far], pa.int64()), pa.array(near[far], pa.int64())], schema=edge)

        for b in batches:
            if b.num_rows:
                held.append((np.asarray(b.column(0)), np.asarray(b.column(1)), np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, 16)))
                count += b.num_rows
                if count >= 100_000:
                    yield from solve(False)
        if held:
            yield from solve(True)

    def met(rows: DataFrame) -> DataFrame:
        return rows.select("id", "fp").mapInArrow(key, "bucket long, id long, fp binary")

    one_in = max(1, min(64, split // 2048))
    some = met(distinct.where(F.pmod(F.xxhash64("fp"), F.lit(one_in)) == 0)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    hot = settle(some.where(F.col("n") * one_in > split).select(F.col("bucket").alias("__hot"), F.ceil(2 * F.col("n") * one_in / split).cast("long").alias("__c")))
    rows = met(distinct)
    if hot.limit(1).count():
        # block r of c meets every block x, itself too: the pair's key stands for a bucket
        both = rows.join(hot, F.col("bucket") == F.col("__hot"), "left")
        own = F.pmod(F.xxhash64("id"), F.col("__c"))
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("__c") - 1), lambda x: F.xxhash64("bucket", F.least(x, own), F.greatest(x, own)))
        rows = both.select(F.explode(F.when(F.col("__c").isNull(), F.array("bucket")).otherwise(pair)).alias("bucket"), "id", "fp")
    met_rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return met_rows.mapInArrow(search, "a long, b long").distinct()


def copies(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id) for every id with a fingerprint that isn't its group's smallest; printed has (id, fp)."""
    one = settle(printed.groupBy("fp").agg(F.min("id").alias("id")))
    groups = components(links(one, radius))
    root = one.join(groups, "id", "left").select("fp", F.coalesce("group", "id").alias("kept_id"))
    every_one = printed.join(root, "fp").groupBy("id").agg(F.min("kept_id").alias("kept_id"))
    return every_one.where(F.col("id") != F.col("kept_id")).select(F.col("id").alias("doc_id"), "kept_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, kept_id) for every document that goes: the copies of kept_id, itself the smallest id of its group.

    Groups are connected: copies of copies belong together. Texts are compared as sets of lower-cased words; texts without
    words are copies only if they are equal. Rows with a null id or text are nobody's copies. Rows that share an id are one
    document, which goes if any of its texts is a copy of a smaller id's. Other columns are ignored, an empty table gives
    no rows. Ids are whole numbers or texts of such; any other is an error.
    """
    return copies(settle(fingerprints(docs, id_col, text_col)), radius)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs without the near-duplicates: of each group the row with the smallest id stays, columns as they are.

    Rows with a null id or text stay. Of rows that share an id which stays, one remains for each different text.
    """
    printed = settle(fingerprints(docs, id_col, text_col))
    gone = settle(copies(printed, radius).select(F.col("doc_id").alias("__gone")))
    # few ids go to every executor, so that no text is moved; more of them meet the texts by hash, without sorting these
    gone = F.broadcast(gone) if gone.count() <= FEW else gone.hint("shuffle_hash")
    row = docs.select(F.struct(*every(docs)).alias("__row"), col(id_col).cast("long").alias("__id"), col(text_col).cast("string").isNotNull().alias("__has"))
    open_ = F.col("__has") & F.col("__id").isNotNull()  # the others stay where they are, whatever their number
    kept = row.where(open_).join(gone, F.col("__id") == F.col("__gone"), "left_anti").unionByName(row.where(~open_))
    twice = settle(printed.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("__twice")))
    if twice.limit(1).count():
        text = F.col("__row").getField(text_col).cast("string")
        again = kept.join(twice, F.col("__id") == F.col("__twice"), "left")
        many = again.where(F.col("__twice").isNotNull() & F.col("__has")).withColumn("__t", F.sha2(text, 256)).dropDuplicates(["__id", "__t"])
        kept = again.where(F.col("__twice").isNull() | ~F.col("__has")).select("__row").unionByName(many.select("__row"))
    return kept.select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every near-duplicate of the documents, with the document that stays in its place."""
    return near_duplicates(load(spark, sf_dir, "documents"))
