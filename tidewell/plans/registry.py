"""Every query of the engine by name, and its SQL.

The test tables hold no images, so documents stand in for them: the text for the content, the character count for the
resolution, the quality label for the main class, and counts of vowels along the text for an image's row of brightness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import hashing, paths, prompts
from ..operators import annotate, dedup, sampling
from ..sources.scratch import settle
from . import cleanup

SPLITS = ("train", "valid")
#: Targets of the sample and of the plan, and of the quotas over line items.
TARGETS, ITEM_TARGETS = {"train": 300, "valid": 90}, {"F": 1003, "O": 997}
CLASSES = 12
#: A class of more digits than any whole number of the engine has.
LONG = "1234567890" * 4


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- stand-ins -------------------------------------------------------------------------------------------------------


def split_of(key: Column) -> Column:
    return F.when(key % 5 == 0, "valid").otherwise("train")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as images: (doc_id, key, subset, image, label, sha256, dhash, res)."""
    d = load(spark, sf_dir, "documents").withColumn("subset", split_of(F.col("doc_id")))
    d = d.withColumn("image", F.concat(F.lit("/ds/"), "subset", F.lit("/images/"), "doc_id", F.lit(".jpg")))
    return d.select(
        "doc_id", F.col("doc_id").cast("string").alias("key"), "subset", "image",
        paths.label_path(F.col("image"), F.concat(F.lit("/ds/"), "subset")).alias("label"),
        hashing.digest(F.col("text")).alias("sha256"), hashing.row_bits(hashing.vowel_profile(F.col("text"))).alias("dhash"), F.col("n_chars").alias("res"),
    )


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """images with cls, the quality label, -1 where there is none."""
    y = load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("cls"))
    return sampling.with_class(images(spark, sf_dir), y, "doc_id", "cls")


def item_box() -> Column:
    """A line item as a box, for some classes unknown, some sizes zero or null and some places between two millionths."""
    tie = (F.col("l_orderkey") % 1_000_000 + F.lit(0.5)) / F.lit(1e6)
    x, w = F.when(F.col("l_linenumber") == 2, tie).otherwise(F.col("l_discount")), F.when(F.col("l_linenumber") != 5, F.col("l_quantity") / 25)
    return F.struct((F.col("l_suppkey") % 14).alias("class_id"), x.alias("cx"), F.col("l_tax").alias("cy"), w.alias("w"), F.col("l_tax").alias("h"))


def item_text() -> Column:
    """A line item as an annotator's free text: signs and trailing words make some lines unusable, some classes are long,
    some numbers lie between two millionths, some texts are null."""
    n = F.col("l_linenumber")
    line = F.concat(
        F.when(n == 4, f"00{LONG}").otherwise(n.cast("string")), F.lit(" "), F.when(F.col("l_returnflag") == "A", "-").otherwise(""), F.col("l_discount").cast("string"), F.lit(" "), F.col("l_tax").cast("string"),
        F.lit("\t"), F.col("l_quantity").cast("string"), F.when(n == 3, " .1234565").otherwise(" .5"), F.when(F.col("l_returnflag") == "R", " x").otherwise(""),
    )
    return F.when(n != 7, F.concat(F.lit("Here they are:\r\n"), line, F.lit("\n99 .5 0.25 0 1.5")))


# ---- queries ---------------------------------------------------------------------------------------------------------


def scan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are images, and where their labels would be."""
    endings = F.array(*map(F.lit, (".jpg", ".JPEG", ".png", ".gif", ".tar.png", "")))
    d = load(spark, sf_dir, "documents").withColumn("root", F.concat(F.lit("/images/"), split_of(F.col("doc_id"))))
    d = d.select("root", F.concat("root", F.when(F.col("doc_id") % 7 == 0, "/pics/").otherwise("/images/"), "doc_id", F.get(endings, (F.col("doc_id") % 6).cast("int"))).alias("path"))
    both = d.unionByName(load(spark, sf_dir, "pages").select(F.lit("/").alias("root"), F.col("url").alias("path")))
    return both.select("path", paths.extension(F.col("path")).alias("ext"), paths.is_image(F.col("path")).alias("is_image"), paths.label_path(F.col("path"), F.col("root")).alias("label"))


def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", hashing.digest(F.col("text")).alias("sha256"))


def exact_groups(across: bool):
    return lambda spark, sf_dir: dedup.exact_groups(images(spark, sf_dir), across)


def exact_removed(across: bool):
    return lambda spark, sf_dir: dedup.exact_removed(images(spark, sf_dir), across).select("subset", "image", "keep")


def dhash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("doc_id", hashing.hex16(F.col("dhash")).alias("dhash"), hashing.prefix(F.col("dhash")).alias("prefix"))


def dhash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", hashing.hex16(hashing.row_bits(F.col("embedding"), wrap=True)).alias("dhash"))


def near_pairs(across: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = dedup.near_pairs(dedup.hashes(images(spark, sf_dir), across).select("scope", "dhash"))
        a, b = hashing.hex16(F.col("a")), hashing.hex16(F.col("b"))
        return p.select("scope", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col("distance").cast("int").alias("distance"))

    return run


def near_clusters(across: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = dedup.near_members(settle(images(spark, sf_dir)), across=across)
        return m.select("scope", "image", hashing.hex16(F.col("cluster")).alias("cluster"), F.col("size").cast("long").alias("size"), (F.col("image") == F.col("keep")).alias("stays"))

    return run


def dedup_removed(across: bool):
    """What exact and near deduplication remove, and why."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        exact, near, _ = dedup.deduplicate(settle(images(spark, sf_dir)), across=across)
        return exact.select("subset", "image", "keep", F.lit("exact").alias("reason")).unionByName(near.select("subset", "image", "keep", F.lit("near").alias("reason")))

    return run


def after_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = dedup.deduplicate(settle(images(spark, sf_dir)))[2]
    return rest.groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


def main_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent class of each order's items, -1 for orders without items."""
    l = load(spark, sf_dir, "lineitem")
    rows = l.select("l_orderkey", (F.col("l_suppkey") % CLASSES).alias("cls"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*l.columns)).alias("position"))
    classes = sampling.main_class(rows, "l_orderkey", "cls", "position")
    return sampling.with_class(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), classes, "l_orderkey", "cls").select(F.col("l_orderkey").alias("o_orderkey"), F.col("cls").cast("long").alias("cls"))


def class_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y = load(spark, sf_dir, "documents").select("doc_id", split_of(F.col("doc_id")).alias("subset")), load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("cls"))
    counts = sampling.with_class(d, y, "doc_id", "cls").groupBy("subset", "cls").agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(counts, TARGETS)


def quota_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("subset"), (F.col("l_suppkey") % CLASSES).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(counts, ITEM_TARGETS)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample that fills the quotas: here a limit is the point."""
    d, y = load(spark, sf_dir, "documents").select("doc_id", split_of(F.col("doc_id")).alias("subset")), load(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("cls"))
    c = sampling.with_class(d, y, "doc_id", "cls")
    quota = sampling.quotas(c.groupBy("subset", "cls").agg(F.count(F.lit(1)).alias("n")), TARGETS)
    return sampling.sample(c, quota, "doc_id").where("kept").select("doc_id", "subset", F.col("cls").cast("long").alias("cls"))


def planned(spark: SparkSession, sf_dir: str) -> cleanup.Plan:
    return cleanup.plan(settle(classed(spark, sf_dir)), list(SPLITS), TARGETS)


def cleanup_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).removals()


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).counts().drop("subset_ord")


def yolo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of orders, their items being the boxes."""
    boxes = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item_box()).alias("boxes"))
    lines = boxes.select("l_orderkey", F.array_sort(bx.box_lines(F.col("boxes"), CLASSES)).alias("lines"))
    return lines.select("l_orderkey", F.size("lines").cast("long").alias("n"), F.array_join("lines", "\n").alias("file"))


def yolo_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(bx.text_lines(item_text()), "\n").alias("lines"))


def boxes_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of JSON replies, some of which are null or no JSON, hold no list or one of boxes and other things."""
    l, n = load(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    box = F.to_json(F.struct((F.col("l_suppkey") % 14).alias("class_id"), F.col("l_discount").alias("cx"), F.col("l_tax").alias("center_y")))
    good = F.concat(F.lit('{"boxes":['), F.when(n == 4, '7,"{",null,[1],').otherwise(""), box, F.lit("]}"))
    reply = F.when(n == 7, "no boxes here").when(n == 6, '{"boxes":5}').when(n == 5, "[1]").when(n != 3, good)
    b = l.select("l_orderkey", "l_linenumber", bx.parsed_boxes(reply).alias("b"))
    first = F.get("b", F.lit(0))
    return b.select("l_orderkey", "l_linenumber", F.size("b").cast("long").alias("n"), first["class_id"].alias("class_id"), F.coalesce(first["center_x"], first["cx"]).alias("cx"), F.coalesce(first["center_y"], first["cy"]).alias("cy"))


def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each brand, whose types are the classes."""
    p = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types"), F.max("p_size").alias("w"), F.min("p_size").alias("h"))
    described = F.transform("types", lambda t: F.struct(t.alias("name"), F.when(F.length(t) % 2 == 0, F.concat(F.lit("made of "), t)).alias("description")))
    notes = F.when(F.col("p_brand").endswith("1"), "").otherwise("Mind the shade.")
    return p.select("p_brand", prompts.prompt(F.col("w") * 10, F.col("h") * 10, described, notes).alias("prompt"))


def fallback_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the structured reply, or where it has none usable those of the plain one."""
    own, plain = bx.box_lines(F.array(item_box()), CLASSES), bx.text_lines(item_text())
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", own.alias("own"), plain.alias("plain"))
    again = F.size("own") == 0
    return l.select("l_orderkey", "l_linenumber", again.alias("used_fallback"), F.array_join(F.when(again, F.col("plain")).otherwise(F.col("own")), "\n").alias("lines"))


def label_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.concat(F.lit("/in/"), "source", F.lit("/"), F.col("doc_id") % 333, F.when(F.col("doc_id") % 2 == 0, ".jpg").otherwise(".png")).alias("path"))
    return annotate.collisions(d.select(paths.flat_label_path(F.col("path"), F.lit("/out")).alias("label_path")))


def backup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = images(spark, sf_dir).select("subset", "image")
    return i.select("image", paths.backup_path(F.col("image"), F.concat(F.lit("/ds/"), "subset"), F.lit("/backup"), F.col("subset")).alias("target"))


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames are a user's events in order, numbered from 0."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame_no"))
    return e.select("event_id", "user_id", "frame_no", paths.frame_name(F.col("frame_no")).alias("name"))


def pending_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose label file isn't there yet."""
    there = load(spark, sf_dir, "labels").select(F.concat(F.lit("/ds/"), split_of(F.col("doc_id")), F.lit("/labels/"), "doc_id", F.lit(".txt")).alias("path"))
    return annotate.pending(images(spark, sf_dir).withColumnRenamed("label", "label_path"), there).select("image", "label_path")


QUERIES = {
    "scan_images": scan_images,
    "content_sha256": content_sha256,
    "exact_groups": exact_groups(False),
    "exact_groups_global": exact_groups(True),
    "exact_removed": exact_removed(False),
    "exact_removed_global": exact_removed(True),
    "dhash_text": dhash_text,
    "dhash_embedding": dhash_embedding,
    "near_pairs": near_pairs(False),
    "near_pairs_global": near_pairs(True),
    "near_clusters": near_clusters(False),
    "near_clusters_global": near_clusters(True),
    "dedup_removed": dedup_removed(False),
    "dedup_removed_global": dedup_removed(True),
    "after_dedup_counts": after_dedup_counts,
    "main_class": main_class,
    "class_quota": class_quota,
    "quota_repair": quota_repair,
    "stratified_sample": stratified_sample,
    "cleanup_plan": cleanup_plan,
    "plan_summary": plan_summary,
    "yolo_lines": yolo_lines,
    "yolo_text_parse": yolo_text_parse,
    "boxes_json": boxes_json,
    "prompt_text": prompt_text,
    "fallback_policy": fallback_policy,
    "label_collisions": label_collisions,
    "backup_paths": backup_paths,
    "frame_names": frame_names,
    "pending_labels": pending_labels,
}


# ---- SQL -------------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'valid' ELSE 'train' END"
_SLICE = "substr(text, CAST(1 + (i * length(text)) // 65 AS INT), greatest(1, length(text) // 65))"
#: img as images() has it, i with its scope and rank among others.
_IMAGES = rf"""
d AS (SELECT doc_id, {_SPLIT} AS subset, text, n_chars, list_transform(range(65), lambda i: length(regexp_replace({_SLICE}, '[^aeiou]', '', 'g'))) AS v FROM documents),
img AS (SELECT doc_id, subset, '/ds/' || subset || '/images/' || doc_id || '.jpg' AS image, '/ds/' || subset || '/labels/' || doc_id || '.txt' AS label, sha256(text) AS sha256, n_chars AS res,
  CAST(list_sum(list_transform(range(64), lambda k: CASE WHEN v[k + 1] > v[k + 2] THEN CAST(pow(2, 63 - k) AS HUGEINT) ELSE 0 END)) AS UBIGINT) AS h FROM d)"""
_BEST = "CASE WHEN subset = 'valid' THEN 0 ELSE 1 END, res DESC, image"
_DISTANCE = "CAST(bit_count(CAST(xor({0}, {1}) AS UBIGINT)) AS INT)"


def _hex(x: str) -> str:
    return f"lpad(lower(to_hex({x})), 16, '0')"


def _scope(across: bool) -> str:
    return "'*'" if across else "subset"


def _exact(across: bool) -> str:
    """i: images with scope, n copies, rank k and the best copy."""
    w = f"PARTITION BY {_scope(across)}, sha256"
    return f"i AS (SELECT *, {_scope(across)} AS scope, count(*) OVER ({w}) AS n, row_number() OVER ({w} ORDER BY {_BEST}) AS k, first_value(image) OVER ({w} ORDER BY {_BEST}) AS keep FROM img)"


def _near(rows: str) -> str:
    """near: rows with their cluster, its size, rank and best member; pr: pairs of hashes in both orders."""
    w = "PARTITION BY scope, cluster"
    return f"""
hh AS (SELECT DISTINCT scope, h FROM {rows}),
pr AS (SELECT x.scope, x.h AS a, y.h AS b FROM hh x JOIN hh y ON x.scope = y.scope AND x.h >> 52 = y.h >> 52 AND x.h <> y.h AND {_DISTANCE.format("x.h", "y.h")} <= {dedup.THRESHOLD}),
reach(scope, h, r) AS (SELECT scope, h, h FROM hh UNION SELECT reach.scope, reach.h, pr.b FROM reach JOIN pr ON reach.scope = pr.scope AND reach.r = pr.a),
cl AS (SELECT scope, h, min(r) AS cluster FROM reach GROUP BY scope, h),
near AS (SELECT {rows}.* EXCLUDE (n, k, keep), cluster, count(*) OVER ({w}) AS size, row_number() OVER ({w} ORDER BY {_BEST}) AS k, first_value(image) OVER ({w} ORDER BY {_BEST}) AS keep
  FROM {rows} JOIN cl USING (scope, h))"""


def _quota(counts: str, targets: dict[str, int]) -> str:
    """quota: counts (subset, cls, n) with the repaired quota."""
    target = "CASE subset " + " ".join(f"WHEN '{s}' THEN {t}" for s, t in targets.items()) + " END"
    return f"""
qc AS (SELECT subset, cls, n, sum(n) OVER (PARTITION BY subset) AS total, {target} AS target FROM {counts}),
qr AS (SELECT *, target IS NULL OR total <= target AS whole, CASE WHEN target IS NULL OR total <= target THEN n ELSE CAST(round_even(target * (n / total), 0) AS BIGINT) END AS q FROM qc),
qd AS (SELECT *, CASE WHEN whole THEN 0 ELSE target - sum(q) OVER (PARTITION BY subset) END AS diff FROM qr),
qo AS (SELECT *, CASE WHEN diff > 0 THEN n - q > 0 ELSE q > 0 END AS ok FROM qd),
qk AS (SELECT *, row_number() OVER (PARTITION BY subset, ok ORDER BY CASE WHEN diff > 0 THEN q - n ELSE n - q END, cls) AS k FROM qo),
quota AS (SELECT subset, cls, n, CAST(q + CASE WHEN ok AND k <= abs(diff) THEN sign(diff) ELSE 0 END AS BIGINT) AS quota FROM qk)"""


_DOC_CLASS = f"SELECT d.doc_id, {_SPLIT.replace('doc_id', 'd.doc_id')} AS subset, coalesce(y.quality, -1) AS cls FROM documents d LEFT JOIN labels y ON d.doc_id = y.doc_id"


def _drawn(rows: str) -> str:
    """Rows (doc_id, subset, cls) with rank k in their class's random order and the quota."""
    return f"SELECT x.*, quota, row_number() OVER (PARTITION BY x.subset, x.cls ORDER BY md5('{sampling.SEED}:' || doc_id), doc_id) AS k FROM {rows} x JOIN quota q ON x.subset = q.subset AND x.cls = q.cls"


_PLAN = f"""WITH RECURSIVE {_IMAGES}, {_exact(False)}, e AS (SELECT * FROM i WHERE k = 1), {_near("e")},
rest AS (SELECT near.*, coalesce(y.quality, -1) AS cls FROM near LEFT JOIN labels y ON near.doc_id = y.doc_id WHERE k = 1),
counts AS (SELECT subset, cls, count(*) AS n FROM rest GROUP BY subset, cls), {_quota("counts", TARGETS)},
drawn AS ({_drawn("(SELECT * EXCLUDE (k) FROM rest)")}),
gone AS (SELECT subset, image, label, 'exact' AS reason FROM i WHERE k > 1 UNION ALL SELECT subset, image, label, 'near' FROM near WHERE k > 1
  UNION ALL SELECT subset, image, label, 'downsample' FROM drawn WHERE k > quota)"""
_LINE = bx.LINE.replace("'", "''")
_CLAMP = "greatest(0.0, least(1.0, {}))"
_TIE = "CASE WHEN l_linenumber = 2 THEN (CAST(l_orderkey % 1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / 1e6 ELSE l_discount END"
_BOX = f"""box AS (SELECT l_orderkey, l_linenumber, l_suppkey % 14 < {CLASSES} AND l_linenumber <> 5 AND {_CLAMP.format("l_quantity / 25")} > 0 AND {_CLAMP.format("l_tax")} > 0 AS ok,
  printf('%d %.6f %.6f %.6f %.6f', l_suppkey % 14, {", ".join(_CLAMP.format(c) for c in (_TIE, "l_tax", "l_quantity / 25", "l_tax"))}) AS line,
  CASE WHEN l_linenumber = 4 THEN '00{LONG}' ELSE CAST(l_linenumber AS VARCHAR) END || ' ' || CASE WHEN l_returnflag = 'A' THEN '-' ELSE '' END || CAST(l_discount AS VARCHAR) || ' ' || CAST(l_tax AS VARCHAR)
    || chr(9) || CAST(l_quantity AS VARCHAR) || CASE WHEN l_linenumber = 3 THEN ' .1234565' ELSE ' .5' END || CASE WHEN l_returnflag = 'R' THEN ' x' ELSE '' END AS own FROM lineitem),
txt AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN 'Here they are:' || chr(13) || chr(10) || own || chr(10) || '99 .5 0.25 0 1.5' END AS t FROM box)"""
_PART = lambda i: _CLAMP.format(f"CAST(regexp_extract(x, '{_LINE}', {i}) AS DOUBLE)")
_FREE = f"""array_to_string(list_transform(list_filter(string_split_regex(t, '\\r\\n|[\\r\\n]'), lambda x: regexp_matches(x, '{_LINE}')),
  lambda x: printf('%s %.6f %.6f %.6f %.6f', regexp_replace(regexp_extract(x, '{_LINE}', 1), '^0+([0-9])', '\\1'), {", ".join(map(_PART, range(2, 6)))})), chr(10))"""


def _quoted(text: str) -> str:
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in text.split("\n"))


SQL = {
    "scan_images": r"""
WITH d AS (SELECT '/images/' || CASE WHEN doc_id % 5 = 0 THEN 'valid' ELSE 'train' END AS root, doc_id % 7 = 0 AS pics, doc_id, ['.jpg', '.JPEG', '.png', '.gif', '.tar.png', ''][doc_id % 6 + 1] AS ending FROM documents),
p AS (SELECT root || CASE WHEN pics THEN '/pics/' ELSE '/images/' END || doc_id || ending AS path,
    CASE WHEN pics THEN '' ELSE root || '/labels/' || doc_id || CASE WHEN ending = '.tar.png' THEN '.tar' ELSE '' END || '.txt' END AS label FROM d
  UNION ALL SELECT url, '' FROM pages),
e AS (SELECT *, lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '^.*[^.].*?(\.[^.]*)$', 1)) AS ext FROM p)
SELECT path, ext, ext IN ('.jpg', '.jpeg', '.png', '.bmp', '.tif', '.tiff', '.webp') AS is_image, label FROM e
""",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "dhash_text": f"WITH {_IMAGES} SELECT doc_id, {_hex('h')} AS dhash, CAST(h >> 52 AS BIGINT) AS prefix FROM img",
    "dhash_embedding": f"""
WITH b AS (SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > embedding[(i + 1) % 64 + 1] THEN CAST(pow(2, 63 - i) AS HUGEINT) ELSE 0 END)) AS UBIGINT) AS h FROM embeddings)
SELECT vec_id, {_hex("h")} AS dhash FROM b
""",
    "after_dedup_counts": f"WITH RECURSIVE {_IMAGES}, {_exact(False)}, e AS (SELECT * FROM i WHERE k = 1), {_near('e')} SELECT subset, count(*) AS n FROM near WHERE k = 1 GROUP BY subset",
    "main_class": f"""
WITH p AS (SELECT l_orderkey, l_suppkey % {CLASSES} AS cls, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS place FROM lineitem),
n AS (SELECT l_orderkey, cls, count(*) AS n, min(place) AS early FROM p GROUP BY l_orderkey, cls),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, early) AS k FROM n)
SELECT o_orderkey, coalesce(cls, -1) AS cls FROM orders LEFT JOIN k ON o_orderkey = l_orderkey AND k = 1
""",
    "class_quota": f"WITH c AS ({_DOC_CLASS}), counts AS (SELECT subset, cls, count(*) AS n FROM c GROUP BY subset, cls), {_quota('counts', TARGETS)} SELECT * FROM quota",
    "quota_repair": f"WITH counts AS (SELECT l_linestatus AS subset, l_suppkey % {CLASSES} AS cls, count(*) AS n FROM lineitem GROUP BY 1, 2), {_quota('counts', ITEM_TARGETS)} SELECT * FROM quota",
    "stratified_sample": f"WITH c AS ({_DOC_CLASS}), counts AS (SELECT subset, cls, count(*) AS n FROM c GROUP BY subset, cls), {_quota('counts', TARGETS)}, s AS ({_drawn('c')}) SELECT doc_id, subset, cls FROM s WHERE k <= quota",
    "cleanup_plan": f"{_PLAN} SELECT * FROM gone",
    "plan_summary": f"""{_PLAN},
names AS (SELECT unnest(['train', 'valid']) AS subset),
a AS (SELECT subset, count(*) AS initial FROM img GROUP BY subset),
g AS (SELECT subset, count(*) FILTER (WHERE reason = 'exact') AS exact, count(*) FILTER (WHERE reason = 'near') AS near, count(*) FILTER (WHERE reason = 'downsample') AS sampled FROM gone GROUP BY subset),
j AS (SELECT subset, coalesce(initial, 0) AS initial, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(sampled, 0) AS sampled FROM names LEFT JOIN a USING (subset) LEFT JOIN g USING (subset))
SELECT *, initial - exact - near AS after_dedup, initial - exact - near - sampled AS final FROM j
""",
    "yolo_lines": f"WITH {_BOX} SELECT l_orderkey, count(*) FILTER (WHERE ok) AS n, coalesce(string_agg(line, chr(10) ORDER BY line) FILTER (WHERE ok), '') AS file FROM box GROUP BY l_orderkey",
    "yolo_text_parse": f"WITH {_BOX} SELECT l_orderkey, l_linenumber, {_FREE} AS lines FROM txt",
    "boxes_json": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (3, 5, 6, 7) THEN 0 ELSE 1 END AS n, CASE WHEN l_linenumber NOT IN (3, 5, 6, 7) THEN CAST(l_suppkey % 14 AS VARCHAR) END AS class_id,
  CASE WHEN l_linenumber NOT IN (3, 5, 6, 7) THEN CAST(l_discount AS VARCHAR) END AS cx, CASE WHEN l_linenumber NOT IN (3, 5, 6, 7) THEN CAST(l_tax AS VARCHAR) END AS cy FROM lineitem
""",
    "prompt_text": f"""
WITH t AS (SELECT DISTINCT p_brand, p_type FROM part), s AS (SELECT p_brand, max(p_size) AS w, min(p_size) AS h FROM part GROUP BY p_brand),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS i FROM t),
c AS (SELECT p_brand, string_agg(i || ' ' || p_type || CASE WHEN length(p_type) % 2 = 0 THEN ' (made of ' || p_type || ')' ELSE '' END, ', ' ORDER BY i) AS c FROM n GROUP BY p_brand)
SELECT p_brand, {_quoted(prompts.TASK)} || c || {_quoted(prompts.RULES)} || CASE WHEN p_brand LIKE '%1' THEN '' ELSE {_quoted(prompts.NOTES)} || 'Mind the shade.' END
  || {_quoted(prompts.SIZE)} || w * 10 || ' height=' || h * 10 || {_quoted(prompts.SCHEMA)} AS prompt FROM c JOIN s USING (p_brand)
""",
    "fallback_policy": f"WITH {_BOX} SELECT l_orderkey, l_linenumber, NOT ok AS used_fallback, CASE WHEN ok THEN line ELSE {_FREE} END AS lines FROM txt",
    "label_collisions": "SELECT '/out/' || doc_id % 333 || '.txt' AS label_path, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "backup_paths": f"SELECT '/ds/' || {_SPLIT} || '/images/' || doc_id || '.jpg' AS image, '/backup/' || {_SPLIT} || '/images/' || doc_id || '.jpg' AS target FROM documents",
    "frame_names": "WITH f AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no FROM events) SELECT *, printf('frame_%05d.jpg', frame_no) AS name FROM f",
    "pending_labels": f"SELECT '/ds/' || {_SPLIT} || '/images/' || doc_id || '.jpg' AS image, '/ds/' || {_SPLIT} || '/labels/' || doc_id || '.txt' AS label_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
for _name, _across in (("", False), ("_global", True)):
    SQL |= {
        f"exact_groups{_name}": f"WITH {_IMAGES}, {_exact(_across)} SELECT scope, sha256, n, keep FROM i WHERE n > 1 AND k = 1",
        f"exact_removed{_name}": f"WITH {_IMAGES}, {_exact(_across)} SELECT subset, image, keep FROM i WHERE k > 1",
        f"near_pairs{_name}": f"WITH RECURSIVE {_IMAGES}, {_exact(_across)}, {_near('i')} SELECT scope, {_hex('a')} AS a, {_hex('b')} AS b, {_DISTANCE.format('a', 'b')} AS distance FROM pr WHERE a < b",
        f"near_clusters{_name}": f"WITH RECURSIVE {_IMAGES}, {_exact(_across)}, {_near('i')} SELECT scope, image, {_hex('cluster')} AS cluster, size, k = 1 AS stays FROM near WHERE size > 1",
        f"dedup_removed{_name}": f"""WITH RECURSIVE {_IMAGES}, {_exact(_across)}, e AS (SELECT * FROM i WHERE k = 1), {_near("e")}
SELECT subset, image, keep, 'exact' AS reason FROM i WHERE k > 1 UNION ALL SELECT subset, image, keep, 'near' FROM near WHERE k > 1""",
    }
