"""Deduplication and sampling: the golden cases, and properties against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.operators import dedup, sampling
from tidewell.plans import cleanup

SCHEMA = "subset string, image string, label string, sha256 string, dhash long, res long, cls long, key string"


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def table(spark, rows):
    return spark.createDataFrame([(s, i, None, sha, None if h is None else signed(h), r, c, i) for s, i, sha, h, r, c in rows], SCHEMA)


def test_clusters_are_transitive_and_stay_in_a_prefix(spark):
    hs = {"a": 0, "b": 0x1F, "c": 0x3FF, "d": 0x0010000000000000, "e": 0x3F000}
    t = table(spark, [("train", k, k, h, 1, 0) for k, h in hs.items()])
    got = {r.image: r.keep for r in dedup.near_members(t).collect()}
    assert got == {"a": "a", "b": "a", "c": "a"}


@pytest.mark.parametrize(
    ("rows", "keep"),
    [([("train", "a.jpg", 900), ("valid", "z.jpg", 100), ("valid", "b.jpg", 50)], "z.jpg"), ([("train", "a.jpg", 9), ("train", "b.jpg", 90)], "b.jpg"), ([("train", "b.jpg", 9), ("train", "a.jpg", 9)], "a.jpg")],
)
def test_what_stays(spark, rows, keep):
    t = table(spark, [(s, i, "x", 7, r, 0) for s, i, r in rows])
    assert [r.keep for r in dedup.exact_groups(t, across=True).collect()] == [keep]


@pytest.mark.parametrize(("across", "removed", "groups"), [(False, {"2", "4"}, 2), (True, {"1", "2", "4"}, 1)])
def test_scopes(spark, across, removed, groups):
    t = table(spark, [("train", "1", "x", 0, 5, 0), ("train", "2", "x", 0, 5, 0), ("valid", "3", "x", 0, 5, 0), ("valid", "4", "x", 0, 5, 0)])
    exact, near, rest = dedup.deduplicate(t, across=across)
    assert {r.image for r in exact.collect()} == removed
    assert near.count() == 0 and rest.count() == 4 - len(removed) and dedup.exact_groups(t, across).count() == groups


def test_nulls_never_group_exactly_but_share_hash_zero(spark):
    t = table(spark, [("train", "1", None, None, 5, 0), ("train", "2", None, None, 5, 0), ("train", "3", "y", 1 << 60, None, 0)])
    exact, near, _ = dedup.deduplicate(t)
    assert exact.count() == 0 and [r.image for r in near.collect()] == ["2"]
    assert dedup.deduplicate(t.limit(0))[2].count() == 0


@pytest.mark.parametrize("threshold", [0, 5, 64])
def test_pairs_against_brute_force(spark, threshold):
    rng = random.Random(threshold)
    hs = set()
    for _ in range(12):
        h = rng.getrandbits(64)
        for _ in range(8):
            hs.add(h ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    d = spark.createDataFrame([("*", signed(h)) for h in hs], "scope string, dhash long")
    got = {tuple(sorted((r.a, r.b))) for r in dedup.near_pairs(d, threshold).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in hs for b in hs if a < b and a >> 52 == b >> 52 and bin(a ^ b).count("1") <= threshold}
    assert got == want


def test_crowded_prefixes_are_settled_together(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["train", "valid"]), f"i{k}", f"h{k}", rng.choice([0, 1 << 60]) | sum(1 << b for b in rng.sample(range(16), rng.randint(0, 4))), 1, 0) for k in range(150)]
    t = table(spark, rows)
    for across in (False, True):
        want, got = (sorted(map(str, dedup.clusters(t, across=across, alone=n).collect())) for n in (10**6, 3))
        assert want == got and len(want) > 10


def test_threshold_is_checked(spark):
    d = spark.createDataFrame([("*", 1)], "scope string, dhash long")
    with pytest.raises(ValueError):
        dedup.near_pairs(d, -1)


def test_ties_go_to_the_first_class(spark):
    r = spark.createDataFrame([(1, 3, 0), (1, 1, 1), (1, 1, 2), (1, 3, 3), (2, None, 0)], "k int, c int, p int")
    assert [tuple(x) for x in sampling.main_class(r, "k", "c", "p").collect()] == [(1, 3)]


@pytest.mark.parametrize(
    ("sizes", "target", "want"),
    [([6, 3, 1], 5, [3, 2, 0]), ([5, 5, 5], 10, [4, 3, 3]), ([1, 1, 1], 2, [0, 1, 1]), ([4, 4], 8, [4, 4]), ([4, 4], 0, [0, 0]), ([4, 4], None, [4, 4])],
)
def test_quotas(spark, sizes, target, want):
    c = spark.createDataFrame([("train", i, n) for i, n in enumerate(sizes)], "subset string, cls long, n long")
    assert [r.quota for r in sampling.quotas(c, {"train": target}).orderBy("cls").collect()] == want


def test_quotas_add_up(spark):
    rng = random.Random(3)
    sizes = {f"s{k}": [rng.randint(1, 40) for _ in range(rng.randint(1, 9))] for k in range(30)}
    targets = {s: rng.randint(0, sum(n)) for s, n in sizes.items()}
    c = spark.createDataFrame([(s, i, n) for s, ns in sizes.items() for i, n in enumerate(ns)], "subset string, cls long, n long")
    got = sampling.quotas(c, targets).collect()
    total = Counter()
    for r in got:
        assert 0 <= r.quota <= r.n
        total[r.subset] += r.quota
    assert all(total[s] == t for s, t in targets.items())


def test_negative_targets_are_refused(spark):
    c = spark.createDataFrame([("train", 0, 1)], "subset string, cls long, n long")
    with pytest.raises(ValueError):
        sampling.quotas(c, {"train": -5})


def test_plan_partitions_the_images(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["train", "valid"]), f"i{k}", f"h{rng.randint(0, 150)}", rng.getrandbits(64) if k % 3 else 0, rng.randint(1, 9), rng.randint(-1, 3)) for k in range(200)]
    p = cleanup.plan(table(spark, rows), ["train", "valid", "test"], {"train": 20, "valid": 5})
    gone = [r.image for r in p.removals().collect()]
    assert len(gone) == len(set(gone))
    c = {r.subset: r for r in p.counts().collect()}
    assert (c["train"].final, c["valid"].final, c["test"].initial, c["test"].final) == (20, 5, 0, 0)
    assert len(rows) - len(gone) == 25
    s = p.summary()
    assert s["targets"] == {"train": 20, "valid": 5} and s["sampling_details"]["train"]["kept"] == 20
    again = cleanup.plan(table(spark, rows[::-1]), ["train", "valid", "test"], {"train": 20, "valid": 5})
    assert sorted(r.image for r in again.removals().collect()) == sorted(gone)
    with pytest.raises(ValueError):
        cleanup.plan(table(spark, rows), ["train", "train"])


def test_extra_columns_do_not_clash(spark):
    t = table(spark, [("train", "1", "x", 0, 5, 0), ("train", "2", "x", 0, 5, 0)]).withColumns({"n": F.lit(1), "best": F.lit(2), "p": F.lit(3), "a": F.lit(4)})
    exact, near, rest = dedup.deduplicate(t)
    assert (exact.count(), near.count(), rest.count()) == (1, 0, 1)


def test_null_strata_are_sampled_like_others(spark):
    rows = [("train", None, "a"), ("train", None, "b"), ("train", 1, "c"), (None, 2, "d"), (None, None, "e"), ("train", 1, None), ("train", 1, "c")]
    t = spark.createDataFrame(rows, "subset string, cls long, k string").withColumns({n: F.lit("x") for n in ("before", "rank", "draw", "bin", "quota", "here", "n")})
    counts = t.groupBy("subset", "cls").agg(F.count(F.lit(1)).alias("n"))
    for targets, kept in (({}, 7), ({"train": 3}, 5), ({"train": 0}, 2)):
        got = sampling.sample(t, sampling.quotas(counts, targets), "k")
        assert got.columns == [*t.columns, "kept"]
        assert got.count() == len(rows) and got.where("kept").count() == kept and got.where("kept and subset is null").count() == 2
    assert sampling.sample(t.limit(0), sampling.quotas(counts, {}), "k").count() == 0
