"""Scalar functions: the golden cases of FIXTURES.md."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import boxes, hashing, paths, prompts


def column(spark, value, *exprs):
    return spark.createDataFrame([(value,)], "x string").select(*exprs).first()


@pytest.mark.parametrize(
    ("path", "image", "label"),
    [
        ("/d/train/images/a.jpg", True, "/d/train/labels/a.txt"),
        ("/d/train/images/s/b.JPEG", True, "/d/train/labels/s/b.txt"),
        ("/d/train/images/x.tar.png", True, "/d/train/labels/x.tar.txt"),
        ("/d/train/pics/a.jpg", True, ""),
        (".jpg", False, ""),
        ("a.gif", False, ""),
        (None, None, None),
    ],
)
def test_paths(spark, path, image, label):
    r = column(spark, path, paths.is_image(F.col("x")), paths.label_path(F.col("x")))
    assert r[0] == image
    assert path is None or r[1] == label


def test_label_path_below_a_root(spark):
    r = column(spark, "/images/d/train/images/a.jpg", paths.label_path(F.col("x"), F.lit("/images/d/train")))
    assert r[0] == "/images/d/train/labels/a.txt"


@pytest.mark.parametrize(
    ("path", "split", "want"),
    [("/r/train/images/a.jpg", "train", "/B/train/images/a.jpg"), ("/r/valid/images/a.jpg", "valid", "/B/valid/images/a.jpg"), ("/r/train/images/s/a.jpg", "train", "/B/train/images/s/a.jpg"), ("/r/train/a.jpg", "train", "/B/train/a.jpg")],
)
def test_backup_mirrors_the_split(spark, path, split, want):
    assert column(spark, path, paths.backup_path(F.col("x"), F.lit(f"/r/{split}"), F.lit("/B"), F.lit(split)))[0] == want


UP, DOWN, FLAT = list(range(9)), list(range(9, 0, -1)), [5] * 9


@pytest.mark.parametrize(
    ("rows", "want", "prefix"),
    [([FLAT] * 8, "0" * 16, 0), ([UP] * 8, "0" * 16, 0), ([DOWN] * 8, "f" * 16, 4095), ([DOWN] + [FLAT] * 7, "ff" + "0" * 14, 4080), ([FLAT] * 7 + [DOWN], "0" * 14 + "ff", 0)],
)
def test_difference_hash(spark, rows, want, prefix):
    df = spark.createDataFrame([([c for r in rows for c in r],)], "g array<int>").select(hashing.difference_bits(F.col("g")).alias("h"))
    assert tuple(df.select(hashing.hex16(F.col("h")), hashing.prefix(F.col("h"))).first()) == (want, prefix)


def test_row_bits_and_hamming(spark):
    df = spark.createDataFrame([(list(range(65, 0, -1)), [1.0, 0.0] * 32)], "a array<int>, b array<double>")
    r = df.select(hashing.hex16(hashing.row_bits(F.col("a"))), hashing.hex16(hashing.row_bits(F.col("b"), wrap=True)), hashing.hamming(hashing.row_bits(F.col("a")), F.lit(0).cast("long"))).first()
    assert tuple(r) == ("f" * 16, "a" * 16, 64)


@pytest.mark.parametrize(
    ("lines", "want"),
    [(["3 .", "1 .", "1 .", "3 ."], 3), (["2.9 .", "0 .", "2 ."], 2), (["-0.5 ."], 0), (["1e1 ."], 10), (["nan .", "inf .", "foo .", "1d ."], -1), (["7"], 7), (["", "  "], -1), ([], -1), (None, -1)],
)
def test_main_class_of_a_file(spark, lines, want):
    assert spark.createDataFrame([(lines,)], "l array<string>").select(boxes.main_class(F.col("l"))).first()[0] == want


@pytest.mark.parametrize(
    ("box", "want"),
    [
        ({"class_id": 0, "center_x": 0.5, "center_y": 0.5, "width": 0.2, "height": 0.1}, "0 0.500000 0.500000 0.200000 0.100000"),
        ({"class_id": 1, "cx": 1.7, "cy": -1, "w": 0.5, "h": 2}, "1 1.000000 0.000000 0.500000 1.000000"),
        ({"class_id": 3, "cx": 0.5, "cy": 0.5, "w": 0.5, "h": 0.5}, None),
        ({"class_id": -1, "cx": 0.5, "cy": 0.5, "w": 0.5, "h": 0.5}, None),
        ({"class_id": "2", "cx": "0.25", "cy": 0.5, "w": 0.5, "h": 0.5}, "2 0.250000 0.500000 0.500000 0.500000"),
        ({"class_id": 1.9, "cx": 0.5, "cy": 0.5, "w": 0.5, "h": 0.5}, "1 0.500000 0.500000 0.500000 0.500000"),
        ({"class_id": 0, "cx": 0.5, "cy": 0.5, "w": 0, "h": 0.5}, None),
        ({"class_id": 0, "cx": 0.5, "cy": 0.5, "w": 0.5, "h": -1}, None),
        ({"class_id": 0, "cx": None, "cy": 0.5, "w": 0.5, "h": 0.5}, None),
        ({"class_id": 0, "cy": 0.5, "w": 0.5, "h": 0.5}, None),
        ("box", None),
        ({"class_id": 0, "cx": float("nan"), "cy": 0.5, "w": 0.5, "h": 0.5}, "0 1.000000 0.500000 0.500000 0.500000"),
        ({"class_id": 0, "cx": 0.1234565, "cy": 0.5, "w": 0.5, "h": 0.5}, "0 0.123456 0.500000 0.500000 0.500000"),
    ],
)
def test_lenient_boxes(box, want):
    assert boxes.lenient_line(box, 3) == want


FREE = [
    ("99 0.5 .5 0 1.5", ["99 0.500000 0.500000 0.000000 1.000000"]),
    ("0 -0.1 0.5 0.2 0.2", []),
    ("0 1. 0.5 0.2 0.2", []),
    ("0 1e-1 0.5 0.2 0.2", []),
    ("0 0.5 0.5 0.2", []),
    ("0 0.5 0.5 0.2 0.2 x", []),
    ("Here are the boxes:\r\n1 .5 .5 .5 .5\n\n2 .25 .5 1 1", ["1 0.500000 0.500000 0.500000 0.500000", "2 0.250000 0.500000 1.000000 1.000000"]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), FREE)
def test_free_text(spark, text, want):
    assert boxes.free_lines(text) == want
    assert column(spark, text, boxes.text_lines(F.col("x")))[0] == want


@pytest.mark.parametrize("reply", ['{"boxes":5}', "[1]", "{}", "", "```json\n{}\n```", None])
def test_replies_without_boxes(spark, reply):
    assert boxes.reply_boxes(reply) == []
    assert column(spark, reply, boxes.parsed_boxes(F.col("x")))[0] == []


def test_prompt(spark):
    classes = [{"name": "Disc", "description": "flat and red"}, {"name": "Cone"}, {}]
    one = prompts.prompt_text(640, 480, classes, "Mind the shade.")
    assert "0 Disc (flat and red), 1 Cone, 2 class." in one and "width=640 height=480" in one and one.endswith("[0,1].")
    df = spark.createDataFrame([([("Disc", "flat and red"), ("Cone", None), (None, "")],)], "c array<struct<name:string,description:string>>")
    assert df.select(prompts.prompt(F.lit(640), F.lit(480), F.col("c"), F.lit("Mind the shade."))).first()[0] == one
    assert "Further notes" not in prompts.prompt_text(1, 1, classes)


def test_six_decimals(spark):
    assert [r[0] for r in spark.createDataFrame([(0.1234565,), (None,)], "x double").select(boxes.six("x")).collect()] == ["0.123456", None]


def test_columns_format_as_python_does(spark):
    """Ties, dyadic halves, tiny and odd values: the column's decimals against Python's."""
    rng = random.Random(6)
    xs = [rng.random() for _ in range(300)] + [(rng.randint(0, 10**6) + 0.5) / 1e6 for _ in range(3000)] + [i / 512 for i in range(513)]
    xs += [0.0, 1.0, 5e-7, 4.9999999e-7, 1e-300, 5e-324, 0.1234565, float("nan"), float("inf"), -float("inf"), 2.0, -1.0, None]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", boxes.decimals(boxes.clamp(F.col("x"))).alias("s")).collect()
    assert len(got) == len(xs)
    for r in got:
        assert r.s == (None if r.x is None else f"{max(0.0, min(1.0, r.x)):.6f}")


def test_typed_boxes_against_python(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, float("nan"), -0.5, 0.0, 1e-9, 0.0078125, 0.1234565, 0.5, 1.0, 7.25, rng.random()])
    made = [[None if rng.random() < 0.05 else (rng.choice([None, -1, 0, 1, 2, 3, 99]), value(), value(), value(), value()) for _ in range(6)] for _ in range(200)]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "i int, b array<struct<class_id:long,cx:double,cy:double,w:double,h:double>>")
    for classes in (3, None):
        got = {r.i: r.l for r in df.select("i", boxes.box_lines(F.col("b"), classes).alias("l")).collect()}
        for i, m in enumerate(made):
            want = [boxes.lenient_line(None if b is None else dict(zip(("class_id", "cx", "cy", "w", "h"), b, strict=True)), classes) for b in m]
            # a class below 0 is nobody's, with or without a list of classes
            assert got[i] == [x for x in want if x is not None], (classes, m)
    assert df.select(boxes.box_lines(F.lit(None).cast("array<struct<class_id:long,cx:double,cy:double,w:double,h:double>>"), 3).alias("l")).first().l is None


def test_free_text_against_python(spark):
    rng = random.Random(8)
    piece = lambda: rng.choice([" ", "\t", "  ", "\n", "\r\n", "0", "12", "0" * 3 + "9" * 45, ".5", "0.1234565", "1.", "-1", "1e3", "x", "0.0078125", ".99999951"])
    texts = ["".join(piece() for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [" ".join(["7", *(rng.choice(["0.5", ".1234565", "3.75", "0.9999995", "0"]) for _ in range(4))]) for _ in range(50)] + [f"{'7' * 60} .5 .5 .5 .5", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", boxes.text_lines(F.col("t")).alias("l")).collect():
        assert (r.l or []) == boxes.free_lines(texts[r.i]), texts[r.i]


REPLIES = [
    '{"boxes":[7,{"class_id":0,"cx":0.5,"cy":0.5,"w":0.5,"h":0.5}]}',
    '{"boxes":[{"class_id":"1","center_x":"0.25","cy":0.5,"w":0.5,"h":0.5},"{",null,[1],{"class_id":9,"cx":1,"cy":1,"w":1,"h":1}]}',
    '{"boxes":[{"class_id":1.9,"center_x":null,"cx":0.5,"cy":0.5,"w":0.5,"h":0.5},{"class_id":true,"cx":0.1234565,"cy":1,"w":1,"h":1}]}',
    '{"boxes":[]}',
    "[]",
    None,
    "{",
]


def test_replies_keep_the_good_boxes_of_a_mixed_list(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, r string")
    for r in df.select("i", boxes.parsed_boxes(F.col("r")).alias("b"), boxes.json_lines(F.col("r"), 3).alias("l")).collect():
        assert len(r.b) == sum(isinstance(x, dict) for x in boxes.reply_boxes(REPLIES[r.i]))
        assert list(r.l) == boxes.reply_lines(REPLIES[r.i], 3)
    assert boxes.reply_lines(REPLIES[0], 3) == ["0 0.500000 0.500000 0.500000 0.500000"]
