"""File trees, images, videos, configuration, annotation and the commands, on trees built in a temporary folder."""

import json
import os
import random
import struct
import sys
import zlib

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewell.operators import annotate
from tidewell.plans import cleanup, cli
from tidewell.sources import config, files, images, video


def png(rows):
    """A grey PNG of 8 bits."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw = b"".join(b"\0" + bytes(r) for r in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def bmp(rows):
    """A grey BMP of 24 bits."""
    w, h = len(rows[0]), len(rows)
    body = b"".join(b"".join(bytes([v, v, v]) for v in r) + b"\0" * (-3 * w % 4) for r in rows[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


cloudpickle.register_pickle_by_value(sys.modules[__name__])
DOWN = [list(range(90, 0, -10))] * 8
TOP = [list(range(90, 0, -10))] + [[5] * 9] * 7


def put(path, data=b""):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


@pytest.fixture
def traps(tmp_path):
    home = f"{tmp_path}/train/images"
    for name in ("a.png", "F.JPG", "_b.png", ".c.png", ".hid/d.png", ".hid/sub/d2.png", "_und/e.png", "k=1/g.png", "sp ace.png", "x%20y.png", "[1].png", "z.png", "n.gif", ".jpg"):
        put(f"{home}/{name}", b"" if name == "z.png" else name.encode())
    put(f"{tmp_path}/elsewhere/s.png", b"s")
    os.symlink(f"{tmp_path}/elsewhere", f"{home}/link")
    put(f"{tmp_path}/flat/b.png", b"b")
    put(f"{tmp_path}/flat/backup_removed_1/old.png", b"o")
    return str(tmp_path)


def names(df, root):
    return {os.path.relpath(r.path, root) for r in df.select("path").collect()}


ALL = {f"train/images/{n}" for n in ("a.png", "F.JPG", "_b.png", ".c.png", ".hid/d.png", ".hid/sub/d2.png", "_und/e.png", "k=1/g.png", "sp ace.png", "x%20y.png", "[1].png", "z.png")}


def test_scan(spark, traps):
    assert names(files.read_tree(spark, traps, ["train", "missing"]), traps) == ALL
    assert names(files.read_tree(spark, traps, ["train", "flat"], "auto"), traps) == ALL - {"train/images/.hid/d.png"} | {"flat/b.png"}
    assert files.read_tree(spark, traps, ["missing"]).count() == 0
    r = files.read_tree(spark, traps, ["train"]).where(F.col("path").endswith("/z.png")).first()
    assert (r.length, bytes(r.content), r.sha256[:8]) == (0, b"", "e3b0c442")
    with pytest.raises(Exception, match="named twice"):
        files.read_tree(spark, traps, ["train", "train"]).count()


def test_metadata(spark):
    cut = png(DOWN)[:60]
    rows = [("a", png(DOWN), "1"), ("b", bmp(TOP), "2"), ("c", b"junk", "3"), ("d", None, None), ("e", b"\xff\xd8\xff rest", "4"), ("f", png([[9] * 30] * 20), "5"), ("g", cut, "6")]
    df = spark.createDataFrame([(p, None if d is None else bytearray(d), s) for p, d, s in rows], "path string, content binary, sha256 string")
    got = {r.path: (r.w, r.h, r.res, r.status) for r in images.with_metadata(df).collect()}
    assert got["a"] == (9, 8, 72, "ok") and got["b"] == (9, 8, 72, "ok") and got["f"] == (30, 20, 600, "ok")
    assert got["c"] == got["g"] == (0, 0, 0, "undecodable") and got["d"] == (0, 0, 0, "unreadable")
    h = {r.path: r.dhash & (1 << 64) - 1 for r in images.with_metadata(df).collect()}
    assert (h["a"], h["b"], h["c"], h["f"]) == ((1 << 64) - 1, 0xFF << 56, 0, 0)
    assert {r.path: r.dhash for r in images.with_metadata(df, "keep").collect()}["c"] != 0
    with pytest.raises(Exception, match="decode"):
        images.with_metadata(df, "error").collect()


def test_cleanup_moves_without_loss(spark, tmp_path):
    root, backup = f"{tmp_path}/ds", f"{tmp_path}/backup"
    for split in ("train", "valid"):
        for name, data in (("a.png", png(DOWN)), ("b.png", png(DOWN)), ("s/c.png", png(TOP))):
            put(f"{root}/{split}/images/{name}", data)
            put(f"{root}/{split}/labels/{name[:-4]}.txt", b"1 .5 .5 .1 .1")
    before = sorted(os.path.relpath(os.path.join(at, n), root) for at, _, ns in os.walk(root) for n in ns)
    p = cleanup.plan(cleanup.scan(spark, root, ["train", "valid"]).persist(), ["train", "valid"])
    assert {(r.subset, r.cls) for r in p.images.select("subset", "cls").distinct().collect()} == {("train", 1), ("valid", 1)}
    s = cleanup.write_plan(p, f"{tmp_path}/plan")
    assert s["exact_removed"] == 2 and s["near_removed"] == 0 and json.load(open(f"{tmp_path}/plan/summary.json")) == s
    gone = spark.read.schema("subset string, image string, label string").json(f"{tmp_path}/plan/removals")
    for _ in range(2):  # a second time changes nothing
        assert {(r.image_status, r.label_status) for r in cleanup.apply(gone, root, backup).collect()} == {("moved", "moved")}
    after = [os.path.relpath(os.path.join(at, n), top) for top in (root, backup) for at, _, ns in os.walk(top) for n in ns]
    assert sorted(after) == before
    assert os.path.isfile(f"{backup}/valid/images/b.png") and os.path.isfile(f"{backup}/train/labels/b.txt")


def test_moves_never_overwrite(tmp_path):
    put(f"{tmp_path}/a", b"new")
    put(f"{tmp_path}/b", b"old")
    assert cleanup.move(f"{tmp_path}/a", f"{tmp_path}/b") == "conflict" and open(f"{tmp_path}/a").read() == "new"
    assert cleanup.move(f"{tmp_path}/none", f"{tmp_path}/none2") == "missing"


def test_frames(spark, tmp_path):
    one, two = b"\xff\xd8\xff\xe0one\xff\xd9", b"\xff\xd8\xff\xe0two\xff\xd9"
    df = spark.createDataFrame([("v", bytearray(b"head" + one + b"gap" + two + b"\xff\xd8\xffcut")), ("w", None)], "path string, content binary")
    got = video.frames(df)
    assert [(r.path, r.frame_no, r.name, bytes(r.content)) for r in got.orderBy("frame_no").collect()] == [("v", 0, "frame_00000.jpg", one), ("v", 1, "frame_00001.jpg", two)]
    video.write_frames(got, f"{tmp_path}/out")
    assert sorted(os.listdir(f"{tmp_path}/out")) == ["frame_00000.jpg", "frame_00001.jpg"]
    with pytest.raises(ValueError, match="twice"):
        video.write_frames(got.unionByName(got.withColumn("path", F.lit("x"))), f"{tmp_path}/out")


class Fake:
    """Replies by what the image holds."""

    def ask(self, prompt, content, structured):
        data = bytes(content)
        if data == b"down":
            raise OSError("no connection")
        if structured:
            return '{"boxes":[{"class_id":0,"cx":0.5,"cy":0.5,"w":0.5,"h":0.5}]}' if data == b"good" else "?"
        return "7 .5 .5 .5 .5\n0 .5 .5 0 .5"


def test_annotation(spark, tmp_path):
    df = spark.createDataFrame([(k, bytearray(k.encode()), 4, 4) for k in ("good", "odd", "down")], "path string, content binary, w int, h int")
    got = {r.path: r for r in annotate.annotate(df, Fake, [{"name": "disc"}]).collect()}
    assert got["good"].lines == ["0 0.500000 0.500000 0.500000 0.500000"] and not got["good"].used_fallback
    assert got["odd"].n == 2 and got["odd"].used_fallback and got["down"].error == "OSError: no connection" and got["down"].lines == []
    assert {r.path: r.n for r in annotate.annotate(df, Fake, [{"name": "disc"}], strict_fallback=True).collect()}["odd"] == 0
    out = spark.createDataFrame([(f"{tmp_path}/l/a.txt", ["x", "y"], None), (f"{tmp_path}/l/b.txt", [], None), (f"{tmp_path}/l/c.txt", [], "bad")], "label_path string, lines array<string>, error string")
    annotate.write_labels(out)
    assert open(f"{tmp_path}/l/a.txt").read() == "x\ny" and open(f"{tmp_path}/l/b.txt").read() == "" and not os.path.exists(f"{tmp_path}/l/c.txt")
    with pytest.raises(ValueError, match="2 images"):
        annotate.write_labels(out.unionByName(out))
    assert annotate.pending(out, spark.createDataFrame([(f"{tmp_path}/l/a.txt",)], "path string")).count() == 2


def test_config(tmp_path):
    path = f"{tmp_path}/c.json"
    with pytest.raises(config.ConfigMissing):
        config.load_config(path)
    for bad in ("{", "[]", '{"classes":[]}'):
        put(path, bad.encode())
        with pytest.raises(config.ConfigInvalid):
            config.load_config(path)
    assert config.parse_classes(" a, ,b,") == ["a", "b"] and config.parse_classes(",") == [] and len(config.parse_classes("  ")) == 8
    answers = iter(["a,b", "maybe", "y", "about a", "", "y", "line 1", "line 2", ""])
    made = config.interview(lambda _: next(answers))
    assert made == {"classes": [{"name": "a", "description": "about a"}, {"name": "b"}], "prompt_notes": "line 1\nline 2\n"}
    config.save_config(made, path)
    assert config.load_config(path) == made
    assert config.make_config(["é"], notes=" ")["prompt_notes"] == config.DEFAULT_NOTES


def test_commands(spark, tmp_path, capsys):
    root, conf = f"{tmp_path}/ds", f"{tmp_path}/conf.json"
    put(f"{root}/train/images/a.png", png(DOWN))
    put(f"{root}/train/images/b.png", png(DOWN))
    assert cli.main(["cleanup", "--root", root, "--subsets", "train", "--output-json", f"{tmp_path}/plan"]) == 0
    assert '"exact_removed": 1' in capsys.readouterr().out and os.path.exists(f"{root}/train/images/b.png")
    assert cli.main(["cleanup", "--root", root, "--subsets", "train", "--apply", "--backup-dir", f"{tmp_path}/bk"]) == 0
    assert os.path.exists(f"{tmp_path}/bk/train/images/b.png") and not os.path.exists(f"{root}/train/images/b.png")
    annotate.register("fake", Fake)
    label = ["label", "--images", root, "--out-dir", f"{tmp_path}/labels", "--config", conf, "--provider"]
    assert cli.main([*label, "none"]) == 1 and cli.main([*label, "fake"]) == 3
    put(conf, b"{")
    assert cli.main([*label, "fake"]) == 4
    assert cli.main(["config", "--classes", "disc", "--out", conf]) == 0
    assert cli.main([*label, "fake"]) == 0
    assert open(f"{tmp_path}/labels/a.txt").read().startswith("7 0.500000")
    os.makedirs(f"{tmp_path}/empty")
    assert cli.main(["label", "--images", f"{tmp_path}/empty", "--config", conf, "--provider", "fake"]) == 2


def filtered(rows, kinds, bands):
    """A PNG whose rows are stored by the given filters; rows hold w x bands numbers."""
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    raw, up = b"", [0] * len(rows[0])
    for kind, r in zip(kinds, rows, strict=True):
        line = []
        for x, v in enumerate(r):
            a, b = (r[x - bands] if x >= bands else 0), up[x]
            c = up[x - bands] if x >= bands else 0
            near = min((a, b, c), key=lambda p: abs(a + b - c - p))  # noqa: B023
            line.append((v - (0, a, b, (a + b) // 2, near)[kind]) & 255)
        raw += bytes([kind]) + bytes(line)
        up = r
    head = struct.pack(">IIBBBBB", len(rows[0]) // bands, len(rows), 8, {1: 0, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 3, 4])
def test_png_filters(spark, bands):
    rng = random.Random(bands)
    rows = [[rng.randrange(256) for _ in range(11 * bands)] for _ in range(25)]
    want = images.png(filtered(rows, [0] * 25, bands))
    assert want.shape == (25, 11)
    assert (images.png(filtered(rows, [k % 5 for k in range(25)], bands)) == want).all()


def jvm_image(spark, kind, rows, path):
    """Grey rows written by the JVM."""
    jvm = spark._jvm
    im = jvm.java.awt.image.BufferedImage(len(rows[0]), len(rows), 5)
    for y, r in enumerate(rows):
        for x, v in enumerate(r):
            im.setRGB(x, y, (v << 16 | v << 8 | v) - (1 << 24))
    os.makedirs(os.path.dirname(path), exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(im, kind, jvm.java.io.File(path))


def test_images_that_only_the_jvm_reads(spark, tmp_path):
    root = f"{tmp_path}/ds"
    for name, kind in (("a.jpg", "jpg"), ("b.JPEG", "jpg"), ("_c.tif", "tiff"), ("d.png", "png")):
        jvm_image(spark, kind, [list(range(200, 20, -10))] * 16, f"{root}/train/images/{name}")
    whole = open(f"{root}/train/images/a.jpg", "rb").read()
    put(f"{root}/train/images/cut.jpg", whole[:200])
    put(f"{root}/train/images/e.webp", b"RIFF\x1a\0\0\0WEBPVP8L\x0d\0\0\0\x2f" + (17 | 15 << 14).to_bytes(4, "little"))
    got = {os.path.basename(r.image): r for r in cleanup.scan(spark, root, ["train"]).collect()}
    assert len(got) == 6
    for name in ("a.jpg", "b.JPEG", "_c.tif", "d.png"):
        assert (got[name].w, got[name].h, got[name].status) == (18, 16, "ok") and got[name].dhash == -1, name
    assert (got["cut.jpg"].w, got["cut.jpg"].dhash, got["cut.jpg"].status) == (0, 0, "undecodable")
    assert got["e.webp"].status == "unsupported" and got["e.webp"].dhash != 0
    for n in ("a.jpg", "_c.tif", "d.png", "e.webp", "cut.jpg"):
        assert images.header_size(open(f"{root}/train/images/{n}", "rb").read()) == ((18, 16)), n
    rows = [(n, bytearray(open(f"{root}/train/images/{n}", "rb").read()), got[n].sha256) for n in ("a.jpg", "b.JPEG")]
    df = spark.createDataFrame(rows, "path string, content binary, sha256 string")
    assert {(r.w, r.dhash) for r in images.with_metadata(df).collect()} == {(18, -1)}
    sized = images.with_size(spark.createDataFrame([(bytearray(b"junk"),), (None,), (bytearray(bmp(TOP)),)], "content binary"))
    assert [(r.w, r.h) for r in sized.collect()] == [(0, 0), (0, 0), (9, 8)]


def test_plans_are_written_in_order(spark, tmp_path):
    names = ["subset", "image", "label", "sha256", "dhash", "res", "cls", "key"]
    rows = [(s, f"{s}/{i:03}", None, "same", 0, 1, 0, f"{s}{i}") for i in range(40) for s in ("train", "valid")]
    p = cleanup.plan(spark.createDataFrame(rows[::-1], "subset string, image string, label string, sha256 string, dhash long, res long, cls long, key string").select(*names), ["valid", "train"])
    cleanup.write_plan(p, str(tmp_path))
    lines = [json.loads(x) for f in sorted(os.listdir(f"{tmp_path}/removals/reason=exact")) if f.endswith(".json") for x in open(f"{tmp_path}/removals/reason=exact/{f}")]
    assert [x["image"] for x in lines] == [f"{s}/{i:03}" for s in ("valid", "train") for i in range(1, 40)]


def test_videos_that_nothing_reads(spark, tmp_path):
    put(f"{tmp_path}/a.mp4", b"\0\0\0\x18ftypmp42")
    assert video.frames(files.read_tree(spark, f"{tmp_path}/a.mp4", layout="plain", suffixes=(".mp4",))).count() == 0
    with pytest.raises(Exception, match="can't read"):
        cli.main(["frames", "--video", f"{tmp_path}/a.mp4", "--out", f"{tmp_path}/out"])
    assert cli.main(["frames", "--video", f"{tmp_path}/none.mp4", "--out", f"{tmp_path}/out"]) == 2
    put(f"{tmp_path}/b.avi", b"head" + b"\xff\xd8\xff\xe0one\xff\xd9" * 3)
    assert cli.main(["frames", "--video", f"{tmp_path}/b.avi", "--out", f"{tmp_path}/out"]) == 0
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"frame_{i:05}.jpg" for i in range(3)]


class Named(Fake):
    def __init__(self, model="own"):
        assert model in ("own", "big")


def test_label_command_options(spark, tmp_path, monkeypatch):
    put(f"{tmp_path}/in/a.png", png(DOWN))
    put(f"{tmp_path}/in/bad.png", b"junk")
    annotate.register("named", Named, secret="TIDEWELL_TEST_KEY")
    assert cli.main(["config", "--classes", "disc", "--out", f"{tmp_path}/c.json"]) == 0
    label = ["label", "--images", f"{tmp_path}/in", "--out-dir", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json", "--provider", "named", "--model", "big", "--save-raw", f"{tmp_path}/raw"]
    monkeypatch.delenv("TIDEWELL_TEST_KEY", raising=False)
    assert cli.main(label) == 1
    monkeypatch.setenv("TIDEWELL_TEST_KEY", "x")
    assert cli.main(label) == 0
    assert os.listdir(f"{tmp_path}/out") == ["a.txt"]
    assert {os.path.basename(r.path): r.raw for r in spark.read.json(f"{tmp_path}/raw").collect()}["a.png"] == "?"


def test_scratch_tables_go(spark):
    from tidewell.sources import scratch

    df = scratch.settle(spark.range(5))
    at = scratch.run_dir(spark).removeprefix("file://")
    assert df.count() == 5 and os.listdir(at)
    scratch.release(spark)
    assert not os.path.exists(at)
