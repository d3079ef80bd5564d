"""Chat formatting by columnar byte assembly: headers and contents are scattered into one preallocated buffer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, load, texts, tune

OPEN, BREAK, CLOSE = b"<|im_start|>", b"\n", b"<|im_end|>\n"
#: The role whose contents are trained on; what stands in for a null role.
LEARNT, NOBODY = "assistant", "unknown"


def body(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and their lengths."""
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, np.diff(off)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with every message in its frame, where each message ends, and where its content begins and ends."""
    names, name_len = body(role)
    content, content_len = body(text)
    n = len(role)
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(OPEN), name_len, len(BREAK), content_len, len(CLOSE)
    stops = np.cumsum(sizes.ravel()).reshape(n, 5)
    starts = stops - sizes
    out = np.empty(int(stops[-1, -1]) if n else 0, np.uint8)
    for k, fixed in ((0, OPEN), (2, BREAK), (4, CLOSE)):
        out[starts[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for k, data, size in ((1, names, name_len), (3, content, content_len)):
        source = np.cumsum(size) - size
        out[np.repeat(starts[:, k] - source, size) + np.arange(len(data))] = data
    return out, stops[:, 4], np.stack([starts[:, 3], stops[:, 3]], axis=1)


def chats(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, n_turns, n_bytes, text, loss_spans) for every conversation.

    Messages stand in the order of turn, then role, then text, nulls first; each is <|im_start|>role, a line break, the
    content and <|im_end|> with a line break. loss_spans lists the byte ranges of the assistant's contents as start-end,
    with commas. A null role reads unknown, a null text is empty, "<|im_" inside a role or content becomes "< |im_".
    Repeated rows stay; rows with a null id form one conversation with a null id; other columns are ignored; an empty table
    gives none. Ids and turns are whole numbers or texts of such; any other is an error.
    """
    tune(messages.sparkSession)
    slim = messages.select(
        col(id_col).cast("long").alias("id"), col(turn_col).cast("long").alias("turn"),
        col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"),
    )
    ordered = slim.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    out = pa.schema([("id", pa.int64()), ("n_turns", pa.int64()), ("n_bytes", pa.int64()), ("text", pa.large_string()), ("loss_spans", pa.large_string())])

    def form(b: pa.Table) -> pa.RecordBatch:
        b = b.combine_chunks().to_batches()[0]
        ids = b.column(0)
        clean = [pc.replace_substring(pc.fill_null(texts(b, c), x), "<|im_", "< |im_") for c, x in (("role", NOBODY), ("text", ""))]
        buffer, stops, content = assemble(*[pa.concat_arrays([c]) for c in clean])
        key, none = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
        new = np.ones(len(ids), bool)
        new[1:] = (key[1:] != key[:-1]) | (none[1:] != none[:-1])
        first = np.flatnonzero(new)
        ends = np.append(first[1:], len(ids))
        off = np.concatenate([[0], stops[ends - 1]])
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(buffer))
        learnt = np.asarray(pc.equal(pc.fill_null(b.column(1), NOBODY), LEARNT))
        group = np.cumsum(new) - 1
        spans: list[list[str]] = [[] for _ in first]
        base = off[:-1][group]
        for g, s, e in zip(group[learnt], (content[:, 0] - base)[learnt], (content[:, 1] - base)[learnt], strict=True):
            spans[g].append(f"{s}-{e}")
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(first)), pa.array(ends - first, pa.int64()), pa.array(np.diff(off), pa.int64()), text, pa.array([",".join(s) for s in spans], pa.large_string())],
            schema=out,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last conversation, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            last = ids[-1].as_py()
            same = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            cut = b.num_rows - int(pc.sum(same).as_py())
            if cut or (held and held[-1].column(0)[-1].as_py() != last):
                done = [*held, b.slice(0, cut)]
                held = []
                yield form(pa.Table.from_batches(done))
            held.append(b.slice(cut))
        if held:
            yield form(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "id long, n_turns long, n_bytes long, text string, loss_spans string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one training text."""
    return chats(load(spark, sf_dir, "conversations")).select("conv_id", "n_turns", "n_bytes", F.col("text").alias("chat"), "loss_spans")


SQL = """
WITH m AS (
  SELECT conv_id, turn, role, text, replace(coalesce(role, 'unknown'), '<|im_', '< |im_') AS r, replace(coalesce(text, ''), '<|im_', '< |im_') AS t
  FROM conversations),
p AS (SELECT *, strlen(r) + 13 AS head, strlen(t) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM m),
q AS (SELECT *, sum(head + body + 11) OVER (PARTITION BY conv_id ORDER BY k) - body - 11 AS s FROM p)
SELECT conv_id, count(*) AS n_turns, CAST(sum(head + body + 11) AS BIGINT) AS n_bytes,
  string_agg('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10), '' ORDER BY k) AS chat,
  coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(s + body AS BIGINT), ',' ORDER BY k) FILTER (WHERE coalesce(role, '') = 'assistant'), '') AS loss_spans
FROM q GROUP BY conv_id
"""
