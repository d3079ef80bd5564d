"""Byte-level BPE over Arrow batches: ids with character offsets, and decoding through the reversed byte table."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import col, lean, load, slices, texts, tune

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text that are encoded at once; distinct pieces of text whose ids a worker remembers.
BATCH, REMEMBERED = 1_000_000, 200_000
#: Bytes that can't begin white space.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """The bytes of every id of a byte-level vocabulary, end to end in one buffer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_of_char()
        try:
            by_id = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        except (KeyError, TypeError, AttributeError) as e:
            raise ValueError(f"{path} has no byte-level vocabulary") from e
        if spec["model"].get("end_of_word_suffix") or spec["model"].get("continuing_subword_prefix") or (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not purely byte-level: it marks words besides")
        # the rule that cuts() knows; texts go whole through any other
        self.known_rule = spec.get("normalizer") is None and spec.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        by_id |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.tokens = [by_id.get(i, b"\xef\xbf\xbd") for i in range(max(by_id) + 1)]
        self.tokens.append(b"\xef\xbf\xbd")  # for any id that the vocabulary lacks
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)

    def known(self, ids: np.ndarray) -> np.ndarray:
        last = len(self.tokens) - 1
        return np.where((ids < 0) | (ids >= last), last, ids)

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All the ids' bytes in one array, and each id's length."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.buffer[np.repeat(self.start[ids] - (ends - n), n) + np.arange(total)], n


_loaded: dict[str, object] = {}


def loaded(path: str, what: str):
    """The tokenizer or the byte table of a file, once for each worker."""
    if (path, what) not in _loaded:
        if what == "table":
            _loaded[path, what] = Table(path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _loaded[path, what] = t
    return _loaded[path, what]


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where bytes of text can be cut with no token across: True at a piece's first byte.

    That is before a space that a visible character follows, around a line break between visible characters, and before
    . or , after a letter. The rule that splits text before the merges ends a match at each of these, and begins one.
    """
    out = np.zeros(len(raw), bool)
    if len(raw) < 3:
        return out
    solid, letter = SOLID[raw], LETTER[raw]
    out[1:-1] = (raw[1:-1] == 32) & solid[2:]
    line = (raw[1:-1] == 10) & solid[2:] & (solid[:-2] & (raw[:-2] < 128))
    out[1:-1] |= line
    out[2:] |= line
    out[1:] |= ((raw[1:] == 46) | (raw[1:] == 44)) & letter[:-1]
    return out


class Encoder:
    """Encodes pieces of text; each distinct piece goes through the tokenizer once for as long as it is remembered."""

    def __init__(self, path: str):
        self.tok, self.table, self.known = loaded(path, "tokenizer"), loaded(path, "table"), {}

    def of(self, names: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = [w for w in names if w not in self.known]
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, np.int32)
        return [self.known[w] for w in names]

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, how many each text has, the texts' bytes and where each text begins in them."""
        off = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
        raw = np.frombuffer(values.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        first = cuts(raw) if self.table.known_rule else np.zeros(len(raw), bool)
        first[off[:-1][off[:-1] < len(raw)]] = True
        start = np.flatnonzero(first)
        ends = np.append(start, len(raw)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw)))
        d = parts.dictionary_encode()
        code = np.asarray(d.indices)
        own = self.of(d.dictionary.to_pylist())
        size = np.array([len(x) for x in own], np.int64)
        store = np.concatenate(own) if own else np.zeros(0, np.int32)
        per = size[code]
        end = np.cumsum(per)
        ids = store[np.repeat((np.cumsum(size) - size)[code] - (end - per), per) + np.arange(int(end[-1]) if len(end) else 0)]
        owner = np.searchsorted(off, start, side="right") - 1
        return ids, np.bincount(owner, weights=per, minlength=len(values)).astype(np.int64), raw, off


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens, ids, starts, ends, round_trip) for every row.

    starts and ends are character offsets: a token covers each character of which it holds a byte, so the tokens of a
    split character cover it all. round_trip says that what decode does with the ids gives the text back whole, with nothing
    left at either end. A null text has null
    everywhere, an empty one no tokens; strings of special tokens in a text are ordinary text. Texts of any length are
    encoded whole, repeated rows and null ids give rows of their own, other columns are ignored. Ids are whole numbers or
    texts of such; any other is an error, and so is a tokenizer without a byte-level vocabulary. Each row is judged alone.
    """
    tune(docs.sparkSession)
    slim = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    whole = pa.list_(pa.int32())
    out = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", whole), ("starts", whole), ("ends", whole), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        encoder = Encoder(tokenizer)
        table = encoder.table
        for b in slices(batches, "text", BATCH):
            t = texts(b, "text")
            null = np.asarray(t.is_null())
            ids, n, raw, doc_at = encoder.encode(t.fill_null(""))
            doc_at = doc_at[:-1]
            off = np.concatenate([[0], np.cumsum(n)])
            data, size = table.bytes_of(ids)
            ends = np.cumsum(size)
            doc_end = np.concatenate([[0], ends])[off]
            # which character each byte belongs to, counted from the batch's first
            char = np.cumsum((raw & 0xC0) != 0x80) if len(raw) == len(data) else np.zeros(len(data), np.int64)
            base = np.repeat(np.concatenate([[0], char])[doc_end[:-1]] if len(data) else np.zeros(len(n), np.int64), n)
            first = (char[ends - size] - 1 - base).astype(np.int32) if len(ids) else ids
            last = (char[ends - 1] - base).astype(np.int32) if len(ids) else ids
            begin = np.concatenate([doc_at, [len(raw)]])[: len(n) + 1]
            if np.array_equal(doc_end, begin) and whole_characters(data.tobytes()) == (b"", raw.tobytes().decode(), b""):
                same = [True] * len(n)  # each text's bytes are as many as they were, and all together decode to the same
            else:
                same = [decoded(table, ids[i:j]) == (b"", x or "", b"") for i, j, x in zip(off[:-1], off[1:], t.to_pylist(), strict=True)]
            mask = pa.array(null)
            lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x, pa.int32()), mask=mask) for x in (ids, first, last)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64(), mask=null), *lists, pa.array(same, mask=null)], schema=out)

    return slim.mapInArrow(run, "id long, n_tokens long, ids array<int>, starts array<int>, ends array<int>, round_trip boolean").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, text, head, tail) for every row of ids, the bytes taken from the reversed byte table.

    Characters split at either end of a slice of tokens are kept apart: head and tail are the bytes before the first
    and after the last whole character, so that neighbouring slices can be joined; what is broken in between becomes
    U+FFFD, as do null ids and ids that the vocabulary lacks. Null ids give null, an empty list an empty text.
    """
    tune(tokens.sparkSession)
    slim = tokens.select(col(id_col).cast("long").alias("id"), col(ids_col).cast("array<int>").alias("ids"))
    out = pa.schema([("id", pa.int64()), ("text", pa.string()), ("head", pa.binary()), ("tail", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(tokenizer, "table")
        for b in batches:
            whole = self_contained(table, b.column(1))
            if whole is not None:
                none = pa.array([None if x else b"" for x in np.asarray(b.column(1).is_null())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), whole, none, none], schema=out)
                continue
            text: list[str | None] = []
            head: list[bytes | None] = []
            tail: list[bytes | None] = []
            for ids in b.column(1):
                if not ids.is_valid:
                    parts: tuple = (None, None, None)
                else:
                    parts = decoded(table, np.asarray(ids.values.fill_null(-1), dtype=np.int64))
                for to, x in zip((head, text, tail), parts, strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())], schema=out)

    return slim.mapInArrow(run, "id long, text string, head binary, tail binary").withColumnRenamed("id", id_col)


def self_contained(table: Table, lists: pa.ListArray) -> pa.Array | None:
    """The texts of all rows at once, if none begins or ends within a character or holds broken ones; else None."""
    off = np.asarray(lists.offsets).astype(np.int64)
    ids = np.asarray(lists.values.fill_null(-1), dtype=np.int64)[off[0] : off[-1]]
    data, size = table.bytes_of(table.known(ids))
    ends = np.concatenate([[0], np.cumsum(size)])[off - off[0]]
    made = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    try:
        made.validate(full=True)
    except pa.ArrowInvalid:
        return None
    return pc.if_else(lists.is_valid(), made, None).cast(pa.string())


def decoded(table: Table, ids: np.ndarray) -> tuple[bytes, str, bytes]:
    """Head, text and tail of one row of ids, as decode gives them."""
    return whole_characters(table.bytes_of(table.known(ids))[0].tobytes())


def whole_characters(data: bytes) -> tuple[bytes, str, bytes]:
    """Bytes of a character begun earlier, the whole characters, and bytes of one that ends later."""
    i = 0
    while i < min(3, len(data)) and data[i] & 0xC0 == 0x80:
        i += 1
    end = len(data)
    for k in range(1, min(3, len(data) - i) + 1):
        c = data[-k]
        if c & 0xC0 != 0x80:
            need = 2 if c >> 5 == 6 else 3 if c >> 4 == 14 else 4 if c >> 3 == 30 else 1
            if need > k:
                end = len(data) - k
            break
    return data[:i], data[i:end].decode("utf-8", "replace"), data[end:]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and offsets of every document's whole text."""
    return encode(load(spark, sf_dir, "documents"))
