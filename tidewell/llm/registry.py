"""The text operators' queries over whole tables, and their SQL."""

from __future__ import annotations

from . import bpe, chat, fingerprints, mixing, neighbours, pii, quality, simhash, toxicity, warc

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "benchmark_contained": fingerprints.contained,
    "op2_quality": quality.query,
    "op3_neighbours": neighbours.query,
    "op4_pii": pii.query,
    "op5_mixing": mixing.query,
    "op6_bpe": bpe.query,
    "op7_chat": chat.query,
    "op8_revisits": warc.query,
    "op9_near_duplicates": simhash.query,
    "op10_toxicity": toxicity.query,
}
SQL = {
    "op1_fingerprints": fingerprints.SQL,
    "benchmark_contained": fingerprints.CONTAINED,
    "op2_quality": quality.SQL,
    "op5_mixing": mixing.SQL,
    "op7_chat": chat.SQL,
    "op8_revisits": warc.SQL,
}
