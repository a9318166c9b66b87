"""A media column: payloads of texts as lossless WebP, read back into pixel arrays and features."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .base import map_texts, texts

PAD, UNIT, TAIL = 255, 576, 32
SCHEMA = "doc_id long, media binary"
FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded to a positive multiple of ``UNIT``; and their number."""
    raw = (text or "").encode("utf-8", "replace")
    return raw + bytes([PAD]) * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text's payload as lossless WebP (null counts as empty)."""

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([webp.encode_payload(*payload(v)) for v in values], pa.binary())], ["doc_id", "media"])

    return map_texts(texts(docs, id_col, text_col), run, SCHEMA)


def pixels(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``doc_id, width, height, argb``: any lossless WebP file as an array of 32-bit pixels.

    A null file gives nulls; a file that is not lossless WebP, or is damaged, fails the job.
    """

    def run(batches):
        for batch in batches:
            rows = [(None, None, None) if v is None else ((p := webp.decode(v)).shape[1], p.shape[0], p.ravel().astype(np.int64)) for v in batch.column(1).to_pylist()]
            w, h, a = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(a, pa.list_(pa.int64()))], ["doc_id", "width", "height", "argb"])

    return media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].cast("binary").alias("media")).mapInArrow(run, "doc_id long, width int, height int, argb array<long>")


def feature(samples: np.ndarray) -> str:
    """Rows, mean, deviation, entropy and distinct values of the samples, and an 8x8 mean hash."""
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / len(samples)
    values = np.arange(256)
    mean = float(counts @ values) / len(samples)
    spread = max(0.0, float(counts @ (values * values)) / len(samples) - mean * mean) ** 0.5
    cells = np.add.reduceat(samples, np.arange(64) * len(samples) // 64, dtype=np.int64)
    hashed = np.packbits(cells * 64 > cells.sum()).tobytes().hex()
    return f"rows={len(samples) // UNIT};mean={mean:.4f};sd={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};distinct={len(p)};hash={hashed}"


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text, read the stored bytes back, and describe both: the contract's columns.

    Equal texts give equal rows but for the id. A very long text becomes several files in a row.
    """

    def run(ids: pa.Array, values: list[str | None]) -> pa.RecordBatch:
        rows = []
        for v in values:
            raw, n = payload(v)
            media = webp.encode_payload(raw, n)
            samples = webp.decode_payload(media)
            back = samples.tobytes()
            rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-TAIL:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids, *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_texts(texts(docs, id_col, text_col), run, FACTS)
