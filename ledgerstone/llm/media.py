"""Operator 3: columns of lossless WebP images.

decode_images() turns a binary column of WebP files into pixel arrays. The query stores every text as images of
48 RGBA pixels (192 bytes) a row: a payload is cut into strips of a bounded number of rows, one WebP file each, and
the stored form is the files one after the other (each file states its own length). A task packs and reads the
strips of one slice of a batch together; nothing is shuffled. A null text is stored as an empty one; equal texts get
equal values, and repeated rows repeated rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .common import in_chunks, table, trim

ROW_PIXELS = 48
ROW_BYTES = 4 * ROW_PIXELS
#: Rows of a strip, and strips that a task holds at once.
STRIP_ROWS, LANES = 20, 768


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b" " * (max(-(-len(raw) // ROW_BYTES), 1) * ROW_BYTES - len(raw))


def store(payloads: list[bytes]) -> list[bytes]:
    """The stored form of payloads of whole rows: each strip's file has the transforms that suit it."""
    strips, of = [], []
    for k, p in enumerate(payloads):
        pixels = np.frombuffer(p, np.uint8).reshape(-1, ROW_PIXELS, 4)
        for a in range(0, len(pixels), STRIP_ROWS):
            strips.append(pixels[a : a + STRIP_ROWS])
            of.append(k)
    files = [b""] * len(strips)
    order = sorted(range(len(strips)), key=lambda i: len(strips[i]))
    for a in range(0, len(order), LANES):
        part = order[a : a + LANES]
        for i, f in zip(part, webp.encode_best([strips[i] for i in part])):
            files[i] = f
    out = [[] for _ in payloads]
    for k, f in zip(of, files):
        out[k].append(f)
    return [b"".join(x) for x in out]


def split_files(stored: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(stored):
        size = 8 + struct.unpack_from("<I", stored, at + 4)[0]
        out.append(stored[at : at + size])
        at += size
    return out


def read_back(stored: list[bytes]) -> list[np.ndarray]:
    """The pixel rows (height, width, 4) of stored forms."""
    files, of = [], []
    for k, s in enumerate(stored):
        mine = split_files(s)
        files += mine
        of += [k] * len(mine)
    pixels: list = [None] * len(files)
    order = sorted(range(len(files)), key=lambda i: len(files[i]))
    for a in range(0, len(order), LANES):
        part = order[a : a + LANES]
        for i, im in zip(part, webp.decode([files[i] for i in part])):
            pixels[i] = im
    out = [[] for _ in stored]
    for k, im in zip(of, pixels):
        out[k].append(im)
    return [np.concatenate(x) for x in out]


def feature(pixels: np.ndarray) -> str:
    """Mean sample of each channel and mean step between neighbours in a row, in thousandths."""
    p = pixels.astype(np.int64)
    mean = p.reshape(-1, 4).sum(0) * 1000 // (p.shape[0] * p.shape[1])
    step = np.abs(np.diff(p, axis=1)).sum() * 1000 // max(p.shape[0] * (p.shape[1] - 1) * 4, 1)
    return ":".join(map(str, [*mean.tolist(), int(step), p.shape[0]]))


def decode_images(images: Column) -> Column:
    """A struct (width, height, rgba) for a binary column of lossless WebP files; null for null."""

    @F.pandas_udf("width int, height int, rgba binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            files, rows = s.tolist(), []
            there = [i for i, f in enumerate(files) if f is not None]
            got = {}
            for a in range(0, len(there), 256):
                part = there[a : a + 256]
                got |= {i: (im.shape[1], im.shape[0], im.tobytes()) for i, im in zip(part, webp.decode([files[i] for i in part]))}
            rows = [got.get(i, (None, None, None)) for i in range(len(files))]
            yield pd.DataFrame(rows, columns=["width", "height", "rgba"]).astype({"width": "Int32", "height": "Int32"})

    return F.when(images.isNotNull(), decoded(images))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_round_trip(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each text (doc_id, text) as images, reads them back, and reports digests and features; with keep_media also the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts, 4_000_000):
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts[a:b]]
                stored = store([payload(t) for t in texts[a:b]])
                pixels = read_back(stored)
                back = [p.tobytes() for p in pixels]
                cols = [pa.array(keys[a:b], pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(map(len, back), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back]), pa.array([zlib.crc32(x[-16:]) for x in back], pa.int64()), pa.array(map(len, stored), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in stored]), pa.array(map(feature, pixels), pa.string())]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                if keep_media:
                    cols.append(pa.array(stored, pa.binary())), names.append("media")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", media binary" if keep_media else ""))


def op3_webp_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
