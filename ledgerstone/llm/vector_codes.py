"""Operator 11: vectors compressed to one small code for each of their parts.

Components become integers, floor(SCALE * x). A vector is cut into equal consecutive parts, and each part position has a
codebook of entries. The nearest entry is found by bounds from coarse to fine: for a block of w components with sums s and t,
and residual norms r and q (what is left of the squared norm beside the mean), |x - c|^2 is at least (s - t)^2 / w + (r - q)^2.
One block for the whole part comes first, then halves, quarters and so on. An entry goes on only while its bound, lowered by
more than all rounding, doesn't exceed the best exact distance known; what is left gets its exact distance in integers. No
entry that could win or tie is lost, so ties go to the lower index as they would without bounds.

Training takes its first entries from the smallest ids and runs a few rounds: tasks add up the parts of each entry, Spark sums
them, and the driver holds the codebooks alone (entries x width numbers). All vectors are read in each round; none is sampled.

Vectors that are null or hold null or non-finite components are dropped. A shorter vector than the longest counts as ending in
zeros, and so does the width up to a multiple of the parts (an empty vector is all zeros). Components beyond +-LARGEST after
scaling are set to it, which keeps sums exact in 64 bits; embeddings don't come near. Null or repeated ids keep their rows; null
ids sort last, rows of one id by their vectors. An empty table gives an empty one and empty codebooks. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, join_dealt, table, trim

PARTS, ENTRIES, ROUNDS, SCALE, LARGEST = 16, 64, 2, 256.0, 1 << 22
#: Vectors whose parts are compared at once, which bounds a task's memory.
AT_ONCE = 4096


@dataclass
class Codebooks:
    """entries[position, index] are integer vectors; all positions have as many entries."""

    entries: np.ndarray
    scale: float = SCALE

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def whole_numbers(vectors: list, width: int, scale: float = SCALE) -> np.ndarray:
    """Rows of integer components, filled with zeros up to width."""
    out = np.zeros((len(vectors), width), np.int64)
    sizes = np.fromiter(map(len, vectors), np.int64, len(vectors))
    if len(vectors):
        flat = np.concatenate([np.asarray(v, np.float64) for v in vectors])
        out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    return out


# -- the nearest entry ---------------------------------------------------------------------------------------


def _summary(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, residual norms and sizes of blocks of a given width; the last block may be narrower."""
    at = np.arange(0, x.shape[1], width)
    size = np.diff(np.r_[at, x.shape[1]])
    total = np.add.reduceat(x, at, axis=1)
    # size * squares - total^2 is exact in integers, so the root's error is relative to the residual alone
    return total.astype(np.float64), np.sqrt((size * np.add.reduceat(x * x, at, axis=1) - total * total) / size), size.astype(np.float64)


def nearest(x: np.ndarray, entries: np.ndarray, survivors: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (ties: the lowest) and the squared distance, both exact.

    survivors gets the number of pairs left at each level, for those who want to see the bounds work."""
    n, d = x.shape
    widths = [d]
    while widths[-1] > 2:
        widths.append((widths[-1] + 1) // 2)
    norm = (x * x).sum(1)[:, None] + (entries * entries).sum(1)[None, :] + 1.0
    slack = 1e-9 * norm
    (s, r, w), (t, q, _) = _summary(x, widths[0]), _summary(entries, widths[0])
    low = (s - t.T) ** 2 / w[0] + (r - q.T) ** 2 - slack
    best = ((x - entries[low.argmin(1)]) ** 2).sum(1)
    row, col = np.nonzero(low <= best[:, None])
    if survivors is not None:
        survivors.append(len(row))
    for width in widths[1:]:
        (s, r, w), (t, q, _) = _summary(x, width), _summary(entries, width)
        bound = ((s[row] - t[col]) ** 2 / w + (r[row] - q[col]) ** 2).sum(1) - slack[row, col]
        stays = bound <= best[row]
        row, col = row[stays], col[stays]
        if survivors is not None:
            survivors.append(len(row))
    exact = np.full((n, len(entries)), np.iinfo(np.int64).max)
    exact[row, col] = ((x[row] - entries[col]) ** 2).sum(1)
    index = exact.argmin(1)
    return index, exact[np.arange(n), index]


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes by part, and the squared distances summed over parts."""
    parts, _, d = books.shape
    index, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
    for a in range(0, len(x), AT_ONCE):
        for p in range(parts):
            at, distance = nearest(x[a : a + AT_ONCE, p * d : (p + 1) * d], books[p])
            index[a : a + AT_ONCE, p] = at
            error[a : a + AT_ONCE] += distance
    return index, error


# -- on tables -----------------------------------------------------------------------------------------------


def usable(df: DataFrame, vector: str, *columns: str) -> DataFrame:
    """The named columns and v, of rows whose vector has finite components only."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & finite).select(*columns, v.cast("array<double>").alias("v"))


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codebooks:
    """Codebooks of a table (vec_id, v) of usable vectors."""
    if not 0 < entries <= 256:
        raise ValueError("an index has one byte: 1 to 256 entries")
    longest = vectors.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), scale)
    d = max(-(-longest // parts), 1)
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.ascontiguousarray(whole_numbers([r["v"] for r in first], parts * d, scale).reshape(len(first), parts, d).transpose(1, 0, 2))
    k = len(first)
    names = [f"c{i}" for i in range(d)]

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((parts * k, d), np.int64), np.zeros(parts * k, np.int64)
            for batch in batches:
                trim()
                x = whole_numbers(batch.column(0).to_pylist(), parts * d, scale)
                index, _ = assign(x, books)
                for p in range(parts):
                    slot = p * k + index[:, p].astype(np.int64)
                    np.add.at(total, slot, x[:, p * d : (p + 1) * d])
                    n += np.bincount(slot, minlength=parts * k)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(total[used, i]) for i in range(d))], ["slot", "n", *names])

        held = vectors.select("v").mapInArrow(sums, ", ".join(f"{c} long" for c in ("slot", "n", *names)))
        got = held.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", *names))).collect()  # a row for each entry
        books = books.copy()
        for r in got:
            books[r["slot"] // k, r["slot"] % k] = [r[c] // r["n"] for c in names]
    return Codebooks(books, scale)


def encode(vectors: DataFrame, codebooks: Codebooks, *columns: str) -> DataFrame:
    """The named columns of a table of usable vectors v, with codes (binary, a byte for each part) and error."""
    parts, k, d = codebooks.entries.shape
    kept = [vectors.schema[c] for c in columns]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trim()
            index, error = assign(whole_numbers(batch.column(len(kept)).to_pylist(), parts * d, codebooks.scale), codebooks.entries)
            codes = pa.array([row.tobytes() for row in index], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], codes, pa.array(error)], [*columns, "codes", "error"])

    return vectors.select(*columns, "v").mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "codes binary", "error long"]))


def decode(codes: np.ndarray, codebooks: Codebooks) -> np.ndarray:
    """The vectors that rows of indexes stand for, in the scale of the originals."""
    parts, _, d = codebooks.entries.shape
    return codebooks.entries[np.arange(parts), codes].reshape(len(codes), parts * d) / codebooks.scale


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Coded rows with label_error, the error summed over the rows of the same label, nulls together. Summed first, then joined; a frequent label is dealt over tasks."""
    stage = Stage(coded.sparkSession, "codes")
    name = F.when(F.col(label).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(label).cast("string")))
    rows = stage.write(coded.withColumn("of", name))
    by = stage.write(rows.groupBy("of").agg(F.count(F.lit(1)).alias("n"), F.try_sum("error").alias("label_error")))
    size = by.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    return join_dealt(rows, by.select("of", "label_error"), "of", stage, by, size["rows"] or 0, size["most"] or 0).drop("of")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"), "embedding", "vec_id", "label")
    codebooks = train(vectors)
    rows = with_label_errors(encode(vectors, codebooks, "vec_id", "label"))
    return rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256"))


ORACLE_SQL = {
    "op11_vector_codes": """
WITH RECURSIVE kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a1 AS MATERIALIZED (SELECT vec_id, p, x, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, a.p, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN b0 b ON a.p = b.p) GROUP BY vec_id, p, x),
m1 AS (SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, k, i, sum(x[i]) AS s, count(*) AS n FROM a1, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, k, i) GROUP BY p, k),
b1 AS MATERIALIZED (SELECT b0.p, b0.k, coalesce(m1.c, b0.c) AS c FROM b0 LEFT JOIN m1 ON b0.p = m1.p AND b0.k = m1.k),
a2 AS MATERIALIZED (SELECT vec_id, p, x, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, a.p, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN b1 b ON a.p = b.p) GROUP BY vec_id, p, x),
m2 AS (SELECT p, k, list(CAST(floor(CAST(s AS DOUBLE) / n) AS BIGINT) ORDER BY i) AS c FROM (SELECT p, k, i, sum(x[i]) AS s, count(*) AS n FROM a2, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, k, i) GROUP BY p, k),
b2 AS MATERIALIZED (SELECT b1.p, b1.k, coalesce(m2.c, b1.c) AS c FROM b1 LEFT JOIN m2 ON b1.p = m2.p AND b1.k = m2.k),
a3 AS MATERIALIZED (SELECT vec_id, label, p, min((d, k)) AS dk FROM (SELECT vec_id, label, a.p, k, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts a JOIN b2 b ON a.p = b.p) GROUP BY vec_id, label, p),
whole AS (SELECT vec_id, label, string_agg(lpad(to_hex(dk[2]), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dk[1]) AS BIGINT) AS error FROM a3 GROUP BY vec_id, label)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) FROM b2) AS codebooks_sha256
FROM whole""",
}
