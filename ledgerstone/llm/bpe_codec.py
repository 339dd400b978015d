"""Operator 6: byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. A task splits its documents into pre-tokens and gathers them in blocks of bounded size. A block holds its
   distinct words and, for each document, the word numbers by position (that is the exploded form of
   (document, position, word), kept as arrays).
2. The (block, number, word) rows are shuffled by word. A task meets equal words one after the other and
   encodes each distinct word once; the ids go back to every (block, number), combined by block before they are sent.
3. Blocks are stored once, bucketed by their number, so that only the ids move when the two meet by block;
   documents are then reassembled by position.

A word has one row in a block, however frequent it is, so no key gets more rows than there are blocks.
Decoding joins ids with the token-byte table, whose size the vocabulary fixes.

Null texts count as empty; an empty text has no ids. Null or repeated document ids are carried along as they
are, one result row for each input row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenizer, merge_words, ragged_take, table_from_ranks
from .common import Stage, in_chunks, ragged_index, table, trim

#: Characters of text in a block.
BLOCK_CHARS = 20_000_000
#: Bits of a word's number in its block, and of a block's number in its partition. A string holds fewer than 2**31 bytes, so
#: fewer than 2**30 distinct words.
NUMBER_BITS, BLOCK_BITS = 30, 13
#: Ids of this many words are combined by block before they leave a task.
COMBINED_WORDS = 500_000


def _planes(a: np.ndarray, level: int = 9) -> bytes:
    """Numbers as byte planes, as many as the largest needs (the first byte says), compressed."""
    import zstandard

    a = np.ascontiguousarray(a, "<i8")
    n = max((int(a.max()).bit_length() + 7) // 8, 1) if len(a) else 1
    return bytes([n]) + zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes())


def _unplaned(b: bytes) -> np.ndarray:
    import zstandard

    p = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((p.shape[1], 8), np.uint8)
    out[:, : b[0]] = p.T
    return out.reshape(-1).view("<i8").astype(np.int64)


def word_blocks(docs: DataFrame, cutter: Callable[[], Callable[[str], list]], block_chars: int = BLOCK_CHARS, kind: str = "string") -> DataFrame:
    """Blocks (block_id, doc_ids, known, sizes, numbers, words) of a table (doc_id, text); known marks the ids that aren't null.

    cutter() makes, in a task, the function that cuts a text into words of a kind (string or binary)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre, arrow = cutter(), pa.binary() if kind == "binary" else pa.string()
        base, n = TaskContext.get().partitionId() << BLOCK_BITS, 0
        ids, sizes, numbers, seen, chars = [], [], [], {}, 0

        def block():
            nonlocal n
            if n >> BLOCK_BITS:
                raise OverflowError(f"more than {1 << BLOCK_BITS} blocks in a partition: use smaller partitions or a larger block_chars")
            number = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            freq = np.bincount(number, minlength=len(seen))
            order = np.argsort(-freq, kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            words = list(seen)
            known = np.array([i is not None for i in ids], np.uint8)
            whole = np.array([i or 0 for i in ids], "<i8")
            binary = (whole.tobytes(), known.tobytes(), _planes(np.array(sizes, np.int64)), _planes(place[number]))
            out = pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), *(pa.array([x], pa.binary()) for x in binary), pa.array([[words[i] for i in order]], pa.list_(arrow))], ["block_id", "doc_ids", "known", "sizes", "numbers", "words"])
            n += 1
            return out

        for batch in batches:
            trim()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            keys = batch.column(0).to_pylist()
            for a, b in in_chunks(texts):
                words = []
                for t in texts[a:b]:
                    w = pre(t)
                    sizes.append(len(w))
                    words += w
                for w in words:
                    if w not in seen:
                        seen[w] = len(seen)
                numbers.append(np.fromiter(map(seen.__getitem__, words), np.int32, len(words)))
                ids += keys[a:b]
                chars += sum(map(len, texts[a:b]))
                if chars >= block_chars:
                    yield block()
                    ids, sizes, numbers, seen, chars = [], [], [], {}, 0
        if ids:
            yield block()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(split, f"block_id long, doc_ids binary, known binary, sizes binary, numbers binary, words array<{kind}>")


def kept_blocks(blocks: DataFrame, stage: Stage) -> DataFrame:
    """The blocks as files of the stage, bucketed by their number: a later join by block moves the other side alone."""
    spark, name = blocks.sparkSession, f"word_blocks_{uuid.uuid4().hex}"
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 10_000)
    blocks.write.bucketBy(buckets, "block_id").option("path", f"{stage.base}/{name}").option("compression", "zstd").format("parquet").saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalogue's entry alone: the files are outside it, and the plan has read it
    return kept


def block_words(blocks: DataFrame) -> DataFrame:
    """Rows (place, word) of all blocks, place being block_id << NUMBER_BITS | number."""
    rows = blocks.select("block_id", F.posexplode("words").alias("number", "word"))
    return rows.select(F.shiftleft("block_id", NUMBER_BITS).bitwiseOR(F.col("number").cast("long")).alias("place"), "word")


def encode_distinct(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Rows (place, word) shuffled by word, place being block_id << NUMBER_BITS | number; each task encodes each of its distinct words once.

    The result is (block_id, numbers, sizes, ids): the ids of some of a block's words."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = table_from_ranks(ranks_path)
        wide = "<u2" if len(pairs.token_bytes) <= 1 << 16 else "<u4"
        last, last_ids, held, n_held = None, np.zeros(0, np.int64), [], 0

        def combined():
            place, n, flat = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.argsort(place, kind="stable")
            at = np.cumsum(n) - n
            place, n, flat = place[order], n[order], flat[ragged_index(at[order], n[order])]
            block, ends = place >> NUMBER_BITS, np.cumsum(n)
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
                yield int(block[a]), _planes(place[a:b] & ((1 << NUMBER_BITS) - 1)), _planes(n[a:b]), flat[ends[a] - n[a] : ends[b - 1]].astype(wide).tobytes()

        def out(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], ["block_id", "numbers", "sizes", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(1).dictionary_encode()
            words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            new = [w for w in words if w != last]
            flat, n = merge_words([w.encode() for w in new], pairs)
            if len(new) < len(words):  # sorted: the word that goes on from the last batch comes first
                flat, n = np.r_[last_ids, flat], np.r_[len(last_ids), n]
            at = np.cumsum(n) - n
            last, last_ids = words[-1], flat[at[-1] : at[-1] + n[-1]]
            held.append((batch.column(0).to_numpy(), n[index], ragged_take(flat, at, n, index)))
            n_held += len(index)
            if n_held >= COMBINED_WORDS:
                yield out(combined())
                held, n_held = [], 0
                trim()
        if held:
            yield out(combined())

    by_word = rows.repartition("word").sortWithinPartitions("word")
    return by_word.mapInArrow(encode, "block_id long, numbers binary, sizes binary, ids binary")


def decode_ids(ids: np.ndarray, table_bytes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """Joins ids with the token-byte table (flat bytes with starts and lengths) in order of position."""
    return ragged_take(table_bytes, starts, lengths, ids).tobytes()


def reassemble(blocks: DataFrame, coded: DataFrame, ranks_path: str, digest: bool = True) -> DataFrame:
    """Documents from blocks and the ids of their words: ids, or their count and digests."""

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        trim()
        pairs = table_from_ranks(ranks_path)
        of_token = np.fromiter(map(len, pairs.token_bytes), np.int64, len(pairs.token_bytes))
        token_at, token_flat = np.cumsum(of_token) - of_token, np.frombuffer(b"".join(pairs.token_bytes), np.uint8)
        wide = "<u2" if len(pairs.token_bytes) <= 1 << 16 else "<u4"
        number = np.concatenate([_unplaned(x) for x in right["numbers"]]) if len(right) else np.zeros(0, np.int64)
        size = np.concatenate([_unplaned(x) for x in right["sizes"]]) if len(right) else number
        flat = np.frombuffer(b"".join(right["ids"]), wide).astype(np.int64)
        order = np.argsort(number)
        if (number[order] != np.arange(len(number))).any():
            raise ValueError("a block lost some of its words")
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        decimal = [b"".join(b"%d " % i for i in flat[a : a + k].tolist()) for a, k in zip(at.tolist(), size.tolist())] if digest else []
        out = []
        for _, row in left.iterrows():
            number, stop = _unplaned(row["numbers"]), 0
            ids_of = [d if k else None for d, k in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["known"])]
            for doc, n in zip(ids_of, _unplaned(row["sizes"]).tolist()):
                mine = number[stop : stop + n]
                stop += n
                ids = ragged_take(flat, at, size, mine)
                if digest:
                    text = b"".join(map(decimal.__getitem__, mine.tolist()))[:-1]
                    back = decode_ids(ids, token_flat, token_at, of_token)
                    out.append((doc, len(ids), hashlib.sha256(text).hexdigest(), hashlib.sha256(back).hexdigest()))
                else:
                    out.append((doc, ids))
        frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids"])
        return frame.assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<long>"
    return blocks.groupBy("block_id").cogroup(coded.groupBy("block_id")).applyInPandas(meet, schema)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) of a table (doc_id, text), or with digest the counts and hashes of ids and of decoded bytes."""
    blocks = kept_blocks(word_blocks(docs, lambda: PreTokenizer(pattern), block_chars), Stage(docs.sparkSession, "bpe"))
    return reassemble(blocks.select("block_id", "doc_ids", "known", "sizes", "numbers"), encode_distinct(block_words(blocks), ranks_path), ranks_path, digest)


def decode_documents(ids: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes) of a table (doc_id, ids): a map-side join of ids with the token-byte table."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = table_from_ranks(ranks_path)
        n = np.fromiter(map(len, pairs.token_bytes), np.int64, len(pairs.token_bytes))
        at, flat = np.cumsum(n) - n, np.frombuffer(b"".join(pairs.token_bytes), np.uint8)
        for batch in batches:
            back = [None if x is None else decode_ids(np.asarray(x, np.int64), flat, at, n) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], ["doc_id", "bytes"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(decode, "doc_id long, bytes binary")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)
