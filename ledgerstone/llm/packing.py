"""Operator 1: packing by vector bin packing with the dot-product heuristic.

An item is a vector (tokens, segments, loss-bearing tokens), a sequence has a limit for each. A task fills one
sequence after the other: of the items that fit in all three, it places the one whose vector has the largest
dot product with what is left of the sequence. Documents may be cut: when nothing fits, the largest item
gives a piece that fills the sequence and its rest stays an item. The last sequence of a task is cut at powers
of two, which need no padding. Instruction examples are packed by the same class without cutting.

Work is local to a task, nothing is shuffled; an open sequence goes on from one batch to the next. A null text
packs as an empty one (its closing id alone). Repeated rows and null ids are packed as rows of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import PreTokenizer, encode_pieces, table_from_json
from .common import in_chunks, table, trim

SEQUENCE_TOKENS, SEQUENCE_SEGMENTS = 2048, 512
DOCUMENT_END = 1
#: Items that a task weighs at once; items left over go on to the next window.
WINDOW = 4096


class DotProductPacker:
    """Fills sequences with items (key, start, tokens, loss). put() yields finished sequences, each a list of (key, start, length)."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool):
        self.cap = np.array([tokens, segments, loss], float)
        self.cut = cut
        self.classes: dict[tuple[int, int], list] = {}
        self.sizes = np.zeros((0, 3))
        self.keys: list[tuple[int, int]] = []
        self.open: list = []
        self.left = self.cap.copy()

    def _loss(self, length: int, loss: int, of: int) -> int:
        """Loss-bearing tokens of a piece: all of a document's, in proportion for the rest."""
        return length if loss == of else round(loss * length / of)

    def _index(self) -> None:
        self.keys = list(self.classes)
        self.sizes = np.array([(t, 1, s) for t, s in self.keys], float).reshape(-1, 3)
        self.live = np.array([bool(self.classes[k]) for k in self.keys], bool)
        self.of = {k: i for i, k in enumerate(self.keys)}

    def _add(self, item) -> None:
        k = (item[2], item[3])
        if k in self.of:
            self.classes[k].append(item)
            self.live[self.of[k]] = True
        else:
            self.classes[k] = [item]
            self.of[k] = len(self.keys)
            self.keys.append(k)
            self.sizes = np.vstack([self.sizes, [(k[0], 1, k[1])]])
            self.live = np.r_[self.live, True]

    def _take(self, i: int):
        k = self.keys[i]
        item = self.classes[k].pop()
        self.live[i] = bool(self.classes[k])
        return item

    def _place(self, key, start: int, length: int, loss: int) -> None:
        self.open.append((key, start, length))
        self.left -= (length, 1, loss)

    def _close(self):
        done, self.open, self.left = self.open, [], self.cap.copy()
        return done

    def put(self, items: list) -> Iterator[list]:
        self.classes = {}
        for key, start, tokens, loss in items:
            if not self.cut and ((tokens, 1, loss) > self.cap).any():
                yield [(key, start, tokens)]  # larger than any sequence: it stands alone
                continue
            self.classes.setdefault((tokens, loss), []).append((key, start, tokens, loss))
        self._index()
        demand = np.array([sum(k[j] * len(v) for k, v in self.classes.items()) for j in (0, 1)] + [0.0])
        demand = np.array([demand[0], sum(map(len, self.classes.values())), demand[1]]) / self.cap
        weight = demand / max(demand.sum(), 1e-12)
        scaled = None
        n = 0
        while self.live.any():
            if scaled is None or len(scaled) != len(self.sizes):
                scaled = self.sizes / self.cap
            fits = self.live & (self.sizes <= self.left).all(1)
            if fits.any():
                score = scaled @ (weight * self.left / self.cap)
                i = int(np.argmax(np.where(fits, score, -1.0)))
                self._place(*self._take(i))
            elif self.cut and self.left[0] >= 1 and self.left[1] >= 1 and self.left[2] >= 1:
                i = int(np.argmax(np.where(self.live, self.sizes[:, 0], -1)))
                key, start, tokens, loss = self._take(i)
                length = int(min(self.left[0], tokens - 1))
                part = self._loss(length, loss, tokens)
                while part > self.left[2]:
                    length = max(1, length * int(self.left[2]) // part)
                    part = self._loss(length, loss, tokens)
                self._place(key, start, length, part)
                self._add((key, start + length, tokens - length, loss - part))
            else:
                yield self._close()
            if self.open and (self.left < 1).any():
                yield self._close()
            n += 1

    def end(self) -> Iterator[list]:
        """The last sequence; if cutting is allowed, cut at powers of two."""
        rest = self._close()
        if not self.cut:
            if rest:
                yield rest
            return
        total = sum(x[2] for x in rest)
        while total:
            room, part = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                key, start, length = rest.pop(0)
                took = min(room, length)
                part.append((key, start, took))
                room -= took
                if took < length:
                    rest.insert(0, (key, start + took, length - took))
            yield part


def _encoder(path: str, pattern: str):
    """Ids of texts as the tokenizer file gives them. Where ids follow the order of the merges, as they do in byte-level files
    trained in one go, ranks are ids and the faster engine gives the same; any other file is read by its own library."""
    import os

    pairs, specials = table_from_json(path)
    if pairs.by_id:
        import tiktoken

        ranks = {t: i for i, t in enumerate(pairs.token_bytes) if t and i not in specials.values()}
        engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
        pre = PreTokenizer(pattern, specials)

        def ids(text: str) -> np.ndarray:
            try:
                return engine.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its regular expressions run out of stack on very long white space
                return encode_pieces(text, pre, pairs)

        return lambda texts: [ids(t) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return lambda texts: [np.array(e.ids, "<u4") for e in library.encode_batch_fast(texts, add_special_tokens=False)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, tokens: int = SEQUENCE_TOKENS, segments: int = SEQUENCE_SEGMENTS, loss: int | None = None, end_id: int = DOCUMENT_END) -> DataFrame:
    """Pieces of the documents (doc_id, text), with the sequence that holds each and its offset there."""
    loss = loss or tokens

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = _encoder(tokenizer_path, pattern)
        packer = DotProductPacker(tokens, segments, loss, cut=True)
        sequence = TaskContext.get().partitionId() << 36
        held: dict[int, list] = {}  # row number -> [doc_id, ids, ids not yet given out]
        row = 0

        def pieces(done: Iterator[list]):
            nonlocal sequence
            cols = [[] for _ in range(7)]
            for parts in done:
                at = 0
                for k, start, length in parts:
                    doc, ids, _ = held[k]
                    for c, v in zip(cols, (doc, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, at)):
                        c.append(v)
                    at += length
                    held[k][2] -= length
                    if not held[k][2]:
                        del held[k]
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            trim()
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in in_chunks(texts, 4_000_000):
                items = []
                for key, ids in zip(keys[a:b], encode(texts[a:b])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    held[row] = [key, ids, len(ids)]
                    whole = len(ids) // tokens * tokens if loss >= tokens else 0
                    items += [(row, s, tokens, tokens) for s in range(0, whole, tokens)]
                    if whole < len(ids):
                        items.append((row, whole, len(ids) - whole, len(ids) - whole))
                    row += 1
                for i in range(0, len(items), WINDOW):
                    yield pieces(packer.put(items[i : i + WINDOW]))
        yield pieces(packer.end())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PIECES)


def pack_examples(items: DataFrame, tokens: int = SEQUENCE_TOKENS, segments: int = 16, loss: int | None = None) -> DataFrame:
    """Instruction examples (item_id, n_tokens, n_loss), whole, into sequences; an item above a limit gets one of its own.

    Nulls count as 0 tokens; the result has one row for each row: item_id, n_tokens, n_loss, sequence_id, offset."""
    loss = tokens if loss is None else loss

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, sequence = DotProductPacker(tokens, segments, loss, cut=False), TaskContext.get().partitionId() << 36

        def rows(done):
            nonlocal sequence
            out = []
            for parts in done:
                at = 0
                for (key, n, s), _, length in parts:
                    out.append((key, n, s, sequence, at))
                    at += length
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], ["item_id", "n_tokens", "n_loss", "sequence_id", "offset"])

        for batch in batches:
            got = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for i in range(0, len(got), WINDOW):
                yield rows(packer.put([((k, n, s), 0, n, s) for k, n, s in got[i : i + WINDOW]]))
        yield rows(packer.end())

    src = items.select(F.col("item_id").cast("long"), *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("n_tokens", "n_loss")))
    return src.mapInArrow(pack, "item_id long, n_tokens long, n_loss long, sequence_id long, offset long")


def pack_conversations(turns: DataFrame, tokenizer_path: str, pattern: str, tokens: int = SEQUENCE_TOKENS, segments: int = 16, loss: int = 1536, learned: str = "assistant") -> DataFrame:
    """Conversations (conv_id, turn, role, text), whole, into sequences: each turn has its text's tokens and a closing one, and only turns of the
    learned role bear loss. All three limits hold in every sequence; a conversation above one stands alone. Null texts are empty turns."""
    from .token_counts import count_tokens

    n = count_tokens(F.col("text"), tokenizer_path, pattern) + 1
    counted = turns.select(F.col("conv_id").alias("item_id"), "role", n.alias("n"))
    items = counted.groupBy("item_id").agg(F.sum("n").alias("n_tokens"), F.sum(F.when(F.col("role") == learned, F.col("n")).otherwise(0)).alias("n_loss"))
    return pack_examples(items, tokens, segments, loss)


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on instruction data, where the three limits differ."""
    import public_tokenizers

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return pack_conversations(turns, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
