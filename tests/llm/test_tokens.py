import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerstone.llm import bpe, bpe_codec, packing, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "²", "½", "Ⅷ", "一", "𝔸", "'s", "'", "_", "-", "12", "٣", "<|endoftext|>", "​", "\x00", "ß", "aaaa", "\r", "́", "😀"]


def texts():
    rng = random.Random(1)
    return [None, "", "a" * 5000, " " * 3000, "ab" * 4000, "".join(rng.choice("abcdefgh") for _ in range(5000))] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(800)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ordinary():
    pairs = bpe.table_from_ranks(RANKS)
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(pairs.token_bytes) if t}, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, text string, n_tokens string, word int").repartition(3)


def test_counts(spark, docs, library):
    got = token_counts.with_token_counts(docs, JSON, P.PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit, r.word) == (n, len((r.text or "").encode()), n > 512, 1)
    assert token_counts.with_token_counts(docs.limit(0), JSON, P.PATTERN).collect() == []


def test_word_tables_stay_bounded(monkeypatch, library):
    monkeypatch.setattr(token_counts, "KNOWN_WORDS", 50)
    pairs, specials = bpe.table_from_json(JSON)
    known = dict.fromkeys(specials, 1)
    own = [t or "" for t in texts()]
    for a in range(0, len(own), 40):
        got = token_counts._counts(own[a : a + 40], bpe.PreTokenizer(P.PATTERN, specials), pairs, known)
        assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in own[a : a + 40]]


@pytest.mark.parametrize("block", [2000, 10_000_000])
def test_codec(spark, docs, ordinary, block):
    want = sorted((str(r.doc_id), len(ids := ordinary.encode_ordinary(r.text or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    got = bpe_codec.encode_documents(docs.select("doc_id", "text"), RANKS, P.PATTERN, digest=True, block_chars=block).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_codec_ids_and_decoding(spark, docs, ordinary):
    few = docs.filter("doc_id < 90").select("doc_id", "text")
    ids = bpe_codec.encode_documents(few, RANKS, P.PATTERN)
    back = {r.doc_id: r.bytes for r in bpe_codec.decode_documents(ids, RANKS).collect()}
    assert {k: bytes(v).decode() for k, v in back.items()} == {r.doc_id: r.text or "" for r in few.collect()}
    assert bpe_codec.encode_documents(few.limit(0), RANKS, P.PATTERN, digest=True).collect() == []


def test_packing(spark, docs, library):
    keyed = docs.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    text = {r.doc_id: r.text or "" for r in keyed.collect()}
    got = packing.pack_documents(keyed.select("doc_id", "text"), JSON, P.PATTERN, tokens=64, segments=8).collect()
    rows = {}
    for r in got:
        rows.setdefault(r.doc_id, []).append(r)
    assert rows.keys() == text.keys()
    for k, parts in rows.items():
        ids = np.array(library.encode(text[k], add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    waste = 0
    for parts in sequences.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64 and len(parts) <= 8
        waste += 0 if at & (at - 1) == 0 else 64 - at
    assert waste < 0.02 * sum(r.length for r in got)
    assert packing.pack_documents(keyed.select("doc_id", "text").limit(0), JSON, P.PATTERN).collect() == []


def test_examples_keep_all_limits(spark):
    rng = random.Random(2)
    rows = [(i, n := rng.randint(0, 900), rng.randint(0, n)) for i in range(500)] + [(900, 5000, 10), (901, None, None), (None, 3, 3)]
    got = packing.pack_examples(spark.createDataFrame(rows, "item_id long, n_tokens long, n_loss long"), 1000, 5, 600).collect()
    assert sorted(str(r.item_id) for r in got) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        alone = len(parts) == 1
        assert alone or (sum(p.n_tokens for p in parts) <= 1000 and len(parts) <= 5 and sum(p.n_loss for p in parts) <= 600)
    least = max(sum(r[1] or 0 for r in rows) / 1000, sum(r[2] or 0 for r in rows) / 600, len(rows) / 5)
    assert len(by) < 1.35 * least


@pytest.mark.parametrize("text", [" " * 10_000_000 + "x", "a <|endoftext|> é" + "\xa0" * 1_500_000 + "b <|endoftext|>"])
def test_very_long_white_space(text, library):
    ids = packing._encoder(JSON, P.PATTERN)([text])[0]
    pairs, specials = bpe.table_from_json(JSON)
    special = {i: t.encode() for t, i in specials.items()}
    assert b"".join(special.get(i) or pairs.token_bytes[i] for i in ids.tolist()).decode() == text
    few = text.replace(" " * 9_990_000, "").replace("\xa0" * 1_499_000, "")
    assert bpe.encode_pieces(few, bpe.PreTokenizer(P.PATTERN, specials), pairs).tolist() == library.encode(few, add_special_tokens=False).ids


def test_codec_large_and_null_ids_in_one_block(spark):
    rows = [(9007199254740993, "a b"), (None, "c"), (-9223372036854775807, None), (9223372036854775807, "d")]
    got = bpe_codec.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), RANKS, P.PATTERN, digest=True).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {9007199254740993: 2, None: 1, -9223372036854775807: 0, 9223372036854775807: 1}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("word_blocks")]


def test_conversations_keep_all_limits(spark, library):
    rng = random.Random(8)
    rows = [(c, t, ["user", "assistant", None][t % 3 if c % 9 == 0 else t % 2], None if rng.random() < 0.05 else "word " * rng.randint(0, 120)) for c in range(200) for t in range(rng.randint(1, 6))] + [(None, 0, "assistant", "alone"), (500, 0, "assistant", "a b " * 3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = packing.pack_conversations(turns, JSON, P.PATTERN, tokens=700, segments=4, loss=400).collect()
    want = {}
    for c, _, role, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        a, b = want.get(c, (0, 0))
        want[c] = (a + n, b + n * (role == "assistant"))
    assert {r.item_id: (r.n_tokens, r.n_loss) for r in got} == want and len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert all(len(p) == 1 or (sum(r.n_tokens for r in p) <= 700 and sum(r.n_loss for r in p) <= 400 and len(p) <= 4) for p in by.values())
    assert packing.pack_conversations(turns.limit(0), JSON, P.PATTERN).collect() == []
