import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerstone.llm import media, webp
from ledgerstone.llm.webp import CROSS_COLOR, PREDICTOR, SUBTRACT_GREEN


def pictures(rng):
    def smooth(h, w):
        y, x = np.mgrid[:h, :w]
        return np.stack([x * 3 + y, x + y * 2, x * 2 + 40, np.full_like(x, 255)], -1).astype(np.uint8)

    noise = rng.integers(0, 256, (13, 17, 4), np.uint8)
    flat = np.full((9, 31, 4), 77, np.uint8)
    few = lambda k, h, w: rng.integers(0, 256, (k, 4), np.uint8)[rng.integers(0, k, (h, w))]
    lines = np.repeat(rng.integers(0, 256, (20, 1, 4), np.uint8), 48, 1)
    return [noise, flat, smooth(40, 33), smooth(1, 1), smooth(1, 70), smooth(70, 1), few(2, 11, 19), few(4, 11, 19), few(16, 23, 30), few(200, 60, 60), np.tile(noise, (3, 2, 1)), lines, rng.integers(97, 123, (20, 48, 4), np.uint8)]


@pytest.mark.parametrize("transforms", [(), (PREDICTOR,), (CROSS_COLOR,), (SUBTRACT_GREEN,), (PREDICTOR, CROSS_COLOR), (SUBTRACT_GREEN, PREDICTOR), (CROSS_COLOR, PREDICTOR, SUBTRACT_GREEN)])
@pytest.mark.parametrize("cache_bits, palette", [(0, "never"), (6, "auto"), (1, "always"), (10, "never")])
def test_round_trip(transforms, cache_bits, palette):
    images = pictures(np.random.default_rng(5))
    files = webp.encode(images, transforms, cache_bits, 3, palette)
    for im, back in zip(images, webp.decode(files)):
        assert back.shape == im.shape and (back == im).all()
    assert webp.encode(images[2:3], transforms, cache_bits, 3, palette) == files[2:3]  # a file doesn't depend on its batch


def test_compresses_and_rejects():
    flat = np.full((200, 200, 4), 9, np.uint8)
    assert len(webp.encode([flat])[0]) < 400
    good = webp.encode([flat])[0]
    for bad in (b"", b"RIFF1234WEBP", good[:60], good[:21] + b"\xff" * 40):
        with pytest.raises(ValueError):
            webp.decode([bad])
    assert webp.decode([]) == []


class _Bits:
    """A writer of single fields, for streams that the encoder doesn't make."""

    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value:0{n}b}"[::-1] if n else ""
        return self

    def simple(self, *symbols):
        self.put(1, 1).put(len(symbols) - 1, 1).put(1, 1).put(symbols[0], 8)
        return self.put(symbols[1], 8) if len(symbols) == 2 else self

    def file(self):
        raw = bytes(int(self.bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(self.bits), 8))
        raw += b"\0" * (len(raw) & 1)
        return b"RIFF" + (12 + len(raw)).to_bytes(4, "little") + b"WEBPVP8L" + len(raw).to_bytes(4, "little") + raw


def test_meta_codes_and_repeat_codes_by_hand():
    # 8 x 4 pixels, two blocks of 4 x 4 with a code of their own: red 10 on the left, red 20 or 30 on the right
    b = _Bits().put(0x2F, 8).put(7, 14).put(3, 14).put(1, 1).put(0, 3).put(0, 1)
    b.put(0, 1).put(1, 1).put(0, 3)  # no cache, meta codes, blocks of 4
    b.put(0, 1).simple(0, 1)  # entropy image: green is the group
    for _ in range(4):
        b.simple(0)
    b.put(0, 1).put(1, 1)
    b.simple(5).simple(10).simple(1).simple(255).simple(0)
    b.simple(6).simple(20, 30).simple(2).simple(255).simple(0)
    b.put(0b0110, 4).put(0, 4).put(0b1111, 4).put(0b1000, 4)
    im = webp.decode([b.file()])[0]
    assert (im[:, :4] == [10, 5, 1, 255]).all()
    assert im[:, 4:, 0].tolist() == [[20, 30, 30, 20], [20] * 4, [30] * 4, [20, 20, 20, 30]]
    assert (im[:, 4:, 1:] == [6, 2, 255]).all()


def test_texts(spark):
    texts = [None, "", "a", "é" * 96, "x" * 50_000, "Lorem ipsum " * 700, "".join(map(chr, range(32, 2000))), "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in media.media_round_trip(df, keep_media=True).collect()}
    for k, t in enumerate(texts):
        want, r = media.payload(t or ""), rows[k]
        assert r.payload_bytes == len(want) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert r.n_bytes == len((t or "").encode())
    assert rows[2][1:] == rows[7][1:] and rows[0][1:] == rows[1][1:]
    one = webp.encode([np.zeros((3, 5, 4), np.uint8)])[0]
    got = spark.createDataFrame([(bytearray(one),), (None,)], "f binary").select(media.decode_images(F.col("f")).alias("d")).collect()
    assert got[0].d.width == 5 and got[0].d.height == 3 and got[0].d.rgba == bytes(60) and got[1].d is None
    assert media.media_round_trip(df.limit(0)).collect() == []


def test_strips_get_the_transforms_that_suit_them():
    """Texts whose characters rise step by step are stored as differences; each file is as short as the best of all tries, and reads back."""
    rising = "".join(chr(0x4E00 + i) for i in range(2000))
    payloads = [media.payload(t) for t in (rising, "Lorem ipsum dolor " * 300, "".join(map(chr, np.random.default_rng(3).integers(97, 123, 4000))))]
    payloads.append(np.repeat(np.arange(0, 240, dtype=np.uint8), 4)[None, :].repeat(4, 0).tobytes())  # grey, one lighter each pixel
    stored = media.store(payloads)
    assert [p.tobytes() for p in media.read_back(stored)] == payloads
    strips = [np.frombuffer(p, np.uint8).reshape(-1, 48, 4)[:20] for p in payloads]
    plain, best = webp.encode(strips), webp.encode_best(strips)
    assert all(len(b) <= len(a) for a, b in zip(plain, best)) and len(best[3]) < len(plain[3])
    assert [media.split_files(s)[0] for s in stored] == best
    assert webp.encode_best(strips[3:]) == best[3:] and webp.encode_best([]) == []
