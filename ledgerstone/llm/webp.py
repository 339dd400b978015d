"""Lossless WebP on whole batches of images.

All images of a batch are read in step: each numpy operation reads the next symbol of every image that still has
one. Prefix codes are complete tables of each code's own depth. The decoder knows the whole lossless format: simple and
normal prefix codes, meta codes, back-references with the map of near distances, colour cache, and the inverse
of predictor, cross-colour, subtract-green and palette transforms. The encoder writes each of these but meta
codes, without a loop over pixels.
"""

from __future__ import annotations

import struct

import numpy as np

from .common import ragged_index

#: Fixed values of the format: order of the code lengths of code lengths, and the near distances (x, y).
_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_NEAR_X, _NEAR_Y = np.array(_NEAR).T
_CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
_BLACK = np.uint32(0xFF000000)


def _reversed_bits(depth: int) -> np.ndarray:
    out = np.zeros(1, np.int64)
    for _ in range(depth):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


_REVERSED = [_reversed_bits(d) for d in range(16)]


# -- decoding ------------------------------------------------------------------------------------------------


class _Bits:
    """Bit positions in many byte strings, read least significant bit first."""

    def __init__(self, parts: list[bytes]):
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.cumsum(size + 16) - size - 16
        self.data = b"".join(p + bytes(16) for p in parts) + bytes(16)
        self.window = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))
        self.pos = start * 8
        self.end = (start + size) * 8

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """The next 57 bits, at least."""
        p = self.pos[lanes]
        return self.window[np.minimum(p >> 3, len(self.window) - 1)] >> (p & 7).astype(np.uint64)

    def take(self, lanes: np.ndarray, n) -> np.ndarray:
        n = np.asarray(n, np.int64)
        out = self.peek(lanes) & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))
        self.pos[lanes] += n
        return out.astype(np.int64)


class _Codes:
    """Prefix codes as one flat array of tables: row r has 2**depth[r] entries of (symbol | length << 16) from base[r] on."""

    def __init__(self, lengths: np.ndarray):
        rows = len(lengths)
        row, sym = np.nonzero(lengths)
        size = lengths[row, sym].astype(np.int64)
        count = np.bincount(row, minlength=rows)
        single = count <= 1  # a lone symbol takes no bits
        size[single[row]] = 0
        depth = np.zeros(rows, np.int64)
        np.maximum.at(depth, row, size)
        lone = np.flatnonzero(count == 0)
        row, sym, size = np.r_[row, lone], np.r_[sym, np.zeros(len(lone), np.int64)], np.r_[size, np.zeros(len(lone), np.int64)]
        order = np.lexsort((sym, size, row))
        row, sym, size = row[order], sym[order], size[order]
        spread = np.int64(1) << (depth[row] - size)
        full = np.bincount(row, spread, rows).astype(np.int64)
        if (full != 1 << depth).any():
            raise ValueError("a prefix code is not complete")
        straight = np.repeat(sym | size << 16, spread).astype(np.int32)  # by the code's first bit first
        self.base = np.cumsum(full) - full
        self.depth, self.mask = depth, (np.int64(1) << depth) - 1
        self.table = np.empty_like(straight)
        for d in np.unique(depth):
            r = np.flatnonzero(depth == d)
            at = self.base[r][:, None]
            self.table[at + np.arange(1 << d)] = straight[at + _REVERSED[d]]

    def read(self, rows: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their lengths from the windows' lowest bits."""
        e = self.table[self.base[rows] + (window & self.mask[rows].astype(np.uint64)).astype(np.int64)]
        return e & 0xFFFF, e >> 16


def _read_lengths(bits: _Bits, lanes: np.ndarray, alphabet: np.ndarray, width: int) -> np.ndarray:
    """Code lengths of one prefix code for each lane."""
    out = np.zeros((len(lanes), width), np.int8)
    simple = bits.take(lanes, 1) == 1
    s = np.flatnonzero(simple)
    if len(s):
        two = bits.take(lanes[s], 1) == 1
        wide = bits.take(lanes[s], 1) == 1
        out[s, bits.take(lanes[s], np.where(wide, 8, 1))] = 1
        t = s[two]
        out[t, bits.take(lanes[t], 8)] = 1
    s = np.flatnonzero(~simple)
    if len(s):
        n = bits.take(lanes[s], 4) + 4
        of = np.zeros((len(s), 19), np.int8)
        for k, symbol in enumerate(_LENGTH_ORDER):
            m = np.flatnonzero(n > k)
            of[m, symbol] = bits.take(lanes[s[m]], 3)
        codes = _Codes(of)
        left = alphabet[s].copy()
        few = np.flatnonzero(bits.take(lanes[s], 1) == 1)
        width_of = 2 + 2 * bits.take(lanes[s[few]], 3)
        left[few] = 2 + bits.take(lanes[s[few]], width_of)
        at, last, live = np.zeros(len(s), np.int64), np.full(len(s), 8), np.arange(len(s))
        while True:
            live = live[(at[live] < alphabet[s[live]]) & (left[live] > 0)]
            if not len(live):
                break
            left[live] -= 1
            sym, size = codes.read(live, bits.peek(lanes[s[live]]))
            bits.pos[lanes[s[live]]] += size
            plain = sym < 16
            p = live[plain]
            out[s[p], at[p]] = sym[plain]
            last[p] = np.where(sym[plain] > 0, sym[plain], last[p])
            at[p] += 1
            for code, extra, least in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
                r = live[sym == code]
                if len(r):
                    run = least + bits.take(lanes[s[r]], extra)
                    if code == 16:
                        run = np.minimum(run, alphabet[s[r]] - at[r])
                        i = ragged_index(at[r], run)
                        out[np.repeat(s[r], run), i] = np.repeat(last[r], run)
                    at[r] += run
    return out


def _prefix_value(bits: _Bits, lanes: np.ndarray, sym: np.ndarray) -> np.ndarray:
    extra = np.maximum(sym - 2, 0) >> 1
    return np.where(sym < 4, sym, (2 + (sym & 1)) << extra) + bits.take(lanes, extra) + 1


def _read_pixels(bits: _Bits, lanes: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pixels (ARGB) of an entropy-coded image for each lane, flat, and where each begins."""
    n = len(lanes)
    has_cache = bits.take(lanes, 1) == 1
    cache_bits = np.zeros(n, np.int64)
    c = np.flatnonzero(has_cache)
    cache_bits[c] = bits.take(lanes[c], 4)
    groups, block_bits, block_wide = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    meta, meta_at = np.zeros(0, np.int64), np.zeros(n, np.int64)
    has_meta = np.zeros(n, bool)
    if main:
        has_meta = bits.take(lanes, 1) == 1
        m = np.flatnonzero(has_meta)
        if len(m):
            block_bits[m] = bits.take(lanes[m], 3) + 2
            side = np.int64(1) << block_bits[m]
            block_wide[m] = -(-width[m] // side)
            blocks, at = _read_pixels(bits, lanes[m], block_wide[m], -(-height[m] // side), False)
            meta = (blocks.astype(np.int64) >> 8) & 0xFFFF
            meta_at[m] = at
            groups[m] = np.maximum.reduceat(meta, at) + 1
    alphabet = 256 + 24 + np.where(has_cache, np.int64(1) << cache_bits, 0)
    first = np.cumsum(groups) - groups
    total = int(groups.sum())
    wide = int(alphabet.max()) if n else 280
    tables = [np.zeros((total, k), np.int8) for k in (wide, 256, 256, 256, 40)]
    for g in range(int(groups.max()) if n else 0):
        m = np.flatnonzero(groups > g)
        for k, t in enumerate(tables):
            size = alphabet[m] if k == 0 else np.full(len(m), t.shape[1])
            t[first[m] + g] = _read_lengths(bits, lanes[m], size, t.shape[1])
    green, red, blue, alpha, far = (_Codes(t) for t in tables)

    pixels = width * height
    start = np.cumsum(pixels) - pixels
    out = np.zeros(int(pixels.sum()), np.uint32)
    cache_at = np.cumsum(np.where(has_cache, np.int64(1) << cache_bits, 0))
    cache = np.zeros(int(cache_at[-1]) if n else 0, np.uint32)
    cache_at -= np.where(has_cache, np.int64(1) << cache_bits, 0)
    shift = (32 - cache_bits).astype(np.uint32)
    at, copying, distance = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(pixels > 0)
    any_meta, any_cache = bool(has_meta.any()), bool(has_cache.any())
    while len(live):
        color = np.zeros(len(live), np.uint32)
        fresh = np.flatnonzero(copying[live] == 0)
        if len(fresh):
            f = live[fresh]
            lane = lanes[f]
            row = first[f]
            if any_meta:
                b = block_bits[f]
                y, x = at[f] // width[f], at[f] % width[f]
                row = row + np.where(has_meta[f], meta[np.minimum(meta_at[f] + (y >> b) * block_wide[f] + (x >> b), max(len(meta) - 1, 0))], 0)
            w = bits.peek(lane)
            sym, used = green.read(row, w)
            lit = np.flatnonzero(sym < 256)
            if len(lit):
                r_, w_, u = row[lit], w[lit] >> used[lit].astype(np.uint64), used[lit]
                r, k = red.read(r_, w_)
                w_ >>= k.astype(np.uint64)
                b, k2 = blue.read(r_, w_)
                u = u + k + k2
                bits.pos[lane[lit]] += u
                a, k3 = alpha.read(r_, bits.peek(lane[lit]))
                bits.pos[lane[lit]] += k3
                color[fresh[lit]] = (a.astype(np.uint32) << np.uint32(24)) | (r.astype(np.uint32) << np.uint32(16)) | (sym[lit].astype(np.uint32) << np.uint32(8)) | b.astype(np.uint32)
            if len(lit) < len(fresh):
                rest = np.flatnonzero(sym >= 256)
                bits.pos[lane[rest]] += used[rest]
                back = rest[sym[rest] < 280]
                if len(back):
                    j, ln = f[back], lane[back]
                    copying[j] = _prefix_value(bits, ln, sym[back].astype(np.int64) - 256)
                    d, k = far.read(row[back], bits.peek(ln))
                    bits.pos[ln] += k
                    code = _prefix_value(bits, ln, d.astype(np.int64))
                    near = np.minimum(code, 120) - 1
                    distance[j] = np.where(code > 120, code - 120, np.maximum(_NEAR_X[near] + _NEAR_Y[near] * width[j], 1))
                    if (distance[j] > at[j]).any():
                        raise ValueError("a back-reference points before the image")
                hit = rest[sym[rest] >= 280]
                color[fresh[hit]] = cache[cache_at[f[hit]] + sym[hit] - 280]
        old = np.flatnonzero(copying[live] > 0)
        if len(old):
            j = live[old]
            color[old] = out[start[j] + at[j] - distance[j]]
            copying[j] -= 1
        out[start[live] + at[live]] = color
        if any_cache:
            k = live if has_cache.all() else live[has_cache[live]]
            col = color if has_cache.all() else color[has_cache[live]]
            cache[cache_at[k] + ((col * np.uint32(_CACHE_FACTOR)) >> shift[k])] = col
        at[live] += 1
        done = at[live] >= pixels[live]
        if done.any():
            live = live[~done]
    return out, start


def _channels(px: np.ndarray) -> np.ndarray:
    """ARGB values as rows (blue, green, red, alpha)."""
    return px.view(np.uint8).reshape(-1, 4).astype(np.int32)


def _packed(ch: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((ch & 255).astype(np.uint8)).view("<u4").ravel()


def _predict(mode: np.ndarray, L: np.ndarray, T: np.ndarray, TR: np.ndarray, TL: np.ndarray) -> np.ndarray:
    half = lambda a, b: (a + b) >> 1
    out = np.zeros_like(L)
    for m in np.unique(mode):
        k = np.flatnonzero(mode == m)
        l, t, tr, tl = L[k], T[k], TR[k], TL[k]
        if m == 0 or m > 13:
            p = np.tile([0, 0, 0, 255], (len(k), 1))
        elif m == 11:
            p = np.where((np.abs(t - tl).sum(1) < np.abs(l - tl).sum(1))[:, None], l, t)
        else:
            p = {1: lambda: l, 2: lambda: t, 3: lambda: tr, 4: lambda: tl, 5: lambda: half(half(l, tr), t), 6: lambda: half(l, tl), 7: lambda: half(l, t), 8: lambda: half(tl, t), 9: lambda: half(t, tr), 10: lambda: half(half(l, tl), half(t, tr)), 12: lambda: np.clip(l + t - tl, 0, 255), 13: lambda: np.clip(half(l, t) + ((half(l, t) - tl) / 2).astype(np.int32), 0, 255)}[int(m)]()
        out[k] = p
    return out


def _neighbours(ch: np.ndarray, i: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Predictions of the pixels at flat positions i; the image's edge has rules of its own."""
    left, top = np.maximum(i - 1, 0), np.maximum(i - w, 0)
    mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, mode))
    return _predict(mode, ch[left], ch[top], ch[np.minimum(top + 1, len(ch) - 1)], ch[np.maximum(top - 1, 0)])


def _block_of(width: np.ndarray, x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (y >> bits) * (-(-width // (np.int64(1) << bits))) + (x >> bits)


def _places(width: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all pixels of several images: the image, x and y; and where each image begins."""
    n = width * height
    lane = np.repeat(np.arange(len(n)), n)
    start = np.cumsum(n) - n
    k = np.arange(len(lane)) - start[lane]
    return lane, k % width[lane], k // width[lane], start


def _undo_predictor(px, width, height, modes, mode_at, bits):
    ch = _channels(px)
    n = width * height
    start = np.cumsum(n) - n
    live = np.flatnonzero(n > 0)
    k = 0
    while len(live):
        x, y, i = k % width[live], k // width[live], start[live] + k
        mode = modes[mode_at[live] + _block_of(width[live], x, y, bits[live])]
        ch[i] = (ch[i] + _neighbours(ch, i, x, y, width[live], mode)) & 255
        k += 1
        live = live[n[live] > k]
    return _packed(ch)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8).view(np.int8).astype(np.int32)


def _shifted(ch: np.ndarray, element: np.ndarray, sign: int) -> np.ndarray:
    """Cross-colour: adds (sign 1) or takes off (sign -1) what green and red say of red and blue."""
    e, out = _channels(element), ch.copy()
    step = lambda t, c: (_signed(t) * _signed(c)) >> 5
    red = ch[:, 2] + sign * step(e[:, 0], ch[:, 1])
    out[:, 2] = red & 255
    true_red = out[:, 2] if sign > 0 else ch[:, 2]
    out[:, 0] = (ch[:, 0] + sign * (step(e[:, 1], ch[:, 1]) + step(e[:, 2], true_red))) & 255
    return out


def _bundle_bits(colors: np.ndarray) -> np.ndarray:
    return np.where(colors <= 2, 3, np.where(colors <= 4, 2, np.where(colors <= 16, 1, 0)))


def decode(files: list[bytes]) -> list[np.ndarray]:
    """RGBA arrays (height, width, 4) of lossless WebP files."""
    parts = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:12] != b"WEBP":
            raise ValueError("not a WebP file")
        at = 12
        while f[at : at + 4] != b"VP8L":
            if at >= len(f):
                raise ValueError("no lossless image in the file")
            at += 8 + (struct.unpack_from("<I", f, at + 4)[0] + 1 & ~1)
        size = struct.unpack_from("<I", f, at + 4)[0]
        parts.append(f[at + 8 : at + 8 + size])
    if not parts:
        return []
    bits, lanes = _Bits(parts), np.arange(len(parts))
    if (bits.take(lanes, 8) != 0x2F).any():
        raise ValueError("a lossless image begins with another sign")
    width, height = bits.take(lanes, 14) + 1, bits.take(lanes, 14) + 1
    if (bits.take(lanes, 4) >> 1).any():
        raise ValueError("unknown version")
    coded = width.copy()
    steps: list[tuple[np.ndarray, int, tuple]] = []
    more = lanes
    while True:
        more = more[bits.take(more, 1) == 1]
        if not len(more):
            break
        kind = bits.take(more, 2)
        for k in (PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE):
            m = more[kind == k]
            if not len(m):
                continue
            if k in (PREDICTOR, CROSS_COLOR):
                b = bits.take(m, 3) + 2
                side = np.int64(1) << b
                data, at = _read_pixels(bits, m, -(-coded[m] // side), -(-height[m] // side), False)
                steps.append((m, k, (data, at, b)))
            elif k == PALETTE:
                n = bits.take(m, 8) + 1
                data, at = _read_pixels(bits, m, n, np.ones(len(m), np.int64), False)
                colors = [_packed(np.cumsum(_channels(data[a : a + c]), axis=0)) for a, c in zip(at, n)]
                steps.append((m, k, (colors, n, coded[m].copy())))
                coded[m] = -(-coded[m] // (1 << _bundle_bits(n)))
            else:
                steps.append((m, k, ()))
    flat, start = _read_pixels(bits, lanes, coded, height, True)
    if (bits.pos > bits.end).any():
        raise ValueError("an image ends too early")
    images = [flat[a : a + n] for a, n in zip(start, coded * height)]
    for m, k, arg in reversed(steps):
        own = np.concatenate([images[i] for i in m])
        w, h = coded[m], height[m]
        if k == PREDICTOR:
            data, at, b = arg
            new = _undo_predictor(own, w, h, (data >> 8 & 15).astype(np.int64), at, b)
        elif k == SUBTRACT_GREEN:
            ch = _channels(own)
            ch[:, [0, 2]] += ch[:, [1]]
            new = _packed(ch)
        elif k == CROSS_COLOR:
            data, at, b = arg
            lane, x, y, _ = _places(w, h)
            new = _packed(_shifted(_channels(own), data[at[lane] + _block_of(w[lane], x, y, b[lane])], 1))
        else:
            colors, n, full = arg
            bundle = _bundle_bits(n)
            lane, x, y, _ = _places(full, h)
            inner = np.cumsum(w * h) - w * h
            b = bundle[lane]
            g = own[inner[lane] + y * w[lane] + (x >> b)].astype(np.int64) >> 8 & 255
            depth = 8 >> b
            index = (g >> ((x & ((1 << b) - 1)) * depth)) & ((1 << depth) - 1)
            at = np.cumsum(n) - n
            table = np.concatenate(colors)
            new = np.where(index < n[lane], table[np.minimum(at[lane] + index, len(table) - 1)], np.uint32(0))
            coded[m] = full
        ends = np.cumsum(coded[m] * h)
        for i, a, e in zip(m, ends - coded[m] * h, ends):
            images[i] = new[a:e]
    out = []
    for px, w, h in zip(images, width, height):
        ch = px.view(np.uint8).reshape(h, w, 4)
        out.append(ch[:, :, [2, 1, 0, 3]])
    return out


# -- encoding ------------------------------------------------------------------------------------------------

_DEPTH = 11
#: Code lengths of the code lengths that the encoder uses: 0 to 11 and the two runs of zeros.
_OWN_SIZES = {0: 3, 5: 3, **dict.fromkeys((1, 2, 3, 4, 6, 7, 8, 9, 10, 11, 17, 18), 4)}
_OWN_CODES = {}
for _s, _n in sorted(_OWN_SIZES.items(), key=lambda x: (x[1], x[0])):
    _OWN_CODES[_s] = sum(2 ** (4 - n) for s, n in _OWN_SIZES.items() if (n, s) < (_n, _s)) >> (4 - _n)
_OWN_CODE = np.array([int(f"{_OWN_CODES.get(s, 0):0{_OWN_SIZES.get(s, 1)}b}"[::-1], 2) for s in range(19)], np.int64)
_OWN_SIZE = np.array([_OWN_SIZES.get(s, 0) for s in range(19)], np.int64)


class _Writer:
    """Bits of many images: segments are appended in the order of the stream, each a sorted list of lanes with values and sizes."""

    def __init__(self, lanes: int):
        self.lanes, self.segments = lanes, []
        self.filled = np.zeros(lanes, np.int64)

    def put(self, lane, value, size) -> None:
        lane = np.asarray(lane, np.int64)
        value, size = np.broadcast_to(np.asarray(value, np.int64), lane.shape), np.broadcast_to(np.asarray(size, np.int64), lane.shape)
        ends = np.cumsum(size)
        n = np.bincount(lane, size, self.lanes).astype(np.int64)
        before = np.cumsum(n) - n
        self.segments.append((lane, value, ends - size - before[lane] + self.filled[lane]))
        self.filled += n

    def finish(self) -> list[bytes]:
        size = -(-self.filled // 64) * 64 + 64
        base = np.cumsum(size) - size
        words = np.zeros(int(size.sum()) // 64 + 1, np.uint64)
        for lane, value, at in self.segments:
            p = base[lane] + at
            k, sh = p >> 6, (p & 63).astype(np.uint64)
            v = value.astype(np.uint64)
            np.add.at(words, k, v << sh)
            np.add.at(words, k + 1, np.where(sh > 0, v >> (np.uint64(64) - np.maximum(sh, np.uint64(1))), np.uint64(0)))
        data = words.tobytes()
        return [data[b // 8 : b // 8 + -(-f // 8)] for b, f in zip(base.tolist(), self.filled.tolist())]


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Complete prefix codes of at most _DEPTH bits for rows of counts: rounded from the logarithms, then put right unit by unit."""
    used = int((counts > 0).sum(1).max())
    order = np.argsort(-counts, axis=1, kind="stable")[:, :used]
    c = np.take_along_axis(counts, order, 1).astype(float)
    there = c > 0
    total = np.maximum(c.sum(1, keepdims=True), 1)
    size = np.where(there, np.clip(np.ceil(np.log2(total / np.maximum(c, 1e-9)) - 1e-9), 1, _DEPTH), 0).astype(np.int64)
    unit = np.where(there, np.int64(1) << (_DEPTH - size), 0)
    goal = 1 << _DEPTH
    rows = np.flatnonzero(there.sum(1) > 1)
    while True:  # too full: lengthen the rarest that can be
        over = rows[unit[rows].sum(1) > goal]
        if not len(over):
            break
        u = unit[over]
        last = used - 1 - np.argmax((u > 1)[:, ::-1], axis=1)
        unit[over, last] >>= 1
    while True:  # room left: shorten the most frequent that fits
        room = goal - unit[rows].sum(1)
        under = rows[room > 0]
        if not len(under):
            break
        fit = there[under] & (unit[under] <= room[room > 0][:, None])
        unit[under, np.argmax(fit, axis=1)] <<= 1
    size = np.where(unit > 0, _DEPTH - np.log2(np.maximum(unit, 1)).astype(np.int64), 0)
    size[there.sum(1) == 1] = np.where(there[there.sum(1) == 1], 1, 0)
    out = np.zeros(counts.shape, np.int64)
    np.put_along_axis(out, order, size, 1)
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, first bit lowest."""
    row, sym = np.nonzero(lengths)
    size = lengths[row, sym]
    order = np.lexsort((sym, size, row))
    row, sym, size = row[order], sym[order], size[order]
    unit = np.int64(1) << (_DEPTH - size)
    ends = np.cumsum(unit)
    n = np.bincount(row, unit, len(lengths)).astype(np.int64)
    at = ends - unit - (np.cumsum(n) - n)[row]
    out = np.zeros(lengths.shape, np.int64)
    out[row, sym] = _REVERSED[_DEPTH][at & ((1 << _DEPTH) - 1)]
    return out


def _put_tree(w: _Writer, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Writes one prefix code for each lane; returns the sizes that symbols then take (a lone symbol takes none)."""
    width = lengths.shape[1]
    used = (lengths > 0).sum(1)
    first = np.argmax(lengths > 0, axis=1)
    simple = (used <= 1) & (first < 256)
    head = np.where(used == 0, 1, 1 | 4 | first << 3)
    size = np.where(used == 0, 4, 11)
    plain = ~simple
    order = _LENGTH_ORDER[:15]
    normal = (len(order) - 4) << 1
    for k, s in enumerate(order):
        normal |= _OWN_SIZES.get(s, 0) << (5 + 3 * k)
    w.put(lanes, np.where(plain, normal, head), np.where(plain, 5 + 3 * len(order) + 1, size))
    k = np.flatnonzero(plain)
    if len(k):
        flat = lengths[k].ravel()
        zero = flat == 0
        edge = np.r_[True, zero[1:] != zero[:-1]]
        edge[::width] = True
        at = np.flatnonzero(edge)
        run = np.diff(np.r_[at, len(flat)])
        zruns = zero[at]
        za, zn = at[zruns], run[zruns]
        lit = np.flatnonzero(~zero)
        whole = zn // 138
        rest = zn % 138
        ca = np.repeat(za, whole) + 138 * ragged_index(np.zeros(len(za), np.int64), whole)
        ra, rn = za[rest > 0] + 138 * whole[rest > 0], rest[rest > 0]
        rsym = np.where(rn >= 11, 18, np.where(rn >= 3, 17, 0))
        rval = np.where(rn >= 11, _OWN_CODE[18] | (rn - 11) << _OWN_SIZE[18], np.where(rn >= 3, _OWN_CODE[17] | (rn - 3) << _OWN_SIZE[17], _OWN_CODE[0] | np.where(rn == 2, _OWN_CODE[0] << _OWN_SIZE[0], 0)))
        rsize = np.where(rsym == 18, _OWN_SIZE[18] + 7, np.where(rsym == 17, _OWN_SIZE[17] + 3, _OWN_SIZE[0] * rn))
        where = np.r_[lit, ca, ra]
        value = np.r_[_OWN_CODE[flat[lit]], np.full(len(ca), _OWN_CODE[18] | 127 << _OWN_SIZE[18]), rval]
        bits = np.r_[_OWN_SIZE[flat[lit]], np.full(len(ca), _OWN_SIZE[18] + 7), rsize]
        o = np.argsort(where, kind="stable")
        w.put(lanes[k[where[o] // width]], value[o], bits[o])
    return np.where((used == 1)[:, None], 0, lengths)


def _value_prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of values from 1 on."""
    x = v - 1
    h = np.where(x >= 4, np.log2(np.maximum(x, 1)).astype(np.int64), 0)
    extra = np.maximum(h - 1, 0)
    return np.where(x < 4, x, 2 * h + (x >> extra & 1)), np.where(x < 4, 0, x & ((np.int64(1) << extra) - 1)), np.where(x < 4, 0, extra)


def _put_pixels(w: _Writer, lanes: np.ndarray, px: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool, cache_bits: int = 0) -> None:
    """Writes an entropy-coded image for each of the lanes (sorted); px holds their pixels one after the other."""
    lane, _, _, start = _places(width, height)
    n = width * height
    total = len(px)
    token = np.ones(total, bool)
    length, distance = np.zeros(total, np.int64), np.zeros(total, np.int64)
    if main and total > 1:
        key = px.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.r_[px[1:], px[:1]].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ (lane.astype(np.uint64) + np.uint64(1)) * np.uint64(0x165667B19E3779F9)
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        end = start[lane] + n[lane] - 1
        same = (key[a] == key[b]) & (lane[a] == lane[b]) & (b < end[b]) & (a < end[a]) & (px[a] == px[b])
        same[same] = px[a[same] + 1] == px[b[same] + 1]
        gap = np.zeros(total + 1, np.int64)
        gap[b[same]] = b[same] - a[same]
        head = np.flatnonzero((gap[:-1] > 0) & np.r_[True, gap[1:-1] != gap[:-2]])
        stop = np.flatnonzero((gap[:-1] > 0) & (gap[1:] != gap[:-1])) + 1
        run = stop - head + (gap[stop] == 0)
        good = run >= 3
        head, run = head[good], run[good]
        token[ragged_index(head + 1, run - 1)] = False
        length[head], distance[head] = run, gap[head]
    hit = np.full(total, -1, np.int64)
    if cache_bits:
        slot = ((px * np.uint32(_CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.int64)
        order = np.argsort(lane << cache_bits | slot, kind="stable")
        a, b = order[:-1], order[1:]
        same = (lane[a] == lane[b]) & (slot[a] == slot[b]) & (px[a] == px[b])
        hit[b[same]] = slot[b[same]]
    at = np.flatnonzero(token)
    ln, back = lane[at], length[at] > 0
    lsym, lval, lbits = _value_prefix(np.maximum(length[at], 1))
    d = distance[at]
    dcode = np.where(d == width[ln], 1, np.where(d == 1, 2, d + 120))
    dsym, dval, dbits = _value_prefix(np.maximum(dcode, 1))
    cached = ~back & (hit[at] >= 0)
    plain = ~back & ~cached
    p = px[at].astype(np.int64)
    g = np.where(back, 256 + lsym, np.where(cached, 280 + hit[at], p >> 8 & 255))
    wide = 280 + (1 << cache_bits if cache_bits else 0)
    m = len(lanes)

    def counted(symbols, mask, size):
        return np.bincount(ln[mask] * size + symbols[mask], minlength=m * size).reshape(m, size)

    everywhere = np.ones(len(at), bool)
    counts = [counted(g, everywhere, wide), counted(p >> 16 & 255, plain, 256), counted(p & 255, plain, 256), counted(p >> 24 & 255, plain, 256), counted(dsym, back, 40)]
    lone = ((counts[0] > 0).sum(1) == 1) & (np.argmax(counts[0] > 0, axis=1) >= 256)
    counts[0][lone, 0] += 1  # a lone symbol must be a colour
    w.put(lanes, (1 | cache_bits << 1) if cache_bits else 0, 5 if cache_bits else 1)
    if main:
        w.put(lanes, 0, 1)
    sizes, codes = [], []
    for c in counts:
        lengths = _code_lengths(c)
        codes.append(_codes(lengths))
        sizes.append(_put_tree(w, lanes, lengths))
    c0, n0 = codes[0][ln, g] * (sizes[0][ln, g] > 0), sizes[0][ln, g]
    r, b, a = p >> 16 & 255, p & 255, p >> 24 & 255
    value, size = c0.copy(), n0.copy()
    for code, sz, s in ((codes[1], sizes[1], r), (codes[2], sizes[2], b), (codes[3], sizes[3], a)):
        k = np.where(plain, sz[ln, s], 0)
        value |= np.where(k > 0, code[ln, s], 0) << size
        size += k
    value |= np.where(back, lval, 0) << size
    size += np.where(back, lbits, 0)
    k = np.where(back, sizes[4][ln, np.minimum(dsym, 39)], 0)
    value |= np.where(k > 0, codes[4][ln, np.minimum(dsym, 39)], 0) << size
    size += k
    value |= np.where(back, dval, 0) << size
    size += np.where(back, dbits, 0)
    w.put(lanes[ln], value, size)


def encode(images: list[np.ndarray], transforms: tuple = (), cache_bits: int = 6, block_bits: int = 4, palette: str = "auto") -> list[bytes]:
    """Lossless WebP files of RGBA arrays (height, width, 4) of up to 16384 pixels a side.

    transforms: of PREDICTOR, CROSS_COLOR and SUBTRACT_GREEN, for all images; palette "auto" takes the palette instead where an
    image has at most 256 colours, fewer than a third of its pixels; "never" and "always" (where possible) say so for all."""
    if not images:
        return []
    height, width = (np.array([im.shape[k] for im in images], np.int64) for k in (0, 1))
    n = width * height
    px = np.concatenate([np.ascontiguousarray(im[:, :, [2, 1, 0, 3]], np.uint8).reshape(-1, 4) for im in images]).view("<u4").ravel()
    lane, x, y, start = _places(width, height)
    w, lanes = _Writer(len(images)), np.arange(len(images))
    w.put(lanes, 0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    key = lane << 32 | px.astype(np.int64)
    colors, index = np.unique(key, return_inverse=True)
    of = colors >> 32
    count = np.bincount(of, minlength=len(images))
    use = count <= 256
    use &= {"auto": count * 3 < n, "always": True, "never": False}[palette]
    coded = width.copy()
    out = px
    if use.any():
        m = lanes[use]
        base = np.cumsum(count) - count
        w.put(m, 1 | PALETTE << 1 | (count[m] - 1) << 3, 11)
        mine = use[of]
        ch = _channels((colors[mine] & 0xFFFFFFFF).astype("<u4"))
        ends = np.cumsum(count[m])
        delta = ch.copy()
        delta[1:] -= ch[:-1]
        delta[ends[:-1]] = ch[ends[:-1]]
        _put_pixels(w, m, _packed(delta), count[m], np.ones(len(m), np.int64), False)
        bundle = np.where(use, _bundle_bits(count), 0)
        coded = -(-width // (1 << bundle))
        inner = coded * height
        at = (np.cumsum(inner) - inner)[lane] + y * coded[lane] + (x >> bundle[lane])
        b = bundle[lane]
        number = (index - base[lane]) << ((x & ((1 << b) - 1)) * (8 >> b))
        packed = np.zeros(int(inner.sum()), np.int64)
        np.add.at(packed, at, np.where(use[lane], number << 8, px.astype(np.int64)))
        out = (packed | np.where(np.repeat(use, inner), 0xFF000000, 0)).astype("<u4")
    m = lanes[~use]
    if transforms and len(m):
        pick = np.repeat(~use, coded * height)
        own, ww, hh = out[pick], width[m], height[m]
        own_lane, ox, oy, own_start = _places(ww, hh)
        bb = np.full(len(m), block_bits)
        bw, bh = -(-ww // (1 << block_bits)), -(-hh // (1 << block_bits))
        block = (np.cumsum(bw * bh) - bw * bh)[own_lane] + _block_of(ww[own_lane], ox, oy, bb[own_lane])
        for t in transforms:
            if t == SUBTRACT_GREEN:
                w.put(m, 1 | t << 1, 3)
                ch = _channels(own)
                ch[:, [0, 2]] -= ch[:, [1]]
                own = _packed(ch)
                continue
            w.put(m, 1 | t << 1 | (block_bits - 2) << 3, 6)
            if t == PREDICTOR:
                ch = _channels(own)
                i = own_start[own_lane] + oy * ww[own_lane] + ox
                cost = np.full((14, int((bw * bh).sum())), np.inf)
                for mode in range(14):
                    d = (ch - _neighbours(ch, i, ox, oy, ww[own_lane], np.full(len(i), mode))) & 255
                    cost[mode] = np.bincount(block, np.minimum(d, 256 - d).sum(1), cost.shape[1])
                best = cost.argmin(0)
                _put_pixels(w, m, (_BLACK | best.astype(np.uint32) << np.uint32(8)).astype("<u4"), bw, bh, False)
                own = _packed(ch - _neighbours(ch, i, ox, oy, ww[own_lane], best[block]))
            else:
                ch = _channels(own)
                cost, tries = [], [(0, 0, 0), (32, 0, 0), (0, 32, 0), (32, 32, 0), (0, 0, 32), (224, 224, 0), (16, 16, 0)]
                for gr, gb, rb in tries:
                    e = np.full(len(own), 0xFF000000 | rb << 16 | gb << 8 | gr, "<u4")
                    d = _shifted(ch, e, -1)
                    cost.append(np.bincount(block, np.minimum(d, 256 - d)[:, [0, 2]].sum(1), int((bw * bh).sum())))
                best = np.argmin(cost, 0)
                element = np.array([0xFF000000 | rb << 16 | gb << 8 | gr for gr, gb, rb in tries], "<u4")[best]
                _put_pixels(w, m, element, bw, bh, False)
                own = _packed(_shifted(ch, element[block], -1))
        out = out.copy()
        out[pick] = own
    w.put(lanes, 0, 1)
    _put_pixels(w, lanes, out, coded, height, True, cache_bits)
    files = []
    for body in w.finish():
        pad = len(body) & 1
        files.append(b"RIFF" + struct.pack("<I", 12 + len(body) + pad) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + bytes(pad))
    return files


#: What encode_best tries besides no transform.
TRIED = ((SUBTRACT_GREEN,), (PREDICTOR,), (SUBTRACT_GREEN, PREDICTOR), (CROSS_COLOR, PREDICTOR))


def likely_transforms(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which images may gain by taking green off, and which by prediction: the entropy of their samples is lower then, each from its left neighbour in the latter case."""
    height, width = (np.array([im.shape[k] for im in images], np.int64) for k in (0, 1))
    flat = np.concatenate([np.ascontiguousarray(im, np.uint8).reshape(-1, 4) for im in images])
    lane, x, _, _ = _places(width, height)
    place = (lane[:, None] * 4 + np.arange(4)) << 8

    def bits(samples: np.ndarray) -> np.ndarray:
        counts = np.bincount((place + samples).ravel(), minlength=len(images) << 10).reshape(len(images), 4, 256)
        return (width * height)[:, None] * np.log2(np.maximum((width * height)[:, None], 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(2)

    def less_green(a: np.ndarray) -> np.ndarray:
        out = a.copy()
        out[:, [0, 2]] -= a[:, [1]]
        return out

    left = flat.copy()
    left[1:] -= flat[:-1]
    left[x == 0] = 0  # a row's first samples are predicted from above
    plain, green, spatial = bits(flat).sum(1), bits(less_green(flat)).sum(1), np.minimum(bits(left).sum(1), bits(less_green(left)).sum(1))
    return green < plain, spatial < plain


def encode_best(images: list[np.ndarray], cache_bits: int = 6) -> list[bytes]:
    """As encode, with the transforms that make each image's file shortest, of those that its entropies speak for."""
    if not images:
        return []
    files = encode(images, (), cache_bits)
    green, spatial = likely_transforms(images)
    for transforms in TRIED:
        at = np.flatnonzero(spatial if PREDICTOR in transforms else green).tolist()
        for i, f in zip(at, encode([images[i] for i in at], transforms, cache_bits, palette="never")):
            if len(f) < len(files[i]):
                files[i] = f
    return files
