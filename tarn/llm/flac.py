"""FLAC in numpy: an encoder for 8-bit mono samples, and decoders.

``decode_frames`` decodes very many frames side by side: step i reads sample i
of every frame, so a step is a few vector operations however the Rice codes
fall. ``decode_stream`` reads one stream frame after frame in plain Python; it
takes any channel layout, and those rare frames the other one hands it.

Both check the header's CRC-8 and the frame's CRC-16. Streams written here hold a
seek point per frame, which is what lets frames be found without decoding.
"""

from __future__ import annotations

import hashlib

import numpy as np

BLOCK, RATE, BITS = 2048, 8000, 8
LPC_ORDER, LPC_PRECISION, LPC_SHIFT = 4, 12, 9
MAX_RICE = 14
BLOCK_CODE = BLOCK.bit_length() - 1  # of 256 and twice that and so on: 8 and up

# Fixed values of the format.
_BLOCK_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}
_SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class Broken(ValueError):
    """The bytes are no valid stream or a checksum differs."""


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = []
    for b in range(256):
        c = b << (width - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (width - 1) & 1 else c << 1
        out.append(c & ((1 << width) - 1))
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CRC8_LIST, _CRC16_LIST = _CRC8.tolist(), _CRC16.tolist()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8_LIST[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC16_LIST[(c >> 8) ^ b] ^ (c << 8 & 0xFFFF)
    return c


def crc16_many(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """CRC-16 of each range of buf, all ranges side by side."""
    order = np.argsort(-lens, kind="stable")
    at, n = starts[order], lens[order]
    live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
    c = np.zeros(len(n), np.uint16)
    for i, k in enumerate(live.tolist()):
        x = c[:k]
        c[:k] = _CRC16[(x >> np.uint16(8)) ^ buf[at[:k] + i]] ^ (x << np.uint16(8))
    out = np.empty_like(c)
    out[order] = c
    return out


def _frame_number(n: int) -> bytes:
    """The format's UTF-8 like coding of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >> (6 * more + 6 - more):
        more += 1
    lead = (0xFF << (7 - more)) & 0xFF
    return bytes([lead | n >> (6 * more), *(0x80 | n >> (6 * i) & 0x3F for i in reversed(range(more)))])


def _header(number: int, n: int) -> bytes:
    head = bytes([0xFF, 0xF8])
    if n == BLOCK:
        head += bytes([BLOCK_CODE << 4 | 4, 0x02]) + _frame_number(number)
    else:
        head += bytes([0x74, 0x02]) + _frame_number(number) + (n - 1).to_bytes(2, "big")
    return head + bytes([crc8(head)])


_headers: dict[tuple[int, int], bytes] = {}


def _kept_header(number: int, n: int) -> bytes:
    got = _headers.get((number, n))
    if got is None:
        got = _header(number, n)
        if len(_headers) < 4096:
            _headers[number, n] = got
    return got


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _lpc(x: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients (frames x LPC_ORDER) from autocorrelation, by Levinson and Durbin."""
    f = x.astype(np.float32)
    n = x.shape[1]
    r = [np.einsum("ij,ij->i", f[:, : n - k], f[:, k:]).astype(np.float64) for k in range(LPC_ORDER + 1)]
    a = np.zeros((LPC_ORDER, len(x)))
    err = r[0] + 1e-9
    for i in range(LPC_ORDER):
        k = (r[i + 1] - sum(a[j] * r[i - j] for j in range(i))) / err
        new = a.copy()
        new[i] = k
        for j in range(i):
            new[j] = a[j] - k * a[i - 1 - j]
        a, err = new, np.maximum(err * (1 - k * k), 1e-9)
    top = (1 << (LPC_PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << LPC_SHIFT)), -top, top).astype(np.int32).T


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best parameter and bits of each row of folded residuals."""
    n = u.shape[1]
    mean = u.sum(1, dtype=np.int64) / max(n, 1)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean, 1))).astype(np.int32), 0, MAX_RICE)
    best_k, best = None, None
    for k in (np.maximum(k0 - 1, 0), k0):
        cost = (u >> k[:, None]).sum(1, dtype=np.int64) + n * (1 + k)
        if best is None:
            best_k, best = k, cost
        else:
            best_k, best = np.where(cost < best, k, best_k), np.minimum(cost, best)
    return best_k, best


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of equal size (rows of int32 samples) as (bytes, bounds); numbers are the frames' own."""
    m, n = x.shape
    heads = [_kept_header(int(k), n) for k in numbers]
    residual, extra, kind = [], [], []
    for order in range(3):
        r = np.diff(x, order, axis=1) if order else x
        residual.append(r)
        extra.append(order * BITS)
        kind.append(8 + order)
    coef = _lpc(x)
    if n > LPC_ORDER:
        pred = np.zeros((m, n - LPC_ORDER), np.int32)
        for j in range(LPC_ORDER):
            pred += coef[:, j, None] * x[:, LPC_ORDER - 1 - j : n - 1 - j]
        residual.append(x[:, LPC_ORDER:] - (pred >> LPC_SHIFT))
        extra.append(LPC_ORDER * (BITS + LPC_PRECISION) + 9)
        kind.append(32 + LPC_ORDER - 1)
    folded = [(r << 1) ^ (r >> 31) for r in residual]
    ks, costs = zip(*(_rice(u) for u in folded), strict=True)
    cost = np.stack([c + e + 10 for c, e in zip(costs, extra, strict=True)])
    pick = cost.argmin(0)
    size = cost[pick, np.arange(m)]
    pick = np.where(size >= n * BITS, -1, pick)  # verbatim
    pick = np.where((x == x[:, :1]).all(1), -2, pick)  # constant
    size = np.where(pick == -1, n * BITS, np.where(pick == -2, BITS, size))
    head = np.array([len(h) for h in heads])
    length = head + 1 + (size + 7) // 8 + 2
    bounds = np.concatenate(([0], np.cumsum(length)))
    bits = np.zeros(int(bounds[-1]) * 8, np.uint8)
    at = (bounds[:-1] + head + 1) * 8

    sample = x & 0xFF
    for p in (-1, -2):
        own = np.flatnonzero(pick == p)
        if len(own):
            many = n if p == -1 else 1
            _put(bits, (at[own, None] + BITS * np.arange(many)).ravel(), sample[own, :many].ravel(), BITS)
    for p, u in enumerate(folded):
        for k in np.unique(ks[p][pick == p]).tolist():
            own = np.flatnonzero((pick == p) & (ks[p] == k))
            order = n - u.shape[1]
            pos = at[own]
            for j in range(order):
                _put(bits, pos, sample[own, j], BITS)
                pos = pos + BITS
            if kind[p] >= 32:
                _put(bits, pos, np.full(len(own), LPC_PRECISION - 1), 4)
                _put(bits, pos + 4, np.full(len(own), LPC_SHIFT), 5)
                pos = pos + 9
                for j in range(order):
                    _put(bits, pos, coef[own, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
                    pos = pos + LPC_PRECISION
            _put(bits, pos, np.full(len(own), k), 10)  # method 0, one partition, its parameter
            v = u[own]
            q = v >> k
            end = np.cumsum(q + (1 + k), axis=1, dtype=np.int64) + (pos + 10)[:, None]
            stop = (end - (k + 1)).ravel()
            bits[stop] = 1
            if k:
                low = ((v & ((1 << k) - 1)) << (16 - k)).ravel().astype(">u2")
                low = np.unpackbits(low.view(np.uint8).reshape(-1, 2), axis=1)
                for j in range(k):
                    bits[stop + (j + 1)] = low[:, j]
    out = np.packbits(bits)
    kinds = np.array([*kind, 0, 1])  # the last two for pick -2 and -1
    out[bounds[:-1] + head] = kinds[pick] << 1
    same = np.arange(int(head.max()))
    raw = np.array([list(h.ljust(len(same), b"\0")) for h in heads], np.uint8)
    own = same < head[:, None]
    out[(bounds[:-1, None] + same)[own]] = raw[own]
    c = crc16_many(out, bounds[:-1], length - 2)
    out[bounds[1:] - 2], out[bounds[1:] - 1] = c >> 8, c & 0xFF
    return out, bounds


def encode_many(samples: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A stream for each range of int8 samples; every range has at least one sample."""
    n = np.diff(offs)
    per = -(-n // BLOCK)
    doc = np.repeat(np.arange(len(n)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[doc] + number * BLOCK
    size = np.minimum(BLOCK, offs[doc + 1] - start)
    coded: list[bytes] = [b""] * len(doc)
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size == s)
        step = max(1, (1 << 20) // s)
        for i in range(0, len(own), step):
            part = own[i : i + step]
            out, bounds = encode_frames(samples[start[part, None] + np.arange(s)].astype(np.int32), number[part])
            raw = out.tobytes()
            for f, a, b in zip(part.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                coded[f] = raw[a:b]
    streams, f = [], 0
    for d, k in enumerate(per.tolist()):
        own = coded[f : f + k]
        lens = [len(c) for c in own]
        total = int(n[d])
        blocks = (BLOCK, BLOCK) if total > BLOCK else (max(16, total),) * 2
        info = blocks[0].to_bytes(2, "big") + blocks[1].to_bytes(2, "big") + min(lens).to_bytes(3, "big") + max(lens).to_bytes(3, "big")
        info += (RATE << 44 | (BITS - 1) << 36 | total).to_bytes(8, "big") + hashlib.md5(samples[offs[d] : offs[d + 1]].tobytes()).digest()
        at = np.cumsum([0, *lens[:-1]])
        points = np.zeros(k, [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        points["sample"], points["at"], points["n"] = np.arange(k) * BLOCK, at, size[f : f + k]
        streams.append(b"".join([b"fLaC", b"\x00\x00\x00\x22", info, b"\x83", (18 * k).to_bytes(3, "big"), points.tobytes(), *own]))
        f += k
    return streams


def metadata(stream: bytes) -> dict:
    """STREAMINFO, the seek points and where frames begin."""
    if stream[:4] != b"fLaC":
        raise Broken("no fLaC marker")
    at, out, last = 4, {"seek": None}, False
    while not last:
        if at + 4 > len(stream):
            raise Broken("cut off in the metadata")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "total": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            out["seek"] = np.frombuffer(body, [("sample", ">u8"), ("at", ">u8"), ("n", ">u2")])
        at += 4 + size
    if "total" not in out:
        raise Broken("no STREAMINFO")
    return out | {"frames": at}


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.pos = data, at * 8

    def take(self, n: int) -> int:
        a, b = self.pos >> 3, (self.pos + n + 7) >> 3
        if b > len(self.data):
            raise Broken("cut off in a frame")
        got = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.pos - n) & ((1 << n) - 1)
        self.pos += n
        return got

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        q = 0
        while not self.take(1):
            q += 1
        return q


def _subframe(b: _Bits, n: int, bits: int) -> list[int]:
    b.take(1)
    kind, wasted = b.take(6), b.take(1)
    if wasted:
        wasted = b.unary() + 1
        bits -= wasted
    if kind == 0:
        x = [b.signed(bits)] * n
    elif kind == 1:
        x = [b.signed(bits) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [b.signed(bits) for _ in range(order)]
        coef, shift = _FIXED[order] if kind < 32 else (), 0
        if kind >= 32:
            precision, shift = b.take(4) + 1, b.signed(5)
            coef = [b.signed(precision) for _ in range(order)]
        wide, parts = 4 + b.take(2), b.take(4)
        for p in range(1 << parts):
            k = b.take(wide)
            raw = b.take(5) if k == (1 << wide) - 1 else None
            for _ in range((n >> parts) - (order if p == 0 else 0)):
                if raw is None:
                    u = b.unary() << k | b.take(k)
                    r = u >> 1 ^ -(u & 1)
                else:
                    r = b.signed(raw)
                x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
    else:
        raise Broken("reserved subframe type")
    return [v << wasted for v in x] if wasted else x


def _frame(data: bytes, at: int, bits: int) -> tuple[list[list[int]], int]:
    """Channels of the frame at byte ``at``, and the byte after it."""
    b = _Bits(data, at)
    if b.take(14) != 0x3FFE or b.take(1):
        raise Broken("no frame sync")
    b.take(1)
    size, rate, layout, width = b.take(4), b.take(4), b.take(4), b.take(3)
    b.take(1)
    lead = b.take(8)
    for _ in range(max(0, 8 - (lead ^ 0xFF).bit_length() - 1) if lead >= 0xC0 else 0):
        b.take(8)
    n = b.take(8) + 1 if size == 6 else b.take(16) + 1 if size == 7 else _BLOCK_SIZES.get(size, 0)
    if rate >= 12:
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
    head = b.pos >> 3
    if b.take(8) != crc8(data[at:head]) or not n:
        raise Broken("a header's checksum differs")
    bits = _SAMPLE_BITS.get(width, bits)
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    x = [_subframe(b, n, bits + (side == c)) for c in range(2 if side is not None else layout + 1)]
    if layout == 8:
        x[1] = [p - q for p, q in zip(*x, strict=True)]
    elif layout == 9:
        x[0] = [p + q for p, q in zip(*x, strict=True)]
    elif layout == 10:
        mid = [2 * p | q & 1 for p, q in zip(*x, strict=True)]
        x = [[(m + s) >> 1 for m, s in zip(mid, x[1], strict=True)], [(m - s) >> 1 for m, s in zip(mid, x[1], strict=True)]]
    end = (b.pos + 7) >> 3
    if int.from_bytes(data[end : end + 2], "big") != crc16(data[at:end]):
        raise Broken("a frame's checksum differs")
    return x, end + 2


def decode_stream(stream: bytes) -> list[list[int]]:
    """The samples of each channel of any stream, frame after frame."""
    info = metadata(stream)
    at, out = info["frames"], [[] for _ in range(info["channels"])]
    while at < len(stream):
        x, at = _frame(stream, at, info["bits"])
        for o, c in zip(out, x, strict=True):
            o += c
    return out


def decode_frames(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit mono frames, side by side: (samples x frames as int32, samples of each)."""
    m = len(starts)
    buf = np.concatenate((buf, np.zeros(64, np.uint8)))
    if (crc16_many(buf, starts, ends - starts) != 0).any():  # a CRC with its own checksum leaves 0
        raise Broken("a frame's checksum differs")
    if ((buf[starts] != 0xFF) | (buf[starts + 1] & 0xFE != 0xF8)).any():
        raise Broken("no frame sync")
    code, rate, layout = buf[starts + 2] >> 4, buf[starts + 2] & 15, buf[starts + 3]
    lead = buf[starts + 4]
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    at = starts + 4 + number
    table = np.array([_BLOCK_SIZES.get(i, 0) for i in range(16)])
    n = np.select([code == 6, code == 7], [buf[at].astype(np.int64) + 1, (buf[at].astype(np.int64) << 8 | buf[at + 1]) + 1], table[code])
    at = at + (code == 6) + 2 * (code == 7) + np.select([rate == 12, rate == 13, rate == 14], [1, 2, 2], 0)
    c = np.zeros(m, np.uint16)
    for i in range(int((at - starts).max()) if m else 0):
        c = np.where(starts + i < at, _CRC8[(c ^ buf[starts + i]) & 0xFF], c)
    if (c != buf[at]).any() or (n == 0).any() or (layout & 0xFE != 2).any():
        raise Broken("a header's checksum differs, or it isn't 8-bit mono")
    head = buf[at + 1]
    kind, pos = (head >> 1).astype(np.int64), (at + 2) * 8
    out = np.zeros((int(n.max()) if m else 0, m), np.int32)
    slow = (head & 1 == 1) | ~((kind < 2) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))
    for s in np.unique(n[kind == 1]).tolist():
        own = np.flatnonzero((kind == 1) & (n == s) & ~slow)
        out[:s, own] = buf[(at[own] + 2) + np.arange(s)[:, None]].view(np.int8)
    own = np.flatnonzero((kind == 0) & ~slow)
    out[:, own] = np.where(np.arange(len(out))[:, None] < n[own], buf[at[own] + 2].view(np.int8), 0)

    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, 8)).view(">u8").ravel().astype(np.uint64)
    u64 = np.uint64

    def peek(p: np.ndarray, width: int) -> np.ndarray:
        return (words[p >> 3] << (p & 7).astype(u64) >> u64(64 - width)).astype(np.int64)

    coded = np.flatnonzero((kind >= 8) & ~slow)
    coded = coded[np.argsort(-n[coded], kind="stable")]
    size, kinds, p = n[coded], kind[coded], pos[coded]
    order = np.where(kinds >= 32, kinds - 31, kinds - 8)
    top = int(order.max()) if len(order) else 0
    x = np.zeros((int(size[0]) if len(size) else 0, len(coded)), np.int32)
    for j in range(top):
        own = order > j
        x[j] = np.where(own, peek(p, 8).astype(np.int8), 0)
        p = p + 8 * own
    lpc = kinds >= 32
    coef, shift = np.zeros((max(top, 1), len(coded)), np.int64), np.zeros(len(coded), np.int64)
    if lpc.any():
        precision = peek(p, 4) + 1
        shift = np.where(lpc, peek(p + 4, 5), 0)
        p = p + 9 * lpc
        for j in range(top):
            own = lpc & (order > j)
            v = (words[p >> 3] << (p & 7).astype(u64) >> (u64(64) - precision.astype(u64))).astype(np.int64)
            coef[j] = np.where(own, v - ((v >> (precision - 1)) << precision), 0)
            p = p + np.where(own, precision, 0)
    method, parts = peek(p, 2), peek(p + 2, 4)
    p = (p + 6).astype(np.int64)
    odd = np.zeros(len(coded), bool)  # to be read one by one
    wide = np.where(method == 1, 5, 4)
    k = np.zeros(len(coded), u64)
    begins: dict[int, list[np.ndarray]] = {}  # step -> frames whose next partition begins there
    for q in np.unique(parts).tolist():
        own = np.flatnonzero(parts == q)
        for s in np.unique(size[own]).tolist():
            same = own[size[own] == s]
            for i in range(1 << q):
                if i:
                    begins.setdefault(i * (s >> q), []).append(same)
                else:
                    for o in np.unique(order[same]).tolist():
                        begins.setdefault(o, []).append(same[order[same] == o])
    live = np.searchsorted(-size, -np.arange(len(x)), "left")
    one, low52 = u64(1), u64(11)
    for i, count in enumerate(live.tolist()):
        for own in begins.get(i, ()):
            got = peek(p[own], 5)
            got = np.where(wide[own] == 5, got, got >> 1)
            odd[own] |= got == (1 << wide[own]) - 1
            k[own] = got.astype(u64)
            p[own] += wide[own]
        own = slice(0, count) if i >= top else np.flatnonzero((order <= i) & (size > i))
        at_bit, kk = p[own], k[own]
        w = words[at_bit >> 3] << (at_bit & 7).astype(u64)
        e = (w >> low52).astype(np.float64).view(np.int64) >> 52
        q = 1075 - e  # leading zeros: 52 minus the exponent, whose bias is 1023
        far = q + kk.astype(np.int64) > 56
        if far.any():
            odd[own] |= far
            q = np.where(far, 0, q)
        qu = q.astype(u64)
        v = qu << kk | (w << (qu + one)) >> (u64(63) - kk) >> one
        x[i, own] = v.astype(np.int64)
        p[own] = np.minimum(at_bit + q + 1 + kk.astype(np.int64), len(words) * 8 - 1)
    step = np.arange(len(x))[:, None]
    if len(x):
        r = np.where((step >= order) & (step < size), (x >> 1) ^ -(x & 1), x)
        for o in range(1, 5):
            own = np.flatnonzero(~lpc & (order == o))
            if len(own):
                y = r[:, own]
                warm = y[:o].copy()
                for i in range(o):
                    y[i] = warm[i] - sum(c * warm[i - 1 - j] for j, c in enumerate(_FIXED[o]) if i - 1 - j >= 0)
                for _ in range(o):
                    np.cumsum(y, axis=0, out=y)
                r[:, own] = y
        own = np.flatnonzero(lpc)
        if len(own):
            y, c, s, o = r[:, own].astype(np.int64), coef[:, own], shift[own], order[own]
            for i in range(1, len(y)):
                pred = sum(c[j] * y[i - 1 - j] for j in range(min(top, i))) >> s
                y[i] += pred if i >= top else np.where(o <= i, pred, 0)
            r[:, own] = y
        out[: len(x), coded] = r
    data = None
    for f in [*np.flatnonzero(slow).tolist(), *coded[odd].tolist()]:
        data = buf.tobytes() if data is None else data
        out[: n[f], f] = _frame(data, int(starts[f]), BITS)[0][0]
    return out, n


def decode_many(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(int8 samples, first sample of each block) of each 8-bit mono stream with a seek point per frame."""
    infos = [metadata(s) for s in streams]
    starts, ends, base, bufs = [], [], 0, []
    for s, info in zip(streams, infos, strict=True):
        if info["seek"] is None or info["channels"] != 1 or info["bits"] != BITS:
            raise Broken("not 8-bit mono with seek points")
        at = info["seek"]["at"].astype(np.int64) + info["frames"] + base
        starts.append(at)
        ends.append(np.append(at[1:], base + len(s)))
        bufs.append(np.frombuffer(s, np.uint8))
        base += len(s)
    if not streams:
        return []
    buf, starts, ends = np.concatenate(bufs), np.concatenate(starts), np.concatenate(ends)
    x, n = decode_frames(buf, starts, ends)
    flat = x.T.astype(np.int8)
    out, f = [], 0
    for info in infos:
        k = len(info["seek"])
        got = flat[f : f + k][np.arange(flat.shape[1]) < n[f : f + k, None]]
        if len(got) != info["total"] or hashlib.md5(got.tobytes()).digest() != info["md5"]:
            raise Broken("the samples' MD5 differs")
        if (np.cumsum(n[f : f + k]) - n[f : f + k] != info["seek"]["sample"]).any():
            raise Broken("a seek point is off")
        out.append((got, info["seek"]["sample"].astype(np.int64)))
        f += k
    return out
