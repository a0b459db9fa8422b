"""Token files: ids coded by an adaptive context-mixing range coder in blocks that stand alone and carry a checksum."""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"CTK1"
# Ids of a block. Everything that is learned starts anew with each block.
BLOCK = 4096
# Bits of a binary decision and of the order-0 frequencies; a block has at most BLOCK different ids.
BIT, ZERO = 12, 13
CONTEXTS = 4096
STATES = 32
# Positions in a block at which order 0 is counted again.
FRAMES = (0, 128, 384, 1024, 2048, 3072)
WINDOW = 60
LEAST = 1 << (WINDOW - 16)


class _Lanes:
    """The model of many blocks in lockstep, one lane each; the encoder and the decoder drive the same object.

    Ids are places in a block's sorted alphabet. Order 2 and order 1 each hold, per context, the id they expect and how often it came true. Their two
    confidences and whether they agree pick an adaptive share for the expected ids (how much weight either order has earned in that state); what is left goes to order 0,
    frequencies counted from the block so far.
    """

    def __init__(self, size: np.ndarray):
        n = len(size)
        self.size, self.first = size, np.cumsum(size) - size
        self.lane_contexts, self.lane_states = np.arange(n) * CONTEXTS, np.arange(n) * STATES
        self.two, self.one = np.zeros(n * CONTEXTS, np.int16), np.zeros(int(size.sum()), np.int16)
        start = np.tile(np.array([200, 900, 1800, 2800], np.int16), STATES // 4)
        self.p_one = np.tile(start, n)
        self.p_two = np.tile(np.repeat(np.array([200, 900, 1800, 2800, 400, 1800, 3000, 3600], np.int16), 4), n)
        self.seen = np.zeros(len(self.one), np.int32)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def expect(self, n: int) -> None:
        """Look up what the first ``n`` lanes expect next."""
        last, before = self.last[:n], self.before[:n]
        self.at_one = self.first[:n] + last
        self.at_two = self.lane_contexts[:n] + (((last * 40503 + before * 60493) >> 4) & (CONTEXTS - 1))
        self.e_one, self.e_two = self.one.take(self.at_one), self.two.take(self.at_two)
        self.c_one, self.c_two = self.e_one >> 2, self.e_two >> 2
        self.agree = self.c_one == self.c_two
        mix = ((self.e_two & 3) << 2) | (self.e_one & 3) | (self.agree.astype(np.int16) << 4)
        self.state = self.lane_states[:n] + mix
        self.share_two, self.share_one = self.p_two.take(self.state), self.p_one.take(self.state)

    def learn(self, symbol: np.ndarray, hit_two: np.ndarray, asked: np.ndarray, hit_one: np.ndarray) -> None:
        """``symbol`` came; order 2 was right in ``hit_two``, order 1 was asked in ``asked`` and right in ``hit_one``."""
        n, new = len(symbol), (symbol << 2) | 1
        a = self.share_two
        self.p_two[self.state] = np.where(hit_two, a + ((4096 - a) >> 4), a - (a >> 4))
        a = self.share_one
        self.p_one[self.state] = np.where(asked, np.where(hit_one, a + ((4096 - a) >> 4), a - (a >> 4)), a)
        for table, at, e, hit in ((self.two, self.at_two, self.e_two, hit_two), (self.one, self.at_one, self.e_one, self.c_one == symbol)):
            sure = e & 3
            table[at] = np.where(hit, e + (sure < 3), np.where(sure > 1, e - 2, new))
        self.before[:n] = self.last[:n]
        self.last[:n] = symbol

    def count(self, symbols: np.ndarray) -> None:
        """Order 0 again, with ``symbols`` (lanes, positions) of the frame that ended."""
        if symbols.size:
            at = self.first[: len(symbols), None] + symbols
            self.seen += np.bincount(at.ravel(), minlength=len(self.seen))
        weight = 1 + 4 * self.seen
        total = np.add.reduceat(weight, self.first)
        freq = 1 + (weight * np.repeat((((1 << ZERO) - self.size) / total).astype(np.float32), self.size)).astype(np.int32)
        spare = (1 << ZERO) - np.add.reduceat(freq, self.first)
        short = np.flatnonzero(spare < 0)  # rounding: the most frequent symbol pays
        for i in short.tolist():
            own = freq[self.first[i] : self.first[i] + self.size[i]]
            own[own.argmax()] += spare[i]
        freq[self.first] += np.maximum(spare, 0).astype(np.int32)
        self.freq = freq
        start = np.cumsum(freq, dtype=np.int64) - freq - np.repeat(np.arange(len(self.size)) << ZERO, self.size)
        self.zero = (start.astype(np.int32) << ZERO) | (freq - 1)  # start and frequency in one word

    def interval(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.zero.take(at)
        return both >> ZERO, (both & ((1 << ZERO) - 1)) + 1

    def slots(self) -> np.ndarray:
        """Which symbol each order-0 slot of each lane belongs to."""
        local = (np.arange(len(self.freq)) - np.repeat(self.first, self.size)).astype(np.int16)
        return np.repeat(local, self.freq)


def _alphabets(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places (lanes, BLOCK) of ids in their block's sorted distinct ids, and those."""
    table = ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids
    lanes = np.empty((len(lengths), BLOCK), table.dtype)
    lanes.ravel()[: len(table)] = table
    lanes.ravel()[len(table) :] = table[-1]  # fills the last lane with an id of its own
    order = np.argsort(lanes, axis=1, kind="stable")
    ranked = np.take_along_axis(lanes, order, 1)
    new = np.ones(lanes.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    place = np.empty(lanes.shape, np.int16)
    np.put_along_axis(place, order, (np.cumsum(new, axis=1, dtype=np.int32) - 1).astype(np.int16), 1)
    return place, np.split(ranked[new].astype(np.uint32), np.cumsum(new.sum(1))[:-1])


def _gaps(alphabet: np.ndarray) -> bytes:
    """Rising ids as one byte per gap; wide gaps follow with their places: their number (u16), places (u16), gaps (u32)."""
    gap = np.diff(alphabet.astype(np.int64), prepend=-1) - 1
    wide = np.flatnonzero(gap > 255)
    low = np.minimum(gap, 255).astype(np.uint8)
    return low.tobytes() + np.array([len(wide)], "<u2").tobytes() + wide.astype("<u2").tobytes() + gap[wide].astype("<u4").tobytes()


def _ungaps(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The ``n`` ids that _gaps() wrote at ``at``, and where they end."""
    gap = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    wide = int.from_bytes(data[at + n : at + n + 2], "little")
    end = at + n + 2
    gap[np.frombuffer(data, "<u2", wide, end)] = np.frombuffer(data, "<u4", wide, end + 2 * wide)
    return np.cumsum(gap + 1) - 1, end + 6 * wide


def encode(ids: np.ndarray) -> bytes:
    """Coded blocks of ``ids``: MAGIC, block count, then per block ids, alphabet size, digits, CRC-32 of the ids (u32 each), gaps and digits (u16)."""
    ids = np.ascontiguousarray(ids, "<u4")
    n_blocks = -(-len(ids) // BLOCK)
    head = MAGIC + np.array([n_blocks], "<u4").tobytes()
    if not n_blocks:
        return head
    lengths = np.full(n_blocks, BLOCK)
    lengths[-1] = len(ids) - BLOCK * (n_blocks - 1)
    place, alphabets = _alphabets(ids, lengths)
    model = _Lanes(np.array([len(a) for a in alphabets]))
    low, width = np.zeros(n_blocks, np.int64), np.full(n_blocks, 1 << WINDOW, np.int64)
    stride = BLOCK * 3 + 8
    digits, filled = np.zeros(n_blocks * stride, np.int32), np.arange(n_blocks) * stride
    columns = np.ascontiguousarray(place.T)
    for t in range(int(lengths.max())):
        n = n_blocks if t < lengths[-1] else n_blocks - 1
        if t in FRAMES:
            done = FRAMES[FRAMES.index(t) - 1] if t else 0
            model.count(place[:n, done:t] if t else place[:0, :0])
        symbol = columns[t, :n]
        model.expect(n)
        r, lo = width[:n], low[:n]
        x = (r >> BIT) * model.share_two
        hit = model.c_two == symbol
        asked = ~(hit | model.agree)
        r = np.where(hit, x, r - x)
        lo = lo + np.where(hit, 0, x)
        x = (r >> BIT) * model.share_one
        h = asked & (model.c_one == symbol)
        r = np.where(asked, np.where(h, x, r - x), r)
        lo += np.where(asked ^ h, x, 0)
        z = np.flatnonzero(~(hit | h))
        start, freq = model.interval(model.first.take(z) + symbol.take(z))
        rz = r.take(z) >> ZERO
        lo[z] += rz * start
        r[z] = rz * freq
        w = np.flatnonzero(r < LEAST)
        while len(w):
            v, at, rw = lo.take(w), filled.take(w), r.take(w) << 16
            digits[at] = v >> (WINDOW - 16)
            filled[w] = at + 1
            lo[w] = (v & (LEAST - 1)) << 16
            r[w] = rw
            w = w[rw < LEAST]
        width[:n], low[:n] = r, lo
        model.learn(symbol, hit, asked, h)
    filled -= np.arange(n_blocks) * stride
    digits = digits.reshape(n_blocks, stride)
    for shift in (44, 28, 12):
        digits[np.arange(n_blocks), filled] = low >> shift if shift == 44 else (low >> shift) & 0xFFFF
        filled += 1
    digits[np.arange(n_blocks), filled] = (low << 4) & 0xFFFF
    filled += 1
    for k in range(int(filled.max()) - 1, 0, -1):  # a digit may have overflowed into the one before
        over = digits[:, k] >> 16
        digits[:, k] &= 0xFFFF
        digits[:, k - 1] += over
    out, digits = [head], digits.astype("<u2")
    for b in range(n_blocks):
        own = ids[b * BLOCK : b * BLOCK + int(lengths[b])]
        out.append(np.array([len(own), len(alphabets[b]), filled[b], zlib.crc32(own.tobytes())], "<u4").tobytes())
        out.append(_gaps(alphabets[b]))
        out.append(digits[b, : filled[b]].tobytes())
    return b"".join(out)


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of each encode() result; their blocks are decoded together. A damaged block raises ValueError."""
    blocks, counts = [], []
    for data in coded:
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n, at = int.from_bytes(data[4:8], "little"), 8
        counts.append(n)
        try:
            for _ in range(n):
                length, size, filled, crc = np.frombuffer(data, "<u4", 4, at).tolist()
                alphabet, at = _ungaps(data, at + 16, size)
                blocks.append((length, alphabet, np.frombuffer(data, "<u2", filled, at), crc))
                at += 2 * filled
                if not 0 < size <= length <= BLOCK:
                    raise ValueError("a block's sizes do not fit")
        except IndexError as error:
            raise ValueError("a block's alphabet is damaged") from error
    ids: list = [None] * len(blocks)
    if blocks:
        order = np.argsort([-b[0] for b in blocks], kind="stable")  # long blocks first: the lanes at work are a prefix
        for o, got in zip(order.tolist(), _decode([blocks[i] for i in order]), strict=True):
            ids[o] = got
    out, at = [], 0
    for n in counts:
        out.append(np.concatenate(ids[at : at + n]) if n else np.empty(0, np.uint32))
        at += n
    return out


def _decode(blocks: list) -> list[np.ndarray]:
    lengths = np.array([b[0] for b in blocks])
    n_blocks = len(blocks)
    model = _Lanes(np.array([len(b[1]) for b in blocks]))
    raw = np.zeros((n_blocks, max(len(b[2]) for b in blocks) + 8), np.int64)
    for i, b in enumerate(blocks):
        raw[i, : len(b[2])] = b[2]
    code = (raw[:, 0] << 44) | (raw[:, 1] << 28) | (raw[:, 2] << 12) | (raw[:, 3] >> 4)
    stream = (((raw[:, 3:-1] & 15) << 12) | (raw[:, 4:] >> 4)).astype(np.int32)
    stride, stream = stream.shape[1], stream.ravel()
    read = np.arange(n_blocks) * stride
    width = np.full(n_blocks, 1 << WINDOW, np.int64)
    steps = int(lengths.max())
    columns = np.zeros((steps, n_blocks), np.int16)
    working = n_blocks - np.searchsorted(lengths[::-1], np.arange(steps), "right")
    lane_slots = np.arange(n_blocks) << ZERO
    for t in range(steps):
        n = int(working[t])
        if t in FRAMES:
            done = FRAMES[FRAMES.index(t) - 1] if t else 0
            model.count(np.ascontiguousarray(columns[done:t, :n].T) if t else columns[:0, :0])
            slots = model.slots()
        model.expect(n)
        r, c = width[:n], code[:n]
        x = (r >> BIT) * model.share_two
        hit = c < x
        asked = ~(hit | model.agree)
        r = np.where(hit, x, r - x)
        c = c - np.where(hit, 0, x)
        x = (r >> BIT) * model.share_one
        h = asked & (c < x)
        r = np.where(asked, np.where(h, x, r - x), r)
        c -= np.where(asked ^ h, x, 0)
        symbol = np.where(hit, model.c_two, model.c_one)
        z = np.flatnonzero(~(hit | h))
        rz, cz = r.take(z) >> ZERO, c.take(z)
        found = slots.take(lane_slots.take(z) + np.minimum((cz.view(np.uint64) // rz.view(np.uint64)).view(np.int64), (1 << ZERO) - 1))
        start, freq = model.interval(model.first.take(z) + found)
        c[z] = cz - rz * start
        r[z] = rz * freq
        symbol[z] = found
        w = np.flatnonzero(r < LEAST)
        while len(w):
            at, rw = read.take(w), r.take(w) << 16
            c[w] = (c.take(w) << 16) | stream.take(at, mode="clip")
            read[w] = at + 1
            r[w] = rw
            w = w[(rw < LEAST) & (rw > 0)]
        width[:n], code[:n] = r, c
        columns[t, :n] = symbol
        model.learn(symbol, hit, asked, h)
    out, places = [], np.ascontiguousarray(columns.T)
    for i, (length, alphabet, _, crc) in enumerate(blocks):
        ids = alphabet[np.minimum(places[i, :length], len(alphabet) - 1)].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError("a block does not match its checksum")
        out.append(ids)
    return out
