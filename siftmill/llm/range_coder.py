"""An adaptive context-mixing range coder for token ids, run in lockstep over many blocks.

Three predictors name an id each: the last follower of the two ids before (order 2), the last
follower of the id before (order 1), and the last id seen with the same low byte (order 0).
One of four things happens: an order's prediction holds, highest order first, or the id is new.
What happened is range-coded. Its frequencies mix two adaptive tables, one picked by how reliable
the predictions of order 2 and 1 have been, one by what happened last. Order 0 takes the id's low
byte besides, a new id both; these bytes stand behind the coded words. Every block starts from
nothing, so blocks decode alone, and all blocks of a call advance together as numpy lanes.

Tables hold cumulative frequencies, and all mixtures have one total, a power of two: neither side divides.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 2048  # ids per block
MAX_ID = 1 << 16
LANES = 4096  # blocks that advance together
_BITS1, _BITS2, _BITS0 = 8, 9, 8
_PAST1, _PAST2 = np.uint16(40503), np.uint16(30011)
# Four 16-bit frequencies share a 64-bit word: those of all outcomes up to each. A table's are at most _TOP, a mixture adds
# _LEAST for each outcome, so none is without and the last is always the total.
_TOTAL_BITS, _LEAST = np.uint64(15), 128
_TOP = (1 << 14) - 2 * _LEAST
_ALL = 0x0001000100010001
_BIAS = np.uint64(sum(_LEAST * (j + 1) << 16 * j for j in range(3)) + (1 << 15 + 48))
_EVEN = np.uint64(sum(_TOP * (j + 1) // 4 << 16 * j for j in range(3)))
_GAIN = np.array([sum(_TOP >> 5 << 16 * j for j in range(3) if o <= j) for o in range(4)], np.uint64)
_FIVE, _KEEP, _F16 = np.uint64(5), np.uint64(0x07FF07FF07FF07FF), np.uint64(0xFFFF)
_U4, _U16, _U32, _MASK = np.uint64(4), np.uint64(16), np.uint64(32), np.uint64(0xFFFFFFFF)
# Three words of 16 bits; what a sum carries stays above them until its word is written. A step takes 8 bits at most, so
# a word is due after every second step, and no more than one.
_SPAN = 1 << 48
_ONE, _THREE, _FOUR = np.uint8(1), np.uint8(3), np.uint8(4)
_BYTES = np.array([0, 0, 1, 2])  # of an id besides, by outcome


class _Model:
    """The predictors and frequency tables of all lanes."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.base2, self.base1, self.base0, self.base = lane << _BITS2, lane << _BITS1, lane << _BITS0, lane << 4
        self.t2 = np.zeros(lanes << _BITS2, np.uint32)  # an id, and above it how often it held in a row, up to 3
        self.t1 = np.zeros(lanes << _BITS1, np.uint32)
        self.t0 = np.zeros(lanes << _BITS0, np.uint16)
        self.held = np.full(lanes << 4, _EVEN, np.uint64)
        self.past = np.full(lanes << 4, _EVEN, np.uint64)
        self.hash1, self.hash2 = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
        self.last = np.full(lanes, 15, np.uint8)

    def narrow(self, m: int) -> None:
        for name in ("base2", "base1", "base0", "base", "hash1", "hash2", "last"):
            setattr(self, name, getattr(self, name)[:m])

    def predict(self) -> None:
        self.at2 = self.base2 + (self.hash1 + self.hash2 >> 16 - _BITS2)
        self.at1 = self.base1 + (self.hash1 >> 16 - _BITS1)
        self.e2, self.e1 = self.t2.take(self.at2, mode="clip"), self.t1.take(self.at1, mode="clip")
        halves2, halves1 = self.e2.view(np.uint16), self.e1.view(np.uint16)
        self.p2, self.k2, self.p1, self.k1 = halves2[::2], halves2[1::2], halves1[::2], halves1[1::2]
        self.at_held, self.at_past = self.base + (self.k2 * _FOUR + self.k1), self.base + self.last
        self.own_held, self.own_past = self.held.take(self.at_held, mode="clip"), self.past.take(self.at_past, mode="clip")
        self.upto = self.own_held + self.own_past + _BIAS

    def share(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequency of all outcomes before one, and of itself."""
        field = outcome.astype(np.uint64)
        field <<= _U4
        start = self.upto << _U16
        start >>= field
        start &= _F16
        width = self.upto >> field
        width &= _F16
        width -= start
        return start, width

    def learn(self, x: np.ndarray, outcome: np.ndarray, at0: np.ndarray) -> None:
        """``x`` are 16-bit ids, ``outcome`` bytes."""
        gain = _GAIN.take(outcome, mode="clip")
        for table, at, own in ((self.held, self.at_held, self.own_held), (self.past, self.at_past, self.own_past)):
            less = own >> _FIVE
            less &= _KEEP
            own -= less
            own += gain
            table[at] = own
        for p, k, held in ((self.p2, self.k2, outcome == 0), (self.p1, self.k1, self.p1 == x)):
            more = np.minimum(k + _ONE, _THREE)
            more *= held
            k[:], p[:] = more, x
        self.t2[self.at2], self.t1[self.at1], self.t0[at0] = self.e2, self.e1, x
        self.hash2 = self.hash1 * _PAST2
        self.hash1 = x * _PAST1
        self.last = self.last << 2 & 15 | outcome


def _encode_lanes(grid: np.ndarray, last: int) -> list[bytes]:
    """grid: (steps, lanes) 16-bit ids; the last lane has ``last`` of them."""
    steps, lanes = grid.shape
    model = _Model(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _SPAN, np.uint64)
    words, used = np.zeros((steps * 8 // 16 + 4, lanes), np.uint32), np.zeros(lanes, np.int64)
    outcomes = np.zeros((steps, lanes), np.uint8)
    m = lanes
    for t in range(steps):
        if t == last:
            m -= 1
            if not m:
                break
            model.narrow(m)
        x, s = grid[t, :m], span[:m]
        model.predict()
        at0 = model.base0 + (x & np.uint16(255))
        outcome = (model.t0.take(at0, mode="clip") != x).view(np.uint8)
        outcome += _ONE
        outcome *= (model.p1 != x).view(np.uint8)
        outcome += _ONE
        outcome *= (model.p2 != x).view(np.uint8)
        outcomes[t, :m] = outcome
        start, width = model.share(outcome)
        s >>= _TOTAL_BITS
        low[:m] += s * start
        s *= width
        if t & 1:
            full = np.flatnonzero(s <= _MASK)
            out = low[full]
            words[used[full], full] = out >> _U32
            used[full] += 1
            low[full] = (out & _MASK) << _U16
            span[full] <<= _U16
        model.learn(x, outcome, at0)
    every = np.arange(lanes)
    for shift in (32, 16, 0):
        words[used, every] = low >> np.uint64(shift)
        low &= np.uint64((1 << shift) - 1)
        used += 1
    while (over := words >> 16).any():
        words &= 0xFFFF
        words[:-1] += over[1:]
    packed = np.ascontiguousarray(words[: used.max()].T.astype("<u2"))
    sides, ends = _side_bytes(grid, outcomes)
    return [used[i].astype("<u2").tobytes() + packed[i, : used[i]].tobytes() + sides[a:b] for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends))]


def _side_bytes(grid: np.ndarray, outcomes: np.ndarray) -> tuple[bytes, list[int]]:
    """The bytes that ids take besides, lane after lane, and the end of each lane. Places behind a lane's end have outcome 0."""
    by_lane = np.ascontiguousarray(outcomes.T)
    both = np.ascontiguousarray(grid.T).astype("<u2").view(np.uint8).reshape(*by_lane.shape, 2)
    kept = np.stack([by_lane >= 2, by_lane == 3], 2)
    return both[kept].tobytes(), kept.sum((1, 2)).cumsum().tolist()


def _decode_lanes(blobs: list[bytes], steps: int, last: int) -> np.ndarray:
    lanes = len(blobs)
    counts = [int.from_bytes(blob[:2], "little") for blob in blobs]
    words = np.zeros((max(3, *counts), lanes), np.uint64)
    for i, (blob, n) in enumerate(zip(blobs, counts)):
        own = np.frombuffer(blob, "<u2", min(n, len(blob) // 2 - 1), 2)
        words[: len(own), i] = own
    sides = [blob[2 + 2 * n :] for blob, n in zip(blobs, counts)]
    side = np.frombuffer(b"".join(sides) + b"\0\0", np.uint8).astype(np.uint16)
    place = np.cumsum([0, *map(len, sides)])[:-1]
    model, grid = _Model(lanes), np.zeros((steps, lanes), np.uint16)
    code, span = words[0] << _U32 | words[1] << _U16 | words[2], np.full(lanes, _SPAN, np.uint64)
    used, m = np.full(lanes, 3, np.int64), lanes
    for t in range(steps):
        if t == last:
            m -= 1
            if not m:
                break
            model.narrow(m)
            code, span, place = code[:m], span[:m], place[:m]
        model.predict()
        upto = model.upto
        span >>= _TOTAL_BITS
        outcome = (code >= span * (upto & _F16)).view(np.uint8)
        outcome += (code >= span * (upto >> _U16 & _F16)).view(np.uint8)
        outcome += (code >= span * (upto >> _U32 & _F16)).view(np.uint8)
        start, width = model.share(outcome)
        code -= span * start
        span *= width
        if t & 1:
            full = np.flatnonzero(span <= _MASK)
            code[full] = code[full] << _U16 | words[np.minimum(used[full], len(words) - 1), full]
            used[full] += 1
            span[full] <<= _U16
        lowest = side.take(place, mode="clip")
        x = np.where(outcome == 2, model.t0.take(model.base0 + lowest, mode="clip"), lowest | side.take(place + 1, mode="clip") << np.uint16(8))
        x = np.where(outcome == 0, model.p2, np.where(outcome == 1, model.p1, x))
        place = place + _BYTES.take(outcome, mode="clip")
        grid[t, :m] = x
        model.learn(x, outcome, model.base0 + (x & np.uint16(255)))
    return grid


def encode_ids(ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Blocks (number of ids, crc32 of the ids as little-endian 32-bit words, coded bytes)."""
    if len(ids) and int(ids.max()) >= MAX_ID:
        raise ValueError(f"the coder takes ids below {MAX_ID}")
    out = []
    for start in range(0, len(ids), BLOCK * LANES):
        part = ids[start : start + BLOCK * LANES]
        lanes = -(-len(part) // BLOCK)
        steps = min(BLOCK, len(part))
        last = len(part) - (lanes - 1) * BLOCK
        padded = np.zeros(lanes * steps, np.uint16)
        padded[: len(part)] = part
        blobs = _encode_lanes(np.ascontiguousarray(padded.reshape(lanes, steps).T), last)
        raw = part.astype("<u4").tobytes()
        for i, blob in enumerate(blobs):
            own = raw[4 * BLOCK * i : 4 * BLOCK * (i + 1)]
            out.append((len(own) // 4, zlib.crc32(own), blob))
    return out


def decode_ids(blocks: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The ids of consecutive blocks as :func:`encode_ids` made them; a block that fails its checksum is an error."""
    parts = []
    for start in range(0, len(blocks), LANES):
        group = blocks[start : start + LANES]
        by_lane = np.ascontiguousarray(_decode_lanes([b[2] for b in group], group[0][0], group[-1][0]).T)
        for own, (n, crc, _) in zip(by_lane, group):
            own = own[:n].astype("<u4")
            if zlib.crc32(own.tobytes()) != crc:
                raise ValueError("a block does not match its checksum")
            parts.append(own)
    return np.concatenate(parts) if parts else np.empty(0, "<u4")
