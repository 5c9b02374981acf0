"""Texts that must differ by more than some edits, told apart by letter groups that are picked once per text.

An edit spoils at most one of several groups of neighbouring letters that do not overlap. So of the groups picked in
x, those that y does not hold where an alignment within the limit could put them cost an edit each. A text picks the
groups that few others hold, the best choice by one scan over its letters. Which groups are picked changes how many
pairs are told apart, never whether that is right. A pair costs some bytes per picked group and shift, not the
product of its lengths.
"""

from __future__ import annotations

import numpy as np

BUCKET, STEP = 256, 128  # letters of x whose groups are searched under one shift, and shifts that count as one
GROUPS = (2, 3, 4, 5)  # letters of a group
HASHES, NONE = 1 << 20, 65_535  # groups that share a number only lower the bound
HELD_BYTES = 1 << 27  # of the table that is searched at once


def letters(texts: list[str]) -> np.ndarray:
    """One byte per letter; letters that share a code only lower a distance."""
    return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") & 255).astype(np.uint8)


def _numbers(texts: list[str], width: int) -> list[np.ndarray]:
    """For every length in ``GROUPS`` the numbers of the groups by place and text; ``HASHES`` where none begins."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.zeros((len(texts), width + GROUPS[-1]), np.uint8)
    codes[np.arange(width + GROUPS[-1]) < sizes[:, None]] = letters(texts)
    codes = np.ascontiguousarray(codes.T).astype(np.uint32) + np.uint32(1)
    out, value = [], np.zeros((width, len(texts)), np.uint32)
    for q in range(GROUPS[-1]):
        value = value * np.uint32(0x01000193) + codes[q : q + width] * np.uint32(0x9E3779B1)
        if q + 1 in GROUPS:
            named = ((value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(12)).astype(np.int32)
            named[np.arange(width)[:, None] + q >= sizes] = HASHES
            out.append(named)
    return out


def _picks(named: list[np.ndarray], missing: np.ndarray) -> np.ndarray:
    """By place and text the length of the group picked there, or 0: in each bucket the groups without overlap of which
    another text is likely to lack most. ``missing`` is that chance by number."""
    places, texts = named[0].shape
    lanes = places // BUCKET * texts
    by_place = lambda k: k.reshape(-1, BUCKET, texts).swapaxes(0, 1).reshape(BUCKET, lanes)
    gains = [missing[by_place(k)] for k in named]
    best = np.zeros((BUCKET + 1, lanes), np.float32)
    chosen = np.zeros((BUCKET + 1, lanes), np.uint8)
    value, better = np.empty(lanes, np.float32), np.empty(lanes, bool)
    for i in range(1, BUCKET + 1):
        now, how = best[i], chosen[i]
        now[:] = best[i - 1]
        for q, gain in zip(GROUPS, gains):
            if q <= i:
                np.add(best[i - q], gain[i - q], out=value)
                np.greater(value, now, out=better)
                np.copyto(now, value, where=better)
                how[better] = q
    picked = np.zeros((BUCKET, lanes), np.uint8)
    at = np.full(lanes, BUCKET, np.int64)
    for i in range(BUCKET, 0, -1):
        here = np.flatnonzero(at == i)
        q = chosen[i, here]
        taken = q > 0
        picked[i - q[taken].astype(np.int64), here[taken]] = q[taken]
        at[here] -= np.maximum(q, 1)
    return picked.reshape(BUCKET, -1, texts)


def apart(xs: list[str], ys: list[str], near: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Pairs (xs[i], ys[j]) among those marked in ``near`` that must differ by more than ``limit[i, j]`` edits; the others
    are undecided. Most are told apart where x is the longer text."""
    out = np.zeros(near.shape, bool)
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if not len(rows):
        return out
    n, m = (np.array([len(t[k]) for k in kept], np.int64) for t, kept in ((xs, rows), (ys, columns)))
    rows, n = rows[order := np.argsort(n, kind="stable")], n[order]
    columns, m = columns[order := np.argsort(m, kind="stable")], m[order]
    near, limit = near[np.ix_(rows, columns)], limit[np.ix_(rows, columns)]
    buckets, width = -(-int(n[-1]) // BUCKET), len(columns)
    own, other = _numbers([xs[k] for k in rows], buckets * BUCKET), _numbers([ys[k] for k in columns], int(m[-1]))

    counts = sum(np.bincount(k.ravel(), minlength=HASHES + 1) for k in other)
    missing = np.exp(counts * (-(BUCKET + STEP) / m.sum())).astype(np.float32)
    missing[HASHES] = -1
    picked = _picks(own, missing)

    # An alignment within k edits of texts whose lengths differ by e shifts a letter by (e - k) / 2 to (e + k) / 2 places.
    longer = m[None, :] - n[:, None]
    low, high = int((longer - limit)[near].min()) // 2, -(int((-longer - limit)[near].min()) // 2)
    shifts = (high - low) // STEP + 1
    cells = shifts + BUCKET // STEP
    cell = (np.arange(cells * STEP)[:, None] // STEP * width + np.arange(width)).ravel()
    start, stop = near.argmax(1), width - near[:, ::-1].argmax(1)
    place = np.full(HASHES + 1, NONE, np.uint16)
    edits = np.zeros(near.shape, np.int32)
    for b in range(buckets):
        open_ = np.flatnonzero((near & (edits <= limit)).any(1) & (n > b * BUCKET))
        first = b * BUCKET + low
        a, z = max(first, 0), min(first + cells * STEP, int(m[-1]))
        at, x = np.nonzero(picked[:, b])
        x, at = x[order := np.argsort(x, kind="stable")], at[order]
        q, ends = picked[at, b, x], np.searchsorted(x, np.arange(len(rows) + 1))
        group = np.empty(len(x), np.int32)
        for k, named in zip(GROUPS, own):
            group[q == k] = named[b * BUCKET + at[q == k], x[q == k]]
        picks = np.cumsum(ends[open_ + 1] - ends[open_])
        at_once = max(min(HELD_BYTES // (cells * width), NONE) - BUCKET, 1)
        for part in np.split(open_, np.flatnonzero(np.diff(picks // at_once)) + 1):
            mine = [group[ends[i] : ends[i + 1]] for i in part.tolist()]
            if not sum(map(len, mine)):
                continue
            used, named_here = np.unique(np.concatenate(mine), return_inverse=True)
            place[used] = np.arange(len(used))
            held = np.zeros((len(used), cells, width), bool)
            for k, named in zip(GROUPS, other):
                if a < z:
                    ids = place[named[a:z].ravel()]
                    hit = np.flatnonzero(ids != NONE)
                    held.ravel()[ids[hit].astype(np.int64) * (cells * width) + cell[hit + (a - first) * width]] = True
            place[used] = NONE
            for _ in range(cells - shifts):
                for k in range(cells - 1):
                    held[:, k] |= held[:, k + 1]
            found, done = held[:, :shifts].view(np.uint8), 0
            for i, size in zip(part.tolist(), map(len, mine)):
                if size:
                    of = slice(start[i], stop[i])
                    kept = np.add.reduce(found[named_here[done : done + size], :, of], axis=0, dtype=np.uint8).max(0)
                    edits[i, of] += size - kept.astype(np.int32)
                done += size
    out[np.ix_(rows, columns)] = near & (edits > limit)
    return out
