"""Byte-level BPE in tasks: words of a text, vocabularies, and the two merge procedures.

A text is cut at every single space between two non-blank characters. No match of the
pre-tokenizer's pattern can span such a cut and none looks across it, so the ids of a text are
the ids of its pieces in order, and pieces repeat: their results are kept in bounded memo tables.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from siftmill.llm.base import Memo

BLANKS = re.compile(r"\s\s")
CUT = re.compile(r"(?<=\S) (?=\S)")
BLANK = "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace())  # inside a class of Arrow's regular expressions
TABLE_BYTES = 1 << 27
CROWDED = rf"[ \n][{BLANK}]|[{BLANK}][ \n]"


def pieces(text: str) -> list[str]:
    """The text cut at single spaces; all pieces but the first have lost a leading space."""
    return CUT.split(text) if BLANKS.search(text) else text.split(" ")


def piece_lists(texts: pa.Array) -> tuple[pa.Array, pa.Array | None]:
    """The texts cut at single spaces and before single line ends, as lists; all pieces but the first that do not begin
    with a line end have lost a leading space. Besides, unless it is theirs, the order of the texts among the lists."""
    crowded = pc.match_substring_regex(texts, CROWDED).to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~crowded)), "\n", " \n"), " ")
    if not crowded.any():
        return lists, None
    others = pa.array([pieces(t) for t in texts.filter(pa.array(crowded)).to_pylist()], lists.type)
    places = np.concatenate([np.flatnonzero(~crowded), np.flatnonzero(crowded)])
    return pa.concat_arrays([lists, others]), pa.array(np.argsort(places))


def with_spaces(pieces: pa.Array) -> list[str]:
    return [t if t[:1] == "\n" else f" {t}" for t in pieces.to_pylist()]


class PieceTable:
    """Ids of pieces as Arrow columns. The pieces of many texts are numbered at once, only new ones are encoded, by ``_alone``.
    A full table starts anew from the pieces of the texts at hand."""

    def __init__(self, entries: int):
        self.entries = entries
        self.known = pa.array([], pa.string())
        self.ids, self.stops = np.empty(0, np.uint32), np.zeros(1, np.int64)  # of the known pieces, in order

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        raise NotImplementedError

    def _add(self, pieces: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids = np.concatenate([self.ids, ids])
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(lengths)])

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """The places of new pieces behind the known ones."""
        self._add(pieces, *self._alone(with_spaces(pieces)))
        return np.arange(len(pieces))

    def _keep(self, rows: np.ndarray) -> None:
        lists = pa.ListArray.from_arrays(pa.array(self.stops, pa.int32()), pa.array(self.ids)).take(pa.array(rows))
        self.known = self.known.take(pa.array(rows))
        self.ids, self.stops = lists.values.to_numpy(), lists.offsets.to_numpy().astype(np.int64)

    def columns(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has. No text is null."""
        lists, order = piece_lists(texts)
        starts, pieces = lists.offsets.to_numpy(), lists.values
        found = pieces.dictionary_encode()
        seen = pc.index_in(self.known, value_set=found.dictionary)
        known = seen.is_valid().to_numpy(zero_copy_only=False)
        place = np.full(len(found.dictionary), -1)  # of a piece in the table
        place[seen.drop_null().to_numpy()] = np.flatnonzero(known)
        missing = np.flatnonzero(place < 0)
        place[missing] = len(known) + self._learn(found.dictionary.take(pa.array(missing)))
        own = place[found.indices.to_numpy()]
        heads = starts[:-1][np.diff(starts) > 0]
        head_ids, head_lengths = self._alone(pieces.take(pa.array(heads)).to_pylist())
        own[heads] = len(self.known) + np.arange(len(heads))
        table = pa.ListArray.from_arrays(
            pa.array(np.concatenate([self.stops, self.stops[-1] + np.cumsum(head_lengths)]), pa.int32()), pa.array(np.concatenate([self.ids, head_ids]))
        )
        taken = table.take(pa.array(own))
        out = pa.ListArray.from_arrays(pa.array(taken.offsets.to_numpy()[starts], pa.int32()), taken.values)
        if order is not None:
            out = out.take(order)
        if len(self.known) > self.entries or self.known.nbytes + self.ids.nbytes > TABLE_BYTES:
            own[heads] = 0
            self._keep(np.unique(own))
        return out.values.to_numpy(), np.diff(out.offsets.to_numpy()).astype(np.int64)


class Pieces:
    """``function`` of every piece of a text, with leading spaces put back."""

    def __init__(self, function: Callable[[str], object]):
        self.first, self.later = Memo(function), Memo(function, " ")

    def of(self, text: str) -> list:
        head, *rest = pieces(text)
        out = list(map(self.later.__getitem__, rest))
        if head:
            out.insert(0, self.first[head])
        return out


# ---------------------------------------------------------------- segment tree (rank files)


NO_RANK = 1 << 24  # above every rank; small, so that the tree holds small numbers


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if max(ranks.values(), default=0) >= NO_RANK:
        raise ValueError(f"ranks are to be below {NO_RANK}")
    return ranks


def merge_by_tree(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token. Leaf i of a segment tree holds the rank of joining the token at byte i
    with its right neighbour, times the length, plus i; the root is the leftmost smallest rank. A merge
    changes three leaves (the token, the one it takes in, its left neighbour), whose paths go up together."""
    get = ranks.get
    whole = get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    none = NO_RANK * n
    tree = [none] * n
    for i in range(n):
        rank = get(word[i : i + 2]) if i + 1 < n else None
        tree.append(none if rank is None else rank * n + i)
    for k in range(n - 1, 0, -1):
        x, y = tree[2 * k], tree[2 * k + 1]
        tree[k] = x if x < y else y
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while n > 1 and (top := tree[1]) < none:
        i = top % n
        gone = after[i]
        after[i] = end = after[gone]
        left = before[i]
        tree[n + gone] = tree[n + i] = none
        if end < n:
            before[end] = i
            rank = get(word[i : after[end]])
            if rank is not None:
                tree[n + i] = rank * n + i
        if left >= 0:
            rank = get(word[left:end])
            tree[n + left] = none if rank is None else rank * n + left
        else:
            left = i
        a, b, c = n + left >> 1, n + i >> 1, n + gone >> 1
        while c:  # the last leaf is the deepest, so its path ends last; node 0 is not used
            x, y = tree[2 * c], tree[2 * c + 1]
            tree[c] = x if x < y else y
            if b != c:
                x, y = tree[2 * b], tree[2 * b + 1]
                tree[b] = x if x < y else y
            if a != b:
                x, y = tree[2 * a], tree[2 * a + 1]
                tree[a] = x if x < y else y
            a, b, c = a >> 1, b >> 1, c >> 1
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Merger:
    """``merge_by_tree`` of many words: the trees of all words of one length are rows of an array and merge in lockstep.
    Every token at hand is in the ranks, so the rank of joining two is looked up by theirs."""

    def __init__(self, ranks: dict[bytes, int], rows: int = 4096, longest: int = 64, fewest: int = 16):
        self.ranks, self.rows, self.longest, self.fewest = ranks, rows, longest, fewest
        get, pairs = ranks.get, {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        keys, joined = np.array([*pairs, -1], np.int64), np.array([*pairs.values(), NO_RANK], np.int64)
        order = np.argsort(keys)
        self.keys, self.joined = keys[order], joined[order]
        self.bytes = np.array([get(bytes([b]), -1) for b in range(256)], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 24 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NO_RANK)

    def _rows(self, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of n > 1 bytes, and how many each has."""
        m, none, w = len(words), NO_RANK * n, 2 * n
        ids = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((m, w), none)
        first = self._rank(ids.reshape(m, n)[:, :-1], ids.reshape(m, n)[:, 1:])
        tree[:, n : w - 1] = np.where(first < NO_RANK, first * n + np.arange(n - 1), none)
        for k in range(n - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        tree = tree.reshape(-1)
        after, before = np.tile(np.arange(1, n + 2), m), np.tile(np.arange(-1, n), m)  # n + 1 a word: its end has a place
        alive, row = np.ones(m * n, bool), np.arange(m)
        while True:
            top = tree[row * w + 1]
            row, top = row[top < none], top[top < none]
            if not len(row):
                return ids[alive], alive.reshape(m, n).sum(1)
            at, link, leaf = row * n, row * (n + 1), row * w + n
            rank, i = np.divmod(top, n)
            gone = after[link + i]
            end, left = after[link + gone], before[link + i]
            after[link + i] = end
            before[link + end] = i
            ids[at + i] = rank
            alive[at + gone] = False
            tree[leaf + gone] = none
            new = self._rank(rank, ids[at + np.minimum(end, n - 1)])
            own = np.where((end < n) & (new < NO_RANK), new * n + i, none)
            tree[leaf + i] = own
            new = self._rank(ids[at + np.maximum(left, 0)], rank)
            tree[leaf + np.maximum(left, 0)] = np.where(left < 0, tree[leaf + np.maximum(left, 0)], np.where(new < NO_RANK, new * n + left, none))
            a, b, c, base = n + np.where(left < 0, i, left) >> 1, n + i >> 1, n + gone >> 1, row * w
            while c.any():  # as in merge_by_tree: the last leaf is the deepest
                for node in (c, b, a):
                    low = base + 2 * node
                    tree[base + node] = np.minimum(tree[low], tree[low + 1])
                a, b, c = a >> 1, b >> 1, c >> 1

    def of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            else:
                by_length.setdefault(len(word), []).append(k)
        for n, places in by_length.items():
            if not 1 < n <= self.longest or len(places) < self.fewest:
                for k in places:
                    out[k] = np.array(merge_by_tree(words[k], self.ranks), "<i4").tobytes()
                continue
            for start in range(0, len(places), self.rows):
                part = places[start : start + self.rows]
                ids, lengths = self._rows([words[k] for k in part], n)
                raw, stops = ids.astype("<i4").tobytes(), (4 * np.cumsum(lengths)).tolist()
                for k, i, j in zip(part, [0, *stops], stops):
                    out[k] = raw[i:j]
        return out


# ---------------------------------------------------------------- heap and linked list (merge files)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(0x100 + k)] = b
    return letters


class MergeTable:
    """The merges of a tokenizer file by pair of ids, and its special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are counted")
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        if any(token[k] for token in spec["added_tokens"] for k in plain):
            raise ValueError("added tokens that take in their surroundings are not counted")
        vocab = model["vocab"]
        self.special = [token["content"] for token in spec["added_tokens"]]
        self.first = [0] * 256
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.joined: list[int] = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << 20 | vocab[b], len(self.joined))
            self.joined.append(vocab[a + b])

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token: its bytes less the merges. A heap gives the lowest-rank, leftmost pair;
        neighbours are linked; entries of pairs that have changed are skipped when popped."""
        n = left = len(word)
        ids = [self.first[b] for b in word]
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            r = rank(ids[i] << 20 | ids[i + 1])
            if r is not None:
                heap.append(r * n + i)
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = self.joined[r], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(ids[i] << 20 | ids[k])
                if r is not None:
                    heapq.heappush(heap, r * n + i)
            p = before[i]
            if p >= 0:
                r = rank(ids[p] << 20 | ids[i])
                if r is not None:
                    heapq.heappush(heap, r * n + p)
        return left


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pre-tokenizer's pattern; characters that it leaves out are left out."""
    return regex.compile(pattern).findall
