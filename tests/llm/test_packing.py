"""Packing: ids against the library, plans against their rules and small optima, placing against the pieces."""

import collections
import functools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftmill.llm import packing
from siftmill.llm.queries import BPE_JSON, WORD_JSON
from tests.llm.data import DOC_DDL, awkward, documents


@pytest.mark.parametrize("path", [WORD_JSON, BPE_JSON])
def test_ids_equal_the_library(path):
    pick, library = random.Random(5), Tokenizer.from_file(path)
    odd = list("abcTH   \n\t\r'sdl129é漢字ñ .,!?-\x1c\x85\xa0　​😀\x00ßÀÿµªº×÷İΣς́̈<|>") + ["<|endoftext|>", "<|startoftext|>", "'s", "'S", "'re", "the ", " of"]
    texts = ["", " ", *("".join(pick.choice(odd) for _ in range(pick.randrange(60))) for _ in range(800))]
    for entries in (500_000, 40):
        encoder = packing.WordEncoder(path, entries)
        assert encoder.by_words == (path == WORD_JSON)
        for a in range(0, len(texts), 97):
            part = texts[a : a + 97]
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.of(part)] == [library.encode(t, add_special_tokens=False).ids for t in part]


def filled(rows, limit):
    """Sequences of a plan as sorted (offset, length) lists; checks that ranks follow on."""
    seen, out = collections.Counter(), collections.defaultdict(list)
    for length, rank, times, first, offset in rows.tolist():
        assert seen[length] == rank
        seen[length] += times
        for t in range(times):
            out[first + t].append((offset, length))
    for parts in out.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= limit
    assert sorted(out) == list(range(len(out)))
    return seen, out


def fewest(lengths, limit):
    @functools.cache
    def bins(left, room):
        if not left:
            return 0
        best = len(left) + 1
        for k, x in enumerate(left):
            if k and left[k - 1] == x:
                continue
            rest = left[:k] + left[k + 1 :]
            best = min(best, bins(rest, room - x) if x <= room else 1 + bins(rest, limit - x))
        return best

    return bins(tuple(sorted(lengths)), 0)


def test_plans_place_everything_once():
    pick = random.Random(6)
    for _ in range(200):
        limit = pick.choice([8, 16, 64])
        counts = {pick.randrange(1, limit + 1): pick.randrange(1, 30) for _ in range(pick.randrange(20))}
        assert filled(packing.plan(counts, limit), limit)[0] == collections.Counter(counts)


def test_plans_are_close_to_the_fewest():
    pick = random.Random(7)
    for _ in range(60):
        lengths = [pick.randrange(1, 13) for _ in range(pick.randrange(1, 10))]
        got = len(filled(packing.plan(collections.Counter(lengths), 12), 12)[1])
        assert fewest(lengths, 12) <= got <= fewest(lengths, 12) + 1
    many = np.minimum(4096, np.random.default_rng(3).lognormal(5.5, 1.2, 50_000).astype(int) + 1)
    rows = packing.plan(collections.Counter(many.tolist()))
    assert int((rows[:, 2] + rows[:, 3]).max()) <= -(-int(many.sum()) // 4096) + 1


def test_exact_sums_are_used_under_the_numbers_left():
    left = np.zeros(101, np.int64)
    left[[10, 25, 30, 45]] = [2, 1, 1, 1]
    sums = packing.Complements(left)
    assert sums.exact(45) == (45,) and sums.exact(20) == (10, 10) and sums.exact(65) == (45, 10, 10) and sums.exact(66) is None
    assert sums.exact(55) == (45, 10)
    left[10] = 1
    assert sums.pair(20) is None and sums.exact(65) == (30, 25, 10) and not sums.pair(20)


@pytest.mark.parametrize("limit", [16, packing.LIMIT])
def test_pieces_lie_where_the_plan_says(spark, limit):
    library = Tokenizer.from_file(WORD_JSON)
    texts = awkward() + [(20, "again"), (None, "no key"), (600, "one " * (limit - 1)), (601, "one " * limit)]
    packed = packing.pack(documents(spark, texts), WORD_JSON, limit)
    rows, want = packed.collect(), []
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(str(i), k, a, tuple(ids[a : a + limit])) for k, a in enumerate(range(0, len(ids), limit))]
    assert sorted((str(r.doc_id), r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == sorted(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for parts in by.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(x[1] for x in parts[:k]) for k in range(len(parts))] and sum(p[1] for p in parts) <= limit
    assert len(by) <= -(-sum(r.length for r in rows) // limit) + 1
    whole = {r.sequence_id: (r.n_tokens, bytes(r.ids), len(r.pieces)) for r in packing.sequences(packed).collect()}
    assert whole == {k: (sum(p[1] for p in parts), b"".join(p[2] for p in parts), len(parts)) for k, parts in by.items()}


def test_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], DOC_DDL), WORD_JSON).count() == 0


def test_tokenizer_paths_are_parameters():
    assert public_tokenizers.path("word_bpe_49k.json") == WORD_JSON
