"""Encoders, counters and token files against the tokenizer libraries and round trips."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from siftmill.llm import bpe, bpe_codec, range_coder, token_count, token_files
from siftmill.llm.queries import BPE_JSON, MULTI_RANKS
from siftmill.session import shared_folder
from tests.llm.data import DOC_DDL, awkward, documents


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    odd = list("abcTH   \n\t\r'sdl129é漢字ñ .,!?-\x1c\x85\xa0\u3000\u200b😀\x00") + ["<|endoftext|>", "'s", "  ", " \n", "the ", " of"]
    return awkward() + [(1000 + i, "".join(rng.choice(odd) for _ in range(rng.randrange(60)))) for i in range(400)] + [(20, "again"), (None, "no key")]


def test_pieces_put_together_are_the_text(texts):
    for _, t in texts:
        head, *rest = bpe.pieces(t or "")
        assert head + "".join(" " + p for p in rest) == (t or "")


def test_codec_equals_the_library(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI_RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe_codec.encode(documents(spark, texts), MULTI_RANKS, public_tokenizers.PATTERN)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    rows = bpe_codec.digests(bpe_codec.decode(ids, MULTI_RANKS)).collect()
    want = []
    for i, t in texts:
        own = library.encode_ordinary(t or "")
        want.append((i, len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(BPE_JSON)
    rows = token_count.count_tokens(documents(spark, texts), BPE_JSON, public_tokenizers.PATTERN).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in texts]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, rows), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    none = spark.createDataFrame([], DOC_DDL)
    assert token_count.count_tokens(none, BPE_JSON, public_tokenizers.PATTERN).count() == 0
    assert bpe_codec.decode(bpe_codec.encode(none, MULTI_RANKS, public_tokenizers.PATTERN), MULTI_RANKS).count() == 0


@pytest.mark.parametrize("segment_ids", [700, token_files.SEGMENT_IDS])
def test_token_files_hold_all_ids_in_order(spark, texts, segment_ids):
    library = Tokenizer.from_file(BPE_JSON)
    path = f"{shared_folder(spark)}/tokens-test-{segment_ids}-{random.random()}"
    token_files.write_files(documents(spark, texts), path, BPE_JSON, segment_ids=segment_ids)
    start, want = 0, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, token_files.digests(spark, path).collect()), key=lambda r: r[1]) == want


def test_token_files_of_an_empty_table(spark):
    path = f"{shared_folder(spark)}/tokens-none-{random.random()}"
    token_files.write_files(spark.createDataFrame([], DOC_DDL), path, BPE_JSON)
    assert token_files.digests(spark, path).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 2049, 10000])
def test_range_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in ((rng.zipf(1.3, n) % 50257).astype(np.uint32), np.zeros(n, np.uint32), rng.integers(0, 1 << 16, n).astype(np.uint32)):
        blocks = range_coder.encode_ids(ids)
        assert (range_coder.decode_ids(blocks) == ids).all() and sum(b[0] for b in blocks) == n


def test_range_coder_blocks_stand_alone_and_are_checked():
    ids = (np.arange(9000) % 77).astype(np.uint32)
    blocks = range_coder.encode_ids(ids)
    assert (range_coder.decode_ids(blocks[2:3]) == ids[4096:6144]).all()
    n, crc, blob = blocks[1]
    with pytest.raises(ValueError):
        range_coder.decode_ids([(n, crc, bytes([blob[0] ^ 255]) + blob[1:])])
    with pytest.raises(ValueError):
        range_coder.encode_ids(np.array([1 << 16]))
    assert sum(len(b[2]) for b in blocks) < len(ids) / 2


def test_tree_merges_words_of_any_length_like_the_library():
    ranks, pick = bpe.read_ranks(MULTI_RANKS), random.Random(7)
    library = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64, 100, 3000]:
        for letters in ("ab", "aaaa", "theinro ", "éñ漢 a"):
            word = "".join(pick.choice(letters) for _ in range(n))
            assert bpe.merge_by_tree(word.encode(), ranks) == library.encode(word)


def test_joined_pieces_get_the_ids_that_the_library_gives_alone():
    tokenizer, pick = Tokenizer.from_file(BPE_JSON), random.Random(7)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", "é", "9", "'s", "<", ".", "漢"]
    texts = ["", " ", "a ", " a", *("".join(pick.choice(bits) for _ in range(40)) for _ in range(200))]
    want = [list(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    joined, alone = token_files._Encoder(tokenizer), token_files._Encoder(tokenizer, entries=10)
    alone.mark = ""  # a tokenizer without a special string
    for encoder in (joined, alone):
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.of(texts)] == want


def test_pieces_are_asked_for_once_and_end_at_line_ends():
    encoder, asked = token_files._Encoder(Tokenizer.from_file(BPE_JSON)), []
    alone = encoder._alone
    encoder._alone = lambda texts: asked.extend(texts) or alone(texts)
    texts = ["one two three", "two three.\nOne two", "one two\nthree three.\nTwo"]
    first = encoder.of(texts)
    del asked[:]
    assert encoder.of(texts + ["one three.\nTwo three\nthree"])[:3] == first
    assert sorted(asked) == ["one", "one", "one", "two"]  # only what texts begin with


@pytest.mark.parametrize("entries", [1, 50, 800_000])
def test_ids_of_crowded_and_odd_texts_are_the_librarys(texts, entries):
    tokenizer = Tokenizer.from_file(BPE_JSON)
    own = [t or "" for _, t in texts] + ["a\n", "\na", "a\n\nb", "a \nb", "a\n b c\nd", "\t\n", "a　\nb", "a b\n<|endoftext|>\nc", "\x1c \x1d\nx"]
    encoder = token_files._Encoder(tokenizer, entries=entries)
    for group in (own, own[::-1], own[::3]):
        want = [list(e.ids) for e in tokenizer.encode_batch(group, add_special_tokens=False)]
        assert [np.frombuffer(raw, "<u4").tolist() for raw in encoder.of(group)] == want


def test_token_files_keep_the_type_of_their_keys(spark):
    for kind in ("int", "string"):
        path = f"{shared_folder(spark)}/tokens-{kind}-{random.random()}"
        token_files.write_files(documents(spark, [(1, "a b"), (2, None), (3, "c")]).selectExpr(f"cast(doc_id as {kind}) doc_id", "text"), path, BPE_JSON)
        back = token_files.digests(spark, path)
        assert dict(back.dtypes)["doc_id"] == kind and [tuple(r)[1:3] for r in back.orderBy("start").collect()] == [(0, 3), (3, 1), (4, 2)]


def test_rare_outcomes_take_no_more_than_a_word_in_two_steps():
    rng = np.random.default_rng(5)
    steady = np.tile(np.arange(64, dtype=np.uint32), 96)
    steady[rng.integers(0, len(steady), 60)] = rng.integers(0, 1 << 16, 60)  # new ids where an old one was all but sure
    steady[2000:2100], steady[4096:4200] = rng.integers(0, 1 << 16, 100), rng.integers(0, 1 << 16, 104)
    blocks = range_coder.encode_ids(steady)
    assert (range_coder.decode_ids(blocks) == steady).all() and sum(len(b[2]) for b in blocks) < len(steady) / 2


def test_codec_asks_for_a_piece_and_merges_a_word_once():
    encoder, asked, merged = bpe_codec._Encoder(MULTI_RANKS, public_tokenizers.PATTERN), [], []
    alone, of = encoder._alone, encoder.merger.of
    encoder._alone = lambda texts: asked.extend(texts) or alone(texts)
    encoder.merger.of = lambda words: merged.extend(words) or of(words)
    column = bpe_codec.pa.array(["a Hello there.\nHello you", "a Hello there.\nHello", "", "you"])
    first = encoder.columns(column)
    del asked[:]
    again = encoder.columns(column)
    assert (first[0] == again[0]).all() and first[1].tolist() == again[1].tolist() and first[1][2] == 0
    assert asked == ["a", "a", "", "you"] and len(merged) == len(set(merged))  # only what texts begin with


def test_trees_in_lockstep_merge_like_one_tree():
    ranks, pick = bpe.read_ranks(MULTI_RANKS), random.Random(9)
    merger = bpe.Merger(ranks, rows=100)
    words = [("".join(pick.choice(letters) for _ in range(n))).encode() for n in [*range(1, 40), 63, 64, 65, 90] for letters in ("ab", "aaaa", "theinro ", "éñ漢 a") for _ in range(40)]
    assert [np.frombuffer(raw, "<i4").tolist() for raw in merger.of(words)] == [bpe.merge_by_tree(w, ranks) for w in words]


@pytest.mark.parametrize("entries", [1, 800_000])
def test_codec_of_crowded_texts_equals_the_library(texts, entries):
    ranks = bpe.read_ranks(MULTI_RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = [t or "" for _, t in texts] + ["a\n", "\na", "a\n\nb", "a \nb", "a\n b c\nd", "\t\n", "a　\nb", "\x1c \x1d\nx"]
    encoder = bpe_codec._Encoder(MULTI_RANKS, public_tokenizers.PATTERN, entries)
    for group in (own, own[::-1], own[::3]):
        ids, lengths = encoder.columns(bpe_codec.pa.array(group, "string"))
        assert [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])] == [library.encode_ordinary(t) for t in group]


def test_decoding_keeps_null_rows_and_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    spelled = {rank: token for token, rank in bpe.read_ranks(MULTI_RANKS).items()}
    assert sorted((r.doc_id, r.decoded) for r in bpe_codec.decode(rows, MULTI_RANKS).collect()) == [(1, bytearray(spelled[0] + spelled[1])), (2, None), (3, bytearray())]
    with pytest.raises(Exception):
        bpe_codec.decode(spark.createDataFrame([(1, [1 << 20])], "doc_id bigint, ids array<int>"), MULTI_RANKS).collect()
