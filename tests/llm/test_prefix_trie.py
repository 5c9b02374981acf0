"""The prefix trie against one held in a dictionary."""

import collections
import hashlib
import random

import numpy as np
import pytest

from siftmill.llm import prefix_trie
from siftmill.llm.queries import with_shared_heads

TURN_DDL = "conv_id bigint, turn bigint, role string, text string, path string, n bigint, depth int, digest string"


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "p", 1, 2, "d") for c, t, r, x in rows], TURN_DDL)


def dialogues(seed=1, convs=150):
    pick, rows = random.Random(seed), []
    for c in range(convs):
        kind = c % 5
        turns = [("user", f"hello {pick.randrange(2)}")] if kind < 4 else []
        turns += [(pick.choice(["user", "bot"]), pick.choice(["yes", "no", "é漢", ""])) for _ in range(pick.randrange(7))]
        if kind == 2:
            turns = [("user", "hello 0"), ("bot", "the same"), ("user", "for all")]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(900, None, None, "first"), (900, 5, "user", None), (900, 7, "", ""), (901, 1, "user", "deep"), *((901, 2 + k, "bot", "again") for k in range(300))]
    return rows + [(None, 1, "user", "nobody's"), (902, 3, "user", "twin"), (902, 3, "user", "twin")]


def in_order(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, (r or "", x or "")))
    return {c: [x for *_, x in sorted(turns, key=lambda y: y[:2])] for c, turns in by.items()}


def trie(convs):
    """{(conv_id, depth): the other columns} by a dictionary of prefixes."""
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(of) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return {(of[0], len(p)): (members[p[:-1]][0] if p else None, len(of), kids[p], leaves[p], saved[p], sha(p)) for p, of in members.items()}


def collected(nodes):
    rows = nodes.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard_nodes", [7, 60, prefix_trie.SHARD_NODES])
def test_nodes_equal_a_dictionary_of_prefixes(spark, shard_nodes):
    rows = dialogues()
    paths = prefix_trie.conversation_paths(table(spark, rows).repartition(5))
    assert collected(prefix_trie.prefix_trie(paths, shard_nodes)) == trie(in_order(rows))


def test_conversations_without_turns_end_at_the_root(spark):
    paths = spark.createDataFrame([(5, []), (-3, []), (9, [("a" * 32, 4)])], "conv_id bigint, turns array<struct<digest:string,size:bigint>>")
    empty = hashlib.sha256(b"-3,5").hexdigest()
    assert collected(prefix_trie.prefix_trie(paths)) == {(-3, 0): (None, 3, 1, 1, 0, empty), (9, 1): (-3, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())}
    assert prefix_trie.prefix_trie(paths.limit(0)).count() == 0
    assert prefix_trie.conversation_paths(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_member_lists_longer_than_a_chunk(spark):
    rows = [(c, 1, "user", "all") for c in range(-5000, 9000)]
    got = collected(prefix_trie.prefix_trie(prefix_trie.conversation_paths(table(spark, rows))))
    assert got[-5000, 1][5] == hashlib.sha256(",".join(map(str, range(-5000, 9000))).encode()).hexdigest()
    assert got[-5000, 0][4] == 13999 * 3


def test_shared_heads(spark):
    import zlib

    rows = dialogues(2)
    convs = in_order(rows)
    want = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - c % 5
        want[c] = convs.get(base, [])[:h] + own[h:]
    paths = prefix_trie.conversation_paths(table(spark, rows))
    assert collected(prefix_trie.prefix_trie(with_shared_heads(paths))) == trie(want)


def test_find_close_and_range_min():
    pick = random.Random(4)
    for n in (1, 2, 31, 32, 33, 500, 3000):
        bits, depth = [1], 1
        opened = 1
        while opened < n:
            if pick.random() < 0.55 or depth == 1:
                bits.append(1)
                depth, opened = depth + 1, opened + 1
            else:
                bits.append(0)
                depth -= 1
        bits += [0] * depth
        tree, stack, want = prefix_trie.Parentheses(np.array(bits, np.uint8)), [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        assert tree.find_close().tolist() == [want[i] for i in tree.opens.tolist()]
        values = np.array([pick.randrange(1000) for _ in range(n)])
        start = np.array([pick.randrange(n) for _ in range(50)])
        stop = np.array([pick.randrange(s, n) + 1 for s in start])
        assert prefix_trie._range_min(values, start, stop).tolist() == [values[a:b].min() for a, b in zip(start, stop)]
