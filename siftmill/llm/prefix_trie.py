"""The trie of conversation prefixes: which turns many conversations begin with, and what sharing them saves.

1. A conversation is a path of turn digests, one row; equal paths are folded before anything moves
   on, so a dialogue that a third of all conversations copy is one row with a count.
2. Paths are dealt into ranges and sorted. A task builds shards of bounded size: the trie of the
   shard as balanced parentheses. Blocks of their excess with a tree of block minima answer findclose,
   which delimits a node's subtree; rank over leaf pairs counts its leaves; cumulative arrays over the
   nodes give members and savings, a table of range minima the smallest member.
3. Only the first and the last path of a shard can share nodes with other shards. All other nodes are
   done. Those two spines go on as one row each, with what hangs on every node of theirs, and are
   merged by the same step over fewer and fewer ranges until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.llm.base import slices
from siftmill.session import written_table

TOKEN = 32  # hexadecimal digits of a turn's digest in a path
SHARD_NODES = 1 << 17
BLOCK = 64  # parentheses of an excess block
IDS = 4096  # ids of one chunk of a member list
NOBODY = (1 << 63) - 1

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends string, node_key binary, parent_key binary"
STRAND = "path string, sizes array<bigint>, since bigint, members array<bigint>, firsts array<bigint>, saved array<bigint>, leaves array<bigint>, children array<bigint>, end_hashes array<string>"
NODE_NAMES, STRAND_NAMES = ([column.split()[0] for column in ddl.split(", ")] for ddl in (NODE, STRAND))


# ---------------------------------------------------------------- paths


def conversation_paths(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, as (digest of role and text, bytes of text).

    Turns are ordered by number, null first; turns of one number by digest. A null role or text is
    empty. Rows without a conversation id belong to none and are left out. A turn takes some 50 bytes,
    a conversation is one row. Other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, TOKEN)
    turns = conversations.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv_id"), F.struct(F.col("turn").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size")).alias("t"))
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


# ---------------------------------------------------------------- balanced parentheses


class Parentheses:
    """A trie as balanced parentheses: 1 opens a node, 0 closes it, in the order of a walk."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.opens = np.flatnonzero(self.bits)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        blocks = max(1, -(-len(bits) // BLOCK))
        wide = 1 << (blocks - 1).bit_length()
        padded = np.full(wide * BLOCK, len(bits) + 1, np.int64)
        padded[: len(bits)] = self.excess
        self.least = np.full(2 * wide, len(bits) + 1, np.int64)  # a tree over the blocks' least excess
        self.least[wide:] = padded.reshape(wide, BLOCK).min(1)
        for k in range(wide.bit_length() - 2, -1, -1):
            a = 1 << k
            self.least[a : 2 * a] = self.least[2 * a : 4 * a].reshape(-1, 2).min(1)
        self.padded, self.wide = padded, wide

    def _scan(self, at: np.ndarray, below: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Move places on inside their blocks up to an excess of at most ``below``; those that leave their block."""
        left = []
        while len(who):
            who = who[self.padded[at[who]] > below[who]]
            at[who] += 1
            out = at[who] % BLOCK == 0
            left.append(who[out])
            who = who[~out]
        return np.concatenate(left) if left else who

    def find_close(self) -> np.ndarray:
        """The closing place of every node: the first behind it whose excess is one less."""
        at, below = self.opens + 1, self.excess[self.opens] - 1
        started = at % BLOCK != 0
        on = np.concatenate([self._scan(at, below, np.flatnonzero(started)), np.flatnonzero(~started)])
        node = self.wide + at // BLOCK
        climbing = on
        while len(climbing):  # up to a tree node whose blocks go low enough, always to the right
            climbing = climbing[self.least[node[climbing]] > below[climbing]]
            node[climbing] = np.where(node[climbing] & 1, (node[climbing] + 1) >> 1, node[climbing] + 1)
        going = on[node[on] < self.wide]
        while len(going):  # down to the first such block
            node[going] = 2 * node[going] + (self.least[2 * node[going]] > below[going])
            going = going[node[going] < self.wide]
        at[on] = (node[on] - self.wide) * BLOCK
        self._scan(at, below, on)
        return at

    def leaf_rank(self, counted: np.ndarray) -> np.ndarray:
        """Before every place, the pairs () whose node is ``counted``."""
        pair = np.zeros(len(self.bits), np.int64)
        closes_next = ~self.bits[self.opens + 1]
        pair[self.opens[closes_next & counted]] = 1
        return np.concatenate([[0], np.cumsum(pair)])


def _range_min(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.int64)
    power = np.frexp(stop - start)[1] - 1  # floor of the binary logarithm of the width
    table, width = values, 1
    for k in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(table[start[own]], table[stop[own] - width])
        table, width = np.minimum(table[:-width], table[width:]) if len(table) > width else table, 2 * width
    return out


# ---------------------------------------------------------------- shards


class _Shard:
    """The trie of sorted strands. A strand is a path with values for its nodes from depth ``since`` on."""

    def __init__(self):
        self.bits, self.depth, self.size, self.parent, self.keys = bytearray(b"\1"), [0], [0], [-1], [b""]
        self.members, self.firsts, self.saved, self.leaves, self.children, self.ends = [0], [NOBODY], [0], [0], [0], [None]
        self.stack, self.path, self.left = [0], "", None

    def add(self, path, sizes, since, members, firsts, saved, leaves, children, ends) -> None:
        depth, before, same = len(path) // TOKEN, len(self.path) // TOKEN, 0
        if path.startswith(self.path):
            same = before
        else:
            while same < depth and path.startswith(self.path[same * TOKEN : (same + 1) * TOKEN], same * TOKEN):
                same += 1
        del self.stack[same + 1 :]
        for d in range(same + 1, depth + 1):
            above = self.stack[-1]
            self.parent.append(above)
            self.keys.append(hashlib.blake2b(self.keys[above] + path[(d - 1) * TOKEN : d * TOKEN].encode(), digest_size=16).digest())
            self.stack.append(len(self.depth))
            self.depth.append(d)
            self.size.append(sizes[d - 1])
        new = depth - same
        self.bits += bytes(before - same) + b"\1" * new
        for own, empty in ((self.members, 0), (self.firsts, NOBODY), (self.saved, 0), (self.leaves, 0), (self.children, 0), (self.ends, None)):
            own += [empty] * new
        for k, v in enumerate(self.stack[since:]):
            self.members[v] += members[k]
            self.firsts[v] = min(self.firsts[v], firsts[k])
            self.saved[v] += saved[k]
            self.leaves[v] += leaves[k]
            self.children[v] += children[k]
            self.ends[v] = self.ends[v] or ends[k]
        self.path = path
        if self.left is None:
            self.left = path, list(self.stack)

    def close(self, last: bool) -> pa.RecordBatch:
        """Rows of the nodes that are done, and of the spines (none in the last round)."""
        tree = Parentheses(np.frombuffer(bytes(self.bits) + bytes(len(self.stack)), np.uint8))
        close = tree.find_close()
        v = np.arange(len(self.depth))
        stop = v + (close - tree.opens + 1) // 2  # nodes of a subtree stand together
        depth, parent, size = (np.array(x, np.int64) for x in (self.depth, self.parent, self.size))
        hanging = np.array(self.children, np.int64)

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[stop] - total[v]

        n_convs = below(np.array(self.members, np.int64))
        children = np.bincount(parent[1:], minlength=len(v)) + hanging
        rank = tree.leaf_rank(hanging == 0)
        leaves = rank[close] - rank[tree.opens] + below(np.array(self.leaves, np.int64))
        own = (n_convs - 1) * size
        saved = below(own + np.array(self.saved, np.int64))
        firsts = _range_min(np.array(self.firsts, np.int64), v, stop)
        spine, strands = np.zeros(len(v), bool), []
        if not last:
            (left_path, left), right = self.left, self.stack
            spine[left + right] = True
            rest = {"members": n_convs.copy(), "saved": saved - own, "leaves": leaves - (children == 0), "children": children.copy()}
            for x in np.flatnonzero(spine)[1:].tolist():  # what hangs on a spine's node, without the spine itself
                above = self.parent[x]
                rest["members"][above] -= n_convs[x]
                rest["saved"][above] -= saved[x]
                rest["leaves"][above] -= leaves[x]
                rest["children"][above] -= 1
            shared = sum(a == b for a, b in zip(left, right))
            for path, nodes, since in ((left_path, left, 0), (self.path, right, shared)):
                mine = nodes[since:]
                if mine:
                    values = [rest["members"][mine], firsts[mine], rest["saved"][mine], rest["leaves"][mine], rest["children"][mine]]
                    strands.append((path, size[nodes[1:]].tolist(), since, *(x.tolist() for x in values), [self.ends[x] for x in mine]))
        done = np.flatnonzero(~spine)
        above = parent[done]
        known = (above >= 0) & ~spine[above]
        waits = (above >= 0) & spine[above]
        nodes = [firsts[done], depth[done], pa.array(firsts[above], mask=~known), n_convs[done], children[done], leaves[done], saved[done]]
        nodes += [pa.array([self.ends[x] for x in done.tolist()], pa.string()), pa.array([self.keys[x] for x in done.tolist()], pa.binary())]
        nodes += [pa.array([self.keys[p] if w else None for p, w in zip(above.tolist(), waits.tolist())], pa.binary())]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string())]
        columns = [pa.concat_arrays([c, pa.nulls(len(strands), c.type)]) for c in (x if isinstance(x, pa.Array) else pa.array(x) for x in nodes)]
        columns += [pa.array([None] * len(done) + [s[k] for s in strands], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, NODE_NAMES + STRAND_NAMES)


def _step(strands: DataFrame, last: bool, shard_nodes: int) -> DataFrame:
    """Node rows and spine rows of sorted ranges of strands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(*row)
                if len(shard.depth) >= shard_nodes and not last:
                    yield shard.close(last)
                    shard = _Shard()
        if shard.left:
            yield shard.close(last)

    return written_table(strands.sortWithinPartitions("path").mapInArrow(run, f"{NODE}, {STRAND}"), "trie")


def _ends(paths: DataFrame) -> DataFrame:
    """(end, ends): the digest of the ascending ids of the conversations that are one path. Ids are joined in chunks of
    bounded size first; a path's chunks then pass through one hash in order, which no split can do for it."""
    chunks = paths.groupBy("end", F.shiftright("conv_id", IDS.bit_length() - 1).alias("chunk"))
    chunks = chunks.agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def row(end: bytes, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([text])], ["end", "ends"])

        for batch in slices(batches):
            ended, texts = [], []
            for end, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if end == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    ended.append(now)
                    texts.append(digest.hexdigest())
                now, digest = end, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ended, pa.binary()), pa.array(texts, pa.string())], ["end", "ends"])
        if now is not None:
            yield row(now, digest.hexdigest())

    return chunks.repartition("end").sortWithinPartitions("end", "chunk").mapInArrow(run, "end binary, ends string")


def prefix_trie(paths: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    ``paths`` has one row per conversation, as ``conversation_paths`` gives them. A node is a sequence
    of first turns: the root has none; its members are the conversations that begin with it and
    ``conv_id`` is the smallest of them, which with the depth names it. ``saved_tokens`` sums over the
    subtree how many bytes of last turns members beyond the first repeat; ``ends_sha256`` is the digest of
    the comma-joined ids of the members that have no further turn. A conversation without turns
    ends at the root; without any conversation there is no node.
    """
    rows = paths.select("conv_id", F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = written_table(rows.withColumn("end", F.unhex(F.substring(F.sha2("path", 256), 1, TOKEN))), "trie-paths")
    folded = rows.groupBy("end").agg(F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first"))
    none = F.array(F.lit(0).cast("bigint"))
    strands = folded.join(_ends(rows), "end").select("path", "sizes", F.size("sizes").cast("bigint").alias("since"), F.array("n"), F.array("first"), none, none, none, F.array("ends")).toDF(*STRAND_NAMES)
    rounds, dealt, before, last = [], strands.repartitionByRange("path"), None, False
    while True:
        out = _step(dealt, last, shard_nodes)
        rounds.append(out.filter("depth is not null").select(*NODE_NAMES))
        spines = out.filter("path is not null").select(*STRAND_NAMES)
        left = 0 if last else spines.agg(F.sum(F.size("members"))).first()[0] or 0
        if not left:
            break
        last = left <= shard_nodes or before is not None and 2 * left > before  # paths as long as shards are merged at once
        dealt, before = (spines.coalesce(1) if last else spines.repartitionByRange(-(-left // shard_nodes), "path")), left
    nodes, named = rounds[0], None
    for more in rounds[1:]:
        nodes = nodes.unionByName(more)
        names = more.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above"))
        named = names if named is None else named.unionByName(names)
    if named is not None:
        waiting = nodes.filter("parent_key is not null").join(named, "parent_key").withColumn("parent_conv_id", F.col("above")).select(*NODE_NAMES)
        nodes = nodes.filter("parent_key is null").unionByName(waiting)
    ends = F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
