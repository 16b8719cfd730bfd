"""Prefix trie of conversations in balanced-parentheses shards.

Each conversation is a path of turn keys (128 bits of role and text). Equal paths are one: their members' ids are put in
order over ranges, written as strings of at most ``CHUNK`` ids and digested from these, so a path that any number of
conversations share is never one group in memory. The distinct paths are sorted over range partitions; a task builds the
trie of its range and cuts it into shards after ``SHARD`` nodes. A shard is one row: packed balanced parentheses,
per-node arrays in preorder, and its first and last path. Shards are Parquet files in the shared folder.

Reading a shard, ``findclose`` by range min-max blocks delimits subtrees, rank counts leaf pairs ``()``, and cumulative
arrays give members and savings of any subtree. Nodes on a shard's first and last path (its spines) may go on in other
shards. They are not counted there: what hangs off them is summed into them, and the two spines, with these sums,
are the paths of a next round over ``FAN`` times fewer tasks, until one shard is left. So only spines are merged, two paths
a shard; all other nodes are final where they are.

Bound: the path of one conversation (16 bytes a turn) is one row.

Defined cases: rows without a conv_id belong to no conversation and are left out; null roles and texts are empty; null
turns come first, equal turns are ordered by their key; repeated rows are turns of their own; no conversations give no
node; other columns are not read.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from pricebook.llm.common import stored
from pricebook.llm.parentheses import Parentheses

SHARD, CHUNK, FAN = 1 << 18, 4096, 64
NONE = np.iinfo(np.int64).max
LONGS, KEYS = pa.list_(pa.int64()), pa.list_(pa.binary())
PATHS = pa.schema([("path", pa.list_(pa.struct([("k", pa.binary()), ("b", pa.int32())]))), ("n", LONGS), ("least", LONGS),
                   ("ends", pa.list_(pa.string())), ("leaves", LONGS), ("children", LONGS), ("saved", LONGS)])
# per node in preorder: bytes of its last text, and what is known of it besides the nodes below it in the shard: members
# that end here, the least of them, the digest of their ids; leaves, children and savings of final subtrees that hang here
SHARDS = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("size", pa.int64()), ("parens", pa.binary()),
                    ("bytes", pa.list_(pa.int32())), *[PATHS.field(i) for i in range(1, 7)], ("key", KEYS), ("first", KEYS), ("last", KEYS)])
NODES = pa.schema([(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
                  + [("ends_sha256", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary())])
STRINGS = pa.schema([("pk", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("pk", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
EMPTY = hashlib.sha256(b"").hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, as keys with the bytes of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)       # no two pairs read alike
    k = F.substring(F.unhex(F.sha2(turn.cast("binary"), 256)), 1, 16)
    t = conversations.where("conv_id is not null").select(
        "conv_id", F.struct("turn", k.alias("k"), F.octet_length(text).alias("b")).alias("t"))
    return (t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
            .select("conv_id", F.transform("t", lambda x: F.struct(x["k"].alias("k"), x["b"].alias("b"))).alias("path")))


def _chunks(batches):
    """Ids of one path, in order, as strings of at most CHUNK ids."""
    held, key = [], None

    def emit():
        return (key, len(held), held[0], ",".join(map(str, held)))

    for batch in batches:
        out = []
        for k, c in zip(batch.column("pk").to_pylist(), batch.column("conv_id").to_pylist()):
            if held and (k != key or len(held) == CHUNK):
                out.append(emit())
                held = []
            key = k
            held.append(c)
        yield _table(out, STRINGS)
    if held:
        yield _table([emit()], STRINGS)


def _digests(batches):
    """Digest, number and least of the ids of each path, from its strings in order."""
    key, n, least, state = None, 0, None, None
    for batch in batches:
        out = []
        for k, m, first, ids in zip(*(batch.column(c).to_pylist() for c in ("pk", "n", "least", "ids"))):
            if state is not None and k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, n, least, state.hexdigest()))
                key, n, least, state = k, 0, first, hashlib.sha256()
            state.update(ids.encode())
            n += m
        yield _table(out, DIGESTS)
    if state is not None:
        yield _table([(key, n, least, state.hexdigest())], DIGESTS)


def _table(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _map(df, function, schema):
    return df.mapInArrow(function, from_arrow_schema(schema))


def distinct_paths(p: DataFrame) -> DataFrame:
    """(path, n, conv_id, ends): each distinct path with the number, the least and the digest of its members' ids."""
    pk = F.unhex(F.sha2(F.array_join(F.transform("path", lambda x: F.hex(x["k"])), "").cast("binary"), 256))
    p = stored(p.select("conv_id", "path", pk.alias("pk")), "trie-paths")
    ids = p.select("pk", "conv_id").repartitionByRange("pk", "conv_id").sortWithinPartitions("pk", "conv_id")
    strings = _map(ids, _chunks, STRINGS)
    ends = _map(strings.repartition("pk").sortWithinPartitions("pk", "least"), _digests, DIGESTS)
    return p.select("conv_id", "path").join(ends.drop("pk"), "conv_id").select("path", "n", "conv_id", "ends")


def _prefix_keys(keys):
    """A digest of each prefix of a path, from the empty one."""
    state = hashlib.sha256()
    out = [state.digest()[:16]]
    for k in keys:
        state.update(k)
        out.append(state.digest()[:16])
    return out


class _Shard:
    """A trie under construction from paths in order."""

    def __init__(self, keyed):
        self.keyed, self.path, self.first = keyed, None, None
        self.stack, self.steps = [], []
        self.bytes, self.n, self.least, self.ends, self.key = [], [], [], [], []
        self.leaves, self.children, self.saved = [], [], []

    def add(self, keys, sizes):
        """Put a path in; its nodes are then on the stack by depth."""
        same = -1
        if self.path is None:
            self.first = keys
        else:
            both = min(len(keys), len(self.path))
            same = next((i for i in range(both) if keys[i] != self.path[i]), both)
        opens = len(keys) - same
        self.steps.append((len(self.stack) - 1 - same, opens))
        del self.stack[same + 1:]
        self.stack.extend(range(len(self.n), len(self.n) + opens))
        self.bytes.extend(([0] if same < 0 else []) + sizes[max(same, 0):])
        for values, start in ((self.n, 0), (self.least, NONE), (self.ends, None), (self.leaves, 0), (self.children, 0), (self.saved, 0)):
            values.extend([start] * opens)
        if self.keyed:
            self.key.extend(_prefix_keys(keys)[same + 1:])
        self.path = keys

    def row(self, part, shard):
        closes, opens = np.array(self.steps, np.int64).T
        p = Parentheses.of_steps(closes, opens)
        return (part, shard, p.n, p.packed.tobytes(), self.bytes, self.n, self.least, self.ends, self.leaves, self.children,
                self.saved, self.key, self.first, self.path)


def _encode(keyed, most):
    """Shards of a task's paths; ``keyed`` paths come from spines and bring arrays, others what their last node has."""
    def run(batches):
        part, count, s = TaskContext.get().partitionId(), 0, _Shard(keyed)
        for batch in batches:
            rows = []
            for path, n, least, ends, *more in zip(*(c.to_pylist() for c in batch.columns)):
                if most and len(s.n) >= most:
                    rows.append(s.row(part, count))
                    count, s = count + 1, _Shard(keyed)
                s.add([x["k"] for x in path], [x["b"] for x in path])
                if not keyed:
                    i = s.stack[-1]
                    s.n[i], s.least[i], s.ends[i] = n, least, ends
                    continue
                for d, i in enumerate(s.stack):
                    s.n[i] += n[d]
                    s.least[i] = min(s.least[i], least[d])
                    s.ends[i] = ends[d] or s.ends[i]
                    for values, given in zip((s.leaves, s.children, s.saved), more):
                        values[i] += given[d]
            yield _table(rows, SHARDS)
        if s.n:
            yield _table([s.row(part, count)], SHARDS)
    return run


def _opened(row):
    """Per node of a shard: depth, parent, members, least member, leaves, children and savings of its subtree."""
    p = Parentheses(np.frombuffer(row["parens"], np.uint8), row["size"])
    size, pairs = p.subtrees()
    at = np.arange(len(size))
    depth = p.excess[p.opens] - 1
    n, leaves, children, saved = (np.array(row[c], np.int64) for c in ("n", "leaves", "children", "saved"))
    below = lambda x: np.concatenate([[0], np.cumsum(x)])[at + size] - np.concatenate([[0], np.cumsum(x)])[at]
    members = below(n)
    leaf = pairs + below(leaves - ((size == 1) & (children > 0)))           # a pair with final children is no leaf
    saving = below((members - 1) * np.array(row["bytes"], np.int64) + saved)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    parent, least = np.full(len(size), -1), np.array(row["least"], np.int64)
    for up, here in zip(levels[:-1], levels[1:]):
        parent[here] = up[np.searchsorted(up, here) - 1]
    for here in reversed(levels[1:]):
        np.minimum.at(least, parent[here], least[here])
    children = children + np.bincount(parent[1:], minlength=len(size))
    return depth, parent, members, least, leaf, children, saving


def _spine(row, parent):
    """Node numbers of the first and the last path."""
    last = [len(parent) - 1]
    while parent[last[-1]] >= 0:
        last.append(int(parent[last[-1]]))
    # the last path may end above the last node opened
    return list(range(len(row["first"]) + 1)), last[::-1][:len(row["last"]) + 1]


def _nodes(whole):
    """The final nodes of each shard: all of them, or those on neither spine."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                depth, parent, members, least, leaf, children, saving = _opened(row)
                first, last = _spine(row, parent)
                open_ = np.zeros(len(depth), bool)
                above = {}
                if not whole:
                    for nodes, keys in ((first, row["first"]), (last, row["last"])):
                        open_[nodes] = True
                        above.update(zip(nodes, _prefix_keys(keys)))
                i = np.flatnonzero(~open_)
                up = parent[i]
                known = (up >= 0) & ~open_[up]
                ends, key = row["ends"], row["key"]
                columns = (least[i], depth[i], pa.array(least[up], mask=~known), members[i], children[i], leaf[i], saving[i],
                           [ends[x] or EMPTY for x in i], [key[x] for x in i] if key else [None] * len(i),
                           [above.get(x) for x in up.tolist()])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(columns, NODES)], schema=NODES)
    return run


def _spines(batches):
    """The first and the last path of each shard with what hangs off them; nodes on both count with the first."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            depth, parent, members, least, leaf, children, saving = _opened(row)
            first, last = _spine(row, parent)
            open_ = np.zeros(len(depth), bool)
            open_[first] = open_[last] = True
            hang = np.flatnonzero(~open_ & open_[parent])
            n, low, lf, ch, sv = (np.array(row[c], np.int64) for c in ("n", "least", "leaves", "children", "saved"))
            for own, below in ((n, members), (lf, leaf), (ch, np.ones(len(depth), np.int64)), (sv, saving)):
                np.add.at(own, parent[hang], below[hang])
            np.minimum.at(low, parent[hang], least[hang])
            for nodes, keys, skip in ((first, row["first"], set()), (last, row["last"], set(first))):
                if skip and nodes[-1] in skip:
                    continue                                    # nothing of its own
                pick = lambda x, none: [none if i in skip else x[i] for i in nodes]
                rows.append(([{"k": k, "b": row["bytes"][i]} for k, i in zip(keys, nodes[1:])],
                             *(pick(x, none) for x, none in ((n, 0), (low, NONE), (row["ends"], None), (lf, 0), (ch, 0), (sv, 0)))))
        yield _table(rows, PATHS)


def shards(rows: DataFrame, most=SHARD) -> DataFrame:
    """The shards of distinct paths, written to the shared folder: one row per shard."""
    return stored(_map(rows.repartitionByRange("path").sortWithinPartitions("path"), _encode(False, most), SHARDS), "trie-shards")


def _merged(below: DataFrame, tasks: int) -> DataFrame:
    spines = _map(below, _spines, PATHS)
    dealt = spines.repartition(1) if tasks == 1 else spines.repartitionByRange(tasks, "path")
    return stored(_map(dealt.sortWithinPartitions("path"), _encode(True, None), SHARDS), "trie-spines")


def trie(p: DataFrame, most=SHARD, fan=FAN) -> DataFrame:
    """One row per node of the trie of (conv_id, path); the root has depth 0 and no parent.

    conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (sum over the subtree of
    members but one, times bytes of the last text), ends_sha256 (ids of the members that end here, in order).
    """
    s, found, before = shards(distinct_paths(p), most), [], None
    while True:
        k = s.count()
        found.append(_map(s, _nodes(k <= 1), NODES))
        if k <= 1:
            break
        # fewer tasks each round; one where that did not halve the shards
        s, before = _merged(s, -(-k // fan) if before is None or 2 * k <= before else 1), k
    nodes = stored(reduce(DataFrame.union, found), "trie-nodes")
    up = nodes.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    inner = nodes.where("parent_key is null").select(*nodes.columns[:8])
    outer = nodes.where("parent_key is not null").drop("parent_conv_id").join(up, "parent_key")
    return inner.union(outer.select(*[F.col("up") if c == "parent_conv_id" else F.col(c) for c in nodes.columns[:8]]))
