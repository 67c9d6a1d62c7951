"""Conversation prefix trie in balanced parentheses.

Conversations that share their first turns share a path of the trie whose nodes are the distinct sequences of first
turns. Equal conversations are one entry with a count. The entries are sorted by their turn digests and dealt to range
partitions; a task cuts its sorted stream into shards of about ``SHARD_TURNS`` turns and writes each shard's trie as a
sequence of parentheses (``Parens``), with the excess minima of 64-bit blocks in a tree above them. ``findclose`` gives
the end of every subtree, from which all measures follow: members and their smallest id from the entries between open
and close, leaves from the rank of ``()`` pairs, savings from the difference of a cumulative array.

A subtree that lies off the paths of a shard's first and last entry is complete in that shard. The nodes on those two
paths, the spines, may go on in neighbouring shards: they leave the shard with partial measures and are merged by
digest. Leaves and savings of a merged spine node also count the spine nodes below it; each of those is owned by the first
path that has it, so a path owns its deeper end: suffix sums over it serve the owned nodes, their total the nodes above,
and a sum by digest adds the paths. Spine rows number two path lengths a shard, so a first turn or conversation that a third of the log shares is a
few rows from each shard and never one group in one task. A node outside the spines whose parent is on one finds it by
(shard, digest), which a popular parent spreads over its shards.

Texts are digested (MD5 of role and text, 128 bits) where they are read and never shuffled; digests stand for texts
and paths. The ids that end at one node are range sorted by (path, id), joined to strings of one Arrow batch each and
digested as a stream, so no list of ids is held whole. A conversation is the smallest unit: the digests of its turns (not
its texts) are one row.

Defined results: rows without a conversation id belong to no conversation; a null role or text is empty; turns are ordered by
number, null first, equal numbers by digest; rows that repeat a turn are turns of their own; conversations without turns end
at the root; very long texts count with their whole length and very long conversations make one long path, at linear
cost; an empty table has no members and so no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import pin

SHARD_TURNS = 1 << 18
BLOCK = 64
# Spine nodes (about 30 bytes each) that are broadcast at most, and the parts a digest is dealt to beyond.
FEW_NODES, SALTS = 200_000, 16
ROOT = bytes(16)
NOTHING = np.iinfo(np.int64).max
NODE_SCHEMA = ("shard long, side int, depth long, key binary, parent_key binary, conv_id long, parent_conv_id long, "
               "n_convs long, n_children long, n_leaves long, saved long, size long, ends string")


class Parens:
    """A balanced sequence of parentheses (1 opens) with block minima of its excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int32) * 2 - 1, dtype=np.int32)
        blocks = -(-len(bits) // BLOCK)
        width = 1 << max(0, (blocks - 1).bit_length())
        low = np.full(width, np.iinfo(np.int32).max, np.int32)
        low[:blocks] = np.minimum.reduceat(self.excess, np.arange(0, len(bits), BLOCK))
        self.low = [low]                                    # low[k][i]: smallest excess in blocks [i << k, (i + 1) << k)
        while len(low) > 1:
            low = np.minimum(low[0::2], low[1::2])
            self.low.append(low)
        pair = np.zeros(len(bits) + 1, np.int64)
        pair[1:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.pairs = np.cumsum(pair)                        # ``()`` pairs that open before a position

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Walk to the end of the block from ``at``; returns the entries of ``live`` not closed there."""
        for _ in range(BLOCK):
            if not len(live):
                break
            hit = self.excess[at[live]] < target[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            inside = at[live] % BLOCK != 0
            if not inside.all():
                self._left.append(live[~inside])
                live = live[inside]
        return live

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each of ``opens``: the next one with a smaller excess."""
        target = self.excess[opens]
        out = np.full(len(opens), -1, np.int64)
        at = opens.astype(np.int64) + 1
        self._left: list[np.ndarray] = []
        fresh = at % BLOCK == 0                             # the block ends with the opening one
        self._scan(at, target, out, np.flatnonzero(~fresh))
        live = np.concatenate([np.flatnonzero(fresh), *self._left])
        if not len(live):
            return out
        node, level = at // BLOCK, np.zeros(len(opens), np.int64)
        found = []
        for k, low in enumerate(self.low):                  # climb: own node, its right sibling, then the next parent
            hit = low[np.minimum(node[live], len(low) - 1)] < target[live]
            right = ~hit & (node[live] % 2 == 0)
            node[live[right]] += 1
            hit[right] = low[np.minimum(node[live[right]], len(low) - 1)] < target[live[right]]
            level[live[hit]] = k
            found.append(live[hit])
            live = live[~hit]
            node[live] = node[live] // 2 + 1
            if not len(live):
                break
        for k in range(len(found) - 1, 0, -1):              # descend to the first block that goes below
            down = np.concatenate(found[k:])
            left = node[down] * 2
            node[down] = left + (self.low[k - 1][left] >= target[down])
        live = np.concatenate(found)
        at[live] = node[live] * BLOCK
        self._scan(at, target, out, live)
        return out


def range_minimum(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest value of every range [start, stop), from a table of minima of power-of-two lengths."""
    out = np.empty(len(start), np.int64)
    span = stop - start
    power = np.frexp(span.astype(np.float64))[1] - 1
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        own = np.flatnonzero(power == k)
        out[own] = np.minimum(table[start[own]], table[stop[own] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
    return out


def shared_turns(keys: np.ndarray, start: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Leading turns that every entry shares with the entry before it; 0 for the first."""
    short = np.minimum(turns[1:], turns[:-1])
    pair = np.repeat(np.arange(len(short)), short)
    step = np.arange(len(pair)) - np.repeat(np.cumsum(short) - short, short)
    same = (keys[start[1:][pair] + step] == keys[start[:-1][pair] + step]).all(axis=1)
    out = np.zeros(len(turns), np.int64)
    some = np.flatnonzero(short)
    if len(some):
        first = (np.cumsum(short) - short)[some]
        out[some + 1] = np.minimum(np.minimum.reduceat(np.where(same, NOTHING, step), first), short[some])
    return out


def encode_shard(shard: int, paths: list[bytes], sizes: np.ndarray, count: np.ndarray, first_id: np.ndarray,
                 ends: list[str]) -> pa.RecordBatch:
    """Nodes of one shard: complete ones with their measures, spine rows with partial ones.

    ``paths`` are distinct and sorted, 16 bytes a turn; ``sizes`` are the turns' text bytes one path after the other.
    """
    keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
    turns = np.fromiter(map(len, paths), np.int64, len(paths)) // 16
    start = np.cumsum(turns) - turns
    lcp = shared_turns(keys, start, turns)
    new = turns - lcp
    # preorder: the root, then of every entry the turns it does not share with the entry before
    at = np.repeat(start + lcp - (np.cumsum(new) - new), new) + np.arange(int(new.sum()))
    depth = np.concatenate(([0], np.repeat(lcp - (np.cumsum(new) - new), new) + np.arange(len(at)) + 1))
    size = np.concatenate(([0], sizes[at]))
    runs = np.empty(2 * len(turns), np.int64)
    runs[0::2] = new
    runs[1:-1:2] = turns[:-1] - lcp[1:]
    runs[0] += 1
    runs[-1] = turns[-1] + 1
    trie = Parens(np.repeat(np.tile(np.array([1, 0], np.uint8), len(turns)), runs))
    opens = np.flatnonzero(trie.bits)
    close = trie.findclose(opens)
    n = len(opens)
    pre = np.arange(n)
    stop = pre + (close - opens + 1) // 2
    end_node = np.cumsum(new)                               # node at which each entry ends
    entry = np.searchsorted(end_node, pre), np.searchsorted(end_node, stop)
    members = np.concatenate(([0], np.cumsum(count)))
    n_convs = members[entry[1]] - members[entry[0]]
    conv = range_minimum(first_id, *entry)
    by_depth = np.lexsort((pre, depth))
    rank = depth[by_depth] * (n + 1) + by_depth
    parent = by_depth[np.maximum(np.searchsorted(rank, (depth - 1) * (n + 1) + pre) - 1, 0)]
    on_first, on_last = pre <= turns[0], stop == n
    spine = on_first | on_last
    leaf_rank = trie.pairs[close + 1] - trie.pairs[opens]
    spine_leaf = np.concatenate(([0], np.cumsum(spine & (stop == pre + 1))))
    n_leaves = leaf_rank - (spine_leaf[stop] - spine_leaf[pre])
    own = np.where(spine, 0, (n_convs - 1) * size)
    savings = np.concatenate(([0], np.cumsum(own)))
    saved = savings[stop] - savings[pre]
    below = np.flatnonzero(~spine)
    children = np.where(spine, np.bincount(parent[below], minlength=n), np.bincount(parent[1:], minlength=n))
    digest = np.full(n, None, object)
    digest[end_node] = ends
    names: dict[int, bytes] = {}
    for nodes, i in ((np.flatnonzero(on_first), 0), (np.flatnonzero(on_last), len(paths) - 1)):
        name = ROOT
        for d, v in enumerate(nodes.tolist()):
            if d:
                name = hashlib.blake2b(name + paths[i][16 * d - 16:16 * d], digest_size=16).digest()
            names[v] = name
    first, last = np.flatnonzero(on_first), np.flatnonzero(on_last)
    last = last if (~on_first[last]).any() else last[:0]    # one path: the first one says it all
    again = on_first[last]                                  # common start of both paths: partial measures are given once
    rows = np.concatenate((below, first, last))
    zero = np.concatenate((np.zeros(len(below) + len(first), bool), again))
    is_spine = np.arange(len(rows)) >= len(below)
    up = parent[rows]
    rootless = rows > 0
    up_spine = spine[up] & rootless
    long = lambda v, null=None: pa.array(v, pa.int64(), mask=null)
    some = lambda v: long(np.where(zero, 0, v[rows]))
    return pa.RecordBatch.from_arrays([
        long(np.full(len(rows), shard)),
        pa.array(np.repeat([0, 0, 1], [len(below), len(first), len(last)]), pa.int32(), mask=~is_spine),
        long(depth[rows]),
        pa.array([names[v] if s else None for v, s in zip(rows.tolist(), is_spine)], pa.binary()),
        pa.array([names[v] if s else None for v, s in zip(up.tolist(), up_spine)], pa.binary()),
        long(conv[rows], zero), long(conv[up], up_spine | ~rootless),
        some(n_convs), some(children), some(n_leaves), some(saved), long(size[rows]),
        pa.array(digest[rows], pa.string())], names=[f.split()[0] for f in NODE_SCHEMA.split(", ")])


def _shards(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Cut the sorted entries of a partition into shards of about ``most`` turns, one entry at least."""
    part, number = TaskContext.get().partitionId(), 0
    held, turns = [], 0

    def close() -> pa.RecordBatch:
        nonlocal held, turns, number
        table = pa.Table.from_batches(held).combine_chunks()
        sizes = pc.list_flatten(table["sizes"]).to_numpy().astype(np.int64)
        out = encode_shard((part << 32) + number, table["path"].to_pylist(), sizes, table["n"].to_numpy(),
                           table["id"].to_numpy(), table["ends"].to_pylist())
        held, turns, number = [], 0, number + 1
        return out
    for batch in batches:
        total = np.cumsum(pc.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        first = 0
        while first < batch.num_rows:
            before = int(total[first - 1]) if first else 0
            stop = max(first + 1, int(np.searchsorted(total, before + most - turns, "right")))
            held.append(batch.slice(first, stop - first))
            turns += int(total[stop - 1]) - before
            first = stop
            if turns >= most or first < batch.num_rows:
                yield close()
    if held:
        yield close()


def _joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(seq, id, n, ids) of every run of equal ``seq`` in a sorted batch: first id, number and the ids joined by commas."""
    if not batch.num_rows:
        return
    seq, ids = batch.column(0), batch.column(1)
    change = pc.not_equal(seq.slice(1), seq.slice(0, len(seq) - 1)).to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.flatnonzero(change) + 1))
    offsets = pa.array(np.append(first, len(seq)), pa.int32())
    text = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), ",")
    yield pa.RecordBatch.from_arrays([seq.take(pa.array(first)), ids.take(pa.array(first)),
                                      pa.array(np.diff(np.append(first, len(seq))), pa.int64()), text],
                                     names=["seq", "id", "n", "ids"])


def _digested(batches) -> Iterator[pa.RecordBatch]:
    """(seq, id, n, ends) from the parts of each ``seq``, which arrive together and in order."""
    now = None
    for batch in batches:
        out = []
        for seq, first, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if now and now[0] == seq:
                now[2] += n
                now[3].update(b"," + ids.encode())
                continue
            if now:
                out.append((*now[:3], now[3].hexdigest()))
            now = [seq, first, n, hashlib.sha256(ids.encode())]
        yield _ends(out)
    if now:
        yield _ends([(*now[:3], now[3].hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()))],
                                      names=["seq", "id", "n", "ends"])


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(id, turns): of each conversation the ordered turns as (turn, key, size), ``key`` the hex digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.struct(F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def _by_key(rows: DataFrame, nodes: DataFrame, few: bool) -> DataFrame:
    """Join on the digest. The root and popular turns have a row from every shard: few nodes are broadcast, more are joined with
    those rows spread over ``SALTS`` tasks a digest."""
    if few:
        return rows.join(F.broadcast(nodes), "key")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod("shard", F.lit(SALTS)).cast("int"))
    return salted.join(nodes.withColumn("salt", salts), ["key", "salt"]).drop("salt")


def _merged(rows: DataFrame, few_nodes: int) -> DataFrame:
    """All nodes from the shards' rows: spines merged, parents on spines looked up."""
    spine = rows.filter(F.col("key").isNotNull())
    total = lambda name: F.sum(name).alias(name)
    merge = [F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
             total("n_convs"), total("n_children"), total("n_leaves"), total("saved"), F.max("size").alias("size"), F.max("ends").alias("ends")]
    # twice: a digest that every shard has meets itself in parts first
    once = spine.groupBy("key", F.pmod("shard", F.lit(SALTS)).alias("salt")).agg(*merge, F.min(F.struct("shard", "side")).alias("owner"))
    once = once.groupBy("key").agg(*merge, F.min("owner").alias("owner"))
    again = once.filter(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    nodes = pin(once.join(again, "key", "left")
                    .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
                    .withColumn("leaves", (F.col("n_children") == 0).cast("long"))
                    .withColumn("savings", (F.col("n_convs") - 1) * F.col("size")).drop("more"))
    few = nodes.limit(few_nodes + 1).count() <= few_nodes
    # a path owns its deeper end; what it owns counts for the owned nodes above and, as a whole, for those owned before
    path = Window.partitionBy("shard", "side").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    owned = nodes.select("key", "depth", "owner.shard", "owner.side", "leaves", "savings")
    suffix = owned.select("key", F.sum("leaves").over(path).alias("leaves"), F.sum("savings").over(path).alias("savings"))
    paths = owned.groupBy("shard", "side").agg(F.min("depth").alias("top"), total("leaves"), total("savings"))
    above = spine.select("shard", "side", "depth", "key").join(paths, ["shard", "side"]).filter(F.col("depth") < F.col("top"))
    above = above.groupBy("key", F.pmod("shard", F.lit(SALTS)).alias("salt")).agg(total("leaves"), total("savings"))
    under = suffix.unionByName(above.drop("salt")).groupBy("key").agg(total("leaves"), total("savings"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    merged = (nodes.drop("leaves", "savings").join(under, "key").join(parents, "parent_key", "left")
                   .withColumn("n_leaves", F.col("n_leaves") + F.col("leaves"))
                   .withColumn("saved", F.col("saved") + F.col("savings")).select(shown))
    own = rows.filter(F.col("key").isNull())
    # partial measures are given once a shard, so this is one row a shard and digest
    held = _by_key(spine.filter(F.col("conv_id").isNotNull()).select("shard", "key"),
                   nodes.select("key", F.col("conv_id").alias("up")), few).withColumnRenamed("key", "parent_key")
    joined = (own.filter(F.col("parent_key").isNotNull()).join(held, ["shard", "parent_key"])
                 .withColumn("parent_conv_id", F.col("up")).select(shown))
    return merged.unionByName(joined).unionByName(own.filter(F.col("parent_key").isNull()).select(shown))


def prefix_trie(convs: DataFrame, shard_turns: int = SHARD_TURNS, few_nodes: int = FEW_NODES) -> DataFrame:
    """Nodes of the trie of ``convs`` (id, turns of (key, size)), one row each.

    ``conv_id`` smallest member; ``depth``; ``parent_conv_id``; ``n_convs`` members; ``n_children``; ``n_leaves`` of the
    subtree; ``saved`` text bytes stored once instead of once per member, summed over the subtree; ``ends`` SHA-256 of the
    ascending ids that end at the node, null if none does.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    flat = pin(convs.select("id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
                    .withColumn("seq", F.unhex(F.md5("path"))))
    parts = flat.select("seq", "id").repartitionByRange("seq", "id").sortWithinPartitions("seq", "id")
    parts = parts.mapInArrow(lambda batches: (x for b in batches for x in _joined(b)), "seq binary, id long, n long, ids string")
    ends = parts.repartition("seq").sortWithinPartitions("seq", "id").mapInArrow(_digested, "seq binary, id long, n long, ends string")
    entries = flat.join(ends, ["seq", "id"]).select("path", "sizes", "n", "id", "ends")
    rows = entries.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(lambda b: _shards(b, shard_turns), NODE_SCHEMA)
    return _merged(pin(rows), few_nodes)
