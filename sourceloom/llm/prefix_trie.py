"""Prefix trie of conversations: which beginnings they share, and what is saved by keeping each once.

A turn is known by 128 bits of a digest.  Conversations become rows of a matrix of turn ids, padded to ``WIDTH`` turns; a longer
one takes several rows, which say by sums over the earlier turns what they continue.  Rows are dealt to
tasks in shards by ranges of (what they continue, turn ids, conversation), so a shard holds every node of the trie that is not at its
edges.  There, ``lexsort`` orders the rows, a mask of changes in each column, or-ed from the left, marks where the nodes of that
depth start, and ``reduceat`` aggregates over the rows of each node.  Nodes that touch the edge of a shard are put together from
their parts.

Sums over subtrees need no walk over the trie.  Each node stands with its smallest member, so a conversation stands for the lower part of its own
path.  A subtree holds the lower parts of the members' paths: all of them whole, but the top's own, which starts at the top.
So one more pass over the shards sums per member what its whole part amounts to, and a running total along each path gives the rest.

No step takes a whole conversation, a whole node or the whole trie into one task: conversations are cut by turns, nodes by
conversations, also if one of either holds most rows.  Only the digest of a node's ends is a sequence by its nature; it is fed from the parts
in order, with constant memory, one part of a shard at a time.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.words import mix
from sourceloom.operators import ordered
from sourceloom.session import Workspace

WIDTH = 32  # turns in a row of the matrix
SHARD = 4_000  # rows in a shard, about; up to 32 turns of 20 bytes each
SPACE = r"[\x20\x09-\x0D]+"
LANES = ["lane0", "lane1", "lane2", "lane3"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_rows(ws: Workspace, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """Per turn: conv_id, pos (from 1), turns (of its conversation), id, words.

    Ordered by turn, null first, then by digest of role and text, null being empty.  Rows without a conversation are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("id"),
        F.size(F.array_remove(F.split(text, SPACE), "")).alias("words"))
    placed = ordered.running_totals(ws, rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], {"pos": F.lit(1)},
                                    wholes={"turns": (F.count(F.lit(1)), F.sum)})
    return placed.select("conv_id", F.col("pos").cast("bigint").alias("pos"), F.col("turns").cast("bigint").alias("turns"), "id", "words")


def with_shared_heads(ws: Workspace, turns: DataFrame, group: int = 20, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of their group's first: (turns as in ``turn_rows``, all conversations with their length).

    Conversation c takes the first h turns of conversation c - c % group, h = crc32(c) % longest, or what there is of them, instead of its
    own first h.
    """
    saved = ws.save(turns)
    convs = saved.where("pos = 1").select(
        "conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
        F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(longest)).cast("bigint").alias("taken"))
    lengths = saved.where("pos = 1").select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    convs = ws.save(convs.join(lengths, "base", "left").select(
        "conv_id", "base", "taken", F.least("taken", F.coalesce("base_turns", F.lit(0).cast("bigint"))).alias("head"),
        F.greatest(F.col("turns") - F.col("taken"), F.lit(0).cast("bigint")).alias("own")))
    length = (F.col("head") + F.col("own")).alias("turns")
    # a conversation is a base for fewer than ``group`` others on either side of zero
    heads = saved.where(F.col("pos") < longest).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    taken = heads.join(convs, "base").where("pos <= taken").select("conv_id", "pos", length, "id", "words")
    own = saved.select("conv_id", "pos", "id", "words").join(convs, "conv_id").where("pos > taken").select(
        "conv_id", (F.col("pos") - F.col("taken") + F.col("head")).alias("pos"), length, "id", "words")
    return taken.union(own), convs.select("conv_id", length)


def _matrix_rows(ws: Workspace, turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """(rows, how many): conv_id, block, turns, lanes (sums over all turns before the block), ids, words."""
    block = F.floor((F.col("pos") - 1) / WIDTH).cast("bigint")
    held = turns.groupBy("conv_id", block.alias("block")).agg(
        F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("pos", "id", "words"))).alias("row"))
    rows = held.select("conv_id", "block", "turns", F.col("row.id").alias("ids"), F.col("row.words").alias("words"))
    empty = convs.where("turns = 0").select("conv_id", F.lit(0).cast("bigint").alias("block"), "turns",
                                            F.array().cast("array<binary>").alias("ids"), F.array().cast("array<int>").alias("words"))
    rows = ws.save(rows.union(empty))

    def sums(batches):
        for batch in batches:
            ids, _, count = _matrix(batch.column("ids"), None)
            total = np.zeros((batch.num_rows, 4), np.int64)
            for start, depth in _first_depths(batch.column("block").to_numpy()):
                total[start] = _lanes(ids[start], count[start], depth)[:, -1]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("block"), *[pa.array(total[:, k]) for k in range(4)]],
                                             names=["conv_id", "block", *LANES])

    long = rows.where(F.col("turns") > WIDTH)
    own = long.mapInArrow(sums, "conv_id bigint, block bigint, " + ", ".join(f"{c} bigint" for c in LANES))
    upto = ordered.running_totals(ws, own, ["conv_id"], [F.col("block")], {f"upto_{c}": F.col(c) for c in LANES})
    before = upto.select("conv_id", "block", *[(F.col(f"upto_{c}") - F.col(c)).cast("bigint").alias(c) for c in LANES])
    short = rows.where(F.col("turns") <= WIDTH).select("conv_id", "block", "turns", *[F.lit(0).cast("bigint").alias(c) for c in LANES], "ids", "words")
    both = short.unionByName(long.join(before, ["conv_id", "block"]))
    saved, seen = ws.save_counted(both)
    return saved, seen["rows"] or 0


def _first_depths(blocks: np.ndarray):
    for block in np.unique(blocks):
        yield np.flatnonzero(blocks == block), int(block) * WIDTH


def _matrix(ids: pa.Array, words: pa.Array | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(ids[row, column, half], words[row, column], turns of each row), padded with zeros."""
    offsets = ids.offsets.to_numpy()
    count = np.diff(offsets)
    flat = ids.flatten()
    places = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    data = np.frombuffer(flat.buffers()[2], np.uint8)[places[0]:places[-1]] if len(flat) else np.zeros(0, np.uint8)
    width = int(count.max(initial=0))
    inside = np.arange(width)[None, :] < count[:, None]
    matrix = np.zeros((len(count), width, 2), np.uint64)
    matrix[inside] = data.view(">u8").reshape(-1, 2)
    if words is None:
        return matrix, None, count
    held = np.zeros((len(count), width), np.int64)
    held[inside] = words.flatten().to_numpy()
    return matrix, held, count


def _lanes(ids: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """lanes[row, column, 4]: sums of 32-bit halves of hashes of (depth, turn) up to a column, column 0 before the first turn.

    Two beginnings of one length agree in all four sums with a chance of about 2**-128 or less, as turn ids are digests.
    """
    at = mix(np.arange(depth + 1, depth + 1 + ids.shape[1], dtype=np.uint64) + np.uint64(0xA0761D6478BD642F))
    code = mix(ids ^ at[None, :, None])
    parts = np.concatenate([code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)], axis=2).astype(np.int64)
    parts[np.arange(ids.shape[1])[None, :] >= count[:, None]] = 0
    out = np.zeros((len(ids), ids.shape[1] + 1, 4), np.int64)
    np.cumsum(parts, axis=1, out=out[:, 1:])
    return out


def _keys(lanes: np.ndarray) -> pa.Array:
    """Four sums as one binary value."""
    packed = np.ascontiguousarray(lanes.astype(">i8"))
    return pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(np.arange(0, 32 * (len(packed) + 1), 32, dtype=np.int32)), pa.py_buffer(packed)])


NODE = ("shard int, whole boolean, depth bigint, key binary, parent_key binary, parent_conv_id bigint, conv_id bigint, n_convs bigint, words bigint, "
        "ends_sha256 string, first_end bigint, ends binary, leaves bigint, saved bigint")


def _nodes_of(table: pa.Table, shard: int):
    """Nodes of a shard, one batch a depth; ``whole`` are those that do not touch its first or last row.

    A node that goes on in the next block is not whole either, and what a row continues is reported as a part without members.
    """
    col = lambda name: table.column(name).combine_chunks()
    conv, block, turns = (col(c).to_numpy() for c in ("conv_id", "block", "turns"))
    before = np.stack([col(c).to_numpy() for c in LANES], axis=1)
    ids, words, count = _matrix(col("ids"), col("words"))
    width = ids.shape[1]
    by = [conv, *[ids[:, j, half] for j in reversed(range(width)) for half in (1, 0)], *before.T[::-1], block]
    order = np.lexsort(by)
    conv, block, turns, before, ids, words, count = (x[order] for x in (conv, block, turns, before, ids, words, count))
    values = [col(c).to_numpy()[order] for c in ("leaves", "saved")] if "leaves" in table.column_names else None
    n = len(conv)
    change = np.zeros((n, width + 1), bool)
    change[0] = True
    change[1:, 0] = (block[1:] != block[:-1]) | (before[1:] != before[:-1]).any(axis=1)
    change[1:, 1:] = (ids[1:] != ids[:-1]).any(axis=2)
    change = np.logical_or.accumulate(change, axis=1)
    lanes = np.zeros((n, width + 1, 4), np.int64)
    for rows, depth in _first_depths(block):
        lanes[rows] = _lanes(ids[rows], count[rows], depth)
    lanes += before[:, None, :]
    goes_on = turns > (block + 1) * WIDTH
    ends_at = np.where(goes_on, -1, count)
    above = None
    for j in range(width + 1):
        starts = np.flatnonzero(change[:, j])
        stops = np.append(starts[1:], n)
        node = np.maximum.accumulate(np.where(change[:, j], np.arange(n), 0))  # first row of the node that each row is in
        least = np.minimum.reduceat(conv, starts)
        whole = (starts > 0) & (stops < n)
        if j == WIDTH:
            whole &= ~np.logical_or.reduceat(goes_on, starts)
        at_row_least, at_row_whole = np.zeros(n, np.int64), np.zeros(n, bool)
        at_row_least[starts], at_row_whole[starts] = least, whole
        real = count[starts] >= j
        reference = (j == 0) & (block[starts] > 0)
        whole &= ~reference
        at_row_whole[starts] = whole
        members = np.where(reference, 0, stops - starts)
        ending = np.flatnonzero(ends_at == j)  # by conversation within each node, as those rows differ in nothing else
        cuts = np.searchsorted(ending, np.append(starts, n))
        digests, firsts, texts = [], [], []
        for s, e, closed in zip(cuts[:-1].tolist(), cuts[1:].tolist(), whole.tolist()):
            text = ",".join(map(str, conv[ending[s:e]].tolist())).encode()
            digests.append(hashlib.sha256(text).hexdigest() if closed else None)
            firsts.append(None if closed or s == e else int(conv[ending[s]]))
            texts.append(None if closed or s == e else text)
        if above is None:
            parent_conv, parent_key = pa.nulls(len(starts), pa.int64()), pa.nulls(len(starts), pa.binary())
        else:
            top = above[0][starts]
            parent_conv = pa.array(above[1][top], mask=~above[2][top])
            parent_key = _keys(lanes[starts, j - 1])
        sums = [pa.array(np.where(reference, 0, np.add.reduceat(v, starts))) for v in values] if values else [pa.nulls(len(starts), pa.int64())] * 2
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(starts), shard, np.int32)), pa.array(whole), pa.array(block[starts] * WIDTH + j), _keys(lanes[starts, j]), parent_key,
             parent_conv, pa.array(least, mask=reference), pa.array(members), pa.array(words[starts, j - 1] if j else np.zeros(len(starts), np.int64)),
             pa.array(digests, pa.string()), pa.array(firsts, pa.int64()), pa.array(texts, pa.binary()), *sums],
            names=[part.split()[0] for part in NODE.split(", ")])
        yield batch.filter(pa.array(real))
        above = (node, at_row_least, at_row_whole)


def _shard_nodes(rows: DataFrame, count: int) -> DataFrame:
    """Nodes of all shards, whole ones and parts."""
    names = ["conv_id", "block", "turns", *LANES, "ids", "words", *[c for c in ("leaves", "saved") if c in rows.columns]]
    dealt = rows.select(*names).repartitionByRange(
        max(1, -(-count // SHARD)), "block", *LANES, "ids", "conv_id").withColumn("shard", F.spark_partition_id())

    def nodes(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from _nodes_of(table, table.column("shard")[0].as_py())

    return dealt.mapInArrow(nodes, NODE)


def _digests_of_parts(parts: DataFrame) -> DataFrame:
    """key, ends_sha256 from the parts of a node's ends in order; one part at a time is held."""

    def digests(batches):
        rows = ((k, t) for b in batches for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for key, texts in groupby(rows, lambda r: r[0]):
            sha, first = hashlib.sha256(), True
            for _, text in texts:
                sha.update(text if first else b"," + text)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    fed = parts.where("ends IS NOT NULL").select("key", "first_end", "ends").repartition("key").sortWithinPartitions("key", "first_end")
    return fed.select("key", "ends").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(ws: Workspace, turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``turns`` (see ``turn_rows``); ``convs`` (conv_id, turns) has every conversation once, turnless ones too.

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root, depth 0), n_convs, n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (sum over the subtree of (members - 1) * words of the last turn), ends_sha256 (of the ids of members that end here,
    ascending, joined by commas).  (conv_id, depth) names a node.  Conversations alike in all turns share all nodes.
    Without conversations the result is empty.
    """
    rows, count = _matrix_rows(ws, turns, convs)
    found = ws.save(_shard_nodes(rows, count))
    parts = found.where("NOT whole")
    digests = _digests_of_parts(parts)
    joined = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
                                      F.min("parent_conv_id").alias("near_conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"))
    edge = ws.save(joined.join(digests, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))))
    # a child learns its parent's smallest member from the shard's own list of edge nodes, so that a parent of many is no hot key
    known = parts.select("shard", "key").join(edge.select("key", F.col("conv_id").alias("edge_conv_id")), "key").select(
        "shard", F.col("key").alias("parent_key"), "edge_conv_id").distinct()
    plain = ["conv_id", "depth", "parent_conv_id", "n_convs", "words", "ends_sha256"]
    whole = found.where("whole")
    settled = whole.where("parent_conv_id IS NOT NULL").select(*plain)
    asking = whole.where("parent_conv_id IS NULL").drop("parent_conv_id").join(known, ["shard", "parent_key"], "left").withColumnRenamed(
        "edge_conv_id", "parent_conv_id").select(*plain)
    tops = edge.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("far_conv_id"))
    edges = edge.drop("key").join(tops, "parent_key", "left").withColumn(
        "parent_conv_id", F.coalesce("near_conv_id", "far_conv_id")).select(*plain)
    nodes = ws.save(settled.unionByName(asking).unionByName(edges))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saving", (F.col("n_convs") - 1) * F.col("words"))
    # what a conversation stands for, whole and from each depth downwards
    along = ws.save(ordered.running_totals(ws, nodes, ["conv_id"], [F.col("depth").desc()], {"leaves_down": F.col("leaf"), "saved_down": F.col("saving")},
                                           wholes={"all_leaves": (F.sum("leaf"), F.sum), "all_saved": (F.sum("saving"), F.sum)}))
    stands = along.groupBy("conv_id").agg(F.max("all_leaves").alias("leaves"), F.max("all_saved").alias("saved"))
    summed = ws.save(_shard_nodes(rows.join(stands, "conv_id"), count))
    once = summed.where("whole").select("conv_id", "depth", "leaves", "saved")
    pieced = summed.where("NOT whole").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).drop("key")
    total = along.join(once.unionByName(pieced), ["conv_id", "depth"])
    return total.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves") - F.col("all_leaves") + F.col("leaves_down")).cast("bigint").alias("n_leaves"),
        (F.col("saved") - F.col("all_saved") + F.col("saved_down")).cast("bigint").alias("saved_tokens"), "ends_sha256")
