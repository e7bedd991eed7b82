"""Near-duplicates by one-permutation MinHash with optimal densification.

Every shingle is hashed once; its upper bits choose one of ``BINS`` bins and each bin keeps its least
hash.  Empty bins take the value of a donor that is drawn by a hash of (bin, attempt), the same for all
texts, until a filled bin is met, which keeps the collision probability of a bin at the Jaccard
similarity.  Groups of ``ROWS`` bins are bands; texts with a common band share a bucket.

Equal shingle sets are one class from the start, so copies never meet in a bucket.  Inside a bucket, candidate
edges form a star: one hub, chosen by a hash, and its members, as many edges as members.  Candidates whose counts of
shingles in ``COUNTS`` bins leave room for the similarity are confirmed on full shingle sets, and only their sets are
shuffled.  What is not linked to its hub may still be linked to another member, so buckets of more than two whose members
are in different components get another hub, drawn anew for each bucket and round: first for half of the members, as most of
a large group falls together then, later for all, until a round links few of its pairs.  All pairs that are left follow exactly.

Two sets at similarity 0.8 miss each other in all 30 bands of 5 with probability (1 - 0.8 ** 5) ** 30, 7 in a million.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import bit_table, in_bits, in_pages, pages, row_key
from sourceloom.llm.components import components
from sourceloom.llm.words import mix, text_bytes, word_hashes
from sourceloom.session import Workspace

SHINGLE = 5
PERCENT = 80
BINS, ROWS = 150, 5
ATTEMPTS = 512
COUNTS = 128  # bins whose counts bound what two sets have in common
FEW_LINKS = 10  # rounds of hubs end when fewer than one pair in so many was a link
SAMPLED = 2  # one in so many places in unresolved buckets is tried in the second round; later ones try all that are left


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; fewer words than ``width`` are one shingle."""
    words, first = word_hashes(*text_bytes(column))
    n = len(words) - width + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
        rolled = mix(rolled)
    sets = []
    for start, end in zip(first[:-1], first[1:]):
        if end - start >= width:
            sets.append(np.unique(rolled[start:end - width + 1]))
        elif end > start:
            alone = np.array([end - start], np.uint64)
            for k in range(start, end):
                alone = alone * np.uint64(0xA0761D6478BD642F) + words[k:k + 1]
            sets.append(mix(alone))
        else:
            sets.append(words[:0])
    return sets


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _donors(bins: int) -> np.ndarray:
    """donor[bin, attempt], the same in every task."""
    at = np.arange(bins * ATTEMPTS, dtype=np.uint64).reshape(bins, ATTEMPTS)
    return (mix(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int16)


def signature(shingles: np.ndarray, bins: int, donors: np.ndarray) -> np.ndarray:
    """Least hash of each bin; a sorted set is already sorted by bin."""
    bin_of = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    head = np.ones(len(bin_of), bool)
    head[1:] = bin_of[1:] != bin_of[:-1]
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    out[bin_of[head]], filled[bin_of[head]] = shingles[head], True
    empty = np.flatnonzero(~filled)
    for start, end in ((0, 16), (16, ATTEMPTS)):
        if not len(empty):
            break
        drawn = donors[empty, start:end]
        usable = filled[drawn]
        hit = usable.any(axis=1)
        out[empty[hit]] = out[drawn[hit, usable[hit].argmax(axis=1)]]
        empty = empty[~hit]
    if len(empty):  # in sets so small that all draws failed: the next filled bin in a circle
        at = np.flatnonzero(filled)
        out[empty] = out[at[np.searchsorted(at, empty) % len(at)]]
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bins: int, rows: int) -> DataFrame:
    """Per row: id, n_shingles, key of the shingle set (null if empty), band keys."""
    bands = bins // rows
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row"))

    def sketch(batches):
        donors = _donors(bins)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            keys, values, ends = [], [], [0]
            for s in sets:
                keys.append(set_key(s) if len(s) else None)
                if len(s):
                    parts = signature(s, bins, donors)[:bands * rows].reshape(bands, rows)
                    folded = salt.copy()
                    for k in range(rows):
                        folded = mix(folded ^ parts[:, k])
                    values.append(folded.view(np.int64))
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), batch.column(2)],
                names=["id", "n_shingles", "key", "bands", "row"])

    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(sketch, f"id {kind}, n_shingles bigint, key binary, bands array<bigint>, row bigint")


def full_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """key, n, shingles, counts: the whole shingle sets, to confirm candidates, and how many shingles fall into each bin."""

    def sets_of(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0), shingle) if len(s)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            counts = [np.bincount((s & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS) for s in sets]
            held = np.concatenate(counts).astype(np.int32) if sets else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, COUNTS * (len(sets) + 1), COUNTS, dtype=np.int32)), pa.array(held))],
                names=["key", "n", "shingles", "counts"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(sets_of, "key binary, n bigint, shingles array<bigint>, counts array<int>")


def among(ws: Workspace, table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``table`` whose ``key`` is the one column of ``keys``, and few others; found where the table is read."""
    hashed = keys.select(F.xxhash64(keys.columns[0]).alias("hash"))
    return in_pages(table.withColumn("hash", F.xxhash64("key")), "hash", pages(ws, hashed, "hash"), "near").where("near").drop("near", "hash")


def confirmed(ws: Workspace, edges: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, int, int]:
    """Edges (a, b) whose full sets meet the similarity, how many these are, and how many were asked."""
    edges, asked = ws.save_counted(edges)
    counted = lambda end: sets.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("counts").alias(f"counts_{end}"))
    room = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    likely = edges.join(counted("b"), "b").join(counted("a"), "a").where(
        room.cast("bigint") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
    likely = ws.save(likely.select("a", "b"))
    whole = lambda end: among(ws, sets.select("key", "shingles"), likely.select(end)).select(
        F.col("key").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = likely.join(whole("b"), "b").join(whole("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    links, found = ws.save_counted(both.where(common * 100 >= union * percent).select("a", "b"))
    ws.release(edges, likely)
    return links, found["rows"] or 0, asked["rows"] or 0


def near_duplicates(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id), row (see ``row_key``).

    Words are runs without ASCII white space, A-Z lower-cased.  Linked are texts whose shingle sets have at least
    ``percent`` of their union in common.  Null, empty and wordless texts have no shingles and no links.
    Repeated rows with one id come out alike; a null id counts only where it is alone, as null.  Other
    columns are not read.  An empty table gives an empty result.
    """
    known = ws.save(sketches(docs, id_col, text_col, shingle, bins, rows))
    # one class for each distinct set: copies are counted before the shuffle and never meet in buckets
    classes = ws.save(known.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("least"), F.max("n_shingles").alias("n")))
    one_each = known.join(classes.select("key", F.col("least").alias("id")), ["key", "id"], "left_semi")
    banded = one_each.select("key", "id", F.col("n_shingles").alias("n"), F.xxhash64("key").alias("h"), F.explode("bands").alias("band"))
    shared = ws.save(banded.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count(F.lit(1)).alias("size")).where(
        "low <> high").select("band", "low", "size"))
    in_shared = in_bits(banded, F.col("band"), bit_table(shared, "band")).where("_maybe")
    members = ws.save(in_shared.join(shared, "band").select("band", "key", "id", "n", "h", "low", "size"))
    if members.isEmpty():
        return _answer(known, classes, None, id_col)
    candidates = members.select(F.xxhash64("id").alias("h"))
    sets = ws.save(full_sets(in_bits(docs, F.xxhash64(F.col(id_col)), bit_table(candidates, "h")).where("_maybe"), id_col, text_col, shingle)
                   .dropDuplicates(["key"]))

    def edges(stars: DataFrame) -> DataFrame:
        """Distinct edges of (key, n, hub, hub_n) whose set sizes alone do not rule the similarity out."""
        fit = stars.where((F.col("hub") != F.col("key")) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent))
        return fit.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct()

    # first the member with the least hash, which is the same in many buckets
    first = members.where("h = low").select("band", F.col("key").alias("hub"), F.col("n").alias("hub_n"))
    links, linked, _ = confirmed(ws, edges(members.join(first, "band")), sets, percent)
    roots = ws.save(components(ws, links)) if linked else None

    def rooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("root", F.col("key"))
        return rows.join(roots, F.col("key") == F.col("node"), "left").select(*rows.columns, F.coalesce("root", "key").alias("root"))

    turn, share, done, open_ = 0, SAMPLED, False, None
    while not done:
        turn += 1
        if open_ is not None:
            ws.release(open_)
        ws.tidy()
        # the two members of a bucket of two have met already
        owner = rooted(members.where("size > 2").select("band", "key", "n", F.xxhash64("key", "band", F.lit(turn)).alias("draw")))
        mark = F.xxhash64("root")
        mixed = owner.groupBy("band").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.min("draw").alias("drawn")).where("low <> high")
        open_ = ws.save(owner.join(mixed.select("band", "drawn"), "band"))
        hubs = open_.where("draw = drawn").select("band", F.col("key").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root"))
        sampled = open_.where(F.pmod(F.xxhash64("draw"), F.lit(share)) == 0)
        new, linked, asked = confirmed(ws, edges(sampled.join(hubs, "band").where("root <> hub_root")), sets, percent)
        if linked:
            roots = ws.save(components(ws, new) if roots is None else _merged(ws, new, roots))
        done, share = share == 1 and linked * FEW_LINKS <= asked, 1
    ws.tidy()
    # the last round has compared every hub with all others of its bucket, so a bucket is open if these differ among themselves
    rest = rooted(open_.where("draw <> drawn").select("band", "key", "n"))
    others = rest.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    left = ws.save(rest.join(others.select("band"), "band").select("key", "n", "root").distinct())
    new, linked, _ = confirmed(ws, _rare_pairs(ws, left, sets, percent), sets, percent)
    if linked:
        roots = ws.save(components(ws, new) if roots is None else _merged(ws, new, roots))
    ws.release(members, open_, left, sets)
    ws.tidy()
    return _answer(known, classes, roots, id_col)


def _rare_pairs(ws: Workspace, left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different roots among ``left`` (key, n, root) that may meet the similarity; no pair that does is missing.

    Shingles are put in one order, the rarest first.  Sets of n and m shingles at the similarity have at least
    ``need`` = percent * (n + m) / (100 + percent) in common, so one among the first n - need + 1 and m - need + 1.  The smaller
    set needs no more than ``few`` of them, the larger one no more than ``most``.
    """
    n, up = F.col("n"), lambda c: F.ceil(c).cast("bigint")
    token = left.select("key").join(among(ws, sets.select("key", "shingles"), left.select("key")), "key").select("key", F.explode("shingles").alias("token"))
    # a shingle that one set alone has needs a place, but no partner
    counts = ws.save(token.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1"))
    listed = token.join(counts, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("common"))
    most = listed.join(left, "key").withColumn("single", n - F.size("common")).withColumn("most", n - up(n * percent / 100) + 1).where("single < most")
    rare = most.select("key", "n", "root", "single", F.posexplode(F.slice("common", F.lit(1), (F.col("most") - F.col("single")).cast("int"))).alias("nth", "at"))
    rare = ws.save(rare.select("key", "n", "root", F.col("at.token").alias("token"), (F.col("single") + F.col("nth") + 1).alias("place")))
    # of a token's sets in its commonest root, none needs to meet another
    held = rare.groupBy("token", "root").agg(F.count(F.lit(1)).alias("count")).groupBy("token").agg(
        F.max_by("root", F.struct("count", "root")).alias("major"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("token", "major")
    rare = ws.save(rare.join(held, "token"))
    few = rare.where(F.col("place") <= n - up(n * 2 * percent / (100 + percent)) + 1)
    larger = lambda df: df.select("token", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "root", "place")])
    minor = F.col("root") != F.col("major")
    need = up((n + F.col("n_b")) * percent / (100 + percent))
    fit = ((n <= F.col("n_b")) & (n * 100 >= F.col("n_b") * percent) & (F.col("root") != F.col("root_b"))
           & (F.col("place") <= n - need + 1) & (F.col("place_b") <= F.col("n_b") - need + 1))
    pairs = few.where(minor).join(larger(rare), "token").where(fit).select("key", "key_b").union(
        few.where(~minor).join(larger(rare.where(minor)), "token").where(fit).select("key", "key_b"))
    return pairs.select(F.least("key", "key_b").alias("a"), F.greatest("key", "key_b").alias("b")).distinct()


def _merged(ws: Workspace, new: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots after new links, by the components of the links between roots."""
    root_of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = new.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
    over = ws.save(components(ws, ws.save(between)))
    moved = roots.join(over.select(F.col("node").alias("up"), F.col("root").alias("above")), F.col("root") == F.col("up"), "left")
    known = moved.select("node", F.coalesce("above", "root").alias("root"))
    return known.union(over.join(roots, "node", "left_anti"))


def _answer(known: DataFrame, classes: DataFrame, roots: DataFrame | None, id_col: str) -> DataFrame:
    if roots is None:
        least = classes.select("key", "least")
    else:
        owner = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", F.coalesce("root", "key").alias("root"))
        lowest = owner.groupBy("root").agg(F.min("least").alias("lowest"))
        least = owner.join(lowest, "root").select("key", F.col("lowest").alias("least"))
    # rows without shingles get no partner; they need not meet in one task
    linked = known.where(F.col("key").isNotNull()).select("id", "n_shingles", "key", "row").join(least, "key", "left").select("id", "n_shingles", "least", "row")
    alone = known.where(F.col("key").isNull()).select("id", "n_shingles", F.col("id").alias("least"), "row")
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.col("id").eqNullSafe(F.col("least")).alias("kept"), "row")
