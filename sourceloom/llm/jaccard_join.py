"""Jaccard self-join on word n-grams by adaptive prefixes with several matches.

All shingles stand in one order, the rarer first, and a set is listed under its first few.  Sets of n and m shingles at the similarity share at
least ``need(n, m)``; so of the first n - need + l of one and m - need + l of the other they share at least l, for every l up to need.  A longer
prefix (greater l) asks more of a pair before its sets are compared.  Every set chooses its l from ``LEVELS``: by the lengths of the lists it would
read and the candidates these let through, weighed by what comparing it costs.  A set reads the lists for its partners of at least its own
size, so its choice decides about each such pair.

The order comes from counts of all shingles by ``BUCKETS`` buckets of their hashes: frequent shingles stand out of their bucket, and any order gives
whole results.  Equal sets are one class from the start, lists of two classes whose places rule the similarity out are dropped, and
so are the members of short lists that no other member may be alike to.  In a list
with many members, most pairs would belong to one component; so long lists first meet one member each: the one under which the shingle stands
first.  It has the fewest rarer shingles, and so is the text that a family of near copies was made from, if that is there.  They
go on with members drawn by a hash until that links little more.  All pairs of different components that remain follow exactly, and with them those of
short lists, which stand in one row each: first one partner of each set, then all that are still apart.  A pair is compared only
if its sketches and the multi-match allow the similarity.  A sketch has a bit for each remainder of the hashes, which says whether an odd number of
shingles has it: two sets differ in at least as many shingles as their sketches do in bits.  It is much shorter than the prefix, so it is asked first.

Prefixes and shingle sets leave the scan only for classes in such pairs, or to find one of several equal sets; lists of frequent shingles are cut into
blocks for the exact part.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import in_pages, pages, share
from sourceloom.llm.components import components
from sourceloom.llm.near_dup import among, set_key, shingle_sets
from sourceloom.session import Workspace

SHINGLE, PERCENT = 5, 80
LEVELS = (1, 2, 4, 8)
BUCKET_BITS = 18  # 262,144 counts are collected and broadcast, whatever the input
SKETCH = 4  # bits of a sketch for each shingle that equal sets may differ in, or up to twice as many
SHORT_LIST = 16  # members of a list that stands in one row, all against all
LIST_BLOCK = 512  # members of a list that one block of the exact part holds
COMPARE, COMPARE_SHINGLES = 4, 16  # comparing sets costs as much as reading so many list entries, and one more for so many shingles
FEW_LINKS = 10  # rounds of single members end when fewer than one pair in so many was a link


def _up(n, by: int):
    """Quotient of whole numbers, rounded up; for columns and arrays."""
    return F.floor((n + (by - 1)) / by).cast("bigint") if isinstance(n, Column) else -(-n // by)


def need(n, m, percent: int):
    """Least number of common shingles of sets of n and m at the similarity."""
    return _up((n + m) * percent, 100 + percent)


def longest_prefix(n, percent: int, level: int):
    """Places under which a set is listed for partners of any size."""
    return n - need(n, _up(n * percent, 100), percent) + level


def may_differ(n, m, percent: int):
    """Most shingles that only one of two sets of n and m at the similarity has."""
    return n + m - 2 * need(n, m, percent)


def sketch(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Bits, 64 in a word, a power of two in number: whether an odd number of shingles has the remainder."""
    n = len(shingles)
    bits = 1 << max(6, (SKETCH * int(may_differ(n, n, percent)) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ; the longer one is folded to the length of the other, as if it had been made so."""
    length = F.least(F.size(a), F.size(b))
    xor = lambda x, y: x.bitwiseXOR(y)

    def folded(words):
        more = F.when(F.size(words) > length, F.sequence(F.lit(1), (F.size(words) / length).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(more, F.slice(words, F.lit(1), length), lambda held, k: F.zip_with(held, F.slice(words, k * length + 1, length), xor))

    return F.aggregate(F.zip_with(folded(a), folded(b), xor), F.lit(0), lambda held, x: held + F.bit_count(x))


def counted_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per row id, n_shingles, key; and for each task rows with counts by bucket, whose key and n_shingles are null."""

    def count(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column(1), shingle)
            for s in sets:
                total += np.bincount((s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=1 << BUCKET_BITS) if len(s) > 1 << 16 else 0
            short = [s for s in sets if len(s) <= 1 << 16]
            if short:
                np.add.at(total, (np.concatenate(short) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows, pa.list_(pa.int32())), pa.nulls(batch.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), *none],
                names=["id", "n_shingles", "key", "buckets", "counts"])
        filled = np.flatnonzero(total)
        if len(filled):
            ends = pa.array(np.append(np.arange(0, len(filled), 4096), len(filled)).astype(np.int32))
            rows = len(ends) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, kind), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()),
                 pa.ListArray.from_arrays(ends, pa.array(filled.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(total[filled]))],
                names=["id", "n_shingles", "key", "buckets", "counts"])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = picked.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(picked.schema["id"].dataType)
    return picked.mapInArrow(count, f"id {name}, n_shingles bigint, key binary, buckets array<int>, counts array<bigint>")


def frequencies(counted: DataFrame) -> np.ndarray:
    """Occurrences of shingles by bucket."""
    pairs = counted.where("buckets IS NOT NULL").select(F.explode(F.arrays_zip("buckets", "counts")).alias("c"))
    rows = pairs.groupBy(F.col("c.buckets").alias("bucket")).agg(F.sum("c.counts").alias("count")).toArrow()  # at most 2**BUCKET_BITS
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[rows["bucket"].to_numpy()] = rows["count"].to_numpy()
    return out


def prefixes(texts: DataFrame, shingle: int, percent: int, get: Callable) -> DataFrame:
    """Per text with shingles: key, n, prefix (its first shingles in the common order), sketch; ``get`` gives the counts by bucket."""

    def prefix(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0), shingle) if len(s)]
            firsts = []
            for s in sets:
                n = len(s)
                length = min(n, int(longest_prefix(n, percent, LEVELS[-1])))
                often = get()[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                if length < n:
                    near = np.flatnonzero(often <= np.partition(often, length - 1)[length - 1])
                    order = near[np.lexsort((s[near], often[near]))][:length]
                else:
                    order = np.lexsort((s, often))
                firsts.append(s[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 _lists([f.view(np.int64) for f in firsts]), _lists([sketch(s, percent) for s in sets])],
                names=["key", "n", "prefix", "sketch"])

    return texts.mapInArrow(prefix, "key binary, n bigint, prefix array<bigint>, sketch array<bigint>")


def whole_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Per text with shingles: key, shingles."""

    def whole(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0), shingle) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_key(s) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets])], names=["key", "shingles"])

    return texts.mapInArrow(whole, "key binary, shingles array<bigint>")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


class _Join:
    """The tables of one join, all of them written."""

    def __init__(self, ws: Workspace, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
        self.ws, self.docs, self.percent = ws, docs, percent
        self.id_col, self.text_col, self.shingle = id_col, text_col, shingle
        counted = ws.save(counted_sets(docs, id_col, text_col, shingle))
        self.known = counted.where("n_shingles IS NOT NULL").select("id", "n_shingles", "key")
        self.classes = ws.save(self.known.where("key IS NOT NULL").groupBy("key").agg(
            F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
        ids = among(ws, self.known, self.classes.where("rows > 1").select("key")).select(F.xxhash64("id").alias("h"))
        self.copied = pages(ws, ws.save(ids), "h")
        self.texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
        self.short, self.long, self.sets = None, None, None
        get = share(docs.sparkSession, frequencies(counted))
        self.first = ws.save(self.one_each(self.texts, lambda texts: prefixes(texts, shingle, percent, get)))
        ws.tidy()

    def one_each(self, rows: DataFrame, made: Callable) -> DataFrame:
        """What ``made`` makes of the texts of ``rows`` (text, h: hash of the id), one row a class; only ids that stand in a class of several rows are shuffled."""
        marked = in_pages(rows, "h", self.copied, "copied")
        alone, copied = (made(marked.where(which).select("text")) for which in ("NOT copied", "copied"))
        return alone.unionByName(copied.dropDuplicates(["key"]))

    def listed(self) -> DataFrame:
        """token, key, n, place, size: the lists of the tokens of more than one class, for partners of any size and l = 1."""
        n = F.col("n")
        head = F.slice("prefix", F.lit(1), longest_prefix(n, self.percent, 1).cast("int"))
        entry = self.first.select("key", "n", F.posexplode(head).alias("at", "token")).select(
            "token", "key", "n", (F.col("at") + 1).cast("bigint").alias("place"))
        # size and place of a list's ends, in one number each; a class stands once in a list, so the ends of a list of two are its members
        end = F.shiftleft("n", 32).bitwiseOR(F.col("place"))
        size_of, place_of = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1).cast("bigint")))
        counts = entry.groupBy("token").agg(F.min(end).alias("low"), F.max(end).alias("high"), F.count(F.lit(1)).alias("size")).where("size > 1")
        met = self.may_meet(size_of("low"), place_of("low"), size_of("high"), place_of("high"))
        counts = self.ws.save(counts.where((F.col("size") > 2) | met).select("token", "size"))
        self.ws.tidy()
        near = in_pages(entry, "token", pages(self.ws, counts, "token"), "near").where("near").drop("near")
        lists = self.ws.save(near.join(counts, "token").select("token", "key", "n", "place", "size"))
        self.ws.release(counts)
        self.ws.tidy()
        self.short, self.long = self.ws.save(self.partnered(lists)), self.ws.save(lists.where(F.col("size") > SHORT_LIST))
        self.ws.release(lists)
        self.ws.tidy()
        short = self.short.select("token", F.size("members").cast("bigint").alias("size"), F.explode("members").alias("m"))
        return self.long.unionByName(short.select("token", "m.*", "size"))

    def partnered(self, lists: DataFrame) -> DataFrame:
        """token, members: the short lists, without members that may meet no other one."""
        held = lists.where(F.col("size") <= SHORT_LIST).groupBy("token").agg(F.collect_list(F.struct("key", "n", "place")).alias("members"))
        meets = lambda x, y: (x["key"] != y["key"]) & self.may_meet(x["n"], x["place"], y["n"], y["place"])
        kept = held.select("token", F.filter("members", lambda x: F.exists("members", lambda y: meets(x, y))).alias("members"))
        return kept.where(F.size("members") > 0)

    def met_in_short(self) -> DataFrame:
        """All pairs (a, b), a the smaller set, that may meet in a short list."""
        smaller = lambda x, y: (x["n"] < y["n"]) | ((x["n"] == y["n"]) & (x["key"] < y["key"]))
        meets = lambda x, y: smaller(x, y) & self.may_meet(x["n"], x["place"], y["n"], y["place"])
        partners = F.transform("members", lambda x: F.struct(
            x["key"].alias("a"), F.transform(F.filter("members", lambda y: meets(x, y)), lambda y: y["key"]).alias("others")))
        return self.short.select(F.explode(partners).alias("p")).select("p.a", F.explode("p.others").alias("b")).distinct()

    def levels(self, lists: DataFrame) -> DataFrame:
        """key, level: the prefix extension that costs a set least as the smaller of a pair, by the lengths of its lists."""
        n = F.col("n")
        own = n - need(n, n, self.percent)
        costs = [F.sum(F.when(F.col("place") <= own + level, F.col("size")).otherwise(F.lit(0))).alias(f"read_{level}") for level in LEVELS]
        read = lists.groupBy("key", "n").agg(*costs)
        check = COMPARE + n / COMPARE_SHINGLES
        priced = [F.struct((F.col(f"read_{level}") * (1 + check / level)).alias("cost"), F.lit(level).cast("bigint").alias("level"))
                  for level in LEVELS]
        usable = F.filter(F.array(*priced), lambda p: (p["level"] <= need(n, n, self.percent)) | (p["level"] == 1))
        return read.select("key", F.array_min(usable)["level"].alias("level"))

    def may_meet(self, n: Column, place: Column, m: Column, there: Column) -> Column:
        """Whether sets of n and m that share a shingle at these places may meet the similarity, and list it for l = 1."""
        least = need(n, m, self.percent)
        return ((F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (place <= n - least + 1) & (there <= m - least + 1)
                & (F.least(place, there) + F.least(n - place, m - there) >= least))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches differ in no more bits than sets at the similarity may differ in shingles."""
        side = lambda end: among(self.ws, self.first.select("key", "n", "sketch"), pairs.select(end)).select(
            F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        kept = self.ws.save(both.where(differing("sketch_a", "sketch_b") <= may_differ(F.col("n_a"), F.col("n_b"), self.percent)).select("a", "b"))
        self.ws.tidy()
        return kept

    def matched(self, pairs: DataFrame, levels: DataFrame) -> DataFrame:
        """Possible pairs (a, b), a the smaller set, that share as many shingles of their prefixes as a's level asks."""
        pairs = self.possible(pairs)
        side = lambda end: among(self.ws, self.first.select("key", "n", "prefix"), pairs.select(end)).select(
            F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("prefix").alias(f"prefix_{end}"))
        both = pairs.join(levels.withColumnRenamed("key", "a"), "a").join(side("a"), "a").join(side("b"), "b")
        least = need(F.col("n_a"), F.col("n_b"), self.percent)
        head = lambda end: F.slice(f"prefix_{end}", F.lit(1), (F.col(f"n_{end}") - least + F.col("level")).cast("int"))
        return both.where(F.size(F.array_intersect(head("a"), head("b"))) >= F.col("level")).select("a", "b")

    def links(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """The pairs whose whole sets meet the similarity, and how many."""
        pairs = self.ws.save(pairs)
        self.ws.tidy()
        wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets, "key", "left_anti")
        wanted = self.ws.save(wanted.join(self.classes, "key"))
        near = in_pages(self.texts, "h", pages(self.ws, wanted.select(F.xxhash64("least").alias("h")), "h"), "near").where("near").drop("near")
        new = self.one_each(near, lambda texts: whole_sets(texts, self.shingle))
        new = self.ws.save(among(self.ws, new, wanted.select("key")))  # with few others, which an earlier round may have too
        self.ws.tidy()
        self.sets = new if self.sets is None else self.sets.union(new)
        side = lambda end: among(self.ws, self.sets, pairs.select(end)).select(
            F.col("key").alias(end), F.col("shingles").alias(f"set_{end}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        alike = common * 100 >= (F.size("set_a") + F.size("set_b") - common) * self.percent
        found, seen = self.ws.save_counted(both.where(alike).select("a", "b").distinct())
        return found, seen["rows"] or 0


def _oriented(pairs: DataFrame) -> DataFrame:
    """(key, n, other, m) as distinct (a, b), a the smaller set."""
    first = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("key") < F.col("other")))
    return pairs.select(F.when(first, F.col("key")).otherwise(F.col("other")).alias("a"),
                        F.when(first, F.col("other")).otherwise(F.col("key")).alias("b")).distinct()


def _rooted(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return lists.withColumn("root", F.col("key"))
    return lists.join(roots, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key")).drop("node")


def _mixed(owner: DataFrame, *more: Column) -> DataFrame:
    """The entries of lists that hold more than one component, with further aggregates of the list."""
    mark = F.xxhash64("root")
    lists = owner.groupBy("token").agg(F.min(mark).alias("least"), F.max(mark).alias("most"), *more).where("least <> most").drop("least", "most")
    return owner.join(lists, "token")


def _joined(ws: Workspace, new: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Roots after more links."""
    if roots is None:
        return ws.save(components(ws, new))
    top = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    between = ws.save(new.join(top("a"), "a", "left").join(top("b"), "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct())
    over = ws.save(components(ws, between))
    above = over.select(F.col("node").alias("up"), F.col("root").alias("above"))
    moved = roots.join(above, F.col("root") == F.col("up"), "left").select("node", F.coalesce("above", "root").alias("root"))
    return ws.save(moved.union(over.join(roots, "node", "left_anti")))


def jaccard_components(ws: Workspace, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links of at least ``percent`` Jaccard similarity).

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than ``shingle`` is one shingle.  Null, empty and
    wordless texts have no shingles, no links, and their own id.  Repeated rows come out alike; a null id counts only where it is alone, as
    null.  Other columns are not read.  An empty table gives an empty result.  No pair at the similarity is missed, whatever a list holds.
    """
    join = _Join(ws, docs, id_col, text_col, shingle, percent)
    lists = join.listed()
    levels = ws.save(join.levels(lists))
    ws.tidy()
    roots, turn, going = None, 0, True
    while going:
        # at first the member with the fewest rarer shingles, which is what a family of near copies has in common; then any one in each list
        drawn = F.struct("place", F.xxhash64("key").alias("hash")) if not turn else F.xxhash64("key", "token", F.lit(turn))
        owner = ws.save(_mixed(_rooted(join.long.select("token", "key", "n", "place", drawn.alias("draw")), roots), F.min("draw").alias("low")))
        hubs = owner.where("draw = low").select("token", F.col("key").alias("other"), F.col("n").alias("m"), F.col("place").alias("there"),
                                                F.col("root").alias("other_root"))
        stars = owner.join(hubs, "token").where((F.col("root") != F.col("other_root")) & join.may_meet(*map(F.col, ("n", "place", "m", "there"))))
        pairs, seen = ws.save_counted(_oriented(stars))
        found, linked = join.links(join.matched(pairs, levels))
        if linked:
            roots = _joined(ws, found, roots)
        ws.release(owner, pairs, found)
        ws.tidy()
        turn, going = turn + 1, linked * FEW_LINKS > (seen["rows"] or 0)
    pairs = ws.save(_remaining(join, roots))
    ws.tidy()
    likely = ws.save(join.matched(pairs, levels))
    # one partner each, as most of the others are in one component then
    some = ws.save(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    for last in (False, True):
        found, linked = join.links(_apart(likely.join(some, ["a", "b"], "left_anti"), roots) if last else some)
        if linked:
            roots = _joined(ws, found, roots)
    ws.release(pairs, likely, some, join.short, join.long, join.first)
    ws.tidy()
    owner = _rooted(join.classes, roots)
    lowest = owner.groupBy("root").agg(F.min("least").alias("component_id"))
    least = owner.join(lowest, "root").select("key", "component_id")
    # rows without shingles get no partner; they need not meet in one task
    linked = join.known.where("key IS NOT NULL").join(least, "key", "left").select("id", "n_shingles", "component_id")
    alone = join.known.where("key IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    return linked.union(alone).withColumnRenamed("id", id_col)


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs (a, b) of different components."""
    if roots is None:
        return pairs
    top = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rooted = pairs.join(top("a"), "a", "left").join(top("b"), "b", "left")
    return rooted.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _remaining(join: _Join, roots: DataFrame | None) -> DataFrame:
    """All pairs (a, b) of different components, a the smaller, that share a shingle of their prefixes for l = 1."""
    percent = join.percent
    owner = join.long.withColumn("root", F.col("key")) if roots is None else join.ws.save(_mixed(join.ws.save(_rooted(join.long, roots))))
    blocks = _up(F.col("size"), LIST_BLOCK)
    n, m, place, there = F.col("n"), F.col("m"), F.col("place"), F.col("there")
    readers = owner.where(place <= n - need(n, n, percent) + 1).select(
        "token", "key", "n", "place", "root", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("block"))
    entries = owner.select("token", F.pmod(F.xxhash64("key"), blocks).alias("block"), F.col("key").alias("other"), F.col("n").alias("m"),
                           F.col("place").alias("there"), F.col("root").alias("other_root"))
    fit = ((F.col("root") != F.col("other_root")) & (n * 100 >= m * percent) & ((n < m) | ((n == m) & (F.col("key") < F.col("other"))))
           & join.may_meet(n, place, m, there))
    met = readers.join(entries, ["token", "block"]).where(fit).select(F.col("key").alias("a"), F.col("other").alias("b"))
    return met.union(_apart(join.met_in_short(), roots)).distinct()
