"""Benchmark decontamination by winnowing, in DataFrame functions only.

Hashes of all k-grams of words are taken, and the least of each ``GUARANTEE - GRAM + 1`` neighbours is kept as a
fingerprint (all of them on a tie).  Any run of ``GUARANTEE`` words that a text shares with an item contains at least
one common fingerprint at the same place.  A fingerprint carries the words around it, so a hit is extended where it
is found, word by word, without reading a text again.

The item side is reduced to distinct contexts.  Their hashes filter the texts' fingerprints through a bitmap of fixed
size before anything is shuffled; what passes meets the contexts in an ordinary join.  Items shorter than the
guarantee are looked up whole, by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import ascii_lower, bit_table, in_bits, row_key
from sourceloom.session import Workspace

GRAM = 5
GUARANTEE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def gram_hashes(hashes: Column, width: int) -> Column:
    """Hash of every ``width`` neighbours; none if there are fewer."""
    starts = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)]))


def fingerprints(df: DataFrame, short: list[int], gram: int = GRAM, guarantee: int = GUARANTEE) -> DataFrame:
    """``df`` (with words) plus marks: array of (span, pos, hash).  span is the length of the runs to compare there."""
    window = guarantee - gram + 1
    df = df.withColumn("_hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("_grams", gram_hashes(F.col("_hashes"), gram))
    starts = F.when(F.size("_grams") >= window, F.sequence(F.lit(0), F.size("_grams") - window)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_least", F.transform(starts, lambda j: F.least(*[F.get(F.col("_grams"), j + k) for k in range(window)])))
    # a gram is the least of some window if it equals the greatest least of the windows around it
    kept = F.transform("_grams", lambda h, i: F.when(h == F.greatest(*[F.get(F.col("_least"), i - k) for k in range(window)]), h))
    df = df.withColumn("_kept", kept)
    marks = [_marks(F.col("_kept"), guarantee)]
    for n in short:
        marks.append(_marks(gram_hashes(F.col("_hashes"), n), n))
    return df.withColumn("marks", F.concat(*marks)).drop("_hashes", "_grams", "_least", "_kept")


def _marks(hashes: Column, span: int) -> Column:
    marked = F.transform(hashes, lambda h, i: F.struct(F.lit(span).alias("span"), i.alias("pos"), h.alias("hash")))
    return F.filter(marked, lambda m: m["hash"].isNotNull())


def _context(gram: int, guarantee: int) -> tuple[Column, Column]:
    """(words before the mark that belong to its context, context)."""
    before = F.when(F.col("span") == guarantee, F.least("pos", F.lit(guarantee - gram))).otherwise(F.lit(0))
    after = F.when(F.col("span") == guarantee, F.lit(guarantee)).otherwise(F.col("span"))
    return before, F.slice("words", F.col("pos") - before + 1, before + after)


def contamination(ws: Workspace, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", gram: int = GRAM, guarantee: int = GUARANTEE) -> DataFrame:
    """Per row: id, row, n_words, n_hit, n_items, item_ids (sorted, comma-joined), contaminated.

    A window is ``guarantee`` consecutive words of an item, or all words of a shorter item; a word of a text inside any
    occurrence of a window is hit.  ``row`` is the hash that tells rows with one id apart (see ``row_key``).  Null and wordless
    texts have no words and no hits; wordless items have no windows; items without an id hit, but
    are not counted or listed.  Repeated rows come out alike.  Other columns are not read.  Empty tables give
    empty results or no hits.
    """
    lengths = F.size("words")
    probes = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words")).where(lengths > 0)
    short = sorted(r[0] for r in probes.where(lengths < guarantee).select(lengths).distinct().collect())  # fewer than `guarantee` numbers
    before, context = _context(gram, guarantee)
    # a short item is looked up whole; runs of its length inside longer items are no windows
    # explode_outer, as a plain explode infers a filter, and pushing that down would inline the nested lambdas into each other
    marked = fingerprints(probes, short, gram, guarantee).withColumn("mark", F.explode_outer("marks")).select("item", "words", "mark.*")
    marked = marked.where(F.col("span") == F.least(lengths, F.lit(guarantee)))
    contexts = ws.save(marked.select("item", "span", "hash", before.alias("i_before"), context.alias("i_context"))
                       .withColumn("context", F.md5(F.concat_ws(" ", "span", "i_before", "i_context"))).distinct())
    distinct = contexts.groupBy("context").agg(*[F.first(c).alias(c) for c in ("span", "hash", "i_before", "i_context")])

    texts = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("row"), words_of(F.col(text_col)).alias("words"))
    # one mark that always passes carries the number of words
    whole = F.array(F.struct(F.lit(0).alias("span"), F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("hash")))
    exploded = fingerprints(texts, short, gram, guarantee).withColumn("mark", F.explode_outer(F.concat(whole, "marks"))).select(
        "id", "row", "words", "mark.*")
    bits = ws.save(bit_table(contexts.select("hash").distinct(), "hash"))
    passed = in_bits(exploded, F.col("hash"), bits).where(F.col("_maybe") | (F.col("pos") < 0))
    found = ws.save(passed.select(
        "id", "row", "span", "pos", "hash", lengths.cast("bigint").alias("n_words"),
        F.when(F.col("pos") >= 0, before).alias("before"), F.when(F.col("pos") >= 0, context).alias("context_words")))

    pairs = found.where("pos >= 0").join(distinct, ["span", "hash"])
    offsets = F.filter(F.sequence(F.lit(0), F.least("before", "i_before")), lambda o: (
        F.size(F.slice("i_context", F.col("i_before") - o + 1, F.col("span"))) == F.col("span"))
        & (F.slice("i_context", F.col("i_before") - o + 1, F.col("span")) == F.slice("context_words", F.col("before") - o + 1, F.col("span"))))
    hits = ws.save(pairs.withColumn("o", F.explode_outer(offsets)).where("o IS NOT NULL").select("id", "row", "context", (F.col("pos") - F.col("o")).alias("start"), "span").distinct())

    stretches = hits.groupBy("id", "row", "start").agg((F.col("start") + F.max("span")).alias("stop"))
    ordered = "OVER (PARTITION BY id, row ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    fresh = F.expr(f"greatest(0, stop - greatest(start, coalesce(max(stop) {ordered}, start)))")
    n_hit = stretches.select("id", "row", fresh.alias("fresh")).groupBy("id", "row").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("id", "row", "context").distinct().join(
        contexts.where("item IS NOT NULL").select("context", "item").distinct(), "context").select("id", "row", "item").distinct()
    listed = named.groupBy("id", "row").agg(
        F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("item_ids"))

    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))
    base = found.where("pos < 0").select("id", "row", "n_words")
    joined = base.alias("d").join(n_hit.alias("h"), same("d", "h"), "left").join(listed.alias("l"), same("d", "l"), "left")
    return joined.select(
        F.col("d.id").alias(id_col), F.col("d.row").alias("row"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
