"""Split scans give what a plain window gives, whatever the cut."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sourceloom.operators import ordered, usage


def skewed(spark, n=600):
    """A third of all rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        ((F.col("id") * 7919) % 1009).alias("at"), F.col("id").alias("seq"), (F.col("id") % 5).alias("v"),
    )


def test_running_totals(spark, ws, many_pieces):
    df = skewed(spark)
    by = [F.col("at"), F.col("seq")]
    found = ordered.running_totals(ws, df, ["key"], by, {"pos": F.lit(1), "total": F.col("v")})
    w = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.withColumn("pos", F.count("*").over(w)).withColumn("total", F.sum("v").over(w))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))


def test_hot_key_spans_pieces(spark, ws, many_pieces):
    cut = ordered._pieces(ws, skewed(spark), ["key"], [F.col("at"), F.col("seq")])
    assert cut.filter("key = 'hot'").select("_piece").distinct().count() > 1


def test_next_value(spark, ws, many_pieces):
    df = skewed(spark)
    value = F.when(F.col("v") == 2, F.col("at"))
    found = ordered.next_value(ws, df, ["key"], [F.col("at"), F.col("seq")], value, "next")
    w = Window.partitionBy("key").orderBy("at", "seq").rowsBetween(1, Window.unboundedFollowing)
    expected = df.withColumn("next", F.first(value, ignorenulls=True).over(w))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_next_value_takes_time_in_proportion(spark, ws):
    """One key; a frame that is gone through anew for every row would take sixteen times as long."""
    import time

    def seconds(n):
        df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("at"))
        start = time.time()
        found = ordered.next_value(ws, df, ["key"], [F.col("at")], F.when(F.col("at") == n - 1, F.col("at")), "next")
        assert found.where(F.col("next") == n - 1).count() == n - 1
        return time.time() - start

    seconds(1000)
    assert seconds(160_000) < 6 * seconds(40_000) + 3


def brute_hits(rows, ttl):
    live, result = {}, set()
    for key, at, seq in sorted(rows):
        hit = key in live and at - live[key] <= ttl
        if not hit:
            live[key] = at
        result.add((key, at, seq, hit))
    return result


def test_ttl_hits_of_hot_and_cold_keys(spark, ws, many_pieces):
    for ttl in (1, 40):
        requests = skewed(spark).select("key", (F.floor(F.col("at") / 2) * 1_000_000).cast("bigint").alias("at"), "seq")
        rows = [tuple(r) for r in requests.collect()]
        found = {tuple(r) for r in usage.ttl_hits(ws, requests, ttl).collect()}
        assert found == brute_hits(rows, ttl * 1_000_000)


def test_ttl_hits_in_one_piece(spark, ws):
    requests = skewed(spark, 200).select("key", (F.col("at") * 1_000_000).alias("at"), "seq")
    rows = [tuple(r) for r in requests.collect()]
    assert {tuple(r) for r in usage.ttl_hits(ws, requests, 30).collect()} == brute_hits(rows, 30_000_000)


def test_default_ttl_and_stats(spark, ws):
    requests = spark.createDataFrame([("k", 0, 1), ("k", 5, 2), ("miss", 6, 3)], "key string, at bigint, seq bigint")
    stats = usage.cache_stats(usage.ttl_hits(ws, requests, 0)).head()
    assert (stats.hits, stats.misses, stats.size) == (1, 2, 2)
    assert abs(stats.hit_rate - 100 / 3) < 1e-9
