"""Request logs: tokens, cost, cache hits, de-duplication and retries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom import rules
from sourceloom.functions import text as T
from sourceloom.operators import ordered
from sourceloom.session import Workspace


def _provider_value(provider: Column, i: int) -> Column:
    """A constant of the provider; NULL for unknown providers."""
    return T.lookup(provider, {name: values[i] for name, values in rules.PROVIDERS.items()})


def token_estimate(text: Column, provider: Column) -> Column:
    """Input tokens: a fixed number per space-separated word."""
    return F.size(T.tokens(text)).cast("bigint") * _provider_value(provider, 3).cast("bigint")


def output_tokens(provider: Column) -> Column:
    return _provider_value(provider, 2).cast("bigint")


def cost_estimate(provider: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return (
        tokens_in * _provider_value(provider, 0) / 1_000_000
        + tokens_out * _provider_value(provider, 1) / 1_000_000
    )


def prompt_dedup(requests: DataFrame, order: list[str]) -> DataFrame:
    """First request per prompt key with the number of later repeats.

    A minimum is combined before the shuffle, so a key that many requests share stays small.
    """
    rest = [c for c in requests.columns if c not in ("prompt_key", *order)]
    return (
        requests.groupBy("prompt_key")
        .agg(F.min(F.struct(*order, *rest)).alias("first"), (F.count("*") - 1).alias("hit_count"))
        .select("prompt_key", "first.*", "hit_count")
    )


def responses(requests: DataFrame, order: list[str]) -> DataFrame:
    """Price each request; a repeat of an earlier prompt key is a cached answer without cost.

    ``order`` names the columns that identify a request and put requests in order.
    """
    # the first request of each key is found by a combined minimum and marked by its own unique
    # position, so nothing is joined on a key that many requests share
    first = requests.groupBy("prompt_key").agg(F.min(F.struct(*order)).alias("at")).select(
        "at.*", F.lit(True).alias("is_first")
    )
    zero = F.lit(0).cast("bigint")
    priced = requests.join(first, order, "left").withColumn("cached", F.col("is_first").isNull())
    priced = priced.withColumn(
        "input_tokens", F.when(F.col("cached"), zero).otherwise(token_estimate(F.col("user_prompt"), F.col("provider")))
    ).withColumn("output_tokens", F.when(F.col("cached"), zero).otherwise(output_tokens(F.col("provider"))))
    cost = cost_estimate(F.col("provider"), F.col("input_tokens"), F.col("output_tokens"))
    return priced.withColumn("cost_usd", cost).drop("is_first")


def usage_totals(answered: DataFrame) -> DataFrame:
    """Running totals of a usage tracker as one aggregate; failed requests only count as errors."""
    ok = ~F.col("failed")
    return answered.agg(
        F.count_if(ok).alias("total_requests"),
        F.coalesce(F.sum(F.when(ok, F.col("input_tokens"))), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("total_output_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("cost_usd"))), F.lit(0.0)).alias("total_cost_usd"),
        F.coalesce(F.sum(F.when(ok, F.col("latency_ms"))), F.lit(0.0)).alias("total_latency_ms"),
        F.count_if(ok & F.col("cached")).alias("cache_hits"),
        F.count_if(~ok).alias("errors"),
    )


def requests_per_model(answered: DataFrame) -> DataFrame:
    return answered.filter(~F.col("failed")).groupBy("model").agg(F.count("*").alias("requests"))


# --- cache hits with a time to live ------------------------------------------------------------
def ttl_hits(ws: Workspace, requests: DataFrame, ttl_seconds: int = rules.DEFAULT_TTL_SECONDS) -> DataFrame:
    """Mark each request of (key, at in microseconds, seq) as cache hit or miss.

    A miss creates an entry; requests until ``ttl_seconds`` after it, that moment included, are
    hits and do not prolong it.

    From each moment the next entry would be created at the first request after its expiry.
    The entries of a key are what its first request leads to; following these pointers with
    doubled steps takes as many rounds as the logarithm of the entries of one key, and no key, however long,
    is read in one task.
    """
    ttl = (ttl_seconds or rules.DEFAULT_TTL_SECONDS) * 1_000_000
    rows = ws.save(requests.select("key", "at", "seq"))
    moments = ws.save(rows.groupBy("key", "at").agg(F.min("seq").alias("seq")))
    asked = moments.select("key", F.col("at").alias("t"), F.lit(False).alias("is_end"), "at")
    ends = moments.select("key", (F.col("at") + ttl).alias("t"), F.lit(True).alias("is_end"), "at")
    pointed = ordered.next_value(
        ws, asked.unionAll(ends), ["key"], [F.col("t"), F.col("is_end")],
        F.when(~F.col("is_end"), F.col("at")), "next_at",
    )
    jump, seen = ws.save_counted(pointed.filter("is_end AND next_at IS NOT NULL").select("key", "at", "next_at"))
    reached = ws.save(moments.groupBy("key").agg(F.min("at").alias("at")))
    created = [reached]
    while seen["rows"]:
        known = reduce(DataFrame.unionAll, created)
        created.append(ws.save(known.join(jump, ["key", "at"]).select("key", F.col("next_at").alias("at"))))
        farther = jump.select("key", F.col("at").alias("next_at"), F.col("next_at").alias("far_at"))
        jump, seen = ws.save_counted(jump.join(farther, ["key", "next_at"]).select("key", "at", F.col("far_at").alias("next_at")))
    entries = reduce(DataFrame.unionAll, created).join(moments, ["key", "at"]).withColumn("miss", F.lit(True))
    return rows.join(entries, ["key", "at", "seq"], "left").select(
        "key", "at", "seq", F.col("miss").isNull().alias("hit")
    )


def cache_stats(marked: DataFrame) -> DataFrame:
    """Hits, misses, entries held and hit rate in percent."""
    hits, total = F.count_if("hit"), F.count("*")
    return marked.groupBy("key").agg(hits.alias("h"), total.alias("n")).agg(
        F.coalesce(F.sum("h"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.col("n") - F.col("h")), F.lit(0)).alias("misses"),
        F.count("*").alias("size"),
        (F.coalesce(F.sum("h"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1)) * 100).alias("hit_rate"),
    )


def retry_log(attempts: DataFrame, allowance: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Per request of (request_id, attempt from 0, ok): attempts made, errors, waiting time.

    A request ends with its first success; every attempt in the log counts, also those beyond the
    allowance, which only decides whether a request without success has been given up.  Attempt
    ``i`` that fails is followed by a wait of 2^i + 0.5 seconds.
    """
    ends = attempts.groupBy("request_id").agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"), F.count("*").alias("n")
    )
    errors = F.coalesce(F.col("first_ok"), F.col("n")).cast("bigint")
    waited = F.pow(F.lit(float(rules.BACKOFF_BASE)), errors) - 1 + errors * rules.BACKOFF_EXTRA
    return ends.select(
        "request_id",
        F.coalesce(F.col("first_ok") + 1, F.col("n")).cast("bigint").alias("attempts"),
        errors.alias("errors"),
        waited.alias("wait_seconds"),
        (F.col("first_ok").isNull() & (F.col("n") >= allowance)).alias("gave_up"),
    )
