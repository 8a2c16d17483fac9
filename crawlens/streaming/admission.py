"""Admission of requests: limits per minute and day, in batch and as streams.

requests: event_id, ts, ip, route (page or site), weight. Order is by ts, then event_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crawlens.constants import COUNTER_HOURS, DAILY_GLOBAL, DAILY_PER_IP, MAX_URL_CHARS, PAGE_PER_MINUTE, SITE_PER_MINUTE
from crawlens.functions import urls
from crawlens.functions.columns import present


def day(ts: str = "ts") -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def per_minute(requests: DataFrame, page: int = PAGE_PER_MINUTE, site: int = SITE_PER_MINUTE) -> DataFrame:
    """requests with in_minute (place in its ip's and route's minute) and allowed."""
    minute = F.date_trunc("minute", "ts")
    place = F.row_number().over(W.partitionBy("ip", "route", minute).orderBy("ts", "event_id"))
    limit = F.when(F.col("route") == "site", site).otherwise(page)
    return requests.withColumn("in_minute", place).withColumn("allowed", F.col("in_minute") <= limit)


def daily(requests: DataFrame, per_ip: int = DAILY_PER_IP, overall: int = DAILY_GLOBAL, stored: DataFrame | None = None) -> DataFrame:
    """requests with day, allowed and blocked_by (global before ip_daily). Only accepted requests count.

    stored: counters to go on from: day, ip (null for the day's total), n.

    An ip's limit cuts its day at the last request that it still holds, and the day's limit
    cuts the day at the last of those, so a request is judged by two times. Both are found by
    ranks up to a limit, which Spark bounds before it shuffles: neither a day nor a busy ip
    is sorted by one task.
    """
    rows = requests.withColumn("day", day()).withColumn("at", F.struct("ts", "event_id"))
    left = total = None
    if stored is not None:
        left = stored.where("ip is not null").groupBy("day", "ip").agg(F.greatest(F.lit(0), per_ip - F.sum("n")).cast("int").alias("room"))
        total = stored.where("ip is null").groupBy("day").agg(F.greatest(F.lit(0), overall - F.sum("n")).cast("int").alias("free"))
    rank = F.row_number().over(W.partitionBy("day", "ip").orderBy("ts", "event_id"))
    first = rows.select("day", "ip", "ts", "event_id", "at").withColumn("r", rank).where(F.col("r") <= per_ip)
    first = first.withColumn("room", F.lit(per_ip)) if left is None else first.join(left, ["day", "ip"], "left").withColumn("room", F.coalesce("room", F.lit(per_ip)))
    held = first.where("r <= room")
    ip_cut = first.groupBy("day", "ip").agg(F.max("room").alias("ip_room"), F.count_if(F.col("r") <= F.col("room")).alias("held"), F.max(F.when(F.col("r") <= F.col("room"), F.col("at"))).alias("ip_last"))
    place = F.row_number().over(W.partitionBy("day").orderBy("ts", "event_id"))
    early = held.select("day", "ts", "event_id", "at").withColumn("p", place).where(F.col("p") <= overall)
    early = early.withColumn("free", F.lit(overall)) if total is None else early.join(total, "day", "left").withColumn("free", F.coalesce("free", F.lit(overall)))
    day_cut = early.groupBy("day").agg(F.max("free").alias("free"), F.max("p").alias("p"), F.max(F.when(F.col("p") <= F.col("free"), F.col("at"))).alias("day_last"))
    both = rows.join(ip_cut, ["day", "ip"], "left").join(day_cut, "day", "left")
    if total is not None:
        both = both.drop("free").join(total, "day", "left").withColumn("free", F.coalesce("free", F.lit(overall)))
    over_day = F.coalesce((F.col("free") <= 0) | ((F.col("p") >= F.col("free")) & (F.col("at") > F.col("day_last"))), F.lit(False))
    over_ip = (F.col("ip_room") <= 0) | ((F.col("held") >= F.col("ip_room")) & (F.col("at") > F.col("ip_last")))
    by = F.when(over_day, "global").when(over_ip, "ip_daily")
    return both.withColumn("blocked_by", by).withColumn("allowed", by.isNull()).select(*requests.columns, "day", "blocked_by", "allowed")


def weighted(requests: DataFrame, per_ip: int = DAILY_PER_IP, overall: int = DAILY_GLOBAL) -> DataFrame:
    """event_id, day, allowed, blocked_by where a request takes its weight, all of it or nothing.

    A refusal takes nothing, so each decision depends on those before it: a pass over the day.
    Days are independent. A day's rows are sorted by Spark and read in batches; what is kept
    is a counter for each ip.
    """
    rows = requests.select("event_id", "ts", "ip", F.greatest("weight", F.lit(1)).cast("int").alias("weight"), day().alias("day"))
    ordered = rows.repartition("day").sortWithinPartitions("day", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total, counts = None, 0, {}
        for batch in batches:
            out = []
            for e, ip, n, d in zip(batch.event_id, batch.ip, batch.weight, batch.day):
                if d != now:
                    now, total, counts = d, 0, {}
                by = "global" if total + n > overall else "ip_daily" if counts.get(ip, 0) + n > per_ip else None
                if by is None:
                    total += n
                    counts[ip] = counts.get(ip, 0) + n
                out.append((e, d, by is None, by))
            yield pd.DataFrame(out, columns=["event_id", "day", "allowed", "blocked_by"])

    return ordered.mapInPandas(run, "event_id bigint, day string, allowed boolean, blocked_by string")


def stream_counts(requests: DataFrame, lateness: str = f"{COUNTER_HOURS} hours") -> DataFrame:
    """Streaming: requests by ip and day. State of a day ends when the watermark has passed it."""
    return requests.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("w"), "ip").agg(F.count(F.lit(1)).alias("n")).select(F.expr("date_format(to_utc_timestamp(w.start, current_timezone()), 'yyyy-MM-dd')").alias("day"), "ip", "n")


def stream_daily(requests: DataFrame, per_ip: int = DAILY_PER_IP, overall: int = DAILY_GLOBAL) -> DataFrame:
    """Streaming form of `weighted` with a state for each day; counters end COUNTER_HOURS after their last request.

    Rows of one trigger are decided in order of ts; later triggers go on from the counters.
    Time is that of the requests: one that is COUNTER_HOURS or more behind the newest has
    no counter any more and gets no decision. (By the clock, there would always be another
    batch to run for timeouts, and an availableNow query would never end.)
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        total, ips, counts = state.get if state.exists else (0, [], [])
        have = dict(zip(ips, counts))
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        out = []
        for e, ip, n in zip(rows.event_id, rows.ip, rows.weight.clip(lower=1)):
            by = "global" if total + n > overall else "ip_daily" if have.get(ip, 0) + n > per_ip else None
            if by is None:
                total += int(n)
                have[ip] = have.get(ip, 0) + int(n)
            out.append((e, key[0], by is None, by))
        state.update((total, list(have), list(have.values())))
        # A timeout must lie beyond the watermark.
        state.setTimeoutTimestamp(max(int(rows.ms.max()), state.getCurrentWatermarkMs()) + COUNTER_HOURS * 3_600_000)
        yield pd.DataFrame(out, columns=["event_id", "day", "allowed", "blocked_by"])

    keyed = requests.withWatermark("ts", f"{COUNTER_HOURS} hours").withColumn("day", day()).withColumn("ms", F.unix_millis("ts"))
    return keyed.groupBy("day").applyInPandasWithState(
        run,
        "event_id bigint, day string, allowed boolean, blocked_by string",
        "total long, ips array<bigint>, counts array<int>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def outcome(default_origins: list[str], extra_origins: list[str] | None = None) -> Column:
    """http_status and error of a request, first rule first. Columns: method, path, origin, referer, body, human."""
    allowed = sorted({*default_origins, *(extra_origins or [])})
    body = F.from_json("body", "url string, token string")
    url = body.url

    def out(status: int, error: str | None) -> Column:
        return F.struct(F.lit(status).alias("http_status"), F.lit(error).cast("string").alias("error"))

    check = urls.safety(url)
    referred = F.regexp_extract("referer", "^(https?://[^/?#]+)", 1)
    return (
        F.when(F.col("method") == "OPTIONS", out(204, None))
        .when((F.col("method") == "GET") & (F.col("path") == "/health"), out(200, None))
        .when(~F.col("path").isin("/scan", "/scan-site"), out(404, "not_found"))
        .when(F.col("method") != "POST", out(405, "method_not_allowed"))
        .when(F.col("origin").isNotNull() & ~F.col("origin").isin(allowed), out(403, "forbidden_origin"))
        .when(F.col("origin").isNull() & ~referred.isin(allowed), out(403, "forbidden_referer"))
        .when(F.try_parse_json("body").isNull(), out(400, "invalid_json"))
        .when(~present(url), out(400, "url_required"))
        .when(F.length(url) > MAX_URL_CHARS, out(400, "url_too_long"))
        .when(check.reason == "invalid_url", out(400, "invalid_url"))
        .when(~urls.scheme(url).isin("http", "https"), out(400, "invalid_url_scheme"))
        .when(F.coalesce(body.token, F.lit("")) == "", out(400, "turnstile_required"))
        .when(~check.ok, out(400, "blocked_target"))
        .when(~F.col("human"), out(403, "turnstile_failed"))
        .otherwise(out(200, None))
    )
