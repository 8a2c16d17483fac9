"""Redirects, resolved addresses and bodies of guarded fetches, as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlens.constants import MAX_BODY_BYTES, MAX_REDIRECTS, PROFILES
from crawlens.functions import urls
from crawlens.session import cut
from crawlens.sources.pages import capped


def followed(starts: DataFrame, responses: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """url, final_url, hops, outcome: every hop is checked before it is followed.

    starts: url. responses: url, status, location. The number of hops is a constant, so the
    chase is unrolled into as many equi-joins. Outcomes: ok, too_many_redirects, network_error
    (nothing answers), or blocked:<reason>.
    """
    known = responses.select(F.col("url").alias("at_url"), F.col("status").alias("at_status"), F.col("location").alias("at_location"))
    rows = starts.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome"))
    for hop in range(max_redirects + 1):
        check = urls.safety(F.col("at"))
        seen = rows.join(known, (F.col("at") == F.col("at_url")) & F.col("outcome").isNull(), "left")
        moved = F.col("at_status").between(300, 399) & F.col("at_location").isNotNull()
        now = (
            F.when(F.col("outcome").isNotNull(), F.col("outcome"))
            .when(~check.ok, F.concat(F.lit("blocked:"), check.reason))
            .when(F.col("at_status").isNull(), "network_error")
            .when(~moved, "ok")
            .when(F.lit(hop == max_redirects), "too_many_redirects")
        )
        step = F.col("outcome").isNull() & now.isNull()
        rows = cut(seen.select("url", F.when(step, urls.resolved(F.col("at_location"), F.col("at"))).otherwise(F.col("at")).alias("at"), F.when(step, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"), now.alias("outcome")))
    return rows.select("url", F.col("at").alias("final_url"), "hops", "outcome")


def fetched(starts: DataFrame, responses: DataFrame, max_redirects: int = MAX_REDIRECTS) -> DataFrame:
    """url, final_url, hops, error (null where it was read), status and the other columns of the final response.

    What the guarded fetch hands to a scan: a url that couldn't be read has a null status, so
    its page counts as a network error. responses: url, status, location and more.
    """
    chain = followed(starts, responses, max_redirects)
    rest = [c for c in responses.columns if c not in ("url", "location")]
    last = responses.select(F.col("url").alias("at_url"), F.lit("ok").alias("at_outcome"), *rest)
    both = chain.join(last, (F.col("final_url") == F.col("at_url")) & (F.col("outcome") == F.col("at_outcome")), "left")
    return both.select("url", "final_url", "hops", F.when(F.col("outcome") != "ok", F.col("outcome")).alias("error"), *rest)


def resolved(targets: DataFrame, dns: DataFrame) -> DataFrame:
    """url, ok, reason: the url's own check, then every address of its host; a host without addresses passes.

    dns: host, address, family, ord.
    """
    check = urls.safety(F.col("url"))
    first = targets.select("url", urls.host(F.col("url")).alias("host"), check.ok.alias("own_ok"), check.reason.alias("own_reason"))
    each = dns.select("host", "ord", urls.resolved_safety(F.col("address"), F.col("family")).alias("check"))
    verdict = each.groupBy("host").agg(F.bool_and("check.ok").alias("all_ok"), F.min_by("check.reason", F.when(~F.col("check.ok"), F.col("ord"))).alias("bad_reason"))
    both = first.join(verdict, "host", "left")
    fine = F.coalesce("all_ok", F.lit(True))
    return both.select("url", (F.col("own_ok") & fine).alias("ok"), F.when(~F.col("own_ok"), F.col("own_reason")).when(~fine, F.col("bad_reason")).otherwise("ok").alias("reason"))


def read(responses: DataFrame, profile: str) -> DataFrame:
    """responses (url, status, location, bytes, took_ms) as a runtime's fetch sees them: too slow is no answer; a long body is cut."""
    limit = PROFILES[profile]
    late = F.col("took_ms") > limit["timeout_ms"]
    most = limit["body_bytes"]
    body = capped("bytes", most) if most else F.make_valid_utf8(F.col("bytes").cast("string"))
    return responses.select("url", F.when(~late, F.col("status")).alias("status"), F.when(~late, F.col("location")).alias("location"), F.when(~late, body).alias("body"))


def bodies(raw: DataFrame, most: int = MAX_BODY_BYTES) -> DataFrame:
    """raw (url, bytes) with the body as text, cut at so many bytes."""
    return raw.select("url", capped("bytes", most).alias("body"), (F.octet_length("bytes") > most).alias("cut"))
