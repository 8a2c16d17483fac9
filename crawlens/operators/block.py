"""Reachability of a fetched page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.constants import CHALLENGE_MARKERS, GATE_MARKERS, HARD_STATUSES, MARKER_CHARS
from crawlens.functions.columns import let, lits


def js_shell(facts: str = "facts") -> Column:
    """Hardly any text, and signs that scripts would make it."""
    f = F.col(facts)
    starved = (f.word_count < 40) & (f.main_word_count < 25)
    return starved & (((f.script_count >= 1) & (f.script_length > 3000)) | f.next_data | f.empty_root)


def shell_reason(facts: str = "facts") -> Column:
    f = F.col(facts)
    heavy = (f.script_count >= 1) & (f.script_length > 3000)
    bits = F.array_compact(F.array(F.when(f.next_data, "app data block"), F.when(f.empty_root, "empty app root"), F.when(heavy, "heavy scripts"), F.concat(f.word_count.cast("string"), F.lit(" words"))))
    return F.when(js_shell(facts), F.array_join(bits, ", "))


def first_marker(head: Column, markers) -> Column:
    """The first marker, in list order, that the text holds; null if none."""
    return F.try_element_at(F.filter(lits(markers), lambda m: F.contains(head, m)), F.lit(1))


def head(html: Column) -> Column:
    return F.substring(F.lower(F.coalesce(html, F.lit(""))), 1, MARKER_CHARS)


def markers(html: Column) -> Column:
    """struct(challenge, gate), taken before the markup is parsed and dropped."""
    # Bound once: inside a filter the head would be made anew for each marker.
    return let(head(html), lambda h: F.struct(first_marker(h, CHALLENGE_MARKERS).alias("challenge"), first_marker(h, GATE_MARKERS).alias("gate")))


def verdict(status: str = "status", marks: str = "marks", facts: str = "facts") -> Column:
    """struct(status, http_status, reason, detail); the first rule that holds decides."""
    s, m = F.col(status), F.col(marks)
    http = F.concat(F.lit("http_"), s.cast("string"))

    def out(kind: str, reason, detail) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        detail = F.lit(detail) if isinstance(detail, str) else detail
        return F.struct(F.lit(kind).alias("status"), s.alias("http_status"), reason.alias("reason"), detail.cast("string").alias("detail"))

    return (
        F.when(s.isNull(), out("HARD_BLOCK", "network_error", "no response"))
        .when(s.isin(*HARD_STATUSES), out("HARD_BLOCK", http, "refused by status"))
        .when(m.challenge.isNotNull(), out("HARD_BLOCK", "bot_challenge", m.challenge))
        .when(s >= 400, out("HARD_BLOCK", http, "no content at this status"))
        .when(s >= 300, out("OK", http, "redirect left unfollowed"))
        .when(m.gate.isNotNull(), out("SOFT_BLOCK", "gated_content", m.gate))
        .when(js_shell(facts), out("SOFT_BLOCK", "js_only_shell", shell_reason(facts)))
        .otherwise(out("OK", "ok", "readable"))
    )
