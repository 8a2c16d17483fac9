"""robots.txt: lines to groups, groups to rulings for each tracked crawler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlens.constants import BOTS, NOTABLE_BOTS
from crawlens.functions.columns import let, lits, trimmed


def lines(robots: DataFrame) -> DataFrame:
    """origin, line_no, field, value of the lines that say something. robots: origin, body."""
    cut = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "raw"))
    line = trimmed(F.regexp_replace("raw", "#.*$", ""))
    at = F.instr(line, ":")
    return cut.where(at > 0).select(
        "origin",
        "line_no",
        F.lower(trimmed(F.substring_index(line, ":", 1))).alias("field"),
        trimmed(F.regexp_replace(line, "^[^:]*:", "")).alias("value"),
    )


def sitemaps(robots: DataFrame) -> DataFrame:
    """origin, ord, url of the declared sitemaps."""
    return lines(robots).where("field = 'sitemap'").select("origin", F.col("line_no").alias("ord"), F.col("value").alias("url"))


def rules(robots: DataFrame) -> DataFrame:
    """origin, group_id, line_no, field, value: agents and their rules, numbered by group.

    A group begins at an agent line that doesn't follow another one; sitemap lines don't
    count for that, unknown fields do. Rules before any agent belong to no group.
    """
    own = W.partitionBy("origin").orderBy("line_no")
    said = lines(robots).where("field <> 'sitemap'")
    agent = F.col("field") == "user-agent"
    start = agent & ~F.coalesce(F.lag("field").over(own) == "user-agent", F.lit(False))
    numbered = said.withColumn("starts", start.cast("int")).withColumn("group_id", F.sum("starts").over(own))
    return numbered.where((F.col("group_id") > 0) & F.col("field").isin("user-agent", "allow", "disallow")).select("origin", "group_id", "line_no", "field", "value")


def pattern_regex(pattern: Column) -> Column:
    """A path pattern as a regular expression: * is any run, a final $ is the end.

    What follows a * is looked for at its first place and then not again (an atomic group):
    a later place could not help what comes after, so many * don't multiply the work. Only
    with a final $ the last part is looked for at the end.
    """
    ends = pattern.endswith("$")
    core = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.regexp_replace(core, r"([.+?^${}()|\[\]\\])", r"\\$1")
    last = F.when(ends, F.regexp_extract(escaped, r"\*([^*]*)$", 1)).otherwise("")
    head = F.when(ends, F.regexp_replace(escaped, r"\*+[^*]*$", "")).otherwise(escaped)
    parts = F.regexp_replace(F.regexp_replace(head, r"\*+$", ""), r"\*+([^*]+)", "(?>.*?$1)")
    tail = F.when(~ends, "").when(F.contains(escaped, F.lit("*")), F.concat(F.lit(".*"), last, F.lit("$"))).otherwise("$")
    return F.concat(F.lit("^"), parts, tail)


def pattern_length(pattern: Column) -> Column:
    """Literal characters of a pattern."""
    return F.length(F.regexp_replace(F.regexp_replace(pattern, r"\$$", ""), r"\*", ""))


def groups(robots: DataFrame) -> DataFrame:
    """origin, groups: array of struct(agents, rules) in order; one small row for each origin."""
    rule = F.struct("line_no", F.col("field").alias("kind"), F.col("value").alias("pattern"), pattern_regex(F.col("value")).alias("regex"), pattern_length(F.col("value")).alias("length"))
    is_agent = F.col("field") == "user-agent"
    of_group = rules(robots).groupBy("origin", "group_id").agg(
        F.array_sort(F.collect_set(F.when(is_agent, F.lower("value")))).alias("agents"),
        F.array_sort(F.collect_list(F.when(~is_agent & (F.col("value") != ""), rule))).alias("rules"),
    )
    return of_group.groupBy("origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_id", "agents", "rules"))), lambda g: F.struct(g.agents.alias("agents"), g.rules.alias("rules"))).alias("groups"))


def matched(groups_: Column, path: Column) -> Column:
    """The groups with those of their rules that match the path."""
    return F.transform(groups_, lambda g: F.struct(g.agents.alias("agents"), F.filter(g.rules, lambda r: F.regexp_like(path, r.regex)).alias("rules")))


def ruling(matched_: Column, bot: Column) -> Column:
    """struct(bot, allowed, rule, explicit) of one crawler, from the groups as of `matched`. Each step is bound once."""
    name = F.lower(bot)
    named = F.filter(matched_, lambda g: F.exists(g.agents, lambda a: (a != "*") & F.contains(name, a)))

    def longest(matching: Column, kind: str) -> Column:
        """struct(length, pattern) of the first longest rule of the kind; length -1 if none."""

        def first(own: Column) -> Column:
            most = F.coalesce(F.array_max(F.transform(own, lambda r: r.length)), F.lit(-1))
            return let(most, lambda n: F.struct(n.alias("length"), F.try_element_at(F.filter(own, lambda r: r.length == n), F.lit(1)).pattern.alias("pattern")))

        return let(F.filter(matching, lambda r: r.kind == kind), first)

    def judged(explicit: Column, used: Column, best: Column) -> Column:
        allow, disallow = best.allow.length, best.disallow.length
        rule = (
            F.when(F.size(used) == 0, "no matching group")
            .when(disallow == -1, "no matching Disallow")
            .when(allow >= disallow, F.concat(F.lit("Allow: "), best.allow.pattern))
            .otherwise(F.concat(F.lit("Disallow: "), best.disallow.pattern))
        )
        return F.struct(bot.alias("bot"), ((disallow == -1) | (allow >= disallow)).alias("allowed"), rule.alias("rule"), explicit.alias("explicit"))

    def of(own: Column) -> Column:
        explicit = F.size(own) > 0
        used = F.when(explicit, own).otherwise(F.filter(matched_, lambda g: F.array_contains(g.agents, "*")))
        best = lambda m: F.struct(longest(m, "allow").alias("allow"), longest(m, "disallow").alias("disallow"))
        return let(used, lambda u: let(let(F.flatten(F.transform(u, lambda g: g.rules)), best), lambda x: judged(explicit, u, x)))

    return let(named, of)


def rulings(groups_: str = "groups", path: str = "path") -> Column:
    """Array of the rulings of all tracked crawlers, null without robots.txt. Rules are matched once for all crawlers."""
    g = F.col(groups_)
    return F.when(g.isNotNull(), let(matched(g, F.col(path)), lambda m: F.transform(lits(BOTS), lambda b: ruling(m, b))))


def blocked(rulings_: Column) -> Column:
    return F.coalesce(F.transform(F.filter(rulings_, lambda r: ~r.allowed), lambda r: r.bot), F.array().cast("array<string>"))


def notable_blocked(rulings_: Column) -> Column:
    return F.arrays_overlap(blocked(rulings_), lits(NOTABLE_BOTS))
