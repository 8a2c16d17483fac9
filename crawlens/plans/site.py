"""Site scans: discovery of pages, stratified sample, roll-up of page reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crawlens.constants import MAX_NAV_LINKS, MAX_PAGES, MAX_SITEMAP_DEPTH, MAX_SITEMAP_URLS, PER_SECTION, WHITE
from crawlens.functions import urls
from crawlens.functions.columns import grade, half_up, present, trimmed, whole
from crawlens.operators import robots as robots_ops
from crawlens.session import cut

LOC = f"(?i)<loc>[{WHITE}]*+([^<{WHITE}][^<]*+)</loc>"


def unescaped(x: Column) -> Column:
    """XML entities, one after the other, the ampersand first."""
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def locs(body: Column) -> Column:
    """The addresses in a sitemap, in order."""
    return F.transform(F.regexp_extract_all(body, F.lit(LOC), F.lit(1)), lambda x: unescaped(trimmed(x)))


def is_index(body: Column) -> Column:
    return body.rlike(r"(?i)<sitemapindex[\s>]")


def crawled(seeds: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Visits of sitemaps from the seeds: origin, url, trail (where in the crawl), body, index, dropped.

    Depth is a constant, so the recursion is unrolled; a sitemap is visited at its first
    place in depth-first order. seeds: origin, ord, url. sitemaps: url, status, body.
    """
    first = W.partitionBy("origin", "url").orderBy("trail")
    # Every level reads them.
    files = cut(sitemaps.where((F.col("status") == 200) & present(F.col("body"))).select(F.col("url").alias("file_url"), "body", is_index(F.col("body")).alias("index")))
    level = seeds.where(urls.origin(F.col("url")) == F.col("origin")).select("origin", "url", F.array(F.col("ord").cast("int")).alias("trail"))
    visits = None
    for depth in range(MAX_SITEMAP_DEPTH + 1):
        level = level.withColumn("ok", urls.safety(F.col("url")).ok)
        got = level.join(files, (F.col("url") == F.col("file_url")) & F.col("ok"), "left").drop("file_url")
        got = cut(got)
        visits = got if visits is None else visits.unionByName(got)
        if depth < MAX_SITEMAP_DEPTH:
            below = got.where("index").select("origin", "trail", F.posexplode(locs(F.col("body"))).alias("n", "url"))
            level = below.where(urls.origin(F.col("url")) == F.col("origin")).select("origin", "url", F.concat("trail", F.array("n")).alias("trail"))
    return visits.withColumn("visit", F.row_number().over(first)).where("visit = 1").drop("visit")


def sitemap_pages(visits: DataFrame) -> DataFrame:
    """origin, url, trail, ok of the same-origin pages listed, at most the limit per origin (before repeats go)."""
    listed = visits.where("not index").select("origin", F.col("trail").alias("at"), F.posexplode(locs(F.col("body"))).alias("n", "url"))
    own = listed.where(urls.origin(F.col("url")) == F.col("origin")).select("origin", "url", F.concat("at", F.array("n")).alias("trail"), urls.safety(F.col("url")).ok.alias("ok"))
    rank = F.row_number().over(W.partitionBy("origin").orderBy("trail"))
    kept = own.where("ok").withColumn("rank", rank).where(F.col("rank") <= MAX_SITEMAP_URLS).drop("rank")
    return kept.unionByName(own.where("not ok"))


def nav_links(homes: DataFrame) -> DataFrame:
    """origin, ord, url, ok: links of the home pages that lead to the same site. homes: origin, url, links."""
    each = homes.select("origin", F.col("url").alias("base"), F.posexplode("links").alias("ord", "href"))
    href = trimmed(F.col("href"))
    plain = each.where((href != "") & ~href.startswith("#") & ~href.rlike("(?i)^(mailto:|tel:|javascript:|data:)"))
    full = plain.withColumn("url", urls.resolved(F.col("href"), F.col("base")))
    own = full.where(urls.origin(F.col("url")) == F.col("origin")).withColumn("ok", urls.safety(F.col("url")).ok)
    rank = F.row_number().over(W.partitionBy("origin", "ok").orderBy("ord"))
    return own.withColumn("rank", rank).where(~F.col("ok") | (F.col("rank") <= MAX_NAV_LINKS)).select("origin", "ord", "url", "ok")


def discovered(sites: DataFrame, robots_txt: DataFrame, sitemaps: DataFrame, homes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates: origin, ord, url; summary per origin: source, found, robots_found, sitemap_found, dropped)."""
    live = robots_txt.where((F.col("status") == 200) & present(F.col("body")))
    declared = cut(robots_ops.sitemaps(live))
    seeds = declared.unionByName(sites.join(declared.select("origin").distinct(), "origin", "left_anti").select("origin", F.lit(0).alias("ord"), F.concat("origin", F.lit("/sitemap.xml")).alias("url")))
    visits = crawled(seeds, sitemaps)
    pages = cut(sitemap_pages(visits))
    links = cut(nav_links(homes))
    counts = (
        sites.select("origin")
        .join(live.select("origin", F.lit(True).alias("robots_found")), "origin", "left")
        .join(visits.groupBy("origin").agg(F.count(F.lit(1)).alias("visited"), F.count_if(~F.col("ok")).alias("bad_maps")), "origin", "left")
        .join(pages.groupBy("origin").agg(F.count_if("ok").alias("mapped"), F.count_if(~F.col("ok")).alias("bad_pages")), "origin", "left")
        .join(links.groupBy("origin").agg(F.count_if("ok").alias("linked"), F.count_if(~F.col("ok")).alias("bad_links")), "origin", "left")
        .na.fill(0)
        .na.fill(False)
    )
    mapped, linked = F.col("mapped") > 0, F.col("linked") > 0
    summary = counts.select(
        "origin",
        F.when(mapped & (F.col("visited") > 1), "sitemap-index").when(mapped, "sitemap").when(linked, "nav-fallback").otherwise("none").alias("source"),
        F.when(mapped, F.col("mapped")).when(linked, F.col("linked")).otherwise(0).cast("long").alias("found"),
        "robots_found",
        mapped.alias("sitemap_found"),
        (F.col("bad_maps") + F.col("bad_pages") + F.when(mapped, 0).otherwise(F.col("bad_links"))).cast("long").alias("dropped"),
    )
    summary = cut(summary)
    source = summary.select("origin", "source")
    home = source.select("origin", F.array(F.lit(-1)).alias("trail"), F.concat("origin", F.lit("/")).alias("url"))
    maps = pages.where("ok").join(source.where("source like 'sitemap%'"), "origin", "left_semi").select("origin", "trail", "url")
    navs = links.where("ok").join(source.where("source = 'nav-fallback'"), "origin", "left_semi").select("origin", F.array("ord").alias("trail"), "url")
    once = home.unionByName(maps).unionByName(navs).groupBy("origin", "url").agg(F.min("trail").alias("trail"))
    ord_ = (F.row_number().over(W.partitionBy("origin").orderBy("trail")) - 1).alias("ord")
    return once.select("origin", ord_, "url"), summary


def sampled(candidates: DataFrame, max_pages: int = MAX_PAGES, per_section: int = PER_SECTION) -> DataFrame:
    """origin, section, available, url, taken: every candidate's section, and whether it is in the sample.

    The home page is always in. Sections get their first urls in order of their size, then
    name, until the budget is spent; only the last one to get any can be cut, so the running
    sum of what sections ask for says what each gets.
    """
    uniq = candidates.select("origin", "url").distinct()
    rest = uniq.where(~urls.is_homepage(F.col("url"), F.col("origin"))).withColumn("section", urls.section(F.col("url")))
    size = rest.groupBy("origin", "section").agg(F.count(F.lit(1)).alias("available"))
    order = W.partitionBy("origin").orderBy(F.desc("available"), "section")
    before = F.coalesce(F.sum(F.least("available", F.lit(per_section))).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    share = size.withColumn("take", F.least(F.lit(per_section), F.col("available"), F.greatest(F.lit(0), F.lit(max_pages - 1) - before)))
    rank = F.row_number().over(W.partitionBy("origin", "section").orderBy("url"))
    picked = rest.withColumn("rank", rank).where(F.col("rank") <= per_section).join(share, ["origin", "section"]).where(F.col("rank") <= F.col("take"))
    home = candidates.select("origin").distinct().select("origin", F.lit("").alias("section"), F.lit(1).cast("long").alias("available"), F.concat("origin", F.lit("/")).alias("url"), F.lit(0).alias("rank"))
    flat = home.unionByName(picked.select("origin", "section", "available", "url", "rank"))
    ord_ = (F.row_number().over(W.partitionBy("origin").orderBy("section", "rank")) - 1).alias("ord")
    return flat.select("origin", ord_, F.when(F.col("section") == "", "root").otherwise(F.col("section")).alias("section"), "available", "url")


def truncated(candidates: DataFrame, max_pages: int = MAX_PAGES, per_section: int = PER_SECTION) -> DataFrame:
    """origin, section, available of the sections that got fewer than they asked for."""
    rest = candidates.select("origin", "url").distinct().where(~urls.is_homepage(F.col("url"), F.col("origin")))
    size = rest.groupBy("origin", urls.section(F.col("url")).alias("section")).agg(F.count(F.lit(1)).alias("available"))
    order = W.partitionBy("origin").orderBy(F.desc("available"), "section")
    asked = F.sum(F.least("available", F.lit(per_section))).over(order.rowsBetween(W.unboundedPreceding, 0))
    return size.withColumn("asked", asked).where(F.col("asked") > max_pages - 1).drop("asked")


#: The four dimensions that are averaged over pages.
PAGE_LEVEL = ("contentExtractability", "structuredData", "semanticStructure", "metadataProvenance")


def page_rows(site: Column, order: Column, reports: DataFrame) -> DataFrame:
    """What the roll-up needs of each page's report. A row whose scan failed has a null block status."""
    portion = sum((F.col(n).score for n in PAGE_LEVEL), F.lit(0))
    return reports.select(
        site.alias("origin"),
        order.alias("ord"),
        "url",
        F.col("block.status").alias("block"),
        portion.alias("portion"),
        F.col("aiCrawlerAccess.score").alias("access"),
        F.col("llmsTxt.score").alias("llms"),
        "total",
        F.col("answers.score").alias("answers"),
        (F.size(robots_ops.blocked(F.col("rulings"))) > 0).alias("disallowed"),
        (F.col("directives.noindex") | F.col("directives.none")).alias("noindex"),
    )


def listed(condition: Column) -> Column:
    """Urls of the rows that fulfil it, in order."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("ord", "url")))), lambda x: x.url)


#: Lists of urls in a roll-up, and the rows (as SQL) they hold.
LISTS = {
    "hard_blocked": "block is null or block = 'HARD_BLOCK'",
    "soft_blocked": "block = 'SOFT_BLOCK'",
    "robots_disallowed": "block is not null and disallowed",
    "noindexed": "block is not null and noindex",
}


def rolled_up(rows: DataFrame, lists: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each origin (and `by`), by one grouping of sums and extremes. rows: as of page_rows.

    lists: with the urls of LISTS, all in one row, so only for sampled sites, whose pages
    are few; else how many there are of each.
    """
    scanned = F.col("block").isNotNull()
    counted = scanned & (F.col("block") != "HARD_BLOCK")
    homepage = F.concat("origin", F.lit("/"))
    away = F.when(scanned, F.struct((F.col("url") != homepage).alias("away"), "ord"))
    root = F.min_by(F.struct("url", "access", "llms"), away)
    portion, answer = F.when(counted, F.col("portion")).cast("double"), F.when(counted, F.col("answers")).cast("double")
    agg = rows.groupBy("origin", *by).agg(
        root.alias("root"),
        F.count(F.lit(1)).alias("pages"),
        F.count_if(counted).alias("counted"),
        F.count_if(~scanned | (F.col("block") == "HARD_BLOCK")).alias("inaccessible"),
        *[half_up(f(portion), 10).alias(f"page_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("stdev", F.stddev_pop), ("min", F.min), ("max", F.max))],
        *[half_up(f(answer), 10).alias(f"answer_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))],
        *[listed(F.expr(c)).alias(k) if lists else F.count_if(F.expr(c)).cast("int").alias(f"n_{k}") for k, c in LISTS.items()],
        F.min_by(F.when(counted, F.struct("url", "total")), F.when(counted, F.struct("total", "ord"))).alias("worst"),
    )
    access, llms = F.coalesce("root.access", F.lit(0)), F.coalesce("root.llms", F.lit(0))
    level = (access + llms).cast("double")
    total = F.when(F.col("counted") > 0, F.least(F.lit(100), F.greatest(F.lit(0), whole(level + F.col("page_mean")))))
    reason = F.when(F.col("counted") > 0, None).when(F.col("root").isNotNull(), "every page was blocked").otherwise("nothing could be read")
    return agg.select(
        "origin",
        *by,
        "pages",
        "counted",
        "inaccessible",
        total.alias("total"),
        grade(total).alias("grade"),
        reason.alias("unscorable"),
        level.alias("site_level"),
        access.alias("access"),
        llms.alias("llms"),
        F.col("root.url").alias("site_source"),
        *[c for c in agg.columns if c.startswith(("page_", "answer_"))],
        *[k if lists else f"n_{k}" for k in LISTS],
        F.col("worst.url").alias("worst_url"),
        F.col("worst.total").alias("worst_total"),
    )


def page_cap(asked: Column) -> Column:
    """Pages reported of a site: as many as asked for, within 1 and the limit; null asks for all."""
    return F.greatest(F.lit(1), F.least(F.lit(MAX_PAGES), F.floor(F.coalesce(asked, F.lit(float(MAX_PAGES)))))).cast("int")


def capped(rows: DataFrame, max_pages: float) -> DataFrame:
    """Only the first pages of each site, as many as asked for within 1 and the limit, rolled up anew."""
    return rolled_up(rows.where(F.col("ord") < page_cap(F.lit(float(max_pages)))))


def sampled_rows(pages: DataFrame, robots_txt: DataFrame, llms: DataFrame, sitemaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From fetched pages and site files: the rows of each site's sample (as of page_rows, in its order), and the summary of its discovery.

    A sampled url that wasn't fetched counts as a page whose scan failed.
    """
    from crawlens.operators import report

    # Reports are narrow rows, used for the home pages' links and for the roll-up: computed once.
    reports = cut(report.scored(report.contexts(pages, robots_txt, llms)))
    homes = reports.where(urls.is_homepage(F.col("url"), F.col("origin"))).select("origin", "url", F.col("facts.links").alias("links"))
    sites = reports.select("origin").where("origin is not null").distinct()
    candidates, summary = discovered(sites, robots_txt, sitemaps, homes)
    sample = sampled(candidates)
    safe = sample.where(urls.safety(F.col("url")).ok)
    rows = page_rows(F.col("origin"), F.lit(0), reports).drop("ord")
    return safe.select("origin", "ord", "url").join(rows, ["origin", "url"], "left"), summary


def site_scan(pages: DataFrame, robots_txt: DataFrame, llms: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """The roll-up of each site's sample, with its lists, and its discovery."""
    rows, summary = sampled_rows(pages, robots_txt, llms, sitemaps)
    return rolled_up(rows, lists=True).join(summary, "origin")


def asked_scans(targets: DataFrame, rows: DataFrame, summary: DataFrame) -> DataFrame:
    """target, max_pages, check, cap and the capped roll-up of the target's site (null where it is refused or unknown).

    targets: target (a url of the site), max_pages (null for all). A site is checked by its
    origin before anything of it is read.
    """
    site = urls.origin(F.col("target"))
    asked = targets.select("target", "max_pages", page_cap(F.col("max_pages").cast("double")).alias("cap"), urls.safety(F.coalesce(site, "target")).alias("check"), site.alias("origin"))
    fine = asked.where("check.ok").select("target", "cap", "origin")
    each = fine.join(rows, "origin").where(F.col("ord") < F.col("cap"))
    return asked.join(rolled_up(each, lists=True, by=("target",)).join(summary, "origin").drop("origin"), "target", "left")
