"""The six scores of a page, the separate answer score, and their findings.

Each scorer is columns over one row: `facts`, `rulings`, `x_robots_tag` and `llms`. A
finding is struct(code, severity, positive, message); an absent one is null and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlens.constants import ANSWER_TYPES, ARTICLE_TYPES, BOTS, LANDMARKS, ORG_TYPES, OTHER_CONTENT_TYPES, TIER_A, TIER_B, TLDR_CHARS
from crawlens.functions.columns import grade, has_any, let, matching, trimmed, whole
from crawlens.operators.block import js_shell
from crawlens.operators.robots import blocked, notable_blocked

#: What each finding says, in our words.
MESSAGES = {
    "robots.absent": "There is no robots.txt, so it disallows nobody.",
    "robots.all_allowed": "robots.txt lets every tracked crawler in.",
    "robots.some_blocked": "robots.txt shuts out some tracked crawlers.",
    "meta.noindex": "The page asks not to be indexed.",
    "meta.noai": "The page asks not to be used by models.",
    "meta.nosnippet": "The page asks for no snippets.",
    "meta.clean": "No directive restricts the page.",
    "extract.js_only": "Without scripts there is nothing to read.",
    "extract.thin_content": "Little text is in the markup.",
    "extract.has_text": "The text is in the markup.",
    "extract.main_landmark": "The content stands in a main or article element.",
    "extract.no_main": "No main or article element holds the content.",
    "extract.low_ratio": "Markup outweighs text by far.",
    "schema.invalid_jsonld": "A JSON-LD block can't be parsed.",
    "schema.none": "There is no structured data.",
    "schema.jsonld_present": "Valid JSON-LD is present.",
    "schema.microdata_only": "Structured data is present, but not as valid JSON-LD.",
    "schema.content_entity": "The article is described.",
    "schema.sameas": "The publisher or author links to other profiles.",
    "schema.no_sameas": "The publisher or author links to no other profile.",
    "schema.no_identity": "Neither publisher nor author is described.",
    "schema.breadcrumb": "Breadcrumbs are described.",
    "schema.answer_friendly": "Questions or steps are described.",
    "structure.single_h1": "There is one top heading.",
    "structure.no_h1": "There is no top heading.",
    "structure.multiple_h1": "There are several top headings.",
    "structure.hierarchy_ok": "Headings skip no level.",
    "structure.hierarchy_skips": "Headings skip levels.",
    "structure.title_length": "The title is too short or too long.",
    "structure.no_title": "There is no title.",
    "structure.no_landmarks": "No landmark elements part the page.",
    "structure.no_main_landmark": "Landmarks are there, but neither main nor article.",
    "structure.no_lists": "There are no lists or tables.",
    "meta.no_description": "There is no description.",
    "meta.no_canonical": "No canonical address is given.",
    "meta.no_social": "There are no preview tags.",
    "meta.no_lang": "The language isn't declared.",
    "meta.no_author": "Nobody is named as author or publisher.",
    "meta.author_present": "An author or publisher is named.",
    "meta.no_date": "No date is given.",
    "llms.present": "There is an llms.txt.",
    "llms.well_formed": "llms.txt has the expected shape.",
    "llms.malformed": "llms.txt hasn't the expected shape.",
    "llms.full_present": "There is an llms-full.txt.",
    "llms.absent": "There is no llms.txt.",
    "answer.question_headings": "Headings ask questions.",
    "answer.no_question_headings": "No heading asks a question.",
    "answer.faq": "There is a list of questions.",
    "answer.tldr": "There is a summary.",
    "answer.no_answer_paras": "No heading is followed by a full paragraph.",
}
FINDING = "array<struct<code:string,severity:string,positive:boolean,message:string>>"


def finding(code: str, severity="info", when: Column | None = None, positive: bool | None = None) -> Column:
    """A finding; good where its severity is info, unless `positive` says otherwise. Null unless `when` holds."""
    level = severity if isinstance(severity, Column) else F.lit(severity)
    out = F.struct(F.lit(code).alias("code"), level.alias("severity"), F.lit(not isinstance(severity, Column) and severity == "info" if positive is None else positive).alias("positive"), F.lit(MESSAGES[code]).alias("message"))
    return out if when is None else F.when(when, out)


def result(score: Column, most: int, found: list[Column]) -> Column:
    """struct(score, max, findings)."""
    clamped = F.least(F.lit(most), F.greatest(F.lit(0), score)).cast("int")
    return F.struct(clamped.alias("score"), F.lit(most).alias("max"), F.array_compact(F.array(*found)).alias("findings"))


def points(*steps, other=0) -> Column:
    """The points of the first condition that holds."""
    out = F.lit(other)
    for condition, value in reversed(steps):
        out = F.when(condition, value).otherwise(out)
    return out


def meta(key: str, name: str) -> Column:
    """Trimmed content of the first meta element with the name; '' if none."""
    own = F.filter(F.col("facts.metas"), lambda m: F.lower(m[key]) == name)
    return F.coalesce(trimmed(F.try_element_at(own, F.lit(1)).content), F.lit(""))


def first_node(types) -> Column:
    """The first described node of one of the types; null if none."""
    wanted = F.array(*[F.lit(t.lower()) for t in types])
    return F.try_element_at(F.filter(F.col("facts.jsonld_nodes"), lambda n: F.arrays_overlap(n.types, wanted)), F.lit(1))


def directives() -> Column:
    said = F.concat_ws(" ", F.lower(F.coalesce("x_robots_tag", F.lit(""))), F.lower(meta("name", "robots")))
    names = ("noindex", "noai", "noimageai", "nosnippet", "none")
    return F.struct(*[said.rlike(rf"\b{n}\b").alias(n) for n in names])


def crawler_access() -> Column:
    r, d = F.col("rulings"), F.col("directives")
    shut = F.size(blocked(r))
    robots = F.when(r.isNull(), 16).otherwise(whole((len(BOTS) - shut) / len(BOTS) * 16))
    quiet = F.greatest(F.lit(0), 6 - points((d.noindex | d.none, 4)) - points((d.noai | d.none, 1)) - points((d.nosnippet, 1)))
    found = [
        finding("robots.absent", when=r.isNull()),
        finding("robots.all_allowed", when=r.isNotNull() & (shut == 0)),
        finding("robots.some_blocked", F.when(notable_blocked(r), "high").otherwise("medium"), r.isNotNull() & (shut > 0)),
        finding("meta.noindex", "high", d.noindex | d.none),
        finding("meta.noai", "medium", d.noai | d.none),
        finding("meta.nosnippet", "low", d.nosnippet),
        finding("meta.clean", when=~(d.noindex | d.noai | d.nosnippet | d.none)),
    ]
    return result(robots + quiet, 22, found)


def extractability() -> Column:
    f = F.col("facts")
    words, main, ratio = f.word_count, f.main_word_count, f.text_ratio
    landmark = f.main | f.article
    score = (
        points((words >= 600, 10), (words >= 300, 8), (words >= 150, 6), (words >= 60, 3), other=1)
        + points((landmark & (main >= 150), 6), (landmark & (main > 0), 4), other=2)
        + points((ratio >= 0.15, 6), (ratio >= 0.08, 5), (ratio >= 0.04, 3), (ratio >= 0.02, 2))
    )
    found = [
        finding("extract.thin_content", F.when(words < 60, "high").otherwise("medium"), words < 150),
        finding("extract.has_text", when=words >= 150),
        finding("extract.main_landmark", when=landmark & (main >= 150)),
        finding("extract.no_main", "low", ~(landmark & (main > 0))),
        finding("extract.low_ratio", "low", ratio < 0.04),
    ]
    shell = result(F.lit(2), 22, [finding("extract.js_only", "critical")])
    return F.when(js_shell(), shell).otherwise(result(score, 22, found))


def structured_data() -> Column:
    f = F.col("facts")
    types, other = f.jsonld_types, F.concat(f.microdata_types, f.rdfa_types)
    valid = (f.jsonld_blocks - f.jsonld_invalid > 0) & (F.size(types) > 0)
    nothing = (F.size(types) == 0) & (F.size(other) == 0)
    article, content = has_any(types, ARTICLE_TYPES), has_any(types, OTHER_CONTENT_TYPES)
    org_node, person_node = first_node(ORG_TYPES), first_node(("Person",))
    org, person = org_node.isNotNull(), person_node.isNotNull()
    same = F.coalesce(org_node.same_as, F.lit(False)) | F.coalesce(person_node.same_as, F.lit(False))
    identity = F.least(F.lit(5), points((org, 2)) + points((person, 1)) + points((same, 2)))
    crumbs, answers_ = has_any(types, ("BreadcrumbList",)), has_any(types, ANSWER_TYPES)
    rich = (F.size(matching(types, TIER_A)) > 0) & (F.size(matching(types, TIER_B)) > 0)
    score = points((valid, 6), other=2) + points((article, 4), (content, 3)) + identity + points((crumbs, 2)) + points((has_any(types, ("WebSite",)), 1)) + points((answers_, 2)) + points((rich, 1))
    broken = finding("schema.invalid_jsonld", "medium", f.jsonld_invalid > 0)
    found = [
        broken,
        finding("schema.jsonld_present", when=valid),
        finding("schema.microdata_only", "low", ~valid, positive=True),
        finding("schema.content_entity", when=article),
        finding("schema.sameas", when=same),
        finding("schema.no_sameas", "low", ~same & (org | person)),
        finding("schema.no_identity", "medium", ~same & ~org & ~person),
        finding("schema.breadcrumb", when=crumbs),
        finding("schema.answer_friendly", when=answers_),
    ]
    return F.when(nothing, result(F.lit(0), 20, [broken, finding("schema.none", "high")])).otherwise(result(score, 20, found))


def heading_skips() -> Column:
    """Headings more than one level below the one before."""
    levels = F.col("facts.headings.level")
    return F.size(F.filter(levels, lambda x, i: (i > 0) & (x > F.coalesce(F.try_element_at(levels, i), F.lit(9)) + 1)))


def semantics() -> Column:
    f = F.col("facts")
    tops = F.size(F.filter(f.headings, lambda h: h.level == 1))
    many, skips, length = F.size(f.headings) >= 2, heading_skips(), F.length(f.title)
    landmarks = sum((f[x].cast("int") for x in LANDMARKS), F.lit(0))
    lists = f.ul_count + f.ol_count + f.table_count > 0
    good_title = length.between(15, 70)
    score = (
        points((tops == 1, 3), (tops > 1, 1))
        + points((many & (skips == 0), 3), (many, 1))
        + points((good_title, 3), (length > 0, 1))
        + points((landmarks >= 3, 3), (landmarks >= 1, 2))
        + points((lists, 2))
        + points((f.word_count >= 300, 1))
    )
    found = [
        finding("structure.single_h1", when=tops == 1),
        finding("structure.no_h1", "medium", tops == 0),
        finding("structure.multiple_h1", "low", tops > 1),
        finding("structure.hierarchy_ok", when=many & (skips == 0)),
        finding("structure.hierarchy_skips", "low", many & (skips > 0)),
        finding("structure.title_length", "low", (length > 0) & ~good_title),
        finding("structure.no_title", "high", length == 0),
        finding("structure.no_landmarks", "medium", landmarks == 0),
        finding("structure.no_main_landmark", "low", (landmarks > 0) & ~f.main & ~f.article),
        finding("structure.no_lists", "low", ~lists),
    ]
    return result(score, 16, found)


def provenance() -> Column:
    f = F.col("facts")
    described = F.length(meta("name", "description"))
    social = points(((meta("property", "og:title") != "") & (meta("property", "og:description") != ""), 1)) + points((meta("name", "twitter:card") != "", 1))
    article = first_node(ARTICLE_TYPES)
    key = lambda k: F.coalesce(F.array_contains(article.getField("keys"), k), F.lit(False))
    publisher = first_node(ORG_TYPES).isNotNull() | key("publisher")
    author = first_node(("Person",)).isNotNull() | key("author") | f.byline
    dated = key("datePublished") | key("dateModified") | f.time_datetime | (meta("property", "article:published_time") != "")
    who = points((publisher, 1)) + points((author, 2))
    score = points((described.between(50, 320), 2), (described > 0, 1)) + points((f.canonical != "", 2)) + social + points((f.html_lang != "", 1)) + who + points((dated, 2))
    found = [
        finding("meta.no_description", "medium", described == 0),
        finding("meta.no_canonical", "low", f.canonical == ""),
        finding("meta.no_social", "low", social == 0),
        finding("meta.no_lang", "low", f.html_lang == ""),
        finding("meta.no_author", "medium", who == 0),
        finding("meta.author_present", when=who > 0),
        finding("meta.no_date", "low", ~dated),
    ]
    return result(score, 12, found)


def llms() -> Column:
    """llms: struct(present, well_formed, full_present)."""
    f = F.col("llms")
    score = points((f.present, 5)) + points((f.present & f.well_formed, 2)) + points((f.present & f.full_present, 1))
    found = [
        finding("llms.present", when=f.present),
        finding("llms.well_formed", when=f.present & f.well_formed),
        finding("llms.malformed", "low", f.present & ~f.well_formed),
        finding("llms.full_present", when=f.present & f.full_present),
        finding("llms.absent", "medium", ~f.present),
    ]
    return result(score, 8, found)


def answers() -> Column:
    """struct(score, grade, signals and findings) of the separate answer score."""
    said = F.substring(F.col("facts.visible_text"), 1, TLDR_CHARS).rlike(r"(?i)\b(tl;?dr|in short|key takeaways?|summary|at a glance|quick answer)\b")
    # Bound once: it reads the text, and is used four times.
    return let(said, _answers)


def _answers(summary: Column) -> Column:
    f = F.col("facts")
    questions = F.size(F.filter(f.headings, lambda h: F.contains(h.text, F.lit("?"))))
    paragraphs = F.size(F.filter(f.headings, lambda h: (h.next_tag == "p") & (h.next_words >= 15)))
    schema, steps = has_any(f.jsonld_types, ANSWER_TYPES), has_any(f.jsonld_types, ("HowTo",))
    score = (
        points((questions >= 3, 30), (questions == 2, 22), (questions == 1, 12))
        + points((schema, 20))
        + points((f.faq_block, 5))
        + points((summary, 15))
        + points((paragraphs >= 4, 20), (paragraphs >= 2, 13), (paragraphs == 1, 6))
        + points((steps, 10), (f.ol_count > 0, 6))
    ).cast("int")
    found = [
        finding("answer.question_headings", when=questions > 0),
        finding("answer.no_question_headings", "low", questions == 0),
        finding("answer.faq", when=schema | f.faq_block),
        finding("answer.tldr", when=summary),
        finding("answer.no_answer_paras", "low", paragraphs == 0),
    ]
    return F.struct(
        score.alias("score"),
        grade(score).alias("grade"),
        questions.alias("question_headings"),
        paragraphs.alias("answer_paragraphs"),
        schema.alias("faq_schema"),
        f.faq_block.alias("faq_block"),
        summary.alias("tldr"),
        steps.alias("howto_schema"),
        f.ol_count.alias("ordered_lists"),
        F.array_compact(F.array(*found)).alias("findings"),
    )


#: Dimension, scorer, in order of report.
SCORERS = (
    ("aiCrawlerAccess", crawler_access),
    ("contentExtractability", extractability),
    ("structuredData", structured_data),
    ("semanticStructure", semantics),
    ("metadataProvenance", provenance),
    ("llmsTxt", llms),
)
