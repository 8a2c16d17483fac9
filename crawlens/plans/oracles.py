"""DuckDB text for the queries that SQL expresses, written apart from them."""

from __future__ import annotations

from crawlens.constants import ANSWER_TYPES, BOTS, CHALLENGE_MARKERS, DIMENSIONS, GATE_MARKERS, NOTABLE_BOTS, TIER_A, TIER_B
from crawlens.sources import inputs
from crawlens.sources.inputs import duck


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _text(x: str) -> str:
    """Visible text of markup, by expressions."""
    blocks = "p|div|section|article|main|header|footer|li|tr|h1|h2|h3|h4|h5|h6"
    for pattern, by in (
        (r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", ""),
        (rf"<({blocks})( [^>]*)?>", " "),
        (r"</[a-z0-9]+>", " "),
        (r"<[^>]*>", ""),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    for name, char in (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return rf"trim(regexp_replace({x}, '[ \n\t\r]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END)"


#: White space, as a class of RE2.
WS = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


XP = f"xp AS ({duck(inputs.PAGES)})"
FEATURES = rf"""
nc AS (
    SELECT *, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS plain,
           coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path
    FROM xp
),
tx AS (
    SELECT *, {_text("regexp_extract(plain, '(?s)<body>(.*)$', 1)")} AS visible, contains(plain, '<main>') AS main,
           {_text("regexp_extract(plain, '(?s)<main>(.*?)(?:</main>|$)', 1)")} AS in_main,
           {_text("regexp_extract(plain, '(?s)<article>(.*?)(?:</article>|$)', 1)")} AS in_article,
           regexp_extract_all(plain, '(?s)<script[^>]*>.*?</script>') AS scripts,
           regexp_extract_all(plain, '<h([1-6])>', 1) AS levels,
           regexp_extract_all(plain, '(?s)<script type="application/ld[+]json">(.*?)</script>', 1) AS blocks,
           {_text("regexp_extract(plain, '(?s)<title>(.*?)</title>', 1)")} AS title
    FROM nc
),
-- The objects of JSON-LD that have a type, in the order of the page.
jb AS (SELECT page_id, i AS b, blocks[i] AS body, json_valid(blocks[i]) AS valid FROM tx, unnest(range(1, len(blocks) + 1)) t(i)),
jn AS (
    SELECT page_id, b, t.id AS k, t.value AS v,
           list_transform(CASE json_type(t.value, '$."@type"') WHEN 'VARCHAR' THEN [t.value->>'$."@type"'] ELSE (t.value->'$."@type"')::VARCHAR[] END, lambda x: list_last(regexp_split_to_array(trim(x), '[/#]'))) AS names
    FROM (SELECT page_id, b, (CASE WHEN valid THEN body ELSE '0' END)::JSON AS j FROM jb) s, json_tree(s.j) t
    WHERE t.type = 'OBJECT' AND json_exists(t.value, '$."@type"')
),
jt AS (SELECT page_id, list(name ORDER BY pos) AS types FROM (SELECT page_id, name, min((b, k, i)) AS pos FROM (SELECT page_id, b, k, names[i] AS name, i FROM jn, unnest(range(1, len(names) + 1)) t(i)) GROUP BY 1, 2) GROUP BY 1),
jo AS (
    SELECT page_id,
           bool_or(list_has_any(names, ['Organization', 'LocalBusiness'])) AS org, bool_or(list_contains(names, 'Person')) AS person,
           arg_min(json_exists(v, '$.sameAs'), (b, k)) FILTER (list_has_any(names, ['Organization', 'LocalBusiness'])) AS org_same,
           arg_min(json_keys(v), (b, k)) FILTER (list_has_any(names, ['Article', 'BlogPosting', 'NewsArticle'])) AS article_keys
    FROM jn GROUP BY 1
),
ji AS (SELECT page_id, count(*) AS n_blocks, count(*) FILTER (NOT valid) AS n_bad FROM jb WHERE trim(body) <> '' GROUP BY 1),
f0 AS (
    SELECT tx.*, CASE WHEN main THEN in_main ELSE in_article END AS main_text,
           coalesce(jt.types, []) AS types, coalesce(jo.org, false) AS org, coalesce(jo.person, false) AS person, coalesce(jo.org_same, false) AS same, coalesce(jo.article_keys, []) AS article_keys,
           coalesce(ji.n_blocks, 0) AS n_blocks, coalesce(ji.n_bad, 0) AS n_bad,
           regexp_extract_all(plain, 'itemtype="[^"]*/([^"/]+)"', 1) AS micro
    FROM tx LEFT JOIN jt USING (page_id) LEFT JOIN jo USING (page_id) LEFT JOIN ji USING (page_id)
),
ft AS (
    SELECT *, {_words("visible")} AS words, {_words("main_text")} AS main_words, len(scripts) AS n_scripts,
           list_sum(list_transform(scripts, lambda s: length(s))) AS script_length,
           length(visible) / length(html)::DOUBLE AS ratio,
           contains(plain, '<article>') AS article, contains(plain, '<nav>') AS nav, contains(plain, '<header>') AS header, contains(plain, '<footer>') AS footer,
           len(regexp_extract_all(plain, '<ul>')) AS uls, len(regexp_extract_all(plain, '<ol>')) AS ols, len(regexp_extract_all(plain, '<table>')) AS tables,
           contains(plain, 'id="__NEXT_DATA__"') AS next_data, contains(plain, '<div id="__next"></div>') AS empty_root,
           regexp_extract(plain, '<meta name="robots" content="([^"]*)"', 1) AS robots_meta,
           regexp_matches(plain, 'class="[^"]*author|name="author"|rel="author"') AS byline, contains(plain, '<time datetime=') AS timed, regexp_matches(plain, '(class|id)="[^"]*faq') AS faq_block,
           length(regexp_extract(plain, '<meta name="description" content="([^"]*)"', 1)) AS description, regexp_extract(plain, '<link rel="canonical" href="([^"]*)"', 1) AS canonical,
           contains(plain, '"og:title"') AND contains(plain, '"og:description"') AS og, contains(plain, '"twitter:card"') AS twitter,
           regexp_extract(plain, '<html lang="([a-z]*)"', 1) AS lang
    FROM f0
),
sh AS (
    SELECT *, words < 40 AND main_words < 25 AND ((n_scripts >= 1 AND script_length > 3000) OR next_data OR empty_root) AS shell,
           list_filter({_list(CHALLENGE_MARKERS)}, lambda m: contains(lower(html)[1:20000], m))[1] AS challenge,
           list_filter({_list(GATE_MARKERS)}, lambda m: contains(lower(html)[1:20000], m))[1] AS gate
    FROM ft
),
bl AS (
    SELECT *, CASE WHEN status IS NULL OR status IN (401, 403, 407, 429, 451, 503) OR challenge IS NOT NULL OR status >= 400 THEN 'HARD_BLOCK'
                   WHEN status >= 300 THEN 'OK' WHEN gate IS NOT NULL OR shell THEN 'SOFT_BLOCK' ELSE 'OK' END AS block,
           CASE WHEN status IS NULL THEN 'network_error' WHEN status IN (401, 403, 407, 429, 451, 503) THEN 'http_' || status
                WHEN challenge IS NOT NULL THEN 'bot_challenge' WHEN status >= 300 THEN 'http_' || status
                WHEN gate IS NOT NULL THEN 'gated_content' WHEN shell THEN 'js_only_shell' ELSE 'ok' END AS reason
    FROM sh
)"""

ROBOTS = rf"""
rb AS (SELECT * FROM ({duck(inputs.ROBOTS)}) WHERE status = 200 AND {_trim("body")} <> ''),
rl AS (SELECT origin, i AS line_no, {_trim("regexp_replace(l[i + 1], '#.*$', '')")} AS line FROM (SELECT origin, string_split(body, chr(10)) AS l FROM rb), unnest(range(len(l))) t(i)),
ln AS (SELECT origin, line_no, lower({_trim("split_part(line, ':', 1)")}) AS field, {_trim("substr(line, instr(line, ':') + 1)")} AS value FROM rl WHERE instr(line, ':') > 0),
gs AS (SELECT *, CASE WHEN field = 'user-agent' AND coalesce(lag(field) OVER (PARTITION BY origin ORDER BY line_no), '') <> 'user-agent' THEN 1 ELSE 0 END AS starts FROM ln WHERE field <> 'sitemap'),
gr AS (SELECT *, sum(starts) OVER (PARTITION BY origin ORDER BY line_no)::BIGINT AS group_id FROM gs),
ru AS (SELECT origin, group_id, line_no, field, value FROM gr WHERE group_id > 0 AND field IN ('user-agent', 'allow', 'disallow')),
bot AS (SELECT unnest({_list(BOTS)}) AS bot),
ag AS (SELECT origin, group_id, lower(value) AS token FROM ru WHERE field = 'user-agent'),
ex AS (SELECT DISTINCT origin, bot, group_id FROM ag, bot WHERE token <> '*' AND contains(lower(bot), token)),
us AS (SELECT * FROM ex UNION ALL SELECT DISTINCT a.origin, b.bot, a.group_id FROM ag a, bot b WHERE token = '*' AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.origin = a.origin AND ex.bot = b.bot)),
rp AS (SELECT *, regexp_replace(value, '[$]$', '') AS core, CASE WHEN value LIKE '%$' THEN '$' ELSE '' END AS ends FROM ru WHERE field <> 'user-agent' AND value <> ''),
rx AS (SELECT *, '^' || replace(replace(replace(core, '.', '[.]'), '?', '[?]'), '*', '.*') || ends AS regex, length(replace(core, '*', '')) AS len FROM rp),
pg AS (SELECT page_id, {inputs.ORIGIN} AS origin, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path FROM xp),
mt AS (SELECT p.page_id, u.bot, r.field, r.value, r.len, row_number() OVER (PARTITION BY p.page_id, u.bot, r.field ORDER BY r.len DESC, r.line_no) AS k
       FROM pg p JOIN us u ON u.origin = p.origin JOIN rx r ON r.origin = u.origin AND r.group_id = u.group_id WHERE regexp_matches(p.path, r.regex)),
rulings AS (
    SELECT p.page_id, b.bot,
           coalesce(a.len, -1) >= coalesce(d.len, -1) OR d.len IS NULL AS allowed,
           CASE WHEN NOT EXISTS (SELECT 1 FROM us WHERE us.origin = p.origin AND us.bot = b.bot) THEN 'no matching group'
                WHEN d.len IS NULL THEN 'no matching Disallow' WHEN coalesce(a.len, -1) >= d.len THEN 'Allow: ' || a.value ELSE 'Disallow: ' || d.value END AS rule,
           EXISTS (SELECT 1 FROM ex WHERE ex.origin = p.origin AND ex.bot = b.bot) AS explicit
    FROM pg p JOIN rb ON rb.origin = p.origin CROSS JOIN bot b
    LEFT JOIN mt a ON a.page_id = p.page_id AND a.bot = b.bot AND a.field = 'allow' AND a.k = 1
    LEFT JOIN mt d ON d.page_id = p.page_id AND d.bot = b.bot AND d.field = 'disallow' AND d.k = 1
)"""

ACCESS = rf"""
sb AS (SELECT page_id, count(*) FILTER (NOT allowed) AS shut, string_agg(bot, ',' ORDER BY list_position({_list(BOTS)}, bot)) FILTER (NOT allowed) AS names,
              count(*) FILTER (NOT allowed AND list_contains({_list(NOTABLE_BOTS)}, bot)) AS notable FROM rulings GROUP BY page_id),
ac AS (
    SELECT b.*, sb.shut, sb.names, coalesce(sb.notable, 0) AS notable, coalesce(b.x_robots_tag, '') || ' ' || robots_meta AS said FROM bl b LEFT JOIN sb USING (page_id)
),
dr AS (SELECT *, contains(said, 'noindex') AS noindex, regexp_matches(said, '\bnoai\b') AS noai, contains(said, 'nosnippet') AS nosnippet, contains(said, 'none') AS none_ FROM ac),
d1 AS (
    SELECT *, (CASE WHEN shut IS NULL THEN 16 ELSE floor((17 - shut) / 17.0::DOUBLE * 16 + 0.5) END
               + greatest(0, 6 - CASE WHEN noindex OR none_ THEN 4 ELSE 0 END - CASE WHEN noai OR none_ THEN 1 ELSE 0 END - CASE WHEN nosnippet THEN 1 ELSE 0 END))::INT AS s1
    FROM dr
)"""

LLMS = rf"""
lf AS (
    SELECT origin, status = 200 AND {_trim("body")} <> '' AS present, full_present, body,
           CASE WHEN {_trim("body")} = '' THEN 'empty' WHEN regexp_matches({_trim("body")}, '(?i)^<(!doctype|html|head|body)') THEN 'html'
                WHEN len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^#\s+\S'))) = 0 THEN 'no title'
                WHEN len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '^##\s+\S'))) = 0 AND NOT regexp_matches(body, '\[[^\]]+\]\([^)]+\)') THEN 'no sections or links'
                ELSE 'ok' END AS detail
    FROM ({duck(inputs.LLMS)})
),
ls AS (SELECT origin, present, present AND detail = 'ok' AS well_formed, detail, full_present,
              (CASE WHEN present THEN 5 + CASE WHEN detail = 'ok' THEN 2 ELSE 0 END + CASE WHEN full_present THEN 1 ELSE 0 END ELSE 0 END)::INT AS score FROM lf)"""

SCORES = rf"""
skip AS (
    SELECT *, len(list_filter(range(2, len(levels) + 1), lambda i: levels[i]::INT > levels[i - 1]::INT + 1)) AS skips,
           n_blocks > n_bad AND types <> [] AS has_ld, list_has_any(types, ['Article', 'BlogPosting', 'NewsArticle']) AS ld_article, list_has_any(types, ['Product', 'QAPage', 'FAQPage', 'HowTo', 'Recipe', 'Event']) AS ld_other,
           list_contains(types, 'BreadcrumbList') AS crumbs, list_has_any(types, ['FAQPage', 'HowTo', 'QAPage']) AS faq_schema, list_contains(types, 'HowTo') AS steps,
           list_filter({_list(TIER_A)}, lambda t: list_contains(types, t)) AS tier_a, list_filter({_list(TIER_B)}, lambda t: list_contains(types, t)) AS tier_b,
           (org OR list_contains(article_keys, 'publisher'))::INT + 2 * (person OR list_contains(article_keys, 'author') OR byline)::INT AS who,
           list_has_any(article_keys, ['datePublished', 'dateModified']) OR timed AS dated
    FROM d1
),
sc AS (
    SELECT k.*, 
        (CASE WHEN shell THEN 2 ELSE
            CASE WHEN words >= 600 THEN 10 WHEN words >= 300 THEN 8 WHEN words >= 150 THEN 6 WHEN words >= 60 THEN 3 ELSE 1 END
            + CASE WHEN (main OR article) AND main_words >= 150 THEN 6 WHEN (main OR article) AND main_words > 0 THEN 4 ELSE 2 END
            + CASE WHEN ratio >= 0.15 THEN 6 WHEN ratio >= 0.08 THEN 5 WHEN ratio >= 0.04 THEN 3 WHEN ratio >= 0.02 THEN 2 ELSE 0 END END)::INT AS s2,
        (CASE WHEN types = [] AND micro = [] THEN 0 ELSE CASE WHEN has_ld THEN 6 ELSE 2 END + CASE WHEN ld_article THEN 4 WHEN ld_other THEN 3 ELSE 0 END + least(5, 2 * org::INT + person::INT + 2 * same::INT)
            + 2 * crumbs::INT + list_contains(types, 'WebSite')::INT + 2 * faq_schema::INT + (tier_a <> [] AND tier_b <> [])::INT END)::INT AS s3,
        (CASE WHEN len(list_filter(levels, lambda x: x = '1')) = 1 THEN 3 WHEN list_contains(levels, '1') THEN 1 ELSE 0 END
            + CASE WHEN len(levels) >= 2 THEN CASE WHEN skips = 0 THEN 3 ELSE 1 END ELSE 0 END
            + CASE WHEN length(title) BETWEEN 15 AND 70 THEN 3 WHEN title <> '' THEN 1 ELSE 0 END
            + CASE WHEN main::INT + article::INT + nav::INT + header::INT + footer::INT >= 3 THEN 3 WHEN main OR article OR nav OR header OR footer THEN 2 ELSE 0 END
            + CASE WHEN uls + ols + tables > 0 THEN 2 ELSE 0 END + CASE WHEN words >= 300 THEN 1 ELSE 0 END)::INT AS s4,
        (CASE WHEN description BETWEEN 50 AND 320 THEN 2 WHEN description > 0 THEN 1 ELSE 0 END + 2 * (canonical <> '')::INT + og::INT + twitter::INT + (lang <> '')::INT + who + 2 * dated::INT)::INT AS s5,
        coalesce(ls.score, 0) AS s6, coalesce(ls.present, false) AS here, coalesce(ls.well_formed, false) AS shaped, coalesce(ls.full_present, false) AS whole
    FROM skip k LEFT JOIN ls ON ls.origin = k.site
),
tt AS (SELECT *, least(100, greatest(0, s1 + s2 + s3 + s4 + s5 + s6))::INT AS total FROM sc),
gd AS (SELECT *, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' WHEN total >= 40 THEN 'D' ELSE 'F' END AS grade FROM tt)"""

ANSWERS = r"""
an AS (
    SELECT *, len(list_filter(regexp_extract_all(plain, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1), lambda h: contains(h, '?'))) AS questions,
           len(list_filter(regexp_extract_all(plain, '(?s)</h[1-6]>[ \n]*<p>(.*?)(?:</p>|<p>|<h[1-6]>|</article>|<ol>)', 1),
               lambda p: len(list_filter(string_split(regexp_replace(regexp_replace(p, '<[^>]*>', '', 'g'), '[ \n\t]+', ' ', 'g'), ' '), lambda w: w <> '')) >= 15)) AS paras,
           regexp_matches(visible[1:4000], '(?i)\b(tl;?dr|in short|key takeaways?|summary|at a glance|quick answer)\b') AS tldr
    FROM gd
),
aw AS (SELECT *, (CASE WHEN questions >= 3 THEN 30 WHEN questions = 2 THEN 22 WHEN questions = 1 THEN 12 ELSE 0 END + CASE WHEN tldr THEN 15 ELSE 0 END + 20 * faq_schema::INT + 5 * faq_block::INT
                  + CASE WHEN paras >= 4 THEN 20 WHEN paras >= 2 THEN 13 WHEN paras = 1 THEN 6 ELSE 0 END + CASE WHEN steps THEN 10 WHEN ols > 0 THEN 6 ELSE 0 END)::INT AS answer FROM an)"""

#: Place of the dimension, code, severity (SQL), whether it is good, condition.
FOUND = (
    (0, "robots.absent", "'info'", True, "shut IS NULL"),
    (0, "robots.all_allowed", "'info'", True, "shut = 0"),
    (0, "robots.some_blocked", "CASE WHEN notable > 0 THEN 'high' ELSE 'medium' END", False, "shut > 0"),
    (0, "meta.noindex", "'high'", False, "noindex OR none_"),
    (0, "meta.noai", "'medium'", False, "noai OR none_"),
    (0, "meta.nosnippet", "'low'", False, "nosnippet"),
    (0, "meta.clean", "'info'", True, "NOT (noindex OR noai OR nosnippet OR none_)"),
    (1, "extract.js_only", "'critical'", False, "shell"),
    (1, "extract.thin_content", "CASE WHEN words < 60 THEN 'high' ELSE 'medium' END", False, "NOT shell AND words < 150"),
    (1, "extract.has_text", "'info'", True, "NOT shell AND words >= 150"),
    (1, "extract.main_landmark", "'info'", True, "NOT shell AND (main OR article) AND main_words >= 150"),
    (1, "extract.no_main", "'low'", False, "NOT shell AND NOT ((main OR article) AND main_words > 0)"),
    (1, "extract.low_ratio", "'low'", False, "NOT shell AND ratio < 0.04"),
    (2, "schema.invalid_jsonld", "'medium'", False, "n_bad > 0"),
    (2, "schema.none", "'high'", False, "types = [] AND micro = []"),
    (2, "schema.jsonld_present", "'info'", True, "has_ld"),
    (2, "schema.microdata_only", "'low'", True, "micro <> [] AND NOT has_ld"),
    (2, "schema.content_entity", "'info'", True, "ld_article"),
    (2, "schema.sameas", "'info'", True, "same"),
    (2, "schema.no_sameas", "'low'", False, "NOT same AND (org OR person)"),
    (2, "schema.no_identity", "'medium'", False, "NOT (types = [] AND micro = []) AND NOT same AND NOT org AND NOT person"),
    (2, "schema.breadcrumb", "'info'", True, "crumbs"),
    (2, "schema.answer_friendly", "'info'", True, "faq_schema"),
    (3, "structure.single_h1", "'info'", True, "tops = 1"),
    (3, "structure.no_h1", "'medium'", False, "tops = 0"),
    (3, "structure.multiple_h1", "'low'", False, "tops > 1"),
    (3, "structure.hierarchy_ok", "'info'", True, "len(levels) >= 2 AND skips = 0"),
    (3, "structure.hierarchy_skips", "'low'", False, "len(levels) >= 2 AND skips > 0"),
    (3, "structure.title_length", "'low'", False, "title <> '' AND length(title) NOT BETWEEN 15 AND 70"),
    (3, "structure.no_title", "'high'", False, "title = ''"),
    (3, "structure.no_landmarks", "'medium'", False, "NOT (main OR article OR nav OR header OR footer)"),
    (3, "structure.no_main_landmark", "'low'", False, "(nav OR header OR footer) AND NOT main AND NOT article"),
    (3, "structure.no_lists", "'low'", False, "uls + ols + tables = 0"),
    (4, "meta.no_description", "'medium'", False, "description = 0"),
    (4, "meta.no_canonical", "'low'", False, "canonical = ''"),
    (4, "meta.no_social", "'low'", False, "NOT og AND NOT twitter"),
    (4, "meta.no_lang", "'low'", False, "lang = ''"),
    (4, "meta.no_author", "'medium'", False, "who = 0"),
    (4, "meta.author_present", "'info'", True, "who > 0"),
    (4, "meta.no_date", "'low'", False, "NOT dated"),
    (5, "llms.present", "'info'", True, "here"),
    (5, "llms.well_formed", "'info'", True, "here AND shaped"),
    (5, "llms.malformed", "'low'", False, "here AND NOT shaped"),
    (5, "llms.full_present", "'info'", True, "here AND whole"),
    (5, "llms.absent", "'medium'", False, "NOT here"),
)
FINDINGS = f"""
tp AS (SELECT *, len(list_filter(levels, lambda x: x = '1')) AS tops, [22 - s1, 22 - s2, 20 - s3, 16 - s4, 12 - s5, 8 - s6] AS gaps FROM aw),
fl AS (SELECT page_id, gaps, unnest(list_filter([{", ".join(f"CASE WHEN {c} THEN {{'d': {d}, 'n': {n}, 'code': '{code}', 'severity': {sev}, 'positive': {str(good).lower()}}} END" for n, (d, code, sev, good, c) in enumerate(FOUND))}], lambda x: x IS NOT NULL)) AS f FROM tp),
fs AS (SELECT page_id, f.d AS d, f.n AS n, f.code AS code, f.severity AS severity, f.positive AS positive, {_list(d for d, _ in DIMENSIONS)}[f.d + 1] AS dimension, gaps[f.d + 1]::DOUBLE AS gap,
              CASE f.severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS w FROM fl),
im AS (SELECT *, floor((gap * w / sum(w) OVER (PARTITION BY page_id, d) + 0.01) * 10 + 0.5) / 10 AS impact FROM fs WHERE NOT positive),
fx AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY impact DESC, w DESC, d, n)::INT AS rank FROM im)"""

ROLL = r"""
rows_ AS (SELECT site AS origin, page_id AS ord, url, block, s2 + s3 + s4 + s5 AS portion, s1 AS access, s6 AS llms, total, answer, coalesce(shut, 0) > 0 AS disallowed, noindex OR none_ AS noindexed, block <> 'HARD_BLOCK' AS counted, (url <> site || '/')::INT * 100000000 + page_id AS home_first FROM aw),
roll AS (
    SELECT origin, count(*) AS pages, count(*) FILTER (counted) AS counted, count(*) FILTER (NOT counted) AS inaccessible,
           arg_min(access, home_first) AS access, arg_min(llms, home_first) AS llms, arg_min(url, home_first) AS site_source,
           floor(avg(portion) FILTER (counted) * 10 + 0.5) / 10 AS page_mean, floor(median(portion) FILTER (counted) * 10 + 0.5) / 10 AS page_median,
           floor(stddev_pop(portion) FILTER (counted) * 10 + 0.5) / 10 AS page_stdev, (min(portion) FILTER (counted))::DOUBLE AS page_min, (max(portion) FILTER (counted))::DOUBLE AS page_max,
           floor(avg(answer) FILTER (counted) * 10 + 0.5) / 10 AS answer_mean, floor(median(answer) FILTER (counted) * 10 + 0.5) / 10 AS answer_median,
           (min(answer) FILTER (counted))::DOUBLE AS answer_min, (max(answer) FILTER (counted))::DOUBLE AS answer_max,
           arg_min(url, total::BIGINT * 100000000 + ord) FILTER (counted) AS worst_url, min(total) FILTER (counted) AS worst_total,
           (count(*) FILTER (block = 'HARD_BLOCK'))::INT AS n_hard_blocked, (count(*) FILTER (block = 'SOFT_BLOCK'))::INT AS n_soft_blocked, (count(*) FILTER (disallowed))::INT AS n_robots_disallowed, (count(*) FILTER (noindexed))::INT AS n_noindexed,
           coalesce(string_agg(url, ' ' ORDER BY ord) FILTER (block = 'HARD_BLOCK'), '') AS hard_blocked, coalesce(string_agg(url, ' ' ORDER BY ord) FILTER (block = 'SOFT_BLOCK'), '') AS soft_blocked,
           coalesce(string_agg(url, ' ' ORDER BY ord) FILTER (disallowed), '') AS robots_disallowed, coalesce(string_agg(url, ' ' ORDER BY ord) FILTER (noindexed), '') AS noindexed
    FROM {source} GROUP BY origin
),
site AS (SELECT *, CASE WHEN counted > 0 THEN least(100, greatest(0, floor(access + llms + page_mean + 0.5)))::INT END AS total FROM roll)"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((XP, *parts))


SAFETY = (
    ("https://example.com/{}", "ok"),
    ("http://10.0.0.{}/", "private_ipv4"),
    ("http://172.15.0.1/{}", "ok"),
    ("http://172.31.255.255/{}", "private_ipv4"),
    ("http://2130706433/{}", "private_ipv4"),
    ("http://0x7f.1/{}", "private_ipv4"),
    ("http://0177.0.0.1/{}", "private_ipv4"),
    ("http://134744072/{}", "ok"),
    ("http://LOCALHOST:8080/{}", "internal_hostname"),
    ("http://router/{}", "internal_hostname"),
    ("http://foo.internal/{}", "internal_hostname"),
    ("ftp://example.com/{}", "scheme_not_allowed:ftp"),
    ("not a url {}", "invalid_url"),
    ("http://[::1]/{}", "private_ipv6"),
    ("http://[2001:4860:4860::8888]/{}", "ok"),
    ("http://100.64.0.1/{}", "private_ipv4"),
    ("http://192.0.9.9/{}", "private_ipv4"),
    ("https://user:pw@deep.er.example.com:443/a/{}", "ok"),
)

PAGE = (FEATURES, ROBOTS, ACCESS, LLMS, SCORES, ANSWERS)
SECTIONS = rf"""
cd AS (SELECT DISTINCT {inputs.ORIGIN} AS origin, url, lower(regexp_extract(url, '^https?://[^/?#]+/([^/?#]+)/[^/?#]', 1)) AS first FROM xp WHERE url <> site || '/'),
ct AS (SELECT origin, url, CASE WHEN first = '' THEN 'root' ELSE first END AS section FROM cd),
sz AS (SELECT origin, section, count(*) AS available FROM ct GROUP BY 1, 2),
od AS (SELECT *, sum(least(2, available)) OVER (PARTITION BY origin ORDER BY available DESC, section) AS asked FROM sz)"""

def _discovery(homes: str) -> str:
    """Discovery of every site; homes: condition on xp for the rows that stand for home pages."""
    own = inputs.ORIGIN.replace("url", "{}")
    return rf"""
sm AS (SELECT url, body, regexp_matches(body, '(?i)<sitemapindex[\s>]') AS is_index, list_transform(regexp_extract_all(body, '(?i)<loc>\s*([^<\s][^<]*?)\s*</loc>', 1), lambda x: replace(replace(x, '&lt;', '<'), '&amp;', '&')) AS locs
       FROM ({duck(inputs.SITEMAPS)}) WHERE status = 200 AND {_trim("body")} <> ''),
st AS (SELECT DISTINCT site AS origin FROM xp),
sd AS (SELECT origin, line_no AS ord, value AS url FROM ln WHERE field = 'sitemap'),
se AS (SELECT * FROM sd UNION ALL SELECT origin, 0, origin || '/sitemap.xml' FROM st WHERE origin NOT IN (SELECT origin FROM sd)),
vs AS (
    SELECT origin, url, [ord::BIGINT] AS trail, 0 AS depth FROM se WHERE {own.format("url")} = origin
    UNION ALL
    SELECT v.origin, sm.locs[n + 1], list_append(v.trail, n::BIGINT), v.depth + 1 FROM vs v JOIN sm ON sm.url = v.url AND sm.is_index, unnest(range(len(sm.locs))) t(n)
    WHERE v.depth < 2 AND {own.format("sm.locs[n + 1]")} = v.origin
),
-- A sitemap is read at its first place.
vf AS (SELECT origin, url, min(trail) AS trail FROM vs GROUP BY 1, 2),
lc AS (SELECT v.origin, sm.locs[n + 1] AS url, list_append(v.trail, n::BIGINT) AS trail FROM vf v JOIN sm ON sm.url = v.url AND NOT sm.is_index, unnest(range(len(sm.locs))) t(n)),
mp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY trail) AS place FROM lc WHERE {own.format("url")} = origin) WHERE place <= 2000),
hl AS (SELECT site, regexp_extract_all(plain, '<a href="([^"]*)"', 1) AS l FROM nc WHERE {homes}),
nv AS (SELECT site AS origin, site || l[n + 1] AS url, [n::BIGINT] AS trail FROM hl, unnest(range(least(200, len(l)))) t(n)),
sy AS (
    SELECT origin, CASE WHEN mapped > 0 AND visited > 1 THEN 'sitemap-index' WHEN mapped > 0 THEN 'sitemap' WHEN linked > 0 THEN 'nav-fallback' ELSE 'none' END AS source,
           CASE WHEN mapped > 0 THEN mapped ELSE linked END AS found, robots_found, mapped > 0 AS sitemap_found, 0::BIGINT AS dropped
    FROM (SELECT origin, (SELECT count(*) FROM vf WHERE vf.origin = st.origin) AS visited, (SELECT count(*) FROM mp WHERE mp.origin = st.origin) AS mapped,
                 (SELECT count(*) FROM nv WHERE nv.origin = st.origin) AS linked, origin IN (SELECT origin FROM rb) AS robots_found FROM st)
),
ca AS (
    SELECT origin, url, (row_number() OVER (PARTITION BY origin ORDER BY min(trail)) - 1)::INT AS ord FROM (
        SELECT origin, origin || '/' AS url, [-1::BIGINT] AS trail FROM st
        UNION ALL SELECT mp.origin, mp.url, trail FROM mp JOIN sy ON sy.origin = mp.origin AND source LIKE 'sitemap%'
        UNION ALL SELECT nv.origin, nv.url, trail FROM nv JOIN sy ON sy.origin = nv.origin AND source = 'nav-fallback'
    ) GROUP BY origin, url
)"""


#: The sample of a site: its home page and at most two of each section, 15 in all; and its pages' scores.
SAMPLE = rf"""
cs AS (SELECT origin, url, lower(regexp_extract(url, '^https?://[^/?#]+/+([^/?#]+)/+[^/?#]', 1)) AS first FROM ca WHERE url <> origin || '/'),
cn AS (SELECT origin, url, CASE WHEN first = '' THEN 'root' ELSE first END AS section FROM cs),
sz AS (SELECT origin, section, count(*) AS available FROM cn GROUP BY 1, 2),
od AS (SELECT *, sum(least(2, available)) OVER (PARTITION BY origin ORDER BY available DESC, section) AS asked FROM sz),
rk AS (SELECT *, row_number() OVER (PARTITION BY origin, section ORDER BY url) AS rank FROM cn),
pk AS (SELECT r.origin, r.section, r.url, r.rank FROM rk r JOIN od o USING (origin, section) WHERE r.rank <= least(2, greatest(0, 14 - (o.asked - least(2, o.available))))),
sp AS (SELECT origin, url, row_number() OVER (PARTITION BY origin ORDER BY section, rank) - 1 AS ord FROM (SELECT origin, '' AS section, origin || '/' AS url, 0 AS rank FROM st UNION ALL SELECT * FROM pk)),
ss AS (SELECT sp.origin, sp.ord, sp.url, aw.block, s2 + s3 + s4 + s5 AS portion, s1 AS access, s6 AS llms, aw.total, coalesce(aw.block, 'HARD_BLOCK') <> 'HARD_BLOCK' AS counted, (sp.url <> sp.origin || '/')::INT * 1000 + sp.ord AS home_first FROM sp LEFT JOIN aw ON aw.url = sp.url AND aw.site = sp.origin)"""


def _sampled(rows: str, by: str = "") -> str:
    """A roll-up of sampled rows."""
    return f"""(SELECT *, CASE WHEN counted > 0 THEN least(100, greatest(0, floor(level + page_mean + 0.5)))::INT END AS total FROM (
        SELECT origin{by}, count(*) AS pages, count(*) FILTER (counted) AS counted, count(*) FILTER (NOT counted) AS inaccessible,
               coalesce(arg_min(access, home_first) FILTER (block IS NOT NULL), 0) + coalesce(arg_min(llms, home_first) FILTER (block IS NOT NULL), 0) AS level, floor(avg(portion) FILTER (counted) * 10 + 0.5) / 10 AS page_mean
        FROM {rows} GROUP BY origin{by}))"""


WALK = rf"""WITH RECURSIVE r AS ({duck(inputs.REDIRECTS)}),
        walk AS (
            SELECT url, url AS here, 0 AS hops, NULL::VARCHAR AS outcome FROM r
            UNION ALL
            SELECT w.url, CASE WHEN go THEN location ELSE here END, CASE WHEN go THEN hops + 1 ELSE hops END,
                   CASE WHEN contains(here, '169.254.') THEN 'blocked:private_ipv4' WHEN status IS NULL THEN 'network_error' WHEN NOT moved THEN 'ok' WHEN hops = 5 THEN 'too_many_redirects' END
            FROM (SELECT w.*, r.status, r.location, coalesce(r.status BETWEEN 300 AND 399 AND r.location IS NOT NULL, false) AS moved, coalesce(r.status BETWEEN 300 AND 399 AND r.location IS NOT NULL, false) AND hops < 5 AND NOT contains(here, '169.254.') AS go
                  FROM walk w LEFT JOIN r ON r.url = w.here WHERE w.outcome IS NULL) w
        )"""

#: A page's report in lines, its types and refused crawlers cut short.
LINES = (
    "sm2 AS (SELECT page_id, string_agg('  - [' || severity || '] ' || code || ' +' || printf('%.1f', impact), chr(10) ORDER BY rank) FILTER (rank <= 5) AS five, string_agg('  - [' || severity || '] ' || code || ' +' || printf('%.1f', impact), chr(10) ORDER BY rank) FILTER (rank <= 6) AS six FROM fx GROUP BY 1),\n"
    "sm3 AS (SELECT aw.*, five, six, string_split(coalesce(names, ''), ',') AS refused FROM aw LEFT JOIN sm2 USING (page_id)),\n"
    "sm4 AS (SELECT *, concat_ws(chr(10), 'page ' || url, 'score ' || total || '/100 (' || grade || ')', 'block ' || CASE WHEN block = 'OK' THEN 'OK' ELSE block || ' (' || reason || ')' END,\n"
    "    'answers ' || answer || '/100 (' || CASE WHEN answer >= 85 THEN 'A' WHEN answer >= 70 THEN 'B' WHEN answer >= 55 THEN 'C' WHEN answer >= 40 THEN 'D' ELSE 'F' END || ')',\n    "
    + ", ".join(f"printf('  %-22s %s %d/{m}', '{n}', repeat('#', floor(s{i} / {m}.0::DOUBLE * 20 + 0.5)::INT) || repeat('-', 20 - floor(s{i} / {m}.0::DOUBLE * 20 + 0.5)::INT), s{i})" for i, (n, m) in enumerate(DIMENSIONS, 1))
    + ",\n    'text ' || floor(ratio * 100 + 0.5)::INT || '% of the markup',\n"
    "    CASE WHEN types <> [] THEN 'types ' || array_to_string(types[1:8], ', ') || CASE WHEN len(types) > 8 THEN ', …' ELSE '' END END,\n"
    "    CASE WHEN shut > 0 THEN 'refused ' || array_to_string(refused[1:6], ', ') || CASE WHEN shut > 6 THEN ', …' ELSE '' END END) AS head FROM sm3)"
)

GRADE = "CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' WHEN total >= 40 THEN 'D' WHEN total IS NOT NULL THEN 'F' END"

ORACLES = {
    "discovery_summary": f"{_with(FEATURES, ROBOTS, _discovery('page_id IN (SELECT max(page_id) FROM xp GROUP BY site)'))} SELECT origin, source, found, robots_found, sitemap_found, dropped FROM sy",
    "discovery_candidates": f"{_with(FEATURES, ROBOTS, _discovery('page_id IN (SELECT max(page_id) FROM xp GROUP BY site)'))} SELECT origin, ord, url FROM ca",
    "site_scan": f"""{_with(*PAGE, _discovery("url = site || '/'"), SAMPLE)} SELECT origin, source, found, dropped, pages, counted, inaccessible, total, {GRADE} AS grade FROM {_sampled("ss")} JOIN sy USING (origin)""",
    "tool_scan_site": f"""{_with(*PAGE, _discovery("url = site || '/'"), SAMPLE)},
        tg AS (SELECT site AS origin, site || '/any?x=1' AS target, CASE WHEN min(page_id) % 4 = 0 THEN 15 ELSE greatest(1, floor(min(page_id) % 4 * 3 - 3.5))::INT END AS cap FROM xp GROUP BY site),
        ro AS (SELECT *, {GRADE} AS grade FROM {_sampled("(SELECT ss.*, cap, target FROM ss JOIN tg USING (origin) WHERE ss.ord < cap)", ", target, cap")} JOIN sy USING (origin))
        SELECT target, cap, pages, total, '{{"origin":"' || origin || '",' || CASE WHEN total IS NULL THEN '' ELSE '"total":' || total || ',"grade":"' || grade || '",' END || '"pages":' || pages || ',"source":"' || source || '"}}' AS structured, false AS is_error, 'site ' || origin AS first_line FROM ro
        UNION ALL SELECT * FROM (VALUES
            ('http://10.9.8.7/a', 3, NULL::BIGINT, NULL::INT, '{{"error":"blocked_host","detail":"private_ipv4"}}', true, 'refused: private_ipv4'),
            ('no url', 15, NULL, NULL, '{{"error":"blocked_host","detail":"invalid_url"}}', true, 'refused: invalid_url'),
            ('ftp://example.org/', 15, NULL, NULL, '{{"error":"blocked_host","detail":"scheme_not_allowed:ftp"}}', true, 'refused: scheme_not_allowed:ftp'),
            ('https://unseen.example.org/x', 2, NULL, NULL, '{{"error":"scan_failed","detail":"nothing could be read"}}', true, 'scan failed: nothing could be read'))""",
    "fetched_bodies": f"""{WALK} SELECT w.url, here AS final_url, hops, CASE WHEN outcome <> 'ok' THEN outcome END AS error, CASE WHEN outcome = 'ok' THEN r.status END AS status, CASE WHEN outcome = 'ok' THEN 'body of ' || here END AS body
        FROM walk w LEFT JOIN r ON r.url = here WHERE outcome IS NOT NULL""",
    "tool_errors": f"""{WALK}, e AS (SELECT url, starts_with(outcome, 'blocked:') AS shut, replace(outcome, 'blocked:', '') AS detail FROM walk WHERE outcome <> 'ok')
        SELECT url, CASE WHEN shut THEN 'refused: ' ELSE 'scan failed: ' END || detail AS text, '{{"error":"' || CASE WHEN shut THEN 'blocked_host' ELSE 'scan_failed' END || '","detail":"' || detail || '"}}' AS structured, true AS is_error FROM e""",
    "fetch_profiles": f"""WITH {XP}, l AS (SELECT * FROM (VALUES ('library', 15000), ('service', 9000), ('local_tool', 12000), ('command', 20000)) v(profile, most))
        SELECT profile, count(status) AS answers, count(html) AS bodies, sum(strlen(html))::BIGINT AS bytes FROM xp JOIN l ON page_id * 97 % 23000 <= most GROUP BY profile""",
    "capped_bodies": f"""WITH {XP}, 
        c AS (SELECT url, strlen(html) > 1500 AS cut, html, len(list_filter(range(1, least(1500, length(html)) + 1), lambda i: strlen(html[1:i]) <= 1500)) AS n FROM xp)
        SELECT url, cut, length(rtrim(replace(html[1:n], chr(65533), ''), ' '))::INT AS chars FROM c""",
    "site_summary": f"""{_with(*PAGE, ROLL.replace("{source}", "rows_"))} SELECT origin, concat_ws(chr(10), 'site ' || origin, 'pages ' || pages || ' (at most 15)',
        CASE WHEN total IS NULL THEN 'score n/a: every page was blocked' ELSE 'score ' || total || '/100 (' || {GRADE} || ') of ' || counted || ' pages' END,
        CASE WHEN total IS NOT NULL THEN printf('pages mean %.1f median %.1f stdev %.1f min %.1f max %.1f', page_mean, page_median, page_stdev, page_min, page_max) END,
        'site level access ' || access || '/22 llms ' || llms || '/8', CASE WHEN answer_mean IS NOT NULL THEN printf('answers mean %.1f/100', answer_mean) END, 'inaccessible ' || inaccessible || ' of ' || pages,
        'hard ' || n_hard_blocked || ' soft ' || n_soft_blocked || ' robots ' || n_robots_disallowed || ' noindex ' || n_noindexed,
        CASE WHEN worst_url IS NOT NULL THEN 'worst ' || worst_url || ' ' || worst_total || '/100' END) AS summary FROM site""",
    "page_summary": f"{_with(*PAGE, FINDINGS, LINES)} SELECT page_id, head || chr(10) || coalesce('fixes' || chr(10) || five, 'fixes none') AS summary FROM sm4",
    "console_report": f"""{_with(*PAGE, FINDINGS, LINES)} SELECT page_id, head || chr(10) || coalesce('fixes' || chr(10) || six, 'fixes none')
        || CASE WHEN block <> 'OK' OR shut IS NULL THEN chr(10) || 'notes' ELSE '' END || CASE WHEN block <> 'OK' THEN chr(10) || '  - The score describes what was served: ' || reason ELSE '' END || CASE WHEN shut IS NULL THEN chr(10) || '  - No robots.txt was found.' ELSE '' END AS report FROM sm4""",
    "tool_scan_url": f"""{_with(*PAGE, FINDINGS, LINES)} SELECT page_id, head || chr(10) || coalesce('fixes' || chr(10) || five, 'fixes none') AS text, '{{"url":"' || url || '","total":' || total || ',"grade":"' || grade || '"}}' AS structured, false AS is_error FROM sm4""",
    # Each decision of a day depends on those before it: a walk over the day, the counters of its ips in a map.
    "quota_weighted": f"""WITH RECURSIVE q AS ({duck(inputs.REQUESTS)}), o AS (SELECT event_id, ip, greatest(weight, 1) AS w, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS k FROM q),
        walk AS (
            SELECT event_id, day, k, NULL::VARCHAR AS blocked_by, w AS total, MAP {{ip: w}} AS counts FROM o WHERE k = 1
            UNION ALL
            SELECT event_id, day, k, why, CASE WHEN why IS NULL THEN total + w ELSE total END, CASE WHEN why IS NULL THEN map_concat(counts, MAP {{ip: had + w}}) ELSE counts END
            FROM (SELECT *, CASE WHEN total + w > 1500 THEN 'global' WHEN had + w > 20 THEN 'ip_daily' END AS why
                  FROM (SELECT o.*, x.total, x.counts, coalesce(x.counts[o.ip], 0) AS had FROM walk x JOIN o ON o.day = x.day AND o.k = x.k + 1))
        )
        SELECT event_id, day, blocked_by IS NULL AS allowed, blocked_by FROM walk""",
    "quota_resumed": f"""WITH q AS ({duck(inputs.REQUESTS)}), a AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN ip % 30 = 0 THEN 2 WHEN ip % 3 = 0 THEN 1 ELSE 0 END AS had FROM q), b AS (SELECT *, had + row_number() OVER (PARTITION BY ip, day ORDER BY ts, event_id) AS r FROM a),
        c AS (SELECT *, 150 + coalesce(sum(CASE WHEN r <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
        SELECT event_id, day, NOT (used >= 200 OR r > 2) AS allowed, CASE WHEN used >= 200 THEN 'global' WHEN r > 2 THEN 'ip_daily' END AS blocked_by FROM c""",
    "page_features": f"""{_with(FEATURES)} SELECT page_id, length(html)::INT AS html_length, words::INT AS word_count, main_words::INT AS main_word_count, n_scripts::INT AS script_count, coalesce(script_length, 0)::INT AS script_length,
        title, lang AS html_lang, canonical, main, article, nav, header, footer, uls::INT AS ul_count, ols::INT AS ol_count, tables::INT AS table_count, next_data, empty_root,
        length(visible)::INT AS text_length, floor(ratio * 1000 + 0.5) / 1000 AS text_ratio, len(levels)::INT AS heading_count FROM ft""",
    "block_status": f"{_with(FEATURES)} SELECT page_id, block, status AS http_status, reason FROM bl",
    "heading_levels": f"""{_with(FEATURES)} SELECT page_id, i::INT AS pos, levels[i + 1]::INT AS level, {_text("texts[i + 1]")} AS text, i > 0 AND levels[i + 1]::INT > coalesce(levels[i]::INT, 9) + 1 AS skips
        FROM (SELECT page_id, levels, regexp_extract_all(plain, '(?s)<h[1-6]>(.*?)</h[1-6]>', 1) AS texts FROM ft), unnest(range(len(levels))) t(i)""",
    "url_parts": rf"""{_with()} SELECT page_id, origin, path, CASE WHEN len(segs) < 2 THEN 'root' ELSE lower(segs[1]) END AS section, path = '/' AND NOT regexp_matches(url, '[?#].') AS homepage, origin || '/robots.txt' AS robots_url
        FROM (SELECT page_id, url, {inputs.ORIGIN} AS origin, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/') AS path, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS segs FROM xp)""",
    "robots_rules": f"{_with(ROBOTS)} SELECT origin, group_id, line_no::BIGINT AS line_no, field, value FROM ru",
    "robots_sitemaps": f"{_with(ROBOTS)} SELECT origin, value AS url FROM ln WHERE field = 'sitemap'",
    "robots_rulings": f"{_with(ROBOTS)} SELECT page_id, bot, allowed, rule, explicit FROM rulings",
    "crawler_access": f"{_with(FEATURES, ROBOTS, ACCESS)} SELECT page_id, s1 AS score, (17 - coalesce(shut, 0))::INT AS bots_allowed, coalesce(names, '') AS bots_blocked, noindex, noai, nosnippet, none_ AS \"none\" FROM d1",
    "llms_files": f"{_with(LLMS)} SELECT * FROM ls",
    "dimension_scores": f'{_with(*PAGE)} SELECT page_id, s1 AS "aiCrawlerAccess", s2 AS "contentExtractability", s3 AS "structuredData", s4 AS "semanticStructure", s5 AS "metadataProvenance", s6 AS "llmsTxt", total, grade FROM gd',
    "answer_readiness": f"""{_with(*PAGE)} SELECT page_id, answer AS score, CASE WHEN answer >= 85 THEN 'A' WHEN answer >= 70 THEN 'B' WHEN answer >= 55 THEN 'C' WHEN answer >= 40 THEN 'D' ELSE 'F' END AS grade, questions::INT AS question_headings, paras::INT AS answer_paragraphs,
        faq_schema, faq_block, tldr, steps AS howto_schema, ols::INT AS ordered_lists FROM aw""",
    "grade_histogram": f"{_with(*PAGE)} SELECT grade, count(*) AS pages, min(total) AS least, max(total) AS most FROM gd GROUP BY grade",
    "extracted_content": f"""{_with(*PAGE)} SELECT page_id, least(20000, length(visible))::INT AS text_length, length(visible) > 20000 AS truncated, length(visible)::INT AS original_length, words::INT AS word_count, block <> 'OK' AS blocked, ols::INT AS ordered_lists FROM gd""",
    "jsonld_nodes": f"""{_with(FEATURES)} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY b, k) - 1)::INT AS ord, lower(array_to_string(names, ',')) AS types, array_to_string(json_keys(v), ',') AS keys, json_exists(v, '$.sameAs') AS same_as FROM jn""",
    "schema_types": f"""{_with(FEATURES)} SELECT page_id, array_to_string(types, ',') AS types, array_to_string(list_distinct(micro), ',') AS microdata, len(blocks)::INT AS blocks, n_bad::INT AS invalid,
        array_to_string(list_filter({_list(TIER_A)}, lambda t: list_contains(types, t)), ',') AS tier_a, array_to_string(list_filter({_list(TIER_B)}, lambda t: list_contains(types, t)), ',') AS tier_b, list_has_any(types, {_list(ANSWER_TYPES)}) AS answer_friendly FROM ft""",
    "sitemap_locs": rf"""SELECT url, is_index, i::INT AS ord, replace(replace(replace(replace(replace(replace(trim(l[i + 1]), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', '''') AS loc
        FROM (SELECT url, regexp_matches(body, '(?i)<sitemapindex[\s>]') AS is_index, regexp_extract_all(body, '(?i)<loc>\s*([^<\s][^<]*?)\s*</loc>', 1) AS l FROM ({duck(inputs.SITEMAPS)})), unnest(range(len(l))) t(i)""",
    "section_counts": f"{_with(SECTIONS)} SELECT origin, section, available FROM sz",
    "truncated_sections": f"{_with(SECTIONS)} SELECT origin, section, available FROM od WHERE asked > 4",
    "site_sample": rf"""{_with(SECTIONS)}, rk AS (SELECT *, row_number() OVER (PARTITION BY origin, section ORDER BY url) AS rank FROM ct),
        pk AS (SELECT r.origin, r.section, r.url, r.rank FROM rk r JOIN od o USING (origin, section) WHERE r.rank <= least(2, greatest(0, 4 - (o.asked - least(2, o.available))))),
        al AS (SELECT DISTINCT origin, '' AS section, origin || '/' AS url, 0 AS rank FROM ct UNION ALL SELECT * FROM pk)
        SELECT origin, (row_number() OVER (PARTITION BY origin ORDER BY section, rank) - 1)::INT AS ord, CASE WHEN section = '' THEN 'root' ELSE section END AS section, url FROM al""",
    "site_score": f"""{_with(*PAGE, ROLL.replace("{source}", "rows_"))} SELECT origin, pages, counted, inaccessible, total, CASE WHEN total >= 85 THEN 'A' WHEN total >= 70 THEN 'B' WHEN total >= 55 THEN 'C' WHEN total >= 40 THEN 'D' WHEN total IS NOT NULL THEN 'F' END AS grade,
        CASE WHEN counted = 0 THEN 'every page was blocked' END AS unscorable, (access + llms)::DOUBLE AS site_level, access, llms, site_source, page_mean, page_median, page_stdev, page_min, page_max, answer_mean, answer_median, answer_min, answer_max, n_hard_blocked, n_soft_blocked, n_robots_disallowed, n_noindexed, worst_url, worst_total FROM site""",
    "site_lists": f"""{_with(*PAGE, ROLL.replace("{source}", "rows_"))} SELECT origin, hard_blocked, soft_blocked, robots_disallowed, noindexed FROM site""",
    "site_capped": f"""{_with(*PAGE, ROLL.replace("{source}", "(SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY origin ORDER BY ord) <= 3)"))} SELECT origin, pages, counted, total, page_mean, worst_url FROM site""",
    "redirect_chain": f"{WALK} SELECT url, here AS final_url, hops, outcome FROM walk WHERE outcome IS NOT NULL",
    "dns_check": rf"""WITH {XP}, d AS ({duck(inputs.DNS)}), v AS (SELECT host, arg_min(CASE WHEN regexp_matches(address, '^(10[.]|192[.]168[.]|172[.]16[.])') THEN 'private_ipv4_resolved' END, ord) AS reason FROM d WHERE regexp_matches(address, '^(10[.]|192[.]168[.]|172[.]16[.])') GROUP BY host)
        SELECT url, v.reason IS NULL AS ok, coalesce(v.reason, 'ok') AS reason FROM xp LEFT JOIN v ON v.host = regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)""",
    "rate_minute": f"""WITH q AS ({duck(inputs.REQUESTS)}), m AS (SELECT event_id, row_number() OVER (PARTITION BY ip, route, date_trunc('minute', ts) ORDER BY ts, event_id) AS in_minute FROM q) SELECT event_id, in_minute, in_minute <= 1 AS allowed FROM m""",
    "quota_daily": f"""WITH q AS ({duck(inputs.REQUESTS)}), a AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM q), b AS (SELECT *, row_number() OVER (PARTITION BY ip, day ORDER BY ts, event_id) AS r FROM a),
        c AS (SELECT *, coalesce(sum(CASE WHEN r <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
        SELECT event_id, day, NOT (used >= 200 OR r > 2) AS allowed, CASE WHEN used >= 200 THEN 'global' WHEN r > 2 THEN 'ip_daily' END AS blocked_by FROM c""",
    "findings": f"{_with(*PAGE, FINDINGS)} SELECT page_id, dimension, code, severity, positive FROM fs",
    "fixes_ranked": f"{_with(*PAGE, FINDINGS)} SELECT page_id, rank, code, severity, impact FROM fx",
    "top_fixes": f"{_with(*PAGE, FINDINGS)} SELECT page_id, rank, code FROM fx WHERE rank <= 5",
    "page_report": f"""{_with(*PAGE, FINDINGS)} SELECT page_id, url, site AS origin, block, reason, s1 AS "aiCrawlerAccess", s2 AS "contentExtractability", s3 AS "structuredData", s4 AS "semanticStructure", s5 AS "metadataProvenance", s6 AS "llmsTxt", total, grade, answer AS answers,
        coalesce(k, 0)::INT AS n_fixes, ((block <> 'OK')::INT + (shut IS NULL)::INT)::INT AS n_notes FROM aw LEFT JOIN (SELECT page_id, count(*) AS k FROM fx GROUP BY 1) USING (page_id)""",
    "nav_links": rf"""{_with(FEATURES)}, hr AS (SELECT page_id, site, regexp_extract_all(plain, '<a href="([^"]*)"', 1) AS l FROM ft) SELECT page_id, i::INT AS ord, site || l[i + 1] AS link FROM hr, unnest(range(len(l))) t(i)""",
    # Reasons by the number of the case, written out apart from the rules.
    "ssrf_urls": f"""WITH {XP}, c(k, target, reason) AS (VALUES {", ".join(f"({k}, '{u}', '{r}')" for k, (u, r) in enumerate(SAFETY))})
        SELECT page_id, replace(target, '{{}}', (page_id % 200)::VARCHAR) AS target, reason = 'ok' AS ok, reason FROM xp JOIN c ON page_id % {len(SAFETY)} = k""",
    "admission_outcome": f"""WITH {XP}, v AS (
            SELECT page_id, ['POST', 'POST', 'POST', 'GET', 'OPTIONS', 'POST'][1 + page_id % 6] AS method, ['/scan', '/scan-site', '/health', '/scan', '/other'][1 + (page_id // 2) % 5] AS path,
                   ['https://a.example', NULL, 'https://b.example', 'https://a.example'][1 + (page_id // 3) % 4] AS origin, ['https://a.example/x', 'https://c.example/', ''][1 + (page_id // 5) % 3] AS referer,
                   ['ok', 'blocked_target', 'invalid_json', 'url_required', 'invalid_url_scheme', 'turnstile_required', 'ok'][1 + page_id % 7] AS body, page_id % 4 <> 1 AS human FROM xp)
        SELECT page_id,
               CASE WHEN method = 'OPTIONS' THEN 204 WHEN method = 'GET' AND path = '/health' THEN 200 WHEN path NOT IN ('/scan', '/scan-site') THEN 404 WHEN method <> 'POST' THEN 405
                    WHEN origin = 'https://b.example' OR (origin IS NULL AND referer <> 'https://a.example/x') THEN 403 WHEN body <> 'ok' THEN 400 WHEN NOT human THEN 403 ELSE 200 END AS http_status,
               CASE WHEN method = 'OPTIONS' OR (method = 'GET' AND path = '/health') THEN NULL WHEN path NOT IN ('/scan', '/scan-site') THEN 'not_found' WHEN method <> 'POST' THEN 'method_not_allowed'
                    WHEN origin = 'https://b.example' THEN 'forbidden_origin' WHEN origin IS NULL AND referer <> 'https://a.example/x' THEN 'forbidden_referer' WHEN body <> 'ok' THEN body WHEN NOT human THEN 'turnstile_failed' END AS error
        FROM v""",
    "stream_quota": """SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS ip, count(*) AS n FROM events GROUP BY 1, 2""",
}
