"""Fixed values that results depend on: names, markers, weights and limits."""

from __future__ import annotations

# Crawlers whose access is tracked, in order of report.
BOTS = (
    "GPTBot",
    "OAI-SearchBot",
    "ChatGPT-User",
    "ClaudeBot",
    "Claude-User",
    "anthropic-ai",
    "Google-Extended",
    "PerplexityBot",
    "Perplexity-User",
    "Applebot-Extended",
    "CCBot",
    "Bytespider",
    "Amazonbot",
    "Meta-ExternalAgent",
    "DuckAssistBot",
    "cohere-ai",
    "Diffbot",
)
# Crawlers whose blocking weighs more.
NOTABLE_BOTS = ("GPTBot", "OAI-SearchBot", "ClaudeBot", "PerplexityBot", "Google-Extended")

# Phrases of challenge pages, in order of precedence.
CHALLENGE_MARKERS = (
    "just a moment",
    "checking your browser",
    "cf-browser-verification",
    "cf_chl_",
    "__cf_chl",
    "attention required",
    "cloudflare ray id",
    "please enable javascript and cookies",
    "verifying you are human",
    "captcha-delivery",
    "px-captcha",
    "access denied",
    "request unsuccessful. incapsula",
    "ddos protection by",
)
# Phrases of login and pay walls, in order of precedence.
GATE_MARKERS = (
    "please log in to continue",
    "sign in to continue",
    "subscribe to read",
    "subscribe to continue reading",
    "this content is for subscribers",
    "members only",
    "create a free account to continue",
    "you have reached your article limit",
    "to continue reading, please",
    "paywall",
)
# Statuses that block whatever the body says.
HARD_STATUSES = (401, 403, 407, 429, 451, 503)

# Schema.org types by tier.
TIER_A = (
    "Organization",
    "LocalBusiness",
    "Person",
    "Article",
    "BlogPosting",
    "NewsArticle",
    "FAQPage",
    "HowTo",
    "Product",
    "Offer",
    "AggregateRating",
    "Review",
    "BreadcrumbList",
    "WebSite",
    "WebPage",
    "QAPage",
)
TIER_B = (
    "Event",
    "Recipe",
    "VideoObject",
    "ImageObject",
    "Course",
    "JobPosting",
    "SoftwareApplication",
    "Book",
    "Dataset",
    "SpecialAnnouncement",
    "SpeakableSpecification",
)
ANSWER_TYPES = ("FAQPage", "HowTo", "QAPage")
ARTICLE_TYPES = ("Article", "BlogPosting", "NewsArticle")
OTHER_CONTENT_TYPES = ("Product", "QAPage", "FAQPage", "HowTo", "Recipe", "Event")
ORG_TYPES = ("Organization", "LocalBusiness")

# What counts as white space where text is trimmed or parted.
WHITE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Elements before which text is parted.
BLOCK_TAGS = ("p", "div", "section", "article", "main", "header", "footer", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br")
LANDMARKS = ("main", "article", "nav", "header", "footer")

# Dimensions, their labels and greatest scores, in order.
DIMENSIONS = (
    ("aiCrawlerAccess", 22),
    ("contentExtractability", 22),
    ("structuredData", 20),
    ("semanticStructure", 16),
    ("metadataProvenance", 12),
    ("llmsTxt", 8),
)
# Severities and their weights.
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
# Least score of each grade, best first.
GRADES = ((85, "A"), (70, "B"), (55, "C"), (40, "D"))

# Limits of sampling, discovery, extraction and admission.
MAX_PAGES = 15
MAX_TYPES = 8
MAX_NAMES = 6
PER_SECTION = 2
MAX_SITEMAP_DEPTH = 2
MAX_SITEMAP_URLS = 2000
MAX_NAV_LINKS = 200
MARKER_CHARS = 20_000
CONTENT_CHARS = 20_000
TLDR_CHARS = 4_000
MAX_REDIRECTS = 5
MAX_BODY_BYTES = 3 * 1024 * 1024
MAX_URL_CHARS = 2048
PAGE_PER_MINUTE = 10
SITE_PER_MINUTE = 2
DAILY_PER_IP = 100
DAILY_GLOBAL = 800
COUNTER_HOURS = 26

# Fetch limits by where a scan runs: milliseconds a page may take, bytes of a body that are read (None: all).
PROFILES = {
    "library": {"timeout_ms": 15_000, "body_bytes": None},
    "service": {"timeout_ms": 9_000, "body_bytes": MAX_BODY_BYTES},
    "local_tool": {"timeout_ms": 12_000, "body_bytes": None},
    "command": {"timeout_ms": 20_000, "body_bytes": None},
}

# Host names that never leave the machine or its network.
INTERNAL_HOSTS = ("localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback", "metadata", "metadata.google.internal")
INTERNAL_SUFFIXES = (".local", ".internal", ".localhost", ".home.arpa")
