"""Column functions on text: hashes, token estimates, query tokens, intents, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search ignores.
STOPWORDS = tuple("""
a about above after again against all am an and any are as at be because been before being below between both but by
can did do does doing down during each few for from further had has have having he her here hers herself him himself his how
i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why with you your yours yourself yourselves
""".split())

#: Intents in order of precedence and the words that show them.
INTENTS = (
    ("troubleshooting", "error|failed|failure|exception|crash|fix|debug|issue|cannot|unable|why does|broken|invalid|429|401|403|404|500"),
    ("examples", "example|examples|sample|samples|snippet|snippets|tutorial|how to|quickstart"),
    ("configuration", r"config|configuration|settings|setup|env|\.env|environment|options|flags?|port|credentials|apikey|api_key"),
    ("api", "api|endpoint|endpoints|parameters?|request|response|headers?|payload|schema|rest|graphql|status code"),
    ("implementation", "implement|implementation|build|create|integrate|integration|workflow|handler|webhook|callback|oauth|pipeline"),
    ("conceptual", "architecture|overview|what is|concept|concepts|design|lifecycle|philosophy|background|understand"),
)
#: ASCII word boundaries: Java's own count accented letters as word characters.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Accented letters and their plain ones, place by place.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćčďēęěğīńňōőřśşšťūůűźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccdeeeginnoorssstuuuzzz"


def bounded(pattern: str) -> str:
    return f"(?i){LEFT}(?:{pattern}){RIGHT}"


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def normal_lines(c: Column) -> Column:
    """Unix line ends, no trailing white space on lines, none around the text."""
    unix = F.regexp_replace(c, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(unix, r"(?m)[ \t\f\x0B]+$", ""), r"^\s+|\s+$", "")


def content_hash(c: Column) -> Column:
    return sha256(normal_lines(c))


def short_id(*parts: Column) -> Column:
    """First 16 hexadecimal digits of the parts' hash: the key of every entity."""
    return F.substring(sha256(F.concat_ws(":", *parts)), 1, 16)


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up; null and empty text have none."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("long")


def words(c: Column) -> Column:
    """Runs of word characters and hyphens."""
    return F.array_remove(F.split(F.regexp_replace(c, r"[^A-Za-z0-9_\s-]", " "), r"\s+"), "")


def chunk_tokens(c: Column) -> Column:
    """What a search of chunks asks for: every word, stopwords too."""
    return words(F.trim(c))


def search_tokens(c: Column) -> Column:
    """Words of three and more characters that are no stopwords, else those of two and more."""
    all_words = words(c)
    stop = F.array(*map(F.lit, STOPWORDS))
    good = F.filter(all_words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, F.lower(w)))
    return F.when(F.size(good) > 0, good).otherwise(F.filter(all_words, lambda w: F.length(w) >= 2))


def score_tokens(c: Column) -> Column:
    return F.filter(words(F.lower(F.trim(c))), lambda w: F.length(w) > 2)


def intent(c: Column) -> Column:
    out = F.lit("conceptual")
    for name, pattern in reversed(INTENTS):
        out = F.when(F.lower(c).rlike(bounded(pattern)), name).otherwise(out)
    return out


def terms(c: Column) -> Column:
    """Index terms: lower-case, accents folded, runs of letters and digits."""
    folded = F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.lower(c), ACCENTED, PLAIN))
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)


def unescape_html(c: Column) -> Column:
    """The common entities, ampersands first, so that doubly escaped text opens twice."""
    for seen, meant in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        c = F.replace(c, F.lit(seen), F.lit(meant))
    return c


def slug(c: Column) -> Column:
    plain = F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9_\s-]", "")
    return F.regexp_replace(F.regexp_replace(plain, r"[\s_]+", "-"), r"-{2,}|^-+|-+$", "")


def trimmed_title(c: Column) -> Column:
    """A page title up to the first spaced bar, hyphen or dash."""
    return F.trim(F.regexp_extract(c, r"^(.*?)(?:\s[|\-–—]\s.*)?$", 1))


def version_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?i)(?<![A-Za-z0-9_])(v\d+(?:\.\d+)*)", 1), F.lit(""))


def clipped(c: Column, n: int, mark: str = "\n\n... (truncated)") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def leading_method(c: Column) -> tuple[Column, Column]:
    """(HTTP method, rest) of a query such as `POST /x`."""
    pattern = r"(?i)^\s*(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S.*)$"
    method = F.upper(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")))
    return method, F.when(method.isNotNull(), F.regexp_extract(c, pattern, 2)).otherwise(c)


#: Page types in order, with what shows them in an address and in a title.
PAGE_TYPES = {
    "changelog": ("changelog|releases?|version-history", "changelog|release notes"),
    "faq": ("faq", "faq|frequently asked questions"),
    "troubleshooting": ("troubleshooting|error-codes|error-handling|debugging|errors", "troubleshooting|error codes|error handling|common errors"),
    "webhook": ("webhook|webhooks", "webhooks?"),
    "authentication": ("auth|authentication|oauth|rate-limit|api-key|tokens?|security", "authentication|rate limiting|api keys?|oauth 2|authorization"),
    "schema": ("schemas?|models?|data-models?|types?", "object schema|data model|schema definition"),
    "endpoint": None,  # by the calls that the content shows
    "api_reference": ("api-reference|api-docs?|endpoints?|reference", "api reference|endpoints?"),
    "tutorial": ("tutorials?|getting-started|walkthrough", "tutorial|step-by-step|getting started"),
    "guide": ("guides?|how-to|recipes?", "guide|how to"),
    "concept": ("concepts?|architecture|fundamentals|core-concepts", "concepts?|architecture|overview"),
    "documentation_overview": (None, "overview|introduction|welcome|quickstart"),
}
#: Signs of an endpoint's page, and addresses of an overview.
CALL, VERSIONED_CALL = rf"{LEFT}(?:get|post|put|delete|patch)\s+/", rf"{LEFT}(?:get|post|put|delete|patch)\s+(?:/v\d+|/api)"
CALL_PARTS, CALL_VERBS, OVERVIEW = r"request\s+body|response\s+body|status\s+code\s+200", "create|delete|update|get|list|cancel|parse", r"(?:/docs/?$|/api/docs/?$|/index(?:\.html)?$)"


def page_type(url: Column, title: Column, content: Column, depth: Column) -> Column:
    """Kind of documentation page by address, title and, for endpoints, content."""
    url, title, content = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, title, content))
    has = lambda c, p: c.rlike(bounded(p)) if p else F.lit(False)
    calls = F.regexp_count(content, F.lit(CALL))
    extra = {
        "endpoint": (calls == 1) | ((content.rlike(VERSIONED_CALL) | has(content, CALL_PARTS)) & has(title, CALL_VERBS)), "api_reference": calls > 1,
        "documentation_overview": url.rlike(OVERVIEW) | (depth == 0),
    }
    kind = F.lit("other_documentation")
    for name, signs in reversed(PAGE_TYPES.items()):
        fits = extra.get(name, F.lit(False))
        fits = fits if signs is None else fits | has(url, signs[0]) | has(title, signs[1])
        kind = F.when(fits, F.when(F.contains(url, F.lit("release")), "release_notes").otherwise(name) if name == "changelog" else F.lit(name)).otherwise(kind)
    return kind
