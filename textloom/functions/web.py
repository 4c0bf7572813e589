"""Column expressions over URLs, markup and guarded text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_edges, trim

# Hosts by kind of referrer.
REFERRERS = (
    ("ai", r"(chatgpt|openai|perplexity|claude|copilot|gemini)\."),
    ("search", r"(google|bing|duckduckgo|yandex|ecosia|brave)\."),
    ("social", r"(reddit|news\.ycombinator|x\.com|twitter|linkedin|facebook|youtube)\."),
)
# What makes markup act, in the order of removal.
ACTIVE = (r"(?is)<script.*?</script>", r"(?is)<iframe.*?</iframe>", r"(?i)\bjavascript:", r"(?i)\bdata:text/html")


def referrer_kind(url: Column, own_host: str) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    out = F.when(host.isNull(), "direct").when(host == own_host, "internal")
    for kind, pattern in REFERRERS:
        out = out.when(host.rlike(pattern), kind)
    return out.otherwise("direct")


def safe_url(c: Column) -> Column:
    """http(s), mailto and tel pass, bare domains get https://, all else is null."""
    t = F.trim(c)
    return F.when(t.rlike("(?i)^(https?://|mailto:|tel:)"), t).when(t.rlike(r"^[\w-]+(\.[\w-]+)+(/\S*)?$"), F.concat(F.lit("https://"), t))


def query_option(query: Column, name: str, kind: str, default, *, least=None, most=None, choices: tuple[str, ...] = ()) -> Column:
    """An option of a query string: numbers clamped, choices and flags by a list; else the default."""
    raw = F.try_url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1), F.lit("")))
    if kind == "number":
        given = value = raw.try_cast("double")
        value = F.greatest(value, F.lit(float(least))) if least is not None else value
        value = F.least(value, F.lit(float(most))) if most is not None else value
        return F.when(given.isNotNull(), value).otherwise(F.lit(float(default)))
    if kind == "bool":
        return F.when(raw.isin("1", "true"), True).when(raw.isin("0", "false"), False).otherwise(default)
    return F.when(raw.isin(*choices), raw).otherwise(default)


def strip_active(c: Column) -> Column:
    """Without scripts, frames and script URLs, trimmed."""
    for pattern in ACTIVE:
        c = F.regexp_replace(c, ascii_edges(pattern), "")
    return trim(c)
