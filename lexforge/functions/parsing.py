"""Parsers of loosely formatted strings: model answers, durations, errors, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The experts that a router may name, in order, and what stands for none.
EXPERTS, SMALL_TALK = ("technical_document_agent", "analytics_agent", "plc_expert"), "direct_reply"

# Words that ask for a chart, words of each metric, words of each grouping in the order of precedence.
CHART_WORDS = (
    "compare", "comparison", "trend", "over time", "chart", "graph", "plot",
    "breakdown", "by site", "each site", "daily", "hourly",
)
METRIC_WORDS = {
    "production_power_w": ("production",),
    "consumption_power_w": ("consumption", "usage", "demand"),
    "grid_power_w": ("grid",),
    "battery_power_w": ("battery power",),
    "battery_soc_pct": ("battery", "soc", "state of charge"),
}
GROUP_WORDS = {
    "hour": ("hourly", "by hour", "hour of day", "time of day"),
    "day": ("daily", "by day", "over time", "trend", "per day"),
    "anomaly_type": ("anomaly type", "by anomaly", "anomaly breakdown"),
    "site": ("site", "each site", "by site", "sites", "location"),
}


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\u0000"), F.lit(""))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^\\p{L}\\p{N}_\\s]", ""))


def file_name(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(title, "[^\\p{L}\\p{N}_\\s-]", ""), "\\s+", "_"), F.lit("_"))


def cache_key(adapter: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lower(F.trim(adapter)), F.lit(":"), F.trim(text)).cast("binary"), 256), 1, 32)


def seconds(duration: Column) -> Column:
    """Of H:M:S, M:S or a number, else null."""
    p = F.split(duration, ":")
    n = lambda i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3)).when(F.size(p) == 2, n(1) * 60 + n(2)).when(F.size(p) == 1, duration.try_cast("double"))


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDD...`` as YYYY-MM-DD."""
    digits = F.regexp_extract(raw, "^D:(\\d{4})(\\d{2})(\\d{2})", 0)
    return F.when(digits != "", F.concat_ws("-", F.substring(raw, 3, 4), F.substring(raw, 7, 2), F.substring(raw, 9, 2)))


def used_context(raw: Column) -> tuple[Column, Column]:
    """(answer, flag) of an answer that ends with a USED_CONTEXT line. Without it: the raw text, and true."""
    bare = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    flag = F.lower(F.regexp_extract(bare, "(?i)USED_CONTEXT:\\s*(true|false)\\s*$", 1))
    answer = F.regexp_replace(F.regexp_replace(bare, "(?i)USED_CONTEXT:\\s*(true|false)\\s*$", ""), "^\\s+|\\s+$", "")
    return F.when((flag == "") | (answer == ""), raw).otherwise(answer), (flag != "false")


def chart_type(raw: Column) -> Column:
    """bar or line of the first CHART line that says yes to one; null for anything else."""
    line = "(?im)^CHART:\\s*(yes|none)\\s*(?:\\|\\s*(bar|line))?\\s*$"
    decision, kind = (F.lower(F.regexp_extract(raw, line, i)) for i in (1, 2))
    return F.when((decision == "yes") & (kind != ""), kind)


def routed(raw: Column, experts: Sequence[str] = EXPERTS) -> Column:
    """The experts that the route line, or else the whole text, names, in order; small talk only alone; by default the first."""
    line = F.regexp_extract(raw, "(?im)^\\s*route:(.*)$", 1)
    said = F.lower(F.when(raw.rlike("(?im)^\\s*route:"), line).otherwise(raw))
    named = F.filter(F.array(*map(F.lit, experts)), lambda e: F.contains(said, e))
    return F.when(F.size(named) > 0, named).when(said.contains(SMALL_TALK), F.array(F.lit(SMALL_TALK))).otherwise(F.array(F.lit(experts[0])))


def error_class(message: Column, kind: Column | None = None, status: Column | None = None) -> Column:
    """By the error's kind, where that says it, with the status of an HTTP error; else by words of the lower-cased message, first
    match; else the kind itself, or "other" without one."""
    m = F.lower(message)
    has = lambda *ws: [m.contains(w) for w in ws]
    rate, limit, quota, timeout, resource, exhausted, json, parse, decode, safety, blocked = has("rate", "limit", "quota", "timeout", "resource", "exhausted", "json", "parse", "decode", "safety", "blocked")
    said = F.when(rate & limit, "rate_limit").when(quota, "quota_exceeded").when(timeout, "timeout").when(resource & exhausted, "quota_exceeded").when(json | parse | decode, "parse_error").when(safety | blocked, "safety_filter").otherwise("other" if kind is None else kind)
    if kind is None:
        return said
    code = F.coalesce(status, F.lit(0)) if status is not None else F.lit(0)
    http = F.when(code == 429, "rate_limit").when(code >= 500, "server_error").otherwise(F.concat(F.lit("http_"), code.cast("string")))
    return F.when(kind == "Timeout", "timeout").when(kind == "ConnectionError", "connection_error").when(kind == "HTTPError", http).otherwise(said)


def ratio_of(message: Column) -> Column:
    """A message's percentage as a share; null without one."""
    return F.nullif(F.regexp_extract(message, "([\\d.]+)%", 1), F.lit("")).try_cast("double") / 100


def value_of(message: Column) -> Column:
    """The number behind a message's first colon that has one; null without."""
    return F.nullif(F.regexp_extract(message, ":\\s*([\\d.]+)", 1), F.lit("")).try_cast("double")


def first_keyword(text: Column, priority: Sequence[str]) -> Column:
    """The first of the keywords that a text holds, as the text writes it; else the text."""
    low = F.lower(text)
    out = text
    for k in reversed(priority):
        out = F.when(low.contains(k), F.substr(text, F.locate(k, low), F.lit(len(k)))).otherwise(out)
    return out


def _any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def chart_intent(question: Column) -> tuple[Column, Column]:
    """(metrics, group) that a question asks to chart, both null if it does not ask. Without a metric: production and
    consumption; without a grouping: by site."""
    low = F.lower(question)
    asks = _any(low, CHART_WORDS)
    named = F.filter(F.array(*[F.when(_any(low, ws), F.lit(m)) for m, ws in METRIC_WORDS.items()]), lambda m: m.isNotNull())
    metrics = F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("production_power_w"), F.lit("consumption_power_w")))
    group = F.coalesce(*[F.when(_any(low, ws), F.lit(g)) for g, ws in GROUP_WORDS.items()], F.lit("site"))
    return F.when(asks, metrics), F.when(asks, group)


def unfenced(raw: Column) -> Column:
    """Without the code fence around it."""
    bare = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    opened = F.when(bare.startswith("```"), F.regexp_replace(bare, "^[^\\n]*\\n", "")).otherwise(bare)
    closed = F.when(opened.endswith("```"), F.regexp_replace(opened, "```$", "")).otherwise(opened)
    return F.regexp_replace(closed, "^\\s+|\\s+$", "")


def recovered_json(raw: Column) -> Column:
    """The JSON object in a model's answer, as a variant: the whole of it, else from the first brace to the place where it
    closes, else up to the last brace; null if none of them is JSON. The second is sought up to four levels deep."""
    text = unfenced(raw)
    level = "[^{}]*"
    for _ in range(3):
        level = f"(?:[^{{}}]|\\{{{level}\\}})*"
    nested = F.regexp_extract(text, f"\\{{{level}\\}}", 0)
    widest = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.coalesce(*[F.try_parse_json(F.when(x != "", x)) for x in (text, nested, widest)])


def parsed_list(raw: Column, expected: Column, item: str) -> Column:
    """An array of ``expected`` structs from a JSON array in a model's answer: a single object is a list of one, what is
    missing or is no JSON is null, what is too much goes."""
    text = F.regexp_replace(F.regexp_replace(raw, "(?m)^\\s*```.*$", ""), "^\\s+|\\s+$", "")
    whole = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    found = F.from_json(F.when(F.try_parse_json(text).isNotNull(), whole), f"array<{item}>")
    return F.transform(F.sequence(F.lit(1), expected), lambda i: F.try_element_at(found, i.cast("int")))


def page_text(raw: Column) -> Column:
    """Of pages: form feeds end lines, no more than three line ends in a row, no NUL."""
    return without_nul(F.regexp_replace(F.replace(raw, F.lit("\f"), F.lit("\n")), "\n{4,}", "\n\n\n"))


def truncated(text: Column, tokens: int, per_token: int = 4) -> Column:
    """What surely fills a model's window: four characters for each of its tokens."""
    return F.substring(text, 1, tokens * per_token)
