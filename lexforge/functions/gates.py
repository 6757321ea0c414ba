"""Text quality gates as Column expressions. Two families: statistical (reject reasons, flags) and rule-based."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the statistical gates.
MIN_CHARS, MAX_CHARS = 200, 500_000
MIN_DIVERSITY, MAX_BOILERPLATE, MIN_DOMAIN = 0.05, 0.40, 0.02
# Fixed values of the rule-based gates.
MIN_STRIPPED, MAX_GARBAGE, MIN_WORD_DIVERSITY, MIN_WORDS, MAX_PHRASES, PHRASE_CHARS, HEAD = 500, 0.15, 0.10, 20, 0.40, 30, 500
TYPOGRAPHIC = "’‘“”–—…"
# Words that tell the domain, by default.
DOMAIN_WORDS = (
    "plc", "scada", "hmi", "dcs", "opc", "modbus", "profibus", "ethernet/ip",
    "iec 61131", "iec 62443", "iiot", "ot", "ics", "automation", "controller",
    "inverter", "servo", "fieldbus", "historian", "edge computing", "digital twin",
    "predictive maintenance", "condition monitoring", "robotics", "cnc", "fanuc",
    "siemens", "rockwell", "allen-bradley", "beckhoff", "schneider", "abb",
    "manufacturing", "industrial", "factory", "production", "machine learning",
)
# Heads of error and consent pages, by default.
NOISE = (
    r"(?i)404\s*(not found|page not found|error)",
    r"(?i)403\s*forbidden",
    r"(?i)access denied",
    r"(?i)page\s*(not|no longer)\s*(found|available|exists)",
    r"(?i)sign\s*in\s*to\s*(continue|view|access)",
    r"(?i)login\s*required",
    r"(?i)subscription\s*required",
    r"(?i)this\s*video\s*is\s*(un)?available",
    r"(?i)enable\s*javascript",
    r"(?i)browser\s*(is\s*)?(not\s*)?supported",
)
# Phrases of navigation and legal boilerplate, by default.
PHRASES = (
    "cookie policy", "privacy policy", "terms of service",
    "terms of use", "terms and conditions", "accept cookies",
    "subscribe to our newsletter", "sign up for free",
    "all rights reserved", "copyright ©", "powered by",
    "share on facebook", "share on twitter", "share on linkedin",
    "click here to", "read more", "load more", "show more",
    "related articles", "you may also like", "recommended for you",
    "leave a comment", "leave a reply", "post a comment",
)

BLANKS_AROUND = "(?U)^\\s+|\\s+$"
LINES = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def words(text: Column) -> Column:
    """Lower-cased tokens between white space of any script."""
    return F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda w: w != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS_AROUND, "")


def too_short(text: Column, min_chars: int = MIN_CHARS) -> Column:
    return F.length(text) < min_chars


def very_long(text: Column) -> Column:
    """A flag, not a reason to reject."""
    return F.length(text) > MAX_CHARS


def diversity(text: Column) -> Column:
    """Distinct share of the tokens; null without tokens. The tokens are bound to a name, so that they are made once."""
    share = F.transform(F.array(words(text)), lambda w: F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)))
    return F.get(share, F.lit(0))


def boilerplate(text: Column) -> Column:
    """Share of the non-blank lines that are page furniture; null without such lines."""
    lines = F.filter(F.transform(F.split(text, LINES), stripped), lambda x: x != "")

    def furniture(line: Column) -> Column:
        numbers = line.rlike("(?U)^[\\d\\s.\\-–—/\\\\]+$")
        shout = (F.length(line) < 40) & (F.upper(line) == line) & line.rlike("\\p{Lu}") & ~line.rlike("\\p{Ll}")
        page = F.lower(line).rlike("^(page\\s*\\d+|\\d+\\s*of\\s*\\d+)$")
        return numbers | shout | page

    return F.size(F.filter(lines, furniture)) / F.nullif(F.size(lines), F.lit(0))


def domain_share(text: Column, terms: Sequence[str] = DOMAIN_WORDS) -> Column:
    """Share of the terms that the lower-cased text holds as substrings; one hit of fewer than fifty passes."""
    low = F.lower(text)
    return sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0)) / len(terms)


def statistical(text: Column, language: Column, terms: Sequence[str] = DOMAIN_WORDS, languages: Sequence[str] = ("en",), min_chars: int = MIN_CHARS) -> Column:
    """The first gate that fails, null if none does. A null text has no characters."""
    t = F.coalesce(text, F.lit(""))
    return judged(t, language, diversity(t), boilerplate(t), terms, languages, min_chars)


def judged(text: Column, language: Column, diverse: Column, furniture: Column, terms: Sequence[str] = DOMAIN_WORDS, languages: Sequence[str] = ("en",), min_chars: int = MIN_CHARS) -> Column:
    """The same of a text whose diversity and boilerplate are known."""
    t = F.coalesce(text, F.lit(""))
    return F.coalesce(
        F.when(too_short(t, min_chars), F.lit("length")),
        F.when(F.coalesce(diverse, F.lit(0.0)) < MIN_DIVERSITY, F.lit("token_diversity")),
        F.when(F.coalesce(furniture, F.lit(1.0)) > MAX_BOILERPLATE, F.lit("boilerplate")),
        F.when(~language.isin(*languages), F.lit("language")),
        F.when(domain_share(t, terms) < MIN_DOMAIN, F.lit("domain_relevance")),
    )


def garbage(text: Column) -> Column:
    """Share of characters that are neither printable ASCII, usual white space nor typographic."""
    kept = F.length(F.regexp_replace(text, f"[\\x20-\\x7f\\n\\r\\t{TYPOGRAPHIC}]+", ""))
    return kept / F.nullif(F.length(text), F.lit(0))


def phrase_share(text: Column, phrases: Sequence[str] = PHRASES) -> Column:
    """Characters of boilerplate phrases, each counted at a fixed length, over the text's."""
    low = F.lower(text)
    hits = sum(((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p) for p in phrases), F.lit(0.0))
    return hits * PHRASE_CHARS / F.nullif(F.length(text), F.lit(0))


def rule_based(text: Column, noise: Sequence[str] = NOISE, phrases: Sequence[str] = PHRASES) -> Column:
    """The first rule that fails, with its tag, null if none does. All rules see the text without the blanks around it."""
    t = stripped(F.coalesce(text, F.lit("")))
    latin = F.regexp_extract_all(F.lower(t), F.lit("[a-z]{2,}"), F.lit(0))
    head = F.substring(t, 1, HEAD)
    varied = F.size(F.array_distinct(latin)) / F.size(latin)
    return F.coalesce(
        F.when(t == "", F.lit("empty")),
        F.when(F.length(t) < MIN_STRIPPED, F.lit("too_short")),
        *[F.when(head.rlike(p), F.lit(f"noise {i}")) for i, p in enumerate(noise)],
        F.when(garbage(t) > MAX_GARBAGE, F.lit("garbage")),
        F.when((F.size(latin) >= MIN_WORDS) & (varied < MIN_WORD_DIVERSITY), F.lit("low_diversity")),
        F.when(phrase_share(t, phrases) > MAX_PHRASES, F.lit("boilerplate")),
    )


def audited(rows: DataFrame, near: DataFrame) -> DataFrame:
    """(id, failed_gate) of (id, failed), null failures and the ids of ``near`` being near-duplicates: the last gate."""
    flagged = rows.join(near.select("id").withColumn("_near", F.lit(True)), "id", "left")
    last = F.when(F.col("_near"), "near_duplicate").otherwise("pass")
    return flagged.select("id", F.coalesce("failed", last).alias("failed_gate"))


def reset(content: DataFrame, passed: DataFrame) -> DataFrame:
    """Rows that pass again wait for the next gate: no reason, no flags."""
    hit = content.join(passed.select("id").withColumn("_hit", F.lit(True)), "id", "left")
    again = F.coalesce("_hit", F.lit(False))
    new = {
        "screening_status": F.when(again, "pending").otherwise(F.col("screening_status")),
        "screening_reason": F.when(~again, F.col("screening_reason")),
        "do_not_vectorize": F.when(again, False).otherwise(F.col("do_not_vectorize")),
        "marked_for_deletion": F.when(again, False).otherwise(F.col("marked_for_deletion")),
    }
    return hit.withColumns(new).drop("_hit")


def regated(content: DataFrame, text: Column) -> DataFrame:
    """Rows that fail the rules get the gate's state: rejected, told why, no vectors wanted, to be deleted; others are left."""
    failed = rule_based(text)
    bad = F.col("_failed").isNotNull()
    new = {
        "screening_status": F.when(bad, "dq_rejected").otherwise(F.col("screening_status")),
        "screening_reason": F.when(bad, F.concat(F.lit("[quality_gate] "), "_failed")).otherwise(F.col("screening_reason")),
        "do_not_vectorize": F.when(bad, True).otherwise(F.col("do_not_vectorize")),
        "vectorization_status": F.when(bad, "not_applicable").otherwise(F.col("vectorization_status")),
        "marked_for_deletion": bad,
    }
    return content.withColumn("_failed", failed).withColumns(new).drop("_failed")


def decided(content: DataFrame, decision: Column, confidence: Column) -> DataFrame:
    """Apply screening decisions to the state columns; without a decision a row stays as it is."""
    yes, no = decision == "approve", decision == "reject"
    keep = lambda value, name: F.when(no, F.lit(value)).otherwise(F.col(name))
    return content.withColumns(
        {
            "screening_status": F.when(yes, "approved").when(no, "rejected").otherwise(F.col("screening_status")),
            "do_not_vectorize": keep(True, "do_not_vectorize"),
            "vectorization_status": keep("not_applicable", "vectorization_status"),
            "marked_for_deletion": F.coalesce(no, F.lit(False)),
            "confidence": confidence,
        }
    )
