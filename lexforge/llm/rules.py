"""10. Quality rules: a learned decision list, by DataFrame and SQL functions alone.

Statistics of each text come from built-in functions. On labelled rows, sequential covering learns rules one by one: a
rule grows by the threshold condition with the highest gain, over equal-depth cuts of every statistic; it is pruned on
rows kept apart for that, and the rows that it covers are taken out before the next. The list becomes one ordered
CASE expression. Counts cover all labelled rows; what the driver gets are (statistic, cut) counts, of fixed number.

Rows: a null text has no words; texts under three words have no repeated windows; repeated rows are judged each; a table
without labelled rows of both kinds gives an empty list, which keeps what the base rule keeps; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.plans.tables import materialize

SPACE = "[ \\t\\n\\x0B\\f\\r]+"
SYMBOLS = "#*$%&|<>"
#: Cuts of a statistic, conditions in a rule, rules in a list.
CUTS, DEPTH, RULES = 24, 3, 8
#: Least share of bad rows among what a rule covers where it is pruned, and least bad rows that it covers there.
PRECISION, SUPPORT = 0.9, 3
#: What rules look at, from the columns of statistics().
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "bang_rate": "n_bangs / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "digit_rate": "n_digits / greatest(word_chars, 1)",
    "line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "distinct_rate": "n_distinct / greatest(n_words, 1)",
    "length": "cast(n_words as double)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the counts below, all long."""
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = t.select("doc_id", "t", F.filter(F.split("t", SPACE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "").alias("lines"))
    hashed = words.select("*", F.expr("if(size(w) < 3, array(), transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])))").cast("array<bigint>").alias("h"))
    # windows in the order of their hashes, only where some are equal; a window is found again if a neighbour is equal
    ordered = hashed.select("*", F.expr("if(size(array_distinct(h)) = size(h), array(), sort_array(transform(h, (x, i) -> struct(x as h, i as i))))").cast("array<struct<h:bigint,i:int>>").alias("o"))
    places = ordered.select("*", F.expr("sort_array(transform(filter(transform(o, (x, j) -> struct(x.i as i, coalesce((j > 0 and x.h = o[greatest(j - 1, 0)].h) or (j + 1 < size(o) and x.h = o[least(j + 1, size(o) - 1)].h), false) as twice)), x -> x.twice), x -> x.i))").alias("p"))

    def kept(pattern: str) -> Column:
        return F.length(F.regexp_replace("t", f"[^{pattern}]+", "")).cast("long")

    return places.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        kept(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("aggregate(transform(p, (x, j) -> if(j + 1 < size(p), least(3, p[least(j + 1, size(p) - 1)] - x), 3)), 0L, (n, x) -> n + x)").alias("n_repeat_words"),
        kept("!?").alias("n_bangs"),
        kept("A-Z").alias("n_upper"),
        kept("0-9").alias("n_digits"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.above else '<'} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _sql(rule: Rule) -> str:
    return " and ".join(c.sql() for c in rule) or "true"


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Of covering p bad and n good rows instead of p0 and n0."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(labelled: DataFrame, rules: int = RULES, depth: int = DEPTH, cuts: int = CUTS, precision: float = PRECISION, support: int = SUPPORT) -> list[Rule]:
    """Rules that find bad rows, from the columns of statistics() and a boolean ``bad``; one row in three prunes."""
    rows = materialize(labelled.select("bad", (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(10)), F.lit(3)) == 0).alias("prunes"), *[F.expr(f"cast({sql} as double)").alias(f) for f, sql in FEATURES.items()]))
    edges = rows.agg(*[F.percentile_approx(f, [(i + 1) / (cuts + 1) for i in range(cuts)], 10_000).alias(f) for f in FEATURES]).first()
    cut_at = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    if not any(cut_at.values()):
        return []
    # places of the cuts among a row's values: a condition is then a bound on a small number
    binned = rows.select("bad", "prunes", *FEATURES, *[(F.expr("+".join(f"if({f} >= {c!r}D, 1, 0)" for c in cut_at[f])) if cut_at[f] else F.lit(0)).alias(f"bin_{f}") for f in FEATURES])
    binned = materialize(binned.select("bad", "prunes", *FEATURES, F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES]).alias("bins")))
    named = {f: f for f in FEATURES}
    found: list[Rule] = []

    def holds(rule: Rule) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & ((F.col(named[c.feature]) >= c.cut) if c.above else (F.col(named[c.feature]) < c.cut))
        return out

    while len(found) < rules:
        left = binned
        for rule in found:
            left = left.where(~holds(rule))
        rule: Rule = ()
        while len(rule) < depth:
            counts = left.where(~F.col("prunes") & holds(rule)).select("bad", F.explode("bins").alias("x")).groupBy("x.f", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
            by: dict[str, dict[int, tuple[int, int]]] = {}
            for r in counts:
                by.setdefault(r["f"], {})[r["b"]] = (r["p"], r["n"])
            if not by:
                break
            some = next(iter(by.values()))
            p0, n0 = sum(p for p, _ in some.values()), sum(n for _, n in some.values())
            if not p0 or not n0:
                break
            options = []
            for f in sorted(by):
                for at, cut in enumerate(cut_at[f]):
                    p, n = (sum(x[i] for b, x in by[f].items() if b > at) for i in (0, 1))
                    options += [(_gain(p, n, p0, n0), f, True, cut), (_gain(p0 - p, n0 - n, p0, n0), f, False, cut)]
            best = max(options)
            if best[0] <= 1e-9:
                break
            rule = (*rule, Condition(best[1], best[2], best[3]))
        if not rule:
            break
        tests = [rule[: i + 1] for i in range(len(rule))]
        counted = left.where("prunes").agg(*[F.count_if(F.col("bad") & holds(x)).alias(f"p{i}") for i, x in enumerate(tests)], *[F.count_if(~F.col("bad") & holds(x)).alias(f"n{i}") for i, x in enumerate(tests)]).first()
        worth = [((counted[f"p{i}"] - counted[f"n{i}"]) / max(1, counted[f"p{i}"] + counted[f"n{i}"]), counted[f"p{i}"], -i) for i in range(len(tests))]
        value, p, minus = max(worth)
        if p < support or (value + 1) / 2 < precision:
            break
        found.append(tests[-minus])
    return found


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list holds, in its order."""
    return F.expr("case " + " ".join(f"when {_sql(r)} then false" for r in rules) + " else true end") if rules else F.lit(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, the counts, base_failed, kept). Labels are joined to the counts, never to the texts; of several labels of an
    id the lowest counts."""
    stats = materialize(statistics(docs, id_col, text_col))
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg((F.min(label_col) == 0).alias("bad"))
    rules = learn(stats.where(~base_failed()).join(marks, "doc_id"))
    failed = base_failed()
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
