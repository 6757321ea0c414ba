"""12. Repair of the turn structure of conversations by Knuth's lightest derivations.

A conversation is in order if its role initials read ``(s?(ua)+)?``. Items of the deduction system are "the steps so far, made into
this state of that pattern"; an item and a fact about the next step (a row kept, given another role or deleted, or a whole block
already solved) derive the next item, an insertion derives another one in place. A derivation's weight is (cost, audit), added and
appended: it never falls from premiss to conclusion, and of two derivations of one item the lighter stays lighter however they
go on (audits of equal cost over the same rows are never each other's beginnings). So the agenda's least item is final when it is
popped, and a goal's first weight is its least.

A conversation of any length is cut into blocks of rows, each solved from every state, and blocks are solved as steps of the same
system, level by level. Texts are read twice: for the faults, and in order by the task that writes the digest.

Rows: a null role or text is one space, a null conversation is one of its own, null turns come first, rows of one turn are in the
order of role and text digest, repeated rows are rows; a role without a first character can only be changed or deleted; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.text import map_arrow
from lexforge.plans.tables import materialize

#: Rows of a block and blocks of a step on the next level.
BLOCK, FAN = 1024, 32
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The states of the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn (which may end it).
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\x0c\r"

#: From a state: the ways through a step as (cost, audit, state after it).
Step = dict[int, list[tuple[int, str, int]]]


def row_step(initial: str, fault: str | None) -> Step:
    """The edits of a row; ``fault`` is blank, duplicate, truncated or None."""
    step: Step = {}
    for state in range(4):
        ways = step[state] = [(DELETE, "D", state)]
        if fault in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in NEXT:
            ways.append((extra, "K", NEXT[state, initial]))
        ways += [(REROLE + extra, "R", NEXT[state, role]) for role in "ua" if (state, role) in NEXT]
    return step


def lightest(steps: list[Step], start: int, inserts: bool = True) -> dict[int, tuple[int, str]]:
    """For each state that can be reached after all steps the least (cost, audit)."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    goals: dict[int, tuple[int, str]] = {}
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(steps):
            goals[state] = (cost, audit)
        else:
            for more, letters, after in steps[at].get(state, ()):
                if (at + 1, after) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, at + 1, after))
        if inserts:
            for role in "ua":
                after = NEXT.get((state, role))
                if after is not None and (at, after) not in final:
                    heapq.heappush(agenda, (cost + INSERT, audit + "I", at, after))
    return goals


def best(goals: Iterable[tuple[int, tuple[int, str]]]) -> tuple[int, str]:
    """The least weight of a whole conversation's goals: nothing is left, or it ends with the assistant."""
    return min(weight for state, weight in goals if state in (START, ASSISTANT))


class Replay:
    """Plays an audit over the rows it belongs to; ``digest`` is of the repaired turns so far."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.turns = audit, 0, START, hashlib.sha256(), 0

    def _emit(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.turns else "") + f"{role}:{text}").encode())
        self.turns += 1

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = ASSISTANT if self.state == USER else USER
            self._emit(NAMES[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "K":
            self.state = NEXT[self.state, role[:1]]
        else:
            self.state = ASSISTANT if self.state == USER else USER
            role = NAMES[self.state]
        self._emit(role, text)


def keyed(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): the conversation's number as a string, empty for none."""
    space = F.lit(" ")
    return conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Of each row, by the crc32 of its place: none, without text, without ends of sentences, two, as a user's, or itself."""
    place = F.concat_ws(":", F.when(F.col("conv") == "", " ").otherwise(F.col("conv")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_")).drop("_")


def in_order(rows: DataFrame) -> DataFrame:
    """A written table of all rows in order, numbered by ``at``, with the block that a row is in (dense over the table, so that no
    block is longer than it may be and neighbours follow each other) and its faults. Ranges are cut through a conversation, or
    a group of equal rows, of any size."""
    stripped = F.rtrim("text", F.lit(BLANKS))
    noted = rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).withColumn("blank", stripped == "").withColumn("cut", ~F.substring(stripped, -1, 1).isin(".", "!", "?"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = noted.withColumn("any", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, "any").sortWithinPartitions(*order, "any")
    written = materialize(ranged.drop("any").withColumn("part", F.spark_partition_id()).withColumn("number", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    # as many rows as there were partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return written.join(F.broadcast(starts), "part").withColumn("at", F.col("start") + F.col("number")).drop("part", "number", "start")


SPAN = "blank long, duplicate long, truncated long, illegal long, first string, last string, spans array<struct<start: int, after: int, cost: long, audit: string>>"
SPAN_TYPES = {
    "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "first": pa.string(), "last": pa.string(),
    "spans": pa.list_(pa.struct([("start", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}


def _solved(steps: list[Step], inserts: bool) -> list[dict]:
    return [{"start": start, "after": after, "cost": cost, "audit": audit} for start in range(4) for after, (cost, audit) in lightest(steps, start, inserts).items()]


def _solve_rows(rows: list[dict]) -> dict:
    """A block's rows in order: its counts, its ends, and the least way from each state to each."""
    faults = ["blank" if r["blank"] else "duplicate" if r["seen"] else "truncated" if r["cut"] else None for r in rows]
    initials = [r["initial"] for r in rows]
    counts = {name: faults.count(name) for name in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return counts | {"illegal": illegal, "first": initials[0], "last": initials[-1], "spans": _solved([row_step(i, f) for i, f in zip(initials, faults, strict=True)], True)}


def _solve_blocks(blocks: list[dict]) -> dict:
    """Blocks in order as one."""
    steps: list[Step] = []
    for b in blocks:
        step: Step = {}
        for s in b["spans"]:
            step.setdefault(s["start"], []).append((s["cost"], s["audit"], s["after"]))
        steps.append(step)
    borders = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:], strict=False))
    sums = {name: sum(b[name] for b in blocks) for name in ("blank", "duplicate", "truncated", "illegal")}
    return sums | {"illegal": sums["illegal"] + borders, "first": blocks[0]["first"], "last": blocks[-1]["last"], "spans": _solved(steps, False)}


def _each_group(groups: DataFrame, solve: Callable[[list[dict]], dict]) -> DataFrame:
    """``solve`` over the sorted lists of (conv, block, rows)."""

    def make() -> Callable:
        def each(batch: pa.RecordBatch) -> dict:
            lists = batch.column(batch.schema.get_field_index("rows"))
            found = [solve(lists[r].as_py()) for r in range(batch.num_rows)]
            kept = {n: batch.column(batch.schema.get_field_index(n)) for n in ("conv", "block")}
            return kept | {n: pa.array([f[n] for f in found], kind) for n, kind in SPAN_TYPES.items()}

        return each

    return map_arrow(groups.select("conv", "block", "rows"), make, f"conv string, block long, {SPAN}", rows=64)


def solved(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(conv, counts, cost, audit) of every conversation in ``in_order``'s table."""
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(False).alias("seen"))
    light = rows.select("conv", "at", F.substring("role", 1, 1).alias("initial"), "blank", "cut").join(firsts, "at", "left").withColumn("seen", F.coalesce("seen", F.lit(True)))
    fields = F.struct("at", "initial", "blank", "cut", "seen")
    groups = light.groupBy("conv", F.floor(F.col("at") / block).alias("block")).agg(F.array_sort(F.collect_list(fields)).alias("rows"))
    spans = materialize(_each_group(groups, _solve_rows))
    begins = spans.groupBy("conv").agg(F.min("block").alias("begin"), F.max("block").alias("end"))
    longest = begins.agg(F.max(F.col("end") - F.col("begin"))).first()[0] or 0
    if longest:
        spans = spans.join(begins, "conv").withColumn("block", F.col("block") - F.col("begin")).drop("begin", "end")
    while longest:
        fields = F.struct("block", *SPAN_TYPES)
        groups = spans.groupBy("conv", F.floor(F.col("block") / fan).alias("up")).agg(F.array_sort(F.collect_list(fields)).alias("rows")).withColumnRenamed("up", "block")
        spans, longest = materialize(_each_group(groups, _solve_blocks)), longest // fan
    ends = F.filter("spans", lambda s: (s["start"] == START) & s["after"].isin(START, ASSISTANT))
    least = F.array_min(F.transform(ends, lambda s: F.struct(s["cost"].alias("cost"), s["audit"].alias("audit"))))
    return spans.select("conv", "blank", "duplicate", "truncated", "illegal", least.alias("least")).select("*", "least.*").drop("least")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repaired(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, the counts, cost, audit, repaired_sha256) of every conversation of ``convs``; ``rows`` as in ``in_order``. A
    conversation's texts pass its task one by one, behind its audit: a digest takes them in order."""
    turns = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = convs.join(solved(rows), "conv", "left").join(turns, "conv", "left")
    found = found.select("conv", F.coalesce("audit", F.lit("")).alias("audit"), *[F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in COUNTS])
    found = materialize(found)
    none = F.lit(None)
    heads = found.select("conv", F.lit(-1).cast("long").alias("at"), none.cast("string").alias("role"), none.cast("string").alias("text"), "audit", *COUNTS)
    tails = found.select("conv", F.lit((1 << 63) - 1).alias("at"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("audit"), *[none.cast("long").alias(n) for n in COUNTS])
    body = rows.select("conv", "at", "role", "text", none.cast("string").alias("audit"), *[none.cast("long").alias(n) for n in COUNTS])
    stream = heads.unionByName(body).unionByName(tails).repartition("conv").sortWithinPartitions("conv", "at")

    def make() -> Callable:
        now: dict = {}

        def each(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in ("conv", *COUNTS, "audit", "repaired_sha256")}
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("conv", "at", "role", "text", "audit", *COUNTS)}
            for r in range(batch.num_rows):
                at = column["at"][r].as_py()
                if at < 0:
                    now["play"] = Replay(column["audit"][r].as_py())
                    now["counts"] = [column[n][r].as_py() for n in COUNTS]
                elif column["role"][r].is_valid:
                    now["play"].row(column["role"][r].as_py(), column["text"][r].as_py())
                else:
                    now["play"].inserts()
                    values = [column["conv"][r].as_py(), *now["counts"], now["play"].audit, now["play"].digest.hexdigest()]
                    for n, v in zip(out, values, strict=True):
                        out[n].append(v)
            kinds = {n: pa.int64() for n in COUNTS}
            return {n: pa.array(x, kinds.get(n, pa.string())) for n, x in out.items()}

        return each

    done = map_arrow(stream, make, f"conv string, {', '.join(f'{n} long' for n in COUNTS)}, audit string, repaired_sha256 string")
    return done.select(F.nullif(F.col("conv"), F.lit("")).cast("long").alias("conv_id"), *COUNTS, "audit", "repaired_sha256")


def repair(conversations: DataFrame, damage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every conversation's faults and its cheapest repair; ``damage`` is applied to the rows first, for trials."""
    rows = keyed(conversations)
    convs = rows.select("conv").distinct()
    return repaired(convs, in_order(damage(rows) if damage else rows))
