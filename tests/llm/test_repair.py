"""Operator 12 against plain Python: enumeration of all edits of short conversations, a relaxation for longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexforge.llm import queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WORD.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def price(rows, faults, audit, turns):
    """Cost of an audit that yields these turns' roles, None if it can't."""
    rows, faults, roles, cost = list(rows), list(faults), list(turns), 0
    for letter in audit:
        if letter == "I":
            if not roles or roles.pop(0) not in "ua":
                return None
            cost += 5
            continue
        (role, _), fault = rows.pop(0), faults.pop(0)
        if letter == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate") or not roles:
            return None
        new = roles.pop(0)
        cost += 5 * (fault == "truncated") + (letter == "R")
        if (letter == "K" and role[:1] != new) or (letter == "R" and new not in "ua"):
            return None
    return None if rows or roles else cost


def enumerated(rows):
    """The least (cost, audit) of all audits with up to three insertions."""
    faults, n = faults_of(rows), len(rows)
    best = None
    for inserts in range(4):
        for places in itertools.combinations(range(n + inserts), inserts):
            for letters in itertools.product("KRD", repeat=n):
                rest = iter(letters)
                audit = "".join("I" if i in places else next(rest) for i in range(n + inserts))
                kept = sum(c != "D" for c in audit)
                for turns in [t for t in ("ua" * (kept // 2), "s" + "ua" * ((kept - 1) // 2)) if len(t) == kept and t != "s"]:
                    cost = price(rows, faults, audit, turns)
                    if cost is not None and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def relaxed(rows):
    """The same by states after each row, with insertions relaxed until nothing changes."""
    go = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def grow(table):
        for _ in range(3):
            for (state, role), after in go.items():
                if role != "s" and state in table:
                    cost, audit = table[state]
                    table[after] = min(table.get(after, (10**9, "")), (cost + 5, audit + "I"))
        return table

    table = grow({"": (0, "")})
    for (role, _), fault in zip(rows, faults_of(rows)):
        new = {}
        for state, (cost, audit) in table.items():
            ways = [(2, "D", state)]
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                ways += [(extra, "K", go[state, role[:1]])] if (state, role[:1]) in go else []
                ways += [(extra + 1, "R", go[state, r]) for r in "ua" if (state, r) in go]
            for more, letter, after in ways:
                new[after] = min(new.get(after, (10**9, "")), (cost + more, audit + letter))
        table = grow(new)
    return min(table[s] for s in ("", "a") if s in table)


def played(rows, audit):
    rows, out = list(rows), []
    for letter in audit:
        user_next = not out or out[-1][0][:1] in "sa"
        if letter == "I":
            out.append(("user" if user_next else "assistant", ""))
            continue
        role, text = rows.pop(0)
        if letter == "R":
            role = "user" if user_next else "assistant"
        if letter != "D":
            out.append((role, text))
    return "\n".join(f"{r}:{t}" for r, t in out)


def wanted(table, damage=True):
    """table: (conv_id, turn, role, text)."""
    convs, out = defaultdict(list), Counter()
    for conv, turn, role, text in table:
        rows = convs[conv]
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in rows if t is not None]
        rows = [r[1:] for r in rows]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = Counter(faults_of(rows))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit = relaxed(rows)
        out[conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(played(rows, audit).encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("conv_id", *repair.COUNTS, "audit", "repaired_sha256").collect())


SCHEMA = "conv_id long, turn long, role string, text string, cost string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def some_rows(r, n):
    texts = ["Yes.", "No!", "a b?  \n", "cut", "", " \t\x0b", "Tell me. ", "...", "more words. and"]
    return [(r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "User"]), r.choice(texts)) for _ in range(n)]


def test_agenda_finds_the_least_of_all_audits():
    r = random.Random(3)
    for i in range(120):
        rows = some_rows(r, r.randint(0, 4))
        steps = [repair.row_step(role[:1], fault) for (role, _), fault in zip(rows, faults_of(rows))]
        assert repair.best(repair.lightest(steps, repair.START).items()) == enumerated(rows) == relaxed(rows), (i, rows)


def test_given_conversations(spark, data):
    table = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_repair(spark, data)) == wanted(table)


@pytest.mark.parametrize("block,fan", [(1024, 32), (3, 2)])
def test_long_conversations_in_blocks(spark, monkeypatch, block, fan):
    """One conversation has most rows; blocks and levels give what a single agenda gives."""
    monkeypatch.setattr(repair.solved, "__defaults__", (block, fan))
    r = random.Random(7)
    table = [(r.choice([1, 1, 1, 1, 2, 3, 4, 5]), i // 2 if i % 5 else None, *x) for i, x in enumerate(some_rows(r, 160))]
    assert found(repair.repair(frame(spark, table).repartition(3), damage=repair.damaged)) == wanted(table)


def test_odd_rows(spark):
    table = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (None, None, None, None), (None, 3, "user", "Q?"),
        (2, None, "assistant", "x" * 200_000 + "."), (3, 1, "system", "S."), (3, 7, "user", "A?"), (3, 9, "assistant", "B"), (4, 5, "", "text."), (5, -3, "tool", "é日."), (5, 4, "user", "\u0085."),
    ]
    assert found(repair.repair(frame(spark, table))) == wanted(table, damage=False)
    assert found(repair.repair(frame(spark, table), damage=repair.damaged)) == wanted([*table], damage=True) + Counter({k: 0 for k in ()})
    assert repair.repair(frame(spark, table).limit(0)).count() == 0


def test_conversation_without_rows_left(spark):
    gone = next((c, t) for c in range(1000) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    r = repair.repair(frame(spark, [(*gone, "user", "Hello.")]), damage=repair.damaged).collect()
    assert [tuple(x) for x in r] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
