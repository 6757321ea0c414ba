"""Greedy order over sets of tokens: what is written and verified."""

import random
from pathlib import Path

import pytest
from tests.test_operators import greedy

from lexforge.operators import dedup


def bytes_written(monkeypatch):
    tables = []

    def make(df, write=dedup.materialize):
        tables.append(write(df))
        return tables[-1]

    monkeypatch.setattr(dedup, "materialize", make)
    return lambda: sum(f.stat().st_size for t in tables for f in Path(t._lexforge_path).rglob("*.parquet"))


def test_tokens_are_written_as_numbers_once(spark, monkeypatch):
    """300 sets of 300 long tokens, a third of them near copies: what is written is less than a third of the texts."""
    r = random.Random(1)
    token = lambda: f"{r.getrandbits(160):040x}"
    rows = [(o, [token() for _ in range(300)]) for o in range(200)]
    rows += [(1000 + o, t[: 300 - o] + [token() for _ in range(o)]) for o, (_, t) in enumerate(rows[:50])] + [(2000 + o, t) for o, t in rows[50:100]]
    written = bytes_written(monkeypatch)
    got = {x["ord"] for x in dedup.leaders(spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(4), 0.85).where("keep").collect()}
    assert got == greedy(rows, 0.85)
    assert written() < sum(len(x) for _, t in rows for x in t) / 3


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_crowds_in_cells(spark, monkeypatch, threshold):
    """Near copies of a few sets of every size and sets of common words only, in parts of few pairs, with copies, sets without tokens
    and counters that many tokens share."""
    for name, value in (("CELL_PAIRS", 7), ("CELL_SETS", 20), ("COUNTERS", 64), ("COPIES", 5), ("FEW_EDGES", 30)):
        monkeypatch.setattr(dedup, name, value)
    r = random.Random(int(threshold * 100))
    words = [f"w{i}" for i in range(60)]
    bases = [r.sample(words, n) for n in (1, 2, 5, 12, 20, 40)]
    sets = [[w for w in b if r.random() > 0.08] + r.sample(words, r.randrange(3)) for b in bases for _ in range(14)]
    sets += [r.sample(words[:12], r.randrange(9)) for _ in range(30)] + [[], [], sets[3] * 2, sets[40][::-1]]
    rows = list(zip(r.sample(range(1000), len(sets)), sets, strict=True))
    found = dedup.leaders(spark.createDataFrame([*rows, (5000, None)], "ord long, tokens array<string>").repartition(3), threshold)
    assert {x["ord"] for x in found.where("keep").collect()} == greedy(rows, threshold) | {5000}
