"""Crowded segments, long chains of similar titles, and components of every size."""

import random

import pytest
from pyspark.sql import functions as F
from tests.test_operators import components, greedy

from lexforge.operators import dedup, graph


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def near(prints, distance):
    return {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}


def test_prints_of_one_segment_value_join_few_rows(spark):
    """2,000 prints share 21 bits; their pairs are found without joining all with all."""
    r = random.Random(1)
    base = [r.getrandbits(43) << 21 | 0x15555 for _ in range(1900)]
    prints = sorted({signed(b) for b in base} | {signed(b ^ sum({1 << r.randrange(64) for _ in range(r.randint(1, 5))})) for b in base[:100]})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    assert {(x["a"], x["b"]) for x in dedup.banded_pairs(df, 5).collect()} == near(prints, 5)
    assert dedup.candidate_pairs(df, 5).count() < 100_000


@pytest.mark.parametrize("distance", [0, 2, 5])
def test_levels_down_to_the_last_bits(spark, monkeypatch, distance):
    """Prints that differ in few places crowd every segment of every level."""
    monkeypatch.setattr(dedup, "CROWDED", 3)
    r = random.Random(distance)
    prints = sorted({signed(sum({1 << r.randrange(64) for _ in range(r.randint(0, 6))})) for _ in range(150)})
    got = {(x["a"], x["b"]) for x in dedup.banded_pairs(spark.createDataFrame([(p,) for p in prints], "fp long"), distance).collect()}
    assert got == near(prints, distance)


def test_chain_of_titles_takes_few_tables(spark, monkeypatch):
    """Each of 10,000 titles is like the next, and not like the one after that: every second one stays."""
    written = []
    monkeypatch.setattr(dedup, "materialize", lambda df, make=dedup.materialize: written.append(1) or make(df))
    monkeypatch.setattr(graph, "materialize", lambda df, make=graph.materialize: written.append(1) or make(df))
    rows = [(o, [f"w{i}" for i in range(o, o + 10)]) for o in range(10_000)]
    got = {x["ord"] for x in dedup.leaders(spark.createDataFrame(rows, "ord long, tokens array<string>").repartition(4), 0.8).where("keep").collect()}
    assert got == set(range(0, 10_000, 2))
    assert len(written) < 20


@pytest.mark.parametrize("few", [1, 12, 40])
def test_greedy_order_over_components_of_every_size(spark, monkeypatch, few):
    """Rounds, components that one task decides, and larger ones that go on."""
    monkeypatch.setattr(dedup, "FEW_EDGES", few)
    r = random.Random(few)
    rows, o = [], 0
    for length in (1, 2, 3, 8, 20, 60):
        for i in range(length):
            rows.append((o, [f"{length}w{x}" for x in range(i, i + 10)]))
            o += 1
    rows = [(n, t) for n, (_, t) in zip(r.sample(range(1000), len(rows)), rows)]
    got = {x["ord"] for x in dedup.leaders(spark.createDataFrame(rows, "ord long, tokens array<string>"), 0.8).where("keep").collect()}
    assert got == greedy(rows, 0.8)


def test_few_edges_in_one_task(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(500, 500), (None, 3), (-5, -6)]
    df = spark.createDataFrame(edges, "src long, dst long")
    known = [e for e in edges if None not in e]
    got = {x["node"]: x["component"] for x in graph.connected_components(df, few=1000).collect()}
    assert got == components({x for e in known for x in e}, known) == {x["node"]: x["component"] for x in graph.connected_components(df).collect()}
    assert graph.connected_components(df.where(F.lit(False)), few=1000).count() == 0
