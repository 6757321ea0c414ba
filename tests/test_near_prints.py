"""Pairs of near fingerprints: each once, and nothing shuffled for them."""

import random

import pytest
from tests.test_crowds import near, signed

from lexforge.operators import dedup


@pytest.mark.parametrize("distance", [0, 1, 2, 5])
@pytest.mark.parametrize("limits", [(256, 1 << 16, 1 << 20, 1024), (2, 4, 50, 7)])
def test_each_pair_once_without_a_shuffle(spark, monkeypatch, limits, distance):
    """A crowd, near copies of single prints, the largest and smallest numbers; several passes and levels."""
    for name, value in zip(("CROWDED", "DIRECT_PAIRS", "PASS_PRINTS", "SLICE"), limits):
        monkeypatch.setattr(dedup, name, value)
    r = random.Random(distance)
    flips = lambda n: sum({1 << r.randrange(64) for _ in range(n)})
    base = [r.getrandbits(64) for _ in range(40)] + [0x1234567890ABCDEF ^ flips(r.randrange(6)) for _ in range(60)] + [0, 1 << 63, (1 << 64) - 1]
    prints = sorted({signed(b) for b in base} | {signed(b ^ flips(r.randint(1, 6))) for b in base})
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)
    pairs = dedup.banded_pairs(df, distance)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = [(x["a"], x["b"]) for x in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == near(prints, distance)
    assert all(x["distance"] == ((x["a"] ^ x["b"]) & (1 << 64) - 1).bit_count() for x in pairs.collect())
