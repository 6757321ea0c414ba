"""Operator 13 against plain Python: sketches, edited texts and likeness."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, odd_docs

from lexforge.llm import queries, sketch


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h


def plain(text):
    """Kept hashes as unsigned numbers, and the fingerprint."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    grams = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    kept = {h for h in map(chained, grams) if 1 << 63 <= h < (1 << 63) + (1 << 62)}
    return kept, "".join(f"{h:016x}" for h in sorted(kept)) or f"={chained(words):016x}"


def near(a, b, contained=False):
    (one, name), (other, other_name) = a, b
    whole = len(one) if contained else len(one | other)
    return len(one & other) / whole if whole else float(name == other_name)


def wanted(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).digest()))
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain(text), plain(edited), plain(after)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a[1], b[1], near(a, b), near(a, c), near(a, b, True), near(a, c, True)))
    return Counter(out)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"]


def found(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_given_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert found(queries.op13_sketch(spark, data)) == wanted(rows)


def test_odd_rows_copies_and_ranges(spark, monkeypatch):
    """Nulls, equal ids with other texts, copies in more than one step, several ranges; one document; none."""
    monkeypatch.setattr(sketch, "COPIES", 3)
    docs = odd_docs(spark)
    more = [(None, "x y z"), (None, "x y z"), (None, "a b c d e f g"), (5, "other text of five or more words"), (2, "  \n\t"), *[(7, ODD[7])] * 8]
    df = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(4)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert found(sketch.edited_and_next(df)) == wanted(rows)
    one = docs.limit(0).unionByName(spark.createDataFrame([(3, "one two three four five six seven eight")], "doc_id long, text string"), allowMissingColumns=True)
    assert found(sketch.edited_and_next(one)) == wanted([(3, "one two three four five six seven eight")])
    assert sketch.edited_and_next(docs.limit(0)).count() == 0


def test_no_python_runs(spark, data):
    plan = queries.op13_sketch(spark, data)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_containment_of_unequal_documents(spark, share):
    """A passage of a text that is twenty times longer; sketches merge to the sketch of both."""
    words = [f"w{i * 7919 % 100_003}" for i in range(20_000)]
    small = words[: int(1000 * share)] + [f"x{i}" for i in range(1000 - int(1000 * share))]
    df = spark.createDataFrame([(" ".join(small), " ".join(words))], "a string, b string")
    a, b = sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))
    r = df.select(sketch.containment(a, b).alias("c"), (sketch.merged(a, b) == sketch.sketch(F.concat_ws(" ", "b", "a"))).alias("m"), F.size(F.array_except(sketch.merged(a, b), sketch.sketch(F.concat_ws(" ", "b", "a")))).alias("lost")).first()
    assert abs(r.c - share) < 0.08 and r.lost == 0
