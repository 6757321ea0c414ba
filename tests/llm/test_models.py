"""Operators that learn: base figures exactly, the rest on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, empty_docs, odd_docs

import corpus_pipeline
from lexforge.llm import labelled, mixing, quality, stages, suffix, toxicity
from lexforge.plans.tables import materialize


def test_fold(spark):
    got = {r["id"]: r["f"] for r in spark.range(200).select("id", labelled.fold(F.col("id"), 7).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 for i in range(200)}


def training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 != 2


def check_base(docs, got):
    texts = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    counts = Counter()
    for i, words in texts:
        if training(i):
            counts.update(words)
    n, v = sum(counts.values()), len(counts)
    wanted = {(i, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for i, w in texts}
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got} == wanted


def test_mixing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = mixing.held_out_scores(docs).collect()
    check_base(docs, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_mixing_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "VOCABULARY", 5)  # so that there are rare words
    docs = odd_docs(spark)
    got = mixing.held_out_scores(docs).collect()
    assert len(got) == len(ODD) + 1
    check_base(docs, got)
    assert mixing.held_out_scores(empty_docs(spark)).count() == 0


def small_model():
    words = [b"", b"a", b"b", b"c", b"d"]
    tree = mixing.Tree.of(words, [9, 5, 4, 2, 1], 3)
    rng = np.random.default_rng(1)
    tables = rng.normal(size=(mixing.CONTEXTS, 1 << 8)).astype(np.float32)
    weights = rng.normal(0.3, 0.1, (4 * mixing.DEPTHS, mixing.CONTEXTS + 2))
    return mixing.Model(tree, np.array([9, 5, 4, 2, 1]), 24, 8, tables, weights)


def test_mixing_is_a_distribution():
    """After any tokens, the probabilities of all that may come next (the end and the escape included) sum to one."""
    model = small_model()
    symbols = mixing.Symbols(model.tree)
    for before in ("", "a", "a b", "d rare c a a a", "b " * 2000):
        total = 0.0
        for last in ("", "a", "b", "c", "d", "rare"):
            x, sizes = symbols.of([f"{before} {last}"])
            at = len(before.split())
            total += math.exp(model.token_logs(x, sizes, symbols.escape)[at])
        assert abs(total - 1) < 1e-4


def plain_scores(model, texts, rate):
    """The model's logarithms, token by token and bit by bit."""
    symbols, out = mixing.Symbols(model.tree), []
    for text in texts:
        x, sizes = symbols.of([text])
        first = np.zeros(len(x), bool)
        first[0] = True
        hashes = mixing.context_hashes(x, first, symbols.escape)
        total, correction = 0.0, np.zeros(mixing.CONTEXTS)
        for t in range(len(x)):
            if t % mixing.SEGMENT == 0:
                correction = np.zeros(mixing.CONTEXTS)
            steps, lengths = mixing.events(model.tree, x[t : t + 1])
            change = np.zeros(mixing.CONTEXTS)
            for i in range(lengths[0]):
                node, bit = steps["node"][i : i + 1], int(steps["bit"][i])
                own = [float(model.tables[k][mixing.slots(hashes[k][t : t + 1], np.array([1]), node, 8)[0]]) for k in range(mixing.CONTEXTS)]
                s = [*own, float(steps["odds"][i]), 0.3]
                gate = int(steps["depth"][i]) * 4 + (own[0] != 0) * 2 + (own[1] != 0)
                z = sum(w * v for w, v in zip(model.weights[gate], s)) + sum(correction * own)
                p = 1 / (1 + math.exp(-z if bit else z))
                total += math.log10(p)
                change += rate * (1 - p) * (1 if bit else -1) * np.array(own)
            correction = correction + change
        out.append(total)
    return out


def test_mixing_scores_are_those_of_a_plain_loop():
    model = small_model()
    r = random.Random(5)
    texts = ["", "a", "rare", " ".join(r.choices(["a", "b", "c", "d", "rare"], k=2500))] + [" ".join(r.choices("abcd", k=r.randint(1, 40))) for _ in range(20)]
    got = model.log_odds(texts, mixing.Symbols(model.tree))[4]
    assert np.allclose(got, plain_scores(model, texts, mixing.RATE), rtol=1e-3)


def test_mixing_learns_from_every_training_row(spark, data):
    """Counts of the tables, of those that the weights are fitted on, too."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    counts = mixing.count_tokens(docs)
    words = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(50).collect()]
    tree = mixing.Tree.of([bytes(w) for w in words], list(range(50, 0, -1)), 10)
    found = mixing.context_counts(docs.repartition(5), tree, 18)
    wanted = np.zeros_like(found)
    mixing.count_contexts(wanted, tree, mixing.Symbols(tree), [r["text"] for r in docs.collect()])
    assert (found == wanted).all() and found.any()


def test_mixing_fits_its_weights_on_every_training_row(spark, monkeypatch):
    """Each bit of every row is counted, guessed without itself; weights do not hang on the rows that the start is fitted on."""
    r = random.Random(4)
    words = ["".join(r.choices("abcdefg", k=3)) for _ in range(30)]
    texts = [" ".join(r.choices(words[i % 3 * 10 : i % 3 * 10 + 12], k=r.randint(0, 60))) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts = mixing.count_tokens(docs)
    seen = []
    monkeypatch.setattr(mixing.Model, "fit_cells", lambda self, cells, fit=mixing.Model.fit_cells: seen.append(cells) or fit(self, cells))
    found = []
    for rows in (5, 200):
        monkeypatch.setattr(mixing, "SAMPLE_ROWS", rows)
        found.append(mixing.train(docs, counts))
    assert (seen[0] == seen[1]).all()
    assert np.allclose(found[0].weights, found[1].weights, atol=1e-4)
    tree = found[0].tree
    x, sizes = mixing.Symbols(tree).of(texts)
    assert seen[0].sum() == len(mixing.events(tree, x)[0])
    table = np.zeros((mixing.CONTEXTS, 2 << mixing.LEAST_BITS), np.int32)
    mixing.add_contexts(table, tree, x, sizes)
    wanted = np.zeros(mixing.CELLS, np.int64)
    hashes = mixing.context_hashes(x, mixing.firsts(sizes), len(tree.words))
    for t in range(0, len(x), 37):  # by a plain loop, some tokens
        steps, lengths = mixing.events(tree, x[t : t + 1])
        for i in range(lengths[0]):
            bit, own = int(steps["bit"][i]), []
            for k in range(mixing.CONTEXTS):
                at = 2 * int(mixing.slots(hashes[k][t : t + 1], np.array([1]), steps["node"][i : i + 1], mixing.LEAST_BITS)[0])
                pair = [int(table[k, at + b]) - (b == bit) for b in (0, 1)]
                own.append(int(mixing.level_of(np.array([math.log((pair[1] + mixing.PRIOR) / (pair[0] + mixing.PRIOR))], np.float32))[0]))
            cell = (int(steps["depth"][i]) * mixing.STEPS + int(mixing.level_of(steps["odds"][i : i + 1].astype(np.float32))[0])) * 2 + bit
            for level in own:
                cell = cell * mixing.STEPS + level
            wanted[cell] += 1
    assert (wanted <= seen[0]).all() and wanted.sum() > 100


def test_mixing_nodes_of_a_group_lie_side_by_side():
    """Four steps of a path in a range of 16 slots; each node of the tree with a number and, for a context, a slot of its own in
    its group's range."""
    r = np.random.default_rng(3)
    tree = mixing.Tree.of([b"%d" % i for i in range(3000)], sorted((int(n) for n in r.integers(1, 10**6, 3000)), reverse=True), 7)
    nodes = {}
    for i in range(len(tree.length)):
        path = tree.steps[tree.start[i] : tree.start[i] + tree.length[i]]
        for d, step in enumerate(path):
            assert nodes.setdefault(tuple(path["bit"][:d]), int(step["node"])) == step["node"]
    assert len(nodes) == len(set(nodes.values())) == 3000
    steps, lengths = mixing.events(tree, np.arange(3001))
    for context in r.integers(0, 1 << 32, 20, dtype=np.uint32):
        found = mixing.slots(np.full(3001, context), lengths, np.ascontiguousarray(steps["node"]), 18)
        level = np.arange(len(found)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first = found[np.arange(len(found)) - level % 4]
        assert (found >> 4 == first >> 4).all()
        assert len({(int(n) >> 4, int(f) & 15) for n, f in zip(steps["node"], found)}) == 3000


def test_mixing_codes_each_text_once(spark, monkeypatch):
    """Texts are read to be counted and to be coded; tables, weights and scores come from the symbols of all rows."""
    read = []
    monkeypatch.setattr(mixing, "VOCABULARY", 5)
    monkeypatch.setattr(mixing, "map_arrow", lambda df, *a, each=mixing.map_arrow, **k: read.append(df.columns) or each(df, *a, **k))
    docs = odd_docs(spark)
    got = mixing.held_out_scores(docs).collect()
    assert len(read) == 3 and sum("text" in c for c in read) == 2
    check_base(docs, got)


def test_mixing_of_one_empty_text(spark):
    """The least trees: an end and the escape; nothing but the escape."""
    for ids in ([0], [next(i for i in range(99) if not training(i))]):
        docs = spark.createDataFrame([(i, "") for i in ids], "doc_id long, text string")
        got = mixing.held_out_scores(docs).collect()
        check_base(docs, got)
        assert all(math.isfinite(r["score"]) for r in got)


def auc(good, bad):
    good, bad = np.array(good), np.array(bad)
    return float(np.mean(good[:, None] > bad[None, :]) + 0.5 * np.mean(good[:, None] == bad[None, :]))


BIG = "/root/testdata/sf0.01"


def judged(spark, found, column):
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    return [(r, labels[r["doc_id"]]) for r in found.collect() if r["held_out"] and r["doc_id"] in labels]


def test_toxicity(spark, data):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = judged(spark, toxicity.classify(docs, labels), "toxic")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r, _ in rows)
    assert auc([r["score"] for r, y in rows if y], [r["score"] for r, y in rows if not y]) > 0.8
    caught, there = sum(r["predicted"] for r, y in rows if y), sum(y for _, y in rows)
    assert caught >= 0.7 * there and sum(r["predicted"] for r, y in rows if not y) <= 0.01 * len(rows)


def test_toxicity_voters_are_entries_and_no_labels(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, labelled.fold(F.col("doc_id"), 3) != 1)
    assert len(model.entries) > 10 and set(model.rates) >= {e.decode() for e in model.entries if e.isascii()}
    assert "label" not in model.rates and all(on > off for n, (on, off) in model.rates.items() if n in ("some", "several"))


def test_quality(spark, data):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = judged(spark, quality.classify(docs, labels), "quality")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r, _ in rows)
    assert auc([r["score"] for r, y in rows if y], [r["score"] for r, y in rows if not y]) > 0.95


def test_held_out_labels_are_not_used(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    changed = labels.withColumn("toxic", F.when(labelled.fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(labelled.fold(F.col("doc_id"), 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    for classify in (toxicity.classify, quality.classify):
        assert {tuple(r) for r in classify(docs, labels).collect()} == {tuple(r) for r in classify(docs, changed).collect()}


def test_classifiers_on_odd_rows(spark, data):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(3, 0, 1), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for classify in (toxicity.classify, quality.classify):
        for marks in (labels, labels.limit(0), labels.where("toxic = 1")):
            got = classify(odd_docs(spark), marks).collect()
            assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
        nameless = classify(odd_docs(spark).withColumn("doc_id", F.lit(None).cast("long")), labels).collect()
        assert len(nameless) == len(ODD) + 1 and all(r["held_out"] is False for r in nameless)
        assert classify(empty_docs(spark), labels).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.85, y, ~y) for _ in range(3)]
    weak = np.where(rng.random(4000) < 0.6, y, ~y)
    votes = np.column_stack([*good, weak, weak, weak, weak]).astype(float)
    q, rates = toxicity.label_model(np.column_stack([votes, 1 - votes]), np.column_stack(good).mean(axis=1))
    assert ((q > 0.5) == y).mean() > 0.9
    assert (rates[1][:3] > rates[0][:3] + 0.4).all()


def test_bradley_terry_finds_the_order():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 3))
    w = quality.bradley_terry(x, x @ [2.0, -1.0, 0.0] + rng.normal(size=800) * 0.3 > 0)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]


def test_quality_cut_where_most_are_bad(spark):
    r = random.Random(9)
    texts = [" ".join("".join(r.choices("abcdef", k=5)) + ("" if i % 10 == 0 else "#$%") for _ in range(60)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 10 == 0).cast("int").alias("quality"))
    got = quality.classify(docs, labels).collect()
    assert sum(x["predicted"] == (x["doc_id"] % 10 == 0) for x in got) >= 0.98 * len(got)


def test_stages_on_odd_rows(spark, data):
    """Every stage on nulls, repeats, rows without an id, clashing columns, and no rows."""
    odd = odd_docs(spark).unionByName(odd_docs(spark).withColumn("doc_id", F.lit(None).cast("long")))
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, odd, data), stage(spark, odd.limit(0), data)
        assert none.count() == 0, name
        if name != "packing":
            assert found.columns == odd.columns == none.columns and found.count() <= odd.count(), name


def test_pipeline_stages_by_brute_force(spark, data):
    """Each stage on what the one before it kept."""
    from tests.llm.test_exact import PATH, check_packed, ids_of, removed, tokenizers

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = toxicity.train(docs, labels, labelled.fold(F.col("doc_id"), 3) != 1).scorer()
    clean = materialize(stages.reject_toxic(spark, docs, data))
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in rows.items() if toxic(t) < toxicity.THRESHOLD}
    model = quality.train(clean, labels, labelled.fold(F.col("doc_id"), 5) != 0)
    good = materialize(stages.reject_poor(spark, clean, data))
    rows = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert {r["doc_id"] for r in good.collect()} == {i for i, t in rows.items() if model.scores(quality.features(t)[None])[0] >= quality.THRESHOLD}
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    words = {i: t.encode().lower().split() for i, t in rows.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    own = {i: i for i in rows}
    for i in rows:
        for k in rows:
            if k < i and own[i] != own[k] and (sets[i] == sets[k] or 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k])) > 0):
                low, high = sorted((own[i], own[k]))
                own = {n: low if c == high else c for n, c in own.items()}
    one = materialize(stages.drop_near_duplicates(spark, good, data))
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(own.values()))
    left = {r["doc_id"]: r["text"] for r in one.collect()}
    order = sorted(left)
    wanted = {i: kept for i, (*_, kept) in zip(order, removed(suffix.SPAN, [left[i] for i in order]), strict=True)}
    cut = {r["doc_id"]: r["text"] for r in stages.cut_repeats(spark, one, data).collect()}
    assert cut.keys() == wanted.keys()
    for i, text in cut.items():
        same = wanted[i].decode("utf-8", "ignore")  # without the code points that were cut in half
        assert text == same or len(same) - 4 <= len(text) <= len(same)
    library = tokenizers.Tokenizer.from_file(PATH)
    last = spark.createDataFrame(sorted(cut.items()), "doc_id long, text string")
    check_packed(stages.pack(spark, last, data).collect(), {i: ids_of(library, t) for i, t in cut.items()}, 1024)


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, data)
        assert docs.columns == names, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= {r["doc_id"] for r in before.select("doc_id").collect()} and len(ids) > 0
    text = docs.selectExpr("bool_and(n_chars = length(text)) as same").first()
    assert text["same"]
    packed = corpus_pipeline.run(spark, data)
    assert packed.agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_pipeline_keeps_one_of_each_group(spark, data):
    docs = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    kept = stages.drop_near_duplicates(spark, docs, data).collect()
    ids = sorted(r["doc_id"] for r in kept)
    assert len(ids) == len(set(ids)) and 12 in ids and 13 not in ids and 3 in ids and 4 not in ids
    cut = stages.cut_repeats(spark, docs, data)
    assert cut.columns == docs.columns and cut.count() == docs.count()


def test_pipeline_loses_no_text_beside_the_copies(spark, data):
    """Rows without an id, an id that holds several texts, and code points cut in half beside a real U+FFFD."""
    r = random.Random(8)
    a, b, c, d = (" ".join("".join(r.choices("abcdefghij", k=5)) for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = stages.drop_near_duplicates(spark, docs, data).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in kept) == sorted([(0, a), (0, b), (1, c), (1, d)])
    passage = "".join(r.choices("abcdefghij ", k=2 * suffix.SPAN))
    rows = [(1, "\ufffd one \u00e9" + passage + "\u00e9 1 \ufffd"), (2, "two \u0169" + passage + "\u00e3 2")]  # a byte of each is in common
    cut = {x["doc_id"]: x["text"] for x in stages.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), data).collect()}
    assert cut == {1: "\ufffd one  1 \ufffd", 2: "two  2"}
