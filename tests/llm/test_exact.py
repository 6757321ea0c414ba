"""Operators with exact results, against brute force."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, empty_docs, odd_docs, random_texts, texts_df

from lexforge.llm import bpe, packing, queries, rules, sharding, similar, simhash, suffix, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_words_and_joins(library):
    r = random.Random(1)
    vocab = bpe.Vocabulary(PATH)
    alphabet = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "!", "?!", "1", "23", "é", "日本", " ", "　", "<|endoftext|>", "<|end", "🙂", "\r\n", "l", "'", "aaaa", "\x1c", "\x85"]
    for i in range(1500):
        some = r.choices(alphabet, k=r.randint(1, 4)) if i % 2 else alphabet
        text = "".join(r.choices(some, k=r.randint(0, 400)))
        wanted = ids_of(library, text)
        assert np.frombuffer(vocab.encode(text), "<u4").tolist() == wanted
        cut = r.randint(0, len(text))
        assert np.frombuffer(vocab.join(vocab.encode(text[:cut]), vocab.encode(text[cut:])), "<u4").tolist() == wanted
        assert vocab.decode(np.array(wanted, "<u4").tobytes()).decode() == text


@pytest.mark.parametrize("leaf", [50, 100_000])
def test_bpe_round_trip(spark, library, leaf):
    docs = odd_docs(spark)
    for r in bpe.digests(docs, PATH, leaf_chars=leaf).collect():
        ids = ids_of(library, ODD[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, PATH, leaf_chars=leaf), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    assert bpe.encode(docs, PATH).count() == len(ODD) + 1
    assert bpe.digests(empty_docs(spark), PATH).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [200, 1])
def test_simhash(spark, data, hot):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    wanted = grouped(prints)
    for r in simhash.near_duplicates(spark.read.parquet(f"{data}/documents.parquet"), hot=hot).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == wanted[r["doc_id"]]


def test_simhash_links_of_crowded_segments(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(3)]
    prints = list({b ^ sum({1 << r.randrange(64) for _ in range(r.randint(0, 5))}) for b in base for _ in range(150)})
    wanted = grouped(dict(enumerate(prints)))
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    place = {p: i for i, p in enumerate(signed)}
    for hot in (5, 10_000):
        edges = [(place[x["src"]], place[x["dst"]]) for x in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot).collect()]
        root = {i: i for i in range(len(prints))}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            assert (prints[a] ^ prints[b]).bit_count() <= 2
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        assert {i: find(i) for i in root} == wanted


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(got) == len(ODD) + 1
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[3] == by[4] == 3 and by[12] == by[13] == 12
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0


def test_similar_texts(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(900)]
    base = [r.choices(words, k=200) for _ in range(20)]
    texts = []
    for b in base:
        near = list(b)
        near[r.randrange(200)] = "edited"
        texts += [" ".join(b), " ".join(b), " ".join(near)]
    for hot in (200, 2):
        by = {x["doc_id"]: x["component_id"] for x in similar.similar_texts(texts_df(spark, texts), hot=hot).collect()}
        assert all(by[i] == i - i % 3 for i in by)
    assert similar.similar_texts(odd_docs(spark)).count() == len(ODD) + 1
    assert similar.similar_texts(empty_docs(spark)).count() == 0


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def components(texts):
    """By brute force: the smallest index that links of 0.8 reach."""
    own = list(range(len(texts)))
    for i in range(len(texts)):
        for k in range(i):
            if own[i] != own[k] and jaccard(texts[i], texts[k]) >= 0.8:
                low, high = sorted((own[i], own[k]))
                own = [low if x == high else x for x in own]
    return own


def test_similar_texts_are_verified(spark):
    """Paragraphs appended, cut and replaced at 0.8 or more are found; scattered edits at 0.6 to 0.75 stay apart."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    texts, kinds = [], []
    for i in range(60):
        b = r.choices(words, k=200)
        if i % 2:
            near = list(b)
            for at in range(3, 200, r.choice([28, 33])):  # far from one another: each breaks five shingles
                near[at] = "edited"
        else:
            near = [b + r.choices(words, k=44), b[:165], b[:90] + r.choices(words, k=16) + b[106:]][i // 2 % 3]
        texts += [" ".join(b), " ".join(near)]
        kinds.append(jaccard(*texts[-2:]))
    assert all(0.6 < j < 0.76 for j in kinds[1::2]) and all(0.8 <= j < 0.86 for j in kinds[::2])
    by = {x["doc_id"]: x["component_id"] for x in similar.similar_texts(texts_df(spark, texts)).collect()}
    assert [by[i] for i in range(len(texts))] == components(texts)


@pytest.mark.parametrize("hot", [16, 2])
def test_similar_texts_of_a_crowded_family(spark, hot):
    """Texts about 0.7 alike, some with a near copy: no copy is lost and no other text goes."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    base, texts = r.choices(words, k=300), []
    for i in range(120):
        t = list(base)
        for at in r.sample(range(5, 295, 10), 5):
            t[at] = r.choice(words)
        texts.append(" ".join(t))
        if i % 3 == 0:
            t[r.randrange(300)] = "copied"
            texts.append(" ".join(t))
    wanted = components(texts)
    assert 20 < len(texts) - len(set(wanted)) < len(texts) - 20
    by = {x["doc_id"]: x["component_id"] for x in similar.similar_texts(texts_df(spark, texts), hot=hot).collect()}
    assert [by[i] for i in range(len(texts))] == wanted


def test_similar_texts_of_the_given_documents(spark, data):
    """All links of whole documents, by brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"].encode().lower().decode("utf-8", "replace")) for r in docs.collect())
    sets = {}
    for i, t in rows:
        w = t.encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    own = {i: i for i, _ in rows}
    for i in own:
        for k in own:
            if k < i and own[i] != own[k] and (sets[i] == sets[k] or 9 * len(sets[i] & sets[k]) >= 4 * (len(sets[i]) + len(sets[k])) > 0):
                low, high = sorted((own[i], own[k]))
                own = {n: low if c == high else c for n, c in own.items()}
    assert {x["doc_id"]: x["component_id"] for x in similar.similar_texts(docs).collect()} == own


def test_sketches_never_differ_in_more_than_their_sets():
    rng = np.random.default_rng(3)
    for n in (1, 10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, n // 5 + 1, dtype=np.uint64)]))
        differ = sum(int(x).bit_count() for x in similar.sketch(a) ^ similar.sketch(b))
        assert differ <= len(np.setxor1d(a, b))


def check_packed(got, ids, window):
    pieces, sequences = {}, {}
    for r in got:
        own = np.array(ids[r["doc_id"]] + [0], "<u4")
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end == window or end & (end - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    return pieces


def test_packing(spark, library, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ids = {r["doc_id"]: ids_of(library, r["text"]) for r in docs.collect()}
    pieces = check_packed(packing.pack(docs, PATH).collect(), ids, 1024)
    for doc, found in pieces.items():
        end = 0
        for start, length in sorted(found):
            assert start == end
            end += length
        assert end == len(ids[doc]) + 1
    assert set(pieces) == set(ids)


def test_packing_odd_rows(spark, library):
    got = packing.pack(odd_docs(spark), PATH, window=64).collect()
    check_packed(got, {i: ids_of(library, t) for i, t in enumerate(ODD)}, 64)
    assert sum(r["length"] for r in got) == sum(len(ids_of(library, t)) + 1 for t in [*ODD, ODD[-1]])
    assert packing.pack(empty_docs(spark), PATH).count() == 0


def test_rows_without_an_id(spark, library):
    """Are rows like any other, each for itself."""
    texts = ["one two", "one two", None, "three " * 3000]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    wanted = sorted(len(ids_of(library, t)) for t in texts)
    for leaf in (50, 100_000):
        found = bpe.digests(docs, PATH, leaf_chars=leaf).collect()
        assert sorted(r["n_tokens"] for r in found) == wanted and all(r["doc_id"] is None for r in found)
    pieces = packing.pack(docs, PATH).collect()
    assert sum(r["length"] for r in pieces) == sum(wanted) + len(texts)


def test_packing_plan_never_overdraws():
    rng = np.random.default_rng(1)
    histogram = np.zeros(1025, np.int64)
    histogram[rng.integers(1, 1024, 300)] = rng.integers(1, 50, 300)
    taken, left = packing.plan(histogram)
    used = np.zeros_like(histogram)
    for combo, n in taken:
        assert sum(combo) == 1024 and n > 0
        for length in combo:
            used[length] += n
    assert (used + left == histogram).all() and (left >= 0).all() and left.sum() < histogram.sum() / 2


def test_sharding(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(odd_docs(spark), allowMissingColumns=True)
    got = sharding.shard(docs, 16).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)
    slots, by_key = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        by_key.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in by_key.values())
    assert sharding.shard(empty_docs(spark)).count() == 0


def test_weighted_sharding(spark):
    keys = spark.range(20_000).select(sharding.shard_of(F.col("id"), [1.0, 3.0]).alias("s"))
    share = keys.where("s = 1").count() / 20_000
    assert abs(share - 0.75) < 0.02


def removed(span, texts):
    raw, seen = [(t or "").encode() for t in texts], {}
    for d, b in enumerate(raw):
        for p in range(len(b) - span + 1):
            seen.setdefault(b[p : p + span], []).append((d, p))
    gone = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + span] = b"\1" * span
    return [(len(b), sum(g), sum(1 for i in range(len(b)) if g[i] and not (i and g[i - 1])), bytes(x for x, y in zip(b, g, strict=True) if not y)) for b, g in zip(raw, gone, strict=True)]


@pytest.mark.parametrize("span", [40, 200])
def test_suffix(spark, monkeypatch, span):
    monkeypatch.setattr(suffix, "SORTED", 5000)
    texts = random_texts(100, 3) + ["", None, "a" * 500, "ab" * 300, "é" * 100]
    texts += texts[:2]
    wanted = removed(span, texts)
    for r in suffix.remove_repeats(texts_df(spark, texts), span=span).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == wanted[r["doc_id"]]


def test_suffix_blocks_and_steps(spark, monkeypatch):
    """Texts that lie in many blocks, and blocks over many steps."""
    monkeypatch.setattr(suffix, "STEP", 700)
    suffix._tables.cache_clear()
    texts = random_texts(30, 9)
    for d, block in [(i, suffix.Block("".join(texts).encode(), np.array([len(t) for t in texts]), 40)) for i in range(1)]:
        found = suffix.Anchors(block)
        monkeypatch.setattr(suffix, "STEP", 1 << 17)
        suffix._tables.cache_clear()
        whole = suffix.Anchors(block)
        assert d == 0 and found.at.tolist() == whole.at.tolist() and found.left.tolist() == whole.left.tolist()
    suffix._tables.cache_clear()


def test_suffix_odd_rows(spark):
    got = suffix.remove_repeats(odd_docs(spark), span=20).collect()
    assert len(got) == len(ODD) + 1
    by = {r["doc_id"]: r["n_removed"] for r in got}
    assert by[13] == len(ODD[13]) and by[9] == 3000 and by[0] == by[1] == 0
    assert suffix.remove_repeats(empty_docs(spark)).count() == 0
    carried = suffix.remove_repeats(odd_docs(spark), span=20, carry=["doc_id", "lang", "score"]).select("doc_id.*").first()
    assert carried["lang"] == "en" and carried["score"] == 2.0


def test_topk(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(300)]
    odd = [(1000, None), (1050, [float("nan")] * 6), (1100, [None] * 6), (1150, [float("inf")] * 6), (1200, [1.0, 2.0]), (1250, []), (0, vectors[0][1])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in vectors]
    ints.append(ints[0])
    for q in range(0, 300, 50):
        v = ints[q][1]
        wanted = sorted((-int(v @ w), i) for i, w in ints if i != q)[:5]
        assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(wanted)]
    assert not got
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_topk_of_large_ids_in_blocks(spark, monkeypatch, broadcast):
    """Ids near the ends of the range, columns of clashing names, blocks and shards of a few rows, joins with and without
    broadcast."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 16)
    rng = np.random.default_rng(4)
    ids = [*range((1 << 62) - 40, (1 << 62) + 40), *range(-(1 << 62) - 30, -(1 << 62) + 30), -1, 0, 1]
    vectors = {i: (rng.integers(-3, 4, 5) / 4).tolist() for i in ids}
    df = spark.createDataFrame([(i, v, 1, 2, 3, "s", 9) for i, v in vectors.items()], "vec_id long, embedding array<float>, rank int, score int, query long, shard string, id int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = topk.top_k(df, F.col("vec_id") % 3 == 0, 4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors.items()}
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 3 == 0}
    for q, rows in got.items():
        wanted = sorted((-int(ints[q] @ w), i) for i, w in ints.items() if i != q)[:4]
        assert sorted(rows) == [(n + 1, i, -s) for n, (s, i) in enumerate(wanted)]


def test_topk_refuses_what_does_not_fit():
    with pytest.raises(OverflowError):
        topk._products(np.array([[1 << 40]], np.int64), np.array([[1 << 40]], np.int64))


def test_topk_of_large_numbers():
    big = np.array([[1 << 30, 3]], np.int64)
    assert topk._products(big, np.array([[1 << 30, 1]], np.int64))[0, 0] == (1 << 60) + 3


def counted(text):
    words, places = re.findall(r"[^\x20\x09-\x0D]+", text or ""), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {p + o for ps in places.values() if len(ps) > 1 for p in ps for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_rules_counts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rules.statistics(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counted(texts[r["doc_id"]])


def test_rules_learn_a_threshold(spark):
    r = random.Random(7)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, " ".join("".join(r.choices("abcdef", k=5)) + ("$$$" if bad else "") for _ in range(80))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 5 != 0).cast("int").alias("quality")).where("doc_id < 400")
    got = rules.judge(docs, labels).collect()
    assert all(x["kept"] == (x["doc_id"] % 5 != 0) for x in got)
    assert all(x["kept"] for x in rules.judge(docs, labels.limit(0)).collect())
    assert rules.judge(odd_docs(spark), labels).count() == len(ODD) + 1
    assert rules.judge(empty_docs(spark), labels).count() == 0


def test_rules_stay_in_the_engine(spark, data):
    plan = queries.op10_rules(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_duckdb_agrees_on_sizes(spark, data):
    wanted = duckdb.sql(f"SELECT sum(strlen(text) + 1) FROM '{data}/documents.parquet'").fetchall()[0][0]
    assert queries.op4_sharding(spark, data).agg(F.sum("size")).first()[0] == wanted
