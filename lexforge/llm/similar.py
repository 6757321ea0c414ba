"""Near-duplicates by the words themselves: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

First the operator's way: SimHash fingerprints that multi-index hashing finds at a distance of 2 or less (``simhash.links``); of
one fingerprint, and of two near ones, one text each is compared with the other(s). These links alone cannot tell the similarity:
at 0.8 two fingerprints differ in about ten bits. So MinHash keys say which further texts to compare. Every link of either is
verified on the whole sets of hashed shingles. Links are never lost among texts that share a key, however many share it, and no
group is compared in pairs:

1. One text of a key, its leader, is compared with all others. Links go to components.
2. A text that is neither linked to the leader nor in its component may still be linked to others of the key. Where few
   share it, they are compared. Where many do, they are told apart by their differences from the leader L. Let D(x) be the
   shingles that only one of x and L has. As x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, they are similar if,
   and only if, 18 |D(x) & D(y)| >= t(x) + t(y), where t(x) = 9 |D(x)| - |x|. Pairs that need nothing in common (t(x) + t(y) <= 0)
   are linked through the text of least t, with which all are compared. The others share one of the rarest shingles of their
   differences; how many of these have to be looked at follows from t (a prefix filter), and from a shared one's place in both
   orders follows how many more can be shared at most (a positional filter). Sketches say that some differ in too many.
3. Should a shingle of the differences be shared by many again, those who share it are the members of a key of the next
   level, with a leader of their own, that have one more shingle in common (or all lack it). There it begins with 1.

Equal sets, told by 128-bit hashes, are one text from the beginning.

Rows: a null, an empty or a blank text has no shingles, and all of these are duplicates of one another; fewer words than a
shingle has are one shingle; repeated rows belong together; a null id is an id like any other, after all numbers; an empty
table gives an empty table; further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import simhash
from lexforge.llm.text import map_arrow, words_of
from lexforge.operators.graph import connected_components
from lexforge.plans.tables import materialize, scratch

#: Words in a shingle, and in one of a fingerprint. The similarity is 4 / 5, in whole numbers: 9 * common >= 4 * (sizes).
SHINGLE, PRINT_SHINGLE = 5, 3
#: Keys of a text and MinHash values in a key. Two texts meet if they share a key: at a similarity of 0.8 all but 1 in 65,000
#: pairs do (1 - 0.8 ** 5) ** 28, at 0.85 all but 2 in 10 million.
KEYS, VALUES, SEED = 28, 5, 42
#: Texts that share a key and are compared in pairs, where the leader leaves some of them open.
CROWD = 16
#: Texts that share a shingle of their differences, on the less frequent side, before that is a key of the next level.
WIDE = 256
#: Members of a crowded key, about, that say which shingles are usual, and how many of these at most.
SOME, USUAL = 2048, 4096
#: Rows of a table of one or two numbers that is broadcast at most; beyond, joins are shuffled.
BROADCAST = 500_000
_MULTIPLY, _ADD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, KEYS * VALUES), np.uint64, endpoint=False)
_MULTIPLY |= np.uint64(1)


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Of one text's words: the distinct hashes, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    n = 1 if len(words) < shingle else len(words) - shingle + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n))


def minhash_keys(hashes: np.ndarray) -> np.ndarray:
    """Of a set of hashes: its keys, each of other MinHash values."""
    least = np.full(KEYS * VALUES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    out = np.arange(1, KEYS + 1, dtype=np.uint64)
    for values in least.reshape(KEYS, VALUES).T:
        out = (out ^ values) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """512 bits, each whether an odd number of a set's hashes falls on it: two sketches differ in no more bits than their sets
    in shingles."""
    odd = np.bincount((hashes & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow lists of longs."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def prints(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """(row, digest, fp, size, keys, shingles, sketch, carried) of each row; ``carried`` is a struct of the columns of ``carry``.
    ``row`` numbers the rows of this run: to be used from a written table only."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*carry).alias("carried"))
    kind = found.schema["carried"].dataType.simpleString()

    def make() -> Callable:
        number = count(TaskContext.get().partitionId() << 40)

        def each(batch: pa.RecordBatch) -> dict:
            words = [words_of(t) for t in batch.column(0).to_pylist()]
            fps = np.fromiter((simhash.fingerprint(w, PRINT_SHINGLE) if w else 0 for w in words), np.uint64, len(words))
            sets = [shingle_set(w) for w in words]
            own = {"row": pa.array(list(islice(number, len(sets))), pa.int64()), "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets], pa.binary())}
            own |= {"fp": pa.array(fps.view(np.int64))}
            own |= {"size": pa.array([len(s) for s in sets], pa.int64()), "keys": _lists([minhash_keys(s) for s in sets]), "shingles": _lists(sets), "sketch": _lists([sketch(s) for s in sets])}
            return own | {"carried": batch.column(1)}

        return each

    return map_arrow(found, make, f"row long, digest binary, fp long, size long, keys array<long>, shingles array<long>, sketch array<long>, carried {kind}")


def _few(rows: DataFrame) -> DataFrame:
    """Marked for broadcast if a count of it says that it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows


def _alike(common: Column, a: Column, b: Column) -> Column:
    return 9 * common >= 4 * (a + b)


def _judged(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(src, dst) of those that are linked among distinct (src, dst, n, m) with the sizes."""
    possible = pairs.where("5 * least(n, m) >= 4 * greatest(n, m)")
    a, b = (sets.select(F.col("fid").alias(x), F.col("shingles").alias(f"_{x}")) for x in ("src", "dst"))
    counted = possible.join(b, "dst").join(a, "src").withColumn("common", F.size(F.array_intersect("_src", "_dst")))
    return materialize(counted.where(_alike(F.col("common"), F.col("n"), F.col("m"))).select("src", "dst"))


def _of(groups: DataFrame, name: str) -> DataFrame:
    return groups.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (src, dst) of different components."""
    with_both = pairs.join(_of(groups, "dst"), "dst", "left").join(_of(groups, "src"), "src", "left")
    return with_both.where(F.coalesce("c_src", "src") != F.coalesce("c_dst", "dst")).drop("c_src", "c_dst")


def _families(led: DataFrame) -> DataFrame:
    """Members with their leaders, where a leader that is a member of other keys gives its own members to the first leader of these:
    keys of similar members have one leader, and a text's differences are looked at once. All members of a key stay together; the
    leader is a member of its family."""
    first = F.min(F.struct("w", "n", "src"))
    above = materialize(led.join(led.select(F.col("src").alias("fid")).distinct(), "fid", "left_semi").groupBy("fid").agg(first.alias("up")))
    moved = led.join(_few(above.withColumnRenamed("fid", "src")), "src", "left")
    moved = moved.withColumns({"src": F.coalesce("up.src", "src"), "n": F.coalesce("up.n", "n")}).drop("up")
    own = moved.withColumns({"fid": F.col("src"), "size": F.col("n"), "weight": -F.col("w")}).select(moved.columns).distinct()
    return materialize(moved.where("fid <> src").unionByName(own))


def _told_apart(led: DataFrame, acting: DataFrame, sets: DataFrame, groups: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst, n, m) to compare, and members of the next level, of crowded keys; see the module's text. ``led``: their
    members with their leader; ``acting``: those that neither it nor its component holds; ``family``: the column that says whose
    differences are compared, the leader of ``_families`` on the first level (as many keys have the same), else the key itself."""
    known = acting.select(F.col(family).alias("family")).distinct()
    rows = led.select(F.col(family).alias("family"), "src", "n", "fid", "size", "weight").distinct().join(known, "family", "left_semi")
    own, lead = sets, sets.select(F.col("fid").alias("src"), F.col("shingles").alias("_lead"))
    apart = F.concat(F.array_except("shingles", "_lead"), F.array_except("_lead", "shingles"))
    rows = rows.join(own, "fid").join(lead, "src").withColumn("apart", apart).join(_of(groups, "fid"), "fid", "left")
    t, d = 9 * F.size("apart").cast("long") - F.col("size"), F.size("apart").cast("long")
    rows = materialize(rows.select("family", "fid", "size", "weight", F.coalesce("c_fid", "fid").alias("c"), t.alias("t"), d.alias("d"), (t > F.col("n")).alias("far"), "apart", "sketch"))
    families = materialize(rows.groupBy("family").agg(F.min(F.struct("t", "fid", "size", "c")).alias("y"), F.count(F.lit(1)).alias("members")))
    both = rows.join(families, "family")
    direct = both.where("t + y.t <= 0 and c <> y.c").select(F.col("y.fid").alias("a"), F.col("fid").alias("b"), F.col("y.size").alias("na"), F.col("size").alias("nb"))

    # the crowded shingles come last, the most frequent at the very end (any order is right; this one leaves few to look for)
    step = F.ceil(F.col("members") / SOME)
    many = both.where(F.col("members") >= WIDE / 2)  # fewer have no shingle in so many of their differences
    some = many.where(F.pmod(F.xxhash64("fid"), step) == 0).select("family", step.alias("step"), F.explode("apart").alias("token"))
    usual = some.groupBy("family", "step", "token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= F.greatest(F.lit(2), WIDE / (2 * F.col("step"))))
    by_count = F.array_sort(F.collect_list(F.struct("df", "token")))
    usual = usual.groupBy("family").agg(F.slice(F.reverse(by_count), 1, USUAL).alias("most"))
    usual = materialize(usual.select("family", F.transform(F.reverse("most"), lambda x: x["token"]).alias("usual")))
    one = F.lit(1).cast("long")
    probe = F.greatest(one, F.ceil((F.col("t") + F.col("y.t")) / 18), F.col("d") - F.floor(F.col("size") / 4))
    index = F.greatest(one, F.ceil(F.col("t") / 9))
    none = F.array().cast("array<bigint>")
    order = F.concat(F.array_sort(F.array_except("apart", F.coalesce("usual", none))), F.array_intersect(F.coalesce("usual", none), "apart"))
    placed = both.join(usual, "family", "left").withColumns({"probe": F.when(F.col("far"), F.col("d") - probe + 1).otherwise(0), "index": F.col("d") - index + 1, "order": order})
    reach = F.greatest("probe", "index").cast("int")
    seen = placed.where(reach > 0).select("family", "fid", "size", "weight", "c", "t", "d", "probe", "index", "sketch", F.posexplode(F.slice("order", F.lit(1), reach)).alias("i", "token"))
    seen = materialize(seen.select("family", "token", "fid", "size", "weight", "c", "t", "sketch", (F.col("d") - F.col("i")).alias("rest"), (F.col("i") < F.col("probe")).alias("asks"), (F.col("i") < F.col("index")).alias("told")))
    sizes = seen.groupBy("family", "token").agg(F.count_if("asks").alias("p"), F.count_if("told").alias("q"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    sizes = materialize(sizes.where("p > 0 and q > 0 and lo <> hi").select("family", "token", F.least("p", "q").alias("width")))
    calm = seen.join(sizes.where(F.col("width") <= WIDE), ["family", "token"])
    calm = calm.select("family", "token", F.struct("fid", "size", "c", "t", "rest", "asks", "told", "sketch").alias("x"))
    x, y = calm.where("x.asks"), calm.where("x.told").withColumnRenamed("x", "y")
    further = "(x.t > y.t or (x.t = y.t and x.fid > y.fid))"
    enough = "18 * least(x.rest, y.rest) >= x.t + y.t and 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)"
    unlike = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(8))
    met = x.join(y, ["family", "token"]).where(f"x.c <> y.c and {further} and {enough} and 9 * ({unlike}) <= x.size + y.size")
    met = met.select(F.col("x.fid").alias("a"), F.col("y.fid").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb"))
    deeper = seen.join(sizes.where(F.col("width") > WIDE), ["family", "token"]).select(F.xxhash64("family", "token").alias("bucket"), "fid", "size", "weight")
    return direct.unionByName(met), materialize(deeper)


def _ordered(met: DataFrame) -> DataFrame:
    """(src, dst, n, m) of (a, b, na, nb), the smaller first, once."""
    ab = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("na").alias("n"), F.col("nb").alias("m"))
    ba = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.col("nb").alias("n"), F.col("na").alias("m"))
    return met.select(F.when(F.col("a") < F.col("b"), ab).otherwise(ba).alias("p")).select("p.*").distinct()


def print_pairs(distinct: DataFrame) -> DataFrame:
    """(src, dst, n, m) of (fid, size, fp): the first text of a fingerprint with the others, and with the first texts of those that
    multi-index hashing finds near it."""
    texts = materialize(distinct.select("fid", "size", "fp"))
    firsts = materialize(texts.groupBy("fp").agg(F.min(F.struct("fid", "size")).alias("first")))
    a, b = (firsts.select(F.col("fp").alias(f"_{x}"), F.col("first").alias(x)) for x in ("x", "y"))
    same = texts.join(_few(a), F.col("fp") == F.col("_x")).select("x", F.struct("fid", "size").alias("y")).where("x.fid <> y.fid")
    near = materialize(simhash.links(firsts.select("fp")))
    near = near.join(a, F.col("src") == F.col("_x")).join(b, F.col("dst") == F.col("_y")).select("x", "y")
    return _ordered(same.unionByName(near).select(F.col("x.fid").alias("a"), F.col("y.fid").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb")))


def similar_links(distinct: DataFrame, hot: int = CROWD) -> DataFrame:
    """(src, dst) edges of (fid, fp, size, keys, shingles, sketch), all at the similarity or more: their components are those of all
    such pairs that ``print_pairs`` gives or that share a key."""
    table = distinct.select("fid", "size", F.explode("keys").alias("bucket"))
    sizes = materialize(table.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    shared = materialize(table.join(_few(sizes), "bucket").groupBy("fid", "size").agg(F.sum("k").alias("weight"), F.collect_list("bucket").alias("buckets")))
    near = materialize(print_pairs(distinct))
    met = materialize(shared.select("fid").unionByName(near.select(F.explode(F.array("src", "dst")).alias("fid"))).distinct())
    sets = materialize(distinct.join(_few(met), "fid", "left_semi").select("fid", "shingles", "sketch"))
    members = shared.select("fid", "size", "weight", F.explode("buckets").alias("bucket"))
    found = [_judged(near, sets)]
    family = "src"
    while not members.isEmpty():
        # the one that shares its keys with most
        lead = F.min(F.struct((-F.col("weight")).alias("w"), "size", "fid")).alias("lead")
        leaders = materialize(members.groupBy("bucket").agg(lead, F.count(F.lit(1)).alias("k")).select("bucket", F.col("lead.fid").alias("src"), F.col("lead.size").alias("n"), "k", "lead.w"))
        led = materialize(members.join(leaders, "bucket").where("fid <> src"))
        stars = materialize(led.select("src", "n", F.col("fid").alias("dst"), F.col("size").alias("m")).distinct())
        linked = _judged(stars, sets)
        found.append(linked)
        groups = materialize(connected_components(reduce(DataFrame.unionByName, found)))
        unlinked = stars.select("src", "dst").join(linked, ["src", "dst"], "left_anti")
        open_ = materialize(_apart(unlinked, groups).select("src", F.col("dst").alias("fid")))
        acting = materialize(led.join(open_, ["src", "fid"], "left_semi"))
        if acting.isEmpty():
            break
        calm = acting.where(F.col("k") <= hot).select("bucket", F.col("fid").alias("a"), F.col("size").alias("na"), F.col("src").alias("leader"))
        others = members.select("bucket", F.col("fid").alias("b"), F.col("size").alias("nb"))
        met = calm.join(others, "bucket").where("a <> b and b <> leader and 5 * least(na, nb) >= 4 * greatest(na, nb)").select("a", "b", "na", "nb")
        crowded = acting.where(F.col("k") > hot)
        members = members.limit(0)
        if not crowded.isEmpty():
            led = led.where(F.col("k") > hot)
            if family == "src":  # on the first level
                led = _families(led)
                crowded = led.join(crowded.select("bucket").distinct(), "bucket", "left_semi")
            more, members = _told_apart(led, crowded, sets, groups, family)
            met = met.unionByName(more)
        found.append(_judged(materialize(_apart(_ordered(met), groups)), sets))
        family = "bucket"
    return reduce(DataFrame.unionByName, found)


def similar_groups(docs: DataFrame, carry: list[str], text_col: str = "text", hot: int = CROWD) -> DataFrame:
    """The columns of ``carry`` of each row, and ``root``, which rows of a component of similar texts have in common."""
    with scratch(docs.sparkSession) as keep:
        rows = materialize(prints(docs, carry, text_col))
        firsts = materialize(rows.groupBy("digest").agg(F.min("row").alias("fid")))
        first = _few(firsts.select(F.col("fid").alias("row")))
        distinct = rows.join(first, "row", "left_semi").select(F.col("row").alias("fid"), "fp", "size", "keys", "shingles", "sketch")
        groups = materialize(connected_components(similar_links(distinct, hot)))
        named = keep(firsts.join(_of(groups, "fid"), "fid", "left").select("digest", F.coalesce("c_fid", "fid").alias("root")))
        carried = keep(rows.select("digest", "carried"))
    return carried.join(named, "digest").select("carried.*", "root")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = CROWD) -> DataFrame:
    """(doc_id, component_id): the smallest id that links of similar texts reach."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(similar_groups(keyed, ["doc_id"], hot=hot))
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "root").select("doc_id", "component_id")
