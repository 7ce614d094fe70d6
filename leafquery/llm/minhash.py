"""Near-duplicate documents by an inverted join of MinHash signature coordinates.

1. Each text becomes a set of word shingles (64-bit hashes) and a signature of K coordinates. Equal sets are one class.
2. Every class is posted under its (coordinate, value) pairs. Two signatures that agree in at least T of K coordinates
   share one of any K - T + 1 pairs of either, so only the rarest K - T + 1 pairs of a class are posted (prefix), and
   pairs that nobody shares need no posting.
3. In each posting list the class whose pairs are shared the most is the pivot, as it stands in the middle of its near
   copies. All others are held against it: agreements are counted on the
   signatures, the coordinates outside the prefix being looked up and not merged (skip); from T agreements on, the
   full sets decide. That links near copies in linear time, and gives for each class what it shares with the pivot (one
   bit for each shingle of the pivot) and what it has besides (its extras). Two classes held against one pivot need no
   texts any more: bits and extras give their intersection.
4. Classes of one pivot that are not together yet are told apart by keys, not pair by pair. A pair above the limit
   either shares an extra, one of the rarest few of either (the rest cannot make up the limit), or its whole
   intersection lies in the pivot, which for classes not linked with the pivot leaves a narrow range of sizes. So extras
   and sizes are posted. Each such list first takes a pivot of its own, and only classes that this does not unite
   are compared in pairs. Classes with too few agreements with their pivot are compared with the members of its list
   by their signatures. No list is cut and no link is lost but
   for pairs with fewer than T agreements in spite of their similarity; T keeps that chance below MISS per pair.
5. The links' connected components give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafquery.llm.common import materialize, release, short_batches, texts_of
from leafquery.llm.components import components

K = 32
MISS = 1e-6
#: Ids that may be broadcast to select texts; beyond it the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_MIX = np.random.default_rng(20240229)
_FACTORS = _MIX.integers(1, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _MIX.integers(0, 2**63, K, dtype=np.uint64)
_PLACES = _MIX.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARKS = _MIX.integers(0, 2**63, K, dtype=np.uint64)
#: Sizes of a pivot's classes are posted in steps of this share of the pivot's size. Parts of a profile.
SIZE_STEPS, PARTS = 64, 64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than space, tab and line ends, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str, n: int) -> np.ndarray:
    """The text's distinct n-word shingles as ascending 64-bit hashes; with fewer words, the whole sequence as one."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    mixed = np.full(len(h) - width + 1, width if width < n else 0, np.uint64)
    for k in range(width):
        mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _PLACES[k % 64]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of K hash functions, as 64-bit numbers that also tell the coordinate."""
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[k : k + 4096, None] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    least = (least ^ _MARKS) * np.uint64(0x9E3779B97F4A7C15)
    return (least ^ (least >> np.uint64(31))).view(np.int64)


def needed_agreements(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The greatest T for which a pair of that similarity has fewer than T agreements with a chance of at most miss."""
    tail, out = 0.0, 1
    for i in range(k):
        tail += comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if tail > miss:
            break
        out = i + 1
    return max(1, out)


def sketch(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, h (digest of the set; null if it is empty), sig."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in texts_of(batch):
                s = shingle_set(text, n)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "h", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, h binary, sig array<long>")


def _agreements(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def _size_fits(a: str, b: str, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _above(both: Column, n: str, m: str, percent: int) -> Column:
    """Whether sets of n and m shingles of which `both` are common are linked."""
    return both * (100 + percent) >= (F.col(n) + F.col(m)) * percent


_CONFIRMED = "a long, ha binary, b long, hb binary, n long, m long, both long, bits array<long>, extras array<long>, profile array<int>"


def _confirm(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """pairs (a, ha, b, hb): with n and m, the sizes of their full sets, `both`, how much is common, `bits`: which of b's
    shingles, in ascending order, a has, 64 to a number, `extras`: the shingles that only a has, and `profile`: how many
    of either lie in each of PARTS parts of b's shingles and of all numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}

        def of(h: bytes, text: str) -> np.ndarray:
            if h not in held:
                if len(held) >= 64:
                    held.clear()
                held[h] = shingle_set(text or "", words)
            return held[h]

        for batch in batches:
            sizes, bits, extras, profiles = [], [], [], []
            for ha, hb, ta, tb in zip(*(batch.column(k).to_pylist() for k in (1, 3, 4, 5)), strict=True):
                x, y = of(ha, ta), of(hb, tb)
                has = np.isin(y, x, assume_unique=True)
                sizes.append((len(x), len(y), int(has.sum())))
                bits.append(np.packbits(np.pad(has, (0, -len(has) % 64)), bitorder="little").view("<i8"))
                own = x[np.isin(x, y, assume_unique=True, invert=True)]
                extras.append(own.view(np.int64))
                profiles.append(np.concatenate([np.bincount(np.flatnonzero(has) * PARTS // max(1, len(y)), minlength=PARTS), np.bincount((own >> np.uint64(58)).astype(np.int64), minlength=PARTS)]).astype(np.int32))
            cols = [pa.array(c, pa.int64()) for c in (zip(*sizes, strict=True) if sizes else ([], [], []))]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in (bits, extras)] + [pa.array(profiles, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *cols, *lists], names=["a", "ha", "b", "hb", "n", "m", "both", "bits", "extras", "profile"])

    with_a = pairs.join(texts.select(F.col("h").alias("ha"), F.col("text").alias("ta")), "ha")
    with_b = with_a.join(texts.select(F.col("h").alias("hb"), F.col("text").alias("tb")), "hb")
    return with_b.select("a", "ha", "b", "hb", "ta", "tb").mapInArrow(run, _CONFIRMED)


def _common(one: str, two: str) -> Column:
    """Of two classes held against one pivot: the size of the intersection of their sets."""
    in_pivot = F.aggregate(F.zip_with(f"{one}.bits", f"{two}.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    return in_pivot + F.size(F.array_intersect(f"{one}.extras", f"{two}.extras"))


def _links_of(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """pairs (hb, h1, h2) of classes held against the pivot hb: (a, b) of those that are linked."""
    fat = F.struct("a", "n", "bits", "extras")
    found = pairs.join(members.select("hb", F.col("h").alias("h1"), fat.alias("x")), ["hb", "h1"]).join(members.select("hb", F.col("h").alias("h2"), fat.alias("y")), ["hb", "h2"])
    return found.where(_above(_common("x", "y"), "x.n", "y.n", percent)).select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))


def _among_pivots(to_pivot: DataFrame, together: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between classes that were held against one pivot and are not in one component of `together` (a, c)."""
    rows = to_pivot.select("a", F.col("ha").alias("h"), "hb", "n", "m", "both", "bits", "extras", "profile")

    def apart(df: DataFrame, by: list[str]) -> DataFrame:
        """Of df with a component c, the groups that hold several."""
        return df.groupBy(*by).agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select(*by)

    members = rows.join(together, "a", "left").withColumn("c", F.coalesce("c", "a"))
    members = materialize(members.join(apart(members, ["hb"]), "hb"), "minhash-members")

    # keys: the rarest extras that classes of several components have, as far as the limit needs them, and the size
    step = F.greatest(F.lit(1), F.floor(F.col("m") / SIZE_STEPS))
    extras = members.select("hb", "h", "c", F.explode("extras").alias("key"))
    kept = extras.groupBy("hb", "key").agg(F.count("*").alias("df"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("hb", "key", "df")
    needed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1  # so many of the rarest shingles hold one that is common
    ranked = extras.join(kept, ["hb", "key"]).groupBy("hb", "h").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("all"))  # a class's own extras
    slim = members.select("hb", "h", "c", "n", "m", "both", F.size("extras").alias("more"), step.alias("step"), "profile")
    keyed = slim.join(ranked, ["hb", "h"])
    first = F.greatest(F.lit(0), F.least(F.size("all"), (needed - (F.col("more") - F.size("all"))).cast("int")))
    by_extra = keyed.select("hb", "h", "c", "n", "both", "more", "profile", F.explode(F.slice("all.key", F.lit(1), first)).alias("key"))
    by_size = slim.select("hb", "h", "c", "n", "both", "more", F.lit(None).cast("array<int>").alias("profile"), F.floor(F.col("n") / F.col("step")).alias("key"), "step")
    lists = materialize(by_extra.withColumn("kind", F.lit(1)).unionByName(by_size.drop("step").withColumn("kind", F.lit(0))), "minhash-lists")

    # each list against a pivot of its own
    heads = lists.groupBy("hb", "kind", "key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct(F.xxhash64("h").alias("r"), "h")).alias("p")).where("c0 != c1").select("hb", "kind", "key", F.col("p.h").alias("h2"))
    tried = lists.select("hb", "kind", "key", F.col("h").alias("h1")).join(heads, ["hb", "kind", "key"]).where("h1 != h2").select("hb", "h1", "h2").distinct()
    star = materialize(_links_of(tried, members, percent), "minhash-list-stars")
    now = components(together.select(F.col("a").alias("u"), F.col("c").alias("v")).union(star), "minhash-list-groups").select(F.col("node").alias("a"), F.col("component").alias("c"))

    # what is still apart, in pairs; step by step, as one plan of it all would hold the driver's memory for 36 exchanges at once
    own = materialize(members.select("hb", "h", "a").join(now, "a", "left").select("hb", "h", F.coalesce("c", "a").alias("c")), "minhash-list-own")
    left = lists.where("kind = 1").drop("c", "kind").join(own, ["hb", "h"])
    left = materialize(left.join(apart(left, ["hb", "key"]), ["hb", "key"]), "minhash-list-extras")
    x, y = (left.select("hb", "key", *[F.col(v).alias(f"{v}{k}") for v in ("h", "c", "n", "both", "more", "profile")]) for k in (1, 2))
    most = F.least("both1", "both2") + F.least("more1", "more2")
    in_parts = F.aggregate(F.zip_with("profile1", "profile2", lambda p, q: F.least(p, q)), F.lit(0), lambda s, p: s + p)
    extra_pairs = x.join(y, ["hb", "key"]).where((F.col("h1") < F.col("h2")) & (F.col("c1") != F.col("c2")) & _size_fits("n1", "n2", percent) & _above(most, "n1", "n2", percent) & _above(in_parts, "n1", "n2", percent))
    sized = slim.select("hb", "h", "n", "both", "step").join(own, ["hb", "h"])
    sized = materialize(sized.join(apart(sized, ["hb"]), "hb"), "minhash-list-sizes")
    # x is the larger one; both sets' common part lies in the pivot, so n1 + n2 is bounded by what x shares with it
    low, high = F.ceil(F.col("n") * percent / 100), F.least(F.col("n"), F.floor(F.col("both") * (100 + percent) / percent).cast("long") - F.col("n"))
    x = sized.where(low <= high).select("hb", *[F.col(v).alias(f"{v}1") for v in ("h", "c", "n", "both")], F.explode(F.sequence(F.floor(low / F.col("step")), F.floor(high / F.col("step")))).alias("key"))
    y = sized.select("hb", *[F.col(v).alias(f"{v}2") for v in ("h", "c", "n", "both")], F.floor(F.col("n") / F.col("step")).alias("key"))
    size_pairs = x.join(y, ["hb", "key"]).where((F.col("c1") != F.col("c2")) & ((F.col("n1") > F.col("n2")) | (F.col("n1") == F.col("n2")) & (F.col("h1") < F.col("h2"))) & _size_fits("n1", "n2", percent) & _above(F.least("both1", "both2"), "n1", "n2", percent))
    pairs = materialize(extra_pairs.select("hb", "h1", "h2").union(size_pairs.select("hb", "h1", "h2")).distinct(), "minhash-list-pairs", done=(lists, own, left, sized))
    return materialize(star.union(_links_of(pairs, members, percent)), "minhash-among", done=(star, members, pairs))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of word shingles; component_id is
    the least id reachable by links, kept says whether that is the row's own id. Null and empty texts, and texts of
    white space only, have no shingles and are linked with nothing. Rows that repeat an id are all
    returned, each with the group of its own text. A row without an id has component_id null, is kept and links nothing. Texts of any
    length are compared whole. Further columns of docs are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    least = needed_agreements(percent / 100)
    prefix = K - least + 1
    sketched = materialize(sketch(docs, words, id_col, text_col), "minhash-sketch")
    named = sketched.where("h is not null and doc_id is not null")
    first = named.groupBy("h").agg(F.min("doc_id").alias("a"))
    nodes = materialize(named.join(first.withColumnRenamed("a", "doc_id"), ["h", "doc_id"]).dropDuplicates(["h"]).select("h", F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), "sig"), "minhash-nodes")

    # postings of the rarest pairs that anybody shares
    posted = nodes.select("h", F.explode("sig").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        posted.join(shared, "key")
        .groupBy("h")
        .agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("all"))  # K entries at most
        .select("h", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("w"), F.slice("all", F.lit(1), F.greatest(F.lit(0), prefix - K + F.size("all"))).alias("all"))
        .where(F.size("all") > 0)
        .select("h", "w", F.col("all.key").alias("keys"))
    )
    listed = materialize(ranked.join(nodes, "h"), "minhash-prefix")
    postings = listed.select(F.explode("keys").alias("key"), "h", "a", "n", "w")
    heads = postings.groupBy("key").agg(F.max(F.struct("w", "a", "n", "h")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.a").alias("b"), F.col("p.h").alias("hb"))
    heads = materialize(heads, "minhash-heads")

    # the texts that may be needed
    wanted = listed.select(F.col("a").alias("doc_id"), "h")
    small = wanted.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(wanted) if small else wanted, "doc_id").select("h", "text")
    sets = sketched.where("doc_id is not null").groupBy("doc_id").agg(F.countDistinct(F.coalesce("h", F.lit(b""))).alias("n"))
    if sets.where("n > 1").limit(1).count():
        texts = _own_texts(texts, words)  # an id with several texts, be one blank: each goes with its own set
    texts = materialize(texts.dropDuplicates(["h"]) if not small else texts, "minhash-texts")

    # every list against its pivot
    star = postings.join(heads, "key").where(F.col("h") != F.col("hb")).select("h", "a", "hb", "b").distinct()
    sigs = nodes.select("h", "sig")
    star = star.join(sigs, "h").join(sigs.select(F.col("h").alias("hb"), F.col("sig").alias("sig_b")), "hb").where(_agreements("sig", "sig_b") >= least)
    to_pivot = materialize(_confirm(star.select("a", F.col("h").alias("ha"), "b", "hb"), texts, words), "minhash-star")
    linked = to_pivot.where(_above(F.col("both"), "n", "m", percent))

    # what the pivots have left apart
    together = components(linked.select("a", "b"), "minhash-star-groups").select(F.col("node").alias("a"), F.col("component").alias("c"))
    among = _among_pivots(to_pivot, together, percent)

    # classes with too few agreements with a list's pivot, against the list
    all_rows = listed.join(together, "a", "left").select(F.explode("keys").alias("key"), "keys", "h", "a", "n", "sig", F.coalesce("c", "a").alias("c"))
    placed = all_rows.select("key", "h", "c").join(heads.select("key", "hb"), "key").where("h != hb").join(to_pivot.select(F.col("ha").alias("h"), "hb", F.lit(True).alias("held")), ["h", "hb"], "left")
    placed = materialize(placed.select("key", "h", "c", "held"), "minhash-placed")
    open_ = placed.groupBy("key").agg(F.count(F.when(F.col("held").isNull(), 1)).alias("far"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("far > 0 and c0 != c1").select("key")
    opened = placed.join(open_, "key").select("key", "h", F.col("held").isNotNull().alias("held"))
    spread = materialize(all_rows.join(opened, ["key", "h"]), "minhash-far", done=(heads, placed))
    left = spread.where("not held").select([F.col(x).alias(f"{x}1") for x in ("h", "a", "n", "sig", "c", "keys")] + ["key"])
    right = spread.select([F.col(x).alias(f"{x}2") for x in ("h", "a", "n", "sig", "c", "keys", "held")] + ["key"])
    pairs = left.join(
        right,
        (left.key == right.key)
        & (F.col("c1") != F.col("c2"))
        & (F.col("held2") | (F.col("h1") < F.col("h2")))
        & _size_fits("n1", "n2", percent)
        & (_agreements("sig1", "sig2") >= least)
        & (F.array_intersect("keys1", "keys2")[0] == left.key),
    ).select(F.col("a1").alias("a"), F.col("h1").alias("ha"), F.col("a2").alias("b"), F.col("h2").alias("hb"))
    across = _confirm(pairs, texts, words).where(_above(F.col("both"), "n", "m", percent)).select("a", "b")

    found = components(together.union(among).union(across), "minhash-links")
    release(nodes, listed, texts, to_pivot, spread)
    groups = first.join(found.withColumnRenamed("node", "a"), "a", "left").select("h", F.col("a").alias("own"), F.col("component").alias("via"))
    return (
        sketched.join(groups, "h", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("via", "own", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def _own_texts(texts: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [bool(t) and xxhash.xxh3_128_digest(shingle_set(t, n).tobytes()) == h for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return texts.mapInArrow(run, T.StructType([T.StructField("h", T.BinaryType()), T.StructField("text", T.StringType())])).dropDuplicates(["h"])
