"""MinHash near-dedup as a signature-coordinate inverted join.

1. Equal shingle sets become one class, so exact copies cost one row from here on.
2. A class is posted under its coordinate-value pairs. A pair found once can meet nothing and is
   skipped; the rest is ordered from the rarest on. Two signatures of K coordinates that agree in T
   share one of their K - T + 1 rarest, so only that prefix is posted (prefix merging), and a class
   with fewer than T pairs found elsewhere is skipped whole.
3. In each posting list every class is tried against the list's most central member first. What is
   linked becomes one component, and only pairs of different components are tried further. Lists of a
   large group of copies thus cost a row per member.
   For the classes still in lists of several components the same prefix merging is then done exactly, on
   their full sets: shingles that no other of them holds cannot be in an intersection, which bounds how
   large a partner can be, and a partner must share one of the rarest of the others. Far edits of one
   text, which agree in many coordinates but reach the similarity with none, end here. What is left is
   tried with its lists' centres, then with each other.
4. A pair is kept when its sketches agree as those of similar texts do, the count of equal
   coordinates reaches T, and the full sets pass 100 * |A & B| >= 80 * |A | B|.
5. Components come from repeated minimum labels with pointer jumping, in stored tables.

With K = 40 and T = 20 a pair of similarity 0.8 is missed once in some 200,000 times; more similar ones less often.

Defined cases: null, empty or wordless texts have no shingles and are linked with nothing; a text
with fewer words than a shingle is one shingle; equal rows are linked, and so is each text of an id that
has several; components are named by their smallest id; a null doc_id stays null and
kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartonscope.llm.common import BLANKS, Words, bounded_batches, mix, shared_folder, slices, stored

K, T = 40, 20
#: Sketch bits in which texts of similarity 0.8 differ at most: 64 bits, 6.4 differ on average, deviation 2.8.
SKETCH_BITS = 22
#: Slots of the bitmap of ids whose sets are built; fixed, 4 MB. A full bitmap only builds sets in vain.
ID_SLOTS = 1 << 25
SET_BYTES = 5
_SEEDS = mix(np.arange(1, 2 * K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[:K], _SEEDS[K:] | np.uint64(1)
_COEF = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(words: Words, data: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, sorted within it, and how many each text has."""
    hashes, _, per_text = words(data, bounds)
    ends = np.cumsum(per_text)
    rolled = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= n:
        size = len(hashes) - n + 1
        for k in range(n):
            rolled[:size] += hashes[k:k + size] * _COEF[k]
        rolled = mix(rolled)
    found = []
    for end, count in zip(ends, per_text):
        if count >= n:
            found.append(np.unique(rolled[end - count:end - n + 1]))
        elif count:
            short = (hashes[end - count:end] * _COEF[:count]).sum(keepdims=True) + np.uint64(count)
            found.append(mix(short * np.uint64(0xD6E8FEB86659FD93)))
        else:
            found.append(hashes[:0])
    return (np.concatenate(found) if found else hashes), np.array([len(f) for f in found], np.int64)


def signature_keys(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """K coordinate-value pairs of each text, hashed to 64 bits; 0 where a text has no shingles."""
    keys, full = np.zeros((len(sizes), K), np.uint64), sizes > 0
    if len(sets):
        starts = (np.cumsum(sizes) - sizes)[full]
        for k in range(K):
            keys[full, k] = mix(np.minimum.reduceat((sets ^ _XOR[k]) * _MUL[k], starts) + np.uint64(k))
    return keys


def _signatures(n: int):
    words = Words(BLANKS)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, bounds in slices(batch["text"]):
                sets, sizes = shingle_sets(words, data, bounds, n)
                full = sizes > 0
                starts = (np.cumsum(sizes) - sizes)[full]
                keys = signature_keys(sets, sizes)
                sketch, one, two = (np.zeros(end - at, np.uint64) for _ in range(3))
                if len(sets):
                    bits = np.concatenate([keys & np.uint64(1), keys[:, :64 - K] >> np.uint64(1) & np.uint64(1)], axis=1)
                    sketch = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
                    one[full], two[full] = (np.add.reduceat(mix(sets ^ c), starts) for c in _COEF[:2])
                offsets = pa.array(np.arange(end - at + 1, dtype=np.int32) * K)
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(at, end - at), batch["v"].slice(at, end - at), pa.array(sizes), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                    pa.array(sketch.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "v", "n_shingles", "set_1", "set_2", "sketch", "keys"])
    return sign


def _sets(n: int, bitmap: np.ndarray):
    words = Words(BLANKS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch["slot"].to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0))
            for at, end, data, bounds in slices(batch["text"]):
                sets, sizes = shingle_sets(words, data, bounds, n)
                packed = np.ascontiguousarray(sets.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES])
                keys = signature_keys(sets, sizes)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, end - at), pa.array(
                    [k.tobytes() + packed[a:b].tobytes() for k, a, b in zip(keys, edges, edges[1:])], pa.binary())],
                    ["v", "shingles"])
    return build


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for v, blob in zip(batch["v"].to_pylist(), batch["shingles"]):
            shingles = _unpacked(blob.as_py())[1].view(np.int64)
            n = len(shingles)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int64)), pa.array(np.full(n, n, np.int64)), pa.array(shingles)],
                                             ["v", "n", "shingle"])


def partner_bounds(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, most, prefix): size of each set, the largest size that a partner among these sets can have, and the
    shingles of which a partner must hold one: place in the set, from its rarest shingle on, and shingle.

    Shingles are ordered by how many of the sets hold them. Those that no other set holds come first and are
    counted only. A pair that passes shares one of the first n - percent * n + 1 of each side."""
    rows = sets.mapInArrow(_shingles, "v long, n long, shingle long")
    held = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    shared = (rows.join(held, "shingle").groupBy("v", "n").agg(F.array_sort(F.collect_set(F.struct("held", "shingle"))).alias("shared"))
              .withColumn("alone", F.col("n") - F.size("shared")))
    most = F.floor(F.size("shared") * (100 + percent) / percent) - F.col("n")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    prefix = F.transform(F.slice("shared", 1, F.greatest(length, F.lit(0)).cast("int")),
                         lambda x, i: F.struct((i + F.col("alone")).alias("place"), x["shingle"].alias("shingle")))
    return shared.select("v", "n", most.alias("most"), prefix.alias("prefix"))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signature and full set, as _sets wrote them."""
    packed = np.frombuffer(blob, np.uint8, offset=8 * K).reshape(-1, SET_BYTES)
    values = np.zeros((len(packed), 8), np.uint8)
    values[:, :SET_BYTES] = packed
    return np.frombuffer(blob, np.uint64, K), values.view(np.uint64).ravel()


def _linked(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            last = None
            for left, right in zip(batch["set_a"], batch["set_b"]):
                left, (keys, right) = left.as_py(), _unpacked(right.as_py())
                if left != last:
                    last, (own_keys, mine) = left, _unpacked(left)
                if np.count_nonzero(keys == own_keys) < T:
                    keep.append(False)
                    continue
                both = len(mine) + len(right) - len(np.unique(np.concatenate([mine, right])))
                keep.append(100 * both >= percent * (len(mine) + len(right) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return confirm


def components(links: DataFrame) -> DataFrame:
    """(v, comp): the smallest id reachable over links (a, b), for each linked id. Stored rounds; nothing is collected."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("comp").alias("least"))
        seen = labels.join(near, labels.v == near.a).select("v", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("v").alias("comp"), F.col("comp").alias("root"))
        moved = stored(seen.join(jump, "comp").select("v", "old", F.col("root").alias("comp")), "labels")
        labels = moved.select("v", "comp")
        if moved.filter("comp <> old").isEmpty():
            return labels


class _Linking:
    """Posted prefixes and what has been linked so far."""

    def __init__(self, posts: DataFrame, sets: DataFrame, percent: int):
        self.posts, self.sets, self.percent = posts, sets, percent
        self.labels: DataFrame | None = None
        self.tried: DataFrame | None = None

    def members(self) -> DataFrame:
        """Posts with components; after the first round only those in lists of several components."""
        if self.labels is None:
            return self.posts.withColumn("comp", F.col("v"))
        found = self.posts.join(self.labels, "v", "left").withColumn("comp", F.coalesce("comp", "v"))
        lists = found.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
        return stored(found.join(lists.select("key"), "key", "left_semi"), "open-posts")

    def bound_partners(self) -> None:
        """Keeps the posts that may still link, with the sizes that decide with which."""
        open_posts = self.members()
        open_sets = self.sets.join(open_posts.select("v").distinct(), "v", "left_semi")
        bounds = partner_bounds(open_sets, self.percent).filter(F.col("most") * 100 >= F.col("n") * self.percent)
        self.bounds = stored(bounds, "bounds")
        self.posts = stored(open_posts.drop("comp").join(self.bounds.drop("prefix"), "v"), "open-posts")

    def meet_on_shingles(self) -> DataFrame:
        """Pairs of what is still open, of two components, that share a shingle of their prefixes early enough
        for the rest of both sets to reach the similarity."""
        members = self.members()
        one = members.select("v", "sketch", "comp", "n", "most").distinct().join(self.bounds.select("v", "prefix"), "v")
        lists = one.select("v", "sketch", "comp", "n", "most", F.inline("prefix"))
        rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
        reach = rest * (100 + self.percent) >= (F.col("a.n") + F.col("b.n")) * self.percent
        return lists.alias("a").join(lists.alias("b"), (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.comp") < F.col("b.comp"))
                                     & _may_link(lists.columns, "a.", "b.") & reach).select(F.col("a.v").alias("a"), F.col("b.v").alias("b"))

    def try_pairs(self, pairs: DataFrame) -> None:
        """Confirms pairs (a, b) on full sets and merges the components of those that pass."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if self.labels is not None and pairs.isEmpty():
            return
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        full = (pairs.join(self.sets.select(F.col("v").alias("b"), F.col("shingles").alias("set_b")), "b")
                .join(self.sets.select(F.col("v").alias("a"), F.col("shingles").alias("set_a")), "a"))
        links = full.select("a", "b", "set_a", "set_b").mapInArrow(_linked(self.percent), "a long, b long")
        if self.labels is not None:
            at = self.labels
            links = (links.join(at.select(F.col("v").alias("a"), F.col("comp").alias("ca")), "a", "left")
                     .join(at.select(F.col("v").alias("b"), F.col("comp").alias("cb")), "b", "left")
                     .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        merged = components(links)
        if self.labels is None:
            self.labels = merged
            return
        old = self.labels.withColumnRenamed("comp", "was")
        new = merged.select(F.col("v").alias("was"), F.col("comp").alias("to"))
        moved = old.join(new, "was", "left").select("v", F.coalesce("to", "was").alias("comp"))
        fresh = merged.join(self.labels, "v", "left_anti")
        self.labels = stored(moved.unionByName(fresh), "labels")


def _may_link(columns: list[str], a: str, b: str) -> Column:
    """Members a and b are of two components, their sketches are alike, and their sizes fit where they are known."""
    test = (F.col(f"{a}comp") != F.col(f"{b}comp")) & (F.bit_count(F.col(f"{a}sketch").bitwiseXOR(F.col(f"{b}sketch"))) <= SKETCH_BITS)
    if "most" in columns:
        test = test & (F.col(f"{a}n") <= F.col(f"{b}most")) & (F.col(f"{b}n") <= F.col(f"{a}most"))
    return test


def _row_key() -> Column:
    """Stands for a row in all joins; equal rows share it, two texts of one id do not."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(docs: DataFrame, shingle: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs (doc_id long, text)."""
    return _judged(docs, shingle, percent).drop("v")


def _judged(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The columns of near_duplicates and v, the row's key."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared_folder(spark)
    docs = docs.select("doc_id", "text", _row_key().alias("v"))
    signed = stored(docs.mapInArrow(_signatures(shingle), "doc_id long, v long, n_shingles long, set_1 long, set_2 long, "
                                    "sketch long, keys array<long>"), "signatures")
    rows = signed.filter("n_shingles > 0 and doc_id is not null")
    # The row of its smallest id stands for a class.
    classes = stored(rows.groupBy("set_1", "set_2").agg(F.min(F.struct("doc_id", "v")).alias("head"))
                     .select("set_1", "set_2", "head.doc_id", "head.v"), "classes")
    heads = rows.join(classes.select("v", "set_1", "set_2"), ["v", "set_1", "set_2"], "left_semi")
    all_posts = heads.select("v", "sketch", F.explode("keys").alias("key"))
    shared = all_posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    listed = (all_posts.join(shared, "key").groupBy("v", "sketch")
              .agg(F.collect_set(F.struct("df", "key")).alias("found")).filter(F.size("found") >= T))
    prefix = F.slice(F.array_sort("found"), 1, F.size("found") - T + 1)
    pop = F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["df"])
    posts = stored(listed.select("v", "sketch", pop.alias("pop"), F.explode(prefix["key"]).alias("key")), "posts")

    found = posts.select(F.pmod(F.xxhash64("v"), F.lit(ID_SLOTS)).alias("slot")).distinct()
    maps = found.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    bitmap = np.zeros((ID_SLOTS + (1 << 16)) >> 3, np.uint8)
    for part, bits in maps:  # the first bitmap is number 1 and starts at slot 1, number 0 holds slot 0
        bitmap[part * 4096:part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    sets = stored(docs.filter("doc_id is not null").select(
        F.col("v").alias("doc_id"), "text", F.expr(f"bitmap_bucket_number(pmod(xxhash64(v), {ID_SLOTS})) * 32768L"
                                                   f" + bitmap_bit_position(pmod(xxhash64(v), {ID_SLOTS}))").alias("slot"))
        .mapInArrow(_sets(shingle, bitmap), "v long, shingles binary"), "sets")

    linking = _Linking(posts, sets, percent)

    def centres(members: DataFrame) -> DataFrame:
        """Each member with its list's centre, where they are of two components and may link. The centre is the
        member in the largest lists; where sets are known, the one with the fewest shingles of its own, which is
        nearest to the text that the others were made from."""
        rank = F.col("most") / F.col("n") if "most" in members.columns else F.col("pop").cast("double")
        fields = ["rank", "pop", *[c for c in members.columns if c not in ("pop", "key")]]
        lists = members.withColumn("rank", rank).groupBy("key").agg(F.max(F.struct(*fields)).alias("c"))
        return members.join(lists, "key").filter(_may_link(members.columns, "", "c.")).select(
            "v", F.col("c.pop").alias("pop"), F.col("c.v").alias("centre"))

    best = centres(linking.members()).groupBy("v").agg(F.max(F.struct("pop", "centre"))["centre"].alias("centre"))
    linking.try_pairs(best.select(F.col("v").alias("a"), F.col("centre").alias("b")))
    linking.bound_partners()
    linking.try_pairs(centres(linking.members()).select(F.col("v").alias("a"), F.col("centre").alias("b")))
    linking.try_pairs(linking.meet_on_shingles())

    # Components of rows are named by the smallest id in them.
    named = classes.join(linking.labels, "v", "left").select("set_1", "set_2", "doc_id", F.coalesce("comp", "v").alias("comp"))
    of_class = named.join(named.groupBy("comp").agg(F.min("doc_id").alias("class_comp")), "comp").select("set_1", "set_2", "class_comp")
    out = signed.select("doc_id", "v", "n_shingles", "set_1", "set_2").join(of_class, ["set_1", "set_2"], "left")
    comp = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("class_comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "v", "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: of the smallest doc_id, and of equal rows with words one. Two texts of one id are judged each
    for itself. Rows of a null id stay."""
    judged = stored(_judged(docs, shingle, percent).select("v", "kept", (F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).alias("linked")), "judged")
    key = "row_key"
    while key in docs.columns:
        key += "_"
    kept = docs.withColumn(key, _row_key()).join(judged.filter("not kept").select(F.col("v").alias(key)).distinct(), key, "left_anti")
    again = judged.filter("kept and linked").groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("v").alias(key))
    if again.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates([key]))
    return single.select(*docs.columns)
