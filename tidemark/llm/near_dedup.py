"""Near-duplicate documents by a signature-coordinate inverted join.

A document's set is its distinct k-word shingles (A-Z lower-cased; with fewer words, the whole sequence). Its MinHash
signature has COORDS coordinates. Documents with one and the same set are one class from the start. Class
representatives are posted under each (coordinate, value) pair; pairs that only one representative has are dropped, as
nothing can collide there. Two sets at the threshold share at least MATCHES coordinates (at similarity 0.8 and 14 of 32
this fails for one pair in a million or so), so it is enough to look at each document's prefix: its pairs ordered by
frequency, rarest first, without the last MATCHES - 1. Posts carry the signature in brief, four bits a coordinate, so that
collisions are counted where two posts of a list meet, and pairs below MATCHES, or of sizes that can't reach the
threshold, go no further. What stays is confirmed on the full sets, which are made anew from the texts.

No list is expanded into its pairs. First a few leaders of each list are compared with its members; components merge, and lists
within one component are skipped. A list may still have members outside its commonest component.
These are dealt into blocks of bounded size, and the members of their lists that collide with one
of a block often enough are compared with the whole block at once, through an index of its shingles. So every pair of posts
in a list is either compared or known to be connected, and components are exact over the candidates. A text travels once for
each block that it is compared with.

Null or blank text: empty set, linked with nothing. Rows that repeat an identifier are documents of their own; a class or
component that they name is one. A null identifier links with nothing. Ties go to the smaller identifier. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.runtime import cut, let_go, ship

COORDS, MATCHES, LEADERS = 32, 14, 3
FEW = 1_000_000  # identifiers that may be broadcast: 40 MB
SHINGLES, MEMBERS = 1 << 18, 1_024  # of a block, about
_seeds = words.mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, ADD = _seeds[:COORDS] | np.uint64(1), _seeds[COORDS:]


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, _, buf, offs in words.slices(texts):
        starts, ends, at = words.find(buf, offs)
        h = words.hashes(buf, starts, ends, lower=True)
        for a, b in zip(at, at[1:], strict=False):
            yield words.shingles(h[a:b], k)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each coordinate's hash over a set that isn't empty; long sets go through in parts."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[i : i + 4096, None] * MULTIPLY + ADD).min(axis=0))
    return low


def brief(sig: np.ndarray) -> tuple[int, int]:
    """Four bits of each coordinate, in two numbers."""
    bits = (words.mix(sig) >> np.uint64(60)) << (np.arange(COORDS, dtype=np.uint64) % np.uint64(16) * np.uint64(4))
    return tuple(int(x) for x in np.bitwise_or.reduce(bits.reshape(2, 16), axis=1).view(np.int64))


def features(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n (set size), d1, d2 (digest of the set), s1, s2 (the signature in brief), signature."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            sizes, digests, sigs, briefs = [], [], [], []
            for s in _sets(batch.column("text"), k):
                sizes.append(len(s))
                digests.append(_digest(s))
                sig = signature(s) if len(s) else np.zeros(0, np.uint64)
                sigs.append(sig.view(np.int64))
                briefs.append(brief(sig) if len(s) else (0, 0))
            ends = pa.array(np.cumsum([0, *map(len, sigs)]), pa.int32())
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sigs]), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), *(pa.array([x[i] for x in pairs], pa.int64()) for pairs in (digests, briefs) for i in (0, 1)), pa.ListArray.from_arrays(ends, flat)],
                ["id", "text_hash", "n", "d1", "d2", "s1", "s2", "signature"],
            )

    return source.mapInArrow(run, "id long, text_hash long, n long, d1 long, d2 long, s1 long, s2 long, signature array<long>")


def collisions(a: Column, b: Column) -> Column:
    """In how many of 16 places do two briefs agree? (At least as often as the coordinates do.)"""
    x = a.bitwiseXOR(b)
    y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    y = y.bitwiseOR(F.shiftrightunsigned(y, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return 16 - F.bit_count(y)


def near(percent: int, matches: int):
    """Can two members (structs) reach the threshold, by their sizes and collisions?"""

    def like(a: Column, b: Column) -> Column:
        size = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * percent
        return size & (collisions(a["s1"], b["s1"]) + collisions(a["s2"], b["s2"]) >= matches)

    return like


def prefix_lists(reps: DataFrame, matches: int) -> DataFrame:
    """(key, rep, n, s1, s2): the prefix of each representative with enough pairs that others have too."""
    every = reps.select("rep", F.posexplode("signature").alias("coordinate", "value")).select("rep", F.xxhash64("coordinate", "value").alias("key"))
    counts = every.groupBy("key").agg(F.count("*").alias("posted")).filter("posted > 1")
    ranked = every.join(counts, "key").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("posted", "key"))).alias("k")).filter(F.size("k") >= matches)
    prefix = F.explode(F.slice("k", F.lit(1), F.size("k") - (matches - 1))).alias("p")
    return ranked.join(reps.select("rep", "n", "s1", "s2"), "rep").select("rep", "n", "s1", "s2", prefix).select(F.col("p.key").alias("key"), "rep", "n", "s1", "s2")


def _labelled(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    own = lists.withColumn("component", F.col("rep")) if labels is None else lists.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return own.select("key", "rep", "component", F.struct("rep", "component", "n", "s1", "s2").alias("m"))


def _leaders(lists: DataFrame, number: int, like) -> DataFrame:
    """(block, rep): a few leaders of each list, each chosen by another hash that all lists share, against the members they may be linked with."""
    own = _labelled(lists, None)
    turns = [F.min_by("m", F.xxhash64("rep", F.lit(r)) if r else F.col("rep")) for r in range(number)]
    heads = own.groupBy("key").agg(F.array_distinct(F.array(*turns)).alias("heads"), F.count("*").alias("k")).filter("k > 1").select("key", "heads")
    heads = cut(heads, "heads")  # read anew, the join can split a hot list
    met = F.filter("heads", lambda o: (o["rep"] != F.col("rep")) & like(F.col("m"), o))
    pairs = own.join(heads, "key").select("rep", F.transform(met, lambda o: o["rep"]).alias("heads")).filter(F.size("heads") > 0)
    return pairs.select(F.explode("heads").alias("block"), "rep").distinct()


def _others(lists: DataFrame, labels: DataFrame | None, like) -> tuple[DataFrame, DataFrame]:
    """What no leader has joined: (block, rep) of the members outside their list's commonest component, in blocks of bounded size; and
    (block, rep) of all members that may be linked with some such member of that block."""
    own = _labelled(lists, labels)
    counted = own.groupBy("key", "component").agg(F.count("*").alias("c"))
    main = counted.groupBy("key").agg(F.max(F.struct("c", F.bitwise_not("component").alias("least"))).alias("top"), F.count("*").alias("k")).filter("k > 1").select("key", "top.c", F.bitwise_not("top.least").alias("main"))
    opened = cut(own.join(cut(main, "main"), "key"), "open")
    few = opened.filter("component <> main").groupBy("rep").agg(F.max(F.struct("c", "main"))["main"].alias("home"), F.max("m.n").alias("n"))  # that of the largest: one for a whole group
    sizes = few.groupBy("home").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / MEMBERS)).alias("blocks"))
    blocks = cut(few.join(sizes, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block")), "blocks")
    grouped = opened.filter("component <> main").join(blocks, "rep").groupBy("key", "block").agg(F.collect_list("m").alias("few"))
    grouped = cut(grouped, "few")
    met = F.exists("few", lambda o: (o["component"] != F.col("component")) & like(F.col("m"), o))
    return blocks, opened.select("key", "rep", "component", "m").join(grouped, "key").filter(met).select("block", "rep").distinct()


def confirm(docs: DataFrame, reps: DataFrame, few: DataFrame, many: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) at the threshold, on full sets, between few and many of one block (both have block, rep): of those in a task a forest, which joins
    all that they join. A block's many are dealt out by the size of their sets; its few, whose size is bounded, go to each part."""
    facts = reps.select("rep", "n", "d1", "d2")
    parts = many.join(facts, "rep").groupBy("block").agg(F.ceil(F.sum("n") / SHINGLES).alias("parts"))
    here = many.join(parts, "block").select("block", F.pmod(F.xxhash64("rep"), F.col("parts")).alias("part"), "rep", F.lit(1).alias("side"))
    there = few.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "rep", F.lit(0).alias("side"))
    wanted = cut(many.select("rep").unionByName(few.select("rep")).distinct().join(facts.drop("n"), "rep"), "wanted")
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(wanted, "rep")
    rows = there.unionByName(here).join(texts, "rep").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "part").sortWithinPartitions("block", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        at, index = None, None
        for batch in batches:
            a, b = [], []
            places = zip(*(batch.column(c).to_pylist() for c in ("block", "part", "side", "rep", "d1", "d2")), strict=True)
            for (block, part, side, rep, *digest), s in zip(places, _sets(batch.column("text"), k), strict=True):
                if at != (block, part):
                    at, index = (block, part), _Index(percent)
                if _digest(s) != tuple(digest):
                    continue  # identifiers may repeat: another document's text
                if not side:
                    index.add(rep, s)
                else:
                    for other in index.links(rep, s):
                        a.append(other)
                        b.append(rep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class _Index:
    """Sets by their shingles, and what is joined so far."""

    def __init__(self, percent: int):
        self.percent, self.reps, self.sets, self.root, self.shingles = percent, [], [], {}, None

    def add(self, rep: int, s: np.ndarray) -> None:
        self.reps.append(rep)
        self.sets.append(s)

    def _find(self, x: int) -> int:
        root = self.root.setdefault(x, x)
        while root != self.root[root]:
            self.root[root] = self.root[self.root[root]]
            root = self.root[root]
        self.root[x] = root
        return root

    def links(self, rep: int, s: np.ndarray) -> Iterator[int]:
        """The members that rep is linked with and not joined with yet."""
        if self.shingles is None:
            self.sizes = np.array([len(x) for x in self.sets], np.int64)
            owners = np.repeat(np.arange(len(self.sets)), self.sizes)
            every = np.concatenate([np.zeros(0, np.uint64), *self.sets])
            order = np.argsort(every, kind="stable")
            self.shingles, self.owners, self.sets = every[order], owners[order], []
        first, last = np.searchsorted(self.shingles, s, "left"), np.searchsorted(self.shingles, s, "right")
        n = last - first
        places = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.bincount(self.owners[places], minlength=len(self.sizes))
        near = np.flatnonzero((shared > 0) & (shared * 100 >= (self.sizes + len(s) - shared) * self.percent))
        for other in (self.reps[i] for i in near.tolist()):
            x, y = self._find(other), self._find(rep)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                yield other


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(rep, component) of representatives that are linked with others, after more links."""
    if labels is not None:
        for x in "ab":
            known = labels.select(F.col("rep").alias(x), F.col("component").alias("c"))
            links = links.join(known, x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    links = cut(links.select("a", "b").distinct(), "links")
    if links.isEmpty():
        return labels
    joined = components(links)
    if labels is None:
        return cut(joined.select(F.col("node").alias("rep"), "component"), "labels")
    moved = labels.join(joined, labels["component"] == joined["node"], "left").select("rep", F.coalesce(joined["component"], labels["component"]).alias("component"))
    new = joined.join(labels, joined["node"] == labels["rep"], "left_anti").select(F.col("node").alias("rep"), "component")
    return cut(moved.unionByName(new), "labels")


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    k: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    matches: int = MATCHES,
    leaders: int = LEADERS,
) -> DataFrame:
    """One row per row of docs: id (long), text_hash, n (set size), component (smallest id reachable), kept (id = component)."""
    ship(spark)
    feats = cut(features(docs, k, id_col, text_col), "minhash")
    classes = feats.filter("n > 0 and id is not null").groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "s1", "s2", "signature")).alias("s"))
    reps = cut(classes.select("d1", "d2", F.col("s.id").alias("rep"), "s.n", "s.s1", "s.s2", "s.signature"), "classes")
    lists = cut(prefix_lists(reps, matches), "lists")
    like = near(percent, matches)
    led = cut(_leaders(lists, leaders, like), "led")
    labels = _merged(None, confirm(docs, reps, led.select("block", F.col("block").alias("rep")).distinct(), led, k, percent, id_col, text_col))
    few, many = _others(lists, labels, like)
    labels = _merged(labels, confirm(docs, reps, few, cut(many, "many"), k, percent, id_col, text_col))
    member = feats.drop("signature").join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left")
    member = member.join(labels, "rep", "left") if labels is not None else member.withColumn("component", F.col("rep"))
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return member.select("id", "text_hash", "n", component.alias("component")).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def keep_one(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one that gives the component its name."""
    gone = near_duplicates(spark, docs, k, percent, id_col, text_col).filter("not kept").select(F.col("id").alias("__id"), F.col("text_hash").alias("__text_hash")).distinct()
    return docs.join(gone, (docs[id_col] == gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__text_hash"]), "left_anti")
