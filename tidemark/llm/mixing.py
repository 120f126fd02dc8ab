"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources in code point order (null last) get the given weights in rotation and share `share` of all sizes. A
target stops at `most` times its source's size and the excess is shared again by weight until none is above. That fixed
point is target = min(level * weight, cap); the level follows from the sources sorted by cap/weight.

Curriculum: source s has a weight schedule w(t) = weight * (1 + slope * (2t - 1)) over training time t in [0, 1]. Its integral,
scaled to the target, is the source's cumulative token demand D(t), with D(1) = target. Its documents lie in a fixed
pseudo-random order along that demand, epoch after epoch. Inverting D at the midpoint of a document in an epoch gives its
training position; where D never gets there, the document isn't played in that epoch. The plays of all sources are
range-sorted by position, and a running sum over that order gives each play the number of words before it. What a document's
plays amount to is what the mix takes of it.

Only DataFrame functions run here. A running sum over a hot source, or over the whole schedule, is split: bucket totals first,
then the order inside each bucket. Null text has size 0; sources of size 0 get target 0 and aren't played; an empty table gives
an empty result; rows that repeat an identifier are separate documents. Only the named columns are read; others may have any
names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.runtime import cut, in_files, located

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (0.5, 0.0, -0.5)
BUCKET_DIGITS = 3  # hexadecimal digits of the order key: 4,096 buckets a source
RANGES = 4_096  # of training positions
FEW_FILES = 1_000_000  # rows that may be broadcast: 16 MB


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def rotating(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sized: DataFrame, weights: Sequence[float], slopes: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: source_size, weight, slope, target. The windows here run over one row per source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("rank", rank).withColumn("weight", rotating(F.col("rank"), weights)).withColumn("slope", rotating(F.col("rank"), slopes))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("level_here", level)
    # The level is the one at the first source that doesn't reach its cap.
    s = s.withColumn("level", F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level_here"))).over(everything)["level_here"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", "slope", target.alias("target"))


def position(demand: Column, target: Column, slope: Column) -> Column:
    """The t in [0, 1] with D(t) = demand, where D(t) = target * ((1 - slope) t + slope t^2); null where D(1) = target isn't above it."""
    a, u = 1 - slope, demand / target
    return F.when(demand < target, F.when(slope == 0, u).otherwise((F.sqrt(a * a + 4 * slope * u) - a) / (2 * slope)))


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    slopes: Sequence[float] = SLOPES,
    share: float = 1.5,
    most: int = 2,
) -> DataFrame:
    """A row for each play of a row of docs (its locator is file, at): id, source, size, source_size, target, epoch, position, and start, the words
    that are played before it. A row that isn't played has one row here, with null epoch, position and start."""
    if not all(-1 <= x <= 1 for x in slopes):
        raise ValueError("a slope beyond -1 to 1 makes a weight negative")
    get = F.col("row")
    sized = docs.select("file", "at", get[id_col].alias("id"), get[source_col].alias("source"), size_of(get[text_col]).alias("size"), order_key(get[id_col]).alias("order_key"))
    sized = sized.withColumn("bucket", F.substring("order_key", 1, BUCKET_DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    base = F.coalesce(F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    goals = targets(buckets, weights, slopes, share, most)
    based = buckets.select("source", "bucket", base.alias("base"))
    facts = based.join(goals, based["source"].eqNullSafe(goals["source"])).drop(goals["source"])
    inside = W.partitionBy("source", "bucket").orderBy("order_key", "id", "size", "file", "at").rowsBetween(W.unboundedPreceding, -1)
    within = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    row = within.join(facts, within["source"].eqNullSafe(facts["source"]) & (within["bucket"] == facts["bucket"])).drop(facts["source"], facts["bucket"])
    mid = F.col("base") + F.col("within") + F.col("size") / 2
    every = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda e: F.struct(e.alias("epoch"), position(mid + e * F.col("source_size"), F.col("target"), F.col("slope")).alias("position")))
    plays = F.filter(every, lambda p: (F.col("size") > 0) & p["position"].isNotNull())
    row = row.select("file", "at", "id", "source", "size", "source_size", "target", "order_key", F.explode_outer(plays).alias("play")).select("*", "play.*").drop("play")
    # The order of the whole schedule: ranges of positions, then the places inside each. What isn't played is spread over ranges of its own.
    idle = -1 - F.pmod(F.xxhash64("file", "at"), F.lit(RANGES))
    span = F.when(F.col("position").isNull(), idle).otherwise(F.least(F.floor(F.col("position") * RANGES), F.lit(RANGES - 1)))
    row = row.withColumn("span", span.cast("int"))
    totals = row.filter("span >= 0").groupBy("span").agg(F.sum("size").alias("words"))
    first = totals.select("span", F.coalesce(F.sum("words").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # RANGES rows at most
    here = W.partitionBy("span").orderBy("position", "order_key", "id", "epoch", "file", "at").rowsBetween(W.unboundedPreceding, -1)
    row = row.withColumn("here", F.coalesce(F.sum("size").over(here), F.lit(0))).join(F.broadcast(first), "span", "left")
    return row.withColumn("start", F.col("first") + F.col("here")).drop("span", "first", "here", "order_key")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken (the words of its plays), epochs (their number), first_start (the words
    played before the first; null if there is none)."""
    plays = schedule(located(docs), id_col, text_col, source_col, **options)
    keys = ("id", "source", "size", "source_size", "target")
    played = F.when(F.col("position").isNotNull(), F.col("size")).otherwise(0)
    found = plays.groupBy("file", "at").agg(*[F.first(c).alias(c) for c in keys], F.sum(played).alias("taken"), F.count("position").alias("epochs"), F.min("start").alias("first_start"))
    return found.select(*keys, "taken", "epochs", "first_start")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False, **options) -> DataFrame:
    """docs as the curriculum plays them: a row for each time a document is taken, range-sorted by training position. Written as files, their order is
    that of the files' names and of the rows in each. With keep, the columns row (a struct of docs' columns), start, position and epoch."""
    rows = located(docs)
    plays = schedule(rows, id_col, text_col, source_col, **options).filter("position is not null").select("file", "at", "start", "position", "epoch")
    played = rows.join(plays, ["file", "at"]).orderBy("start")
    return played.select("row", "start", "position", "epoch") if keep else played.select("row.*")


def read_order(docs: DataFrame) -> DataFrame:
    """(row, position): a training order that was written as files, each row (a struct) with its place in it. Parts follow by their numbers, rows as they
    stand in a part; a table that isn't read from files is taken in the order of its partitions."""
    rows = in_files(docs)
    counts = cut(rows.groupBy("part", "piece").agg(F.count("*").alias("n")), "parts")
    before = F.coalesce(F.sum("n").over(W.orderBy("part", "piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    firsts = counts.select("part", "piece", before.alias("first"))
    if counts.count() <= FEW_FILES:
        firsts = F.broadcast(firsts)
    return rows.join(firsts, ["part", "piece"]).select("row", (F.col("first") + F.col("at")).alias("position"))
