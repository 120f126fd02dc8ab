"""Exact deduplication as a stateful stream.

Each text becomes an event (digest, identifier, content locator). A streaming aggregation keyed by the digest keeps, in the
disk-backed RocksDB state store and without expiry, the identifier and locator of the row that stays and the number of rows
seen. Events come in slices, each a micro-batch that finds the state of those before it. After each, the digests that it hit
(more than one row so far) are checked by full bytes: its texts against each other and against the text at the locator that
the state holds. So equal digests alone decide nothing; texts that share a digest are told apart by their bytes.

With a home of its own, a folder that lives on, the state outlasts the call: the rows of a later table are judged against all
rows before them (bytes are compared within a table; an earlier table's files are not read again). The checkpoint records what
the state has taken in, and a micro-batch that is run again overwrites its groups.

Null text counts as empty. Of equal texts the row with the largest identifier stays (a null identifier is below all others);
of rows that repeat it, the one with the largest locator (file and row). An empty table gives an empty result. Other columns
are not looked at, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.runtime import cut, fresh_path, located

STATE = "spark.sql.streaming.stateStore"
STORE = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.allowFAllocate": "false",  # many small stores: no megabytes set aside for each one's logs
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",  # by all stores of an executor together; else each may fill 64 MB
    f"{STATE}.rocksdb.maxMemoryUsageMB": "256",
}
SLICES = 2
FEW = 1_000_000  # locators that may be broadcast: 40 MB


def readings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, digest, file, at) of rows with a locator."""
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    return docs.select(F.col("row")[id_col].alias("id"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), "file", "at")


def dedup_stream(events: DataFrame) -> DataFrame:
    """The keyed state over a streaming (or batch) table of events: who stays, and how many rows there are."""
    return events.groupBy("digest").agg(F.max(F.struct("id", "file", "at")).alias("stays"), F.count("*").alias("group_size"))


def run_stream(spark: SparkSession, home: str, schema) -> None:
    """Take the events that are new in home/events through the state store. Each micro-batch writes the groups it changed; a repeated batch overwrites
    itself."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            dedup_stream(spark.readStream.schema(schema).parquet(f"{home}/events"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/state")
            .trigger(availableNow=True)
            .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{home}/groups/batch={n}"))
            .start()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()


def groups_of(spark: SparkSession, home: str) -> DataFrame:
    """The newest state of each digest: digest, stays, group_size."""
    return spark.read.option("basePath", f"{home}/groups").parquet(f"{home}/groups").groupBy("digest").agg(F.max(F.struct("group_size", "stays")).alias("g")).select("digest", "g.stays", "g.group_size")


def unequal(rows: DataFrame, events: DataFrame, groups: DataFrame) -> DataFrame:
    """The digests that these events hit, and that stand for more than one text: events' texts and the text of the row that stays, by their bytes."""
    hits = groups.filter("group_size > 1").join(events.select("digest").distinct(), "digest", "left_semi")
    places = cut(events.join(hits, "digest", "left_semi").select("file", "at").unionByName(hits.select("stays.file", "stays.at")).distinct(), "dedup-hits")
    if places.count() <= FEW:
        places = F.broadcast(places)
    texts = rows.join(places, ["file", "at"], "left_semi").groupBy("digest")  # partial sums: one text a task of each group
    return texts.agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", home: str | None = None, slices: int = SLICES) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, and the locator (file, at). home: where the state lives on; by default it
    is this call's own."""
    return _decide(spark, readings(located(docs), id_col, text_col), home, slices)


def _decide(spark: SparkSession, rows: DataFrame, home: str | None = None, slices: int = SLICES) -> DataFrame:
    home = home.rstrip("/") if home else fresh_path(spark, "dedup")
    events = cut(rows.select("id", "digest", "file", "at", F.pmod(F.xxhash64("file", "at", F.lit(1)), F.lit(slices)).cast("int").alias("slice")), "dedup-events")
    if events.isEmpty():
        return events.select("id", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"), "file", "at")
    doubtful = []
    for n in range(slices):
        own = events.filter(F.col("slice") == n).drop("slice")
        own.write.mode("append").parquet(f"{home}/events")
        run_stream(spark, home, own.schema)
        doubtful.append(cut(unequal(rows, own, groups_of(spark, home)), "dedup-unequal"))
    doubtful = [d for d in doubtful if not d.isEmpty()]
    groups = cut(groups_of(spark, home), "dedup-groups")
    events = events.drop("slice")
    if doubtful:
        split = doubtful[0]
        for d in doubtful[1:]:
            split = split.union(d)
        split = split.distinct()
        groups = _by_bytes(rows, groups, split)
        bytes_of = F.col("text").alias("bytes")
        events = rows.select("id", "digest", "file", "at", bytes_of).join(split, "digest", "left_semi").unionByName(events.join(split, "digest", "left_anti").withColumn("bytes", F.lit(None).cast("string")))
        own = groups.select(F.col("digest").alias("group_digest"), F.col("bytes").alias("group_bytes"), "stays", "group_size")
        found = events.join(own, (F.col("digest") == F.col("group_digest")) & F.col("bytes").eqNullSafe(F.col("group_bytes")))
    else:
        found = events.join(groups, "digest")
    same = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("file") == F.col("stays.file")) & (F.col("at") == F.col("stays.at"))
    return found.select("id", F.col("stays.id").alias("keep_id"), "group_size", same.alias("kept"), F.col("digest").alias("text_sha256"), "file", "at")


def _by_bytes(rows: DataFrame, groups: DataFrame, split: DataFrame) -> DataFrame:
    """Groups of digests that different texts share, keyed by the text itself."""
    own = rows.join(split, "digest", "left_semi").groupBy("digest", F.col("text").alias("bytes")).agg(F.max(F.struct("id", "file", "at")).alias("stays"), F.count("*").alias("group_size"))
    return groups.join(split, "digest", "left_anti").withColumn("bytes", F.lit(None).cast("string")).select("digest", "bytes", "stays", "group_size").unionByName(own)


def drop_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", home: str | None = None, slices: int = SLICES) -> DataFrame:
    """docs without the rows that exact_dedup drops."""
    rows = located(docs)
    gone = _decide(spark, readings(rows, id_col, text_col), home, slices).filter("not kept").select("file", "at")
    return rows.join(gone, ["file", "at"], "left_anti").select("row.*")
