"""Free text against a controlled taxonomy: hashed n-gram vectors, closest anchor, movement of themes between periods."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tidemark.functions.exprs import is_blank, md5_bucket, month_of, ngrams, or_missing, safe_ratio, tokens
from tidemark.operators import periods
from tidemark.operators.metrics import with_account_columns
from tidemark.sources.tables import scratch

Tables = Mapping[str, DataFrame]
Taxonomy = Mapping[str, Sequence[str]]
Embedder = Callable[[Sequence[str]], np.ndarray]
UNCLEAR, DIMS, NGRAMS = "unclear_or_other", 512, (1, 2)
SEGMENTS = ("merchant_category", "channel", "customer_segment", "fico_band")

TAXONOMY: dict[str, tuple[str, ...]] = {
    "unknown_merchant": ("I do not recognise this charge and the merchant name means nothing to me.", "I cannot tell which shop is behind the name on my statement."),
    "travel_charged_twice": ("My hotel or flight was charged twice.", "The same travel booking shows up two times on my card."),
    "foreign_fee": ("A foreign transaction fee was added and nobody explained why.", "I paid abroad and found a fee I did not expect."),
    "app_dispute_trouble": ("The app does not let me send or follow my dispute.", "The dispute I filed on my phone still shows no status."),
    "slow_dispute": ("My dispute has been open for weeks and I hear nothing.", "It takes too long to decide my dispute."),
    "autopay_failed": ("Autopay failed and I was marked as late.", "The payment I scheduled on my phone came back."),
    "fraud_worry": ("I got a fraud alert and think somebody used my account.", "My card was declined and then an unknown charge followed."),
    UNCLEAR: ("I need help to understand my account.", "I have a general question."),
}


def facts(tables: Tables) -> DataFrame:
    """Complaints with month, text and segments; blank segments are a bucket of their own."""
    rows = with_account_columns(tables["complaints"].withColumn("month", month_of(F.col("date_received"))), tables.get("accounts"), ("product_type", "region"))
    segments = [c for c in (*SEGMENTS, "product_type", "region") if c in rows.columns]
    return rows.select("complaint_id", "account_id", F.col("date_received").alias("complaint_date"), "month", F.col("complaint_narrative").alias("narrative"), "issue", "submitted_via", *[or_missing(rows, c).alias(c) for c in segments])


def terms(text: Column, sizes: Sequence[int] = NGRAMS) -> Column:
    """Words and runs of words."""
    return ngrams(tokens(text), *sizes)


def sparse_vectors(rows: DataFrame, key: str, text: str, dims: int = DIMS) -> DataFrame:
    """key, bucket, weight: counts of hashed terms. Stays in the JVM; texts without terms have no rows."""
    return rows.select(key, F.explode(F.transform(terms(F.col(text)), lambda t: md5_bucket(t, dims))).alias("bucket")).groupBy(key, "bucket").agg(F.count("*").alias("weight"))


def anchors(rows: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    """theme, place (of the theme), anchor, text: as many rows as the taxonomy has sentences."""
    data = [(theme, i, f"{i}.{j}", text) for i, (theme, texts) in enumerate(taxonomy.items()) for j, text in enumerate(texts)]
    return rows.sparkSession.createDataFrame(data, "theme string, place int, anchor string, text string")


def with_closest(rows: DataFrame, text: str, taxonomy: Taxonomy, dims: int = DIMS) -> DataFrame:
    """rows with _theme and _s, the closest theme and its similarity; null for texts without terms. All of it is computed within the row: no shuffle.

    The anchors are a few dozen sentences. Their counts come to the driver and go into the plan as one array, anchor after anchor. A text's dot product
    with an anchor is the sum of the anchor's counts over the text's terms; its own squared norm is summed over its sorted buckets, run by run.
    """
    if not taxonomy:
        raise ValueError("a taxonomy needs one theme at least")
    named = anchors(rows, taxonomy)
    listed = named.collect()
    counts = np.zeros((len(listed), dims), np.int64)
    at = {r.anchor: i for i, r in enumerate(listed)}
    for r in sparse_vectors(named, "anchor", "text", dims).collect():
        counts[at[r.anchor], r.bucket] = r.weight
    norms = np.sqrt((counts * counts).sum(axis=1).astype(float)).tolist()
    table, used = F.lit(counts.ravel()), F.lit(counts.sum(axis=0))

    def grown(state: Column, bucket: Column) -> Column:
        n = F.when(state["last"] == bucket, state["n"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(bucket.alias("last"), n.alias("n"), (state["total"] + 2 * n - 1).alias("total"))

    nothing = F.struct(*[F.lit(x).cast("long").alias(name) for name, x in (("last", -1), ("n", 0), ("total", 0))])
    squares = F.aggregate(F.sort_array("_v"), nothing, grown, lambda state: state["total"])
    dot = lambda i: F.aggregate("_known", F.lit(0).cast("long"), lambda total, b: total + F.get(table, (b + i * dims).cast("int")))
    # (-similarity, place) least: the closest theme, of equals the first.
    each = [F.struct((-(dot(i).cast("double") / (F.col("_norm") * norms[i]))).alias("n"), F.lit(r.place).alias("place"), F.lit(r.theme).alias("theme")) for i, r in enumerate(listed) if norms[i]]
    best = F.array_min(F.array(*each)) if each else F.lit(None).cast("struct<n: double, place: int, theme: string>")
    v = F.transform(terms(F.col(text)), lambda t: md5_bucket(t, dims).cast("long"))
    made = rows.withColumn("_v", v).withColumn("_known", F.filter("_v", lambda b: F.get(used, b.cast("int")) > 0)).withColumn("_norm", F.sqrt(squares.cast("double")))
    # As an array of one that is exploded: a filter on the theme isn't pushed below, where everything would be computed again for it.
    made = made.withColumn("_best", F.explode(F.array(F.when(F.size("_v") > 0, best))))
    return made.withColumns({"_theme": F.col("_best.theme"), "_s": -F.col("_best.n")}).drop("_v", "_known", "_norm", "_best")


def _fallback(taxonomy: Taxonomy) -> str:
    return UNCLEAR if UNCLEAR in taxonomy else list(taxonomy)[-1]


def assign(rows: DataFrame, taxonomy: Taxonomy = TAXONOMY, min_similarity: float | None = None, embedder: Embedder | None = None, key: str = "complaint_id", text: str = "narrative", dims: int = DIMS) -> DataFrame:
    """rows with theme_name, theme_similarity, embedding_backend. Ties go to the theme listed first; text without signal to the fallback."""
    last = _fallback(taxonomy)
    if embedder is None:
        found, backend = with_closest(rows, text, taxonomy, dims), "hashing_md5"
    else:
        found, backend = _with_embedder(rows, taxonomy, embedder, text), getattr(embedder, "name", "injected")
    signal = ~is_blank(found, text) & F.col("_s").isNotNull()
    score = F.when(signal, F.col("_s")).otherwise(0.0)
    name = F.when(signal, F.col("_theme")).otherwise(last)
    if min_similarity is not None:
        name = F.when(score >= min_similarity, name).otherwise(last)
    return found.select(*rows.columns, name.alias("theme_name"), score.alias("theme_similarity"), F.lit(backend).alias("embedding_backend"))


def _vectors(embedder: Embedder, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero where there is no signal) and their lengths before."""
    vectors = np.asarray(embedder(texts), float)
    if len(vectors) != len(texts):
        raise ValueError(f"the embedder gave {len(vectors)} vectors for {len(texts)} texts")
    norms = np.linalg.norm(vectors, axis=1) if len(texts) else np.zeros(0)
    return vectors / np.where(norms > 0, norms, 1)[:, None] if len(texts) else vectors, norms


def _with_embedder(rows: DataFrame, taxonomy: Taxonomy, embedder: Embedder, text: str) -> DataFrame:
    """Closest themes by any function from texts to vectors, called on Arrow batches; the taxonomy's sentences are embedded once."""
    names = list(taxonomy)
    owner = np.array([i for i, n in enumerate(names) for _ in taxonomy[n]])
    unit = rows.sparkSession.sparkContext.broadcast(_vectors(embedder, [s for n in names for s in taxonomy[n]])[0])

    def closest(texts: pd.Series) -> pd.DataFrame:
        given, norms = _vectors(embedder, texts.fillna("").astype(str).tolist())
        if not len(given):
            return pd.DataFrame({"theme": pd.Series(dtype=str), "s": pd.Series(dtype=float)})
        sims = given @ unit.value.T
        per_theme = np.column_stack([sims[:, owner == i].max(axis=1) for i in range(len(names))])
        best = per_theme.argmax(axis=1)
        return pd.DataFrame({"theme": [names[i] for i in best], "s": np.where(norms > 0, per_theme[np.arange(len(best)), best], np.nan)})

    kind = T.StructType([T.StructField("theme", T.StringType()), T.StructField("s", T.DoubleType())])
    return rows.withColumn("_e", F.pandas_udf(closest, kind)(F.col(text))).withColumns({"_theme": F.col("_e.theme"), "_s": F.when(~F.isnan("_e.s"), F.col("_e.s"))}).drop("_e")


def blake2_embedder(dims: int = DIMS, sizes: Sequence[int] = NGRAMS) -> Embedder:
    """Counts of terms hashed by 8 bytes of BLAKE2b, big-endian, modulo dims."""
    import re

    if dims < 1:
        raise ValueError(f"dims must be positive, not {dims}")

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        for row, text in enumerate(texts):
            words = re.findall(r"[a-z0-9]+", text.lower())
            for n in sizes:
                for i in range(len(words) - n + 1):
                    digest = hashlib.blake2b(" ".join(words[i : i + n]).encode(), digest_size=8).digest()
                    out[row, int.from_bytes(digest, "big") % dims] += 1
        return out

    embed.name = "hashing_blake2b"
    return embed


def sentence_model(name: str) -> Embedder:
    """A sentence-transformers model on local disk, loaded where it runs; never downloaded."""

    def embed(texts: Sequence[str]) -> np.ndarray:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(name, local_files_only=True).encode(list(texts))

    embed.name = name
    return embed


def resolve_embedder(embedder: Embedder | None = None, model: str | None = None) -> Embedder | None:
    """The one handed in, else the model asked for, else None: hashing inside the JVM."""
    return embedder or (sentence_model(model) if model else None)


def _movement(rows: DataFrame, skeleton: DataFrame, keys: Sequence[str], current: str, previous: str, within: Sequence[str]) -> DataFrame:
    inside = rows.filter(F.col("month").isin(current, previous))
    part = lambda m: F.sum(F.when(F.col("month") == m, 1).otherwise(0))
    counted = inside.groupBy(*keys).agg(part(previous).alias("previous_complaints"), part(current).alias("current_complaints"), F.avg("theme_similarity").alias("avg_similarity"))
    full = skeleton.join(counted, list(keys), "left").na.fill(0, ["previous_complaints", "current_complaints"])
    group = W.partitionBy(*within)
    was, now = (safe_ratio(F.col(c), F.sum(c).over(group)) for c in ("previous_complaints", "current_complaints"))
    change = F.col("current_complaints") - F.col("previous_complaints")
    return full.select(*keys, "previous_complaints", "current_complaints", change.alias("complaint_change"), was.alias("previous_share"), now.alias("current_share"), (now - was).alias("share_change"), "avg_similarity")


def _themes(rows: DataFrame, taxonomy: Taxonomy) -> DataFrame:
    return rows.sparkSession.createDataFrame([(t,) for t in taxonomy], "theme_name string")


def summary(labelled: DataFrame, current: str, previous: str, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Every theme, also those without a complaint."""
    return _movement(labelled, _themes(labelled, taxonomy), ["theme_name"], current, previous, []).orderBy(F.desc("complaint_change"), "theme_name")


def by_segment(labelled: DataFrame, current: str, previous: str, fields: Sequence[str] = ("merchant_category", "channel"), taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Every theme in every value of every field that occurs in the two periods."""
    unknown = [c for c in fields if c not in labelled.columns]
    if unknown:
        raise KeyError(f"segment fields {unknown} aren't in these complaints")
    cut = F.explode(F.array(*[F.struct(F.lit(c).alias("segment_name"), F.col(c).alias("segment_value")) for c in fields])).alias("s")
    rows = labelled.filter(F.col("month").isin(current, previous)).select("month", "theme_name", "theme_similarity", cut).select("month", "theme_name", "theme_similarity", "s.*")
    skeleton = rows.select("segment_name", "segment_value").distinct().join(F.broadcast(_themes(labelled, taxonomy)))
    found = _movement(rows, skeleton, ["segment_name", "segment_value", "theme_name"], current, previous, ["segment_name", "segment_value"])
    return found.orderBy("segment_name", F.desc("complaint_change"), "segment_value", "theme_name")


def representatives(labelled: DataFrame, n: int = 3, period: str | None = None) -> DataFrame:
    """The n complaints of each theme that are closest to it."""
    if n < 1:
        raise ValueError(f"n must be positive, not {n}")
    rows = labelled if period is None else labelled.filter(F.col("month") == period)
    rank = F.row_number().over(W.partitionBy("theme_name").orderBy(F.desc("theme_similarity"), "complaint_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("theme_name", "rank", "complaint_id", "month", F.col("theme_similarity").alias("similarity"), "issue", *[c for c in ("merchant_category", "channel") if c in rows.columns], "narrative").orderBy("theme_name", "rank")


def clusters(labelled: DataFrame, k: int = 8, period: str | None = None, dims: int = DIMS, seed: int = 0, starts: int = 10) -> DataFrame:
    """K-means over normalised hashed vectors: size, dominant theme and most central text of each cluster. Of several starts the one with the least cost
    counts. There must be as many texts with terms (of the period, if one is given) as clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    if k < 2:
        raise ValueError(f"k must be 2 at least, not {k}")
    inside = labelled if period is None else labelled.filter(F.col("month") == period)
    made = inside.select("complaint_id", "theme_name", "theme_similarity", "narrative", terms(F.col("narrative")).alias("terms"))
    made = made.filter(F.lower("narrative").rlike("[a-z0-9]"))  # has terms; a filter on them would compute them once more
    made = Normalizer(inputCol="tf", outputCol="features").transform(HashingTF(inputCol="terms", outputCol="tf", numFeatures=dims).transform(made))
    path = scratch(labelled.sparkSession, "clusters")
    made.drop("terms", "tf").sortWithinPartitions("complaint_id").write.parquet(path)  # terms and themes once; k-means keeps the vectors itself
    made = labelled.sparkSession.read.schema(made.drop("terms", "tf").schema).parquet(path)
    there = made.count()
    if there < k:
        raise ValueError(f"{there} texts can't make {k} clusters")
    vectors = made.select("features")
    model = min((KMeans(k=k, seed=seed + i).fit(vectors) for i in range(starts)), key=lambda m: m.summary.trainingCost)
    centres = np.array(model.clusterCenters())

    @F.pandas_udf("double")
    def central(cluster: pd.Series, vectors: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", centres[cluster.to_numpy()], np.stack(vectors.to_numpy())) if len(cluster) else np.zeros(0))

    rows = model.transform(made).withColumn("dot", central("prediction", vector_to_array("features")))
    by_theme = rows.groupBy("prediction", "theme_name").agg(F.count("*").alias("n"))
    top = by_theme.groupBy("prediction").agg(F.min(F.struct((-F.col("n")).alias("m"), "theme_name")).alias("t"))
    per = rows.groupBy("prediction").agg(F.count("*").alias("complaints"), F.avg("theme_similarity").alias("avg_similarity_to_taxonomy"), F.max_by("narrative", "dot").alias("representative_narrative"))
    share = F.col("complaints") / F.sum("complaints").over(W.partitionBy())
    return per.join(top, "prediction").select(F.col("prediction").alias("cluster_id"), "complaints", share.alias("share_of_complaints"), F.col("t.theme_name").alias("dominant_theme"), (-F.col("t.m") / F.col("complaints")).alias("dominant_theme_share"), "avg_similarity_to_taxonomy", "representative_narrative").orderBy(F.desc("complaints"), "cluster_id")


@dataclass(frozen=True, eq=False)
class ThemeReport:
    current_period: str
    previous_period: str
    labelled: DataFrame
    summary: DataFrame
    by_segment: DataFrame
    representatives: DataFrame

    def release(self) -> None:
        """Let go of the labelled texts that these tables are computed from; they can still be read, from the start."""
        self.labelled.unpersist()


def report(tables: Tables, current: str | None = None, previous: str | None = None, taxonomy: Taxonomy = TAXONOMY, embedder: Embedder | None = None, min_similarity: float | None = None) -> ThemeReport:
    labelled = assign(facts(tables), taxonomy, min_similarity, resolve_embedder(embedder)).cache()  # vectors once
    current, previous = periods.resolve(labelled.select("month").distinct(), current, previous)
    fields = [c for c in ("merchant_category", "channel") if c in labelled.columns]
    return ThemeReport(current, previous, labelled, summary(labelled, current, previous, taxonomy), by_segment(labelled, current, previous, fields, taxonomy), representatives(labelled, period=current))
