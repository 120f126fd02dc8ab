"""Document quality by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. FILTERS learned filters of WIDTH bytes slide over each
chunk, byte by byte; the first layer is a table (place in the filter, byte) -> FILTERS numbers, which is an embedding and a
convolution in one. Each filter's greatest response in a chunk is squashed; the mean and the greatest of a document's chunks go
through a logistic layer, which gives one probability.

Training is on the driver, over a bounded sample of whole documents: for each label one of each of BUCKETS hash buckets, chosen
by hash among those of up to USUAL bytes, or the shortest where there is none. Documents whose crc32(doc_id as text) mod 5 is 0
are never learned from. Identifiers of both tables are compared as text, so their types may differ. Scoring reads whole texts.

Null text counts as empty; an empty text is one chunk of padding and gets a score like any other. With one label or none to
learn, every score is that label's share (0.5 without labels). An empty table gives an empty result. A row is scored each
time it occurs; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.language_id import held_out
from tidemark.llm.runtime import ship
from tidemark.llm.words import slices

FILTERS, WIDTH = 16, 8
CHUNK, OVERLAP = 512, 64
BUCKETS, USUAL, EPOCHS, BATCH, SEED = 512, 8_192, 12, 64, 7
STEP = 32  # chunks whose responses are held at a time
THRESHOLD = 0.3
PAD = 256  # the byte after the end of a text


def chunked(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk, CHUNK) bytes with padding, and the text of each chunk. Every text has one chunk at least."""
    sizes = np.diff(offs)
    step = CHUNK - OVERLAP
    n = 1 + np.maximum(0, -(-(sizes - CHUNK) // step))
    doc = np.repeat(np.arange(len(sizes)), n)
    start = offs[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
    size = np.minimum(CHUNK, offs[doc + 1] - start)
    at = np.minimum(start[:, None] + np.arange(CHUNK), max(0, len(buf) - 1))
    if not len(buf):
        return np.full((len(doc), CHUNK), PAD, np.int16), doc
    return np.where(np.arange(CHUNK) < size[:, None], buf[at].astype(np.int16), np.int16(PAD)), doc


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.3, (WIDTH, PAD + 1, FILTERS)).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.3, 2 * FILTERS).astype(np.float32)
        self.bias = np.float32(0)

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, place, filter)"""
        places = chunks.shape[1] - WIDTH + 1
        total = self.table[0][chunks[:, :places]]
        for k in range(1, WIDTH):
            total += self.table[k][chunks[:, k : k + places]]
        return total

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest response of each filter in each chunk, squashed; and where it is."""
        best, where = [], []
        for i in range(0, len(chunks), STEP):
            r = self.responses(chunks[i : i + STEP])
            where.append(r.argmax(axis=1))
            best.append(np.take_along_axis(r, where[-1][:, None], 1)[:, 0])
        return np.tanh(np.concatenate(best) + self.shift), np.concatenate(where)

    def fixed(self) -> Network:
        """Ready to score: the tables of neighbouring places are added up for each pair of bytes."""
        self.pairs = [(self.table[k][:, None] + self.table[k + 1][None]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)]
        return self

    def greatest(self, chunks: np.ndarray) -> np.ndarray:
        """What pooled gives first, by pairs of bytes: half the look-ups."""
        out, places = [], chunks.shape[1] - WIDTH + 1
        for i in range(0, len(chunks), STEP):
            c = chunks[i : i + STEP].astype(np.int32)
            pair = c[:, :-1] * (PAD + 1) + c[:, 1:]
            total = self.pairs[0].take(pair[:, :places], axis=0)
            for k in range(1, WIDTH // 2):
                total += self.pairs[k].take(pair[:, 2 * k : 2 * k + places], axis=0)
            out.append(total.max(axis=1))
        return np.tanh(np.concatenate(out) + self.shift)

    def combine(self, p: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of chunks (doc ascending): features and probability; and the chunks of each text."""
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        n = np.diff(np.append(first, len(doc)))
        features = np.hstack([np.add.reduceat(p, first) / n[:, None], np.maximum.reduceat(p, first)])
        return features, 1 / (1 + np.exp(-np.clip(features @ self.out + self.bias, -30, 30))), n

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        chunks, doc = chunked(buf, offs)
        return self.combine(self.greatest(chunks), doc)[1]

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean weighted log loss, by table, shift, out and bias; that of a maximum goes to the place where it was."""
        p, where = self.pooled(chunks)
        features, prob, n = self.combine(p, doc)
        error = ((prob - labels) * weight / len(labels)).astype(self.table.dtype)
        to_features = error[:, None] * self.out
        peak = features[:, FILTERS:]
        top = np.flatnonzero(np.diff(doc, prepend=-1))
        first = np.zeros_like(p, bool)  # of equal chunks only the first has the maximum
        for d, (a, b) in enumerate(zip(top, np.append(top[1:], len(doc)), strict=True)):
            first[a + (p[a:b] == peak[d]).argmax(axis=0), np.arange(FILTERS)] = True
        to_p = to_features[doc, :FILTERS] / n[doc, None] + to_features[doc, FILTERS:] * first
        to_r = to_p * (1 - p * p)
        grad = np.zeros_like(self.table)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            seen = np.take_along_axis(chunks, where + k, 1).astype(np.int64)
            grad[k] += np.bincount((seen * FILTERS + filters).ravel(), to_r.ravel(), (PAD + 1) * FILTERS).reshape(PAD + 1, FILTERS)
        return [grad, to_r.sum(axis=0), error @ features, error.sum()]

    def learn(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam, with both labels weighed alike."""
        r = np.random.default_rng(SEED)
        data = [chunked(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
        params = [self.table, self.shift, self.out]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                doc = np.repeat(np.arange(len(pick)), [len(data[k]) for k in pick])
                *grads, bias = self.gradients(np.concatenate([data[k] for k in pick]), doc, labels[pick], weight[pick])
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
                self.bias -= np.float32(rate * bias)
        # The bias puts the true share back.
        share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.bias += np.float32(np.log(share / (1 - share)))


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return np.full(len(offs) - 1, self.value)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[int, bytes]]:
    """(label, whole text): BUCKETS texts of each label at most."""
    known = labels.select(F.col(id_col).cast("string").alias("key"), F.col(label_col).cast("int").alias("label"), held_out(F.col(id_col)).alias("out"))
    known = known.filter(F.col("label").isin(0, 1) & ~F.col("out") & F.col("key").isNotNull()).select("key", "label").distinct()
    rows = docs.select(F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).filter("key is not null")
    rows = rows.select("key", F.xxhash64("key", "text").alias("h"), F.length("text").alias("n"), "text")
    bucket = F.pmod("h", F.lit(BUCKETS)).alias("bucket")
    picks = rows.select("key", "h", "n").join(known, "key").groupBy("label", bucket).agg(F.min(F.struct(F.greatest("n", F.lit(USUAL)), "h")).alias("pick"))
    found = rows.join(F.broadcast(picks.select("label", "pick.h")), "h").select("label", "h", "text").distinct()  # 2 * BUCKETS rows
    return sorted((int(r.label), bytes(r.text)) for r in found.collect())


def train(sample: list[tuple[int, bytes]]) -> Network | Constant:
    labels = np.array([y for y, _ in sample], np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Constant(float(labels.mean()) if len(labels) else 0.5)
    net = Network()
    net.learn([t for _, t in sample], labels)
    return net.fixed()


def scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    ship(spark)
    data = spark.sparkContext.broadcast(pickle.dumps(train(labelled_sample(docs, labels, id_col, text_col, label_col))))
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network_of(data.value)
        for batch in batches:
            for i, j, buf, offs in slices(batch.column("text"), 1 << 20):
                s = net.score(buf, offs).astype(np.float64)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def network_of(data: bytes) -> Network | Constant:
    """One a worker process."""
    key = hashlib.sha256(data).digest()
    held = sys.__dict__.setdefault("_tidemark_quality", {})
    if key not in held:
        held.clear()
        held[key] = pickle.loads(data)
    return held[key]
