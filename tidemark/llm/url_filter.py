"""URL rules as a sorted array of digests.

A rule is a verdict, a host and a path. Every rule's string (host + path) is hashed with 64-bit xxhash; the sorted keys, the
verdicts and the strings form the index: files of at most SHARD_BYTES each, cut where keys differ. Spark gives each executor one
copy of the files, and all its workers map them into memory, so the list of rules may be larger than a worker's memory. A url is
looked up under each suffix of its host at a dot and each path length that rules have; all those keys are probed with
vectorised binary searches a batch, and each hit is confirmed against the stored full string.

The longest rule that fits wins (by host + path, then by host). No rule: rule is null and the verdict is allow. A null url,
or one without "://", has an empty host and path. An empty table gives an empty result. No other column is read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.runtime import ship

MAGIC = b"TMURL001"
SHARD_BYTES = 256 << 20
_published: dict[str, set[str]] = {}
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """(host, path) as the rules see them."""
    if url is None or (at := url.find(b"://")) < 0:
        return b"", b""
    rest = url[at + 3 :]
    for stop in (b"#", b"?"):
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_lower), slash + path


def build_index(rules: Sequence[tuple[str, str, str]], most: int | None = None) -> list[bytes]:
    """The files of the index. rules: (verdict, host, path), verdict allow or block. A repeated rule keeps its last verdict."""
    by_text = {(h.encode().translate(_lower), p.encode()): v for v, h, p in rules}
    entries = sorted((xxhash.xxh64_intdigest(h + b"\0" + p), h, p, v == "block") for (h, p), v in by_text.items())
    most, files, first, size = most or SHARD_BYTES, [], 0, 0
    for i, (key, h, p, _) in enumerate(entries):
        cost = 21 + len(h) + len(p)
        if size and size + cost > most and key != entries[i - 1][0]:
            files.append(_file(entries[first:i]))
            first, size = i, 0
        size += cost
    return [*files, _file(entries[first:])]


def _file(entries: list[tuple[int, bytes, bytes, bool]]) -> bytes:
    keys = np.array([e[0] for e in entries], "<u8")
    ends = np.cumsum([0, *(len(e[1]) + len(e[2]) for e in entries)]).astype("<u8")
    host_lens = np.array([len(e[1]) for e in entries], "<u4")
    block = np.array([e[3] for e in entries], "<u1")
    labels = sorted({h.count(b".") + 1 for _, h, _, _ in entries})
    paths = sorted({len(p) for _, _, p, _ in entries})
    head = struct.pack("<8sQII", MAGIC, len(entries), len(labels), len(paths)) + np.array(labels + paths, "<u4").tobytes()
    head += b"\0" * (-len(head) % 8)
    return head + keys.tobytes() + ends.tobytes() + host_lens.tobytes() + block.tobytes() + b"".join(h + p for _, h, p, _ in entries)


class Index:
    """A mapped index file."""

    def __init__(self, path: str):
        m = self.map = np.memmap(path, np.uint8, "r")
        magic, n, n_labels, n_paths = struct.unpack("<8sQII", m[:24].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} is no url index")
        few = np.frombuffer(m, "<u4", n_labels + n_paths, 24).tolist()
        self.labels, self.paths = few[:n_labels], few[n_labels:]
        at = 24 + 4 * len(few)
        at += -at % 8
        self.keys = np.frombuffer(m, "<u8", n, at)
        self.ends = np.frombuffer(m, "<u8", n + 1, at + 8 * n)
        self.host_lens = np.frombuffer(m, "<u4", n, at + 16 * n + 8)
        self.block = np.frombuffer(m, "<u1", n, at + 20 * n + 8)
        self.text_at = at + 21 * n + 8

    def entry(self, k: int) -> tuple[bytes, bytes]:
        whole = self.map[self.text_at + int(self.ends[k]) : self.text_at + int(self.ends[k + 1])].tobytes()
        return whole[: self.host_lens[k]], whole[self.host_lens[k] :]

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in keys, entry) of all entries that have one of the keys; strings that share a key stand together."""
        if len(self.keys):
            at, after = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
            for q in np.flatnonzero(at < after).tolist():
                yield from ((q, k) for k in range(int(at[q]), int(after[q])))


def judge(files: list[Index], hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bool] | None]:
    """For each url its longest rule: (host + path, is it blocked), or None."""
    labels, lengths = (sorted({n for f in files for n in getattr(f, x)}) for x in ("labels", "paths"))
    owner, asked = [], []
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        parts = host.split(b".")
        for n in labels:
            if n <= len(parts):
                suffix = b".".join(parts[len(parts) - n :])
                for length in lengths:
                    if length <= len(path):
                        owner.append(i)
                        asked.append((suffix, path[:length]))
    found: list[tuple[bytes, bool] | None] = [None] * len(hosts)
    best: dict[int, tuple[int, int]] = {}
    keys = np.array([xxhash.xxh64_intdigest(h + b"\0" + p) for h, p in asked], np.uint64)
    for file in files if asked else ():
        for q, k in file.find(keys):
            h, p = asked[q]
            if file.entry(k) == (h, p) and best.get(owner[q], (-1, -1)) < (rank := (len(h) + len(p), len(h))):
                best[owner[q]], found[owner[q]] = rank, (h + p, bool(file.block[k]))
    return found


def publish(spark: SparkSession, files: list[bytes]) -> list[str]:
    """Hand the files to Spark, which copies them to each executor that asks; their names."""
    sc, names = spark.sparkContext, []
    known = _published.setdefault(sc.applicationId, set())
    for data in files:
        name = f"tidemark-url-{hashlib.sha256(data).hexdigest()[:32]}.idx"
        if name not in known:
            path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), name)
            with open(path, "wb") as f:
                f.write(data)
            sc.addFile(path)
            known.add(name)
        names.append(name)
    return names


def open_index(names: list[str]) -> list[Index]:
    """The mapped files, once a worker."""
    cache = sys.__dict__.setdefault("_tidemark_url_index", {})
    for n in names:
        if n not in cache:
            cache[n] = Index(SparkFiles.get(n))
    return [cache[n] for n in names]


def judge_urls(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of pages: id, host, path, rule (host + path, or null), verdict."""
    ship(spark)
    names = publish(spark, build_index(rules))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("binary").alias("url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = open_index(names)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            hosts, paths = [h for h, _ in parts], [p for _, p in parts]
            found = judge(files, hosts, paths)
            rule = [f and f[0] for f in found]
            verdict = [("block" if f[1] else "allow") if f else default for f in found]
            text = [pa.array(x, pa.binary()).cast(pa.string()) for x in (hosts, paths, rule)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *text, pa.array(verdict, pa.string())], ["id", "host", "path", "rule", "verdict"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string")
