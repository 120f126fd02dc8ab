"""Token ids as sorted-string-table shards.

Documents are range-partitioned and sorted by identifier; each partition streams into shards of bounded size. A shard is

    block* index bloom footer

A block holds records in key order: (shared, rest, value length) as varints, the key's last `rest` bytes (it shares the
first `shared` with the key before it), and the value; every RESTART-th record has its whole key. Blocks are compressed
with zstandard and carry a crc32. The sparse index has (first key, offset, length, records, tokens) of each block, the
Bloom filter 10 bits a key, and the footer of fixed length has the places of both, counts and a magic number. A lookup
reads the footer, asks the Bloom filter, finds the block by binary search and scans one block.

Keys: a byte (0 for null, 1 otherwise) and the identifier as eight big-endian bytes with the sign bit flipped, so that bytes
sort as numbers do and null comes first. Values: ids as little-endian unsigned 32-bit numbers. A repeated identifier gives
records that stand side by side, in the order of their texts' digests. Shards are written under a name of the attempt and renamed, and
the manifest names only shards whose task succeeded, so lost executors leave no half-written data behind in a result.

Null text counts as empty: the end id alone. An empty table gives no shards and an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.runtime import fresh_path, on_disk, ship

MAGIC, FOOTER = b"TMSST001", struct.Struct("<QQQQQQ8s")
RESTART, BLOCK_BYTES, SHARD_TOKENS, BITS, PROBES = 16, 256 << 10, 16 << 20, 10, 7
CACHE_BYTES, LONGEST, PORTION = 64 << 20, 256, 2 << 20


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + k * b) % bits for k in range(PROBES)]


class Writer:
    """One shard, given records in key order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.filled, self.in_block, self.block_tokens, self.last = [], 0, 0, 0, b""
        self.first: bytes | None = None
        self.index, self.keys, self.tokens, self.records = [], [], 0, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, key: bytes, value: bytes) -> None:
        """value: ids as little-endian unsigned 32-bit numbers."""
        shared = 0
        if self.in_block % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        if not self.in_block:
            self.first = key
        self.block += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.filled += len(value) + 8
        self.in_block += 1
        self.block_tokens += len(value) // 4
        self.last = key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if self.filled >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.in_block:
            return
        data = self.pack(b"".join(self.block))
        data += struct.pack("<I", zlib.crc32(data))
        self.out.write(data)
        self.index.append(b"".join((_varint(len(self.first)), self.first, struct.pack("<QIIQ", self.at, len(data), self.in_block, self.block_tokens))))
        self.at += len(data)
        self.records += self.in_block
        self.tokens += self.block_tokens
        self.block, self.filled, self.in_block, self.block_tokens = [], 0, 0, 0

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BITS * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for k in self.keys:
            for p in _bloom_places(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index)
        self.out.write(bytes(bloom))
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.records, self.tokens, MAGIC))
        self.out.close()


class Shard:
    """A written shard, read block by block."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(on_disk(path))
        self.file = fs.open_input_file(name)
        size = self.file.size()
        index_at, index_len, self.bloom_at, self.bloom_len, self.records, self.tokens, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, at, self.index = self.file.read_at(index_len, index_at), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QIIQ", raw, at + n)))
            at += n + 24
        self.unpack = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, offset, length, records, _ = self.index[k]
        raw = self.file.read_at(length, offset)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        b, at, key = self.unpack(raw[:-4]), 0, b""
        for _ in range(records):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            size, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            yield key, np.frombuffer(b, "<u4", size // 4, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        bits = self.bloom_len * 8
        return all(self.file.read_at(1, self.bloom_at + (p >> 3))[0] >> (p & 7) & 1 for p in _bloom_places(key, bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each record of that identifier."""
        key, out = key_of(doc_id), []
        if not self.may_hold(key):
            return out
        low, high = 0, len(self.index)
        while low < high:  # the first block that starts at the key or after it
            mid = (low + high) // 2
            if self.index[mid][0] < key:
                low = mid + 1
            else:
                high = mid
        for k in range(max(0, low - 1), len(self.index)):
            if self.index[k][0] > key:
                break
            out += [v for found, v in self.block(k) if found == key]
        return out


# How the tokenizer file must clean and cut texts for pieces to be encoded one by one.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same cut for lower-case Latin-1 text, and what it counts as letters, numbers and white space.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")


class PieceCache:
    """The ids, as bytes, of what the tokenizer looks at one by one.

    The tokenizer drops white space, never looks across it and encodes each match of its pattern on its own. Latin-1 text is in
    composed form already, so its matches are found in lower case; other text is cut at spaces and line feeds only. What was not
    seen before goes through the library, Latin-1 matches many at a time: the last token of each carries the end-of-word mark.
    Text with one of the tokenizer's added tokens, or a tokenizer of another kind, is left to the library. Two generations of
    at most CACHE_BYTES and one call's texts are held.
    """

    def __init__(self, tokenizer_json: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        made = json.loads(tokenizer_json)
        cut = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern")
        mark = made["model"].get("end_of_word_suffix")
        self.known = bool(mark) and (made.get("normalizer") or {}).get("normalizers") == NORMAL and cut == {"Regex": SPLIT}
        self.added = [x["content"] for x in made.get("added_tokens") or ()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if self.known:
            self.last[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
        self.held: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0

    def pieces(self, text: str) -> list[str]:
        if not self.known or (self.added and any(x in text for x in self.added)):
            return [text]
        if _latin(text):
            return LATIN.findall(text.lower())
        parts = text.replace("\n", " ").split(" ")
        return [x for p in parts for x in (LATIN.findall(p.lower()) if _latin(p) else (p,))]

    def _learn(self, pieces: set[str]) -> None:
        new = pieces.difference(self.held)
        found = {x: v for x in new if (v := self.old.get(x)) is not None}
        new.difference_update(found)
        plain = [x for x in new if self.known and len(x) <= LONGEST and _latin(x) and LATIN.fullmatch(x)]
        for i in range(0, len(plain), 4096):
            some = plain[i : i + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                found.update(zip(some, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        rest = [x for x in new if x not in found]
        for i in range(0, len(rest), 1024):
            some = rest[i : i + 1024]
            for x, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                found[x] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        self.held.update(found)
        self.size += sum(map(len, found)) + sum(map(len, found.values())) + 200 * len(found)

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """The ids of each text and the end id, as little-endian unsigned 32-bit numbers."""
        split = list(map(self.pieces, texts))
        self._learn(set().union(*split))
        get, end = self.held.__getitem__, struct.pack("<I", end_id)
        out = [b"".join(map(get, s)) + end for s in split]
        if self.size > CACHE_BYTES:
            self.old, self.held, self.size = self.held, {}, 0
        return out


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def portions(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of about `most` characters; a longer text comes alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def piece_cache(tokenizer_json: str) -> PieceCache:
    key = hashlib.sha256(tokenizer_json.encode()).digest()
    held = sys.__dict__.setdefault("_tidemark_pieces", {})
    if key not in held:
        held[key] = PieceCache(tokenizer_json)
    return held[key]


def write_shards(spark: SparkSession, docs: DataFrame, out: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Write shards under out; gives the manifest: part, seq, path, records, tokens, in the order of identifiers by (part, seq)."""
    ship(spark)
    with open(tokenizer_path) as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    out = on_disk(out)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), "digest"]  # an identifier that many texts share is split over partitions
    rows = rows.withColumn("digest", F.xxhash64("text")).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").select("id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = piece_cache(vocabulary.value)
        fs, base = pafs.FileSystem.from_uri(out)
        fs.create_dir(base, recursive=True)
        writer, seq, name, part = None, 0, "", 0

        def finish():
            writer.close()
            fs.move(f"{base}/{name}.tmp", f"{base}/{name}.sst")
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [f"{out}/{name}.sst"], "records": [writer.records], "tokens": [writer.tokens]}, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            keys, texts = [key_of(x) for x in batch.column("id").to_pylist()], batch.column("text").to_pylist()
            for some in portions(texts, PORTION):
                for key, value in zip(keys[some], words.encode(texts[some], end_id), strict=True):
                    if writer is None:
                        name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}"
                        writer = Writer(fs.open_output_stream(f"{base}/{name}.tmp"))
                    writer.add(key, value)
                    if writer.tokens >= SHARD_TOKENS:
                        yield finish()
                        writer, seq = None, seq + 1
        if writer is not None:
            yield finish()

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("tokens", pa.int64())])
    return rows.mapInArrow(run, "part int, seq int, path string, records long, tokens long")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per record of the shards: id, start (ids of all records before it), n_tokens, ids."""
    ship(spark)
    before = F.coalesce(F.sum("tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    shards = manifest.withColumn("start", before).select("path", "start")
    shards = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(path)
                for k in range(len(shard.index)):
                    records = list(shard.block(k))
                    sizes = np.array([len(v) for _, v in records], np.int64)
                    ends = np.concatenate(([0], np.cumsum(sizes)))
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([v for _, v in records]).astype(np.int64).astype(np.int32), pa.int32()))
                    crcs = pa.array([zlib.crc32(v.tobytes()) for _, v in records], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([id_of(key) for key, _ in records], pa.int64()), pa.array(start + ends[:-1], pa.int64()), pa.array(sizes), crcs, ids], ["id", "start", "n_tokens", "ids_crc32", "ids"])
                    start += int(ends[-1])

    return shards.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, out: str | None = None, **columns) -> DataFrame:
    """Write docs as shards, then read them back."""
    from tidemark.llm.runtime import cut

    manifest = write_shards(spark, docs, out or fresh_path(spark, "token-table"), tokenizer_path, end_id, **columns)
    return read_shards(spark, cut(manifest, "manifest"))
