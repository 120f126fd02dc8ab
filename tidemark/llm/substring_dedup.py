"""Repeated passages by prefix-partitioned suffix trees over words.

A suffix starts at each word. What decides is whether its first LENGTH words start anywhere else: that is whether it lies
below an internal node of the suffix tree at depth LENGTH or more. The tree is never held whole. Its suffixes are split by
prefixes of varying length until each group fits into memory:

1. Every run of LENGTH words holds a run of SHORT words with the least digest among its own, at the same place wherever the
   passage stands. Only these sampled prefixes (two in thirty) are dealt out and counted. Suffixes whose prefix is alone
   have no sibling and drop out here; no repeat is lost. What stays is an occurrence: the words of up to LENGTH - SHORT + 1
   suffixes that the prefix stands for, sent once.
2. A group of at most GROUP occurrences gets its subtree: the suffixes are sorted, and neighbours that share LENGTH words lie
   below one deep internal node.
3. In larger groups, neighbouring occurrences of a text travel as a pack, cut where their words say so; packs with the same words
   are repeats of each other with all their suffixes, and of each such text one goes on as a witness. So do occurrences, when
   packs are undone. The rest grows its prefix: its suffixes are split by their distance from the sampled place into
   halves, and each half takes all the words that its suffixes have in common as its new, longer prefix. New groups go to step
   2 or 3, until the prefix has all LENGTH words and a group is one node. Equal texts are counted with partial sums, so a
   passage in a third of all rows is a row a task.

Digests only deal out; words are compared as bytes wherever a repeat is decided. Repeats travel as runs of suffixes. Words are
taken unchanged; null text has none. Rows that repeat an identifier count as documents of their own (told apart by their text;
identical rows repeat each other). An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import words
from tidemark.llm.runtime import cut, ship

LENGTH, SHORT, GROUP = 35, 8, 4_096
PACK = 64  # occurrences in a pack at most; it is cut before one in sixteen
FEW = 4_000_000  # places that may be broadcast: some 50 MB


def sampled(short: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `span` short prefixes, the place of the least (the leftmost of equals); and the distinct places."""
    if len(short) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(short, span).argmin(axis=1) + np.arange(len(short) - span + 1)
    return least, np.unique(least)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word digests) of each text of a batch."""
    for i, _, buf, offs in words.slices(batch.column("text")):
        starts, ends, at = words.find(buf, offs)
        h = words.hashes(buf, starts, ends)
        for row, (a, b) in enumerate(zip(at, at[1:], strict=False), i):
            yield row, h[a:b]


def _prefixes(length: int, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, places = [], [], []
            for row, h in _texts(batch):
                if len(h) >= length:
                    s = words.windows(h, short)
                    _, at = sampled(s, length - short + 1)
                    rows.append(np.full(len(at), row))
                    keys.append(s[at])
                    places.append(at)
            if rows:
                take = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), pa.array(np.concatenate(places), pa.int32())], ["prefix", "id", "th", "at"])

    return run


def packs(places: np.ndarray, keys: np.ndarray, hot: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of runs of neighbouring hot occurrences, cut before those whose digest says so (by middle bits: the least was sampled)."""
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(np.isin(places, hot)).tolist():
        if out and out[-1][1] == k and k - out[-1][0] < PACK and int(keys[k]) >> 24 & 15:
            out[-1] = out[-1][0], k + 1
        else:
            out.append((k, k + 1))
    return out


def _packed(length: int, short: int):
    """For each pack the suffixes of its occurrences: id, th, start (of the first), n (their number), words (each with a space after it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("places")
            rows, first, number, passages = [], [], [], []
            for i, _, buf, offs in words.slices(batch.column("text")):
                starts, ends, at = words.find(buf, offs)
                h = words.hashes(buf, starts, ends)
                data = buf.tobytes()
                for row, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False), i):
                    s = words.windows(h[a:b], short)
                    least, places = sampled(s, length - short + 1)
                    begin = np.append(np.searchsorted(least, places), len(least)).tolist()
                    for k, after in packs(places, s[places], wanted[row].values.to_numpy()):
                        x, n = begin[k], begin[after] - begin[k]
                        rows.append(row)
                        first.append(x)
                        number.append(n)
                        span = slice(a + x, a + x + n + length - 1)
                        passages.append(b" ".join([*(data[p:q] for p, q in zip(starts[span].tolist(), ends[span].tolist(), strict=True)), b""]))
            if rows:
                take = pa.array(rows)
                numbers = [pa.array(x, pa.int32()) for x in (first, number)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("th").take(take), *numbers, pa.array(passages, pa.binary())], ["id", "th", "start", "n", "words"])

    return run


def _unpacked(length: int, short: int):
    """The occurrences of packs. Which places a window samples depends on its own words, so they are those of the whole text."""
    occurrences = _occurrences(length, short)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(max(1, pc.max(batch.column("n")).as_py() + length), dtype=np.int32) if batch.num_rows else np.zeros(0, np.int32)
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                source = pa.RecordBatch.from_arrays([own.column("id"), own.column("th"), own.column("words"), pa.array([every])], ["id", "th", "text", "places"])
                for found in occurrences(iter([source])):
                    start = pc.add(found.column("start"), own.column("start")[0])
                    yield found.set_column(3, "start", start).set_column(7, "witness", pa.array([own.column("witness")[0].as_py()] * found.num_rows, pa.bool_()))

    return run


def _occurrences(length: int, short: int):
    """For each place the suffixes that its prefix stands for: prefix, id, th, start (of the first), top (words from there to the place), n (their
    number), words (each with a space after it), witness (false)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("places")
            rows, keys, first, top, number, passages = [], [], [], [], [], []
            for i, _, buf, offs in words.slices(batch.column("text")):
                starts, ends, at = words.find(buf, offs)
                h = words.hashes(buf, starts, ends)
                data = buf.tobytes()
                for row, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False), i):
                    s = words.windows(h[a:b], short)
                    least, places = sampled(s, length - short + 1)
                    begin = np.searchsorted(least, places)  # places only grow with the window's start
                    count = np.diff(np.append(begin, len(least)))
                    for k in np.flatnonzero(np.isin(places, wanted[row].values.to_numpy())).tolist():
                        x, n = int(begin[k]), int(count[k])
                        rows.append(row)
                        keys.append(s[places[k]])
                        first.append(x)
                        top.append(int(places[k]) - x)
                        number.append(n)
                        span = slice(a + x, a + x + n + length - 1)
                        passages.append(b" ".join([*(data[p:q] for p, q in zip(starts[span].tolist(), ends[span].tolist(), strict=True)), b""]))
            if rows:
                take = pa.array(rows)
                numbers = [pa.array(x, pa.int32()) for x in (first, top, number)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, np.uint64).view(np.int64)), batch.column("id").take(take), batch.column("th").take(take), *numbers, pa.array(passages, pa.binary()), pa.array(np.zeros(len(rows), bool))], ["prefix", "id", "th", "start", "top", "n", "words", "witness"]
                )

    return run


def halves(passage: bytes, top: int, n: int, length: int, short: int, shift: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(suffixes before, top, n, words, prefix) of the parts of an occurrence whose distances from the sampled place agree but for their last `shift` bits."""
    w = passage.split(b" ")
    high = top
    while high > top - n:
        least = high >> shift << shift
        low, most = max(least, top - n + 1), min(least + (1 << shift) - 1, length - short)
        before, size = top - high, high - low + 1
        shared = b" ".join(w[top - least : top - most + length])  # what all suffixes at distances least to most have in common
        yield before, high, size, b" ".join([*w[before : before + size + length - 1], b""]), b"%d %d %s" % (shift, least, shared)
        high = low - 1


def _grown(length: int, short: int, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, tops, sizes, passages, keys = [], [], [], [], [], []
            fields = (batch.column(c).to_pylist() for c in ("words", "start", "top", "n"))
            for row, (passage, start, top, n) in enumerate(zip(*fields, strict=True)):
                for before, high, size, part, prefix in halves(passage, top, n, length, short, shift):
                    rows.append(row)
                    starts.append(start + before)
                    tops.append(high)
                    sizes.append(size)
                    passages.append(part)
                    keys.append(xxhash.xxh3_64_intdigest(prefix) - (1 << 63))
            take = pa.array(rows, pa.int64())
            numbers = [pa.array(x, pa.int32()) for x in (starts, tops, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(batch.column(c).take(take) for c in ("id", "th")), *numbers, pa.array(passages, pa.binary()), batch.column("witness").take(take)], ["prefix", "id", "th", "start", "top", "n", "words", "witness"])

    return run


def deep(table: pa.RecordBatch, length: int) -> pa.Array:
    """For each occurrence, a bit for each of its suffixes: is it below a node of depth `length`? Groups are whole."""
    passages = table.column("words").cast(pa.large_binary())
    _, offs, data = passages.buffers()
    offs = np.frombuffer(offs, np.int64)[passages.offset : passages.offset + len(passages) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    ends = np.concatenate(([0], np.flatnonzero(data == 0x20) + 1))  # a space ends each word
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    symbols = each.dictionary_encode().indices.to_numpy()
    n = table.column("n").to_numpy()
    first = np.concatenate(([0], np.cumsum(n + length - 1)))[:-1]
    owner = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = first[owner] + nth
    suffixes = np.empty((len(owner), length + 2), ">u4")
    suffixes[:, :2] = table.column("prefix").to_numpy()[owner].astype(">i8").view(">u4").reshape(-1, 2)
    suffixes[:, 2:] = symbols[at[:, None] + np.arange(length)]
    order = np.argsort(suffixes.view(f"V{4 * (length + 2)}").ravel(), kind="stable")
    ranked = suffixes[order]
    same = (ranked[1:] == ranked[:-1]).all(axis=1)  # common prefix of neighbours: LENGTH words
    below = np.zeros(len(owner), bool)
    below[order[1:][same]] = True
    below[order[:-1][same]] = True
    masks = np.zeros(len(n), np.int64)
    np.bitwise_or.at(masks, owner, below.astype(np.int64) << nth)
    return pa.array(masks)


def _subtrees(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                masks = deep(rows, length)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("th"), rows.column("start"), masks], ["id", "th", "at", "mask"]).filter(pc.and_(pc.greater(masks, 0), pc.invert(rows.column("witness"))))

        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                prefix = part.column("prefix").to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # sorted: the last group may go on
                if held and held[-1].column("prefix")[0].as_py() == prefix[0] and not cut:
                    held.append(part)
                    continue
                whole = [*held, part.slice(0, cut)]
                held = [part.slice(cut)]
                yield from judged(pa.Table.from_batches(whole).combine_chunks().to_batches()[0] if sum(x.num_rows for x in whole) else part.slice(0, 0))
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _strip(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.column("repeats")
            for i, j, buf, offs in words.slices(batch.column("text")):
                starts, ends, at = words.find(buf, offs)
                data = buf.tobytes()
                n_words, n_removed, kept, spans = [], [], [], []
                for row, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False), i):
                    cover = np.zeros(b - a + 1, np.int64)
                    if repeats[row].is_valid:
                        first, masks = (repeats[row].values.field(k).to_numpy() for k in (0, 1))
                        runs = masks < 0  # so many suffixes of a pack
                        np.add.at(cover, first[runs], 1)
                        np.add.at(cover, first[runs] - masks[runs] + length - 1, -1)
                        first, masks = first[~runs], masks[~runs]
                        which, bit = np.nonzero(masks[:, None] >> np.arange(length) & 1)
                        where = first[which] + bit
                        np.add.at(cover, where, 1)
                        np.add.at(cover, where + length, -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    left = np.flatnonzero(~gone) + a
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    kept.append(b" ".join([data[x:y] for x, y in zip(starts[left].tolist(), ends[left].tolist(), strict=True)]))
                    spans.append(edges.tolist())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.int32()))], ["id", "n_words", "n_removed", "kept_text", "removed"])

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, short: int = SHORT, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_text (words joined by a space), removed (word places: start, end, start, end ...)."""
    if not 0 < short <= length < short + 63:
        raise ValueError("length must be at least short and below short + 63")
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.hash(text).alias("th"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    prefixes = rows.mapInArrow(_prefixes(length, short), f"prefix long, id {kind}, th int, at int")
    siblings = cut(prefixes.groupBy("prefix").agg(F.count("*").alias("k")).filter("k > 1"), "siblings")  # read anew, the join can split a hot prefix
    places = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("at"))))
    shared = cut(prefixes.join(siblings, "prefix").groupBy("id", "th").agg(places(F.col("k") <= group).alias("small"), places(F.col("k") > group).alias("large")), "shared")
    shape = f"prefix long, id {kind}, th int, start int, top int, n int, words binary, witness boolean"
    held = lambda which: shared.filter(F.size(which) > 0).select("id", "th", F.col(which).alias("places"))
    found_at = lambda there: rows.join(there, same(rows, there)).select(rows["id"], rows["th"], "text", "places").mapInArrow(_occurrences(length, short), shape)
    fit, repeats, hot = found_at(held("small")), [], held("large")
    if there := hot.agg(F.sum(F.size("places"))).first()[0]:
        kept = F.broadcast(hot) if there <= FEW else hot
        packed = rows.join(kept, same(rows, kept)).select(rows["id"], rows["th"], "text", "places").mapInArrow(_packed(length, short), f"id {kind}, th int, start int, n int, words binary")
        occurrences, repeats = _unpack(cut(packed, "packs"), length, short, shape)
        more, found = _split(occurrences, length, short, group, shape)
        repeats += found
        fit = fit.unionByName(more) if more is not None else fit
    # Groups that fit: sorted by prefix, each whole in one task, one group after the other.
    dealt = fit.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "prefix").sortWithinPartitions("prefix")
    below = dealt.mapInArrow(_subtrees(length), f"id {kind}, th int, at int, mask long")
    repeats = reduce(DataFrame.unionByName, repeats, below).groupBy("id", "th").agg(F.collect_set(F.struct("at", "mask")).alias("repeats"))
    marked = rows.join(repeats, same(rows, repeats), "left").select(rows["id"], "text", "repeats")
    return marked.mapInArrow(_strip(length), f"id {kind}, n_words long, n_removed long, kept_text string, removed array<int>")


def _unpack(packed: DataFrame, length: int, short: int, shape: str) -> tuple[DataFrame, list[DataFrame]]:
    """Occurrences of one pack of each text, witnesses if there are more; and the packs that repeat, as runs (id, th, at, minus their suffixes)."""
    texts = cut(packed.groupBy("words").agg(F.count("*").alias("k"), F.min(F.struct("id", "th", "start", "n")).alias("one")), "texts")
    again = texts.filter("k > 1").select("words")
    runs = cut(packed.join(again, "words").select("id", "th", F.col("start").alias("at"), (-F.col("n")).cast("long").alias("mask")), "runs")
    left = texts.select("one.*", "words", (F.col("k") > 1).alias("witness"))
    return cut(left.mapInArrow(_unpacked(length, short), shape), "occurrences"), [runs]


def _split(rows: DataFrame, length: int, short: int, group: int, shape: str) -> tuple[DataFrame | None, list[DataFrame]]:
    """Of occurrences in larger groups: those that fit after their prefixes have grown, and runs of suffixes (id, th, at, mask) that repeat."""
    text, fit, found = ["prefix", "words", "top", "n"], None, []
    for shift in range((length - short).bit_length(), -1, -1):
        if rows.isEmpty():
            break
        texts = cut(rows.groupBy(*text).agg(F.count("*").alias("k"), F.max("witness").alias("witness"), F.min(F.struct("id", "th", "start")).alias("one")), "texts")
        again = texts.filter("k > 1").select(*text)
        found.append(cut(rows.filter("not witness").join(again, text).select("id", "th", F.col("start").alias("at"), F.expr("shiftleft(1L, n) - 1").alias("mask")), "runs"))
        if not shift:
            break
        left = texts.select("prefix", "one.*", "top", "n", "words", (F.col("witness") | (F.col("k") > 1)).alias("witness"))
        grown = cut(left.mapInArrow(_grown(length, short, shift - 1), shape), "grown")
        sizes = cut(grown.groupBy("prefix").agg(F.count("*").alias("k")).filter("k > 1"), "siblings")
        sized = grown.join(sizes, "prefix")
        small = sized.filter(F.col("k") <= group).drop("k")
        fit = small if fit is None else fit.unionByName(small)
        rows = cut(sized.filter(F.col("k") > group).drop("k"), "large")
    return fit, found
