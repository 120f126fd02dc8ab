"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. Walking a text through it yields the longest matches:
the text is cut greedily into phrases, each the longest that occurs in the labelled text. A symbol that doesn't occur there is a
phrase and has to be spelt out, which counts as one more. Fewer phrases mean a closer language; the count is normalised by the
length of the labelled text (log2 bits a phrase) and the language with the fewest wins, ties going to the first in code point
order.

Texts are read as letters of any script: case is folded and each run of other characters counts as one separator. The parse
covers the whole text and phrases cross everything. To parse long texts side by side, each block of BLOCK symbols is first
parsed as if a phrase began there; then each is entered once more in the state in which the block before it ends, until both
parses begin a phrase at one place, from where on they agree.

The labelled text is a bounded sample of whole documents: for each language one of each of BUCKETS hash buckets, chosen by
hash among those of up to USUAL characters, or the shortest where there is none. Documents whose crc32(id as text) mod 5 is 0,
or whose text or lang is null, are never learned from. More than MOST_LANGS values of lang are refused. An automaton takes
memory in proportion to its text, whatever the alphabet.

Null text and text without a letter: `und`, score 0; so is every text if nothing can be learned. An empty table gives an
empty result. Rows that repeat an identifier are judged each on its own. Columns other than the three named ones are not
read; those carried along may have any names.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.runtime import held, named, ship
from tidemark.llm.words import slices

BUCKETS, USUAL, MOST_LANGS = 24, 4_096, 1_000
BLOCK = 1_024
UNSEEN, GAP = 0, 1
UND = "und"


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Language -> whole texts, BUCKETS at most."""
    rows = docs.select(named(id_col).alias("id"), named(lang_col).cast("string").alias("lang"), named(text_col).alias("text"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.xxhash64(F.col("id").cast("string"), "text").alias("h"), "text")
    rank = F.struct(F.greatest(F.length("text"), F.lit(USUAL)), "h")
    picks = rows.groupBy("lang", F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.min(rank).alias("pick")).select("lang", "pick.h").limit(BUCKETS * MOST_LANGS + 1).collect()
    if len(picks) > BUCKETS * MOST_LANGS:
        raise ValueError(f"{lang_col} has over {MOST_LANGS} values")
    if not picks:
        return {}
    chosen = docs.sparkSession.createDataFrame([(r.lang, r.h) for r in picks], "lang string, h long")
    out: dict[str, list[str]] = {}
    for r in rows.join(F.broadcast(chosen), ["lang", "h"]).distinct().collect():  # BUCKETS * MOST_LANGS at most
        out.setdefault(r.lang, []).append(r.text)
    return {lang: sorted(texts) for lang, texts in sorted(out.items())}


class Alphabet:
    """Code points to symbols: letters of the sample by their lower case, UNSEEN for other letters, GAP for what isn't a letter."""

    def __init__(self, texts: Sequence[str]):
        seen = sorted({c for t in texts for c in t.lower() if c.isalpha()})
        self.size = len(seen) + 2
        number = {c: k for k, c in enumerate(seen, 2)}
        self.of = np.full(sys.maxunicode + 1, GAP, np.int32)
        for point in range(sys.maxunicode + 1):
            c = chr(point)
            if c.isalpha():
                self.of[point] = number.get(c.lower(), UNSEEN)

    def symbols(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with runs of separators made one, and the offsets of the texts among them."""
        s = self.of[points]
        again = np.zeros(len(s), bool)
        again[1:] = (s[1:] == GAP) & (s[:-1] == GAP)
        again[offs[offs < len(s)]] = False
        keep = ~again
        return s[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


class Automaton:
    """A suffix automaton. A state is a place in `slots`; its transition by symbol c, if any, stands at state + c, as owner << 32 | next state."""

    def __init__(self, codes: Sequence[int], width: int):
        nexts = transitions(codes)
        r, size = random.Random(len(codes)), 2 * sum(map(len, nexts)) + len(nexts) + width
        free, places, used = bytearray(b"\1") * (size + width), [0] * len(nexts), set()
        for k in sorted(range(len(nexts)), key=lambda k: -len(nexts[k])):  # the widest first, while there is room
            own = list(nexts[k])
            while True:
                at = r.randrange(size)
                if at not in used and all(free[at + c] for c in own):
                    break
            used.add(at)
            places[k] = at
            for c in own:
                free[at + c] = 0
        self.dead = next(at for at in range(size, -1, -1) if at not in used)
        self.slots = np.full(size + width, -1, np.int64)
        at = np.array(places, np.int64)
        rows = np.repeat(at, [len(n) for n in nexts])
        symbols = np.fromiter((c for n in nexts for c in n), np.int64, len(rows))
        self.slots[rows + symbols] = rows << 32 | at[np.fromiter((q for n in nexts for q in n.values()), np.int64, len(rows))]
        self.start = np.full(width, self.dead, np.int64)  # where a phrase goes that begins with a symbol
        for c, q in nexts[0].items():
            self.start[c] = at[q]

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether the phrase goes on (else one begins with c)."""
        v = self.slots[state + c]
        on = v >> 32 == state
        return np.where(on, v & 0xFFFFFFFF, self.start[c]), on

    def phrases(self, columns: np.ndarray, sizes: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """The number of phrases that begin in each block: columns has a block's symbols, sizes (descending) their number, follows the block before
        it in its text, or -1."""
        n, steps = len(sizes), len(columns)
        alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
        state, begins = np.full(n, self.dead, np.int64), np.zeros((steps, n), bool)
        for t in range(steps):
            m = alive[t]
            state[:m], on = self.step(state[:m], columns[t, :m])
            begins[t, :m] = ~on
        count, todo = begins.sum(axis=0), np.flatnonzero(follows >= 0)
        while len(todo):  # a second time only if a block's end changed
            s, here, changed = state[follows[todo]], todo, []
            for t in range(steps):
                over = sizes[here] <= t
                if over.any():
                    gone = here[over]
                    changed.append(gone[state[gone] != s[over]])
                    state[gone] = s[over]
                    here, s = here[~over], s[~over]
                if not len(here):
                    break
                s, on = self.step(s, columns[t, here])
                same = ~on & begins[t, here]
                differs = on == begins[t, here]
                count[here[differs]] += np.where(on[differs], -1, 1)
                begins[t, here] = ~on
                here, s = here[~same], s[~same]
            else:
                changed.append(here[state[here] != s])
                state[here] = s
            todo = np.flatnonzero(np.isin(follows, np.concatenate(changed))) if changed else np.zeros(0, np.int64)
        return count


class Model:
    def __init__(self, sample: dict[str, list[str]]):
        self.alphabet = Alphabet([t for texts in sample.values() for t in texts])
        self.langs, self.automata, self.bits = [], [], []
        for lang in sorted(sample):
            points = np.frombuffer("\n".join(sample[lang]).encode("utf-32-le"), np.uint32)
            codes, _ = self.alphabet.symbols(points, np.zeros(1, np.int64))
            if (codes > GAP).any():
                self.langs.append(lang)
                self.automata.append(Automaton(codes.tolist(), self.alphabet.size))
                self.bits.append(float(np.log2(len(codes) + 1)))

    def judge(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], list[float]]:
        first = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))[offs]
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        s, offs = self.alphabet.symbols(points, first)
        letters = np.concatenate(([0], np.cumsum(s != GAP)))
        some = letters[offs[1:]] > letters[offs[:-1]]
        n = len(offs) - 1
        if not self.langs:
            return [UND] * n, [0.0] * n
        cost = self.costs(s, offs)
        best = np.argmin(cost, axis=0)
        score = 1 / np.exp2(np.maximum(-(cost - cost.min(axis=0)) / 8, -1000)).sum(axis=0)
        return [self.langs[k] if ok else UND for k, ok in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0).tolist()

    def costs(self, s: np.ndarray, offs: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Bits of each text (columns) under each language (rows)."""
        sizes = np.diff(offs)
        blocks = -(-sizes // block)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = offs[doc] + nth * block
        size = np.minimum(block, offs[doc + 1] - start)
        cost = np.zeros((len(self.langs), len(sizes)))
        if not len(doc):
            return cost
        order = np.argsort(-size, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        follows = np.where(nth > 0, place[np.maximum(0, np.arange(len(doc)) - 1)], -1)[order]
        doc, start, size = doc[order], start[order], size[order]
        padded = np.append(s, np.zeros(int(size[0]), s.dtype))
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, int(size[0]))[start].T)
        for k, automaton in enumerate(self.automata):
            spelt = np.concatenate(([0], np.cumsum((automaton.start == automaton.dead)[s])))[offs]
            cost[k] = (np.bincount(doc, automaton.phrases(columns, size, follows), len(sizes)) + np.diff(spelt)) * self.bits[k]
        return cost


def transitions(codes: Sequence[int]) -> list[dict[int, int]]:
    """The suffix automaton of codes, built online: symbol -> state for each state, the first being the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


def model_of(data: bytes) -> Model:
    """One a worker process."""
    key = hashlib.sha256(data).digest()
    return held(("language", key), lambda: pickle.loads(data))


def identify(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id, held_out, lang_pred, score, row (a struct of the carried columns, which pass unread)."""
    ship(spark)
    data = spark.sparkContext.broadcast(pickle.dumps(Model(labelled_sample(docs, id_col, text_col, lang_col))))
    row = F.struct(*map(named, carry)) if carry else F.lit(None).cast("struct<none:boolean>")
    text = [] if text_col in carry else [named(text_col).alias("text")]  # a text that is carried along travels once
    source = docs.select(named(id_col).alias("id"), held_out(named(id_col)).alias("held_out"), row.alias("row"), *text)
    place = list(carry).index(text_col) if text_col in carry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data.value)
        for batch in batches:
            for i, j, buf, offs in slices(batch.column("text") if place is None else batch.column("row").flatten()[place]):
                langs, scores = model.judge(buf, offs)
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), own.column("row")], ["id", "held_out", "lang_pred", "score", "row"])

    kinds = {f.name: f.dataType for f in source.schema.fields}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("row", kinds["row"])])
    return source.mapInArrow(run, schema)


def drop_unknown(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those in no learned language: null text and text without a letter."""
    return identify(spark, docs, id_col, text_col, lang_col, carry=docs.columns).filter(F.col("lang_pred") != UND).select("row.*")
