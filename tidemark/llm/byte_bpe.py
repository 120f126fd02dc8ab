"""Byte-level BPE by dynamic programming over prefixes.

Each byte prefix of a piece of text has exactly one valid last token. A token t that ends at byte i is that token if it
starts the piece, or if the last token of the prefix before it and t keep their border when both are encoded side by
side. One pass stores the last token of every prefix; walking back from the end gives the ids. Appending bytes only adds
entries, and after an edit the entries agree again as soon as one longest-token's length of them does.

Borders: merges happen in rank order. On the left of a border, tokens of the right spine of a's merge tree touch it, each
until its parent's rank; on the right those of the left spine of b's tree. The border breaks if two tokens that touch it
at one time merge before either is merged away (equal ranks go left to right).

Pieces that a slice of texts brings anew are handled together, by arrays: sorted neighbours share the entries of the prefix they have in
common, and entries of prefixes of one length are found at once. Where pieces are long or few, each has a table of its own.

A piece that is itself in the vocabulary is that token. Null text counts as empty and has no ids. Empty tables give empty
results; rows that repeat an identifier are encoded each on its own; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.runtime import held, named, ship
from tidemark.llm.words import slices

NEVER = 1 << 60
CACHE_BYTES = 32 << 20  # of a generation of a cache, about; two generations are held
BORDERS = 400_000  # that are remembered
BORDER_BITS = 19  # of the number of borders that a forest remembers
WIDTHS = (16, 64)  # of the rows of a forest; longer pieces have a table each
FOREST_BYTES = 1 << 20  # of the rows of a forest
FEW = 256  # pieces that aren't worth a forest


class Vocabulary:
    """Ranks of byte strings, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.borders: dict[int, bool] = {}

    @cached_property
    def matches(self):
        """All tokens inside a string, by their ends."""
        finder = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.made(rank):
                finder.add_word(token.decode("latin-1"), (rank, len(token)))
        finder.make_automaton()
        return finder.iter

    @cached_property
    def forest(self) -> PrefixForest:
        return PrefixForest(self)

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """Lines of base64 token and rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes this one; None for bytes and for tokens that merging never makes."""
        if token not in self._parts:
            whole, get = self.bytes_of[token], self.ranks.get
            pieces = [whole[i : i + 1] for i in range(len(whole))]
            while len(pieces) > 2:
                joined = [get(a + b, NEVER) for a, b in zip(pieces, pieces[1:], strict=False)]
                best = min(joined)
                if best == NEVER:
                    break
                i = joined.index(best)
                pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
            self._parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None
        return self._parts[token]

    def made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.parts(token) is not None

    def _spine(self, token: int, side: int, memo: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """(token, rank at which it is merged away) for the tokens at one edge of the merge tree, first the byte."""
        if token not in memo:
            parts = self.parts(token) if len(self.bytes_of[token]) > 1 else None
            below = self._spine(parts[side], side, memo) if parts else []
            memo[token] = [*below[:-1], *((t, token) for t, _ in below[-1:]), (token, NEVER)]
        return memo[token]

    def border(self, a: int, b: int) -> bool:
        """Do a and b stay apart when their bytes are encoded together?"""
        key = a << 32 | b
        known = self.borders.get(key)
        if known is None:
            if len(self.borders) > BORDERS:
                self.borders.clear()
            known = self.borders[key] = self._stays(self._spine(a, 1, self._right), self._spine(b, 0, self._left))
        return known

    def _stays(self, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> bool:
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            joined = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
            if joined is not None and joined < x_ends and joined <= y_ends:
                return False
            if x_ends == y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1


_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PrefixTable:
    """The valid last token of every prefix of a growing, editable byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _extend(self, until: int) -> None:
        v, last = self.vocabulary, self.last
        done = len(last) - 1
        last += [-1] * (until - done)
        base = max(0, done + 1 - v.longest)  # tokens that end after `done` start here at the earliest
        known = v.borders
        for end, (token, size) in v.matches(self.data[base:until].decode("latin-1")):
            i = base + end + 1
            if last[i] < 0 and i > done:
                if k := i - size:
                    apart = known.get(last[k] << 32 | token)
                    if not (v.border(last[k], token) if apart is None else apart):
                        continue
                last[i] = token
        if until > done and -1 in last[done + 1 :]:
            raise ValueError("some byte ends no token; the vocabulary lacks single bytes")

    def append(self, data: bytes) -> None:
        self.data += data
        self._extend(len(self.data))

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put data in place of bytes start to end; entries are computed anew only until they agree with the old ones."""
        old_last, old_end, shift, v = self.last, end, len(data) - (end - start), self.vocabulary
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old_last[: start + 1]
        agreed, i = 0, start + len(data)
        self._extend(i)
        while i < len(self.data):
            i += 1
            self._extend(i)
            agreed = agreed + 1 if self.last[i] == old_last[i - shift] else 0
            # Tokens reach back `longest` bytes at most: old bytes only, and only entries that agree.
            if agreed >= v.longest and i - shift - v.longest >= old_end:
                self.last += old_last[i - shift + 1 :]
                break

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.bytes_of[self.last[i]])
        return out[::-1]


class _Numbers:
    """Numbers of 0 or more by keys of 0 or more, looked up many at a time; -1 for keys that aren't there. Open addressing."""

    def __init__(self, found: dict[int, int]):
        bits = max(4, (3 * len(found)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        keys, values = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int32, len(found))
        at = self._home(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            put = self.keys[at] == keys
            self.values[at[put]] = values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).view(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        seen = self.keys[at]
        hit = seen == keys
        out = np.where(hit, self.values[at], np.int32(-1))
        rest = np.flatnonzero(~hit & (seen >= 0))
        keys, at = keys[rest], at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            seen = self.keys[at]
            hit = seen == keys
            out[rest[hit]] = self.values[at[hit]]
            go = ~hit & (seen >= 0)
            rest, keys, at = rest[go], keys[go], at[go]
        return out


class PrefixForest:
    """Prefix tables of many byte strings at once: a prefix that neighbours share is one node, and nodes of one depth are settled together."""

    def __init__(self, vocabulary: Vocabulary):
        v, ranks = vocabulary, vocabulary.ranks
        self.vocabulary, self.unmade = v, {}  # tokens that merging never makes
        n = max(v.bytes_of, default=-1) + 1
        edges, ending = {}, [-1]  # of a trie of the tokens' bytes from last to first
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        pairs = {}  # of tokens that make a token side by side
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a = ranks.get(token[:i])
                if a is not None and (b := ranks.get(token[i:])) is not None:
                    pairs[a << 32 | b] = rank
            if not v.made(rank):
                self.unmade[token] = rank
                continue
            if parts := v.parts(rank) if len(token) > 1 else None:
                left[rank], right[rank] = parts
            node = 0
            for byte in reversed(token):
                below = edges.get(node << 8 | byte)
                if below is None:
                    below = edges[node << 8 | byte] = len(ending)
                    ending.append(-1)
                node = below
            ending[node] = rank
        self.sizes = np.zeros(n, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        self.edges, self.pairs, self.ending = _Numbers(edges), _Numbers(pairs), np.array(ending, np.int32)
        self.one = np.array([edges.get(b, -1) for b in range(256)], np.int64)
        self.two = np.full(1 << 16, -1, np.int64)  # nodes by the last byte and the one before
        for b in np.flatnonzero(self.one >= 0):
            self.two[b << 8 : (b + 1) << 8] = self.edges[self.one[b] << 8 | np.arange(256)]
        self.right, self.left = _spines(right), _spines(left)
        self.known = np.full(1 << BORDER_BITS, -1, np.int64)  # border << 1 | whether it stays; a newer one takes the place of an older one

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Vocabulary.border for many."""
        keys = a.astype(np.int64) << 31 | b
        at = ((keys.view(np.uint64) * _SPREAD) >> np.uint64(64 - BORDER_BITS)).view(np.int64)
        seen = self.known[at]
        out = (seen & 1).astype(bool)
        new = np.flatnonzero(seen >> 1 != keys)
        if len(new):
            out[new] = found = self._stays(a[new], b[new])
            self.known[at[new]] = keys[new] << 1 | found
        return out

    def _stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (starts, xs, x_ends), (others, ys, y_ends) = self.right, self.left
        i, j, who, out = starts[a], others[b], np.arange(len(a)), np.zeros(len(a), bool)
        while len(who):
            x, y, p, q = xs[i], ys[j], x_ends[i], y_ends[j]
            joined = self.pairs[x << 32 | y]
            over = (p == NEVER) & (q == NEVER)
            breaks = (joined >= 0) & (joined < p) & (joined <= q)
            out[who[over & ~breaks]] = True
            go, up = ~(over | breaks), p <= q
            i, j, who = (i + up)[go], (j + ~up)[go], who[go]
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings that lie in data one after the other, and where each string's start and end."""
        lens = np.diff(offs)
        alone = lens > WIDTHS[-1]
        whole = {}
        for k in np.flatnonzero(np.isin(lens, [*map(len, self.unmade)])).tolist() if self.unmade else ():
            if (rank := self.unmade.get(data[offs[k] : offs[k + 1]].tobytes())) is not None:
                whole[k], alone[k] = [rank], True
        counts, found = np.zeros(len(lens), np.int64), []
        for less, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero((lens > less) & (lens <= width) & ~alone)
            padded = np.concatenate((data, np.zeros(width, np.uint8))) if len(rows) else data
            for k in range(0, len(rows), FOREST_BYTES // width):
                some = rows[k : k + FOREST_BYTES // width]
                text = padded[offs[some][:, None] + np.arange(width)]
                text[np.arange(width) >= lens[some][:, None]] = 0
                order = np.lexsort(text[:, :16].copy().view(">u8").astype(np.uint64).T[::-1])
                some = some[order]
                ids, counts[some] = self._tokens(text[order], lens[some])
                found.append((some, ids))
        for k in np.flatnonzero(alone).tolist():
            ids = whole.get(k) or PrefixTable(self.vocabulary, data[offs[k] : offs[k + 1]].tobytes()).tokens()
            counts[k] = len(ids)
            found.append((np.array([k]), np.array(ids, np.int32)))
        ends = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(int(ends[-1]), np.int32)
        for some, ids in found:
            n = counts[some]
            out[np.repeat(ends[some] - np.cumsum(n) + n, n) + np.arange(len(ids))] = ids
        return out, ends

    def _tokens(self, text: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings in the rows of text one after the other, and their numbers. Any order is right; sorted rows share most."""
        most, n = int(lens.max()), len(lens)
        text = np.ascontiguousarray(text[:, :most])
        inside = np.arange(most) < lens[:, None]
        own = inside.copy()
        own[1:] &= ~np.logical_and.accumulate((text[1:] == text[:-1]) & inside[:-1], axis=1)
        own = np.ascontiguousarray(own.T)
        at, row = np.nonzero(own)  # of each node but the root, which is node 0; by depth
        node = np.zeros((most + 1, n), np.int32)
        node[1:][own] = np.arange(1, len(at) + 1)
        np.maximum.accumulate(node, axis=1, out=node)  # a prefix that is shared has the last number before it
        ends, sizes, tokens = self._matches(text.ravel(), row * most + at, at)
        depth = at[ends]
        order = np.argsort(depth.astype(np.uint8), kind="stable")  # longer tokens of a node come later
        ends, sizes, tokens, depth = ends[order], sizes[order], tokens[order], depth[order]
        before = node.ravel()[(depth + 1 - sizes) * n + row[ends]]
        last = np.full(len(at) + 1, -1, np.int32)
        cuts, firsts = np.searchsorted(depth, np.arange(most + 1)).tolist(), np.searchsorted(at, np.arange(most + 1)).tolist()
        for d in range(most):
            some = slice(cuts[d], cuts[d + 1])
            end, token, k = ends[some] + 1, tokens[some], before[some]
            fits = k == 0
            ask = np.flatnonzero(~fits)
            fits[ask] = self.stay(last[k[ask]], token[ask])
            last[end[fits]] = token[fits]
            if (last[firsts[d] + 1 : firsts[d + 1] + 1] < 0).any():
                raise ValueError("some byte ends no token; the vocabulary lacks single bytes")
        return self._walked(last, node, lens)

    def _matches(self, text: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node without the root, size, token) of the tokens that end at a node, whose last byte is at `place` of text and at `at` of its string."""
        live = np.flatnonzero(self.one[text[place]] >= 0)
        found, size, state = [], 1, self.one[text[place[live]]]
        while len(live):
            token = self.ending[state]
            has = token >= 0
            found.append((live[has], token[has]))
            live, state = live[go := at[live] >= size], state[go]
            where = place[live]
            byte = text[where - size].astype(np.int64)
            state = (self.two[text[where].astype(np.int64) << 8 | byte] if size == 1 else self.edges[state << 8 | byte]).astype(np.int64)
            live, state = live[go := state >= 0], state[go]
            size += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([x for x, _ in found]), np.repeat(np.arange(1, len(found) + 1), [len(x) for x, _ in found]), np.concatenate([t for _, t in found])

    def _walked(self, last: np.ndarray, node: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        who, depth, steps, counts = np.arange(len(lens)), lens, [], np.zeros(len(lens), np.int64)
        while len(who):
            token = last[node[depth, who]]
            steps.append((who, token))
            counts[who] += 1
            depth = depth - self.sizes[token]
            who, depth = who[go := depth > 0], depth[go]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (who, token) in enumerate(steps):
            out[ends[who] - 1 - k] = token
        return out, counts


def _spines(child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token's spine starts, and token by token, first the byte, its tokens and the ranks at which they are merged away."""
    chain = [np.arange(len(child))]
    while len(chain[-1]) and (chain[-1] >= 0).any():
        chain.append(np.where(chain[-1] >= 0, child[chain[-1]], -1))
    deep = sum((c >= 0).astype(np.int64) for c in chain)
    after = np.cumsum(deep)
    tokens, ends = np.zeros(int(deep.sum()), np.int64), np.full(int(deep.sum()), NEVER)
    for k, c in enumerate(chain):
        has = c >= 0
        tokens[after[has] - 1 - k] = c[has]
        if k:
            ends[after[has] - 1 - k] = chain[k - 1][has]
    return after - deep, tokens, ends


class _Cache(dict):
    """str -> bytes that were computed, in two generations of bounded size. What is longer than a generation is not held at all."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.size = make, {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self.hold(key, found)
        return found

    def hold(self, key: str, found: bytes) -> None:
        cost = 200 + 4 * len(key) + len(found)
        if cost > CACHE_BYTES >> 6:
            return
        if self.size + cost > CACHE_BYTES:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = found
        self.size += cost

    def look_up(self, keys: set[str], make) -> dict[str, bytes]:
        """All of keys that are held or that make(those that aren't) finds; now they are held, as far as they fit."""
        out = dict(zip(keys, map(self.get, keys), strict=True))
        again = [key for key, value in out.items() if value is None]
        found = [(key, value) for key, value in zip(again, map(self.old.get, again), strict=True) if value is not None]
        new = [key for key in again if key not in self.old]
        for key in new:
            del out[key]
        found += make(new)
        for key, value in found:
            self.hold(key, value)
        out.update(found)
        return out


class _SpaceRun(Exception):
    """A space that doesn't start a match."""


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.pieces = _Cache(self._piece)
        self.space = regex.compile(r"\s").match
        self.plain = _Cache(self._pieces)
        self.spaced = _Cache(self._after_space)
        tokens = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of, default=-1) + 1)]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.vocabulary.ranks.get(data)
        return array("i", (whole,) if whole is not None else PrefixTable(self.vocabulary, data).tokens()).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def _after_space(self, rest: str) -> bytes:
        if not rest or self.space(rest):
            raise _SpaceRun
        found = self.find(" " + rest)
        if len(found) == 1:  # remembered here; not as a piece too
            return self._piece(found[0])
        return b"".join(map(self.pieces.__getitem__, found))

    def encode(self, text: str) -> np.ndarray:
        """A space before anything but white space starts a match, whatever stands before it. So a text splits at its spaces, and what
        stands between them is remembered whole, unless a space is followed by white space or nothing."""
        try:
            first, *rest = text.split(" ")
            ids = b"".join([self.plain[first] if first else b"", *map(self.spaced.__getitem__, rest)])
        except _SpaceRun:
            ids = self._pieces(text)
        return np.frombuffer(ids, np.int32)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """encode for each; what the texts bring anew is encoded together."""
        words = [[] if "  " in text else text.split(" ") for text in texts]
        firsts = [own.pop(0) if own else text for own, text in zip(words, texts, strict=True)]
        chunks = self.spaced.look_up(set().union(*words), self._new_chunks).__getitem__
        rests = []
        for k, own in enumerate(words):
            try:
                rests.append(b"".join(map(chunks, own)))
            except KeyError:  # a space that doesn't start a match
                rests.append(b"")
                firsts[k] = texts[k]
        found = {text: self.find(text) for text in set(firsts)}
        pieces = self.pieces.look_up(set().union(*found.values()), self._new_pieces).__getitem__
        return [np.frombuffer(b"".join(map(pieces, found[first])) + rest, np.int32) for first, rest in zip(firsts, rests, strict=True)]

    def _new_chunks(self, chunks: list[str]) -> list[tuple[str, bytes]]:
        """What stands between spaces, with its ids after a space; nothing for what starts with white space or is empty."""
        chunks = [c for c in chunks if c and not (c[0].isspace() and self.space(c))]
        if len(chunks) < FEW:
            return [(c, self._after_space(c)) for c in chunks]
        text = " " + " ".join(chunks)
        found = self.find(text)
        starts = [k for k, piece in enumerate(found) if piece[:1] == " "]
        if len(starts) != len(chunks) or "".join(found) != text:  # another pattern: matches that leave out something or don't start at spaces
            return [(c, self._after_space(c)) for c in chunks]
        return list(zip(chunks, self._ids(found, [*starts, len(found)]), strict=True))

    def _new_pieces(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        if len(pieces) < FEW:
            return [(piece, self._piece(piece)) for piece in pieces]
        return list(zip(pieces, self._ids(pieces, range(len(pieces) + 1)), strict=True))

    def _ids(self, pieces: list[str], cuts: Sequence[int]) -> list[bytes]:
        """The ids of the pieces between each cut and the next."""
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of characters
        ids, ends = self.vocabulary.forest.encode(data, places[np.cumsum([0, *map(len, pieces)])])
        raw, ends = ids.tobytes(), (4 * ends[cuts]).tolist()
        return [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_many(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each text's end, given where its ids do."""
        sizes = self.sizes[ids]
        after = np.concatenate(([0], np.cumsum(sizes)))
        return self.bytes[np.repeat(self.starts[ids] - after[:-1], sizes) + np.arange(after[-1])], after[ends]


def encoder(ranks: bytes, pattern: str) -> Encoder:
    """One a worker process."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    return held(("byte_bpe", key), lambda: Encoder(Vocabulary.parse(ranks), pattern))


def _same(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Which texts have the same bytes in a and b? The ends have one entry more than there are texts."""
    if np.array_equal(a_ends, b_ends) and np.array_equal(a, b):
        return np.ones(len(b_ends) - 1, bool)
    return np.array([np.array_equal(a[i:j], b[k:n]) for i, j, k, n in zip(a_ends, a_ends[1:], b_ends, b_ends[1:], strict=False)], bool)


def round_trip(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs: id, ids (array of int), decoded (the bytes that the ids stand for), row (a struct of the carried columns),
    same (whether decoded are the bytes of the text)."""
    ship(spark)
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    row = F.struct(*map(named, carry)) if carry else F.lit(None).cast("struct<none:boolean>")
    source = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), row.alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value, pattern)
        for batch in batches:
            for i, j, buf, offs in slices(batch.column("text")):
                data, at = buf.tobytes(), offs.tolist()
                ids = e.encode_many([data[a:b].decode() for a, b in zip(at, at[1:], strict=False)])
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids)
                decoded, after = e.decode_many(flat, ends)
                same = _same(decoded, after, buf, offs)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(after.astype(np.int64)), pa.py_buffer(decoded)]).cast(pa.binary())
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([own.column("id"), lists, texts, own.column("row"), pa.array(same)], ["id", "ids", "decoded", "row", "same"])

    kinds = {f.name: f.dataType for f in source.schema.fields}
    return source.mapInArrow(run, T.StructType([T.StructField("id", kinds["id"]), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType()), T.StructField("row", kinds["row"]), T.StructField("same", T.BooleanType())]))
