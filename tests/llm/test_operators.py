"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, components, embedding_dedup, exact_dedup, language_id, mixing, near_dedup, quality, substring_dedup, token_table, url_filter

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, score string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "Kappa", "né", "señor"]
    base = [" ".join(r.choice(words) + str(r.randint(0, 40)) for _ in range(60)) for _ in range(6)]
    out = [None, "", "   \n\t", "one", "One", "a b", *base, *base[:3], base[0].replace("alpha", "ALPHA")]
    for b in base:
        w = b.split(" ")
        w[10] = "changed"
        out += [" ".join(w), "  ".join(b.split(" ")[:40]) + "\n" + "tail " * 50, "x" + b]
    return [*out, "long " * 3000 + base[1], "\x1c\x85 \xa0 .", "!!! ???"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None, "c"][i % 4], len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts())]
    rows += [rows[6], rows[0]]  # rows that occur twice
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def reach(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, empty, k):
    sets = {i: shingles(t, k) for i, t in rows_of(docs)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = reach(sets, links)
    got = near_dedup.near_duplicates(spark, docs, k).collect()
    assert len(got) == docs.count()
    assert {r.id: (r.n, r.component, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(spark, empty, k).count() == 0
    kept = near_dedup.keep_one(spark, docs, k)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in sets if want[i] == i}


def test_near_duplicates_of_a_large_chain(spark):
    """Copies that drift apart: neighbours are linked, ends aren't, and all are one component."""
    w = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(60):
        w[3 * i + 1] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.component for r in got.collect()} == {0}


def test_recall_at_a_larger_size(spark):
    """The links of every document whose id is divisible by 50, against all documents, by brute force on full sets."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    component = {r.id: r.component for r in near_dedup.near_duplicates(spark, docs, 5).collect()}
    rows = docs.collect()
    ids = np.array([r.doc_id for r in rows])
    sets = [np.array(sorted({hash(x) for x in shingles(r.text, 5)}), np.int64) for r in rows]
    sizes, links, found = np.array([len(s) for s in sets]), 0, 0
    for q in np.flatnonzero((ids % 50 == 0) & (sizes > 0)).tolist():
        for j in np.flatnonzero((np.minimum(sizes, sizes[q]) * 100 >= 80 * np.maximum(sizes, sizes[q])) & (ids != ids[q])).tolist():
            shared = len(np.intersect1d(sets[q], sets[j], assume_unique=True))
            if shared * 100 >= 80 * (sizes[q] + sizes[j] - shared):
                links, found = links + 1, found + (component[ids[q]] == component[ids[j]])
    assert links > 20 and found >= 0.99 * links


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(7, 7)]
    want = reach(range(301), links)
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for pair in links for n in pair if pair[0] != pair[1]}


def test_exact_dedup(spark, docs, empty):
    rows = rows_of(docs)
    by_text = {}
    for i, t in rows:
        by_text.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        group = next(g for t, g in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.id in group and r.keep_id == max(group) and r.group_size == len(group)
    assert Counter(r.kept for r in got)[True] == len(by_text)
    kept = exact_dedup.drop_copies(spark, docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in by_text.values())
    assert exact_dedup.exact_dedup(spark, empty).count() == 0 and exact_dedup.drop_copies(spark, empty).count() == 0


def test_equal_digests_of_different_texts_are_told_apart(spark):
    rows = spark.createDataFrame([(1, "a", "d", 0, 0), (2, "b", "d", 0, 1), (3, "b", "d", 0, 2), (4, "c", "e", 0, 3)], "id long, text string, digest string, file long, at long")
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup._decide(spark, rows).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


@pytest.mark.parametrize("slices", [1, 4])
def test_state_outlasts_slices_and_calls(spark, tmp_path, slices):
    """Copies in later slices and later tables meet the state of those before them."""
    one = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    two = spark.createDataFrame([(100, "text 3"), (101, "new"), (102, "new")], "doc_id long, text string")
    home = f"file://{tmp_path}/home"
    first = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, one, home=home, slices=slices).collect()}
    assert first == {i: (15 + i % 5, 4, i >= 15) for i in range(20)}
    batches = len(list((tmp_path / "home" / "groups").glob("batch=*")))
    assert batches >= slices
    second = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, two, home=home, slices=slices).collect()}
    assert second == {100: (100, 5, True), 101: (102, 2, False), 102: (102, 2, True)}
    assert len(list((tmp_path / "home" / "groups").glob("batch=*"))) > batches


ODD = "doc_id long, text string, lang string, source string, `__file` string, `__row` int, `_metadata` string, `a.b` int, row string, file int, at int, `we``ird` int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "b", "x", i, "m", i, "r", 1, 2, 3) for i, t in enumerate([None, "", "one two", "one two", "a b c d e f", "new"])]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("written", [False, True])
def test_columns_of_any_name_pass_through(spark, odd, tmp_path, written):
    if written:
        odd.write.parquet(f"{tmp_path}/odd")
        odd = spark.read.parquet(f"{tmp_path}/odd")
    rows = lambda df: Counter(map(tuple, df.collect()))
    for out in (exact_dedup.drop_copies(spark, odd), mixing.training_order(odd), near_dedup.keep_one(spark, odd), language_id.drop_unknown(spark, odd)):
        assert out.columns == odd.columns and out.count() and not set(rows(out)) - set(rows(odd))
    assert byte_bpe.round_trip(spark, odd, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=odd.columns).select("row.*").columns == odd.columns


def test_url_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "https://m.example.com/en/", "https://example.com/EN/", "http://a.net/es/", "http://net/fr/x", "http://anet/fr/", "x://example.com?/en/", "http://b.com", "http://É.com/\n/en/", "a://b://c.com/", "http://example.com/en/" + "z" * 5000]
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls + urls[:5])], "page_id long, url string, host string")
    for r in url_filter.judge_urls(spark, rows, rules).collect():
        u = (urls + urls[:5])[r.id]
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0] if u and "://" in u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest.split("/", 1)[0])
        path = rest[len(rest.split("/", 1)[0]) :]
        fit = max(((len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fit[1], fit[2])
    assert url_filter.judge_urls(spark, rows.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(spark, rows, []).collect()} == {"allow"}


def test_url_index_of_many_files(spark, monkeypatch):
    """A long list of rules is cut into files; every rule is found, whichever it stands in."""
    r = random.Random(11)
    rules = [(r.choice(["allow", "block"]), f"h{i}.example.{r.choice(['com', 'net'])}", "/" + "d/" * r.randint(0, 3)) for i in range(3000)]
    one, many = url_filter.build_index(rules), url_filter.build_index(rules, 4096)
    assert len(one) == 1 and len(many) > 20 and all(len(f) < 5000 for f in many)
    monkeypatch.setattr(url_filter, "SHARD_BYTES", 4096)
    urls = [f"http://x.{h}{p}page" for _, h, p in rules]
    got = url_filter.judge_urls(spark, spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    assert {x.id: (x.rule, x.verdict) for x in got} == {i: (h + p, v) for i, (v, h, p) in enumerate(rules)}


def test_near_vectors(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 16))
    for i in range(0, 300, 3):
        v[i + 1] = v[i] + r.normal(size=16) * r.choice([0.01, 0.1, 0.2])
    v[10], v[11] = v[12], 2 * v[12]
    rows = [(i, v[i].tolist(), int(i % 7 == 0) if i % 11 else None, "clash") for i in range(400)]
    rows += [(400, None, 1, ""), (401, [0.0] * 16, 1, ""), (402, [float("nan")] * 16, 1, ""), (403, [None] * 16, 1, ""), (404, [1.0], 1, ""), (405, [2.0], 1, ""), (406, [], 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string").repartition(3)
    ok = {i: (x, lab) for i, x, lab, _ in rows if lab is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    near = lambda a, b: a[1] == b[1] and len(a[0]) == len(b[0]) and np.dot(a[0], b[0]) / np.linalg.norm(a[0]) / np.linalg.norm(b[0]) >= 0.98
    links = [(a, b) for a in ok for b in ok if a < b and near(ok[a], ok[b])]
    want, n = reach([x[0] for x in rows], links), Counter(x for pair in links for x in pair)
    for block in (2048, 20):
        embedding_dedup.BLOCK = block
        try:
            got = {x.id: (x.n_links, x.component, x.kept) for x in embedding_dedup.near_vectors(spark, df).collect()}
        finally:
            embedding_dedup.BLOCK = 2048
        assert got == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.near_vectors(spark, df.limit(0)).count() == 0


def test_cover_tree_pairs_equal_brute_force():
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8))
    a = np.concatenate([c + r.normal(size=(40, 8)) * 0.05 for c in centres])
    a /= np.linalg.norm(a, axis=1)[:, None]
    tree = embedding_dedup.CoverTree(a)
    tree = embedding_dedup.CoverTree.read(a, tree.stored())
    i, j = embedding_dedup.linked(tree, None, 0.98)
    want = {(x, y) for x, y in zip(*np.nonzero(np.triu(a @ a.T >= 0.98, 1)), strict=True)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    i, j = embedding_dedup.linked(embedding_dedup.CoverTree(a[:300]), embedding_dedup.CoverTree(a[300:]), 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y - 300) for x, y in want if x < 300 <= y}


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        v = byte_bpe.Vocabulary.parse(f.read())
    return v, byte_bpe.Encoder(v, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_equals_the_library(spark, docs, empty, bpe):
    _, own, library = bpe
    r = random.Random(4)
    made = ["".join(r.choice("ab 's\n\t\xa0été1,.  ") for _ in range(r.randint(0, 30))) for _ in range(2000)]
    for t in [*made, *(t or "" for t in texts()), "a" * 5000, " " * 300, "\r\n \n x"]:
        ids = own.encode(t).tolist()
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    got = byte_bpe.round_trip(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=("id", "row")).collect()
    assert Counter((r.id, tuple(r.ids)) for r in got) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows_of(docs))
    assert got[0].row.id == "clash"
    assert byte_bpe.round_trip(spark, empty, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


def test_bpe_cache_is_bounded_by_bytes(bpe, monkeypatch):
    v, _, library = bpe
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 64 << 10)
    own, r = byte_bpe.Encoder(v, public_tokenizers.PATTERN), random.Random(7)
    for _ in range(300):
        t = " ".join("".join(r.choice("abcdefgh漢字") for _ in range(r.randint(1, 9))) for _ in range(20)) + "漢" * 3000
        assert own.encode(t).tolist() == library.encode_ordinary(t)
        for cache in (own.pieces, own.plain, own.spaced):
            assert sum(200 + 4 * len(k) + len(x) for k, x in cache.items()) <= 64 << 10 and all(len(k) < 300 for k in cache)


def test_bpe_of_many_texts_has_no_table_a_piece(bpe, monkeypatch):
    """Pieces that a slice brings anew share one forest; texts come out as from the library, whatever is remembered."""
    v, _, library = bpe
    r, made, table = random.Random(8), [], byte_bpe.PrefixTable
    monkeypatch.setattr(byte_bpe, "PrefixTable", lambda *args: made.append(args) or table(*args))
    monkeypatch.setattr(byte_bpe, "FEW", 1)
    own = byte_bpe.Encoder(v, public_tokenizers.PATTERN)
    parts = ["th", "ing", "er", "né", "ция", "x", "0", "'s", ".", ",\n", "-", "漢", "\u0301", "\x00", "😀"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(6000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(400)]
    texts += [t + r.choice(["", " ", "\n", " \n ", "  x"]) + t[:50] for t in texts[:100]] + ["", " ", "  ", "\n", " a", "a ", " \xa0b", texts[0], "'s"]
    for size in (1, 16 << 10, 32 << 20):  # bytes of a generation: nothing fits, little, all
        monkeypatch.setattr(byte_bpe, "CACHE_BYTES", size)
        for k in range(0, len(texts), 300):
            assert [x.tolist() for x in own.encode_many(texts[k : k + 300])] == [library.encode_ordinary(t) for t in texts[k : k + 300]]
        assert all(c.size <= size and c.size == sum(200 + 4 * len(k) + len(x) for k, x in c.items()) for c in (own.pieces, own.plain, own.spaced))
    assert max(len(w.encode()) for w in words) <= 64 and not made
    long = [*texts, "ab" * 40, "漢" * 30 + "!" * 70]
    assert [x.tolist() for x in own.encode_many(long)] == [library.encode_ordinary(t) for t in long] and len(made) >= 1
    assert own.encode_many([]) == []


@pytest.mark.parametrize("seed", range(6))
def test_forest_equals_tables(seed, monkeypatch):
    """Vocabularies with tokens that merging never makes, and few borders remembered."""
    r = random.Random(seed)
    ranks = {bytes([i]): i for i in range(256)}
    while len(ranks) < 400:
        old = [t for t in ranks if len(t) < 7 and (len(t) > 1 or t in b"abc ")]
        ranks.setdefault(r.choice(old) + r.choice(old), len(ranks))
    v = byte_bpe.Vocabulary(ranks)
    monkeypatch.setattr(byte_bpe, "BORDER_BITS", 4)
    monkeypatch.setattr(byte_bpe, "FOREST_BYTES", 2048)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    strings = ["".join(r.choice("abc") for _ in range(r.choice([1, 3, 8, 16, 17, 40, 64, 65, 90]))) for _ in range(700)] + [t.decode() for t in ranks if t.isalpha() and len(t) > 1]
    data = [s.encode() for s in strings]
    ids, ends = v.forest.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert any(not v.made(i) for i in v.bytes_of) and [ids[i:j].tolist() for i, j in zip(ends, ends[1:])] == [library.encode_ordinary(s) for s in strings]
    del ranks[b"b"]
    with pytest.raises((ValueError, KeyError)):
        byte_bpe.Vocabulary(ranks).forest.encode(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))


def test_many_texts_by_other_patterns():
    """Patterns that leave out something, or whose matches don't start at spaces, give what one text at a time gives."""
    v, r = byte_bpe.Vocabulary({bytes([i]): i for i in range(256)} | {b"ab": 256, b" a": 257}), random.Random(3)
    texts = [" ".join("".join(r.choice("ab1.") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(100)]
    for pattern in (r"\w+", ".", r" ?\w+|[^\s\w]+|\s+", r" ?[a-z]+| ?1"):
        one, many = byte_bpe.Encoder(v, pattern), byte_bpe.Encoder(v, pattern)
        assert [x.tolist() for x in many.encode_many(texts)] == [one.encode(t).tolist() for t in texts]


def test_bpe_appends_and_edits(bpe):
    v, _, _ = bpe
    r = random.Random(6)
    for _ in range(100):
        data = "".join(r.choice("theandion é") for _ in range(120)).encode()
        table = byte_bpe.PrefixTable(v, data[:50])
        table.append(data[50:])
        assert table.last == byte_bpe.PrefixTable(v, data).last
        a = r.randint(0, len(data))
        b, new = min(len(data), a + r.randint(0, 9)), b"in" * r.randint(0, 3)
        table.replace(a, b, new)
        assert table.data == data[:a] + new + data[b:] and table.last == byte_bpe.PrefixTable(v, table.data).last


def test_language(spark, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.identify(spark, docs).join(docs.withColumnRenamed("doc_id", "id"), "id").filter("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.95 and 0 <= right[1] <= right[2] <= 1
    odd = spark.createDataFrame([(1000 + i, t, "en") for i, t in enumerate([None, "", "123 !?", "日本語"])], "doc_id long, text string, lang string").unionByName(docs.select("doc_id", "text", "lang"))
    got = {r.id: r.lang_pred for r in language_id.identify(spark, odd).filter("id >= 1000").collect()}
    assert got[1000] == got[1001] == got[1002] == "und" and got[1003] in {"en", "de", "fr", "es"}
    assert language_id.identify(spark, empty).count() == 0
    kept = language_id.drop_unknown(spark, odd)
    assert kept.columns == odd.columns and kept.count() == docs.count() + 1


def parsed(model, text, block=language_id.BLOCK):
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    s, offs = model.alphabet.symbols(points, np.array([0, len(points)]))
    return s.tolist(), [round(c / b) for c, b in zip(model.costs(s, offs, block)[:, 0], model.bits, strict=True)]


def test_cross_parsing_counts_phrases():
    m = language_id.Model({"xx": ["abcabd"], "yy": ["zzz"]})
    assert parsed(m, "abcabdab")[1] == [2, 16]  # abcabd|ab; a letter unseen is a phrase and spelt out


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_cross_parsing_equals_naive_longest_matches(block):
    """Blocks make no difference: the parse is the one from the text's first symbol."""
    r = random.Random(block)
    sample = {lang: ["".join(r.choice(letters) for _ in range(300)) for _ in range(3)] for lang, letters in (("aa", "abcd "), ("bb", "abé "), ("cc", "xyz"))}
    m = language_id.Model(sample)
    hay = ["".join(map(chr, parsed(m, "\n".join(sample[lang]))[0])) for lang in sorted(sample)]
    for n in (0, 1, 5, 50, 700):
        text = "".join(r.choice("abcdé xq") for _ in range(n // 2)) + "".join(sample["aa"])[: n // 2]
        symbols, got = parsed(m, text, block)
        text, want = "".join(map(chr, symbols)), []
        for h in hay:
            i = count = 0
            while i < len(text):
                size = 0
                while i + size < len(text) and text[i : i + size + 1] in h:
                    size += 1
                i, count = i + max(1, size), count + (1 if size else 2)
            want.append(count)
        assert got == want


def test_large_alphabets_and_late_letters(spark):
    r = random.Random(9)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(1500)], "bb": [chr(0x20000 + i) for i in range(1500)], "cc": [chr(0x30000 + i) for i in range(300)]}
    rows = [(i, "".join(r.choice(scripts[lang]) for _ in range(80)), lang) for i, lang in enumerate(r.choice("abc") * 2 for _ in range(600))]
    rows.append((1000, " " + "".join(r.choice(scripts["aa"]) for _ in range(60_000)), None))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    got = language_id.identify(spark, docs).collect()
    want = {i: lang or "aa" for i, _, lang in rows}
    assert len(got) == 602 and all(x.lang_pred == want[x.id] for x in got)
    with pytest.raises(ValueError, match="values"):
        language_id.MOST_LANGS = 1
        try:
            language_id.identify(spark, docs)
        finally:
            language_id.MOST_LANGS = 1_000


def test_quality(spark, docs, empty):
    r = random.Random(8)
    good = [" ".join(r.choice(["the", "of", "and", "river", "stone"]) for _ in range(80)) for _ in range(120)]
    bad = [" ".join(r.choice(["WIN!!", "###", "$$$", "BUY!!"]) for _ in range(80)) for _ in range(120)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)], "doc_id long, text string")
    labels = rows.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    got = quality.scores(spark, rows, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").filter("held_out").collect()
    assert np.mean([x.predicted == x.quality for x in got]) >= 0.95 and all(0 <= x.score <= 1 for x in got)
    everything = quality.scores(spark, docs, labels)
    assert everything.count() == docs.count() and everything.filter("score is null").count() == 0
    assert quality.scores(spark, empty, labels).count() == 0
    assert {x.score for x in quality.scores(spark, docs, labels.limit(0)).collect()} == {0.5}


def naive_score(net, data):
    """The forward pass, one number at a time."""
    step, chunks = quality.CHUNK - quality.OVERLAP, []
    for a in range(0, max(1, len(data) - quality.OVERLAP), step) if len(data) > quality.CHUNK else [0]:
        chunk = list(data[a : a + quality.CHUNK])
        chunk += [quality.PAD] * (quality.CHUNK - len(chunk))
        best = [max(sum(float(net.table[k][chunk[i + k]][f]) for k in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1)) for f in range(quality.FILTERS)]
        chunks.append([np.tanh(b + float(net.shift[f])) for f, b in enumerate(best)])
    features = [*np.mean(chunks, axis=0), *np.max(chunks, axis=0)]
    return 1 / (1 + np.exp(-(sum(x * float(w) for x, w in zip(features, net.out, strict=True)) + float(net.bias))))


def test_quality_forward_pass_equals_naive():
    r = random.Random(3)
    data = [b"", b"a", bytes(r.randrange(256) for _ in range(512)), bytes(r.randrange(256) for _ in range(1100))]
    net = quality.Network(5).fixed()
    got = net.score(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert got == pytest.approx([naive_score(net, d) for d in data], abs=1e-5)


def test_quality_gradients_equal_differences():
    r = np.random.default_rng(2)
    net = quality.Network(5)
    net.table, net.shift, net.out, net.bias = (np.asarray(x, np.float64) for x in (net.table, net.shift, net.out, net.bias))
    data = [r.integers(0, 256, n).astype(np.uint8) for n in (3, 700, 1500)]
    chunks, doc = quality.chunked(np.concatenate(data), np.cumsum([0, *map(len, data)]))
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.7, 1.0, 1.3])

    def loss():
        p = net.combine(net.pooled(chunks)[0], doc)[1]
        return -(weight * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).mean()

    *grads, bias = net.gradients(chunks, doc, labels, weight)
    for param, grad in zip((net.table, net.shift, net.out), grads, strict=True):
        flat, slope = param.reshape(-1), grad.reshape(-1)
        for i in [*np.argsort(-np.abs(slope))[:8], *r.integers(0, len(flat), 5)]:
            old, sides = flat[i], []
            for h in (1e-6, -1e-6):
                flat[i] = old + h
                sides.append(loss())
            flat[i] = old
            assert slope[i] == pytest.approx((sides[0] - sides[1]) / 2e-6, abs=1e-6)
    net.bias = net.bias + 1e-6
    up = loss()
    net.bias = net.bias - 2e-6
    assert bias == pytest.approx((up - loss()) / 2e-6, abs=1e-6)


def test_quality_of_odd_tables(spark, docs):
    """Identifiers of another type, labels that repeat or aren't 0 or 1, null identifiers, long texts."""
    rows = docs.select(F.col("doc_id").cast("int").alias("doc_id"), "text", F.lit(1).alias("label"), F.lit(2).alias("h"), F.lit(3).alias("key"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2 + [(None, 1), (3, 7), (4, None), (999, 1)], "doc_id long, quality int")
    got = quality.scores(spark, rows, labels).collect()
    assert len(got) == docs.count() and len({r.score for r in got}) > 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= quality.THRESHOLD) for r in got)


def test_quality_chunks_cover_the_text():
    buf = np.frombuffer(bytes(range(256)) * 9, np.uint8)
    chunks, doc = quality.chunked(buf, np.array([0, 0, 5, 512, 513, len(buf)]))
    assert Counter(doc.tolist())[0] == 1 and (chunks[doc == 0] == quality.PAD).all()
    assert [(chunks[doc == d] != quality.PAD).sum() for d in (1, 2, 3)] == [5, 507, 1]
    last = chunks[doc == 4]
    step = quality.CHUNK - quality.OVERLAP
    assert np.concatenate([last[:-1, :step].ravel(), last[-1][last[-1] != quality.PAD]]).tolist() == buf[513:].tolist()


def test_pieces_equal_the_library(monkeypatch):
    """Any mix of Latin-1, other scripts, marks that compose, white space of all kinds and added tokens; caches of any size."""
    path, r = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    with open(path) as f:
        cache, library = token_table.PieceCache(f.read()), Tokenizer.from_file(path)
    assert cache.known
    odd = ["'s", "'LL", " ", "\n", "\x1c", "\x85", "\xa0", "é", "É", "ß", "²", "½", "ª", "<|endoftext|>", "—", "’", "日本", "e\u0301", "\u0301", " \u0308", "İ", "Σ", "ΑΣ", "A", "b", "123", "!!", "'", "x" * 300, "\r\n", "\u2003", "\u200b", "\x00", "😀", "ﬁ", "ſ", "\u00ad", "µ", "×"]
    made = ["".join(r.choice(odd) for _ in range(r.randint(0, 25))) for _ in range(2000)]
    made += ["".join(chr(r.choice([r.randint(0, 255), r.randint(0, 0x2FFF)])) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    monkeypatch.setattr(token_table, "CACHE_BYTES", 20_000)
    for some in token_table.portions(made, 3000):
        for t, got in zip(made[some], cache.encode(made[some], 2), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]
        assert cache.size <= 20_000


def test_token_table(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encode = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 2]
    want = sorted(rows_of(docs), key=lambda r: (r[0], r[1] or ""))
    manifest = token_table.write_shards(spark, docs, str(tmp_path / "t"), path, 2).cache()
    got = sorted(token_table.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    assert [(r.id, r.ids) for r in got] == [(i, encode(t)) for i, t in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(encode(t)) for _, t in want)])[:-1].tolist()
    shards = [token_table.Shard(r.path) for r in manifest.collect()]
    for i, t in want:
        found = [v.tolist() for s in shards for v in s.get(i)]
        assert encode(t) in found and len(found) == sum(j == i for j, _ in want)
    assert not any(s.get(10_000) for s in shards)
    many = spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(400)] + [(None, "text 1")] * 3, "doc_id long, text string").repartition(5)
    manifest = token_table.write_shards(spark, many, str(tmp_path / "m"), path, 2, partitions=4).cache()
    again = sorted(token_table.read_shards(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.id for r in again] == [None] * 203 + [5] * 200 and manifest.count() > 2
    assert Counter((r.id, tuple(r.ids)) for r in again) == Counter((r.doc_id, tuple(encode(r.text))) for r in many.collect())
    assert token_table.token_table(spark, empty, path, 2).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, total, target = set(sizes), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * sizes[s]]
        for s in over or left:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        total -= sum(target[s] for s in over)
        left = left - set(over) if over else set()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken == r.epochs * r.size <= 2 * r.size
        taken[r.source] += r.taken
    biggest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= biggest for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.training_order(empty).count() == 0


def test_training_order(spark, docs, tmp_path):
    """Positions ascend, starts are the running sum of sizes, files keep the order, and other slopes give another order but the same shares."""
    played = mixing.training_order(docs, keep=True).collect()
    at = [r.position for r in played]
    assert at == sorted(at) and 0 < at[0] and at[-1] < 1
    size = lambda r: len(WORD.findall(r.row.text or ""))
    assert [r.start for r in played] == np.cumsum([0, *map(size, played)])[:-1].tolist()
    assert Counter(r.row.doc_id for r in played) == Counter({r.id: r.epochs for r in mixing.mix(docs).groupBy("id").agg(F.sum("epochs").alias("epochs")).collect() if r.epochs})
    mixing.training_order(docs).write.parquet(f"{tmp_path}/order")
    read = spark.read.parquet(f"{tmp_path}/order").select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r.doc_id for r in sorted(read, key=lambda r: (r.file_name, r.row_index))] == [r.row.doc_id for r in played]
    flat = mixing.training_order(docs, keep=True, slopes=(0.0,)).collect()
    assert Counter(r.row.doc_id for r in flat) == Counter(r.row.doc_id for r in played) and [r.row.doc_id for r in flat] != [r.row.doc_id for r in played]


def test_curriculum_positions_invert_the_schedule(spark):
    for slope in (0.5, 0.0, -0.5, 1.0):
        for u in (0.0, 0.3, 0.99):
            t = spark.range(1).select(mixing.position(F.lit(200 * u), F.lit(200.0), F.lit(slope))).first()[0]
            assert (1 - slope) * t + slope * t * t == pytest.approx(u)
    assert spark.range(1).select(mixing.position(F.lit(200.0), F.lit(200.0), F.lit(0.5))).first()[0] is None


@pytest.mark.parametrize("group", [4096, 1])
def test_repeated_passages(spark, docs, empty, group):
    rows = [(i, WORD.findall(t or "")) for i, t in rows_of(docs)]
    seen = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))
    want = Counter()
    for i, w in rows:
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)] += 1
    got = substring_dedup.remove_repeats(spark, docs, group=group).collect()
    assert Counter((r.id, r.n_words, r.n_removed, r.kept_text) for r in got) == want
    assert all(sum(r.removed[1::2]) - sum(r.removed[::2]) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(spark, empty).count() == 0


def test_a_worker_keeps_one_operators_model(monkeypatch):
    import pickle
    import sys

    monkeypatch.delitem(sys.__dict__, "_tidemark_held", raising=False)
    ranks = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256))
    first = byte_bpe.encoder(ranks, ".")
    assert byte_bpe.encoder(ranks, ".") is first
    model = pickle.dumps("a model")
    assert language_id.model_of(model) is language_id.model_of(model)
    assert byte_bpe.encoder(ranks, ".") is not first


def test_copies_travel_as_packs(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))
    texts = [passage] * 40 + [f"a{i} b{i} {passage} c{i}" for i in range(40)] + [" ".join(["x"] * 90)] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, unpack = [], substring_dedup._unpack

    def spy(packed, *args):
        occurrences, runs = unpack(packed, *args)
        made.append((runs[0].count(), packed.agg(F.sum("n")).first()[0]))
        return occurrences, runs

    monkeypatch.setattr(substring_dedup, "_unpack", spy)
    got = {r.id: r for r in substring_dedup.remove_repeats(spark, docs, group=1).collect()}
    assert all(got[i].n_removed == 400 and got[i].kept_text == "" for i in range(40))
    assert all(got[i].n_removed == 400 and got[i].kept_text == f"a{i - 40} b{i - 40} c{i - 40}" for i in range(40, 80))
    assert all(got[i].n_removed == 90 for i in range(80, 83))
    (rows, suffixes), = made
    assert rows * 60 < suffixes  # an occurrence stands for some 14


def test_a_chunk_after_a_space_is_remembered_once():
    v = byte_bpe.Vocabulary({bytes([i]): i for i in range(256)})
    e = byte_bpe.Encoder(v, r" ?\w+|[^\s\w]+|\s+")
    assert e.decode(e.encode("one two three, four")) == b"one two three, four"
    assert set(e.spaced) == {"two", "three,", "four"} and set(e.pieces) == {"one", " three", ","}


def test_the_worker_says_whether_decoded_bytes_are_the_texts(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "é x"), (4, "")], "doc_id long, text string")
    found = byte_bpe.round_trip(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(found) == 4 and all(r.same for r in found)
    a, b = (np.frombuffer(x, np.uint8) for x in (b"abcd", b"abxd"))
    assert byte_bpe._same(a, np.array([0, 2, 4]), b, np.array([0, 2, 4])).tolist() == [True, False]
    assert byte_bpe._same(a, np.array([0, 2, 4]), a, np.array([0, 1, 4])).tolist() == [False, False]


def test_a_worker_lets_go_of_what_it_held(monkeypatch):
    import sys

    from tidemark.llm import runtime

    monkeypatch.setitem(sys.__dict__, "_tidemark_held", {"language": "a model"})
    runtime.let_go()
    assert not sys.__dict__["_tidemark_held"]
