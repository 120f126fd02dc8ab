import base64
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tidemark.llm import mixing

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_keep_columns_and_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    one = corpus_pipeline.identify_language(spark, docs, SF)
    assert one.columns == docs.columns and one.count() == docs.count()
    two = corpus_pipeline.drop_exact_copies(spark, one, SF)
    assert two.columns == docs.columns and two.count() == docs.select("text").distinct().count()
    three = corpus_pipeline.drop_near_copies(spark, two, SF)
    assert three.columns == docs.columns and 0.8 * two.count() < three.count() <= two.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    assert out.filter("not round_trip").count() == 0 and out.count() > 0
    assert out.filter("n_tokens <> size(ids)").count() == 0


def test_the_training_order_reaches_the_tokens(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    played = mixing.training_order(docs, keep=True).select("row.doc_id").collect()
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(f"{tmp_path}/mixed")
    tokens = corpus_pipeline.encode_tokens(spark, spark.read.parquet(f"{tmp_path}/mixed"), SF).orderBy("position").collect()
    assert [r.doc_id for r in tokens] == [r.doc_id for r in played] and [r.position for r in tokens] == list(range(len(played)))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, stage):
    """Nulls in every column, empty and very long texts, repeated rows, names that clash, no rows at all."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, `__file` string, `__row` int, `_metadata` string, `a.b` int, id int, position int, row string"
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "b", i, "x", i, "m", i, 1, 2, "r") for i, t in enumerate([None, "", " ", "one two three", "one two three", "w" * 100_000, "long text " * 20_000, "é!"])]
    rows += [rows[3], (None,) * 12, (None, "one two three", *[None] * 10)]
    docs = spark.createDataFrame(rows, shape)
    out = stage(spark, docs, SF)
    last = stage is corpus_pipeline.encode_tokens
    assert out.columns == (["doc_id", "position", "n_tokens", "ids", "round_trip"] if last else docs.columns)
    found = out.collect()
    assert all(r.round_trip for r in found) and len(found) == len(rows) if last else found and {r.text for r in found} <= {r[1] for r in rows}
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_equals_its_stages_by_hand(spark):
    """The rows of the whole run from brute force: no copies, one of each near group, plays by the plan, ids by the library."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    last = {}
    for r in docs:
        last[r.text] = max(last.get(r.text, r), r, key=lambda x: x.doc_id)
    docs = sorted(last.values(), key=lambda r: r.doc_id)
    words = {r.doc_id: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in docs}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for i, w in words.items() if w}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = [r for r in docs if find(r.doc_id) == r.doc_id]
    plan = {r.id: r.epochs for r in mixing.mix(spark.createDataFrame(docs)).collect()}
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines()) if a}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text))) for r in docs for _ in range(plan[r.doc_id]))
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want and sorted(r.position for r in out) == list(range(len(out)))
