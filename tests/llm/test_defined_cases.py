"""Every registered query and every pipeline stage on odd tables: null and repeated ids, null, empty and very long texts, ties, clashing columns, empty tables."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from factloom.llm import queries, training_order
from factloom.llm.tokens import default_path

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(5)) for _ in range(400)]


def text(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


A, B, LONG = text(100), text(100), text(220_000)  # LONG is over the chunk of 1 MB
DOCS = [(1, A), (2, A), (2, B), (2, "b"), (None, A), (None, A), (None, None), (3, None), (4, ""), (5, " \n "), (6, LONG), (7, LONG), (8, "a <|endoftext|> b"), (9, "x"), (9, "x"), (10, B + " password=abcdefgh12"), (None, "token: zyxwvuts98")]
CLASH = ["_hit_doc", "_hit_spans", "key", "kept", "name", "bucket", "cls", "blob", "found", "x", "score", "rank", "starts", "n", "part"]
BY_DOCUMENT = {"op2_secret_ledger", "op3_toxicity_chain", "op4_jaccard_join", "op5_recompression", "op6_suffix_blocks", "op8_repetition_rules", "op11_fill_in_middle", "op13_additive_quality"}


def write(spark, folder, docs, items, pages, labels):
    clash = ", ".join(f"{c} string" for c in CLASH)
    extra = tuple("c" for _ in CLASH)
    frames = {
        "documents": spark.createDataFrame([(i, t, None if t is None else len(t), *extra) for i, t in docs], f"doc_id long, text string, n_chars long, {clash}").repartition(3),
        "benchmark": spark.createDataFrame([(*x, 1, "c") for x in items], "item_id long, text string, doc_id int, score string"),
        "pages": spark.createDataFrame([(*x, "c", 1) for x in pages], "page_id long, url string, html string, text string, n_chars int"),
        "labels": spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    }
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    pages = [(1, "u", "<body><article><p>one two three four five six seven eight nine ten</p></article></body>"), (1, "u", None), (None, None, "<p>x"), (2, "v", ""), (3, "w", "<article><p>" + LONG + "</p></article>")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, 0), (9, 1, 0)]
    return write(spark, tmp_path_factory.mktemp("odd"), DOCS, [(1, B), (1, "b"), (None, "x"), (2, None), (3, "")], pages, labels)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_odd_tables(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).collect()
    if name in BY_DOCUMENT:
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in DOCS)
    if name == "op10_html_tree":
        assert [(r.page_id or 0) for r in sorted(got, key=lambda r: r.page_id or 0)] == [0, 1, 1, 2, 3]
        assert any(r.text == LONG for r in got)
    if name == "op5_recompression":
        gone = sorted((r.doc_id, r.n_words, r.n_removed) for r in got if r.doc_id is not None and r.n_words > 1)
        assert gone == [(1, 100, 0), (2, 100, 0), (2, 100, 100), (6, 220_000, 0), (7, 220_000, 220_000), (8, 3, 0), (10, 101, 100)]
    if name == "op12_max_sketch":
        assert {r.doc_id for r in got if r.item_id == 1} >= {2, 10} and any(r.item_id is None and r.doc_id == 9 for r in got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            rows = out.collect()
            assert name == "packing" or out.columns == docs.columns
            if folder == empty:
                assert rows == []
            if name == "secrets" and folder == odd:
                assert Counter(r.text for r in rows)["[SECRET]"] == 1 and len(rows) == len(DOCS)


def test_op1_ids_are_the_library_s(spark, odd):
    library = Tokenizer.from_file(default_path())
    want = Counter()
    for d, t in DOCS:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[d, len(ids)] += 1
    got = queries.QUERIES["op1_packing"](spark, odd).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|><|endoftext|>y<|startoftext|", "<|ENDOFTEXT|> É<|endoftext|>İ", "<|<|endoftext|>|>", "'s<|startoftext|>'LL it's"])
def test_special_strings(text):
    from factloom.llm.tokens import WordEncoder

    library = Tokenizer.from_file(default_path())
    assert np.frombuffer(WordEncoder(default_path()).encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_shards_hold_the_library_s_stream(spark, tmp_path):
    """op9: the sequences of a partition, in order of their ids, are its documents' ids one after another."""
    library = Tokenizer.from_file(default_path())
    rows = [(k, text(R.randrange(60))) for k in range(50)] + [(None, "null one"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/shards"
    manifest = sorted(training_order.materialise(docs, folder, key=5, length=64, per_shard=4).collect(), key=lambda r: r.sequence_id)
    stream = [x for _, t in rows for x in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
    got = []
    for r in manifest:
        one = training_order.read_shard(f"{folder}/shard-{r.shard:08d}.bin", 64, start=r.byte_offset // 128)[0]
        assert set(one[r.n_tokens :].tolist()) <= {0}
        got += one[: r.n_tokens].tolist()
    assert got == stream
    slots = training_order.feistel(np.arange(len(manifest)), len(manifest), 5)
    assert [r.slot for r in manifest] == slots.tolist() and sorted(slots.tolist()) == list(range(len(manifest)))
    with pytest.raises(FileExistsError):
        training_order.materialise(docs, folder, key=6, length=64, per_shard=4)


def test_a_batch_size_that_was_set_stays(spark):
    from factloom.llm.common import ROWS_PER_BATCH, keyed_text

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    before = spark.conf.get(ROWS_PER_BATCH)
    spark.conf.set(ROWS_PER_BATCH, "10000")
    keyed_text(docs)
    assert spark.conf.get(ROWS_PER_BATCH) == "10000"
    spark.conf.set(ROWS_PER_BATCH, before)
