"""What a review found missing: links at the least sizes, pages after raw elements, repeated rows and rows without ids."""

import random

import pytest

from factloom.llm import decontaminate, html_tree, jaccard_join, packing, repetition, secret_ledger, suffix_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def words(n, name="w"):
    return [f"{name}{i}" for i in range(n)]


@pytest.mark.parametrize("size, num, least", [(3, 90, 9), (5, 80, 4)])
def test_links_at_the_least_size_that_can_differ(spark, size, num, least):
    """least against least + 1 shingles is exactly num/100; one less is below it."""
    w, v, u = words(least + size - 1), words(least + size - 1, "v"), words(least + size - 2, "u")
    texts = [w, [*w, "end"], v, ["start", *v], u, [*u, "end"]]
    rows = jaccard_join.jaccard_components(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), size, num).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(0, least, 0), (1, least + 1, 0), (2, least, 2), (3, least + 1, 2), (4, least - 1, 4), (5, least, 5)]


SCRIPTS = ["for(var i=0;i<e.length;i++)f(e[i]);", "x<!--y", "if(a<b)c('</p>')", 's="<div class=\'a";', "<!-- // -->", ""]


@pytest.mark.parametrize("tag", ["script", "STYLE", "textarea", "iframe", "noscript"])
@pytest.mark.parametrize("inner", SCRIPTS)
def test_raw_elements_end_at_their_end_tag(tag, inner):
    runs = html_tree.Page(f"<body><p>one</p><{tag} type=x>{inner}</{tag.lower()} ><article>two</article><{tag}>z</{tag}><p>three</p>").runs
    assert [t for _, _, t in runs] == ["one", "two", "three"]


@pytest.mark.parametrize("tag", ["svg", "template"])
def test_raw_subtrees_hold_markup(tag):
    runs = html_tree.Page(f"<p>one</p><{tag}><!-- </{tag}> --><script>i<e.length</script><b title='</{tag}>'>x</b></{tag}><p>two</p>").runs
    assert [t for _, _, t in runs] == ["one", "two"]


def test_page_after_a_script_is_extracted(spark):
    pages = [f"<body><script>{x}</script><article><h1>T</h1><p>one two</p></article></body>" for x in SCRIPTS]
    df = spark.createDataFrame([(i, "u", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    assert {r.text for r in html_tree.extract(df).collect()} == {"T one two"}


def test_byte_dedup_of_repeated_doc_ids(spark):
    """A window goes if an equal one has a smaller (doc_id, start), whatever row it is in; each row has its own spans."""
    r = random.Random(5)
    make = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c = make(300), make(260), make(220)
    rows = [(1, a), (1, a), (1, b), (2, c), (2, a[:150] + c), (2, c), (3, c[20:180]), (3, make(50) + b), (0, a[40:190]), (4, b + a), (4, b + a), (5, make(30) + a[:250]), (5, a[:250] + make(30)), (None, a), (None, a)]
    first = {}
    for d, t in rows:
        for i in range(len(t) - 99):
            if d is not None:
                first[t[i : i + 100]] = min(first.get(t[i : i + 100], (d, i)), (d, i))
    want = []
    for d, t in rows:
        gone = {j for i in range(len(t) - 99) if d is not None and first[t[i : i + 100]] < (d, i) for j in range(i, i + 100)}
        want.append((d or -1, len(t), len(gone), "".join(x for j, x in enumerate(t) if j not in gone)))
    for parts in (1, 5):  # equal pieces meet in a chunk or across chunks
        got = suffix_blocks.dedup(frame(spark, rows).repartition(parts), rounds=2).collect()
        assert sorted((x.doc_id or -1, x.n_bytes, x.n_removed, bytes(x.kept).decode()) for x in got) == sorted(want)


def test_rows_without_a_doc_id(spark):
    key = "password=abcdefgh12"
    w = " ".join(words(30))
    big = 2**60 + 1  # not a float
    rows = [(None, w), (None, w), (None, f"x {key} y"), (None, None), (big, w), (7, "a b c d e f"), (7, f"both {key}"), (None, f"both {key}")]
    docs = frame(spark, rows).coalesce(1)
    plain = sorted((d or -1, t or "") for d, t in rows)

    found = {(r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert found == {(-1, 28, None), (-1, 1, None), (-1, 0, None), (big, 28, big), (7, 4, 7), (7, 1, 7)}
    kept = jaccard_join.one_of_each(docs)
    stays = [(-1, ""), (-1, f"x {key} y"), (big, w), (7, "a b c d e f"), (7, f"both {key}")]
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted(stays)

    first = [r for r in packing.pack(docs).collect() if r.start == 0]
    assert sorted(r.doc_id or -1 for r in first) == sorted(d for d, _ in plain)

    clean = secret_ledger.redacted(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in clean) == sorted((d, t.replace(key, "[SECRET]")) for d, t in plain)
    findings, ledger = secret_ledger.scan(docs)
    spans = [(r.doc_id or -1, len(r.found)) for r in secret_ledger.per_document(docs, findings).collect()]
    assert sorted(spans) == sorted((d, int(key in t)) for d, t in plain)
    assert ledger.count() == 3 * len({t for _, t in plain})

    assert sorted((r.doc_id or -1, r.n_words) for r in repetition.rules(docs).collect()) == sorted((d, len(t.split())) for d, t in plain)

    items = spark.createDataFrame([(5, w)], "item_id long, text string")
    assert sorted(r.doc_id or -1 for r in decontaminate.search(docs, items).collect()) == [-1, -1, big]


def test_short_benchmark_items(spark):
    texts = ["a b c d e f g", "A\nb", "a x b c d", "b a", "", None, "d e f", "c d e f", "q"]
    items = ["a b", "A B", "c d e f", "d", "zz", "", None, "a b c d e"]
    want = set()
    for d, t in enumerate(texts):
        for k, item in enumerate(items):
            w, v = (t or "").lower().split(), (item or "").lower().split()
            if v and any(w[i : i + len(v)] == v for i in range(len(w) - len(v) + 1)):
                want.add((d, k, 1, 1, 1.0))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [tuple(r) for r in decontaminate.search(frame(spark, list(enumerate(texts))), table).collect()]
    assert len(got) == len(set(got)) and set(got) == want
