"""Hand-made cases of functions and operators."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow import model
from folioflow.functions import html, jsonx, scores
from folioflow.functions import text as T
from folioflow.operators import chunking, metrics, store, themes, traces, vectors
from folioflow.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).head()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [("a [1, 2] b", "a b"), ("x [ - ] y", "x y"), ("multi-\nline , end", "multiline, end"), ("café-\nnoir", "cafénoir"), ("", ""), (None, None)],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text) == clean


@pytest.mark.parametrize(
    "section, paper, category",
    [("Evaluation of Related Work", "", 6), ("Background and Method", "", 1), ("Summary of Results", "", 3), ("5 Discussion", "", 4), ("Kernel Fuzzer Design", "Fuzzer for Kernels", 2), ("Appendix", "", 5)],
)
def test_classify_section(spark, section, paper, category):
    df = spark.createDataFrame([(section, paper)], "s string, p string")
    assert df.select(T.classify_section(F.col("s"), F.col("p"))).head()[0] == category


@pytest.mark.parametrize(
    "text, parts",
    [
        ("We saw Dr. Smith. J. Doe left! Really? Yes.", ["We saw Dr. Smith. J. Doe left!", "Really?", "Yes."]),
        ("It cost 3.14 units. 3.15 is more. See Fig. 2.", ["It cost 3.14 units. 3.15 is more.", "See Fig. 2."]),
        ("The end etc. Then (ok). [1] is it.", ["The end etc. Then (ok).", "[1] is it."]),
        ("", []),
        ("   \n ", []),
    ],
)
def test_sentences(spark, text, parts):
    assert one(spark, text, T.sentences) == parts


def merged(parts, size=800, overlap=100, least=100):
    """The merge, restated plainly."""
    out, cur, n = [], [], 0
    for s in parts:
        if n + len(s) > size and cur:
            out.append(" ".join(cur))
            tail, got = [], 0
            for t in reversed(cur):
                if got >= overlap and tail:
                    break
                tail.insert(0, t)
                got += len(t) + 1
            cur, n = tail, sum(map(len, tail)) + len(tail) - 1
        cur = [*cur, s]
        n += len(s) + 1
    if cur:
        last = " ".join(cur)
        if len(last) < least and out:
            out[-1] += " " + last
        else:
            out.append(last)
    return out


def test_merge_sentences(spark):
    import random

    rng = random.Random(5)
    rows = [(k, ["s" * rng.choice([3, 40, 90, 200, 500, 900]) for _ in range(rng.randint(0, 12))]) for k in range(200)]
    got = spark.createDataFrame(rows, "k int, p array<string>").select("k", chunking.merge_sentences(F.col("p")).alias("m")).collect()
    assert {r.k: r.m for r in got} == {k: merged(p) for k, p in rows}


def test_strategies(spark):
    docs = spark.createDataFrame([("d", "x" * 1001), ("e", None)], "doc_id string, text string")
    assert [len(r.chunk_text) for r in chunking.chunk_text(docs, "fixed_size").orderBy("chunk_index").collect()] == [500, 500, 1]
    stops = spark.createDataFrame([("d", "a. b..c.")], "doc_id string, text string")
    assert [r.chunk_text for r in chunking.chunk_text(stops, "sentence").orderBy("chunk_index").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        chunking.chunk_text(docs, "words")


def test_page_fallback(spark):
    pages = spark.createDataFrame([("d", k, "w" * n) for k, n in enumerate([60, 60, 49, 60])], "doc_id string, page int, text string")
    rows = chunking.page_fallback(pages).orderBy("chunk_index").collect()
    assert [(r.section_category, r.page_number) for r in rows] == [(0, 1), (1, 2), (5, 4)]


def test_paper_scores(spark):
    expected = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"]), (3, [])], "query_id int, expected array<string>")
    hits = spark.createDataFrame([(1, 1, "x"), (1, 2, "a")], "query_id int, rank int, doc_id string")
    got = {r.query_id: (r.p5, r.p10, r.r5, r.rr, r.hit) for r in metrics.paper_scores(expected, hits).collect()}
    assert got == {1: (0.2, 0.1, 0.5, 0.5, 1.0), 2: (0.0, 0.0, 0.0, 0.0, 0.0)}


def test_chunk_scores(spark):
    expected = spark.createDataFrame([(1, "method", [3, 4]), (2, "method", None)], "query_id int, answer_source string, chunks array<int>")
    hits = spark.createDataFrame([(1, -1), (1, 3), (1, 9)], "query_id int, chunk_id long")
    assert [(r.query_id, r.p, r.r) for r in metrics.chunk_scores(expected, hits).collect()] == [(1, 0.5, 0.5)]


def test_first_per_document_after_limit(spark):
    hits = spark.createDataFrame([("d1", 0, 0.1), ("d1", 1, 0.2), ("d2", 0, 0.3)], "doc_id string, chunk_id int, dist double")
    assert vectors.first_per_document(hits).count() == 2


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(scores.jaccard(F.col("a"), F.col("b"))).collect()] == [0.333333, 0.0]


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    words = [f"w{k}" for k in range(30)]
    sets = [(f"d{k:03}", "t", sorted(rng.sample(words, rng.randint(0, 12)))) for k in range(80)]
    df = spark.createDataFrame(sets, "doc_id string, title string, kw array<string>")
    for threshold in (0.1, 0.5):
        got = {(r.id1, r.id2) for r in themes.similar_pairs(df, threshold).collect()}
        want = {(a, b) for i, (a, _, x) in enumerate(sets) for b, _, y in sets[i + 1 :] if x and y and len(set(x) & set(y)) / len(set(x) | set(y)) > threshold}
        assert got == want


def test_greedy_groups():
    sets = [(d, d.upper(), k) for d, k in [("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["x", "z"]), ("d", ["q"]), ("e", [])]]
    pairs = [("a", "b", 1.0, ["x", "y"]), ("a", "c", 0.33, ["x"])]
    (g,) = themes.greedy_groups(sets, pairs)
    assert g == {"cluster_id": 0, "paper_ids": ["a", "b", "c"], "common_keywords": ["x"], "paper_titles": ["A", "B", "C"]}


def test_windows_of_context(spark):
    rows = spark.createDataFrame([("d", -1, "paper"), ("d", 0, "a"), ("d", 1, "b"), ("d", 1, "b"), ("d", 2, "c")], "doc_id string, chunk_id long, text string")
    hits = spark.createDataFrame([("d", 0), ("d", 9)], "doc_id string, chunk_id long")
    assert [(r.chunk_id, r.context) for r in store.CorpusStore(rows).context(hits).collect()] == [(0, "a\n\nb")]


def test_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"doc_id": "d", "title": "t", "strategy": "paragraph",\n "chunks": [{"text": "old", "chunk_index": 0}, {"chunk_text": "new", "text": "x", "chunk_index": 1}]}')
    assert [r.chunk_text for r in files.read_chunk_files(spark, str(tmp_path)).orderBy("chunk_index").collect()] == ["old", "new"]
    pairs = spark.createDataFrame([(1, "q", "easy", ["d"], [1], "method", "a", 3, False)], model.QA_PAIR)
    truth = files.ground_truth(pairs)
    assert truth.head().difficulty_distribution == {"easy": 1}
    files.write_jsonl(truth, str(tmp_path / "gt"))
    assert files.read_ground_truth(spark, str(tmp_path / "gt"), multi_line=False).head().question == "q"
    docs = files.chunk_documents(spark.createDataFrame([("d", "s", 1, "b"), ("d", "s", 0, "a")], "doc_id string, strategy string, chunk_index int, chunk_text string"))
    assert [c.chunk_text for c in docs.head().chunks] == ["a", "b"]
    files.write_markdown(spark.createDataFrame([("| 1 |",)], "line string"), str(tmp_path / "md"), ["n"])
    assert spark.read.text(str(tmp_path / "md")).count() == 3


def test_export_is_repeatable(spark):
    p = spark.createDataFrame([(f"d{k}", "t", "a", "u" if k % 3 else " ", "x", "C", 2020, "r") for k in range(30)], model.PAPER_SOURCE)
    a = [r.doc_id for r in store.export_papers(p, sample=7).collect()]
    assert a == [r.doc_id for r in store.export_papers(p.repartition(3), sample=7).collect()] and len(a) == 7


def test_html_grammar():
    page = html.parse('<div id=a class="x y"><ul><li class=i><a href="/p.pdf">P</a><li class=i>two</ul><p>one<p>two<b>bold</div><p>out')
    assert [n.text() for n in html.select(page, "li.i")] == ["P", "two"]
    assert [n.text() for n in html.select(page, "#a > p")] == ["one", "two bold"]
    assert len(html.select(page, "a[href$='.pdf'], p")) == 4
    assert html.select(page, "div.x.z") == []
    with pytest.raises(ValueError):
        html.select(page, "p:first-child")
    assert html.css_of(html.select(page, "div")[0]) == ".x"


def test_detect_item():
    page = html.parse("<div class=list>" + "".join(f"<div class=row><div class=in><h3>t{k}</h3></div></div>" for k in range(6)) + "</div>")
    assert html.detect_item(page, "h3")[0] == ".in"
    assert html.detect_item(html.parse("<p>x"), "h3") == ("body", ["body"])
    assert html.verify("<p>x", "no json")["n_items"] == 1


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_scans_never_fail(text):
    jsonx.mend_json(text)
    jsonx.objects(text)
    html.extract_texts(text, {"t": "p"})


def test_attach_outputs_without_call(spark):
    e = spark.createDataFrame([("t", 1, "output", "", "x")], "trace_id string, seq int, kind string, name string, content string")
    assert traces.attach_outputs(e).count() == 0


def test_providers(spark):
    embed = vectors.embedder("function", encode=lambda texts: [[float(len(t))] for t in texts])
    assert spark.createDataFrame([("ab",), (None,)], "t string").select(embed(F.col("t"))).collect()[0][0] == [2.0]
    with pytest.raises(ValueError):
        vectors.embedder("none")
    v = one(spark, "a b a", lambda c: vectors.hashing_embedding(c, 8), "string")
    assert abs(sum(x * x for x in v) - 1) < 1e-6


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert chunking.chunk_text(empty, "paragraph").count() == 0
    papers, chunks = spark.createDataFrame([], model.PAPER_SOURCE), spark.createDataFrame([], f"doc_id string, {model.CHUNK}")
    assert model.collection(papers, chunks).count() == 0
    assert themes.keyword_groups(papers).count() == 0


def test_numbered_in_blocks(spark):
    """Places don't depend on the size of blocks; null keys are one group, null values come first, ties go by the next column."""
    from pyspark.sql import Window

    from folioflow.operators import chunking

    rows = [("a", k % 50, k) for k in range(300)] + [("b", 7, 1000), (None, 3, 1001), (None, None, 1002), ("c", -5, 1003), ("c", 2, 1004)]
    df = spark.createDataFrame(rows, "d string, x int, id int")
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("d").orderBy("x", "id")) - 1).collect()}
    for block in (1, 7, 1024):
        assert {r.id: r.n for r in chunking.numbered(df, "d", ("x", "id"), "n", block).collect()} == want


def test_merge_sentences_is_linear():
    import time

    from folioflow.operators.chunking import _merged

    began = time.process_time()
    out = _merged(["A sentence of some length."] * 200_000, 800, 100, 100)
    assert time.process_time() - began < 5 and all(len(c) <= 800 for c in out)
