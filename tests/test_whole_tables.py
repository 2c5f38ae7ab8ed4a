"""Queries that ask whole tables, against brute force without their SQL."""

import numpy as np
import pandas as pd

from folioflow.plans import catalog

QUERIES = catalog.queries()


def test_keyword_pairs_above_a_tenth(spark, data):
    words = {r.doc_id: set(r.keywords.split()) for r in QUERIES["f11_keywords"](spark, data).collect()}
    ids = sorted(d for d in words if words[d])
    similar = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in ids for b in ids if a < b}
    found = {(r.id1, r.id2): r.sim for r in QUERIES["j7_f37_o7_keyword_pairs"](spark, data).collect()}
    assert found == {p: round(s, 6) for p, s in similar.items() if s > 0.1} and len(found) > len(ids)


def _store(data):
    e = pd.read_parquet(f"{data}/embeddings.parquet").sort_values("vec_id")
    ids, label, v = e["vec_id"].to_numpy(), e["label"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    return ids, label, ids % 100, ids // 100 - 1, np.sqrt(np.square(v[:, None] - v[None]).sum(axis=2))


def test_paper_scores_of_every_vector(spark, data):
    ids, label, doc, chunk, dist = _store(data)
    scope = np.flatnonzero((label % 7 == 0) | (chunk == -1))
    want = {}
    for q in range(len(ids)):
        near = sorted(scope, key=lambda r: (dist[q, r], str(doc[r]), chunk[r]))[:10]
        docs, e = list(dict.fromkeys(doc[near])), set(doc[label == label[q]])
        first = next((k for k, d in enumerate(docs, 1) if d in e), None)
        want[ids[q]] = (len(e & set(docs[:5])) / 5, round(len(e & set(docs)) / len(e), 6), round(1 / first, 6) if first else 0.0)
    assert {r.query_id: (r.p5, r.r10, r.rr) for r in QUERIES["w2_j6_e1_paper_scores"](spark, data).collect()} == want
    assert QUERIES["a5_e1_paper_metrics"](spark, data).head().queries == len(ids)


def test_chunk_scores_of_every_vector(spark, data):
    ids, label, doc, chunk, dist = _store(data)
    section = label % 7
    want = {}
    for q in range(len(ids)):
        own = doc == doc[q]
        e = set(chunk[own & (label == label[q]) & (chunk >= 0)])
        near = sorted(np.flatnonzero(own & ((section == section[q]) | (section[q] > 3))), key=lambda r: (dist[q, r], chunk[r]))[:10]
        got = set(chunk[near]) - {-1}
        if e:
            want[ids[q]] = (round(len(e & got) / len(got), 6) if got else 0.0, round(len(e & got) / len(e), 6))
    assert {r.query_id: (r.p, r.r) for r in QUERIES["e2_chunk_scores"](spark, data).collect()} == want and max(want) >= 300
    assert QUERIES["a6_e2_chunk_metrics"](spark, data).head().overall_recall == round(np.mean([len_ for _, len_ in want.values()]), 6)


def test_sentences_of_every_chunk(spark, data):
    c = pd.read_parquet(f"{data}/chunk_results.parquet").dropna(subset=["chunk_text"])
    found = {r.id: r.sentences for r in QUERIES["f4_c2_sentences"](spark, data).collect()}
    assert set(found) == set(c["id"]) and set(c["strategy"]) == {"paragraph", "contextual"}
    same = [found[i].replace("\n", " ").split() == t.split() for i, t in zip(c["id"], c["chunk_text"]) if t.isascii()]
    assert all(same) and len(same) > 100


def test_routes_of_questions_in_any_language(spark, tmp_path):
    rows = [(1, "Où est l'idée ?"), (2, "Bitte crawl die Räume"), (3, " ¿ ? "), (4, "What is it?"), (5, None)]
    spark.createDataFrame(rows, "id long, question string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    assert {r.id: r.route for r in QUERIES["l1_routes"](spark, str(tmp_path)).collect()} == {1: "search", 2: "collect", 3: "clarify", 4: "search", 5: "clarify"}


def test_keyword_pairs_in_blocks_without_candidates(spark, monkeypatch):
    from folioflow.operators import themes

    rng = np.random.default_rng(6)
    kw = {f"d{k:02}": sorted({f"w{w}" for w in rng.integers(0, 40, rng.integers(0, 15))}) for k in range(70)}
    sets = spark.createDataFrame([*kw.items(), (None, ["w1"])], "doc_id string, kw array<string>")
    monkeypatch.setattr(themes, "PAIR_BLOCK", 20, raising=False)
    monkeypatch.setattr(themes, "PAIR_TASK", 15, raising=False)
    pairs = themes.similar_pairs(sets, 0.2).collect()
    want = {(a, b): sorted(set(kw[a]) & set(kw[b])) for a in kw for b in kw if a < b and len(set(kw[a]) & set(kw[b])) > 0.2 * len(set(kw[a]) | set(kw[b]))}
    assert {(r.id1, r.id2): r.common for r in pairs} == want and len(pairs) == len(want) > 100
    sims = themes.pair_similarities(sets, 0.2)
    assert "Join" not in sims._jdf.queryExecution().toString()
    assert {(r.id1, r.id2): r.sim for r in sims.collect()} == {(a, b): len(c) / len(set(kw[a]) | set(kw[b])) for (a, b), c in want.items()}


def test_keyword_pairs_count_frequent_words_in_rows_of_bytes(monkeypatch):
    import pyarrow as pa

    from folioflow.operators import themes

    class Shared:
        value = None

    rng = np.random.default_rng(7)
    # Some words in most documents, some in few, and one document with more words than a byte counts.
    kw = [sorted({f"w{int(w)}" for w in rng.integers(0, 30, rng.integers(1, 20))} | {f"r{int(w)}" for w in rng.integers(0, 900, 4)}) for _ in range(300)]
    kw[7] = kw[8] = sorted({*kw[7], *(f"m{k}" for k in range(400))})
    ids = [f"d{k:03}" for k in range(300)]
    shared = Shared()
    shared.value = themes._postings(pa.table({"doc_id": ids, "kw": kw}))
    x = pa.RecordBatch.from_pydict({"doc_id": ids, "kw": kw, "_block": [0] * 300})
    shares = {(a, b): len(set(kw[a]) & set(kw[b])) / len(set(kw[a]) | set(kw[b])) for b in range(300) for a in range(b)}
    want = {(ids[a], ids[b]): s for (a, b), s in shares.items() if s > 0.1}
    for words in (0, 2048):
        monkeypatch.setattr(themes, "PAIR_WORDS", words)  # no word, or every frequent one
        got = [r for y in themes._pairs_with(shared, 0, 0.1)([x]) for r in y.to_pylist()]
        assert {(r["id1"], r["id2"]): r["sim"] for r in got} == want and len(got) == len(want) and want["d007", "d008"] == 1
    from decimal import ROUND_HALF_UP, Decimal

    half_up = lambda s: float(Decimal(repr(s)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    rounded = [r for y in themes._pairs_with(shared, 0, 0.1, 6)([x]) for r in y.to_pylist()]
    assert {(r["id1"], r["id2"]): r["sim"] for r in rounded} == {p: half_up(s) for p, s in want.items()}
