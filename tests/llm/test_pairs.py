import random

import numpy as np
import pytest

from folioflow.llm.crf import ChainCRF
from folioflow.llm.pairs import bare, broken_pairs, clauses, damaged, is_empty, languages, shared, training_set, unbalanced


@pytest.mark.parametrize("answer", [None, "", " \t\n", "​", "\xa0", "n/a", "N/A", "null", "-", "—", "?", "...", '""', "Answer:", "<answer></answer>", "TBD", "None."])
def test_empty(answer):
    assert is_empty(answer)


@pytest.mark.parametrize("answer", ["Yes", "No.", "7", "N/A is printed for hosts without a filter.", "Answer: Yes"])
def test_not_empty(answer):
    assert not is_empty(answer)


def test_clauses():
    assert clauses("As Prof. Arlt says (cf. Sec. 3). It holds.\n- one\n- two") == ["As Prof. Arlt says (cf. Sec. 3).", "It holds.", "- one", "- two"]
    assert bare("Answer:  x ") == "x" and clauses("") == []


@pytest.mark.parametrize("text, lang", [("the filter is in the host", "en"), ("der Filter ist auf dem Gerät", "de"), ("le filtre est dans la machine", "fr"), ("el filtro está en la máquina", "es"), ("фильтр стоит на узле", "ru")])
def test_languages(text, lang):
    got = languages(text)
    assert max(got, key=lambda k: got[k]) == lang


def test_unbalanced():
    assert unbalanced("a (b") and unbalanced("“a") and not unbalanced("“a” (b)")


def test_crf_learns_transitions():
    rng = np.random.default_rng(0)
    x, y = [], []
    for _ in range(200):
        tags = [int(rng.integers(2))]
        while len(tags) < 6:
            tags.append(tags[-1] if rng.random() < 0.95 else 1 - tags[-1])
        x.append(np.array([[1.0, t + 0.8 * rng.normal()] for t in tags]))
        y.append(tags)
    model = ChainCRF(["a", "b"], 2)
    model.fit(x[:150], y[:150], steps=200)
    right = np.mean([np.mean(np.array(model.tag(a)) == b) for a, b in zip(x[150:], y[150:])])
    alone = np.mean([np.mean((a[:, 1] > 0.5) == b) for a, b in zip(x[150:], y[150:])])
    assert right > alone and right > 0.8 and model.tag(np.zeros((0, 2))) == []


NOUNS = ["filter", "sensor", "cache", "queue", "ledger", "index", "router", "parser"]
VERBS = ["stores", "checks", "drops", "copies", "merges", "reads"]


def sample(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.sample(NOUNS, 3)
        q = f"What does the {a} do with the {b} in system {k}?"
        rows.append((k, q, f"The {a} {rng.choice(VERBS)} the {b} before the {c} is full. It {rng.choice(VERBS)} one {c} for each {b}."))
    return rows


def test_defects(spark):
    q = "What does the filter do with the queue?"
    good = sample(300)
    cases = {
        1001: (q, None, {"empty"}), 1002: (q, "n/a", {"empty"}), 1003: (q, "The filter checks the", {"truncated"}), 1004: (q, "I’m sorry, but I can’t answer that.", {"refusal"}),
        1005: (q, q.upper(), {"copy"}), 1006: (q, "Der Filter prüft die Warteschlange, bevor sie voll ist.", {"other_language"}), 1007: (q, "The filter checks the queue", set()),
        1008: (q, f"{q} The filter checks the queue before the cache is full.", set()), 1009: (q, "The system answers “I cannot answer that” when the queue is full.", set()),
        1010: ("Was macht der Filter mit der Warteschlange?", "Der Filter prüft die Warteschlange, bevor sie voll ist.", set()), 1011: (None, "The filter checks the queue.", set()),
    }
    long = "How does the filter work with " + " ".join(f"part{k}" for k in range(3000)) + "?"
    cases[1012] = (long, long.upper(), {"copy"})
    rows = good + [(i, a, b) for i, (a, b, _) in cases.items()] + [(1001, q, None)]
    df = spark.createDataFrame(rows, "id int, question string, reference_answer string").selectExpr("*", "1 as answer", "2 as last", "3 as word")
    got = broken_pairs(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.defect)
    assert {i: by.get(i, set()) for i in cases} == {i: d for i, (_, _, d) in cases.items()}
    assert sum(r.id == 1001 for r in got) == 2
    assert sum(i < 1000 for i in by) <= 3


def test_held_out_accuracy():
    import pandas as pd

    from folioflow.llm.pairs import LABELS, WIDTH

    rows = sample(400, 2)
    df = pd.DataFrame({"question": [r[1] for r in rows], "answer": [r[2] for r in rows]})
    x, y = training_set(damaged(df.iloc[:300], seed=1), {})
    model = ChainCRF(LABELS, WIDTH)
    model.fit(x, y)
    x, y = training_set(damaged(df.iloc[300:], seed=2), {})
    right = [t == g for a, b in zip(x, y) for t, g in zip(model.tag(a), b)]
    assert np.mean(right) > 0.95


@pytest.mark.parametrize("n", [0, 1, 63, 199, 201, 400])
def test_shared_words_at_any_length(n):
    """One measure below and above what once was its limit (40,000 products): the longest common subsequence."""
    rng = random.Random(n)
    a, b = [rng.choice("abcdefgh") for _ in range(n)], [rng.choice("abcdefgh") for _ in range(200)]
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    assert shared(a, b) == row[-1]
    own = [str(k) for k in range(n)]
    assert shared(own, own[::-1]) == min(n, 1) and shared(own, own) == n


def test_long_sequences_and_words(spark):
    """A sampled answer of thousands of clauses, and one unbroken word of a million letters."""
    good = sample(60)
    rows = good + [(900, good[0][1], " ".join(f"It checks part {k}." for k in range(4000))), (901, good[1][1], "x" * 1_000_000), (902, good[1][1], "n/a")]
    got = {(r.id, r.defect) for r in broken_pairs(spark.createDataFrame(rows, "id int, question string, reference_answer string")).collect()}
    assert (902, "empty") in got and not any(i == 900 for i, _ in got)


def test_stand_ins_without_a_sample(spark):
    rows = [(1, "What?", "n/a"), (2, "What?", "It holds")]
    got = broken_pairs(spark.createDataFrame(rows, "id int, question string, reference_answer string")).collect()
    assert [tuple(r) for r in got] == [(1, "empty")]


def test_no_rows(spark):
    schema = "id int, question string, reference_answer string"
    assert broken_pairs(spark.createDataFrame([], schema)).count() == 0
    assert broken_pairs(spark.createDataFrame([(None, None, None)], schema).selectExpr("*")).collect()[0].defect == "empty"
