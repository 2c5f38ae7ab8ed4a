import math

import pytest

from folioflow.llm.scans import find_noise, head_form, keys, line_findings, misreading_cost, repair_scans, repair_text

BODY = (
    "The measurement shows that every sensor reading passes the network filter. "
    "Another measurement confirms that the sensor holds one reading for each network. "
)
PAPERS = [("d1", "Fenbol: Rethinking the Sensor Reading", "CRYSEC"), ("d1", None, None), ("d2", "Other Work", "  ")]


def papers(spark):
    return spark.createDataFrame(PAPERS, "doc_id string, title string, conference_name string")


def chunks(spark, texts):
    rows = [(k, "d1", t) for k, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "id long, doc_id string, chunk_text string").selectExpr("*", "1 as word", "2 as line", "3 as noise", "4 as text")


def noise(spark, texts):
    found, _ = find_noise(chunks(spark, [BODY * 40, *texts]), papers(spark))
    out = {}
    for r in found.select("id", "noise").distinct().collect():
        out.setdefault(r.id - 1, set()).add(r.noise)
    return [out.get(k, set()) for k in range(1, len(texts) + 1)]


def test_kinds_of_noise(spark):
    texts = [
        "every sen-\nsor reading passes the filter",  # cut word
        "every best-\neffort sensor reading",  # cut compound
        "both pre-\nand post-reading filters",  # left hanging on purpose
        "the sen-\n— 12 —\nsor reading passes",  # noise between the halves
        "every sens0r reading and the mea5urement",
        "every scnsor reading passes",
        "the sensor holds\nProceedings of CRYSEC 2021\none reading",
        "the sensor holds\nF E N B O L    1048 / 1072\none reading",
        "the sensor holds\nFenbol: Rethinking the Sensor …\none reading",
        "5 Evaluation\nThe sensor holds one reading",  # a section's heading
        "the sensor holds one\nreading for each network",  # line breaks alone
        "the value 0x5eb6 of v7.9 in L2-style on TorTrace-60",
    ]
    assert noise(spark, texts) == [
        {"hyphen_break"}, {"hyphen_break"}, set(), {"hyphen_break", "page_number"}, {"misread"}, {"misread"},
        {"running_head"}, {"running_head", "page_number"}, {"running_head"}, set(), set(), set(),
    ]


def test_repair(spark):
    text = "the sen-\n— 12 —\nsor holds one\nProceedings of CRYSEC 2021\n\nread1ng for each best-\neffort network."
    both = BODY * 40 + "a best effort network. " * 5
    rows = repair_scans(chunks(spark, [both, text, None, ""]), papers(spark)).orderBy("id").collect()
    assert rows[1].repaired == "the sensor holds one reading for each best-effort network."
    assert rows[1].noise == ["hyphen_break", "misread", "page_number", "running_head"]
    assert (rows[0].repaired, rows[0].noise) == (both, []) and rows[2].repaired is None and rows[3].repaired == ""


def test_repair_text_keeps_paragraphs():
    assert repair_text("a b\nc\n\nd", [("running_head", 9, "", "", True)]) == "a b c\n\nd"


@pytest.mark.parametrize("seen, meant, near", [("batcli", "batch", True), ("acldition", "addition", True), ("c1ient", "client", True), ("house", "horse", False), ("", "", True)])
def test_cost(seen, meant, near):
    assert math.isfinite(misreading_cost(seen, meant)) == near


def test_misread_and_meant_share_a_key():
    for a, b in [("batcli", "batch"), ("tbreat", "threat"), ("acldition", "addition"), ("l!nes", "lines"), ("wliich", "which")]:
        assert set(keys(a)) & set(keys(b))


def test_head_forms():
    assert head_form("F E N B O L") == head_form("Fenbol") == head_form("FFNB0L")


def test_odd_texts():
    for t in ["", "\n", "-\n", "x" * 10_000, "a-\n" * 500, "\n".join(["7"] * 50)]:
        line_findings(t)


def test_empty(spark):
    assert repair_scans(chunks(spark, []).limit(0), papers(spark)).count() == 0
    assert find_noise(chunks(spark, ["a"]), papers(spark).limit(0))[0].count() == 0
