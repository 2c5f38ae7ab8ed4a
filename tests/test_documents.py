"""Fetching, parsing, plain values, prompts and models, on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import values
from folioflow.operators import models, vectors
from folioflow.sources import documents as D


def test_fetch_retries_and_caches(spark, tmp_path):
    seen = str(tmp_path)

    def transport(url):
        import os

        mark = f"{seen}/{url[-1]}"
        tries = len(open(mark).read()) if os.path.exists(mark) else 0
        open(mark, "a").write("x")
        if url.endswith("c") or tries < 1:
            raise OSError("down")
        return b"body of " + url.encode()

    urls = spark.createDataFrame([("http://x/a",), (" http://x/a ",), ("http://x/c",), ("http://x/d",), ("",), (None,)], "url string")
    cached = urls.select(F.expr("concat(substr(md5('http://x/d'), 1, 16), '.pdf') cache_key")).distinct()
    got = {r.url: (r.content and bytes(r.content), r.attempts, r.error) for r in D.fetch(urls, transport, delay=0.0, cached=cached).coalesce(1).collect()}
    assert got == {"http://x/a": (b"body of http://x/a", 2, None), "http://x/c": (None, 3, "OSError: down")}


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pages": ["one", "two"], "outline": [[1, "Intro", 0], [2, "Part", 1]]}))
    (tmp_path / "b.json").write_text("not json")
    got = D.read_documents(spark, str(tmp_path), D.json_parser, "*.json")
    assert sorted(tuple(r) for r in D.pages(got).collect()) == [("a", 0, "one"), ("a", 1, "two")]
    assert sorted(tuple(r) for r in D.outline(got).collect()) == [("a", 0, 1, "Intro", 0), ("a", 1, 2, "Part", 1)]
    assert [r.doc_id for r in got.filter("kind = 'error'").collect()] == ["b"]


def test_nothing_to_parse(spark):
    assert D.parse(spark.createDataFrame([("a", None)], "doc_id string, content binary"), D.json_parser).count() == 0


def test_plain_values():
    deep = {"a": [1, {"b": {"c": 2}}], "s": {"y", "x"}, 3: "z" * 10, "o": object}
    got = values.plain(deep, depth=3, chars=4)
    assert got["a"] == [1, {"b": "(deeper)"}] and got["s"] == ["x", "y"] and got["3"] == "zzzz... (6 more)" and got["o"].startswith("<cla")


def test_values_of_columns(spark):
    df = spark.createDataFrame([('{"a": [1]}',), ("text",), ("7",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(values.pretty_answer(F.col("v"))).collect()] == ['{\n  "a": [\n    1\n  ]\n}', "text", "7", "", ""]
    assert [r[0] for r in df.select(values.bounded_json(F.col("v"), depth=1)).collect()] == ['{"a": "(deeper)"}', '"text"', "7", '""', None]
    a, b = df.select(values.run_id(F.col("v"), F.lit(1)), values.call_id(F.col("v"))).collect()[-1]
    assert len(a) == 8 and b.startswith("call_") and len(b) == 29


def test_templates(spark):
    one = spark.range(1)
    t = {"a": "x{{ v }}{% include 'b' %}", "b": "{{ w | default('none') }}!", "c": "{% include 'c' %}"}
    assert one.select(models.template("a", t, {"v": F.lit(5), "w": F.lit(None)})).head()[0] == "x5none!"
    with pytest.raises(ValueError):
        models.template("c", t, {})
    with pytest.raises(KeyError):
        models.template("d", t, {})


def test_models(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "p string").coalesce(1)
    known = models.Models(lambda ps: [p * 2 for p in ps])
    short = known.with_settings(odd=lambda ps: ps[:1], blank=lambda ps: [" " for _ in ps])
    ask = lambda m, f=None: [r[0] for r in df.select(models.generate(F.col("p"), m, f)).collect()]
    assert ask(short.get("other")) == ["abab", None, "cc"]
    assert ask(short.get("odd")) == ["ab", None, "c"] and ask(short.get("blank"), F.lit("-")) == ["-", "-", "-"]
    assert known.usages() == ["default"] and short.usages() == ["blank", "default", "odd"]


def test_lsh_buckets(spark):
    """Close vectors are found, most others aren't compared, and null or odd vectors are nobody's neighbour."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 32))
    x = np.concatenate([base, base + 0.2 * rng.normal(size=base.shape)])
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, vectors array<double>")
    q = rows.filter("id < 40").selectExpr("id query_id", "vectors query")
    found = vectors.search_lsh(rows, q, 2, ("id",)).collect()
    by = {r.query_id: [] for r in found}
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r.query_id].append(r.id)
    assert all(by[i] == [i, i + 40] for i in range(40))
    keys = rows.select(vectors.sign_keys(F.col("vectors"), 24, 12).alias("k")).filter("k is not null")
    assert {len(r.k) for r in keys.collect()} == {24}


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    from folioflow import runtime

    class Fake:
        class sparkContext:
            master = "spark://x:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                isEmpty = staticmethod(lambda: True)

                            return O

                    return S

        class conf:
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Fake)
