"""python -m folioflow MODE --data DIR [--out DIR]: status, prepare, evaluate, compare, or any named query."""

from __future__ import annotations

import argparse

from folioflow.operators import evaluation
from folioflow.plans import catalog, corpus, retrieval
from folioflow.runtime import session, table
from folioflow.sources import files


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioflow", description=__doc__)
    parser.add_argument("mode", help="status, prepare, evaluate, compare, list, or the name of a query")
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--out", help="folder to write to; shown if left out")
    a = parser.parse_args(args)
    spark = session("folioflow")
    if a.mode == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if a.mode == "status":
        result = corpus.s24_status(spark, a.data)
    elif a.mode == "prepare":
        ready = evaluation.prepare(table(spark, a.data, "source_papers"), table(spark, a.data, "chunk_results"))
        if a.out:
            for name, rows in ready.items():
                rows.write.mode("overwrite").parquet(f"{a.out}/{name}")
        result = evaluation.prepared_counts(ready)
    elif a.mode == "evaluate":
        levels = retrieval.a5_e1_paper_metrics, retrieval.a6_e2_chunk_metrics, retrieval.a7_e3_answer_metrics
        result = evaluation.report(*(f(spark, a.data) for f in levels), run_id="run")
    elif a.mode == "compare":
        result = retrieval.e4_e5_comparison(spark, a.data)
    elif a.mode in catalog.queries():
        result = catalog.queries()[a.mode](spark, a.data)
    else:
        parser.error(f"unknown mode {a.mode}")
    if a.out and a.mode != "prepare":
        files.write_jsonl(result, a.out)
    else:
        result.show(50, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
