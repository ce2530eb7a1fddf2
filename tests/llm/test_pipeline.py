"""The pipeline stage by stage against plain versions, and the registry."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain
from test_near_copies import kept_ids

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ledgerweave.llm import quality_rules, secret_scans

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]


@needs_data
def test_pipeline_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    rows = [r for r in rows if verdict[r[0]]]
    stays = set(kept_ids(rows))
    rows = [r for r in rows if (r[0] is None, r[0] or 0) in stays]
    rows = [r for r, c in zip(rows, plain.contamination(rows, items, 13)) if not c[-1]]
    hidden = []
    for d, t, lang in rows:
        out, at = "", 0
        for a, _, b in secret_scans.spans_of(t.encode())[1]:
            if a >= at:
                out += t[at:a] + "[redacted]"
            at = max(at, b)
        hidden.append((d, out + t[at:], lang))
    made = corpus_pipeline.run(spark, SF)
    plain.same(made, ["doc_id", "piece", "start", "length", "ids_crc32"], plain.pieces(hidden, 2048))


@needs_data
def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns and 0 < made.count() <= docs.count()


@needs_data
@pytest.mark.parametrize("name", ["op9_substring_dedup", "op10_benchmark_decontamination", "op11_line_dedup", "op12_ranked_lexical_search", "op13_hard_negative_mining"])
def test_against_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    cursor = connection.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    made = queries()[name](spark, SF)
    assert sorted(made.columns) == sorted(columns)
    plain.same(made, columns, cursor.fetchall())
