"""A sample of registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_compare import TABLES, canonical_rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["tokenize_stats", "chunk_documents", "bm25_binary_topk", "bm25_plus_topk", "lexical_bm25_boosted", "dense_l2_topk", "rrf_hybrid", "gold_mapping",
          "threshold_sweep", "grid_search", "ablation", "fb_conflicts", "fb_heatmap", "gate_chain", "span_decode", "followup_rank",
          "window_merge", "fallback_errors", "char_span_tokens", "window_slices", "ranking_counts", "fb_status_counts", "fb_validate", "near_documents",
          "compare_retrievers", "tfidf_hashed_topk", "tfidf_cosine_indexed_topk", "tfidf_ngram_indexed_topk", "gold_documents", "subject_focus"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    mine = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == canonical_rows(columns, result.fetchall())


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
