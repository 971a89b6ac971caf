import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Queries that stand for each module; the full set is compared by the same rule outside.
COMPARED = (
    "normalize_structural", "qa_violations", "quarantine_records", "producer_contract", "contract_coverage",
    "policy_decisions", "breaker_timeline_slow", "incident_actions", "feature_stats", "feature_asof",
    "quarantine_audit", "ks_features", "drift_windows", "sustained_alerts", "slo_report", "sensor_fusion",
    "lidar_returns", "doc_chunks", "hash_embed", "vector_topk", "injection_filter", "lake_roundtrip",
    "snapshot_read", "batch_publish", "stream_qa", "message_decode", "message_quarantine", "message_windows",
    "message_drift", "message_breaker", "message_triage", "batch_publish_blocked", "fusion_quarantine",
    "breaker_snapshot", "breaker_snapshot_midway", "stream_pass_ratio", "guarded_sql", "ks_order_lines",
)


def rows(columns, values):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(v[i] for i in at) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 43


def test_every_query_has_its_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", COMPARED)
def test_matches_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, result.fetchall())


def test_retrieval_against_brute_force(spark, sf):
    import numpy as np

    from convoy.operators import search
    from convoy.plans import queries as q
    from tests.test_frames_search import direct_embedding

    chunks = q._chunks(spark, sf)
    held = chunks.select("chunk_id", "text").collect()
    asked = q.tables.table(spark, sf, "benchmark").collect()
    items = np.array([direct_embedding(r.text) for r in held])
    got = search.retrieve(
        spark.createDataFrame([(r.item_id, r.text) for r in asked], "id long, text string"), search.embed(chunks)
    ).collect()
    for r in asked:
        scores = np.round(items @ np.array(direct_embedding(r.text)), 9)
        want = sorted(scores, reverse=True)[:4]
        mine = [round(x.score, 9) for x in sorted((g for g in got if g.query_id == r.item_id), key=lambda g: g["rank"])]
        assert np.allclose(mine, want)
