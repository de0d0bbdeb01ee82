"""Every registered query of the engine's own operators against its SQL oracle."""

import duckdb
import pytest

from sonorel.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "embeddings", "supplier", "documents", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rows = sorted(map(str, ([r[c] for c in sorted(got.columns)] for r in got.collect())))
    assert rows
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name])
        order = sorted(range(len(want.columns)), key=lambda i: want.columns[i])
        assert [want.columns[i] for i in order] == sorted(got.columns)
        assert rows == sorted(str([r[i] for i in order]) for r in want.fetchall())


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_every_clip_finds_its_own_track(spark):
    for name in ("wang_index_query", "match_best", "panako_match"):
        got = registry.QUERIES[name](spark, SF).collect()
        assert {(r.query_id, r.ref_id) for r in got} == {(str(i) if isinstance(got[0].query_id, str) else i,) * 2 for i in range(10)}
        assert {r.offset_frames for r in got} == {20}


def test_range_join_is_no_nested_loop(spark):
    for name in ("wang_pairs", "match_ranked", "overlap", "haitsma_match", "neural_sliding", "neural_global", "neural_dtw", "panako_match", "jaccard", "bit_similarity", "own_matcher"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_ranking_lists_every_reference(spark):
    got = registry.QUERIES["match_ranked"](spark, SF).collect()
    assert len(got) == 20 and {(r["rank"], r.is_match) for r in got} == {(1, True), *((k, False) for k in range(2, 11))}
    assert all((r.score, r.votes, r.offset_frames, r.time_scale) == (0.0, 0, 0, 1.0) for r in got if not r.is_match)


def test_scan_reads_only_what_it_needs(spark):
    plan = registry.QUERIES["stop_hash"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
