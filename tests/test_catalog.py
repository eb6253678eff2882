import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tests.oracle import check, connect
from tessera import catalog
from tessera.functions import topk


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, con, name):
    check(catalog.QUERIES[name](spark, data), con, catalog.SQL[name])


def test_hybrid_provenance_of_many_queries(spark, data, tmp_path, monkeypatch):
    """More queries than the cores take at once: groups one after the other, and still every hit counts."""
    hits = pq.read_table(f"{data}/folder_hits.parquet")
    pq.write_table(hits.set_column(0, "hit_id", pc.multiply(hits.column("hit_id"), 50)), tmp_path / "folder_hits.parquet")
    (tmp_path / "store_rows.parquet").symlink_to(f"{data}/store_rows.parquet")
    monkeypatch.setattr(topk, "CANDIDATES", 500)
    monkeypatch.setattr(topk, "RESULTS", 72 * 30, raising=False)
    found = catalog.QUERIES["hybrid_provenance"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("MapInArrow" in line for line in plan.splitlines()) > 4 * spark.sparkContext.defaultParallelism
    check(found, connect(str(tmp_path)), catalog.SQL["hybrid_provenance"])


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "rank", "fused", "match", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_export_has_every_score(spark, tmp_path):
    """Scores amid two texts of four decimals, and null ones, are rows too; rounding goes by the exact binary value."""
    scores = [0.03125, 0.09375, 0.12345, 0.00005, 0.99995, 0.5, -0.03125, 1.00015, 0.20005, 2.675]
    rows = [(i, 1, "a", "p", "c", s, 1) for i, s in enumerate([*scores, None, float("nan")])]
    spark.createDataFrame(rows, "hit_id long, query_id long, folder string, image_path string, caption string, score double, member_count int").write.parquet(str(tmp_path / "folder_hits.parquet"))
    got = {r["hit_id"]: r["score"] for r in catalog.QUERIES["result_export"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([*(f"{s:.4f}" for s in scores), None, "NaN"]))
