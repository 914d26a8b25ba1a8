"""Fixture queries on tables whose last mosaic is not whole."""

import duckdb
import pyarrow.parquet as pq
import pytest

import tessera.plans.all  # noqa: F401
from tessera import registry
from tests.conftest import SF_SMALL
from tests.test_oracle import plain


@pytest.fixture(scope="module")
def partial(tmp_path_factory):
    """Three mosaics of which the last has 37 of its 100 blocks, one of them missing amid the others."""
    at = tmp_path_factory.mktemp("partial")
    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").slice(0, 238)
    pq.write_table(t.filter([k != 213 for k in t.column("vec_id").to_pylist()]), at / "embeddings.parquet")
    pq.write_table(pq.read_table(f"{SF_SMALL}/labels.parquet"), at / "labels.parquet")
    return str(at)


def same(spark, at: str, name: str) -> int:
    """Asserts the query's rows to be its SQL's; their number."""
    con = duckdb.connect()
    for t in ("embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet')")
    df = registry.queries()[name](spark, at)
    res = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    assert got == sorted(tuple(map(plain, r)) for r in res.fetchall())
    return len(got)


@pytest.mark.parametrize("name", ["t02_patches_from_blocks", "t10_blocks_from_patches", "m04_coverage_of_blocks", "m01_components_of_blocks"])
def test_missing_blocks_count_nowhere(spark, partial, name):
    assert same(spark, partial, name)


PREDICTED = ["k02_gradient_sums", "m06_patch_dice", "m07_surface_distances", "m08_boundary_metrics", "m09_all_patch_metrics", "m18_sigmoid_predict", "m20_single_pass"]


@pytest.mark.parametrize("name", PREDICTED)
def test_predictions_of_short_and_null_embeddings(spark, tmp_path, name):
    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").slice(0, 60).to_pylist()
    t[3]["embedding"], t[4]["embedding"], t[5]["embedding"][7] = t[3]["embedding"][:50], None, None
    spark.createDataFrame([(r["vec_id"], r["embedding"], r["label"]) for r in t], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "some"))
    next((tmp_path / "some").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    pq.write_table(pq.read_table(f"{SF_SMALL}/labels.parquet"), tmp_path / "labels.parquet")
    assert same(spark, str(tmp_path), name)


def test_predictions_join_nothing(spark, partial):
    """A patch's neighbours are in its row: no join, and the stored rows are dealt out once."""
    for name in (*PREDICTED, "m13_worst_patches", "m17_losses"):
        plan = registry.queries()[name](spark, partial)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "collect_list" not in plan and "RepartitionByExpression [vec_id" in plan


def test_kernels_take_a_batch_in_pieces():
    """A batch has 10,000 rows; kernels hold the Python objects of a few hundred at a time, in whatever slices they come."""
    import numpy as np
    import pyarrow as pa

    from tessera.functions import kernels, shapes
    from tessera.operators import labels

    px = np.random.default_rng(3).integers(0, 256, (1100, 64)).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1100), pa.int64()), pa.array(list(px))], ["pid", "px"])
    scored = list(labels._features(labels.BASE, 8)(iter([batch])))
    assert sum(b.num_rows for b in scored) == 1100 and max(b.num_rows for b in scored) <= kernels.PIECE
    assert [r["px"] for b in scored for r in b.to_pylist()] == px.tolist()
    one = pa.concat_batches(scored).append_column("mask", pa.array((px > 150).astype(np.int32).tolist())).append_column("thr", pa.array([4.0] * 1100)).append_column("n_valid", pa.array([64] * 1100, pa.int32()))
    found = [b.to_pylist() for b in shapes.region_rows(8, True)(iter([one]))]
    assert max(len({r["pid"] for r in b}) for b in found) <= kernels.PIECE
    assert [r for b in found for r in b] == [r for k in range(1100) for b in shapes.region_rows(8, True)(iter([one.slice(k, 1)])) for r in b.to_pylist()]
