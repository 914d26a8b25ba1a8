"""The pred view's users shuffle and sort patches, never pixels; rows equal the SQL's on odd embeddings."""

import pyarrow.parquet as pq
import pytest

import tessera.plans.all  # noqa: F401
from tessera import registry
from tests.conftest import SF_SMALL
from tests.test_partial import same

#: queries over fx_pred and the finding of round 3 that names each
USERS = [
    "m06_patch_dice",  # F4
    "m07_surface_distances",  # F5
    "m08_boundary_metrics",  # F6
    "m09_all_patch_metrics",  # F7
    "m10_metrics_summary",  # F8
    "m11_pooled_dice",  # F9
    "m12_threshold_sweep",  # F10
    "m12b_best_threshold",  # F11
    "m13_worst_patches",  # F12
    "m14_confident_scores",  # F13
    "m15_adaptive_thresholds",  # F14
    "m16_two_pass_score",  # F15
    "m17_losses",  # F16
    "m18_sigmoid_predict",  # F17
    "m19_binarise",  # F18
    "m20_single_pass",  # F19
    "r06_dice_ranking_summary",  # F20
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """200 patches: one short, one without an embedding, a missing element, vectors beyond the gray range and null labels."""
    at = tmp_path_factory.mktemp("odd")
    t = pq.read_table(f"{SF_SMALL}/embeddings.parquet").slice(0, 200).to_pylist()
    t[3]["embedding"], t[4]["embedding"], t[5]["embedding"][7] = t[3]["embedding"][:50], None, None
    t[6]["embedding"], t[7]["embedding"] = [9.0] * 64, [-9.0] * 64
    t[8]["label"] = t[9]["label"] = None
    t[9]["embedding"] = [9.0 if i // 8 in (2, 3, 4) and i % 8 in (2, 3, 4) else -9.0 for i in range(64)]  # predicted where the truth is unknown
    rows = spark.createDataFrame([(r["vec_id"], r["embedding"], r["label"]) for r in t], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(str(at / "some"))
    next((at / "some").glob("*.parquet")).rename(at / "embeddings.parquet")
    pq.write_table(pq.read_table(f"{SF_SMALL}/labels.parquet"), at / "labels.parquet")
    return str(at)


def shuffled(spark, run) -> int:
    """The most rows that one stage of ``run`` writes to a shuffle."""
    sc, gw = spark.sparkContext, spark.sparkContext._gateway
    store = sc._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), None)
    old = stages()
    seen = {old.apply(k).stageId() for k in range(old.size())}
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    new = stages()
    return max(s.shuffleWriteRecords() for s in map(new.apply, range(new.size())) if s.stageId() not in seen)


@pytest.mark.parametrize("name", USERS)
def test_patches_are_shuffled_not_pixels(spark, odd, name):
    """200 patches are 12,800 pixels, which with their neighbours were 115,200 rows."""
    most = shuffled(spark, lambda: same(spark, odd, name))
    assert 0 < most < 12800 / 4


def test_corrected_patches_are_left_out_as_stored_rows(spark, odd):
    """m16: neither a join nor a sort meets a patch's 64 pixels."""
    plan = registry.queries()["m16_two_pass_score"](spark, odd)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    anti, made = ([k for k, line in enumerate(plan) if w in line] for w in ("LeftAnti", "Generate posexplode"))
    assert len(anti) == len(made) == 2 and all(g < a for g, a in zip(made, anti)) and anti[0] < made[1]
