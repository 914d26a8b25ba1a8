"""Guards of the label operators: dark, flat and null patches."""

from tessera.operators import enhance, labels


def test_dark_flat_and_null(spark):
    rows = [(1, [0] * 64), (2, [120] * 64), (3, None), (4, [20] * 5 + [0] * 59), (5, [])]
    p = spark.createDataFrame(rows, "pid long, px array<int>")
    got = {r.pid: r for r in labels.proxy_label(p).collect()}
    assert all(got[k].candidates == 0 and got[k].coverage_pct in (0, None) for k in (1, 2, 3, 4, 5))
    assert got[1].threshold == 0 and got[2].threshold == 4 and got[4].threshold == 0
    p = p.filter("pid < 5")
    for f in (enhance.illumination_normalize, enhance.retinex):
        a = {r.pid: r.a for r in f(p).collect()}
        assert a[1] == rows[0][1] and a[2] == rows[1][1] and a[4] == rows[3][1]
    a = {r.pid: r.a for r in enhance.unsharp(p).collect()}
    assert a[1] == rows[0][1] and a[2] == rows[1][1]


def test_unknown_step_is_passed_over(spark):
    p = spark.createDataFrame([(1, [50] * 64)], "pid long, px array<int>")
    r = enhance.run_chain(p, ["nothing", "unsharp_mask"]).first()
    assert r.skipped == ["nothing"] and r.px == [50] * 64


def test_empty_table(spark):
    p = spark.createDataFrame([], "pid long, px array<int>")
    assert labels.proxy_label(p).count() == 0 and enhance.sigma_search(p).count() == 0
