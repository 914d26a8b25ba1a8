"""Record-level operators: resolution, filters, splits, ranking, merging, tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.fixtures import duck, table, view

EDGES = (1.0, 3.0, 8.0, 20.0, 100.0)
SEED = 42


def with_mask_source(records: DataFrame, corrected: DataFrame) -> DataFrame:
    """Corrected masks win over proxy masks."""
    c = corrected.select("doc_id", F.lit(True).alias("_c"))
    return records.join(c, "doc_id", "left").withColumn("mask_source", F.when(F.col("_c"), "corrected").otherwise("proxy")).drop("_c")


@query("r01_corrected_over_proxy", duck("record corrected", "SELECT r.patch_id, CASE WHEN c.doc_id IS NULL THEN 'proxy' ELSE 'corrected' END AS mask_source FROM fx_record r LEFT JOIN fx_corrected c ON c.doc_id = r.doc_id"))
def r01(spark, sf):
    return with_mask_source(view(spark, sf, "record"), view(spark, sf, "corrected")).select("patch_id", "mask_source")


@query("r02_filter_uncorrected", duck("record corrected", "SELECT patch_id FROM fx_record WHERE doc_id NOT IN (SELECT doc_id FROM fx_corrected)"))
def r02(spark, sf):
    return view(spark, sf, "record").join(view(spark, sf, "corrected"), "doc_id", "left_anti").select("patch_id")


@query("r03_unannotated", duck("record corrected event", "SELECT patch_id FROM fx_record WHERE doc_id NOT IN (SELECT doc_id FROM fx_event UNION SELECT doc_id FROM fx_corrected)"))
def r03(spark, sf):
    done = view(spark, sf, "event").select("doc_id").union(view(spark, sf, "corrected").select("doc_id"))
    return view(spark, sf, "record").join(done, "doc_id", "left_anti").select("patch_id")


@query("r04_get_unannotated_ids", duck("record event", "SELECT doc_id AS ordinal, patch_id FROM fx_record r WHERE NOT EXISTS (SELECT 1 FROM fx_event e WHERE e.doc_id = r.doc_id)"))
def r04(spark, sf):
    return view(spark, sf, "record").join(view(spark, sf, "event"), "doc_id", "left_anti").select(F.col("doc_id").alias("ordinal"), "patch_id")


def metric_reason(include_corrected: bool):
    corrected = F.col("mask_source") == "corrected"
    first = F.when(corrected & F.lit(not include_corrected), "corrected")
    return first.when(~F.col("files_exist"), "missing").when(F.col("doc_id") % 13 == 5, "true_negative").otherwise("kept")


_R05 = "SELECT CASE WHEN c.doc_id IS NOT NULL AND {f} THEN 'corrected' WHEN NOT files_exist THEN 'missing' WHEN r.doc_id % 13 = 5 THEN 'true_negative' ELSE 'kept' END AS reason, count(*) AS n FROM fx_record r LEFT JOIN fx_corrected c ON c.doc_id = r.doc_id GROUP BY 1"


@query("r05_filter_metrics", duck("record corrected", _R05.format(f="true")))
def r05(spark, sf):
    r = with_mask_source(view(spark, sf, "record"), view(spark, sf, "corrected"))
    return r.groupBy(metric_reason(False).alias("reason")).agg(F.count("*").alias("n"))


@query("r05b_filter_metrics_all", duck("record corrected", _R05.format(f="false")))
def r05b(spark, sf):
    r = with_mask_source(view(spark, sf, "record"), view(spark, sf, "corrected"))
    return r.groupBy(metric_reason(True).alias("reason")).agg(F.count("*").alias("n"))


def patch_dice(pred: DataFrame, threshold: float = 0.58) -> DataFrame:
    """Hard Dice of each patch; NULL if both masks are empty."""
    p, y = (F.col("p") > threshold).cast("long"), F.col("truth").cast("long")
    s = pred.groupBy("pid").agg(F.sum(p * y).alias("i"), F.sum(p + y).alias("t"))
    return s.select("pid", F.when(F.col("t") > 0, (2 * F.col("i") + 1e-6) / (F.col("t") + 1e-6)).alias("dice"))


DICE = "dice AS (SELECT pid, CASE WHEN sum(CAST(p > 0.58 AS INT) + CAST(truth AS INT)) > 0 THEN (2 * sum(CAST(p > 0.58 AND truth AS INT)) + CAST(1e-6 AS DOUBLE)) / (sum(CAST(p > 0.58 AS INT) + CAST(truth AS INT)) + CAST(1e-6 AS DOUBLE)) END AS dice FROM fx_pred GROUP BY pid)"


def upper_median(df: DataFrame, column: str, bins: int = 4096) -> DataFrame:
    """One row: the value of rank n // 2 + 1 of values in [0, 1], exactly, without a global sort.

    A histogram of ``bins`` rows tells the bin that holds it; only that bin's distinct values are ranked.
    """
    binned = df.select(F.col(column).alias("v"), F.floor(F.col(column) * bins).alias("bin"))
    counts = binned.groupBy("bin").agg(F.count("*").alias("c"))
    n = counts.agg((F.expr("sum(c) DIV 2 + 1")).alias("rank"))
    cum = counts.withColumn("hi", F.sum("c").over(W.orderBy("bin"))).crossJoin(F.broadcast(n))
    at = cum.filter("hi >= rank").agg(F.min_by(F.struct("bin", (F.col("rank") - F.col("hi") + F.col("c")).alias("rank")), "bin").alias("at")).select("at.bin", "at.rank")
    inside = binned.join(F.broadcast(at), "bin").groupBy("v", "rank").agg(F.count("*").alias("c"))
    return inside.withColumn("hi", F.sum("c").over(W.orderBy("v"))).filter("hi >= rank").agg(F.min("v").alias("value"))


@query("r06_dice_ranking_summary", duck("pred", f"WITH {DICE}, o AS (SELECT dice, row_number() OVER (ORDER BY dice, pid) AS k, count(*) OVER () AS n FROM dice WHERE dice IS NOT NULL) SELECT round(min(dice), 6) AS worst, round(max(CASE WHEN k = n // 2 + 1 THEN dice END), 6) AS upper_median, round(avg(CASE WHEN k <= 150 THEN dice END), 6) AS top_mean, count(*) AS n FROM o"))
def r06(spark, sf, top_k: int = 150):
    d = patch_dice(view(spark, sf, "pred")).filter("dice IS NOT NULL").select(F.round("dice", 12).alias("dice"), "pid")
    top = d.orderBy("dice", "pid").limit(top_k).agg(F.avg("dice").alias("top_mean"))
    med = upper_median(d, "dice").withColumnRenamed("value", "upper_median")
    return d.agg(F.min("dice").alias("worst"), F.count("*").alias("n")).crossJoin(med).crossJoin(top).select(F.round("worst", 6).alias("worst"), F.round("upper_median", 6).alias("upper_median"), F.round("top_mean", 6).alias("top_mean"), "n")


@query("r07_dice_audit_queue", duck("pred", f"WITH {DICE}, q AS (SELECT pid, round(dice, 6) AS dice FROM dice WHERE dice IS NOT NULL) SELECT row_number() OVER (ORDER BY dice, pid) AS rank, pid, dice FROM q ORDER BY dice, pid LIMIT 150"))
def r07(spark, sf, top_k: int = 150):
    # ranked as exported: rounded values, ties by id
    top = patch_dice(view(spark, sf, "pred")).filter("dice IS NOT NULL").select("pid", F.round("dice", 6).alias("dice")).orderBy("dice", "pid").limit(top_k)
    return top.select(F.row_number().over(W.orderBy("dice", "pid")).cast("long").alias("rank"), "pid", "dice")


@query("r09_filter_by_mosaic", duck("record", "SELECT patch_id FROM fx_record WHERE contains(patch_id, 'src1')"))
def r09(spark, sf, name: str = "src1"):
    return view(spark, sf, "record").filter(F.col("patch_id").contains(name)).select("patch_id")


@query("r09b_filter_by_mosaic_exact", duck("record", "SELECT patch_id FROM fx_record WHERE mosaic_id = 'src1'"))
def r09b(spark, sf, name: str = "src1"):
    return view(spark, sf, "record").filter(F.col("mosaic_id") == name).select("patch_id")


def coverage_bin(c):
    out = F.when(c.isNull() | (c <= EDGES[0]), 0)
    for k, e in enumerate(EDGES[1:-1], 1):
        out = out.when(c <= e, k)
    return out.otherwise(len(EDGES) - 1)


_BIN = "CASE WHEN coverage_pct IS NULL OR coverage_pct <= 1 THEN 0 WHEN coverage_pct <= 3 THEN 1 WHEN coverage_pct <= 8 THEN 2 WHEN coverage_pct <= 20 THEN 3 ELSE 4 END"


@query("r11_coverage_bin", duck("record", f"SELECT patch_id, {_BIN} AS bin FROM fx_record"))
def r11(spark, sf):
    return view(spark, sf, "record").select("patch_id", coverage_bin(F.col("coverage_pct")).alias("bin"))


def merge_rare(binned: DataFrame, least: int = 2, share: float = 0.0) -> DataFrame:
    """bin -> the nearest bin with enough members, in number and as a share of all (the lower one on a tie). Bins are few by definition."""
    n = binned.groupBy("bin").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("all"))
    safe = n.crossJoin(F.broadcast(total)).filter((F.col("n") >= least) & (F.col("n") >= share * F.col("all"))).select(F.col("bin").alias("to"))
    near = n.join(F.broadcast(safe)).groupBy("bin").agg(F.min(F.struct(F.abs(F.col("bin") - F.col("to")).alias("d"), "to")).alias("m"))
    return near.select("bin", F.col("m.to").alias("stratum"))


@query("r12_rare_stratum_merge", duck("record", f"WITH b AS (SELECT {_BIN} AS bin, count(*) AS n FROM fx_record GROUP BY 1), p AS (SELECT a.bin, s.bin AS t, row_number() OVER (PARTITION BY a.bin ORDER BY abs(a.bin - s.bin), s.bin) AS k FROM b a, b s WHERE 5 * s.n >= (SELECT sum(n) FROM b)) SELECT bin, t AS stratum FROM p WHERE k = 1"))
def r12(spark, sf):
    """A bin is rare here if it holds less than a fifth of all records, so that rare bins occur at every size."""
    return merge_rare(view(spark, sf, "record").select(coverage_bin(F.col("coverage_pct")).alias("bin")), share=0.2)


def split_records(records: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """80/10/10 inside each stratum, in order of md5(seed:id); shares are rounded half up, the rest is the test split.

    Places in the order come from ranges of the hash: 4,096 a stratum, whose counts are summed up, so no stratum is sorted in one task.
    """
    b = records.withColumn("bin", coverage_bin(F.col("coverage_pct")))
    b = b.join(F.broadcast(merge_rare(b)), "bin")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))
    b = b.withColumn("h", key)
    n = b.groupBy("stratum").agg(F.count("*").alias("n"))
    b = b.withColumn("range", F.substring("h", 1, 3))
    counts = b.groupBy("stratum", "range").agg(F.count("*").alias("c"))  # at most 4,096 rows a stratum
    before = counts.select("stratum", "range", (F.sum("c").over(W.partitionBy("stratum").orderBy("range")) - F.col("c")).alias("before"))
    b = b.join(F.broadcast(n), "stratum").join(F.broadcast(before), ["stratum", "range"])
    b = b.withColumn("k", F.col("before") + F.row_number().over(W.partitionBy("stratum", "range").orderBy("h"))).drop("range", "before")
    train, val = "(8 * n + 5) DIV 10", "(9 * n + 5) DIV 10"
    return b.withColumn("split", F.expr(f"CASE WHEN k <= {train} THEN 'train' WHEN k <= {val} THEN 'val' ELSE 'test' END")).drop("h", "n", "k", "bin")


_SPLIT = f"WITH b AS (SELECT *, {_BIN} AS bin FROM fx_record), n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin), p AS (SELECT a.bin, s.bin AS t, row_number() OVER (PARTITION BY a.bin ORDER BY abs(a.bin - s.bin), s.bin) AS k FROM n a, n s WHERE s.n >= 2), s AS (SELECT b.*, p.t AS stratum FROM b JOIN p ON p.bin = b.bin AND p.k = 1), o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS k, count(*) OVER (PARTITION BY stratum) AS n FROM s), x AS (SELECT *, CASE WHEN k <= (8 * n + 5) // 10 THEN 'train' WHEN k <= (9 * n + 5) // 10 THEN 'val' ELSE 'test' END AS split FROM o)"


@query("r13_split_dataset", duck("record", _SPLIT + " SELECT patch_id, stratum, split FROM x"))
def r13(spark, sf):
    return split_records(view(spark, sf, "record")).select("patch_id", "stratum", "split")


@query("r10_filter_by_split", duck("record", _SPLIT + " SELECT patch_id FROM x WHERE split = 'val'"))
def r10(spark, sf, split: str = "val"):
    return split_records(view(spark, sf, "record")).filter(F.col("split") == split).select("patch_id")


DRAW_WEIGHT = f"(1 + {_BIN} / CAST(4 AS DOUBLE) * 4)"


@query("r14_sampler_weights", duck("record", f"SELECT patch_id, {DRAW_WEIGHT} AS weight FROM fx_record"))
def r14(spark, sf, multiplier: float = 5.0):
    if multiplier < 1:
        raise ValueError("multiplier must be at least 1")
    return view(spark, sf, "record").select("patch_id", (1 + coverage_bin(F.col("coverage_pct")) / F.lit(4.0) * (multiplier - 1)).alias("weight"))


_DIGEST = " , d AS (SELECT split, substr(md5(patch_id), 1, 3) AS r, count(*) AS n, md5(string_agg(patch_id, ',' ORDER BY patch_id)) AS m FROM x GROUP BY ALL) SELECT split, CAST(sum(n) AS BIGINT) AS n, md5(string_agg(m, ',' ORDER BY r)) AS ids_md5 FROM d GROUP BY split"


@query("r15_split_info", duck("record", _SPLIT + _DIGEST))
def r15(spark, sf):
    """Number and digest of each split's ids: by hash range first, so that no row holds all ids; then of the 4,096 ranges' digests."""
    s = split_records(view(spark, sf, "record")).withColumn("r", F.substring(F.md5(F.col("patch_id").cast("binary")), 1, 3))
    d = s.groupBy("split", "r").agg(F.count("*").alias("n"), F.md5(F.concat_ws(",", F.sort_array(F.collect_list("patch_id"))).cast("binary")).alias("m"))
    joined = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("r", "m"))), lambda x: x["m"]))
    return d.groupBy("split").agg(F.sum("n").alias("n"), F.md5(joined.cast("binary")).alias("ids_md5"))


def sample_per_group(df: DataFrame, group: str, k: int, seed: int = SEED) -> DataFrame:
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"))
    return df.withColumn("_k", F.row_number().over(W.partitionBy(group).orderBy(h))).filter(F.col("_k") <= k).drop("_k")


@query("r16_sample_per_mosaic", duck("record", "SELECT mosaic_id, patch_id FROM (SELECT *, row_number() OVER (PARTITION BY mosaic_id ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS k FROM fx_record) t WHERE k <= 10"))
def r16(spark, sf):
    return sample_per_group(view(spark, sf, "record"), "mosaic_id", 10).select("mosaic_id", "patch_id")


@query("r17_sample_patches", duck("record", "SELECT patch_id FROM fx_record WHERE files_exist ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)) LIMIT 25"))
def r17(spark, sf):
    return view(spark, sf, "record").filter("files_exist").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary"))).limit(25).select("patch_id")


@query("r18_copy_paste_sources", duck("record", "SELECT patch_id FROM fx_record WHERE coalesce(coverage_pct, 0) >= 5"))
def r18(spark, sf, least: float = 5.0):
    return view(spark, sf, "record").filter(F.coalesce("coverage_pct", F.lit(0.0)) >= least).select("patch_id")


def import_actions(entries: DataFrame, corrected: DataFrame, strategy: str, require_list: bool = False) -> DataFrame:
    """Action of each bundle entry against the masks that exist: untouched, imported, skipped or conflict (imported over)."""
    listed = F.when(F.col("has_list"), F.col("in_list")).otherwise(F.lit(not require_list) & (F.col("mask_source") != "untouched"))
    e = entries.join(corrected.select("doc_id", "mtime"), "doc_id", "left")
    rule = F.when(~listed, "untouched").when(F.col("mtime").isNull(), "imported")
    if strategy == "skip":
        rule = rule.otherwise("skipped")
    elif strategy == "newest":
        rule = rule.when(F.col("entry_minute") < F.col("mtime"), "skipped").otherwise("conflict")
    else:
        rule = rule.otherwise("conflict")
    return e.withColumn("action", rule)


def _r21(strategy: str) -> str:
    late = {"skip": "ELSE 'skipped'", "newest": "WHEN b.entry_minute < c.mtime THEN 'skipped' ELSE 'conflict'", "overwrite": "ELSE 'conflict'"}[strategy]
    return duck("bundle corrected", f"SELECT b.bundle_id, b.turn, CASE WHEN NOT (CASE WHEN has_list THEN in_list ELSE mask_source <> 'untouched' END) THEN 'untouched' WHEN c.doc_id IS NULL THEN 'imported' {late} END AS action FROM fx_bundle b LEFT JOIN fx_corrected c ON c.doc_id = b.doc_id")


for _s in ("skip", "newest", "overwrite"):

    @query(f"r21_import_bundle_{_s}", _r21(_s))
    def r21(spark, sf, strategy=_s):
        return import_actions(view(spark, sf, "bundle"), view(spark, sf, "corrected"), strategy).select("bundle_id", "turn", "action")


@query("r22_repack_bundle", duck("bundle corrected", "SELECT bundle_id, count(*) AS patch_count, count(*) FILTER (c.doc_id IS NOT NULL) AS corrected_count, count(*) FILTER (c.doc_id IS NULL) AS untouched_count, string_agg(CASE WHEN c.doc_id IS NOT NULL THEN CAST(turn AS VARCHAR) END, ',' ORDER BY turn) AS corrected_ids FROM fx_bundle b LEFT JOIN fx_corrected c ON c.doc_id = b.doc_id GROUP BY bundle_id"))
def r22(spark, sf):
    b = with_mask_source(view(spark, sf, "bundle").drop("mask_source"), view(spark, sf, "corrected"))
    is_c = F.col("mask_source") == "corrected"
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(is_c, F.col("turn")))), lambda t: t.cast("string")))
    return b.groupBy("bundle_id").agg(F.count("*").alias("patch_count"), F.count_if(is_c).alias("corrected_count"), F.count_if(~is_c).alias("untouched_count"), F.nullif(ids, F.lit("")).alias("corrected_ids"))


@query("r23_export_bundle", duck("record corrected", "SELECT mosaic_id, count(*) AS patch_count, count(c.doc_id) AS corrected, md5(string_agg(patch_id || CASE WHEN c.doc_id IS NULL THEN ':proxy' ELSE ':corrected' END, ',' ORDER BY patch_id)) AS contents_md5 FROM fx_record r LEFT JOIN fx_corrected c ON c.doc_id = r.doc_id GROUP BY mosaic_id"))
def r23(spark, sf):
    r = with_mask_source(view(spark, sf, "record"), view(spark, sf, "corrected"))
    line = F.concat_ws(":", "patch_id", "mask_source")
    return r.groupBy("mosaic_id").agg(F.count("*").alias("patch_count"), F.count_if(F.col("mask_source") == "corrected").alias("corrected"), F.md5(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("patch_id", line.alias("l")))), lambda s: s["l"])).cast("binary")).alias("contents_md5"))


@query("r24_max_patches", duck("record", "SELECT doc_id, patch_id FROM fx_record ORDER BY doc_id LIMIT 40"))
def r24(spark, sf, n: int = 40):
    return view(spark, sf, "record").orderBy("doc_id").limit(n).select("doc_id", "patch_id")


@query("r25_import_all", duck("bundle", "WITH u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bundle_id DESC, turn DESC) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM fx_bundle WHERE CASE WHEN has_list THEN in_list ELSE mask_source <> 'untouched' END) SELECT doc_id, bundle_id, turn, n AS writes FROM u WHERE k = 1"))
def r25(spark, sf):
    b = view(spark, sf, "bundle").filter("CASE WHEN has_list THEN in_list ELSE mask_source <> 'untouched' END")
    return b.groupBy("doc_id").agg(F.max(F.struct("bundle_id", "turn")).alias("m"), F.count("*").alias("writes")).select("doc_id", "m.bundle_id", "m.turn", "writes")


@query("r26_record_annotation", duck("event", "SELECT doc_id, arg_max(annotator, event_id) AS last_annotator, max(event_id) AS last_event, count(*) AS events, string_agg(annotator, ',' ORDER BY event_id) AS history FROM fx_event GROUP BY doc_id"))
def r26(spark, sf):
    e = view(spark, sf, "event")
    return e.groupBy("doc_id").agg(F.max_by("annotator", "event_id").alias("last_annotator"), F.max("event_id").alias("last_event"), F.count("*").alias("events"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("event_id", "annotator"))), lambda s: s["annotator"])).alias("history"))


@query("r26b_annotators", duck("event", "SELECT annotator, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_active FROM fx_event GROUP BY annotator"))
def r26b(spark, sf):
    return view(spark, sf, "event").groupBy("annotator").agg(F.count("*").alias("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_active"))


@query("r27_get_status", duck("event", "SELECT count(DISTINCT doc_id) AS annotated, (SELECT count(*) FROM documents) - count(DISTINCT doc_id) AS remaining, round(100.0 * count(DISTINCT doc_id) / greatest((SELECT count(*) FROM documents), 1), 4) AS percent FROM fx_event"))
def r27(spark, sf):
    total = table(spark, sf, "documents").agg(F.count("*").alias("t"))
    a = view(spark, sf, "event").agg(F.countDistinct("doc_id").alias("annotated"))
    return a.crossJoin(total).select("annotated", (F.col("t") - F.col("annotated")).alias("remaining"), F.round(F.lit(100.0) * F.col("annotated") / F.greatest("t", F.lit(1)), 4).alias("percent"))


@query("r28_resume_position", duck("record corrected", "SELECT coalesce(min(doc_id), 0) AS position FROM fx_record WHERE doc_id NOT IN (SELECT doc_id FROM fx_corrected)"))
def r28(spark, sf):
    return view(spark, sf, "record").join(view(spark, sf, "corrected"), "doc_id", "left_anti").agg(F.coalesce(F.min("doc_id"), F.lit(0)).cast("long").alias("position"))


@query("r29_idempotent_skip", duck("record", "SELECT DISTINCT mosaic_id FROM fx_record WHERE mosaic_id NOT IN (SELECT mosaic_id FROM fx_record WHERE NOT files_exist AND doc_id % 5 = 0)"))
def r29(spark, sf):
    r = view(spark, sf, "record")
    return r.select("mosaic_id").distinct().join(r.filter("NOT files_exist AND doc_id % 5 = 0"), "mosaic_id", "left_anti")


@query("r30_run_summary", duck("record", "SELECT count(*) AS mosaics, sum(coalesce(v, 0)) AS valid, sum(n) AS total FROM (SELECT mosaic_id, nullif(count(*) FILTER (files_exist), 0) AS v, count(*) AS n FROM fx_record GROUP BY mosaic_id) t"))
def r30(spark, sf):
    m = view(spark, sf, "record").groupBy("mosaic_id").agg(F.count_if("files_exist").alias("v"), F.count("*").alias("n"))
    return m.agg(F.count("*").alias("mosaics"), F.sum(F.coalesce("v", F.lit(0))).alias("valid"), F.sum("n").alias("total")).select("mosaics", F.col("valid").cast("decimal(38,0)").alias("valid"), F.col("total").cast("decimal(38,0)").alias("total"))


@query("r31_upsert_manifest", duck("record", "WITH u AS (SELECT mosaic_id, max(doc_id) AS v FROM fx_record GROUP BY mosaic_id UNION ALL SELECT mosaic_id, doc_id + 1000000 FROM fx_record WHERE doc_id % 50 = 0) SELECT mosaic_id, max(v) AS entry FROM u GROUP BY mosaic_id"))
def r31(spark, sf):
    r = view(spark, sf, "record")
    old, new = r.select("mosaic_id", F.col("doc_id").alias("v")), r.filter("doc_id % 50 = 0").select("mosaic_id", (F.col("doc_id") + 1000000).alias("v"))
    return old.unionByName(new).groupBy("mosaic_id").agg(F.max("v").alias("entry"))


@query("r32_threshold_resolution", duck("record", "SELECT patch_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN CAST(0.7 AS DOUBLE) END, CASE WHEN doc_id % 5 = 0 THEN CAST(0.6 AS DOUBLE) END, CASE WHEN doc_id % 7 = 0 THEN CAST(0.55 AS DOUBLE) END, CAST(0.5 AS DOUBLE)) AS threshold FROM fx_record"))
def r32(spark, sf):
    flag, stored, config = (F.when(F.col("doc_id") % m == 0, v) for m, v in ((3, 0.7), (5, 0.6), (7, 0.55)))
    return view(spark, sf, "record").select("patch_id", F.coalesce(flag, stored, config, F.lit(0.5)).alias("threshold"))


@query("r33_annotation_diff", duck("pred", "SELECT pid, count(*) FILTER (truth AND p > 0.58) AS kept, count(*) FILTER (NOT truth AND p > 0.58) AS added, count(*) FILTER (truth AND NOT p > 0.58) AS removed FROM fx_pred GROUP BY pid"))
def r33(spark, sf):
    p = F.col("p") > 0.58
    return view(spark, sf, "pred").groupBy("pid").agg(F.count_if(F.col("truth") & p).alias("kept"), F.count_if(~F.col("truth") & p).alias("added"), F.count_if(F.col("truth") & ~p).alias("removed"))


@query("r34_progress_count", duck("record event corrected", "SELECT count(DISTINCT doc_id) AS done FROM (SELECT doc_id FROM fx_event UNION ALL SELECT doc_id FROM fx_corrected) t WHERE doc_id IN (SELECT doc_id FROM fx_record)"))
def r34(spark, sf):
    done = view(spark, sf, "event").select("doc_id").union(view(spark, sf, "corrected").select("doc_id"))
    return done.join(view(spark, sf, "record"), "doc_id", "left_semi").agg(F.countDistinct("doc_id").alias("done"))


@query("r35_touched_reviewed", duck("event", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM fx_event WHERE action = 'click' UNION SELECT doc_id FROM fx_event WHERE action <> 'click') t) AS touched, (SELECT count(*) FROM (SELECT doc_id FROM fx_event WHERE action <> 'click' EXCEPT SELECT doc_id FROM fx_event WHERE action = 'click') t) AS reviewed_only"))
def r35(spark, sf):
    e = view(spark, sf, "event").groupBy("doc_id").agg(F.bool_or(F.col("action") == "click").alias("modified"))
    return e.agg(F.count("*").alias("touched"), F.count_if(~F.col("modified")).alias("reviewed_only"))


@query("r36_audit_manifest", duck("record corrected", "SELECT count(*) AS total, count(c.doc_id) AS corrected, count(*) FILTER (NOT files_exist) AS missing FROM fx_record r LEFT JOIN fx_corrected c ON c.doc_id = r.doc_id"))
def r36(spark, sf):
    r = with_mask_source(view(spark, sf, "record"), view(spark, sf, "corrected"))
    return r.agg(F.count("*").alias("total"), F.count_if(F.col("mask_source") == "corrected").alias("corrected"), F.count_if(~F.col("files_exist")).alias("missing"))


@query("r37_edit_selection", duck("record corrected", "SELECT doc_id, patch_id FROM fx_record WHERE contains(patch_id, 'src2') AND doc_id NOT IN (SELECT doc_id FROM fx_corrected)"))
def r37(spark, sf, mosaic: str | None = "src2", worst: int = 0, unannotated: bool = True, cap: int | None = None):
    """Mosaic before worst-N (0 is none) before all; then the unannotated filter; then the cap, in record order."""
    r = view(spark, sf, "record")
    if mosaic:
        r = r.filter(F.col("patch_id").contains(mosaic))
    elif worst:
        r = r.orderBy("coverage_pct", "doc_id").limit(worst)
    if unannotated:
        r = r.join(view(spark, sf, "corrected"), "doc_id", "left_anti")
    return (r.orderBy("doc_id").limit(cap) if cap else r).select("doc_id", "patch_id")


@query("r38_export_selection", duck("record corrected", _SPLIT + " SELECT patch_id FROM x WHERE split = 'test' AND doc_id NOT IN (SELECT doc_id FROM fx_corrected) ORDER BY doc_id LIMIT 50"))
def r38(spark, sf):
    r = split_records(view(spark, sf, "record")).filter("split = 'test'").join(view(spark, sf, "corrected"), "doc_id", "left_anti")
    return r.orderBy("doc_id").limit(50).select("patch_id")


@query("r39_import_tracking", duck("bundle", "SELECT annotator, count(*) AS events FROM fx_bundle WHERE has_list AND in_list GROUP BY annotator"))
def r39(spark, sf):
    return view(spark, sf, "bundle").filter("has_list AND in_list").groupBy("annotator").agg(F.count("*").alias("events"))


@query("r40_repack_name", duck("bundle", "SELECT DISTINCT bundle_id, 'bundle_' || CAST(bundle_id AS VARCHAR) || '_' || annotator || '.zip' AS name FROM fx_bundle"))
def r40(spark, sf):
    return view(spark, sf, "bundle").select("bundle_id", F.format_string("bundle_%d_%s.zip", "bundle_id", "annotator").alias("name")).distinct()


@query("r41_modified_patches", duck("pred", "SELECT pid, bool_or((p > 0.58) <> truth) AS modified FROM fx_pred GROUP BY pid"))
def r41(spark, sf):
    return view(spark, sf, "pred").groupBy("pid").agg(F.bool_or((F.col("p") > 0.58) != F.col("truth")).alias("modified"))


@query("r42_tracker_document", duck("event", "SELECT count(DISTINCT doc_id) AS patches, count(DISTINCT annotator) AS annotators, count(*) AS events FROM fx_event"))
def r42(spark, sf):
    return view(spark, sf, "event").agg(F.countDistinct("doc_id").alias("patches"), F.countDistinct("annotator").alias("annotators"), F.count("*").alias("events"))


@query("s05_collect_patch_records", duck("record", "SELECT patch_id FROM fx_record WHERE files_exist"))
def s05(spark, sf):
    r = view(spark, sf, "record")
    return r.join(r.filter("files_exist").select("patch_id"), "patch_id", "left_semi").select("patch_id")


@query("s06_all_records", duck("record", "SELECT patch_id, mosaic_id FROM fx_record"))
def s06(spark, sf):
    return view(spark, sf, "record").select("patch_id", "mosaic_id")


@query("s08_load_audit_queue", duck("record", "WITH q AS (SELECT row_number() OVER (ORDER BY coverage_pct DESC, doc_id) AS rank, CASE WHEN doc_id % 9 = 0 THEN 'gone' ELSE patch_id END AS patch_id FROM fx_record ORDER BY coverage_pct DESC, doc_id LIMIT 100) SELECT q.rank, q.patch_id, r.doc_id IS NOT NULL AS found FROM q LEFT JOIN fx_record r ON r.patch_id = q.patch_id"))
def s08(spark, sf):
    r = view(spark, sf, "record")
    q = r.orderBy(F.desc("coverage_pct"), "doc_id").limit(100)
    q = q.select(F.row_number().over(W.orderBy(F.desc("coverage_pct"), "doc_id")).cast("long").alias("rank"), F.when(F.col("doc_id") % 9 == 0, "gone").otherwise(F.col("patch_id")).alias("patch_id"))
    return q.join(r.select("patch_id", F.lit(True).alias("f")), "patch_id", "left").select("rank", "patch_id", F.coalesce("f", F.lit(False)).alias("found"))


@query("s14_bundle_contents", duck("bundle", "SELECT bundle_id, count(*) AS masks, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM fx_bundle WHERE mask_source <> 'untouched' GROUP BY bundle_id"))
def s14(spark, sf):
    b = view(spark, sf, "bundle").withColumn("name", F.format_string("patches/%d/mask.png", "turn")).filter("mask_source <> 'untouched'")
    b = b.filter(F.col("name").like("patches/%/mask.png")).withColumn("t", F.split("name", "/")[1].cast("long"))
    return b.groupBy("bundle_id").agg(F.count("*").alias("masks"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("t")), lambda t: t.cast("string"))).alias("turns"))
