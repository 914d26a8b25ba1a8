"""Connected components: few links in one task, many by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, tempfile.mkdtemp(prefix="tessera-"))
    return base.rstrip("/")


def shared(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL = 500_000  #: links that one task closes by itself, counted first


def _closed(arrow: pa.DataType):
    """Union-find over all links of the one partition: (node, root), the smallest node standing for each component."""

    def run(batches):
        up: dict = {}

        def find(x):
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for v in (x, y):
                    up.setdefault(v, v)
                x, y = find(x), find(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        for k in range(0, len(nodes), 20_000):
            some = nodes[k : k + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, arrow), pa.array([find(v) for v in some], arrow)], ["node", "root"])

    return run


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, root): the smallest node reachable over undirected links (a, b). At most ``small`` links are closed in one task, more by rounds."""
    e = shared(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if e.limit(small + 1).count() <= small:
        kind = e.schema["a"].dataType
        return shared(e.coalesce(1).mapInArrow(_closed(to_arrow_type(kind)), f"node {kind.simpleString()}, root {kind.simpleString()}"))
    before = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = shared(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        e = shared(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
