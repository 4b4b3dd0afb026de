"""Scans and sinks (IO1–IO13) on Spark's file sources.

Path selection is done by the file source itself (glob, ``pathGlobFilter``,
``recursiveFileLookup``) or by a filter on ``_metadata.file_path``; both keep
the scan lazy and let Catalyst prune columns and push filters.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path fragments that mark derived tables, never posts (IO1).
EXCLUDED_FRAGMENTS = ["snapshots", "features", "stage_predictions"]
PLATFORM_PREFIX = {"reddit": "reddit_", "hackernews": "hackernews_"}

RAW_REDDIT_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("subreddit", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("created_utc", T.DoubleType()),
    T.StructField("author", T.StringType()), T.StructField("is_self", T.BooleanType()),
    T.StructField("url", T.StringType()), T.StructField("domain", T.StringType()),
    T.StructField("upvote_ratio", T.DoubleType()), T.StructField("score", T.LongType()),
    T.StructField("num_comments", T.LongType()), T.StructField("selftext", T.StringType()),
    T.StructField("over_18", T.BooleanType()), T.StructField("spoiler", T.BooleanType()),
    T.StructField("stickied", T.BooleanType()),
])
RAW_HN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("score", T.LongType()),
    T.StructField("by", T.StringType()), T.StructField("time", T.LongType()),
    T.StructField("descendants", T.LongType()), T.StructField("kids", T.ArrayType(T.LongType())),
    T.StructField("dead", T.BooleanType()), T.StructField("deleted", T.BooleanType()),
])
TEXT_LIMIT = 500


def list_files(spark: SparkSession, directory: str, suffix: str = ".parquet") -> list[str]:
    """Recursive file listing through the Hadoop file system (metadata only)."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    it = fs.listFiles(root, True)
    out = []
    while it.hasNext():
        path = it.next().getPath().toString()
        name = path.rsplit("/", 1)[-1]
        if path.endswith(suffix) and not name.startswith(("_", ".")):
            out.append(path)
    return sorted(out)


def _tables(spark: SparkSession, directory: str, keep) -> list[list[str]]:
    """What to read for every table below ``directory``: the paths of its files whose relative path satisfies ``keep``.

    A table is the deepest folder ending in .parquet, or a file in no such
    folder.  A folder whose files are all wanted is named as a whole, so that
    its part files are one scan however many they are.
    """
    base = directory.rstrip("/")
    wanted: dict[str, list[str]] = {}
    below: dict[str, int] = {}
    for path in list_files(spark, directory):
        rel = path.split(base.split(":", 1)[-1], 1)[-1].lstrip("/")
        parts = rel.split("/")
        folders = ["/".join(parts[:i + 1]) for i, p in enumerate(parts[:-1]) if p.endswith(".parquet")]
        for folder in folders:
            below[folder] = below.get(folder, 0) + 1
        if keep(rel):
            wanted.setdefault(folders[-1] if folders else rel, []).append(rel)
    return [[f"{base}/{rel}" for rel in ([table] if below.get(table) == len(files) else files)]
            for table, files in sorted(wanted.items())]


def _read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files of one table, with the columns of any of them.

    Partition folders give no columns.  Files that hold a column in different
    types are read one by one and widened.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        return reader.option("mergeSchema", "true").parquet(*paths)
    except (PySparkException, Py4JJavaError) as e:
        if "CANNOT_MERGE_SCHEMAS" not in str(e):
            raise
    return _union([spark.read.parquet(f) for p in paths for f in list_files(spark, p)])


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise FileNotFoundError("no matching parquet tables")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_posts(spark: SparkSession, directory: str, platform: str = "both") -> DataFrame:
    """IO1: every post table below a folder whose name has the platform prefix
    (``reddit_*`` / ``hackernews_*``; any for 'both'), excluding snapshot /
    feature / prediction outputs; tables are unioned by name (missing columns
    null), like concatenating per-file frames."""
    prefix = PLATFORM_PREFIX.get(platform)

    def keep(rel: str) -> bool:
        if any(f in rel for f in EXCLUDED_FRAGMENTS):
            return False
        return prefix is None or rel.split("/")[0].startswith(prefix)

    return _union([_read(spark, paths) for paths in _tables(spark, directory, keep)])


def scan_snapshots(spark: SparkSession, directory: str) -> DataFrame:
    """IO2: every ``*snapshots*`` table at any depth; HN names unified."""
    tables = _tables(spark, directory, lambda rel: "snapshots" in rel)
    return _union([canonical_snapshots(_read(spark, paths)) for paths in tables])


def canonical_snapshots(df: DataFrame) -> DataFrame:
    """HN snapshot names (story_id, story_age_minutes, descendants) -> canonical."""
    ren = {"story_id": "post_id", "story_age_minutes": "post_age_minutes", "descendants": "num_comments"}
    for a, b in ren.items():
        if a in df.columns:
            df = df.withColumn(b, F.coalesce(F.col(b), F.col(a)) if b in df.columns else F.col(a)).drop(a)
    if "post_id" in df.columns:
        df = df.withColumn("post_id", F.col("post_id").cast("string"))
    return df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """IO3 / IO5: parquet if present, else the csv of the same name."""
    root, ext = os.path.splitext(path)
    candidates = [path] if ext else [root + ".parquet", root + ".csv"]
    if ext == ".parquet":
        candidates.append(root + ".csv")
    for cand in candidates:
        if path_exists(spark, cand):
            if cand.endswith(".csv"):
                return spark.read.option("header", "true").option("inferSchema", "true").csv(cand)
            return spark.read.parquet(cand)
    raise FileNotFoundError(path)


def write_posts(df: DataFrame, path: str, partition_cols: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """IO4: parquet sink; a ``date`` partition is derived from created_timestamp."""
    out = df
    if partition_cols and "date" in partition_cols and "created_timestamp" in df.columns:
        out = out.withColumn("date", F.to_date(F.timestamp_micros(F.round(F.col("created_timestamp") * 1_000_000).cast("long"))))
    w = out.write.mode(mode)
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO6: csv sink with a header."""
    df.write.mode(mode).option("header", "true").csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO7: JSON report sink (one row of nested structs / maps / arrays)."""
    df.coalesce(1).write.mode(mode).json(path)


def parse_raw_posts(json_df: DataFrame, platform: str, column: str = "value") -> DataFrame:
    """IO8: landed JSON records -> fixed field list; 500-char text cut;
    HN: only ``type == 'story'``, kid count."""
    if platform == "reddit":
        r = json_df.select(F.from_json(F.col(column), RAW_REDDIT_SCHEMA).alias("r")).select("r.*")
        return r.withColumn("selftext", F.substring(F.coalesce(F.col("selftext"), F.lit("")), 1, TEXT_LIMIT))
    r = json_df.select(F.from_json(F.col(column), RAW_HN_SCHEMA).alias("r")).select("r.*")
    r = r.filter(F.col("type") == "story")
    return r.select(
        "id", "title", "url", F.substring(F.coalesce(F.col("text"), F.lit("")), 1, TEXT_LIMIT).alias("text"),
        "score", "by", "time", "descendants", F.coalesce(F.size("kids"), F.lit(0)).cast("long").alias("kids"),
        "dead", "deleted",
    )


def historical(df: DataFrame, start_epoch: float, end_epoch: float, max_rows: int = 1000,
               ts: str = "time", key: str = "id") -> DataFrame:
    """IO9: stories in [start, end], newest first, capped at ``max_rows``
    (the cap is the operator's feature: a bounded fetch)."""
    t = F.col(ts).cast("double")
    return df.filter(t.between(float(start_epoch), float(end_epoch))).orderBy(t.desc(), F.col(key).desc()).limit(max_rows)


def append_slice(df: DataFrame, known: DataFrame, run_id: str, ingested_ts: float, path: str | None = None,
                 key: str = "post_id") -> DataFrame:
    """IO11: unseen posts stamped with the run id / time (and appended, when a
    path is given, partitioned by run id)."""
    fresh = df.join(known.select(key).distinct(), key, "left_anti").withColumns({
        "collection_run_id": F.lit(run_id), "ingested_timestamp": F.lit(float(ingested_ts)),
    })
    if path:
        fresh.write.mode("append").partitionBy("collection_run_id").parquet(path)
    return fresh


def collection_summary(df: DataFrame, key: str = "subreddit") -> DataFrame:
    """IO13: per community rows, top/new counts, min/max/avg score."""
    s = F.col("score").cast("double")
    ct = F.col("collection_type") if "collection_type" in df.columns else F.lit(None).cast("string")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(ct == "top").alias("top_rows"),
        F.count_if(ct == "new").alias("new_rows"),
        F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("avg_score"),
    )
