"""Scans of collection folders: one scan per table, whatever its part files are."""

from pyspark.sql import functions as F

from riselens.sources import io as IO


def _scans(df):
    return df._jdf.queryExecution().analyzed().collectLeaves().size()


def _rows(df, *cols):
    return sorted(df.select(*cols).collect(), key=repr)


def _posts(spark, n):
    return spark.range(n).select(F.col("id").cast("string").alias("post_id"), (F.col("id") % 7).alias("score"),
                                 (F.col("id") * 90_000.0).alias("created_timestamp"))


def test_part_files_of_a_table_are_one_scan(spark, tmp_path):
    root = str(tmp_path)
    posts = _posts(spark, 60)
    IO.write_posts(posts.repartition(4, "post_id"), f"{root}/reddit_posts.parquet", ["date"])
    posts.withColumn("extra", F.lit("x")).repartition(3).write.parquet(f"{root}/hackernews_posts.parquet")
    assert len(IO.list_files(spark, root)) > 50
    got = IO.scan_posts(spark, root, "reddit")
    assert _scans(got) == 1 and got.columns == posts.columns
    assert _rows(got, *posts.columns) == _rows(posts, *posts.columns)
    both = IO.scan_posts(spark, root, "both")
    assert _scans(both) == 2 and set(both.columns) == {*posts.columns, "extra"}
    assert both.count() == 120 and both.where("extra IS NULL").count() == 60


def test_part_files_of_snapshots_are_one_scan(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(40).select(F.col("id").alias("story_id"), F.lit(1.5).alias("story_age_minutes"))
    rows.repartition(8).write.parquet(f"{root}/runs/b/hn_snapshots.parquet")
    got = IO.scan_snapshots(spark, root)
    assert _scans(got) == 1
    assert _rows(got, "post_id") == _rows(rows.select(F.col("story_id").cast("string").alias("post_id")), "post_id")


def test_tables_within_tables_and_unwanted_files_are_kept_apart(spark, tmp_path):
    root = str(tmp_path)
    _posts(spark, 5).coalesce(1).write.parquet(f"{root}/reddit_a.parquet")
    _posts(spark, 3).withColumn("own", F.lit(1)).coalesce(1).write.parquet(f"{root}/reddit_a.parquet/more.parquet")
    _posts(spark, 9).coalesce(1).write.parquet(f"{root}/reddit_a.parquet/features")
    spark.range(2).write.csv(f"{root}/reddit_a.parquet/notes")
    _posts(spark, 4).coalesce(1).write.parquet(f"{root}/reddit_loose")
    got = IO.scan_posts(spark, root, "reddit")
    assert got.count() == 5 + 3 + 4 and got.where("own = 1").count() == 3


def test_files_of_one_table_may_differ(spark, tmp_path):
    """Columns of any file appear, and a column held in two types is widened."""
    root = str(tmp_path)
    table = f"{root}/reddit_posts.parquet"
    _posts(spark, 3).write.parquet(table)
    _posts(spark, 2).withColumn("late", F.lit("y")).write.mode("append").parquet(table)
    got = IO.scan_posts(spark, root)
    assert got.count() == 5 and got.where("late = 'y'").count() == 2
    _posts(spark, 2).withColumn("score", F.lit(0.5)).write.mode("append").parquet(table)
    got = IO.scan_posts(spark, root)
    assert got.count() == 7 and got.where("score = 0.5").count() == 2 and dict(got.dtypes)["score"] == "double"
