"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Four ratios per document are sketched per language and source: a histogram over
log-linear buckets (the four bits after the leading bit are kept, so a value is
known within 1/16), whose merge is a sum of counts.  Group sketches merge into
language sketches and those into one for the corpus.  A ratio is an outlier
beyond the quartiles by three interquartile ranges, and at least by the slack of
its rule.  Groups of fewer than MIN_GROUP documents use their language's
thresholds, and small languages the corpus's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riselens.llm.common import SPACE
from riselens.session import checkpoint

MIN_GROUP = 50
#: ratio (per thousand): numerator, denominator, least distance from the quartiles, lower side too
RULES = {
    "word_length": ("word_chars", "n_words", 2000, True),
    "symbols": ("n_symbols", "n_words", 100, False),
    "dup_lines": ("n_dup_lines", "n_lines", 200, False),
    "repeats": ("n_repeat_words", "n_words", 150, False),
}


def base_values(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the kept columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    keep = list(keep)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *keep, text.alias("t"))
    words = F.filter(F.split("t", SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split("t", "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    rows = rows.select("doc_id", *keep, words.alias("w"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))
    rows = rows.select(
        "doc_id", *keep, "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    n = F.greatest(F.size("h") - 2, F.lit(0))
    pairs = F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice("h", F.lit(3), n), lambda a, b: F.xxhash64(a, b))
    rows = rows.withColumn("k", windows).drop("h")
    rows = rows.withColumn("s", F.sort_array(F.transform("k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))).drop("k")
    rows = rows.withColumn("m", F.greatest(F.size("s") - 1, F.lit(0)))
    twice = F.flatten(F.zip_with(F.slice("s", F.lit(1), F.col("m")), F.slice("s", F.lit(2), F.col("m")), lambda a, b: F.when(a["k"] == b["k"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("twice", twice).drop("s", "m")
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda i: F.array(i, i + 1, i + 2))))
    return rows.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("twice")


def ratio(rule: str) -> Column:
    top, under, *_ = RULES[rule]
    return F.floor(1000 * F.col(top) / F.col(under)).cast("long")


def bucket(x: Column) -> Column:
    """x with all bits after the leading five cleared."""
    shift = F.greatest(F.length(F.bin(x)) - 5, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def quantile_sketch(values: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts per key and rule."""
    return values.groupBy(*keys, "rule", "bucket").agg(F.count("*").alias("c"))


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("c").alias("c"))


def quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Per key and rule: n, q1, q3 (the lower ends of their buckets), with ``tag`` appended."""
    w = Window.partitionBy(*keys, "rule")
    run = sketch.withColumns({"run": F.sum("c").over(w.orderBy("bucket")), "n": F.sum("c").over(w)})
    least = lambda part: F.min(F.when(F.col("run") * 4 >= F.col("n") * part, F.col("bucket")))
    return run.groupBy(*keys, "rule").agg(F.max("n").alias("n" + tag), least(1).alias("q1" + tag), least(3).alias("q3" + tag))


def thresholds(values: DataFrame) -> DataFrame:
    """lang, source and for each rule low_/high_ bounds."""
    sketch = checkpoint(quantile_sketch(values, ["lang", "source"]))
    by_lang = merge(sketch, ["lang"])
    whole = merge(sketch, [])
    q = quartiles(sketch, ["lang", "source"], "").join(quartiles(by_lang, ["lang"], "_l"), ["lang", "rule"]).join(quartiles(whole, [], "_c"), "rule")
    pick = lambda c: F.when(F.col("n") >= MIN_GROUP, F.col(c)).when(F.col("n_l") >= MIN_GROUP, F.col(c + "_l")).otherwise(F.col(c + "_c"))
    q = q.select("lang", "source", "rule", pick("q1").alias("q1"), pick("q3").alias("q3"))
    out = []
    for rule, (_, _, slack, both) in RULES.items():
        reach = F.greatest(3 * (F.col("q3") - F.col("q1")), F.lit(slack))
        out.append(F.max(F.when(F.col("rule") == rule, F.col("q3") + reach)).alias("high_" + rule))
        if both:
            out.append(F.max(F.when(F.col("rule") == rule, F.col("q1") - reach)).alias("low_" + rule))
    return q.groupBy("lang", "source").agg(*out)


def filter_quality(docs: DataFrame) -> DataFrame:
    """doc_id, base values, base_failed and kept, one row per row of ``docs``.

    Documents without words fail the base rules and enter no sketch.  Null
    languages and sources count as empty strings; null texts have no words;
    rows with null or repeated doc_ids are judged one by one; an empty table
    stays empty; extra columns are ignored.
    """
    named = docs.select("doc_id", "text", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")))
    base = checkpoint(base_values(named, "lang", "source"))
    each = F.array(*(F.struct(F.lit(r).alias("rule"), bucket(ratio(r)).alias("bucket")) for r in RULES))
    values = base.where("n_words > 0").select("lang", "source", F.explode(each).alias("v")).select("lang", "source", "v.rule", "v.bucket")
    bounds = thresholds(values)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for rule, (*_, both) in RULES.items():
        fits = fits & (ratio(rule) <= F.col("high_" + rule))
        if both:
            fits = fits & (ratio(rule) >= F.col("low_" + rule))
    kept = F.when(failed, F.lit(False)).otherwise(fits)
    out = base.join(bounds, ["lang", "source"], "left").withColumns({"base_failed": failed, "kept": kept})
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov ON w.r = cov.r),
x AS (SELECT r, lang, source, 'word_length' AS rule, 1000 * word_chars // n_words AS x FROM b WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'symbols', 1000 * n_symbols // n_words FROM b WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'dup_lines', 1000 * n_dup_lines // n_lines FROM b WHERE n_words > 0
  UNION ALL SELECT r, lang, source, 'repeats', 1000 * n_repeat_words // n_words FROM b WHERE n_words > 0),
v AS (SELECT *, (x >> greatest(length(bin(x)) - 5, 0)) << greatest(length(bin(x)) - 5, 0) AS k FROM x),
s AS (SELECT lang, source, rule, k, row_number() OVER g AS i, count(*) OVER (PARTITION BY lang, source, rule) AS n,
  row_number() OVER (PARTITION BY lang, rule ORDER BY k) AS i_l, count(*) OVER (PARTITION BY lang, rule) AS n_l,
  row_number() OVER (PARTITION BY rule ORDER BY k) AS i_c, count(*) OVER (PARTITION BY rule) AS n_c
  FROM v WINDOW g AS (PARTITION BY lang, source, rule ORDER BY k)),
qg AS (SELECT lang, source, rule, max(n) AS n, max(n_l) AS n_l, min(k) FILTER (i * 4 >= n) AS q1, min(k) FILTER (i * 4 >= 3 * n) AS q3 FROM s GROUP BY ALL),
ql AS (SELECT lang, rule, min(k) FILTER (i_l * 4 >= n_l) AS q1, min(k) FILTER (i_l * 4 >= 3 * n_l) AS q3 FROM s GROUP BY ALL),
qc AS (SELECT rule, min(k) FILTER (i_c * 4 >= n_c) AS q1, min(k) FILTER (i_c * 4 >= 3 * n_c) AS q3 FROM s GROUP BY ALL),
q AS (SELECT qg.lang, qg.source, qg.rule, CASE WHEN n >= 50 THEN qg.q1 WHEN n_l >= 50 THEN ql.q1 ELSE qc.q1 END AS q1,
  CASE WHEN n >= 50 THEN qg.q3 WHEN n_l >= 50 THEN ql.q3 ELSE qc.q3 END AS q3,
  CASE qg.rule WHEN 'word_length' THEN 2000 WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 200 ELSE 150 END AS slack
  FROM qg JOIN ql ON qg.lang = ql.lang AND qg.rule = ql.rule JOIN qc ON qg.rule = qc.rule),
bad AS (SELECT DISTINCT r FROM v JOIN q USING (lang, source, rule) WHERE x > q3 + greatest(3 * (q3 - q1), slack) OR rule = 'word_length' AND x < q1 - greatest(3 * (q3 - q1), slack))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.r IS NULL AS kept FROM b LEFT JOIN bad ON b.r = bad.r
"""
