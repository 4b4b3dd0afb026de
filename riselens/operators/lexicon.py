"""Lexicon sentiment (T11–T14) and gazetteer entity counts (T21–T24) as Spark jobs.

Both are relational: title tokens are exploded with their position, joined to
a caller-supplied table (lexicon: token -> valence; gazetteer: phrase ->
entity type), aggregated per post, and joined back.  Neighbour rules
(negation, booster) look at the previous token inside the token array before
the explode, so no window over a post is needed.  The lookup tables are
broadcast only after a row-count check (``attach_small``).

Sentiment follows the published rule-based scheme of Hutto & Gilbert (2014):
valence sum ``s`` normalised as ``s / sqrt(s^2 + 15)``; positive / negative /
neutral shares with the +1 / -1 shift per sentiment-bearing token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riselens.functions.titles import WS_SPLIT
from riselens.operators.joins import attach_small

# ---------------------------------------------------------------------------
# Fixed values (published constants of the rule-based scheme; word lists are
# this engine's own short lists)
# ---------------------------------------------------------------------------
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
NORMALIZATION_ALPHA = 15.0
NEGATIONS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot",
             "can't", "don't", "doesn't", "isn't", "wasn't", "won't", "without"]
BOOSTERS = ["very", "really", "extremely", "so", "totally", "absolutely", "incredibly", "highly", "most", "more"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august",
          "september", "october", "november", "december"]
YEAR_PATTERN = r"^(?:19|20)[0-9]{2}$"
# ---------------------------------------------------------------------------

EDGE_PUNCT = r"^[^\p{L}\p{N}']+|[^\p{L}\p{N}']+$"


def sentiment_tokens(title: Column) -> Column:
    """Lower-cased whitespace tokens with edge punctuation stripped."""
    raw = F.split(F.lower(F.coalesce(title, F.lit(""))), WS_SPLIT)
    stripped = F.transform(raw, lambda w: F.regexp_replace(w, EDGE_PUNCT, ""))
    return F.filter(stripped, lambda w: w != F.lit(""))


def _shifted(arr: Column, k: int) -> Column:
    """arr shifted left by k (element i -> arr[i+k]); shorter by k."""
    return F.slice(arr, k + 1, F.greatest(F.size(arr) - k, F.lit(0)))


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, text: str = "title", key: str = "post_id") -> DataFrame:
    """Attach sentiment_compound / positive / negative / neutral.

    The token array is computed once per row; the previous token comes from a
    shifted copy zipped alongside (O(n) per title, no per-element re-split).
    """
    df = df.drop("sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_neutral")
    base = df.withColumn("_toks", sentiment_tokens(F.col(text)))
    base = base.withColumn("_prev", F.concat(F.array(F.lit("")), F.slice("_toks", 1, F.greatest(F.size("_toks") - 1, F.lit(0)))))
    neg = F.array(*[F.lit(w) for w in NEGATIONS])
    boost = F.array(*[F.lit(w) for w in BOOSTERS])
    per_tok = base.select(F.col(key), F.explode(F.arrays_zip("_toks", "_prev")).alias("it")).select(
        key, F.col("it._toks").alias("token"),
        F.array_contains(neg, F.col("it._prev")).alias("negated"),
        F.array_contains(boost, F.col("it._prev")).alias("boosted"))
    lex = lexicon.select(F.col("token"), F.col("valence").cast("double").alias("valence")).filter(F.col("valence") != 0)
    hits = attach_small(per_tok, lex, "token", "inner")
    v = F.col("valence")
    adj = v * F.when(F.col("negated"), F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0)) + \
        F.when(F.col("boosted"), F.signum(v) * F.lit(BOOSTER_INCREMENT)).otherwise(F.lit(0.0))
    scored = hits.select(key, adj.alias("a"))
    sums = scored.groupBy(key).agg(
        F.sum("a").alias("_s"),
        F.sum(F.when(F.col("a") > 0, F.col("a") + 1.0).otherwise(0.0)).alias("_pos"),
        F.sum(F.when(F.col("a") < 0, F.col("a") - 1.0).otherwise(0.0)).alias("_neg"),
        F.count_if(F.col("a") != 0).alias("_n_sent"),
    )
    out = base.withColumn("_n_tok", F.size("_toks")).drop("_toks", "_prev").join(sums, key, "left")
    s = F.coalesce(F.col("_s"), F.lit(0.0))
    pos = F.coalesce(F.col("_pos"), F.lit(0.0))
    negs = F.abs(F.coalesce(F.col("_neg"), F.lit(0.0)))
    neu = (F.col("_n_tok") - F.coalesce(F.col("_n_sent"), F.lit(0))).cast("double")
    total = pos + negs + neu
    share = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    return out.withColumns({
        "sentiment_compound": s / F.sqrt(s * s + F.lit(NORMALIZATION_ALPHA)),
        "sentiment_positive": share(pos),
        "sentiment_negative": share(negs),
        "sentiment_neutral": share(neu),
    }).drop("_s", "_pos", "_neg", "_n_sent", "_n_tok")


def entity_counts(df: DataFrame, gazetteer: DataFrame | None, text: str = "title", key: str = "post_id",
                  max_n: int = 3) -> DataFrame:
    """Person / org / date / total entity counts.

    Word n-grams (1..max_n) of the stripped lower-cased title joined to the
    gazetteer; dates are month names and years (fixed rule).  Without a
    gazetteer, person and org counts are zero.
    """
    df = df.drop("person_entities", "org_entities", "date_entities", "total_entities")
    base = df.withColumn("_toks", sentiment_tokens(F.col(text)))
    for k in range(1, max_n):
        base = base.withColumn(f"_next{k}", _shifted(F.col("_toks"), k))
    toks = F.col("_toks")

    def ngrams(n: int) -> Column:
        if n == 1:
            return toks
        zipped = F.arrays_zip("_toks", *[f"_next{k}" for k in range(1, n)])
        full = F.filter(zipped, lambda z: z[f"_next{n - 1}"].isNotNull())
        return F.transform(full, lambda z: F.concat_ws(" ", z["_toks"], *[z[f"_next{k}"] for k in range(1, n)]))

    grams = F.flatten(F.array(*[ngrams(n) for n in range(1, max_n + 1)]))
    months = F.array(*[F.lit(m) for m in MONTHS])
    dates = F.size(F.filter(toks, lambda w: F.array_contains(months, w) | w.rlike(YEAR_PATTERN)))
    base = base.withColumn("date_entities", dates)
    helpers = ["_toks"] + [f"_next{k}" for k in range(1, max_n)]
    if gazetteer is None:
        base = base.drop(*helpers)
        return base.withColumns({"person_entities": F.lit(0), "org_entities": F.lit(0)}).withColumn(
            "total_entities", F.col("date_entities"))
    exploded = base.select(F.col(key), F.explode(grams).alias("phrase"))
    base = base.drop(*helpers)
    gz = gazetteer.select(F.lower("phrase").alias("phrase"), "entity_type").dropDuplicates(["phrase"])
    hits = attach_small(exploded, gz, "phrase", "inner")
    counts = hits.groupBy(key).agg(
        F.count_if(F.col("entity_type") == "PERSON").alias("person_entities"),
        F.count_if(F.col("entity_type") == "ORG").alias("org_entities"),
    )
    out = base.join(counts, key, "left").withColumns({
        "person_entities": F.coalesce(F.col("person_entities"), F.lit(0)).cast("int"),
        "org_entities": F.coalesce(F.col("org_entities"), F.lit(0)).cast("int"),
    })
    return out.withColumn("total_entities", F.col("person_entities") + F.col("org_entities") + F.col("date_entities"))
