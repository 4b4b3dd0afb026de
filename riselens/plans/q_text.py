"""Registered queries for lexicon sentiment, gazetteer entities and the
handcrafted title block (T11–T14, T21–T30)."""

from __future__ import annotations

from riselens.functions.titles import WS_SPLIT as WS_SQL

from pyspark.sql import functions as F

from riselens.functions.titles import NON_WORD, WH_WORDS, handcrafted_features
from riselens.operators.lexicon import (BOOSTERS, BOOSTER_INCREMENT, EDGE_PUNCT, MONTHS, NEGATION_SCALAR,
                                        NEGATIONS, NORMALIZATION_ALPHA, YEAR_PATTERN, entity_counts,
                                        lexicon_sentiment)
from riselens.plans.oracle_sql import q
from riselens.plans.registry import register, round_sql, rounded
from riselens.sources import fixtures as fx

_toks = (f"list_filter(list_transform(regexp_split_to_array(lower(coalesce(title, '')), '{WS_SQL}'), "
         f"lambda w: regexp_replace(w, {q(EDGE_PUNCT)}, '', 'g')), lambda w: w <> '')")
_negs = "[" + ", ".join(q(w) for w in NEGATIONS) + "]"
_boost = "[" + ", ".join(q(w) for w in BOOSTERS) + "]"

_sent_sql = fx.sql_with(f"""
SELECT p.post_id,
  {round_sql(f"coalesce(s, 0.0) / sqrt(coalesce(s, 0.0) * coalesce(s, 0.0) + {NORMALIZATION_ALPHA})")} AS sentiment_compound,
  {round_sql("coalesce(pos / NULLIF(pos + abs(neg) + neu, 0), 0.0)")} AS sentiment_positive,
  {round_sql("coalesce(abs(neg) / NULLIF(pos + abs(neg) + neu, 0), 0.0)")} AS sentiment_negative,
  {round_sql("coalesce(neu / NULLIF(pos + abs(neg) + neu, 0), 0.0)")} AS sentiment_neutral
FROM (SELECT t.post_id, a.s, coalesce(a.pos, 0.0) AS pos, coalesce(a.neg, 0.0) AS neg,
             CAST(len(t.t) - coalesce(a.n_sent, 0) AS DOUBLE) AS neu
      FROM tk t LEFT JOIN (
        SELECT post_id, sum(a) AS s, sum(CASE WHEN a > 0 THEN a + 1.0 ELSE 0.0 END) AS pos,
               sum(CASE WHEN a < 0 THEN a - 1.0 ELSE 0.0 END) AS neg, count(*) FILTER (WHERE a <> 0) AS n_sent
        FROM (SELECT i.post_id,
                     l.valence * (CASE WHEN i.negated THEN {NEGATION_SCALAR} ELSE 1.0 END)
                     + (CASE WHEN i.boosted THEN sign(l.valence) * {BOOSTER_INCREMENT} ELSE 0.0 END) AS a
              FROM (SELECT post_id, t[k] AS token,
                           k > 1 AND list_contains({_negs}, t[k - 1]) AS negated,
                           k > 1 AND list_contains({_boost}, t[k - 1]) AS boosted
                    FROM (SELECT post_id, t, generate_subscripts(t, 1) AS k FROM tk)) i
              JOIN lexicon l ON l.token = i.token)
        GROUP BY post_id) a ON a.post_id = t.post_id) p
""", "posts", "lexicon", extra={"tk": f"SELECT post_id, {_toks} AS t FROM posts"})


@register("title_sentiment_lexicon", _sent_sql)
def q_title_sentiment(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "title")
    out = lexicon_sentiment(p, fx.lexicon(spark, sf))
    return rounded(out.select("post_id", "sentiment_compound", "sentiment_positive", "sentiment_negative",
                              "sentiment_neutral"))


_months = "[" + ", ".join(q(m) for m in MONTHS) + "]"
_gaz = """SELECT lower(w) AS phrase,
  CASE WHEN ascii(substr(md5(lower(w)), 1, 1)) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_type
  FROM (SELECT unnest(regexp_extract_all(text, '(?m)^(\\p{Lu}\\p{Ll}+)', 1)) AS w FROM documents)
  GROUP BY lower(w) HAVING count(*) >= 20"""
_grams = " UNION ALL ".join(
    f"SELECT post_id, array_to_string(t[k:k + {n - 1}], ' ') AS phrase FROM "
    f"(SELECT post_id, t, generate_subscripts(t, 1) AS k FROM tk) WHERE k + {n - 1} <= len(t)"
    for n in (1, 2, 3))
_ent_sql = fx.sql_with(f"""
SELECT tk.post_id,
  coalesce(e.person, 0) AS person_entities, coalesce(e.org, 0) AS org_entities,
  len(list_filter(t, lambda w: list_contains({_months}, w) OR regexp_matches(w, {q(YEAR_PATTERN)}))) AS date_entities,
  coalesce(e.person, 0) + coalesce(e.org, 0)
    + len(list_filter(t, lambda w: list_contains({_months}, w) OR regexp_matches(w, {q(YEAR_PATTERN)}))) AS total_entities
FROM tk LEFT JOIN (
  SELECT g.post_id, CAST(count(*) FILTER (WHERE z.entity_type = 'PERSON') AS INTEGER) AS person,
         CAST(count(*) FILTER (WHERE z.entity_type = 'ORG') AS INTEGER) AS org
  FROM ({_grams}) g JOIN gaz z ON z.phrase = g.phrase GROUP BY g.post_id) e ON e.post_id = tk.post_id
""", "posts", extra={"tk": f"SELECT post_id, {_toks} AS t FROM posts", "gaz": _gaz})


@register("title_entities_gazetteer", _ent_sql)
def q_title_entities(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "title")
    out = entity_counts(p, fx.gazetteer(spark, sf))
    return out.select("post_id", F.col("person_entities").cast("int"), F.col("org_entities").cast("int"),
                      F.col("date_entities").cast("int"), F.col("total_entities").cast("int"))


_t = "coalesce(title, '')"
_ltoks = f"list_filter(regexp_split_to_array(lower({_t}), '{WS_SQL}'), lambda w: w <> '')"
_caps = f"len(list_filter(list_filter(regexp_split_to_array({_t}, '{WS_SQL}'), lambda w: w <> ''), lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1))"
_wh = "|".join(WH_WORDS)
_hand_sql = fx.sql_with(f"""
SELECT post_id, lower({_t}) AS title_lower, len({_ltoks}) AS title_token_len, length(lower({_t})) AS title_char_len,
  {round_sql(f"coalesce(length(lower({_t})) / NULLIF(len({_ltoks}), 0), 0.0)")} AS title_avg_token_len,
  CAST(regexp_matches({_t}, '^(?:{_wh})(?:{NON_WORD}|$)', 'i') AS DOUBLE) AS feat_wh_start,
  CAST(contains({_t}, ':') AS DOUBLE) AS feat_contains_colon,
  CAST(contains({_t}, '-') AS DOUBLE) AS feat_contains_dash,
  CAST(regexp_matches({_t}, '[0-9]') AS DOUBLE) AS feat_contains_digit,
  CAST(regexp_matches({_t}, '20[0-9]{{2}}|19[0-9]{{2}}') AS DOUBLE) AS feat_contains_year,
  CAST(regexp_matches({_t}, '(?:^|{NON_WORD})[A-Z]{{4,}}(?:{NON_WORD}|$)') AS DOUBLE) AS feat_all_caps_word,
  CAST(contains({_t}, '!') AS DOUBLE) AS feat_title_exc,
  CAST(contains({_t}, '?') AS DOUBLE) AS feat_title_question,
  CAST(contains({_t}, '"') AS DOUBLE) AS feat_title_quote,
  {round_sql(f"coalesce({_caps} / NULLIF(len({_ltoks}), 0), 0.0)")} AS feat_token_shout_ratio
FROM posts
""", "posts")


@register("title_handcrafted_features", _hand_sql)
def q_handcrafted(spark, sf):
    p = fx.posts(spark, sf).select("post_id", "title")
    return rounded(p.select("post_id", *[c.alias(k) for k, c in handcrafted_features("title").items()]))
