"""SQL text of the feature rules for the independent check engine.

These strings restate the Column expressions of ``functions.titles`` and
``functions.context`` in plain SQL (list lambdas, RE2 regexes) so that every
registered query can be recomputed from the raw test tables.  They are built
from the same fixed-value lists, never copied by hand.
"""

from __future__ import annotations

from riselens.functions.titles import WS_SPLIT as WS_SQL

from riselens.functions.context import IMAGE_DOMAINS, MEDIA_EXTENSION_PATTERN, NEWS_DOMAINS
from riselens.functions.titles import CLICKBAIT_KEYWORDS, CLICKBAIT_PATTERNS, PUNCTUATION_CLASS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def title_sql(t: str = "coalesce(title, '')") -> dict[str, str]:
    toks = f"list_filter(regexp_split_to_array({t}, '{WS_SQL}'), lambda w: w <> '')"
    ltoks = f"list_filter(regexp_split_to_array(lower({t}), '{WS_SQL}'), lambda w: w <> '')"
    n = f"len({toks})"
    letters = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    uppers = f"length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g'))"
    numbers = f"len(regexp_extract_all({t}, '[0-9]+'))"
    kw = " + ".join(f"CAST(contains(lower({t}), {q(k)}) AS INTEGER)" for k in CLICKBAIT_KEYWORDS)
    pats = " + ".join(f"CAST(regexp_matches(lower({t}), {q(p)}) AS INTEGER)" for p in CLICKBAIT_PATTERNS)
    w2 = "lower(regexp_replace(w, '[^\\p{L}]', '', 'g'))"
    groups = f"len(regexp_extract_all({w2}, '[aeiouy]+'))"
    silent = (f"CAST(regexp_matches({w2}, '[^aeiouy]e$') AND NOT regexp_matches({w2}, '[^aeiouy]le$') "
              f"AND {groups} > 1 AS INTEGER)")
    syl = f"coalesce(list_sum(list_transform({toks}, lambda w: greatest(1, {groups} - {silent}))), 0)"
    sentences = f"greatest(1, len(regexp_extract_all({t}, '[.!?]+')))"
    fk = (f"CASE WHEN {n} > 0 THEN 0.39 * ({n} / {sentences}) + 11.8 * ({syl} / {n}) - 15.59 ELSE 0.0 END")
    toklen = f"coalesce(list_sum(list_transform({toks}, lambda w: length(w))), 0)"
    return {
        "title_length": f"length({t})",
        "title_words": n,
        "title_chars_per_word": f"length({t}) / NULLIF({n}, 0)",
        "has_question": f"CAST(contains({t}, '?') AS INTEGER)",
        "has_exclamation": f"CAST(contains({t}, '!') AS INTEGER)",
        "punctuation_count": f"length({t}) - length(regexp_replace({t}, {q(PUNCTUATION_CLASS)}, '', 'g'))",
        "all_caps_words": f"len(list_filter({toks}, lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1))",
        "capitalization_ratio": f"coalesce({uppers} / NULLIF({letters}, 0), 0.0)",
        "number_count": numbers,
        "has_numbers": f"CAST({numbers} > 0 AS INTEGER)",
        "flesch_kincaid_grade": fk,
        "avg_word_length": f"coalesce({toklen} / NULLIF({n}, 0), 0.0)",
        "type_token_ratio": f"coalesce(len(list_distinct({ltoks})) / NULLIF({n}, 0), 0.0)",
        "clickbait_keywords": f"({kw})",
        "clickbait_patterns": f"({pats})",
        "has_clickbait": f"CAST(({kw}) > 0 OR ({pats}) > 0 AS INTEGER)",
    }


def domain_sql(url: str = "url") -> str:
    return f"NULLIF(regexp_extract({url}, 'https?://(?:www\\.)?([^/]+)', 1), '')"


def context_sql(ts: str = "ts", url: str = "url", is_self: str = "is_self_post", as_of: float = 0.0,
                epoch: str = "created_timestamp") -> dict[str, str]:
    h = f"hour({ts})"
    d = f"(isodow({ts}) - 1)"
    age = f"(({as_of!r} - {epoch}) / 3600.0)"
    dom = domain_sql(url)
    img = ", ".join(q(x) for x in IMAGE_DOMAINS)
    news = ", ".join(q(x) for x in NEWS_DOMAINS)
    ext = MEDIA_EXTENSION_PATTERN.replace("(?i)", "")
    return {
        "hour_of_day": h,
        "is_morning": f"CAST({h} BETWEEN 6 AND 11 AS INTEGER)",
        "is_afternoon": f"CAST({h} BETWEEN 12 AND 17 AS INTEGER)",
        "is_evening": f"CAST({h} BETWEEN 18 AND 23 AS INTEGER)",
        "is_night": f"CAST(NOT ({h} BETWEEN 6 AND 23) AS INTEGER)",
        "hour_sin": f"sin(2 * pi() * {h} / 24.0)",
        "hour_cos": f"cos(2 * pi() * {h} / 24.0)",
        "day_of_week": d,
        "is_weekend": f"CAST({d} IN (5, 6) AS INTEGER)",
        "is_monday": f"CAST({d} = 0 AS INTEGER)",
        "is_friday": f"CAST({d} = 4 AS INTEGER)",
        "age_hours": age,
        "is_very_new": f"CAST({age} <= 1 AS INTEGER)",
        "is_recent": f"CAST({age} <= 6 AS INTEGER)",
        "is_old": f"CAST({age} >= 24 AS INTEGER)",
        "log_age_hours": f"ln(1 + greatest({age}, 0.0))",
        "is_image_post": f"CAST(coalesce({dom} IN ({img}), false) OR coalesce(regexp_matches({url}, {q(ext)}, 'i'), false) AS INTEGER)",
        "is_news_post": f"CAST(coalesce({dom} IN ({news}), false) AS INTEGER)",
        "is_text_post": f"CAST(coalesce({is_self}, false) AS INTEGER)",
        "is_external_link": f"CAST(NOT coalesce({is_self}, false) AS INTEGER)",
    }


def ts_from_epoch(epoch: str = "created_timestamp") -> str:
    return f"make_timestamp(CAST(round({epoch} * 1000000) AS BIGINT))"


def ladder_sql(targets=(5, 15, 30, 60), tie: str = "event_id") -> str:
    aggs = ",\n       ".join(
        f"first(CAST(score AS DOUBLE) ORDER BY abs(post_age_minutes - {m}.0), {tie}) AS score_at_{m}min" for m in targets)
    return f"SELECT post_id, {aggs},\n       count(*) AS n_snapshots FROM snapshots GROUP BY post_id"
