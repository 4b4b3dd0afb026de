"""Context (time / URL / author) column helpers, C1–C8, C11, C12, NM3, NM4.

Pure Column expressions; the per-group counts (C9, C10) are aggregations and
live in ``operators.features``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied pipeline for identical results)
# ---------------------------------------------------------------------------
IMAGE_DOMAINS = [
    "i.redd.it", "imgur.com", "i.imgur.com", "gfycat.com",
    "v.redd.it", "giphy.com", "flickr.com", "instagram.com",
]
NEWS_DOMAINS = [
    "bbc.com", "cnn.com", "nytimes.com", "washingtonpost.com",
    "reuters.com", "apnews.com", "theguardian.com", "npr.org",
]
MEDIA_EXTENSION_PATTERN = r"(?i)\.(?:jpg|jpeg|png|gif|webp|mp4|webm)(?:\?|$)"
URL_DOMAIN_PATTERN = r"https?://(?:www\.)?([^/]+)"
ANONYMOUS_AUTHORS = ["[deleted]", ""]
# Notebook form of the self/image flags (C11).
SELF_DOMAIN_PREFIX = "self."
NOTEBOOK_IMAGE_DOMAINS = ["i.redd.it", "imgur.com", "i.imgur.com"]
# ---------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def epoch_to_ts(epoch_seconds: Column | str) -> Column:
    """Epoch seconds (double, possibly a string) -> TIMESTAMP (UTC session)."""
    secs = _c(epoch_seconds).cast("string").try_cast("double")
    return F.timestamp_micros(F.round(secs * F.lit(1_000_000)).cast("long"))


def author_hash(author: Column | str) -> Column:
    """NM3: first 8 hex chars of SHA-256; null/''/'[deleted]' -> 'anonymous'."""
    a = _c(author).cast("string")
    return F.when(a.isNull() | a.isin(*ANONYMOUS_AUTHORS), F.lit("anonymous")).otherwise(
        F.substring(F.sha2(a, 256), 1, 8)
    )


def url_domain(url: Column | str) -> Column:
    """NM4: host of an http(s) URL without 'www.'; '' when none."""
    return F.coalesce(F.regexp_extract(_c(url), URL_DOMAIN_PATTERN, 1), F.lit(""))


def _domain_or_null(url: Column) -> Column:
    d = F.regexp_extract(url, URL_DOMAIN_PATTERN, 1)
    return F.when(d == F.lit(""), F.lit(None)).otherwise(d)


def hour_flags(ts: Column | str) -> dict[str, Column]:
    """C2 + C5."""
    h = F.hour(_c(ts))
    angle = F.lit(2 * math.pi) * h / F.lit(24.0)
    return {
        "hour_of_day": h,
        "is_morning": h.between(6, 11).cast("int"),
        "is_afternoon": h.between(12, 17).cast("int"),
        "is_evening": h.between(18, 23).cast("int"),
        "is_night": F.coalesce(~h.between(6, 23), F.lit(True)).cast("int"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    }


def weekday_flags(ts: Column | str) -> dict[str, Column]:
    """Monday = 0."""
    d = F.weekday(_c(ts))
    return {
        "day_of_week": d,
        "is_weekend": F.coalesce(d.isin(5, 6), F.lit(False)).cast("int"),
        "is_monday": F.coalesce(d == 0, F.lit(False)).cast("int"),
        "is_friday": F.coalesce(d == 4, F.lit(False)).cast("int"),
    }


def age_features(epoch_seconds: Column | str, as_of_epoch: float) -> dict[str, Column]:
    """C4 with an explicit ``as_of`` (epoch seconds) instead of the wall clock."""
    secs = _c(epoch_seconds).cast("string").try_cast("double")
    age = (F.lit(float(as_of_epoch)) - secs) / F.lit(3600.0)
    return {
        "age_hours": age,
        "is_very_new": F.coalesce(age <= 1, F.lit(False)).cast("int"),
        "is_recent": F.coalesce(age <= 6, F.lit(False)).cast("int"),
        "is_old": F.coalesce(age >= 24, F.lit(False)).cast("int"),
        "log_age_hours": F.log1p(F.greatest(age, F.lit(0.0))),
    }


def is_image_url(url: Column | str) -> Column:
    """Known image domain or media file extension."""
    u = _c(url)
    by_domain = F.coalesce(_domain_or_null(u).isin(*IMAGE_DOMAINS), F.lit(False))
    by_ext = F.coalesce(u.rlike(MEDIA_EXTENSION_PATTERN), F.lit(False))
    return by_domain | by_ext


def is_news_url(url: Column | str) -> Column:
    """Known news domain."""
    return F.coalesce(_domain_or_null(_c(url)).isin(*NEWS_DOMAINS), F.lit(False))


def url_flags(url: Column | str, is_self: Column | str | None) -> dict[str, Column]:
    """C6–C8.  With a self-post column (Reddit form) or without (HN form)."""
    u = _c(url)
    out = {
        "is_image_post": is_image_url(u).cast("int"),
        "is_news_post": is_news_url(u).cast("int"),
    }
    if is_self is not None:
        s = F.coalesce(_c(is_self).cast("boolean"), F.lit(False))
        out["is_text_post"] = s.cast("int")
        out["is_external_link"] = (~s).cast("int")
    else:
        out["has_url"] = u.isNotNull().cast("int")
        out["is_text_post"] = u.isNull().cast("int")
    return out


def notebook_content_flags(domain: Column | str) -> dict[str, Column]:
    """C11: notebook form keyed on the lower-cased domain."""
    d = F.lower(F.coalesce(_c(domain), F.lit("")))
    return {
        "is_self": d.startswith(SELF_DOMAIN_PREFIX).cast("int"),
        "is_image": d.isin(*NOTEBOOK_IMAGE_DOMAINS).cast("int"),
    }


def interaction_features(hour: Column | str, dow: Column | str, feats: dict[str, Column] | None = None) -> dict[str, Column]:
    """Off-peak (22–5) / weekend flags and the seven title × context terms."""
    h, d = _c(hour), _c(dow)
    off = F.coalesce(h.isin(0, 1, 2, 3, 4, 5, 22, 23), F.lit(False)).cast("double")
    wk = F.coalesce(d >= 5, F.lit(False)).cast("double")
    f = feats or {}

    def g(name: str) -> Column:
        return F.coalesce(f.get(name, F.col(name)).cast("double"), F.lit(0.0))

    return {
        "is_off_peak": off,
        "is_weekend_flag": wk,
        "sentiment_compound_offpeak": g("sentiment_compound") * off,
        "sentiment_negative_offpeak": g("sentiment_negative") * off,
        "sentiment_positive_offpeak": g("sentiment_positive") * off,
        "has_numbers_offpeak": g("has_numbers") * off,
        "clickbait_patterns_offpeak": g("clickbait_patterns") * off,
        "sentiment_compound_weekend": g("sentiment_compound") * wk,
        "has_question_weekend": g("has_question") * wk,
    }
