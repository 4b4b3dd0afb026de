"""Edge rows for the title / context / normalisation expressions (FIXTURES §4),
checked against plain-Python definitions of the same rules."""

import hashlib
import string

import pytest
from pyspark.sql import functions as F

from riselens.functions import context as ctx
from riselens.functions.titles import CLICKBAIT_KEYWORDS, title_features

TITLES = [None, "", "   ", "a", "ALL CAPS TITLE HERE", "12345 678", "emoji 😀 test 𝔘nicode",
          "Why you won't believe this?! 10 ways", "Mixed Case, punctuation: (yes) - no...",
          "nbsp\u00a0split\u2003em\u3000ideographic"]


def py_features(t):
    t = "" if t is None else t
    words = t.split()
    letters = [c for c in t if c.isalpha()]
    import re
    return {
        "title_length": len(t),
        "title_words": len(words),
        "has_question": int("?" in t),
        "has_exclamation": int("!" in t),
        "punctuation_count": sum(1 for c in t if c in string.punctuation),
        "all_caps_words": sum(1 for w in words if w.isupper() and len(w) > 1),
        "capitalization_ratio": (sum(1 for c in letters if c.isupper()) / len(letters)) if letters else 0.0,
        "number_count": len(re.findall(r"[0-9]+", t)),
        "avg_word_length": (sum(len(w) for w in words) / len(words)) if words else 0.0,
        "type_token_ratio": (len(set(t.lower().split())) / len(words)) if words else 0.0,
        "clickbait_keywords": sum(1 for k in CLICKBAIT_KEYWORDS if k in t.lower()),
    }


def test_title_features_match_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "id int, title string")
    feats = title_features("title")
    rows = df.select("id", *[c.alias(k) for k, c in feats.items()]).orderBy("id").collect()
    for r, t in zip(rows, TITLES):
        exp = py_features(t)
        for k, v in exp.items():
            assert r[k] == pytest.approx(v), (t, k, r[k], v)
    # chars per word is null (not inf) without words
    assert rows[0]["title_chars_per_word"] is None and rows[2]["title_chars_per_word"] is None


def test_url_domain_and_flags(spark):
    urls = ["https://www.example.com:8080/x", "http://i.imgur.com/a.png", "example.com/no/scheme",
            None, "https://bbc.com/news", "https://cdn.site.org/v.MP4?x=1"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = df.select(ctx.url_domain("url").alias("d"), ctx.is_image_url("url").alias("img"),
                     ctx.is_news_url("url").alias("news")).collect()
    assert [r["d"] for r in rows] == ["example.com:8080", "i.imgur.com", "", "", "bbc.com", "cdn.site.org"]
    assert [r["img"] for r in rows] == [False, True, False, False, False, True]
    assert [r["news"] for r in rows] == [False, False, False, False, True, False]


def test_author_hash(spark):
    authors = [None, "", "[deleted]", "someone"]
    df = spark.createDataFrame([(a,) for a in authors], "a string")
    got = [r[0] for r in df.select(ctx.author_hash("a")).collect()]
    assert got[:3] == ["anonymous"] * 3
    assert got[3] == hashlib.sha256(b"someone").hexdigest()[:8]


def test_hour_weekday_flags(spark):
    # 2024-01-01 is a Monday; 23:30 UTC is evening
    df = spark.createDataFrame([(1704151800.0,)], "t double")
    ts = ctx.epoch_to_ts("t")
    r = df.select(*[c.alias(k) for k, c in {**ctx.hour_flags(ts), **ctx.weekday_flags(ts)}.items()]).collect()[0]
    assert r["hour_of_day"] == 23 and r["is_evening"] == 1 and r["is_night"] == 0
    assert r["day_of_week"] == 0 and r["is_monday"] == 1 and r["is_weekend"] == 0
