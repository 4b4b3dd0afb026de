"""Title (string) features as pure Column expressions.

Every feature is a built-in Spark expression (regex, higher-order array
functions, string functions) so that the whole feature block compiles into one
whole-stage-codegen projection; no Python runs per row.  ``title_features``
returns ``{name: Column}`` to be added with a single ``withColumns``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied pipeline for identical results)
# ---------------------------------------------------------------------------
# Clickbait phrases, matched as substrings of the lower-cased title; each
# phrase counts at most once.
CLICKBAIT_KEYWORDS = [
    "you won't believe", "what happens next", "shocking", "amazing",
    "unbelievable", "incredible", "mind-blowing", "jaw-dropping",
    "this will", "you need to", "everyone should", "nobody talks about",
    "the truth about", "what nobody tells you", "secret", "revealed",
    "exposed", "conspiracy", "hidden", "leaked",
]
# Clickbait patterns, searched in the lower-cased title; each counts once.
# Written with [0-9] instead of \d so Java and RE2 agree.
CLICKBAIT_PATTERNS = [
    r"[0-9]+\s+(?:reasons|ways|things|facts|tips|tricks|secrets)",
    r"(?:how|why|what|when|where)\s+(?:to|you|we|they)",
    r"this\s+(?:is|will|might|could)",
    r"you\s+(?:won't|can't|shouldn't|must|should|need)",
]
# Question words that open a title (handcrafted flag feat_wh_start).
WH_WORDS = ["who", "what", "when", "where", "why", "how", "is", "are", "can", "should"]
# The 32 ASCII punctuation marks as one character class.
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
# ---------------------------------------------------------------------------

# Python's str.split() separators: ASCII whitespace, the information
# separators 0x1c-0x1f, NEL and every Unicode space / line / paragraph separator.
WS_SPLIT = r"[\s\x1c-\x1f\x85\p{Z}]+"
# A Unicode word boundary written out (Java's and RE2's \b disagree on
# non-ASCII letters; Python's Unicode \b treats letters and digits as word).
NON_WORD = r"[^\p{L}\p{N}_]"


def clean_title(title: Column | str) -> Column:
    """Null title -> '' (the hygiene rule); features are defined on text."""
    col = F.col(title) if isinstance(title, str) else title
    return F.coalesce(col.cast("string"), F.lit(""))


def tokens(text: Column) -> Column:
    """Whitespace tokens, empty strings removed (Python ``str.split()``)."""
    return F.filter(F.split(text, WS_SPLIT), lambda w: w != F.lit(""))


def _count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _ratio_or(num: Column, den: Column, default: float | None) -> Column:
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def _syllables(word: Column) -> Column:
    """Vowel-group syllable count with the silent-e rule, at least 1."""
    w = F.lower(F.regexp_replace(word, r"[^\p{L}]", ""))
    groups = F.regexp_count(w, F.lit("[aeiouy]+"))
    silent_e = (w.rlike("[^aeiouy]e$") & ~w.rlike("[^aeiouy]le$") & (groups > 1)).cast("int")
    return F.greatest(F.lit(1), groups - silent_e)


def title_features(title: Column | str = "title", tok_col: str | None = None) -> dict[str, Column]:
    """T1–T20 (and T21–T24 placeholders) as Column expressions.

    Entities (T21–T24) are zero here, the same as the studied pipeline without
    its entity model; ``operators.lexicon.entity_counts`` fills them from a
    gazetteer table.  Sentiment T11–T14 comes from ``operators.lexicon``.
    """
    t = clean_title(title)
    toks = tokens(t) if tok_col is None else F.col(tok_col)
    n_tok = F.size(toks)
    lower_t = F.lower(t)

    length = F.length(t)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    uppers = F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
    caps_words = F.size(
        F.filter(toks, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))
    )
    numbers = _count_matches(t, "[0-9]+")
    kw = sum((F.instr(lower_t, k) > 0).cast("int") for k in CLICKBAIT_KEYWORDS)
    pats = sum(lower_t.rlike(p).cast("int") for p in CLICKBAIT_PATTERNS)
    sentences = F.greatest(F.lit(1), _count_matches(t, "[.!?]+"))
    syllables = F.aggregate(F.transform(toks, _syllables), F.lit(0), lambda acc, x: acc + x)
    fk = F.when(
        n_tok > 0,
        F.lit(0.39) * (n_tok / sentences) + F.lit(11.8) * (syllables / n_tok) - F.lit(15.59),
    ).otherwise(F.lit(0.0))
    tok_len_sum = F.aggregate(F.transform(toks, lambda w: F.length(w)), F.lit(0), lambda a, x: a + x)

    zero = F.lit(0)
    return {
        "title_length": length,
        "title_words": n_tok,
        "title_chars_per_word": _ratio_or(length, n_tok, None),
        "has_question": (F.instr(t, "?") > 0).cast("int"),
        "has_exclamation": (F.instr(t, "!") > 0).cast("int"),
        "punctuation_count": length - F.length(F.regexp_replace(t, PUNCTUATION_CLASS, "")),
        "all_caps_words": caps_words,
        "capitalization_ratio": _ratio_or(uppers, letters, 0.0),
        "number_count": numbers,
        "has_numbers": (numbers > 0).cast("int"),
        "flesch_kincaid_grade": fk,
        "avg_word_length": _ratio_or(tok_len_sum, n_tok, 0.0),
        "type_token_ratio": _ratio_or(F.size(F.array_distinct(tokens(lower_t))), n_tok, 0.0),
        "clickbait_keywords": kw,
        "clickbait_patterns": pats,
        "has_clickbait": ((kw > 0) | (pats > 0)).cast("int"),
        "person_entities": zero,
        "org_entities": zero,
        "date_entities": zero,
        "total_entities": zero,
    }


def handcrafted_features(title: Column | str = "title", all_caps_words: Column | None = None) -> dict[str, Column]:
    """The extended handcrafted block used by the text variants.

    The studied code wrote several regexes with doubled backslashes, so three
    flags practically never fired and the question flag always fired.  These
    are written with their evident intent (word boundary, digit, literal '?').
    """
    t = clean_title(title)
    lower_t = F.lower(t)
    n_tok = F.size(tokens(lower_t))
    char_len = F.length(lower_t)
    if all_caps_words is None:
        all_caps_words = title_features(t)["all_caps_words"]
    wh = "|".join(WH_WORDS)
    return {
        "title_lower": lower_t,
        "title_token_len": n_tok,
        "title_char_len": char_len,
        "title_avg_token_len": _ratio_or(char_len, n_tok, 0.0),
        "feat_wh_start": t.rlike(rf"(?i)^(?:{wh})(?:{NON_WORD}|$)").cast("double"),
        "feat_contains_colon": (F.instr(t, ":") > 0).cast("double"),
        "feat_contains_dash": (F.instr(t, "-") > 0).cast("double"),
        "feat_contains_digit": t.rlike("[0-9]").cast("double"),
        "feat_contains_year": t.rlike("20[0-9]{2}|19[0-9]{2}").cast("double"),
        "feat_all_caps_word": t.rlike(rf"(?:^|{NON_WORD})[A-Z]{{4,}}(?:{NON_WORD}|$)").cast("double"),
        "feat_title_exc": (F.instr(t, "!") > 0).cast("double"),
        "feat_title_question": (F.instr(t, "?") > 0).cast("double"),
        "feat_title_quote": (F.instr(t, '"') > 0).cast("double"),
        "feat_token_shout_ratio": _ratio_or(F.coalesce(all_caps_words.cast("double"), F.lit(0.0)), n_tok, 0.0),
    }


TITLE_FEATURE_COLUMNS = [
    "title_length", "title_words", "title_chars_per_word", "has_question", "has_exclamation",
    "punctuation_count", "all_caps_words", "capitalization_ratio", "number_count", "has_numbers",
    "flesch_kincaid_grade", "avg_word_length", "type_token_ratio", "clickbait_keywords",
    "clickbait_patterns", "has_clickbait", "person_entities", "org_entities", "date_entities",
    "total_entities",
]
SENTIMENT_COLUMNS = ["sentiment_compound", "sentiment_positive", "sentiment_negative", "sentiment_neutral"]
