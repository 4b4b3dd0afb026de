"""The feature build (make_features) as one lazy plan.

posts -> dedup (NM6) -> collection flag (NM7) -> community and author
statistics (A1, A2) -> title block (T1–T20) -> lexicon sentiment (T11–T14)
-> gazetteer entities (T21–T24) -> context block (C1–C10) -> snapshot
ladder (J2, D1–D5).  Shuffles: the dedup aggregate and the ladder aggregate
are both on post_id; group statistics are partial aggregates attached by a
checked broadcast; title / context expressions are one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riselens.functions.titles import SENTIMENT_COLUMNS
from riselens.operators import features as feat
from riselens.operators.lexicon import entity_counts, lexicon_sentiment
from riselens.operators.snapshots import early_score_features
from riselens.session import checkpoint


def build_features(posts: DataFrame, snapshots: DataFrame | None, as_of_epoch: float,
                   lexicon: DataFrame | None = None, gazetteer: DataFrame | None = None,
                   exact_median: bool = True, tie_key: str = "event_id", materialize: bool = True,
                   unique: bool = False) -> DataFrame:
    """``unique`` says that ``posts`` were deduplicated before."""
    p = feat.flag_collection(posts if unique else feat.dedup_posts(posts))
    if materialize:
        # The deduplicated posts feed several aggregates and the final plan:
        # write them once to the shared checkpoint folder (lineage cut, and a
        # lost executor does not trigger a recompute of the ingest joins).
        p = checkpoint(p)
    p = feat.with_group_stats(p, exact_median=exact_median)
    p = feat.with_title_features(p)
    if lexicon is not None:
        p = lexicon_sentiment(p, lexicon)
    else:
        p = p.withColumns({c: F.lit(0.0) for c in SENTIMENT_COLUMNS})
    p = entity_counts(p, gazetteer)
    p = feat.context_features(p, as_of_epoch)
    if snapshots is not None:
        p = early_score_features(p, snapshots, tie_key=tie_key)
    return p
