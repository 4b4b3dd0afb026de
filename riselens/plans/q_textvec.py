"""Registered text-vector queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from riselens.operators import gram as G
from riselens.operators import textvec as TV
from riselens.operators.encoder import encode, fit_encoder
from riselens.operators.pairwise import pairwise_accuracy
from riselens.operators.stats import rank_results
from riselens.plans import stage as S
from riselens.plans.q_eval import _with, baseline_frame
from riselens.plans.q_models import fitted
from riselens.plans.registry import register, round_sql, rounded
from riselens.session import checkpoint, ensure_checkpoint_dir
from riselens.sources import fixtures as fx

MAX_FEATURES, MIN_DF = 500, 5

_TFIDF_SQL = fx.sql_with(f"""
SELECT post_id, term, {round_sql('w / sqrt(sum(w * w) OVER (PARTITION BY post_id))')} AS tfidf FROM (
  SELECT c.post_id, c.term, c.tf * (ln((1 + nd.n) / (1 + v.df)) + 1) AS w
  FROM cnt c JOIN voc v USING (term) CROSS JOIN (SELECT count(*) AS n FROM posts) nd)""", "posts", extra={
    "tk": "SELECT post_id, regexp_extract_all(lower(coalesce(title, '')), '[\\p{L}\\p{N}_]{2,}') AS t FROM posts",
    "ix": "SELECT post_id, t, generate_subscripts(t, 1) AS k FROM tk",
    "terms": "SELECT post_id, t[k] AS term FROM ix UNION ALL SELECT post_id, t[k] || ' ' || t[k + 1] FROM ix WHERE k < len(t)",
    "cnt": "SELECT post_id, term, count(*) AS tf FROM terms GROUP BY post_id, term",
    "voc": f"""SELECT term, df FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM cnt GROUP BY term)
               WHERE df >= {MIN_DF} ORDER BY cf DESC, term LIMIT {MAX_FEATURES}""",
})


def tfidf_long(spark, sf, posts=None):
    p = posts if posts is not None else fx.posts(spark, sf).select("post_id", "title")
    counts = TV.term_counts(p)
    vocab = TV.fit_tfidf(counts, p.count(), MAX_FEATURES, MIN_DF)
    return TV.transform_tfidf(counts, vocab), vocab


@register("tfidf_title_terms", _TFIDF_SQL)
def q_tfidf(spark, sf):
    long, _ = tfidf_long(spark, sf)
    return rounded(long.select("post_id", "term", "tfidf"))


def fold_key(info) -> "Column":
    """f0..f4 for contiguous time-ordered training folds, 'test' after."""
    n_train, n = info["train_count"], info["train_count"] + info["test_count"]
    fb = S.fold_bounds(n_train, S.CV_FOLDS)
    return S.interval_key(F.col("time_rank"), fb + [n], [f"f{i}" for i in range(S.CV_FOLDS)] + ["test"])


def _fold_grams(grams, names):
    folds = [grams.get(f"f{i}", G.AugGram.zeros(names)) for i in range(S.CV_FOLDS)]
    return folds, grams.get("test", G.AugGram.zeros(names))


def _stage_b_rows(name, tr, te, fit, y="stage_a_residual"):
    return [(name, "train", *G.metrics(tr, fit, y).values()), (name, "test", *G.metrics(te, fit, y).values())]


@register("tfidf_svd_stage_b")
def q_tfidf_svd(spark, sf, k: int = 20):
    """V1 + V2 + V3: Stage B residual model on handcrafted features plus TF-IDF
    (as SVD components), vocabulary / SVD / scaler fitted on train, elastic
    net with 5-fold CV over l1 × the default alpha path — all from ONE pass of
    fold Grams."""
    from riselens.functions.titles import handcrafted_features
    fit, scored, info = fitted(spark, sf)
    train_titles = scored.filter(F.col("split") == "train").select("post_id", "title")
    vocab = TV.fit_tfidf(TV.term_counts(train_titles), train_titles.count(), MAX_FEATURES, MIN_DF)
    dim = vocab.count()
    long = TV.transform_tfidf(TV.term_counts(scored.select("post_id", "title")), vocab)
    vec = TV.dense_vectors(long, dim)
    hand = {c: e for c, e in handcrafted_features("title", F.col("all_caps_words")).items() if c != "title_lower"}
    d = (scored.select("post_id", "time_rank", "title", "all_caps_words", "stage_a_residual").withColumns(hand)
         .join(vec, "post_id", "left")
         .withColumn("vector", F.coalesce(F.col("vector"), F.array_repeat(F.lit(0.0), dim))))
    names_extra = list(hand) + ["stage_a_residual"]
    grams = TV.vector_gram(d, dim, names_extra, fold_key(info))
    names = grams[next(iter(grams))].names
    folds, test = _fold_grams(grams, names)
    train = G.sum_grams(folds, names)
    comps = TV.svd_components(train, dim, min(k, dim))
    pf = [TV.project(f, dim, comps) for f in folds]
    pt = TV.project(test, dim, comps)
    x = [f"c{i}" for i in range(comps.shape[0])] + list(hand)
    ptrain = G.sum_grams(pf, pf[0].names)
    _, sd = G.scaler_from_gram(ptrain, x)                        # scaler without centering
    zero = np.zeros(len(x))
    sf_ = [G.standardize(f, x, zero, sd, center=False) for f in pf]
    st_ = G.standardize(pt, x, zero, sd, center=False)
    strain = G.sum_grams(sf_, sf_[0].names)
    enet, cv = G.fit_elastic_net_cv(sf_, x, "stage_a_residual", [0.1, 0.3, 0.5, 0.7, 0.9], None)
    ols = G.fit_ols(strain, x, "stage_a_residual")
    rows = _stage_b_rows("tfidf_svd_elasticnet", strain, st_, enet) + _stage_b_rows("tfidf_svd_ols", strain, st_, ols)
    out = spark.createDataFrame(rows, "model string, split string, rmse double, r2 double, n long")
    return rounded(out.withColumns({"nonzero_coefs": F.lit(int(np.sum(enet.coef != 0))),
                                    "cv_alpha": F.lit(float(cv["alpha"])), "cv_l1_ratio": F.lit(float(cv["l1_ratio"]))}))


EMB_DIM = 64


RIDGE_ALPHAS = (0.1, 1.0, 10.0)
ENET_L1, ENET_ALPHAS = (0.1, 0.5, 0.9), (0.01, 0.1, 1.0)
_FRAMES: dict = {}


def _emb_frame(spark, sf):
    """All posts with the vector of their title, from an encoder fitted on the training titles (written once per session)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FRAMES:
        fit, scored, info = fitted(spark, sf)
        d = scored.select("post_id", "split", "time_rank", "subreddit", "lang", "created_dt", "title", "stage_a_residual")
        encoder = fit_encoder(d.filter(F.col("split") == "train"), "title", EMB_DIM)
        _FRAMES[key] = checkpoint(encode(d, encoder).withColumn("fold", fold_key(info)))
    return _FRAMES[key]


def _emb_grams(d):
    g = TV.vector_gram(d, EMB_DIM, ["stage_a_residual"], "fold")
    names = g[next(iter(g))].names
    folds, test = _fold_grams(g, names)
    return {"folds": folds, "test": test, "train": G.sum_grams(folds, names)}


def _design(grams, pca_k):
    """V5 PCA (fit on train) and V6 scaler: the design's Grams, its columns, and its map from the vector."""
    tr, te, folds = grams["train"], grams["test"], grams["folds"]
    mean, comps, x = None, None, [f"v{i}" for i in range(EMB_DIM)]
    if pca_k:
        mean, comps = TV.pca_components(tr, EMB_DIM, pca_k)
        tr, te, folds = (TV.project(tr, EMB_DIM, comps, mean), TV.project(te, EMB_DIM, comps, mean), [TV.project(f, EMB_DIM, comps, mean) for f in folds])
        x = [f"c{i}" for i in range(pca_k)]
    smean, sstd = G.scaler_from_gram(tr, x)
    M = (comps if pca_k else np.eye(EMB_DIM)) / sstd[:, None]
    c = -(M @ mean if pca_k else np.zeros(len(x))) - smean / sstd
    scaled = [G.standardize(g, x, smean, sstd) for g in (tr, te, *folds)]
    return {"x": x, "train": scaled[0], "test": scaled[1], "folds": scaled[2:], "M": M, "c": c}


def _emb_fits(d, grams, configs):
    """Per (regressor, PCA): the fit, its design, and the weights on the vector.

    V7: ridge with the alpha of the least exact leave-one-out error on the
    standardised design, all ridge designs in one pass; V8: elastic net by
    5-fold CV on the time-ordered training folds.
    """
    designs = {k: _design(grams, k) for k in {k for _, k in configs}}
    ridge = [k for k in designs if ("ridge", k) in configs]
    train = d.filter(F.col("split") == "train")
    loo = dict(zip(ridge, TV.ridge_loo(train, [(designs[k]["train"], designs[k]["x"], designs[k]["M"], designs[k]["c"]) for k in ridge], "stage_a_residual", RIDGE_ALPHAS)))
    out = {}
    for reg, k in configs:
        own = designs[k]
        if reg == "ridge":
            fit = G.fit_ridge(own["train"], own["x"], "stage_a_residual", loo[k][0])
        else:
            fit, _ = G.fit_elastic_net_cv(own["folds"], own["x"], "stage_a_residual", ENET_L1, ENET_ALPHAS)
        w = own["M"].T @ fit.coef
        out[reg, k] = fit, own, w, float(fit.intercept + own["c"] @ fit.coef)
    return out


@register("embedding_stage_b")
def q_embedding(spark, sf):
    """V4–V8: Stage B on the vectors of all titles (PCA / scaler / ridge with
    exact leave-one-out alpha / elastic net), metrics and pairwise accuracy."""
    d = _emb_frame(spark, sf)
    names = {("ridge", None): "ridge_nopca", ("ridge", 16): "ridge_pca16", ("enet", None): "enet_nopca"}
    rows, preds, alphas = [], {}, []
    for key, (fit, own, w, b0) in _emb_fits(d, _emb_grams(d), list(names)).items():
        rows += _stage_b_rows(names[key], own["train"], own["test"], fit)
        preds[names[key]] = TV.vector_predict_expr(w, b0)
        alphas.append((names[key], float(fit.extra["alpha"])))
    out = spark.createDataFrame(rows, "model string, split string, rmse double, r2 double, n long")
    test = d.filter(F.col("split") == "test").withColumns({f"pred_{k}": v for k, v in preds.items()}).withColumn(
        "hour_bucket", F.date_trunc("hour", "created_dt"))
    pw = []
    for name in preds:
        r = pairwise_accuracy(test, ["lang", "hour_bucket"], "stage_a_residual", f"pred_{name}").collect()[0]
        pw.append((name, r["pairwise_accuracy"], int(r["pairs"])))
    pwdf = spark.createDataFrame(pw, "model string, pairwise_accuracy double, pairs long")
    chosen = spark.createDataFrame(alphas, "model string, alpha double")
    return rounded(out.join(pwdf, "model", "left").join(chosen, "model"))


@register("embedding_grid_ranked")
def q_embedding_grid(spark, sf):
    """A config grid (regressor × PCA) scored from ONE vector
    Gram; ranked by pairwise accuracy (null -> last), ties by index."""
    d = _emb_frame(spark, sf)
    configs = [(r, k) for r in ("ridge", "enet") for k in (None, 8, 16, 32)]
    fits = _emb_fits(d, _emb_grams(d), configs)
    exprs, rows = {}, []
    for i, (reg, k) in enumerate(configs):
        fit, own, w, b0 = fits[reg, k]
        m = G.metrics(own["test"], fit, "stage_a_residual")
        rows.append((i, reg, k or 0, m["rmse"], m["r2"]))
        exprs[i] = TV.vector_predict_expr(w, b0)
    test = d.filter(F.col("split") == "test").withColumn("hour_bucket", F.date_trunc("hour", "created_dt"))
    items = F.array(*[F.struct(F.lit(i).alias("cfg"), e.alias("pred")) for i, e in exprs.items()])
    ex = test.select("lang", "hour_bucket", "stage_a_residual", F.explode(items).alias("it")).select(
        "lang", "hour_bucket", "stage_a_residual", "it.cfg", "it.pred")
    pw = pairwise_accuracy(ex, ["cfg", "lang", "hour_bucket"], "stage_a_residual", "pred", by=["cfg"])
    res = spark.createDataFrame(rows, "index int, regressor string, pca int, test_rmse double, test_r2 double")
    res = res.join(pw.select(F.col("cfg").alias("index"), "pairwise_accuracy", "pairs"), "index", "left")
    return rounded(rank_results(res, "pairwise_accuracy", "index"))


@register("title_vectors_of_all_posts", fx.sql_with("SELECT count(*) AS posts, count(*) AS with_vector, CAST(64 AS INTEGER) AS dim FROM posts WHERE created_timestamp IS NOT NULL", "posts"))
def q_vectors(spark, sf):
    """V4: every post has a vector."""
    d = _emb_frame(spark, sf)
    return d.agg(F.count("*").alias("posts"), F.count("vector").alias("with_vector"), F.min(F.size("vector")).alias("dim"))


@register("prediction_table_metrics", _with(f"""
SELECT 'early' AS config, count(*) AS rows, count(DISTINCT subreddit) AS communities, {round_sql('sqrt(avg((y - early) * (y - early)))')} AS rmse FROM bf
UNION ALL SELECT 'mid', count(*), count(DISTINCT subreddit), {round_sql('sqrt(avg((y - mid) * (y - mid)))')} FROM bf"""))
def q_predictions(spark, sf):
    """Prediction tables of two configurations, written (one of them twice), read back, and measured."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/predictions/{uuid.uuid4().hex}"
    df = baseline_frame(spark, sf)
    for config in ("early", "mid", "early"):
        TV.write_predictions(df, root, config, "y", config, "hour_bucket")
    e = F.col("actual") - F.col("predicted")
    back = TV.read_predictions(spark, root).groupBy("config")
    return rounded(back.agg(F.count("*").alias("rows"), F.count_distinct("subreddit").alias("communities"), F.sqrt(F.avg(e * e)).alias("rmse")))
