"""Splits, training, evaluation, scoring, monitoring, fairness."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.functions.names import unused
from quayside.functions.scratch import materialize
from quayside.operators.enrichment import number_rows, number_within
from quayside.operators.features import assemble
from quayside.operators.neighbours import self_neighbours
from quayside.operators.quantiles import long_values, quantiles
from quayside.operators.running import running_sums


def _place(key: str) -> Column:
    """A hash order of rows that any engine can repeat: md5 of the key as text (null: of an empty one)."""
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))


def stratified_split(df: DataFrame, label: str, key: str, ratio: float = 0.8) -> DataFrame:
    """``split``: train for the first share of each class in hash order, test for the rest."""
    place, n, every = (unused(x, df.columns) for x in ("place", "n", "every"))
    placed = number_within(df.withColumn(place, _place(key)), label, [place, key], n, every)
    return placed.withColumn("split", F.when(F.col(n) < F.floor(F.col(every) * ratio), "train").otherwise("test")).drop(place, n, every)


def assign_folds(df: DataFrame, key: str, k: int, label: str | None = None) -> DataFrame:
    """``fold`` 0 to k - 1: in turn within each class, or by the hash itself without one (no window over all rows)."""
    if label:
        place, n = (unused(x, df.columns) for x in ("place", "n"))
        placed = number_within(df.withColumn(place, _place(key)), label, [place, key], n)
        return placed.withColumn("fold", (F.col(n) % k).cast("int")).drop(place, n)
    return df.withColumn("fold", (F.conv(F.substr(_place(key), F.lit(1), F.lit(8)), 16, 10).cast("long") % k).cast("int"))


def time_series_split(df: DataFrame, ts: str, splits: int, gap: int = 0) -> DataFrame:
    """``(split, role, columns)``: in split i the first i blocks train, ``gap`` rows are left out, the next block tests."""
    n = materialize(number_rows(df, [ts, *[c for c in df.columns if c != ts]], "_n"), "ordered")
    size = n.count() // (splits + 1)
    pairs = n.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(splits))))
    role = F.when(F.col("_n") < F.col("split") * size, "train").when((F.col("_n") >= F.col("split") * size + gap) & (F.col("_n") < (F.col("split") + 1) * size), "test")
    return pairs.withColumn("role", role).where("role is not null").select("split", "role", *df.columns)


def oversample(df: DataFrame, label: str, ratio: float = 1.0, seed: int = 1) -> DataFrame:
    """The rare class (0/1) repeated until it has ``ratio`` times the rows of the other: each of its rows equally often, but
    for the remainder, which goes to rows in a hash order of all columns."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not n:
        return df
    rare = min(n, key=n.get)
    want = round(ratio * max(n.values())) - n[rare]
    if want <= 0:
        return df
    more = _times(df.where(F.col(label) == rare).withColumn("_h", F.xxhash64(*df.columns, F.lit(seed))), ["_h"], want, n[rare])
    return df.unionByName(more.select(*df.columns))


def _times(df: DataFrame, order_by: list[str], want: int, n: int) -> DataFrame:
    """``want`` rows made of the ``n`` of ``df``, which differ by at most one in how often they come; ``_copy`` counts from 1."""
    numbered = number_rows(df, order_by, "_n")
    often = F.lit(want // n) + F.when(F.col("_n") < want % n, 1).otherwise(0)
    return numbered.withColumn("_copy", F.explode(F.when(often > 0, F.sequence(F.lit(1), often.cast("int"))))).drop("_n")


def smote(df: DataFrame, key: str, label: str, columns: list[str], rare, k: int = 3, seed: int = 1, ratio: float | None = None) -> DataFrame:
    """New rows of the rare class, each between a row of it and one of that row's k nearest of the same class by distance: one
    for each row, or so many that the class then has ``ratio`` times the rows of all other classes. A class without rows, or
    with a single one, gives none; rows with a null among the columns have no neighbours and make none."""
    v = df.where(F.col(label) == rare).select(F.col(key).cast("long").alias(key), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    base = v.withColumn("_copy", F.lit(1))
    if ratio is not None:
        n = df.agg(F.count(F.when(F.col(label) == rare, 1)).alias("r"), F.count(F.when(F.col(label) != rare, 1)).alias("o")).first()
        want = round(ratio * n["o"]) - n["r"]
        base = _times(v, [key], want, n["r"]) if n["r"] and want > 0 else base.limit(0)
    flat = v.select(key, *[F.col("v")[i].alias(f"v{i}") for i in range(len(columns))])
    near = materialize(self_neighbours(flat, key, [f"v{i}" for i in range(len(columns))], k), "near")
    most = near.groupBy("query").agg(F.max("rank").alias("_most"))
    turn = F.pmod(F.xxhash64("query", "_copy", F.lit(seed)), F.col("_most")) + 1
    picked = base.select(F.col(key).alias("query"), "_copy").join(most, "query").withColumn("rank", turn.cast("int"))
    near = picked.join(near, ["query", "rank"])
    u = F.pmod(F.xxhash64("query", "neighbour", "_copy", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    a, b = v.select(F.col(key).alias("query"), F.col("v").alias("a")), v.select(F.col(key).alias("neighbour"), F.col("v").alias("b"))
    made = near.join(a, "query").join(b, "neighbour").withColumn("u", u)
    return made.select(*[(F.col("a")[i] + F.col("u") * (F.col("b")[i] - F.col("a")[i])).alias(c) for i, c in enumerate(columns)], F.lit(rare).alias(label))


MODELS = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier, "linear": LinearRegression, "forest_regression": RandomForestRegressor, "boosted_regression": GBTRegressor}


def without_summary(model):
    """The model without what it knows of its training data: that holds the session, which would go into every task, and
    can't once the session has observed a query."""
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def train(df: DataFrame, label: str, columns: list[str], kind: str, **params):
    """A fitted model over ``columns`` (assembled into ``features``)."""
    if "seed" not in params and kind in ("forest", "boosted", "forest_regression", "boosted_regression"):
        params["seed"] = 1
    return without_summary(MODELS[kind](featuresCol="features", labelCol=label, **params).fit(assemble(df, columns)))


def batch_score(df: DataFrame, model, columns: list[str], version: str = "1") -> DataFrame:
    out = model.transform(assemble(df, columns, invalid="keep"))
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1]).drop("probability", "rawPrediction")
    return out.drop("features").withColumns({"model_version": F.lit(version), "scored_at": F.current_timestamp()})


def score_udf(fn: Callable[..., pd.Series], return_type: str):
    """A vectorized Python function as a column function."""
    return F.pandas_udf(fn, return_type)


def group_apply(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return df.groupBy(*keys).applyInPandas(fn, schema)


def classification_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and area under the curve, in all or per group.

    Rows shrink to distinct scores first; the area is a sum of trapezoids over them, so ties count half. The negatives below
    a score are a running sum over all tasks, so scores of one group need not fit into one.
    """
    by = by or []
    per = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    ranked = running_sums(per, by, ["_s"], {"below": "q"}).withColumn("below", F.col("below") - F.col("q"))
    hit = F.col("_s") >= threshold
    s = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0))
    agg = ranked.groupBy(*by).agg(s(hit, "p").alias("tp"), s(hit, "q").alias("fp"), s(~hit, "p").alias("fn"), s(~hit, "q").alias("tn"), F.sum(F.col("p") * (F.col("below") + F.col("q") / 2.0)).alias("_a"), F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    prec, rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(*by, (F.col("_p") + F.col("_q")).alias("n"), ((F.col("tp") + F.col("tn")) / (F.col("_p") + F.col("_q"))).alias("accuracy"), prec.alias("precision"), rec.alias("recall"), F.try_divide(2 * prec * rec, prec + rec).alias("f1"), F.try_divide(F.col("_a"), F.col("_p") * F.col("_q")).alias("auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return df.agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(label))).alias("r2"), F.count("*").alias("n"))


def _areas(folded: DataFrame, label: str, columns: list[str], kind: str, grid: list[dict], k: int, parallelism: int) -> DataFrame:
    """``(point, fold, auc)`` of each point of a grid, models being fitted ``parallelism`` at a time."""
    session = folded.sparkSession

    def scored(job: tuple[int, int]) -> DataFrame:
        point, fold = job
        m = train(folded.where(F.col("fold") != fold), label, columns, kind, **grid[point])
        return batch_score(folded.where(F.col("fold") == fold), m, columns).select(F.lit(point).alias("point"), F.lit(fold).alias("fold"), label, "score")

    jobs = [(p, f) for p in range(len(grid)) for f in range(k)]
    with ThreadPoolExecutor(max(1, min(parallelism, len(jobs)))) as pool:
        parts = list(pool.map(inheritable_thread_target(session)(scored), jobs))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return classification_metrics(every, label, "score", by=["point", "fold"]).select("point", "fold", "auc")


def _over_folds(areas: DataFrame, *by: str) -> DataFrame:
    return areas.groupBy(*by).agg(F.avg("auc").alias("mean_auc"), F.stddev_samp("auc").alias("std_auc"), F.count("*").alias("folds"))


def cross_validate(df: DataFrame, key: str, label: str, columns: list[str], kind: str, k: int = 3, parallelism: int = 4, **params) -> DataFrame:
    """Mean and deviation of the area under the curve over folds. Each row is tested in one fold, one with a null key too."""
    folded = materialize(assign_folds(df, key, k, label), "folds")
    return _over_folds(_areas(folded, label, columns, kind, [params], k, parallelism))


def hyperparameter_sweep(df: DataFrame, key: str, label: str, columns: list[str], kind: str, grid: list[dict], k: int = 3, parallelism: int = 4) -> DataFrame:
    """The grid's points with their cross-validated area, best first. The folds are written once for all points."""
    folded = materialize(assign_folds(df, key, k, label), "folds")
    areas = _areas(folded, label, columns, kind, grid, k, parallelism)
    names = F.array(*[F.lit(str(sorted(p.items()))) for p in grid])
    return _over_folds(areas, "point").withColumn("params", F.get(names, F.col("point"))).drop("point").orderBy(F.desc("mean_auc"), "params")


def ensemble(df: DataFrame, models: list, columns: list[str], method: str = "average", weights: list[float] | None = None) -> DataFrame:
    """Mean score or majority vote of models, chained over the same rows."""
    made, scores = assemble(df, columns), []
    for i, m in enumerate(models):
        made = m.transform(made).withColumn(f"_s{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        scores.append(F.col(f"_s{i}"))
    ws = weights or [1.0] * len(models)
    value = sum((s * w for s, w in zip(scores, ws)), F.lit(0.0)) / sum(ws) if method == "average" else sum(((s >= 0.5).cast("int") * w for s, w in zip(scores, ws)), F.lit(0.0)) / sum(ws)
    return made.withColumn("score", value).drop("features", *[f"_s{i}" for i in range(len(models))])


def champion_challenger(test: DataFrame, models: dict, columns: list[str], label: str, champion: str, threshold: float = 0.0, metric: str = "auc") -> DataFrame:
    """Metrics of each model on one test set and which to promote: the best, if it beats the champion by the threshold."""
    scored = None
    for name, m in models.items():
        one = batch_score(test, m, columns).select(F.lit(name).alias("model"), label, "score")
        scored = one if scored is None else scored.unionByName(one)
    got = classification_metrics(scored, label, "score", by=["model"])
    best = got.agg(F.max(F.struct(F.col(metric).alias("v"), F.col("model").alias("m"))).alias("_b"), F.max(F.when(F.col("model") == champion, F.col(metric))).alias("_c"))
    return got.crossJoin(F.broadcast(best)).withColumn("promote", (F.col("model") == F.col("_b.m")) & ((F.col("model") == champion) | (F.col("_b.v") - F.col("_c") > threshold))).drop("_b", "_c")


def adversarial_validation(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Area under the curve of a forest that tells two tables apart; about one half if they are alike."""
    both = a.select(key, *columns).withColumn("_y", F.lit(0)).unionByName(b.select(key, *columns).withColumn("_y", F.lit(1)))
    return cross_validate(both, key, "_y", columns, "forest", 2, numTrees=10)


def permutation_importance(df: DataFrame, model, columns: list[str], label: str, key: str, seed: int = 1, repeats: int = 1) -> DataFrame:
    """``(column, drop, deviation)``: what the area under the curve loses when a column's values are dealt to other rows, the
    mean over ``repeats`` deals, and the deviation between them (null for one).

    A deal puts the rows in a hash order of its own and gives each row the value of the one before, the first that of the last.
    """
    base = materialize(df.select(key, label, *columns), "importance")
    scored = batch_score(base, model, columns).select(F.lit("").alias("column"), F.lit(0).alias("deal"), label, "score")
    for deal in range(repeats):
        hashed = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed + deal))))
        order = materialize(number_rows(base.withColumn("_h", hashed), ["_h", key], "_i").drop("_h"), "dealt")
        n = order.count()
        giver = order.select(F.pmod(F.col("_i") + 1, F.lit(max(n, 1))).alias("_i"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)])
        both = materialize(order.join(giver, "_i"), "both")
        for i, c in enumerate(columns):
            dealt = both.withColumn(c, F.col(f"_{i}"))
            scored = scored.unionByName(batch_score(dealt, model, columns).select(F.lit(c).alias("column"), F.lit(deal).alias("deal"), label, "score"))
    m = classification_metrics(scored, label, "score", by=["column", "deal"]).select("column", "deal", "auc")
    whole = m.where("column = ''").select(F.col("auc").alias("_w"))
    drops = m.where("column <> ''").crossJoin(F.broadcast(whole)).select("column", (F.col("_w") - F.col("auc")).alias("drop"))
    return drops.groupBy("column").agg(F.avg("drop").alias("drop"), F.stddev_samp("drop").alias("deviation"))


def route_versions(df: DataFrame, key: str, weights: dict[str, float], target: str = "version") -> DataFrame:
    """Sticky assignment by weight: the same key always gets the same version."""
    at = F.conv(F.substr(_place(key), F.lit(1), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    total, done, made = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        done += w / total
        made = F.when(at < done, name) if made is None else made.when(at < done, name)
    return df.withColumn(target, made.otherwise(list(weights)[-1]))


def shadow_compare(df: DataFrame, a: str, b: str, threshold: float = 0.5) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.count("*").alias("n"), F.avg(d).alias("mean_difference"), F.max(d).alias("max_difference"), F.avg(((F.col(a) >= threshold) != (F.col(b) >= threshold)).cast("int")).alias("disagreement_rate"))


def rejection_inference(accepted: DataFrame, rejected: DataFrame, model, columns: list[str], label: str) -> DataFrame:
    """Accepted rows and the rejected ones with inferred labels; ``is_inferred`` tells them apart."""
    guessed = batch_score(rejected, model, columns).withColumn(label, F.col("prediction").cast("int"))
    keep = [c for c in accepted.columns if c != label]
    return accepted.select(*keep, label).withColumn("is_inferred", F.lit(False)).unionByName(guessed.select(*keep, label).withColumn("is_inferred", F.lit(True)))


def counterfactuals(df: DataFrame, key: str, feature: str, model, columns: list[str], deltas: tuple[float, ...] = (0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0)) -> DataFrame:
    """``(key, delta, new_value)``: the smallest multiplicative change of a feature that flips the outcome."""
    base = batch_score(df, model, columns).select(key, *columns, F.col("prediction").alias("_was"))
    tried = base.withColumn("delta", F.explode(F.array(*[F.lit(d) for d in deltas]))).withColumn(feature, F.col(feature) * F.col("delta"))
    flipped = batch_score(tried, model, columns).where(F.col("prediction") != F.col("_was"))
    return flipped.groupBy(key).agg(F.min(F.struct(F.abs(F.col("delta") - 1).alias("d"), "delta", F.col(feature).alias("v"))).alias("r")).select(key, "r.delta", F.col("r.v").alias("new_value"))


def daily_metrics(predictions: DataFrame, actuals: DataFrame, on: list[str], ts: str, label: str, score: str) -> DataFrame:
    return classification_metrics(predictions.join(actuals, on).withColumn("day", F.col(ts).cast("date")), label, score, by=["day"])


def psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """Population stability index per column, over bins between the reference's quantiles."""
    r, c = long_values(reference, columns), long_values(current, columns)
    edges = quantiles(r, [i / bins for i in range(1, bins)]).groupBy("column").agg(F.array_sort(F.collect_list("q")).alias("edges"))
    binned = lambda df, n: df.join(F.broadcast(edges), "column").groupBy("column", F.size(F.filter("edges", lambda x: x < F.col("v"))).alias("bin")).agg(F.count("*").alias(n))
    both = edges.select("column", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(binned(r, "a"), ["column", "bin"], "left").join(binned(c, "b"), ["column", "bin"], "left")
    w = Window.partitionBy("column")
    share = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)) / F.sum(F.coalesce(F.col(n), F.lit(0))).over(w), F.lit(floor))
    return both.select("column", share("a").alias("p"), share("b").alias("q")).groupBy("column").agg(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p"))).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Largest distance of the distribution functions per column. Rows shrink to distinct values first, and the functions are
    running sums over all tasks."""
    side = lambda df, a, b: long_values(df, columns).select("column", "v", F.lit(a).alias("a"), F.lit(b).alias("b"))
    per = side(reference, 1, 0).unionByName(side(current, 0, 1)).groupBy("column", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    reached = running_sums(per, ["column"], ["v"], {"a_to": "a", "b_to": "b"}, {"a_all": "a", "b_all": "b"})
    gap = F.abs(F.col("a_to") / F.col("a_all") - F.col("b_to") / F.col("b_all"))
    return reached.groupBy("column").agg(F.max(gap).alias("ks"))


def rollback_check(metrics: DataFrame, ts: str, metric: str, threshold: float, lookback: int) -> DataFrame:
    """Mean of the newest values of a metric and whether it is below the threshold."""
    return metrics.orderBy(F.desc(ts)).limit(lookback).agg(F.avg(metric).alias("recent"), F.count("*").alias("n")).withColumn("rollback", F.coalesce(F.col("recent") < threshold, F.lit(False)))


def prediction_audit(df: DataFrame, name: str, version: str, user: str) -> DataFrame:
    return df.withColumns({"model_name": F.lit(name), "model_version": F.lit(version), "predicted_at": F.current_timestamp(), "requested_by": F.lit(user)})


def fairness_audit(df: DataFrame, attributes: list[str], label: str, predicted: str) -> DataFrame:
    """Rates per group of each attribute and the gaps between its groups: one unpivot, one grouping."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("group")) for a in attributes])).alias("r"), F.col(label).alias("y"), F.col(predicted).alias("p")).select("r.*", "y", "p")
    rate = lambda cond: F.avg(F.when(cond, F.col("p").cast("double")))
    g = long.groupBy("attribute", "group").agg(F.count("*").alias("n"), F.avg(F.col("p").cast("double")).alias("positive_rate"), rate(F.col("y") == 1).alias("tpr"), rate(F.col("y") == 0).alias("fpr"))
    w = Window.partitionBy("attribute")
    gap = lambda c: F.max(c).over(w) - F.min(c).over(w)
    return g.withColumns({"parity_gap": gap("positive_rate"), "odds_gap": F.greatest(gap("tpr"), gap("fpr"))})


def fairness_weights(df: DataFrame, attribute: str, label: str) -> DataFrame:
    """Rows with ``weight`` P(a) P(y) / P(a, y), which makes attribute and label independent."""
    n = df.groupBy(attribute, label).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(F.lit(1))
    w = n.select(F.col(attribute).alias("_a"), F.col(label).alias("_y"), (F.sum("_n").over(Window.partitionBy(attribute)) * F.sum("_n").over(Window.partitionBy(label)) / (F.sum("_n").over(every) * F.col("_n"))).alias("weight"))
    return df.join(w, df[attribute].eqNullSafe(w["_a"]) & df[label].eqNullSafe(w["_y"]), "left").drop("_a", "_y")


def risk_tiers(df: DataFrame, criteria: dict[str, int], high: int = 70, medium: int = 40) -> DataFrame:
    total = F.lit(0)
    for condition, points in criteria.items():
        total = total + F.when(F.expr(condition), points).otherwise(0)
    return df.withColumn("risk_points", total).withColumn("risk_tier", F.when(F.col("risk_points") >= high, "high").when(F.col("risk_points") >= medium, "medium").otherwise("low"))


def retirement_candidates(df: DataFrame, reasons: dict[str, str]) -> DataFrame:
    """Rows for which a condition holds, with the names of those that do."""
    found = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in reasons.items()]))
    return df.withColumn("reasons", found).where(F.size("reasons") > 0)
