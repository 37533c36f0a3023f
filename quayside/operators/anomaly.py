"""Rules, cases, isolation forest, reconstruction error, density clusters, linked entities, calibration."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.graph import connected_components
from quayside.functions.scratch import materialize
from quayside.operators.enrichment import number_within
from quayside.operators.quantiles import quantile_row
from quayside.operators.features import assemble
from quayside.operators.models import without_summary


def rule_engine(df: DataFrame, rules: dict[str, float], threshold: float) -> DataFrame:
    """``risk_score``: sum of the scores of the SQL rules that hold; ``is_flagged`` from the threshold on."""
    total = F.lit(0.0)
    for rule, score in rules.items():
        total = total + F.when(F.expr(rule), F.lit(float(score))).otherwise(0.0)
    return df.withColumn("risk_score", total).withColumn("is_flagged", F.col("risk_score") >= threshold)


def fraud_cases(flagged: DataFrame, key: str, score: str, bands: dict[str, float], assignees: list[str]) -> DataFrame:
    """Cases of the rows whose score reaches the lowest band: priority, status, assignee in turn within the priority (by
    score, then key), and an identifier made from the key."""
    ordered = sorted(bands.items(), key=lambda kv: -kv[1])
    band = F.lit(None).cast("string")
    for name, least in reversed(ordered):
        band = F.when(F.col(score) >= least, name).otherwise(band)
    cases = flagged.withColumn("priority", band).where("priority is not null")
    cases = number_within(cases.withColumn("_least", -F.col(score)), "priority", ["_least", key], "_turn")
    turn = F.col("_turn")
    names = F.array(*[F.lit(a) for a in assignees])
    return cases.select(key, score, "priority", F.lit("open").alias("status"), F.element_at(names, (turn % len(assignees)).cast("int") + 1).alias("assignee"), F.concat(F.lit("case-"), F.substr(F.sha2(F.col(key).cast("string"), 256), F.lit(1), F.lit(12))).alias("case_id"))


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> dict:
    spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(x.shape[1])
    if depth >= limit or len(x) <= 1 or not spread.any():
        return {"n": len(x)}
    f = int(rng.choice(np.flatnonzero(spread)))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return {"f": f, "cut": cut, "l": _grow(x[left], rng, depth + 1, limit), "r": _grow(x[~left], rng, depth + 1, limit)}


def _mean_path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _path(tree: dict, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if "n" in tree:
        return np.full(len(x), depth + _mean_path(tree["n"]))
    left = x[:, tree["f"]] < tree["cut"]
    out = np.empty(len(x))
    out[left], out[~left] = _path(tree["l"], x[left], depth + 1), _path(tree["r"], x[~left], depth + 1)
    return out


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 50, sample: int = 256, contamination: float = 0.05, seed: int = 1) -> DataFrame:
    """``anomaly_score`` in (0, 1) of every row and ``is_anomaly`` for the highest share. Each tree is grown on its own
    sample of at most ``sample`` rows, one tree a group; the forest, bounded by both parameters, is broadcast."""
    n = max(1, df.count())
    share = min(1.0, 2.0 * sample * trees / n)
    drawn = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna().sample(True, share if share < 1 else float(trees), seed) if n else df.select(*columns)
    keyed = drawn.withColumn("_t", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(trees)).cast("int")).withColumn("_o", F.row_number().over(Window.partitionBy("_t").orderBy(F.rand(seed)))).where(F.col("_o") <= sample)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        import json

        t = int(pdf["_t"].iloc[0])
        x = pdf.sort_values(columns)[columns].to_numpy()
        return pd.DataFrame({"tree": [json.dumps({"size": len(x), "root": _grow(x, np.random.default_rng(seed + t), 0, int(np.ceil(np.log2(max(2, sample)))))})]})

    import json

    forest = [json.loads(r["tree"]) for r in keyed.groupBy("_t").applyInPandas(grow, "tree string").collect()]
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in cols], axis=1)
        depth = np.mean([_path(t["root"], x) for t in shared.value], axis=0) if shared.value else np.zeros(len(x))
        norm = _mean_path(float(np.mean([t["size"] for t in shared.value]))) if shared.value else 1.0
        return pd.Series(np.power(2.0, -depth / max(norm, 1e-9)))

    scored = df.withColumn("anomaly_score", score(*[F.col(c).cast("double") for c in columns]))
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10000).alias("_c"))
    return scored.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.coalesce(F.col("anomaly_score") >= F.col("_c"), F.lit(False))).drop("_c")


def reconstruction_anomaly(df: DataFrame, columns: list[str], k: int, percentile: float = 0.95) -> DataFrame:
    """Squared error of the standardized columns against their first ``k`` components, and whether it is beyond the
    percentile of all errors. Components being orthogonal, the error is the vector's length less that of its projection."""
    v = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(a := assemble(df, columns, "_v")).transform(a)
    p = PCA(k=k, inputCol="_s", outputCol="_p").fit(v).transform(v)
    square = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda acc, x: acc + x * x)
    out = p.withColumn("reconstruction_error", F.greatest(F.lit(0.0), square("_s") - square("_p"))).drop("_v", "_s", "_p")
    cut = quantile_row(out, {"_c": ("reconstruction_error", percentile)})
    return out.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col("reconstruction_error") > F.col("_c")).drop("_c")


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_samples: int) -> DataFrame:
    """``(key, cluster, is_core)``: density clusters of points in a few columns; outliers have cluster -1.

    Points fall into cells whose diagonal is just under ``eps``, so all points of a cell are neighbours: in a cell of
    ``min_samples`` points all are core, without a pair. Only points of thinner cells are compared with the cells around,
    and of cells that hold core points it is only asked whether any two of these are neighbours (``_touching``). The cluster
    is its smallest core key; a border point takes the smallest of its core neighbours' clusters. Copies of a position
    count once per position. Points with a null among the columns are left out, an empty table gives no rows.
    """
    width = eps / np.sqrt(len(columns)) * (1 - 1e-12)
    pts = df.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    cell = F.array(*[F.floor(F.col(c) / width).cast("long") for c in columns])
    spots = pts.groupBy(*columns).agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("cell", cell)
    dense = spots.groupBy("cell").agg((F.sum("n") >= min_samples).alias("dense"))
    spots = materialize(spots.join(dense, "cell"), "spots")

    reach = int(eps / width) + 1
    # Cells at such an offset can hold a neighbour: between them lie fewer cells than eps is long.
    offsets = [d for d in product(range(-reach, reach + 1), repeat=len(columns)) if sum(max(abs(x) - 1, 0) ** 2 for x in d) * width * width <= eps * eps]
    shifted = lambda some: F.explode(F.array(*[F.array(*[F.col("cell")[i] + x for i, x in enumerate(d)]) for d in some]))
    thin = spots.where("not dense").select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns], shifted(offsets).alias("cell"))
    gap = sum((F.pow(F.col(f"a_{c}") - F.col(c), 2) for c in columns), F.lit(0.0))
    near = materialize(thin.join(spots, "cell").where(gap <= eps * eps).select("a", F.col("id").alias("b"), "n"), "near")
    enough = near.groupBy("a").agg(F.sum("n").alias("m")).where(F.col("m") >= min_samples).select(F.col("a").alias("id"), F.lit(True).alias("enough"))
    core = spots.join(enough, "id", "left").where("dense or enough").select("id", "cell", *columns)
    core = core.join(core.groupBy("cell").agg(F.min("id").alias("node")), "cell")
    core = materialize(core, "core")

    nodes = core.select("cell", "node").distinct()
    ahead = [d for d in offsets if d > (0,) * len(columns)]
    pairs = nodes.select(F.col("node").alias("p"), shifted(ahead).alias("cell")).join(nodes.withColumnRenamed("node", "q"), "cell").select("p", "q")
    links = _touching(core, pairs, columns, width, eps).unionByName(nodes.select(F.col("node").alias("p"), F.col("node").alias("q")))
    clusters = core.join(connected_components(links, "p", "q"), "node").select("id", F.col("component").alias("cluster"), F.lit(True).alias("is_core"))
    border = near.join(clusters, near["b"] == clusters["id"]).groupBy("a").agg(F.min("cluster").alias("b_cluster")).withColumnRenamed("a", "id")
    told = spots.select("id", *columns).join(clusters, "id", "left").join(border, "id", "left")
    told = told.select(*columns, F.coalesce("cluster", "b_cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return pts.join(told, columns).select(F.col("id").alias(key), "cluster", "is_core")


def _touching(core: DataFrame, pairs: DataFrame, columns: list[str], width: float, eps: float, levels: int = 24) -> DataFrame:
    """Of the pairs ``(p, q)`` of cells (by node) those of which some two points are within ``eps``.

    Boxes around the points decide: if the farthest two points of two boxes could be within eps, the cells touch; if the
    nearest two can't, these boxes are done with. What is left is looked at in boxes of half the width, and after
    ``levels`` halvings point by point. Crowded cells touch at once or not at all, so their points make no pairs.
    """
    parts = F.array(*[F.floor(F.col(c) / width * F.col("scale")).cast("long") for c in columns])
    bounds = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]

    def boxes(level: int, side: str, open_: DataFrame | None) -> DataFrame:
        held = core if open_ is None else core.join(open_.select(F.col(side).alias("node")).distinct(), "node", "left_semi")
        made = held.withColumn("scale", F.lit(float(1 << level))).withColumn("part", F.col("id") if level > levels else F.lit(0) if level == 0 else parts)
        if level > levels:
            return made.select("node", F.array("id").alias("part"), *[F.col(c).alias(f"{name}_{c}") for c in columns for name in ("low", "high")], parts.alias("above"))
        above = F.transform("part", lambda x: F.floor(x / 2).cast("long")) if level > 1 else F.array().cast("array<long>")
        return made.groupBy("node", *(["part"] if level else [])).agg(*bounds).withColumn("part", F.col("part") if level else F.array().cast("array<long>")).withColumn("above", above)

    open_, found = None, None
    for level in range(levels + 2):
        sides = []
        for side in ("p", "q"):
            own = boxes(level, side, open_)
            sides.append(own.select(F.col("node").alias(side), F.col("above").alias(f"{side}_above"), F.col("part").alias(f"{side}_part"), *[F.col(f"{n}_{c}").alias(f"{side}_{n}_{c}") for c in columns for n in ("low", "high")]))
        before = pairs if open_ is None else open_.withColumnsRenamed({"p_part": "p_above", "q_part": "q_above"})
        met = before
        for side, own in zip(("p", "q"), sides):
            met = met.join(own.drop(f"{side}_above") if open_ is None else own, [side] if open_ is None else [side, f"{side}_above"])
        least = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"q_low_{c}") - F.col(f"p_high_{c}"), F.col(f"p_low_{c}") - F.col(f"q_high_{c}")), 2) for c in columns), F.lit(0.0))
        most = sum((F.pow(F.greatest(F.col(f"p_high_{c}") - F.col(f"q_low_{c}"), F.col(f"q_high_{c}") - F.col(f"p_low_{c}")), 2) for c in columns), F.lit(0.0))
        looked = materialize(met.select("p", "q", "p_part", "q_part", least.alias("least"), most.alias("most")).where(F.col("least") <= eps * eps), "boxes")
        touching = looked.where(F.col("most") <= eps * eps).select("p", "q").distinct()
        found = touching if found is None else found.unionByName(touching)
        open_ = looked.where(F.col("most") > eps * eps).join(touching, ["p", "q"], "left_anti").select("p", "q", "p_part", "q_part")
        if level > levels or open_.isEmpty():
            return found
    return found


def linked_entities(df: DataFrame, entity: str, attributes: list[str]) -> DataFrame:
    """``(entity, group)``: entities that share a value of any attribute, over any number of steps. Each value is joined to
    its smallest entity, so a value that thousands share makes thousands of links, not their square."""
    pairs = None
    for a in attributes:
        v = df.select(F.col(entity).alias("e"), F.col(a).cast("string").alias("v")).where("v is not null and e is not null").distinct()
        hub = v.groupBy("v").agg(F.min("e").alias("h"))
        p = v.join(hub, "v").select("e", "h")
        pairs = p if pairs is None else pairs.unionByName(p)
    return connected_components(pairs, "e", "h").select(F.col("node").alias(entity), F.col("component").alias("group"))


def calibrate_scores(train: DataFrame, df: DataFrame, score: str, label: str, method: str = "isotonic") -> DataFrame:
    """``calibrated``: probabilities from scores, by an isotonic curve or a logistic one."""
    if method == "isotonic":
        m = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(train.withColumn(label, F.col(label).cast("double")))
        return m.transform(df)
    m = LogisticRegression(featuresCol="_f", labelCol=label, predictionCol="_y", probabilityCol="_p", rawPredictionCol="_r")
    m = without_summary(m.fit(assemble(train, [score], "_f")))
    return m.transform(assemble(df, [score], "_f")).withColumn("calibrated", vector_to_array("_p")[1]).drop("_f", "_y", "_p", "_r")


def supervised_fraud(train: DataFrame, test: DataFrame, columns: list[str], label: str, trees: int = 20) -> DataFrame:
    """``test`` scored by boosted trees whose rare class weighs as much as the other."""
    n = train.agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q")).first()
    weighted = assemble(train, columns, "_f").withColumn("_w", F.when(F.col(label) == 1, (n["q"] or 0) / max(1, n["p"] or 0)).otherwise(1.0))
    m = GBTClassifier(featuresCol="_f", labelCol=label, weightCol="_w", maxIter=trees, seed=1).fit(weighted)
    return m.transform(assemble(test, columns, "_f")).withColumn("score", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability")
