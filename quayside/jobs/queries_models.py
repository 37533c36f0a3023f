"""Queries of anomalies, forecasts, ranking, models, monitoring and fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions.scratch import materialize
from quayside.jobs.queries_tables import DAILY, daily
from quayside.jobs.registry import query
from quayside.operators import anomaly as N
from quayside.operators import features as X
from quayside.operators import models as M
from quayside.operators import neighbours as B
from quayside.operators import recommend as R
from quayside.operators import timeseries as S

RISK = "CASE WHEN o_totalprice > 300000 THEN 50.0 ELSE 0 END + CASE WHEN o_orderpriority LIKE '1%' THEN 30.0 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN 20.0 ELSE 0 END"
RISK_RULES = {"o_totalprice > 300000": 50, "o_orderpriority LIKE '1%'": 30, "o_orderstatus = 'P'": 20}


@query("ano1_rule_engine", f"SELECT o_orderkey, ({RISK})::DOUBLE AS risk_score, {RISK} >= 50 AS is_flagged FROM orders")
def _(t):
    return N.rule_engine(t.orders, RISK_RULES, 50).select("o_orderkey", "risk_score", "is_flagged")


@query("ano2_fraud_cases", f"WITH r AS (SELECT o_orderkey, ({RISK})::DOUBLE AS risk_score FROM orders), c AS (SELECT *, CASE WHEN risk_score >= 80 THEN 'high' WHEN risk_score >= 50 THEN 'medium' END AS priority FROM r WHERE risk_score >= 50) SELECT o_orderkey, risk_score, priority, 'open' AS status, ['ann', 'bob', 'cy'][(row_number() OVER (PARTITION BY priority ORDER BY risk_score DESC, o_orderkey) - 1) % 3 + 1] AS assignee, 'case-' || left(sha256(o_orderkey::VARCHAR), 12) AS case_id FROM c")
def _(t):
    return N.fraud_cases(N.rule_engine(t.orders, RISK_RULES, 50), "o_orderkey", "risk_score", {"high": 80, "medium": 50}, ["ann", "bob", "cy"])


@query("ano3_isolation_forest")
def _(t):
    return N.isolation_forest(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 20).select("l_orderkey", "l_linenumber", "anomaly_score", "is_anomaly")


@query("ano4_reconstruction_anomaly")
def _(t):
    return N.reconstruction_anomaly(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2).select("l_orderkey", "l_linenumber", "reconstruction_error", "is_anomaly")


@query("ano5_dbscan", """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size / 10 AS x, p_retailprice / 100 AS y FROM part),
near AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 0.15::DOUBLE * 0.15::DOUBLE),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5), e AS (SELECT near.a, near.b FROM near JOIN core USING (a) JOIN core c ON c.a = near.b),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
l AS (SELECT near.a AS id, min(cluster) AS cluster FROM near JOIN c ON c.id = near.b GROUP BY 1)
SELECT p_partkey, coalesce(cluster, -1) AS cluster, core.a IS NOT NULL AS is_core FROM part LEFT JOIN l ON l.id = p_partkey LEFT JOIN core ON core.a = p_partkey""")
def _(t):
    pts = t.part.select("p_partkey", (F.col("p_size") / 10).alias("x"), (F.col("p_retailprice") / 100).alias("y"))
    return N.dbscan(pts, "p_partkey", ["x", "y"], 0.15, 5)


REACHED = 'r AS (SELECT s, d FROM p UNION SELECT r.s, p.d FROM r JOIN p ON r.d = p.s)'


@query("ano6_linked_entities", f"WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey AS e, l_partkey, l_shipdate FROM lineitem), p AS (SELECT DISTINCT x.e AS s, y.e AS d FROM v x JOIN v y USING (l_partkey, l_shipdate)), {REACHED} SELECT s AS e, min(d) AS \"group\" FROM r GROUP BY 1")
def _(t):
    """Orders that ship the same part on the same day."""
    v = t.lineitem.select(F.col("l_orderkey").alias("e"), F.concat_ws("|", "l_partkey", "l_shipdate").alias("a"))
    return N.linked_entities(v, "e", ["a"])


@query("ano6_linked_entities_whole", f"WITH RECURSIVE v AS (SELECT user_id, min(user_id) OVER (PARTITION BY event_type, value) AS h FROM events), p AS (SELECT user_id AS s, h AS d FROM v UNION SELECT h, user_id FROM v), {REACHED} SELECT s AS user_id, min(d) AS \"group\" FROM r GROUP BY 1")
def _(t):
    """All users, linked by an equal value of an event of the same type."""
    return N.linked_entities(t.events.select("user_id", F.to_json(F.struct("event_type", "value")).alias("a")), "user_id", ["a"])


def labelled(t):
    """Labelled documents with a made-up score that leans to the label, and plain features."""
    d = t.documents.select("doc_id", "lang", "source", F.length("text").alias("n"), F.size(F.split("text", " ")).alias("w"), F.size(F.split("text", "[|%$]")).alias("marks"))
    j = d.join(t.labels, "doc_id")
    score = ((F.col("doc_id") * 37 % 101) / 200.0 + F.col("quality") * 0.4).alias("score")
    return j.select("doc_id", "lang", "source", "n", "w", "marks", "quality", "toxic", score)


SCORED = "sc AS (SELECT doc_id, lang, source, quality, toxic, (doc_id * 37 % 101) / 200.0 + quality * 0.4 AS score FROM documents JOIN labels USING (doc_id))"
AUC = "(SELECT sum(CASE WHEN a.score > b.score THEN 1 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) FROM sc a, sc b WHERE a.quality = 1 AND b.quality = 0)"


@query("ano7_calibrate_scores", f"""WITH {SCORED}, g AS (SELECT score, sum(quality) AS y, count(*) AS n, row_number() OVER (ORDER BY score) AS k FROM sc GROUP BY score),
c AS (SELECT k, sum(y) OVER (ORDER BY k) AS cy, sum(n) OVER (ORDER BY k) AS cn, y, n FROM g),
m AS (SELECT a.k AS a, b.k AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS m FROM c a JOIN c b ON b.k >= a.k),
l AS (SELECT a, b AS k, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS least FROM m), h AS (SELECT k, max(least) AS calibrated FROM l GROUP BY k)
SELECT doc_id, round(sc.score, 6) AS score, round(calibrated, 6) AS calibrated FROM sc JOIN g ON g.score = sc.score JOIN h ON h.k = g.k""")
def _(t):
    d = labelled(t)
    return N.calibrate_scores(d, d, "score", "quality").select("doc_id", F.round("score", 6).alias("score"), F.round("calibrated", 6).alias("calibrated"))


@query("ano8_supervised_fraud")
def _(t):
    d = labelled(t)
    return N.supervised_fraud(d.where("doc_id % 4 <> 0"), d, ["n", "w", "marks"], "quality", 5).select("doc_id", "score")


@query("tsf1_forecast_series")
def _(t):
    return S.forecast_series(daily(t), "s", "day", "y", 14)


@query("tsf1_forecast_trend", f"""WITH {DAILY}, a AS (SELECT s, day, y, day - min(day) OVER (PARTITION BY s) AS t FROM fc), b AS (SELECT s, avg(t) AS mt, avg(y) AS my, max(day) AS z, min(day) AS first, count(*) AS n FROM a GROUP BY s),
l AS (SELECT s, sum((t - mt) * (y - my)) / sum((t - mt) * (t - mt)) AS slope FROM a JOIN b USING (s) GROUP BY s),
e AS (SELECT s, day, y, false AS is_future FROM fc UNION ALL SELECT s, z + k::INT, NULL, true FROM b, range(1, 15) r(k)),
h AS (SELECT s, e.day, e.y, is_future, my + slope * ((e.day - first) - mt) AS yhat, n FROM e JOIN b USING (s) JOIN l USING (s)), d2 AS (SELECT s, sqrt(sum((y - yhat) * (y - yhat)) / (max(n) - 2)) AS sd FROM h GROUP BY s)
SELECT s, day, round(yhat, 2) AS yhat, round(yhat + 1.96 * sd, 2) AS upper, coalesce(abs(y - yhat) > 1.96 * sd, false) AS is_anomaly, is_future FROM h JOIN d2 USING (s)""")
def _(t):
    f = S.forecast_series(daily(t), "s", "day", "y", 14, harmonics=0)
    return f.select("s", "day", F.round("yhat", 2).alias("yhat"), F.round("upper", 2).alias("upper"), "is_anomaly", "is_future")


@query("tsf2_global_forecaster")
def _(t):
    d = daily(t).select("s", "day", "y")
    return S.global_forecaster(d.where("day < DATE '1998-01-01'"), d.where("day >= DATE '1998-01-01'"), ["s"], "day", "y", trees=5).select("s", "day", "y", "prediction")


@query("tsf3_quantile_intervals", f"WITH {DAILY}, q AS (SELECT s, quantile_cont(y - yhat, 0.1) a, quantile_cont(y - yhat, 0.9) b FROM fc GROUP BY s) SELECT s, day, round(yhat + a, 2) AS q10, round(yhat + b, 2) AS q90 FROM fc JOIN q USING (s)")
def _(t):
    d = daily(t)
    q = S.quantile_intervals(d.select("s", "day", "yhat"), d.select("s", (F.col("y") - F.col("yhat")).alias("e")), ["s"], "yhat", "e")
    return q.select("s", "day", F.round("q10", 2).alias("q10"), F.round("q90", 2).alias("q90"))


@query("tsf4_forecast_accuracy", f"WITH {DAILY} SELECT s, round(avg(abs(y - yhat)), 2) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(abs((y - yhat) / y)) * 100, 3) AS mape, round(avg(yhat - y), 3) AS bias, count(*) AS n FROM fc GROUP BY s")
def _(t):
    d = daily(t)
    a = S.forecast_accuracy(d.select("s", "day", "yhat"), d.select("s", "day", "y"), ["s", "day"], ["s"], "yhat", "y")
    return a.select("s", F.round("mae", 2).alias("mae"), F.round("rmse", 2).alias("rmse"), F.round("mape", 3).alias("mape"), F.round("bias", 3).alias("bias"), "n")


@query("tsf5_correct_bias", f"WITH {DAILY} SELECT s, day, round(yhat - (SELECT avg(yhat - y) FROM fc WHERE day >= DATE '1998-01-01'), 2) AS corrected FROM fc")
def _(t):
    d = daily(t)
    return S.correct_bias(d, d.where("day >= DATE '1998-01-01'"), "yhat", "y").select("s", "day", F.round("corrected", 2).alias("corrected"))


@query("tsf6_compare_versions", f"WITH {DAILY}, e AS (SELECT avg(abs((y - yhat) / y)) * 100 AS a, avg(abs((y - yhat * 0.9) / y)) * 100 AS b FROM fc) SELECT round(a, 4) AS mape_a, round(b, 4) AS mape_b, round(a - b, 4) AS improvement, b - a > 0 AS rollback FROM e")
def _(t):
    d = daily(t)
    b = d.select("s", "day", (F.col("yhat") * 0.9).alias("yhat"))
    return S.compare_versions(d.select("s", "day", "yhat"), b, d.select("s", "day", "y"), ["s", "day"], "yhat", "y").withColumns({c: F.round(c, 4) for c in ("mape_a", "mape_b", "improvement")})


def ratings(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("int").alias("u"), F.col("l_partkey").cast("int").alias("i"), "l_quantity", "l_shipdate")


@query("rec1_als")
def _(t):
    r = ratings(t).groupBy("u", "i").agg(F.avg("l_quantity").alias("r"))
    return R.recommend(R.als(r, "u", "i", "r", iterations=2), "u", "i", 5)


@query("rec2_implicit_als")
def _(t):
    r = ratings(t).groupBy("u", "i").agg(F.count("*").cast("double").alias("r"))
    return R.recommend(R.als(r, "u", "i", "r", iterations=2, implicit=True), "u", "i", 5)


@query("rec3_sar", """WITH aff AS (SELECT o_custkey AS u, p_brand AS i, sum(l_quantity * exp(-ln(2.0) * date_diff('day', l_shipdate::DATE, DATE '1998-12-31') / 365.0)) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT x.i, y.i AS j, count(*) AS c FROM aff x JOIN aff y USING (u) GROUP BY ALL), n AS (SELECT i, count(*) AS n FROM aff GROUP BY 1),
s AS (SELECT c.i, c.j, c / (a.n + b.n - c) AS s FROM c JOIN n a ON a.i = c.i JOIN n b ON b.i = c.j),
r AS (SELECT u, j AS i, sum(a * s) AS score FROM aff JOIN s ON s.i = aff.i GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM r WHERE NOT EXISTS (SELECT 1 FROM aff WHERE aff.u = r.u AND aff.i = r.i))
SELECT u, rank::INT AS rank, round(score, 4) AS score FROM k WHERE rank <= 3""")
def _(t):
    i = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("o_custkey").alias("u"), F.col("p_brand").alias("i"), "l_quantity", "l_shipdate")
    return R.sar(i, "u", "i", "l_shipdate", "l_quantity", "1998-12-31", 365.0, k=3).select("u", "rank", F.round("score", 4).alias("score"))


@query("rec3_sar_lift", """WITH aff AS (
  SELECT o_custkey AS u, l_suppkey AS i, sum(l_quantity * exp(-ln(2.0) * date_diff('day', l_shipdate::DATE, DATE '1998-12-31') / 365.0)) AS a
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
c AS (SELECT x.i, y.i AS j, count(*) AS c FROM aff x JOIN aff y USING (u) GROUP BY ALL), n AS (SELECT i, count(*) AS n FROM aff GROUP BY 1),
s AS (SELECT c.i, c.j, c / (a.n * b.n) AS s FROM c JOIN n a ON a.i = c.i JOIN n b ON b.i = c.j),
r AS (SELECT u, j AS i, sum(a * s) AS score FROM aff JOIN s ON s.i = aff.i GROUP BY ALL)
SELECT u, row_number() OVER (PARTITION BY u ORDER BY score DESC, i)::INT AS rank, round(score, 8) AS score
FROM r QUALIFY rank <= 5""")
def _(t):
    """Suppliers by lift, those a customer has bought from included."""
    i = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    i = i.select(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("i"), "l_quantity", "l_shipdate")
    found = R.sar(i, "u", "i", "l_shipdate", "l_quantity", "1998-12-31", 365.0, similarity="lift", k=5, hide_seen=False)
    return found.select("u", "rank", F.round("score", 8).alias("score"))


@query("rec4_nearest_neighbours", "SELECT query, neighbour, round(s, 5) AS similarity, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) n FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE n <= 5")
def _(t):
    """Of all vectors."""
    return R.nearest_neighbours(t.embeddings, t.embeddings, "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 5))


def approximate(t):
    """Ten approximate neighbours of every 20th vector among all, and the exact ones."""
    e = t.embeddings
    some = e.where("vec_id % 20 = 0")
    return R.lsh_neighbours(some, e, "vec_id", "embedding", 10), R.nearest_neighbours(some, e, "vec_id", "embedding", 10)


@query("rec4_lsh")
def _(t):
    """Each row with the share of all exact neighbours that were found."""
    near, exact = approximate(t)
    near = materialize(near, "near")
    found = exact.join(near.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    recall = found.agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
    return near.withColumn("similarity", F.round("similarity", 5)).crossJoin(F.broadcast(recall))


@query("rec4_lsh_recall", """WITH s AS (SELECT a.vec_id AS query, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC) AS n
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT count(*) AS wanted, true AS recalled, 0 AS beyond FROM s WHERE n <= 10""")
def _(t):
    """The number of exact neighbours, whether nine tenths of them were found, and how many found ones are farther than the
    exact one of their rank would let them be near."""
    near, exact = approximate(t)
    both = exact.select("query", "rank", F.col("neighbour").alias("e"), F.col("similarity").alias("best")).join(near.select("query", F.col("neighbour").alias("e"), F.lit(1).alias("hit")), ["query", "e"], "left")
    ranks = both.join(near.select("query", "rank", "similarity"), ["query", "rank"], "left")
    hits = F.sum(F.coalesce("hit", F.lit(0)))
    return ranks.agg(F.count("*").alias("wanted"), (hits >= 0.9 * F.count("*")).alias("recalled"), F.count(F.when(F.col("similarity") > F.col("best") + 1e-9, 1)).cast("int").alias("beyond"))


@query("rec5_cosine_similarity", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(R.cosine(F.col("x"), F.col("y")), 5).alias("s"))


@query("rec6_ranking_quality", "WITH r AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, (floor(l_quantity)::INT % 3) AS rel FROM lineitem), i AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, k) AS ik FROM r) SELECT q, round(coalesce(sum(CASE WHEN k <= 3 THEN (2 ** rel - 1) / log2(k + 1) ELSE 0 END) / nullif(sum(CASE WHEN ik <= 3 THEN (2 ** rel - 1) / log2(ik + 1) ELSE 0 END), 0), 0), 6) AS ndcg_at_k, round(sum(CASE WHEN k <= 3 AND rel > 0 THEN 1 ELSE 0 END) / 3, 6) AS precision_at_k FROM i GROUP BY q")
def _(t):
    from pyspark.sql import Window

    r = t.lineitem.select(F.col("l_orderkey").alias("q"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("k"), (F.floor("l_quantity").cast("int") % 3).alias("rel"))
    return R.ranking_quality(r, "q", "k", "rel", 3).withColumns({c: F.round(c, 6) for c in ("ndcg_at_k", "precision_at_k")})


@query("rec7_bandit_policy_value", "WITH m AS (SELECT user_id % 10 AS c, event_type AS a, avg(value) AS m FROM events GROUP BY ALL), b AS (SELECT c, max({'m': m, 'a': a}) AS g, count(*) AS k FROM m GROUP BY c) SELECT count(*) AS n, round(avg((0.1 / k + CASE WHEN e.event_type = g.a THEN 0.9 ELSE 0 END) / 0.2 * value), 4) AS value FROM events e JOIN b ON b.c = e.user_id % 10")
def _(t):
    log = t.events.select((F.col("user_id") % 10).alias("c"), F.col("event_type").alias("a"), "value", F.lit(0.2).alias("p"))
    return R.bandit_policy_value(log, ["c"], "a", "value", "p").withColumn("value", F.round("value", 4))


@query("rec8_topics")
def _(t):
    return R.topics(X.words(t.documents, "text"), "doc_id", "words", 4, 500, 3)


@query("mod1_stratified_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.8) THEN 'train' ELSE 'test' END AS split FROM orders")
def _(t):
    return M.stratified_split(t.orders, "o_orderstatus", "o_orderkey", 0.8).select("o_orderkey", "split")


@query("mod2_assign_folds", "SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def _(t):
    return M.assign_folds(t.orders, "o_orderkey", 5, "o_orderstatus").select("o_orderkey", "fold")


@query("mod3_time_series_split", "WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, (SELECT count(*) FROM orders) // 4 AS z FROM orders), s AS (SELECT unnest([1, 2, 3]) AS split) SELECT split, CASE WHEN i < split * z THEN 'train' ELSE 'test' END AS role, o_orderkey FROM n, s WHERE i < split * z OR (i >= split * z + 10 AND i < (split + 1) * z)")
def _(t):
    return M.time_series_split(t.orders.select("o_orderdate", "o_orderkey"), "o_orderdate", 3, 10).select("split", "role", "o_orderkey")


@query("mod4_oversample", "WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1) SELECT quality, (SELECT max(n) FROM c) AS count FROM c")
def _(t):
    return M.oversample(labelled(t), "quality").groupBy("quality").count()


@query("mod4_neighbours", """WITH p AS (SELECT p_partkey AS i, p_size::DOUBLE AS x, p_retailprice AS y FROM part),
n AS (SELECT a.i AS query, b.i AS neighbour, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.i <> b.i),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM n) SELECT query, neighbour, round(d, 9) AS distance, rank::INT AS rank FROM r WHERE rank <= 3""")
def _(t):
    """Of all parts the three nearest by size and price."""
    return B.self_neighbours(t.part, "p_partkey", ["p_size", "p_retailprice"], 3, 128).withColumn("distance", F.round("distance", 9))


@query("mod4_smote")
def _(t):
    return M.smote(labelled(t), "doc_id", "quality", ["n", "w", "marks"], 0)


@query("mod4_smote_ratio", "SELECT 0 AS quality, greatest(count(*) FILTER (quality <> 0) * 2 - count(*) FILTER (quality = 0), 0) AS n, true AS inside FROM documents JOIN labels USING (doc_id)")
def _(t):
    """How many new rows there are, and whether all lie within the bounds of their class."""
    d = labelled(t)
    made = M.smote(d, "doc_id", "quality", ["n", "w", "marks"], 0, ratio=2.0)
    box = d.where("quality = 0").agg(*[f(c).alias(f"{p}_{c}") for c in ("n", "w", "marks") for p, f in (("a", F.min), ("b", F.max))])
    inside = F.expr(" AND ".join(f"{c} >= a_{c} - 1e-6 AND {c} <= b_{c} + 1e-6" for c in ("n", "w", "marks")))
    return made.crossJoin(F.broadcast(box)).agg(F.lit(0).alias("quality"), F.count("*").alias("n"), F.coalesce(F.every(inside), F.lit(True)).alias("inside"))


@query("mod5_train_and_score")
def _(t):
    d = labelled(t)
    m = M.train(d.where("doc_id % 4 <> 0"), "quality", ["n", "w", "marks"], "forest", numTrees=10, maxDepth=5)
    return M.batch_score(d, m, ["n", "w", "marks"], "v1").select("doc_id", "score", "prediction", "model_version")


@query("mod6_hyperparameter_sweep")
def _(t):
    return M.hyperparameter_sweep(labelled(t), "doc_id", "quality", ["n", "w", "marks"], "logistic", [{"regParam": 0.0}, {"regParam": 0.1}], 2)


@query("mod7_cross_validate")
def _(t):
    return M.cross_validate(labelled(t), "doc_id", "quality", ["n", "w", "marks"], "logistic", 3)


@query("mod8_ensemble")
def _(t):
    d, cols = labelled(t), ["n", "w", "marks"]
    ms = [M.train(d, "quality", cols, "logistic"), M.train(d, "quality", cols, "forest", numTrees=5)]
    return M.ensemble(d, ms, cols).select("doc_id", "score")


@query("mod9_classification_metrics", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality = 0 AND score >= 0.5) AS fp, count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality = 0 AND score < 0.5) AS tn FROM sc) SELECT tp + fp + fn + tn AS n, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round({AUC}, 6) AS auc FROM c")
def _(t):
    m = M.classification_metrics(labelled(t), "quality", "score")
    return m.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "auc")})


@query("mod9_regression_metrics", f"WITH {DAILY} SELECT round(sqrt(avg((y - yhat) * (y - yhat))), 2) AS rmse, round(avg(abs(y - yhat)), 2) AS mae, round(1 - avg((y - yhat) * (y - yhat)) / var_pop(y), 6) AS r2, count(*) AS n FROM fc")
def _(t):
    return M.regression_metrics(daily(t), "y", "yhat").select(F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mae"), F.round("r2", 6).alias("r2"), "n")


@query("mod10_champion_challenger")
def _(t):
    d, cols = labelled(t), ["n", "w", "marks"]
    ms = {"champion": M.train(d, "quality", ["n", "w", "marks"], "logistic"), "challenger": M.train(d, "quality", cols, "forest", numTrees=5)}
    return M.champion_challenger(d, ms, cols, "quality", "champion")


@query("mod11_adversarial_validation")
def _(t):
    d = labelled(t)
    return M.adversarial_validation(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id", ["n", "w"])


@query("mod12_permutation_importance")
def _(t):
    d, cols = labelled(t), ["n", "w", "marks"]
    return M.permutation_importance(d, M.train(d, "quality", cols, "logistic"), cols, "quality", "doc_id").select("column", "drop")


@query("srv2_route_versions", "SELECT c_custkey, CASE WHEN ('0x' || left(md5(c_custkey::VARCHAR), 8))::BIGINT / 4294967296 < 0.8 THEN 'a' ELSE 'b' END AS version FROM customer")
def _(t):
    return M.route_versions(t.customer, "c_custkey", {"a": 0.8, "b": 0.2}).select("c_custkey", "version")


@query("srv3_shadow_compare", f"WITH {SCORED} SELECT count(*) AS n, round(avg(abs(score - toxic)), 6) AS mean_difference, round(max(abs(score - toxic)), 6) AS max_difference, round(avg(((score >= 0.5) <> (toxic >= 0.5))::INT), 6) AS disagreement_rate FROM sc")
def _(t):
    s = M.shadow_compare(labelled(t).withColumn("toxic", F.col("toxic").cast("double")), "score", "toxic")
    return s.withColumns({c: F.round(c, 6) for c in ("mean_difference", "max_difference", "disagreement_rate")})


@query("srv4_rejection_inference")
def _(t):
    d, cols = labelled(t).select("doc_id", "n", "w", "marks", "quality"), ["n", "w", "marks"]
    m = M.train(d.where("doc_id % 3 <> 0"), "quality", cols, "logistic")
    return M.rejection_inference(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0"), m, cols, "quality").select("doc_id", "quality", "is_inferred")


@query("srv5_counterfactuals")
def _(t):
    d, cols = labelled(t).withColumn("marks", F.col("marks").cast("double")), ["n", "w", "marks"]
    return M.counterfactuals(d, "doc_id", "marks", M.train(d, "quality", cols, "logistic"), cols)


@query("srv6_prediction_audit", "SELECT doc_id, 'm' AS model_name, '1' AS model_version, 'u' AS requested_by FROM labels")
def _(t):
    return M.prediction_audit(t.labels.select("doc_id"), "m", "1", "u").drop("predicted_at")


@query("srv7_daily_metrics", "WITH p AS (SELECT event_id, ts::DATE AS day, (event_type = 'purchase')::INT AS y, (event_id % 97) / 97.0 AS s FROM events) SELECT day, count(*) AS n, round(avg((y = (s >= 0.5)::INT)::INT), 6) AS accuracy, round(count(*) FILTER (y = 1 AND s >= 0.5) / count(*) FILTER (y = 1), 6) AS recall FROM p GROUP BY 1")
def _(t):
    p = t.events.select("event_id", "ts", ((F.col("event_id") % 97) / 97.0).alias("s"))
    y = t.events.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"))
    return M.daily_metrics(p, y, ["event_id"], "ts", "y", "s").select("day", "n", F.round("accuracy", 6).alias("accuracy"), F.round("recall", 6).alias("recall"))


@query("srv8_psi", """WITH r AS (SELECT l_extendedprice AS v FROM lineitem WHERE l_orderkey % 2 = 0), c AS (SELECT l_extendedprice * 1.1 AS v FROM lineitem WHERE l_orderkey % 2 = 1),
e AS (SELECT quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM r),
a AS (SELECT len(list_filter(q, lambda x: x < v)) AS b, count(*) AS n FROM r, e GROUP BY 1), d AS (SELECT len(list_filter(q, lambda x: x < v)) AS b, count(*) AS n FROM c, e GROUP BY 1),
j AS (SELECT greatest(coalesce(a.n, 0) / (SELECT count(*) FROM r), 1e-4) AS p, greatest(coalesce(d.n, 0) / (SELECT count(*) FROM c), 1e-4) AS q FROM a FULL OUTER JOIN d USING (b))
SELECT 'v' AS "column", round(sum((q - p) * ln(q / p)), 6) AS psi FROM j""")
def _(t):
    r = t.lineitem.where("l_orderkey % 2 = 0").select(F.col("l_extendedprice").alias("v"))
    c = t.lineitem.where("l_orderkey % 2 = 1").select((F.col("l_extendedprice") * 1.1).alias("v"))
    return M.psi(r, c, ["v"]).withColumn("psi", F.round("psi", 6))


@query("srv9_ks", """WITH u AS (SELECT l_quantity AS v, (l_returnflag = 'R')::INT AS a, (l_returnflag <> 'R')::INT AS b FROM lineitem), g AS (SELECT v, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1),
k AS (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS d FROM g) SELECT 'l_quantity' AS "column", round(max(d), 8) AS ks FROM k""")
def _(t):
    li = t.lineitem.select("l_quantity", "l_returnflag")
    return M.ks(li.where("l_returnflag = 'R'"), li.where("l_returnflag <> 'R'"), ["l_quantity"]).withColumn("ks", F.round("ks", 8))


@query("srv10_rollback_check", "WITH d AS (SELECT ts::DATE AS day, avg(value) AS m FROM events GROUP BY 1), l AS (SELECT * FROM d ORDER BY day DESC LIMIT 7) SELECT round(avg(m), 6) AS recent, count(*) AS n, avg(m) < 50 AS rollback FROM l")
def _(t):
    d = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("m"))
    return M.rollback_check(d, "day", "m", 50.0, 7).withColumn("recent", F.round("recent", 6))


@query("gov1_fairness_audit", f"""WITH {SCORED}, u AS (SELECT 'lang' AS attribute, lang AS "group", quality AS y, (score >= 0.5)::INT AS p FROM sc UNION ALL SELECT 'source', source, quality, (score >= 0.5)::INT FROM sc),
g AS (SELECT attribute, "group", count(*) AS n, avg(p) AS positive_rate, avg(p) FILTER (y = 1) AS tpr, avg(p) FILTER (y = 0) AS fpr FROM u GROUP BY ALL)
SELECT attribute, "group", n, round(positive_rate, 6) AS positive_rate, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(max(positive_rate) OVER w - min(positive_rate) OVER w, 6) AS parity_gap, round(greatest(max(tpr) OVER w - min(tpr) OVER w, max(fpr) OVER w - min(fpr) OVER w), 6) AS odds_gap FROM g WINDOW w AS (PARTITION BY attribute)""")
def _(t):
    a = M.fairness_audit(labelled(t).withColumn("p", (F.col("score") >= 0.5).cast("int")), ["lang", "source"], "quality", "p")
    return a.withColumns({c: F.round(c, 6) for c in ("positive_rate", "tpr", "fpr", "parity_gap", "odds_gap")})


@query("gov2_fairness_weights", f"WITH {SCORED} SELECT doc_id, round(count(*) OVER (PARTITION BY lang) * count(*) OVER (PARTITION BY quality) / (count(*) OVER () * count(*) OVER (PARTITION BY lang, quality)), 6) AS weight FROM sc")
def _(t):
    return M.fairness_weights(labelled(t), "lang", "quality").select("doc_id", F.round("weight", 6).alias("weight"))


@query("gov3_risk_tiers", "WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 30 ELSE 0 END + CASE WHEN c_nationkey < 10 THEN 20 ELSE 0 END + CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 25 ELSE 0 END AS risk_points FROM customer) SELECT c_custkey, risk_points, CASE WHEN risk_points >= 70 THEN 'high' WHEN risk_points >= 40 THEN 'medium' ELSE 'low' END AS risk_tier FROM r")
def _(t):
    return M.risk_tiers(t.customer, {"c_acctbal < 0": 30, "c_nationkey < 10": 20, "c_mktsegment = 'AUTOMOBILE'": 25}).select("c_custkey", "risk_points", "risk_tier")


@query("gov4_retirement_candidates", "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderdate < TIMESTAMP '1993-01-01' THEN 'age' END, CASE WHEN o_totalprice < 2000 THEN 'value' END], lambda x: x IS NOT NULL), ',') AS reasons FROM orders WHERE o_orderdate < TIMESTAMP '1993-01-01' OR o_totalprice < 2000")
def _(t):
    r = M.retirement_candidates(t.orders, {"age": "o_orderdate < TIMESTAMP '1993-01-01'", "value": "o_totalprice < 2000"})
    return r.select("o_orderkey", F.array_join("reasons", ",").alias("reasons"))


@query("udf1_score_udf", "SELECT c_custkey, round(c_acctbal * 2 + 1, 4) AS v FROM customer")
def _(t):
    f = M.score_udf(lambda s: s * 2 + 1, "double")
    return t.customer.select("c_custkey", F.round(f("c_acctbal"), 4).alias("v"))


@query("udf2_group_apply", "SELECT c_nationkey, round(max(c_acctbal) - min(c_acctbal), 4) AS spread FROM customer GROUP BY 1")
def _(t):
    import pandas as pd

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_nationkey": [pdf["c_nationkey"].iloc[0]], "spread": [pdf["c_acctbal"].max() - pdf["c_acctbal"].min()]})

    return M.group_apply(t.customer.select("c_nationkey", "c_acctbal"), ["c_nationkey"], spread, "c_nationkey int, spread double").withColumn("spread", F.round("spread", 4))
