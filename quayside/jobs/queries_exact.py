"""Trained models on labels and columns whose answer is known, so that SQL can hold every row against it.

A tree of one split learns a threshold exactly: between the last value of one class and the first of the other. Two
standardized columns have the components (1, 1) and (1, -1). What a model can't promise row by row (factors, topics, word
vectors, isolation) is checked as laws over all rows.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quayside.functions.scratch import materialize
from quayside.jobs.queries_models import ratings
from quayside.jobs.queries_stream import events
from quayside.jobs.queries_tables import daily
from quayside.jobs.registry import query
from quayside.operators import anomaly as N
from quayside.operators import features as X
from quayside.operators import models as M
from quayside.operators import recommend as R
from quayside.operators import timeseries as S
from quayside.streaming import jobs as J

COLUMNS = ["k", "z"]
ONE_SPLIT = {"numTrees": 1, "maxDepth": 1}
#: Every event with two columns and a label that follows the first one but for every seventh row.
NOISY = "e AS (SELECT event_id, event_id % 20 AS k, event_id % 7 AS z, ((event_id % 20 >= 10) <> (event_id % 7 = 0))::INT AS y FROM events)"


def noisy(t):
    k, z = F.col("event_id") % 20, F.col("event_id") % 7
    return t.events.select("event_id", k.alias("k"), z.alias("z"), ((k >= 10) != (z == 0)).cast("int").alias("y"))


def split_at(df, label, columns=COLUMNS, **more):
    return M.train(df, label, columns, "forest", **ONE_SPLIT, **more)


@query("fea6_hashed_totals", "SELECT p_partkey, (2 + p_size)::DOUBLE AS total FROM part")
def _(t):
    """The buckets of a row hold one for each text column and the value of the number, whatever collides."""
    total = F.aggregate(vector_to_array("hashed"), F.lit(0.0), lambda acc, x: acc + x)
    return X.hash_features(t.part, ["p_brand", "p_type", "p_size"], 64).select("p_partkey", total.alias("total"))


@query("fea6_hashed_classes", """SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS same
FROM part""")
def _(t):
    """Parts have equal vectors if, and only if, they agree in all three columns: each value has a bucket of its own here."""
    hashed = X.hash_features(t.part, ["p_brand", "p_type", "p_size"], 1 << 18).withColumn("v", F.col("hashed").cast("string"))
    return hashed.join(hashed.groupBy("v").agg(F.count("*").alias("same")), "v").select("p_partkey", "same")


@query("fea7_counted_words", r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents),
f AS (SELECT term FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2), n AS (SELECT doc_id, count(*) AS n FROM w JOIN f USING (term) GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::DOUBLE AS total FROM documents LEFT JOIN n USING (doc_id)""")
def _(t):
    """Words of each text that at least two texts have."""
    values = F.regexp_extract(F.col("counts").cast("string"), r"\[([^\[\]]*)\]\)$", 1)
    total = F.aggregate(F.transform(F.filter(F.split(values, ","), lambda v: v != ""), lambda v: v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return X.count_vectorize(X.words(t.documents, "text"), "words", None, 2.0).select("doc_id", total.alias("total"))


@query("fea9_vectors_of_equal_words", r"""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM documents)
SELECT count(*) AS texts, count(DISTINCT array_to_string(words, ' ')) AS sequences, 1::BIGINT AS most_vectors, 16 AS size FROM w WHERE words IS NOT NULL""")
def _(t):
    """Equal sequences of words have one vector."""
    made = X.word2vec(X.words(t.documents, "text").where("words is not null"), "words", 16)
    v = made.select(F.array_join("words", " ").alias("s"), vector_to_array("vector").alias("v"))
    per = v.groupBy("s").agg(F.count("*").alias("n"), F.count_distinct(F.col("v").cast("string")).alias("m"), F.max(F.size("v")).alias("size"))
    return per.agg(F.sum("n").alias("texts"), F.count("*").alias("sequences"), F.max("m").alias("most_vectors"), F.max("size").alias("size"))


@query("fea9_words_apart", r"""WITH w AS (
  SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS word FROM documents),
k AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 2)
SELECT doc_id, count(DISTINCT k.word) AS vectors, true AS is_mean FROM w LEFT JOIN k USING (word) GROUP BY doc_id""")
def _(t):
    """Each word that occurs twice has a vector of its own, the others none, and a text has the mean of its words' vectors.

    A word becomes a text of its own as well, which is one more occurrence, so the least count is three.
    """
    texts = X.words(t.documents, "text").where("size(words) > 0").select("doc_id", "words")
    words = texts.select(F.explode("words").alias("w")).distinct().select(F.lit(None).cast("long").alias("doc_id"), F.array("w").alias("words"))
    made = materialize(
        X.word2vec(texts.unionByName(words), "words", 8, min_count=3).select("doc_id", "words", vector_to_array("vector").alias("v")),
        "vectors",
    )
    single = made.where("doc_id is null").select(F.col("words")[0].alias("w"), F.col("v").alias("one"))
    named = single.withColumn("name", F.when(F.exists("one", lambda x: x != 0), F.xxhash64("one")))
    held = made.where("doc_id is not null").select("doc_id", F.explode("words").alias("w")).join(named, "w")
    sums = [F.sum(F.col("one")[k]).alias(f"s{k}") for k in range(8)]
    per = held.groupBy("doc_id", "name").agg(F.count("*").alias("n"), *sums).groupBy("doc_id").agg(
        F.count("name").alias("vectors"), *[(F.sum(f"s{k}") / F.sum("n")).alias(f"m{k}") for k in range(8)]
    )
    whole = made.where("doc_id is not null").select("doc_id", "v")
    gap = F.greatest(*[F.abs(F.col("v")[k] - F.col(f"m{k}")) for k in range(8)])
    return per.join(whole, "doc_id").select("doc_id", "vectors", (gap < 1e-6).alias("is_mean"))


TWO = "u AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_tax * 100 AS b FROM lineitem), m AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM u)"


def two(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_tax") * 100).alias("b"))


@query("fea19_pca", f"WITH {TWO} SELECT l_orderkey, l_linenumber, round(abs((a - ma) / sa + (b - mb) / sb) / sqrt(2), 5) AS p FROM u, m")
def _(t):
    v = X.pca(X.standard_scale(X.assemble(two(t), ["a", "b"], "v"), "v", "s"), "s", 1, "p")
    return v.select("l_orderkey", "l_linenumber", F.round(F.abs(vector_to_array("p")[0]), 5).alias("p"))


@query("ano3_isolation_laws", "SELECT count(*) AS n, true AS in_range, true AS share_kept, true AS edges_stand_out FROM lineitem")
def _(t):
    """Scores lie between 0 and 1, about the wanted share is flagged, and rows at the edges score higher on average."""
    s = N.isolation_forest(t.lineitem, ["l_quantity", "l_extendedprice"], 20, contamination=0.05)
    edge = F.avg(F.when(F.col("l_quantity").isin(1.0, 50.0), F.col("anomaly_score")))
    flagged = F.avg(F.col("is_anomaly").cast("int"))
    return s.agg(F.count("*").alias("n"), F.every(F.col("anomaly_score").between(0, 1)).alias("in_range"), flagged.between(0.03, 0.07).alias("share_kept"), (edge > F.avg("anomaly_score")).alias("edges_stand_out"))


@query("ano3_rare_value", "SELECT event_id, event_id % 50 = 0 AS is_anomaly FROM events")
def _(t):
    """One event in fifty has another value, which every tree parts from the others at once; a hundredth is asked for, and
    equal scores are flagged alike."""
    d = t.events.select("event_id", (F.col("event_id") % 50 == 0).cast("int").alias("x"))
    return N.isolation_forest(d, ["x"], 20, contamination=0.01).select("event_id", "is_anomaly")


@query("ano4_reconstruction_error", f"WITH {TWO}, e AS (SELECT l_orderkey, l_linenumber, pow((a - ma) / sa - (b - mb) / sb, 2) / 2 AS e FROM u, m) SELECT l_orderkey, l_linenumber, round(e, 5) AS reconstruction_error FROM e")
def _(t):
    made = N.reconstruction_anomaly(two(t), ["a", "b"], 1)
    return made.select("l_orderkey", "l_linenumber", F.round("reconstruction_error", 5).alias("reconstruction_error"))


@query("ano8_fraud_threshold", "SELECT event_id, event_id % 20 >= 18 AS is_fraud FROM events")
def _(t):
    """A tenth of the events is fraud; the model sees three quarters of all."""
    d = noisy(t).withColumn("y", (F.col("k") >= 18).cast("int"))
    return N.supervised_fraud(d.where("event_id % 4 <> 0"), d, COLUMNS, "y", 2).select("event_id", (F.col("score") > 0.5).alias("is_fraud"))


@query("tsf2_level_of_each_series", "SELECT DISTINCT l_returnflag AS s, l_shipdate::DATE AS day, ascii(l_returnflag)::DOUBLE AS prediction FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")
def _(t):
    """Series of one level each: one model for all has to give each its own."""
    d = daily(t).select("s", "day", F.ascii("s").cast("double").alias("y"))
    made = S.global_forecaster(d.where("day < DATE '1998-01-01'"), d.where("day >= DATE '1998-01-01'"), ["s"], "day", "y", trees=2)
    return made.select("s", "day", F.round("prediction", 4).alias("prediction"))


BEST_FIVE = "SELECT DISTINCT o_custkey::INT AS u, 5::BIGINT AS n, true AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def best_five(recs):
    """Of each user, how many items, and whether they are different ones in the order of their scores."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "score")))
    per = recs.groupBy("u").agg(F.count("*").alias("n"), F.count_distinct("i").alias("m"), listed.alias("l"))
    falling = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda k: F.element_at("l", k)["score"] >= F.element_at("l", k + 1)["score"])
    return per.select("u", "n", ((F.col("m") == F.col("n")) & falling).alias("ordered"))


@query("rec1_five_items", BEST_FIVE)
def _(t):
    r = ratings(t).groupBy("u", "i").agg(F.avg("l_quantity").alias("r"))
    return best_five(R.recommend(R.als(r, "u", "i", "r", iterations=2), "u", "i", 5))


#: Ratings that one factor explains: (1 + user / 1000) times (1 + number of the brand).
PRODUCTS = "p AS (SELECT DISTINCT l_suppkey::INT AS u, replace(p_brand, 'Brand#', '')::INT AS i FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT u, i, (1 + u / 1000.0) * (1 + i) AS r FROM p)"


def products(t):
    both = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    p = both.select(F.col("l_suppkey").cast("int").alias("u"), F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("i")).distinct()
    return p.withColumn("r", (1 + F.col("u") / 1000.0) * (1 + F.col("i")))


def one_factor(r):
    return R.als(r, "u", "i", "r", rank=1, iterations=10, reg=0.0)


@query("rec1_items", f"WITH {PRODUCTS}, a AS (SELECT DISTINCT u FROM p), b AS (SELECT DISTINCT i FROM p), s AS (SELECT i, u, (1 + u / 1000.0) * (1 + i) AS score, row_number() OVER (PARTITION BY i ORDER BY u DESC) AS rank FROM a, b) SELECT i, rank::INT AS rank, u, round(score, 3) AS score FROM s WHERE rank <= 3")
def _(t):
    """The three users of each item with the highest ratings, where one factor explains all ratings."""
    return R.recommend_to_items(one_factor(products(t)), "u", "i", 3).select("i", "rank", "u", F.round(F.col("score").cast("double"), 3).alias("score"))


@query("rec1_rmse", f"WITH {PRODUCTS} SELECT count(*) AS n, round(sqrt(avg(CASE WHEN u % 2 = 0 THEN 0.25 ELSE 0 END)), 3) AS rmse, round(avg(CASE WHEN u % 2 = 0 THEN 0.5 ELSE 0 END), 3) AS mae, 1 AS unknown FROM r")
def _(t):
    """Ratings of even users are half a point off, and one user is new to the model."""
    r = products(t)
    model = one_factor(r)
    test = r.withColumn("r", F.col("r") + F.when(F.col("u") % 2 == 0, 0.5).otherwise(0.0))
    test = test.unionByName(test.limit(1).withColumn("u", F.lit(-1)))
    return R.rating_error(model, test, "r").select("n", F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"), "unknown")


@query("rec2_five_items", BEST_FIVE)
def _(t):
    r = ratings(t).groupBy("u", "i").agg(F.count("*").cast("double").alias("r"))
    return best_five(R.recommend(R.als(r, "u", "i", "r", iterations=2, implicit=True), "u", "i", 5))


@query("rec2_items_of_own_kind", """WITH p AS (
  SELECT DISTINCT l_suppkey::INT AS u, replace(p_brand, 'Brand#', '')::INT AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT i % 2 AS kind, string_agg(i::VARCHAR, ',' ORDER BY i) AS items FROM (SELECT DISTINCT i FROM p) GROUP BY 1)
SELECT DISTINCT u, items FROM p JOIN g ON u % 2 = kind""")
def _(t):
    """Even users took even items and odd ones odd items: a user's best items are all those of its own kind."""
    p = products(t).where("u % 2 = i % 2").select("u", "i", F.lit(1.0).alias("r"))
    size = p.groupBy(F.pmod("i", F.lit(2)).alias("kind")).agg(F.count_distinct("i").alias("n"))
    best = R.recommend(R.als(p, "u", "i", "r", rank=2, implicit=True), "u", "i", 25)
    own = best.join(F.broadcast(size), F.col("kind") == F.col("u") % 2).where("rank <= n")
    return own.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i.cast("string")), ",").alias("items"))


@query("rec8_topic_laws", "SELECT doc_id, true AS valid FROM documents")
def _(t):
    """The likeliest of four topics has at least a quarter; a text of no known words has none."""
    made = R.topics(X.words(t.documents, "text"), "doc_id", "words", 4, 500, 3)
    known = F.col("topic").between(0, 3) & F.col("probability").between(0.2499, 1.0001)
    return made.select("doc_id", F.when(F.col("probability") == 0, F.col("topic").isNull()).otherwise(known).alias("valid"))


@query("rec8_two_vocabularies", r"""SELECT doc_id, (doc_id % 2)::BIGINT AS kind FROM documents
WHERE len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) > 0""")
def _(t):
    """Words are told by their first sign and by the parity of the text's number, so even and odd texts share no word and
    two topics tell them apart. The topic of most even texts is 0."""
    marked = F.transform("words", lambda w: F.concat(F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), F.left(w, F.lit(1))))
    texts = X.words(t.documents, "text").where("size(words) > 0").select("doc_id", marked.alias("words"))
    made = materialize(R.topics(texts, "doc_id", "words", 2, 500, 20, share=1.0).select("doc_id", "topic"), "topics")
    even = made.where("doc_id % 2 = 0").agg(F.mode("topic").alias("even"))
    return made.crossJoin(F.broadcast(even)).select("doc_id", (F.col("topic") != F.col("even")).cast("long").alias("kind"))


HELD_OUT = "SELECT event_id, (event_id % 20 > 12)::INT::DOUBLE AS score, (event_id % 20 > 12)::INT::DOUBLE AS prediction, 'v7' AS model_version FROM events"


@query("mod5_learned_split", HELD_OUT)
def _(t):
    """Multiples of 4 are held out, so the split lies between 11 and 13, at 12."""
    d = noisy(t).withColumn("y", (F.col("k") >= 12).cast("int"))
    return M.batch_score(d, split_at(d.where("event_id % 4 <> 0"), "y"), COLUMNS, "v7").select("event_id", "score", "prediction", "model_version")


@query("srv1_scored_part", HELD_OUT.replace("FROM events", "FROM events WHERE event_id % 3 = 0"))
def _(t):
    d = noisy(t).withColumn("y", (F.col("k") >= 12).cast("int"))
    scored = M.batch_score(d.where("event_id % 3 = 0").drop("y"), split_at(d.where("event_id % 4 <> 0"), "y"), COLUMNS, "v7")
    return scored.select("event_id", "score", "prediction", "model_version")


@query("srv1_scored_whole", HELD_OUT)
def _(t):
    """All events, scored without their label by a model that was trained on the others than multiples of 4."""
    d = noisy(t).withColumn("y", (F.col("k") >= 12).cast("int"))
    scored = M.batch_score(d.drop("y"), split_at(d.where("event_id % 4 <> 0"), "y"), COLUMNS, "v7")
    return scored.select("event_id", "score", "prediction", "model_version")


def folds_sql(k: int) -> str:
    """The area in each of k folds: a split has the mean of the two rates as its area."""
    return f"""WITH {NOISY}, f AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY md5(event_id::VARCHAR), event_id) - 1) % {k} AS fold FROM e),
a AS (SELECT fold, (avg((k >= 10)::INT) FILTER (y = 1) + avg((k < 10)::INT) FILTER (y = 0)) / 2 AS auc FROM f GROUP BY 1)"""


def rounded(df):
    return df.withColumns({c: F.round(c, 8) for c in ("mean_auc", "std_auc")})


DEPTHS = [{"maxDepth": d, "numTrees": 1} for d in (0, 1)]
NAMES = [str(sorted(p.items())).replace("'", "''") for p in DEPTHS]


@query("mod6_sweep_of_depths", f"{folds_sql(2)} SELECT '{NAMES[1]}' AS params, round(avg(auc), 8) AS mean_auc, round(stddev_samp(auc), 8) AS std_auc, count(*) AS folds FROM a UNION ALL SELECT '{NAMES[0]}', 0.5, 0, 2")
def _(t):
    """Without a split all rows score alike, which is an area of a half."""
    return rounded(M.hyperparameter_sweep(noisy(t), "event_id", "y", COLUMNS, "forest", DEPTHS, 2))


@query("mod7_areas_of_folds", f"{folds_sql(3)} SELECT round(avg(auc), 8) AS mean_auc, round(stddev_samp(auc), 8) AS std_auc, count(*) AS folds FROM a")
def _(t):
    return rounded(M.cross_validate(noisy(t), "event_id", "y", COLUMNS, "forest", 3, **ONE_SPLIT))


@query("mod8_weighted_splits", "SELECT event_id, ((event_id % 20 >= 10)::INT * 3 + (event_id % 7 >= 4)::INT) / 4 AS score FROM events")
def _(t):
    d = noisy(t).withColumns({"y": (F.col("k") >= 10).cast("int"), "y2": (F.col("z") >= 4).cast("int")})
    return M.ensemble(d, [split_at(d, "y"), split_at(d, "y2")], COLUMNS, weights=[3.0, 1.0]).select("event_id", "score")


@query("mod10_promoted_split", f"""WITH {NOISY}, s AS (SELECT 'challenger' AS model, y, k >= 10 AS hit FROM e UNION ALL SELECT 'champion', y, z >= 4 FROM e),
c AS (SELECT model, count(*) AS n, count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn FROM s GROUP BY 1)
SELECT model, n, round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS auc, model = 'challenger' AS promote FROM c""")
def _(t):
    d = noisy(t).withColumn("y2", (F.col("z") >= 4).cast("int"))
    got = M.champion_challenger(d, {"champion": split_at(d, "y2"), "challenger": split_at(d, "y")}, COLUMNS, "y", "champion")
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "auc")})


@query("mod11_tables_apart", "SELECT 1.0::DOUBLE AS mean_auc, 0.0::DOUBLE AS std_auc, 2::BIGINT AS folds")
def _(t):
    """Two halves of the events that one column tells apart."""
    d = noisy(t)
    return rounded(M.adversarial_validation(d.where("k < 10"), d.where("k >= 10"), "event_id", COLUMNS))


@query("mod12_importance_of_split", f"""WITH {NOISY}, o AS (SELECT *, row_number() OVER (ORDER BY md5(event_id::VARCHAR || '1'), event_id) AS i FROM e),
d AS (SELECT a.y, a.k, b.k AS dealt FROM o a JOIN o b ON a.i % (SELECT count(*) FROM e) = (b.i + 1) % (SELECT count(*) FROM e)),
a AS (SELECT (avg((k >= 10)::INT) FILTER (y = 1) + avg((k < 10)::INT) FILTER (y = 0) - avg((dealt >= 10)::INT) FILTER (y = 1) - avg((dealt < 10)::INT) FILTER (y = 0)) / 2 AS v FROM d)
SELECT 'k' AS "column", round(v, 8) AS "drop" FROM a UNION ALL SELECT 'z', 0""")
def _(t):
    d = noisy(t)
    return M.permutation_importance(d, split_at(d, "y"), COLUMNS, "y", "event_id").select("column", F.round("drop", 8).alias("drop"))


@query("mod12_repeats", f"""WITH {NOISY}, s AS (SELECT unnest(['1', '2', '3']) AS s), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5(event_id::VARCHAR || s), event_id) AS i FROM e, s),
d AS (SELECT a.s, a.y, a.k, b.k AS dealt FROM o a JOIN o b ON a.s = b.s AND a.i % (SELECT count(*) FROM e) = (b.i + 1) % (SELECT count(*) FROM e)),
a AS (SELECT s, (avg((k >= 10)::INT) FILTER (y = 1) + avg((k < 10)::INT) FILTER (y = 0) - avg((dealt >= 10)::INT) FILTER (y = 1) - avg((dealt < 10)::INT) FILTER (y = 0)) / 2 AS v FROM d GROUP BY s)
SELECT 'k' AS "column", round(avg(v), 8) AS "drop", round(stddev_samp(v), 8) AS deviation FROM a UNION ALL SELECT 'z', 0, 0""")
def _(t):
    """Three deals of each column."""
    d = noisy(t)
    got = M.permutation_importance(d, split_at(d, "y"), COLUMNS, "y", "event_id", repeats=3)
    return got.select("column", F.round("drop", 8).alias("drop"), F.round("deviation", 8).alias("deviation"))


@query("srv4_inferred_split", f"WITH {NOISY} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (k >= 10)::INT ELSE y END AS y, event_id % 3 = 0 AS is_inferred FROM e")
def _(t):
    d = noisy(t)
    accepted = d.where("event_id % 3 <> 0")
    return M.rejection_inference(accepted, d.where("event_id % 3 = 0"), split_at(accepted, "y"), COLUMNS, "y").select("event_id", "y", "is_inferred")


@query("srv5_counterfactual_split", """WITH x AS (SELECT event_id, (event_id % 50 + 1)::DOUBLE AS x, unnest([0.5, 0.75, 0.9, 1.1, 1.25, 1.5, 2.0])::DOUBLE AS d FROM events)
SELECT event_id, arg_min(d, abs(d - 1)) AS delta, arg_min(x * d, abs(d - 1)) AS new_value FROM x WHERE (x > 25.5) <> (x * d > 25.5) GROUP BY 1""")
def _(t):
    """1 to 25 is one class and 26 to 50 the other: the split lies at 25.5."""
    d = t.events.select("event_id", (F.col("event_id") % 50 + 1).cast("double").alias("x"))
    d = d.withColumn("y", (F.col("x") > 25).cast("int"))
    return M.counterfactuals(d, "event_id", "x", split_at(d, "y", ["x"], maxBins=64), ["x"])


@query("str10_scored_stream", "SELECT event_id, (event_id % 20 >= 10)::INT::DOUBLE AS score FROM events")
def _(t):
    d = noisy(t).withColumn("y", (F.col("k") >= 10).cast("int"))
    payload = events(t).select(F.to_json(F.struct("event_id", (F.col("event_id") % 20).alias("k"), (F.col("event_id") % 7).alias("z"))).alias("v"))
    scored = J.stream_score(payload, "v", "event_id long, k long, z long", split_at(d, "y"), COLUMNS)
    return J.run_now(scored.select("event_id", "score"), "append").select("event_id", "score")
