"""Feature engineering: encoders, scalers, dates, places, text; feature tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, CountVectorizer, FeatureHasher, OneHotEncoder, PolynomialExpansion, StandardScaler, StringIndexer, VectorAssembler, Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quayside.functions.scratch import discard, materialize
from quayside.operators import word_vectors
from quayside.operators.joins import asof_join, latest_per_key
from quayside.operators.quantiles import quantile_row

EARTH_KM = 6371.0
#: Fixed value: the digits of place cells.
GEO_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def assemble(df: DataFrame, columns: list[str], target: str = "features", invalid: str = "error") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=target, handleInvalid=invalid).transform(df)


def polynomial_features(df: DataFrame, columns: list[str], degree: int = 2, target: str = "poly") -> DataFrame:
    return PolynomialExpansion(degree=degree, inputCol="_v", outputCol=target).transform(assemble(df, columns, "_v")).drop("_v")


def bucketize(df: DataFrame, column: str, splits: list[float], target: str) -> DataFrame:
    """Number of the bucket, right-open but for the last; outside or null: null."""
    c = F.col(column)
    made = F.when(c == splits[-1], len(splits) - 2)
    for i, (a, b) in enumerate(zip(splits, splits[1:])):
        made = made.when((c >= a) & (c < b), i)
    return df.withColumn(target, made)


def string_index(df: DataFrame, column: str, target: str):
    """Numbers by frequency, ties by the alphabet; unseen values get one more number."""
    return StringIndexer(inputCol=column, outputCol=target, handleInvalid="keep", stringOrderType="frequencyDesc").fit(df).transform(df)


def one_hot(df: DataFrame, column: str, target: str) -> DataFrame:
    indexed = string_index(df, column, f"{target}_index")
    return OneHotEncoder(inputCols=[f"{target}_index"], outputCols=[target]).fit(indexed).transform(indexed)


def target_encode(df: DataFrame, column: str, target: str, smoothing: float = 10.0, name: str | None = None) -> DataFrame:
    """(mean * n + global mean * s) / (n + s) per category."""
    g = df.agg(F.avg(target).alias("_g"))
    s = df.groupBy(column).agg(F.avg(target).alias("_m"), F.count(target).alias("_n")).crossJoin(F.broadcast(g))
    enc = s.select(F.col(column).alias("_k"), ((F.coalesce("_m", F.lit(0.0)) * F.col("_n") + F.col("_g") * smoothing) / (F.col("_n") + smoothing)).alias(name or f"{column}_encoded"))
    return df.join(enc, df[column].eqNullSafe(enc["_k"]), "left").drop("_k")


def frequency_encode(df: DataFrame, column: str, normalize: bool = True, name: str | None = None) -> DataFrame:
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    enc = n.crossJoin(F.broadcast(total)).select(column, (F.col("_n") / F.col("_t") if normalize else F.col("_n")).alias(name or f"{column}_frequency"))
    return df.join(enc, column, "left")


def hash_features(df: DataFrame, columns: list[str], n: int = 1024, target: str = "hashed") -> DataFrame:
    return FeatureHasher(inputCols=columns, outputCol=target, numFeatures=n).transform(df)


def words(df: DataFrame, column: str, target: str = "words") -> DataFrame:
    return df.withColumn(target, F.filter(F.split(F.lower(F.col(column)), r"[^a-z0-9]+"), lambda w: w != ""))


def count_vectorize(df: DataFrame, tokens: str, vocabulary: int | None = 10000, min_df: float = 1.0, target: str = "counts"):
    """Counts of the ``vocabulary`` most frequent words that ``min_df`` texts have; None: of all of those, however many. The
    driver holds the vocabulary."""
    size = vocabulary or max(1, df.select(F.explode(tokens).alias("_w")).agg(F.count_distinct("_w")).first()[0])
    return CountVectorizer(inputCol=tokens, outputCol=target, vocabSize=size, minDF=min_df).fit(df).transform(df)


def term_counts(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, term, tf)`` of the distinct words of each row, counted inside the task that holds the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                keys, lists = batch.column(0).slice(at, 500), batch.column(1).slice(at, 500)
                words_, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
                held = words_.is_valid().to_numpy(zero_copy_only=False)
                encoded = words_.filter(pa.array(held)).dictionary_encode()
                size = max(1, len(encoded.dictionary))
                found, n = np.unique(row[held].astype(np.int64) * size + encoded.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(found // size)), encoded.dictionary.take(pa.array(found % size)), pa.array(n, pa.int64())], names=[key, "term", "tf"])

    schema = StructType([df.schema[key], StructField("term", StringType()), StructField("tf", LongType())])
    return df.select(key, tokens).mapInArrow(run, schema)


def tfidf(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """``(key, term, tf, df, tfidf)`` with tf * ln((N + 1) / (df + 1)): a row is a document, document frequencies are counted
    over all rows. Words are counted inside their row, so only distinct terms of a document are shuffled; rows without words
    count as documents and give no terms."""
    n = df.agg(F.count("*").alias("_n"))
    tf = materialize(term_counts(df, key, tokens), "terms")
    dfs = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log((F.col("_n") + 1) / (F.col("df") + 1))
    return tf.join(dfs, "term").crossJoin(F.broadcast(n)).select(key, "term", "tf", "df", weight.alias("tfidf"))


#: Of a vocabulary of more words no process holds the vectors.
HELD_WORDS = 1 << 18


def word2vec(df: DataFrame, tokens: str, size: int = 32, target: str = "vector", seed: int = 1, min_count: int = 2, partitions: int | None = None) -> DataFrame:
    """Trained on all rows in ``partitions`` tasks, as many as the session runs at once if None: one task would read the whole
    table. Each holds the vectors of the whole vocabulary; their changes are added up in the end. The tokens are written
    once, as they are read several times, and are dealt to all tasks however few files the table has. The driver holds the
    vocabulary as well, so one of more than HELD_WORDS is trained by ``word_vectors``, where each task holds its own words."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    held = materialize(df.select(tokens).repartition(n), "tokens")
    words_ = held.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("w").isNotNull() & (F.col("n") >= min_count))
    if words_.count() > HELD_WORDS:
        vectors = word_vectors.train(held, size, seed, min_count)
        discard(held)
        return word_vectors.mean_vectors(df, tokens, vectors, size, target)
    model = Word2Vec(inputCol=tokens, outputCol=target, vectorSize=size, seed=seed, minCount=min_count, maxIter=1, numPartitions=n).fit(held)
    discard(held)
    return model.transform(df)


def ratio_features(df: DataFrame, pairs: list[tuple[str, str]], on_zero: float | None = None) -> DataFrame:
    made = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return df.withColumns({f"{a}_per_{b}": made(a, b) if on_zero is None else F.coalesce(made(a, b), F.lit(on_zero)) for a, b in pairs})


def interaction_features(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs})


#: Periods of the parts of a date (days of the week count from Sunday = 1).
PERIODS = {"hour": 24, "dayofweek": 7, "month": 12, "dayofyear": 365}


def cyclical_datetime(df: DataFrame, ts: str, parts: list[str]) -> DataFrame:
    part = {"hour": F.hour, "dayofweek": F.dayofweek, "month": F.month, "dayofyear": F.dayofyear}
    return df.withColumns({f"{p}_{n}": f(part[p](ts) * (2 * math.pi / PERIODS[p])) for p in parts for n, f in (("sin", F.sin), ("cos", F.cos))})


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on the sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Cell of a place: bits of longitude and latitude in turn, five a digit, by column arithmetic."""
    bits = 5 * precision
    n_lon, n_lat = (bits + 1) // 2, bits // 2
    cell = lambda v, lo, span, n: F.least(F.floor((v - lo) / span * (1 << n)), F.lit((1 << n) - 1)).cast("long")
    x, y = cell(lon, -180.0, 360.0, n_lon), cell(lat, -90.0, 180.0, n_lat)
    bit = lambda k: F.shiftright(x, n_lon - 1 - k // 2).bitwiseAND(F.lit(1)) if k % 2 == 0 else F.shiftright(y, n_lat - 1 - k // 2).bitwiseAND(F.lit(1))
    digits = []
    for d in range(precision):
        v = F.lit(0).cast("long")
        for k in range(5 * d, 5 * d + 5):
            v = v * 2 + bit(k)
        digits.append(F.substr(F.lit(GEO_DIGITS), v.cast("int") + 1, F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*digits))


def missing_indicators(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def cap_outliers(df: DataFrame, columns: list[str], method: str = "iqr", lower: float = 0.01, upper: float = 0.99, multiplier: float = 1.5) -> DataFrame:
    """Values beyond the bounds become the bounds; the bounds of all columns are one row."""
    shares = (0.25, 0.75) if method == "iqr" else (lower, upper)
    found = quantile_row(df, {f"_q{i}_{c}": (c, p) for c in columns for i, p in enumerate(shares)})
    aggs = []
    for c in columns:
        q = [F.col(f"_q0_{c}"), F.col(f"_q1_{c}")]
        lo, hi = (q[0] - multiplier * (q[1] - q[0]), q[1] + multiplier * (q[1] - q[0])) if method == "iqr" else q
        aggs += [lo.alias(f"_lo_{c}"), hi.alias(f"_hi_{c}")]
    made = df.crossJoin(F.broadcast(found.select(*aggs)))
    return made.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))) for c in columns}).select(*df.columns)


def correct_skew(df: DataFrame, columns: list[str], method: str = "log1p") -> DataFrame:
    f = {"log1p": F.log1p, "sqrt": F.sqrt}[method]
    return df.withColumns({f"{c}_{method}": f(F.col(c)) for c in columns})


def robust_scale(df: DataFrame, columns: list[str], centering: bool = False) -> DataFrame:
    """By the range of the quartiles; a range of 0 gives 0."""
    found = quantile_row(df, {f"_{k}_{c}": (c, p) for c in columns for k, p in (("a", 0.25), ("m", 0.5), ("b", 0.75))})
    made = df.crossJoin(F.broadcast(found.select(*[x for c in columns for x in (F.col(f"_m_{c}"), (F.col(f"_b_{c}") - F.col(f"_a_{c}")).alias(f"_r_{c}"))])))
    return made.withColumns({f"{c}_scaled": F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - (F.col(f"_m_{c}") if centering else F.lit(0.0)), F.col(f"_r_{c}")), F.lit(0.0))) for c in columns}).select(*df.columns, *[f"{c}_scaled" for c in columns])


def standard_scale(df: DataFrame, vector: str, target: str) -> DataFrame:
    return StandardScaler(inputCol=vector, outputCol=target, withMean=True, withStd=True).fit(df).transform(df)


def pca(df: DataFrame, vector: str, k: int, target: str) -> DataFrame:
    return PCA(k=k, inputCol=vector, outputCol=target).fit(df).transform(df)


def fourier_features(df: DataFrame, date: str, yearly: int = 3, weekly: int = 2) -> DataFrame:
    out = {}
    for name, n, base in (("yearly", yearly, F.dayofyear(date) / 365.25), ("weekly", weekly, F.dayofweek(date) / 7.0)):
        for k in range(1, n + 1):
            out |= {f"{name}_sin_{k}": F.sin(base * (2 * math.pi * k)), f"{name}_cos_{k}": F.cos(base * (2 * math.pi * k))}
    return df.withColumns(out)


def holiday_features(df: DataFrame, date: str, calendar: DataFrame, day: str = "day", name: str = "name") -> DataFrame:
    """Is it a holiday, which, and the signed days to the nearest one (positive: ahead; equal distances: the one ahead).
    The distinct dates meet the calendar, not the rows."""
    dates = df.select(F.col(date).cast("date").alias("_d")).distinct()
    gap = F.datediff(F.col(day), F.col("_d"))
    near = dates.crossJoin(F.broadcast(calendar.select(day, name))).groupBy("_d").agg(F.min(F.struct(F.abs(gap).alias("a"), (-gap).alias("s"), F.col(name).alias("n"))).alias("_h"))
    out = df.withColumn("_d", F.col(date).cast("date")).join(near, "_d", "left")
    return out.select(*df.columns, (F.coalesce(F.col("_h.a") == 0, F.lit(False))).alias("is_holiday"), F.when(F.col("_h.a") == 0, F.col("_h.n")).alias("holiday_name"), (-F.col("_h.s")).alias("days_to_holiday"))


def materialize_features(table: DataFrame | None, batch: DataFrame, path: str, keys: list[str], columns: list[str], feature_ts: str = "feature_ts") -> DataFrame:
    """A feature table with a batch taken in, written to ``path`` and read back: the newest row for each key, whether it
    comes from ``table`` (None at first) or from the batch, so batches may come late or twice."""
    kept = [*keys, feature_ts, *columns]
    both = batch.select(*kept) if table is None else table.select(*kept).unionByName(batch.select(*kept))
    latest_per_key(both, keys, feature_ts).select(*kept).write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.parquet(path)


def read_features(entities: DataFrame, features: DataFrame, keys: list[str], columns: list[str], ts: str | None = None, feature_ts: str = "feature_ts") -> DataFrame:
    """Features of entities: the newest, or those as of each entity row's time."""
    if ts:
        return asof_join(entities, features, keys, ts, feature_ts, columns)
    return entities.join(latest_per_key(features, keys, feature_ts).select(*keys, *columns), keys, "left")


def online_snapshot(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """``(key, value)``: ``feature:<key>`` and the newest row as JSON, for a key-value store."""
    newest = latest_per_key(df.select(key, ts, *columns), [key], ts)
    return newest.select(F.concat(F.lit("feature:"), F.col(key).cast("string")).alias("key"), F.to_json(F.struct(*columns)).alias("value"))
