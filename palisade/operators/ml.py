"""Learned scores: logistic regression over text features, TF-IDF as an option, isolation forest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import staged
from ..functions.fixed import TRAINING
from ..functions.text import feature_names, text_features
from .evaluate import confusion
from .ranges import numbered
from .windows import blocked


def with_features(df: DataFrame, text_col: str, raw: bool = False) -> DataFrame:
    """Adds the 33 text features as columns."""
    return df.select("*", *text_features(F.coalesce(F.col(text_col), F.lit("")), raw))


def training_samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRAINING), "text string, label int")


def standardization(features: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each feature (deviation 1 where it is 0)."""
    names = feature_names()
    row = features.agg(*(F.avg(f"`{n}`").alias(f"m_{n}") for n in names), *(F.stddev_pop(f"`{n}`").alias(f"s_{n}") for n in names)).first()
    return {n: (row[f"m_{n}"] or 0.0, row[f"s_{n}"] or 1.0) for n in names}


def standardized(features: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return features.withColumn("features", array_to_vector(F.array(*((F.col(f"`{n}`") - m) / s for n, (m, s) in scale.items()))))


class TextModel:
    """Logistic regression (L2, C = 1) over standardised text features."""

    def __init__(self, scale: dict[str, tuple[float, float]], model: PipelineModel):
        self.scale, self.model = scale, model

    @classmethod
    def fit(cls, samples: DataFrame, text_col: str = "text", label_col: str = "label", c: float = 1.0) -> TextModel:
        return cls.fit_features(with_features(samples, text_col), label_col, c)

    @classmethod
    def fit_features(cls, features: DataFrame, label_col: str = "label", c: float = 1.0) -> TextModel:
        """As ``fit``, of rows with their features; they are read several times."""
        scale = standardization(features)
        n = features.count()
        lr = LogisticRegression(featuresCol="features", labelCol=label_col, regParam=1 / (n * c), standardization=False, maxIter=1000)
        return cls(scale, Pipeline(stages=[lr]).fit(standardized(features, scale)))

    def score(self, df: DataFrame, text_col: str) -> DataFrame:
        """Adds ml_score, the probability of class 1."""
        return self.score_features(with_features(df, text_col), df.columns)

    def score_features(self, features: DataFrame, kept: list[str]) -> DataFrame:
        scored = self.model.transform(standardized(features, self.scale))
        return scored.select(*kept, vector_to_array("probability")[1].alias("ml_score"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(n, m, s) for n, (m, s) in self.scale.items()], "name string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(f"{path}/scale")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        scale = {r.name: (r.mean, r.std) for r in spark.read.parquet(f"{path}/scale").collect()}  # a row for each feature
        return cls({n: scale[n] for n in feature_names()}, PipelineModel.load(f"{path}/model"))


def training_report(scored: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: samples, accuracy and support-weighted precision, recall and F1 of ``ml_score`` above one half."""
    c = confusion(scored, F.col(label_col) == 1, F.col("ml_score") > 0.5)
    samples = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    accuracy = F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), samples), F.lit(0.0))
    return c.select(samples.alias("samples"), accuracy.alias("accuracy"), "precision", "recall", "f1")


def cross_validated(samples: DataFrame, folds: int = 5, text_col: str = "text", label_col: str = "label", seed: int = 42) -> DataFrame:
    """fold and training_report of a model fitted on the other folds; folds are dealt by a hash of the text.

    A fold whose other folds hold a single label, or that is empty, is left out.
    """
    spark = samples.sparkSession
    folded = samples.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.pmod(F.xxhash64(text_col, F.lit(seed)), F.lit(folds)).alias("fold"))
    featured = staged(with_features(folded, "text").drop("text"), "features")  # each text is looked at once, whatever the folds
    reports = []
    for fold in range(folds):  # a fit for each fold
        rest, mine = featured.where(F.col("fold") != fold), featured.where(F.col("fold") == fold)
        if rest.agg(F.count_distinct("label")).first()[0] > 1:
            report = training_report(TextModel.fit_features(rest).score_features(mine, ["label"])).where("samples > 0")
            reports.append(report.select(F.lit(fold).alias("fold"), "*"))
    none = spark.createDataFrame([], "fold int, samples long, accuracy double, precision double, recall double, f1 double")
    return reduce(DataFrame.unionByName, reports, none)


def refitted(labelled: DataFrame, batch: DataFrame, path: str) -> TextModel:
    """For foreachBatch: adds the batch's (text, label) to the table at ``path`` and fits on base samples and table.

    A batch that comes again adds nothing new: the table is read without repeated rows.
    """
    batch.select("text", "label").write.mode("append").parquet(path)
    seen = batch.sparkSession.read.schema("text string, label int").parquet(path)
    return TextModel.fit(labelled.select("text", "label").union(seen).distinct())


def tfidf_pipeline(text_col: str = "text", vocabulary: int = 1000) -> Pipeline:
    """TF-IDF of 1- to 3-grams without English stop words."""
    token = RegexTokenizer(inputCol=text_col, outputCol="tokens", pattern=r"\W+")
    stop = StopWordsRemover(inputCol="tokens", outputCol="words")
    grams = [NGram(n=n, inputCol="words", outputCol=f"grams{n}") for n in (1, 2, 3)]
    joined = SQLTransformer(statement="SELECT *, concat(grams1, grams2, grams3) AS grams FROM __THIS__")
    return Pipeline(stages=[token, stop, *grams, joined, CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="tfidf"), VectorAssembler(inputCols=["tfidf"], outputCol="tfidf_features")])


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    if depth == 0 or len(x) <= 1 or not (x.max(axis=0) > x.min(axis=0)).any():
        return (len(x),)
    f = int(rng.choice(np.flatnonzero(x.max(axis=0) > x.min(axis=0))))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth - 1), _grow(x[~left], rng, depth - 1)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _depths(node: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(node) == 1:
        return np.full(len(x), depth + _average_path(node[0]))
    out = np.empty(len(x))
    left = x[:, node[0]] < node[1]
    out[left] = _depths(node[2], x[left], depth + 1)
    out[~left] = _depths(node[3], x[~left], depth + 1)
    return out


def isolation_scores(df: DataFrame, columns: list[str], order: str, sample: int = 4096, trees: int = 100, per_tree: int = 256, seed: int = 42) -> DataFrame:
    """Adds anomaly_score (0 to 1, about 0.5 for usual rows; null if a column is).

    The forest (Liu, Ting and Zhou 2008) is fitted on a bounded sample, the
    ``sample`` rows with the smallest hash of column ``order``; all rows are
    scored in Arrow batches.
    """
    known = df.select(*columns, order).dropna()
    rows = known.orderBy(F.xxhash64(order), order).limit(sample).select(*columns).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(per_tree, len(rows))
    forest = [_grow(rows[rng.choice(len(rows), size, replace=False)], rng, int(np.ceil(np.log2(max(size, 2))))) for _ in range(trees)] if len(rows) else []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[columns].to_numpy(float)
            score = np.full(len(x), np.nan)
            fine = ~np.isnan(x).any(axis=1)
            if forest and fine.any():
                mean = np.mean([_depths(t, x[fine]) for t in forest], axis=0)
                score[fine] = 2 ** (-mean / max(_average_path(size), 1e-9))
            yield part.assign(anomaly_score=pd.Series(score, index=part.index).astype(object).where(~np.isnan(score), None))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", anomaly_score double"
    return df.mapInPandas(run, schema)


def joined_depths(past: np.ndarray, points: np.ndarray, rng: np.random.Generator, trees: int, size: int, depth: int) -> np.ndarray:
    """Mean depth of each point in ``trees`` isolation trees of ``size`` rows of the past, had each been grown with the point.

    All trees grow together, a level at a time.  Outside the box of a node's rows a
    cut may isolate the point there, with the share of the span that lies between;
    what is expected adds up along the way.
    """
    width = past.shape[1]
    draw = rng.random((trees, len(past)))
    rows = past[np.argpartition(draw, size - 1, axis=1)[:, :size]].reshape(-1, width)  # those of the least draws; their order tells nothing
    tree = np.repeat(np.arange(trees), size)
    node = np.zeros(len(rows), np.int64)
    place = np.zeros((trees, len(points)), np.int64)
    total, left_over, going = np.zeros(place.shape), np.ones(place.shape), np.ones(place.shape, bool)
    usual = np.array([_average_path(n + 1) for n in range(size + 1)])
    for level in range(depth + 1):
        number = tree * (1 << level) + node
        order = np.argsort(number.astype(np.int16) if trees << level <= 1 << 15 else number, kind="stable")  # short numbers are sorted by digits
        starts = np.flatnonzero(np.diff(number[order], prepend=-1))
        held = number[order][starts]
        low, high, count = (np.zeros((width, trees << level)), np.zeros((width, trees << level)), np.zeros(trees << level, np.int64))
        low[:, held], high[:, held] = np.minimum.reduceat(rows[order], starts, axis=0).T, np.maximum.reduceat(rows[order], starts, axis=0).T
        count[held] = np.diff(starts, append=len(order))
        uneven = (high > low).T
        leaf = (count <= 1) | ~uneven.any(axis=1) | (level == depth)
        at = np.arange(trees)[:, None] * (1 << level) + place
        alone, spans = np.zeros(place.shape), np.zeros(place.shape, np.int64)
        for x, bottom, top in zip(points.T.copy(), low, high, strict=True):  # a feature at a time: its arrays stay in the cache
            bottom, top = bottom.take(at), top.take(at)
            beyond = np.maximum(bottom - x, 0) + np.maximum(x - top, 0)
            span = beyond + (top - bottom)
            alone += beyond / np.where(span > 0, span, 1)
            spans += span > 0
        alone /= np.maximum(spans, 1)
        total += np.where(going, left_over * alone * (level + 1), 0)
        left_over = np.where(going, left_over * (1 - alone), left_over)
        ends = going & leaf[at]
        total += np.where(ends, left_over * (level + usual[count[at]]), 0)
        going &= ~ends
        feature = np.where(uneven, rng.random(uneven.shape), -1).argmax(axis=1)
        each = np.arange(trees << level)
        cut = low[feature, each] + rng.random(trees << level) * (high - low)[feature, each]
        cut = np.where(cut < high[feature, each], cut, low[feature, each])  # neither side is empty
        kept = ~leaf[number]
        if not kept.any():
            break
        rows, tree, node, number = rows[kept], tree[kept], node[kept], number[kept]
        node = 2 * node + (rows[np.arange(len(rows)), feature[number]] > cut[number])
        beside = points[np.arange(len(points))[None, :], feature[at]] > cut[at]
        place = np.where(going, 2 * place + beside, 0)
    return total.mean(axis=0)


def causal_scores(x: np.ndarray, offset: int, first: int, history: int, least: int, step: int, trees: int, per_tree: int, seed: int, neutral: float = 0.5) -> np.ndarray:
    """Scores of a key's rows from number ``first`` on; ``x`` has the rows from number ``offset`` on (numbers from 0).

    A row is judged by the ``history`` rows before the last refit at or before it.
    A score is the distance of 2 ** (-depth / usual depth) from ``neutral``.
    """
    stop = offset + len(x)
    close = [least << i for i in range(max(0, (step - 1) // least).bit_length())]  # while the history is short
    marks = sorted({m for m in (*close, *range(step * (first // step), stop, step)) if least <= m < stop})
    out = np.zeros(stop - first)
    for mark, then in zip(marks, [*marks[1:], stop], strict=False):
        rows = np.arange(max(mark, first), then)
        past = x[max(0, mark - history - offset) : mark - offset]
        if len(rows):
            rng = np.random.default_rng([seed, mark])
            size = min(per_tree, len(past))
            depth = int(np.ceil(np.log2(max(size, 2))))
            mean = joined_depths(past, x[rows - offset], rng, trees, size, depth)
            out[rows - first] = np.abs(2 ** (-mean / max(_average_path(size), 1e-9)) - neutral)
    return out


def session_anomalies(df: DataFrame, key: str, ts_us: str, order: str, columns: list[str], history: int = 1000, least: int = 10, step: int = 100, trees: int = 50, per_tree: int = 64, seed: int = 42, parts: int | None = None, neutral: float = 0.5) -> DataFrame:
    """Adds anomaly_score: how far a row is from what its key did before, by an isolation forest of the key.

    A row is judged by rows before it only: the forest of the ``history`` rows up to
    the last refit, which comes every ``step`` rows of the key (and after ``least``, twice and
    four times as many, until the first ``step``), as if it had been grown with the row.  Later rows change no score.  Before ``least`` rows, or with a null
    key, time or column, the score is 0.  Otherwise it is 2 ** (-depth / usual depth) -
    1/2 as an absolute value (0 to 1/2), the distance from the forest's neutral score;
    with 0 as ``neutral`` the forest's score itself (0 to 1, about 1/2 for usual rows).

    Rows are numbered within their key over sorted ranges; a block of ``history``
    numbers, with the block before as its past, is one group: a hot key is many.
    """
    usable = F.col(key).isNotNull() & F.col(ts_us).isNotNull()
    for c in columns:
        usable = usable & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    marked = df.withColumn("_fine", usable)
    rows = numbered(marked.where("_fine").drop("_fine"), [key], [ts_us, order], "_n", parts)
    xs = [f"_x{i}" for i in range(len(columns))]
    slim = rows.select(F.col(key).alias("_key"), (F.col("_n") - 1).alias("_p"), *(F.col(c).cast("double").alias(x) for x, c in zip(xs, columns, strict=True)))
    kind = dict(slim.dtypes)["_key"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_p")
        own = part["_own"].to_numpy(bool)
        out = part.loc[own, ["_key", "_p"]]
        if not len(out):
            return out.assign(anomaly_score=0.0)
        score = causal_scores(part[xs].to_numpy(float), int(part["_p"].iloc[0]), int(out["_p"].iloc[0]), history, least, step, trees, per_tree, seed, neutral)
        return out.assign(anomaly_score=score)

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups are heavy for their bytes: not to be coalesced by size
    scored = blocked(slim, "_p", history).repartition(tasks, "_key", "_block").groupBy("_key", "_block").applyInPandas(run, f"_key {kind}, _p long, anomaly_score double")
    same = F.col("r._key").eqNullSafe(F.col("s._key")) & (F.col("r._p") == F.col("s._p"))
    joined = rows.withColumns({"_key": F.col(key), "_p": F.col("_n") - 1}).alias("r").join(scored.alias("s"), same)
    out = joined.select(*(F.col(f"r.`{c}`") for c in df.columns), "s.anomaly_score")
    return out.unionByName(marked.where("not _fine").drop("_fine").withColumn("anomaly_score", F.lit(0.0)))
