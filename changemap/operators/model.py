"""Classifiers on feature columns: fit, score, importance, out-of-bag error."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changemap import params as P
from changemap.functions.names import split_name
from changemap.operators import forest

_FOREST = {"numTrees": 50, "minInstancesPerNode": 3}
# the names of the study's settings
_SETTINGS = {"numTrees": "trees", "minInstancesPerNode": "min_leaf", "maxLeaves": "max_leaves", "maxDepth": "max_depth", "featureSubsetStrategy": "mtry"}


@dataclass
class VectorForest:
    """A forest of ``operators.forest`` on the vectors of ``features``, with the ``fit`` and ``transform`` of the ML
    library's classifiers. That library's own forest has no leaf limit and is built on the driver, whose
    memory then grows with the rows."""

    settings: forest.Settings
    label: str = "label"
    fitted: forest.Forest | None = None

    def fit(self, df: DataFrame) -> VectorForest:
        x = vector_to_array("features")
        size = df.select(F.size(x)).first()
        if size is None:
            raise ValueError("no rows to train on")
        names = [f"x{i}" for i in range(size[0])]
        key = F.xxhash64(*[x if c == "features" else F.col(c) for c in df.columns])
        rows = df.select(key.alias("_key"), F.col(self.label).alias("_y"), x.alias("_x"))
        rows = rows.select("_key", "_y", *[F.col("_x")[i].alias(n) for i, n in enumerate(names)])
        return replace(self, fitted=forest.fit(rows, names, self.settings, "_y", row_key=["_key"]))

    def transform(self, df: DataFrame) -> DataFrame:
        x = df.withColumn("_x", vector_to_array("features"))
        values = F.struct(*[F.col("_x")[i].alias(n) for i, n in enumerate(self.fitted.features)])
        p = x.withColumn("_p", self.fitted.probability(values))
        return p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p")))).drop("_x", "_p")


def classifier(name: str = "random_forest", seed: int = 0, label: str = "label", **args):
    """Untrained classifier by name; unknown names raise."""
    common = {"featuresCol": "features", "labelCol": label}
    if name == "random_forest":
        return VectorForest(forest_settings(seed, **{**_FOREST, **args}), label)
    if name == "svm":
        return LinearSVC(**common, **args)
    if name == "gradient_trees":
        return GBTClassifier(**common, seed=seed, **args)
    raise NotImplementedError(f"model {name!r} is not implemented")


def balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Rows with weight ``n / (classes * n_class)``."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy()  # one row per class
    w = F.sum("_n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("_n"))
    # one row a class, so a row never travels to the task of its class
    return df.join(F.broadcast(per.select(label, w.alias(out))), label)


def forest_settings(seed: int = 0, **args) -> forest.Settings:
    """Settings of a forest from the study's names; unknown names raise."""
    unknown = set(args) - set(_SETTINGS)
    if unknown:
        raise ValueError(f"unknown forest settings: {sorted(unknown)}")
    return forest.Settings(seed=seed, **{_SETTINGS[k]: v for k, v in args.items()})


def fit(
    train: DataFrame,
    features: Sequence[str],
    name: str = "random_forest",
    seed: int = 0,
    label: str = "label",
    balanced: bool = False,
    weight: str | None = None,
    row_key: Sequence[str] | None = None,
    start: forest.Forest | None = None,
    **args,
) -> PipelineModel | forest.Forest:
    """Train on the chosen columns; rows with a missing feature are left out. ``start`` is a smaller
    forest of the same rows and settings to grow on."""
    data = train.na.drop(subset=list(features))
    key = list(row_key or train.columns)
    if balanced:
        data, weight = balanced_weights(data, label, "_w"), "_w"
    if name == "random_forest":
        return forest.fit(data, features, forest_settings(seed, **args), label, weight, key, start=start)
    clf = classifier(name, seed, label, **args)
    if weight:
        clf = clf.setWeightCol(weight)
    keep = [*features, label] + ([weight] if weight else [])
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), clf]).fit(
        data.select(*[F.col(c).cast("double").alias(c) for c in keep])
    )


def load_or_fit(path: str, train: DataFrame, features: Sequence[str], force: bool = False, **kw) -> PipelineModel | forest.Forest:
    """The saved model at ``path``, or a new one trained and saved there."""
    spark = train.sparkSession
    is_forest = kw.get("name", "random_forest") == "random_forest"
    if not force:
        try:
            return forest.Forest.load(spark, path) if is_forest else PipelineModel.load(path)
        except Exception as e:  # nothing saved yet
            if "Input path does not exist" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                raise
    model = fit(train, features, **kw)
    if is_forest:
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    return model


def score(model: PipelineModel | forest.Forest, df: DataFrame, out: str = "prob") -> DataFrame:
    """Probability of class 1; a margin classifier gives the logistic of its margin."""
    if isinstance(model, forest.Forest):
        return model.transform(df, out)
    scored = model.transform(df)
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    made = {"features", "rawPrediction", "probability", "prediction"} - set(df.columns)
    return scored.withColumn(out, p).drop(*made)


def score_or_null(model: PipelineModel | forest.Forest, df: DataFrame, features: Sequence[str], out: str = "prob") -> DataFrame:
    """Every row with its probability, null where a feature is missing.

    Raises when a feature column does not exist.  No join: a forest votes on all rows in one pass and
    the votes on incomplete ones are dropped; for other models those rows are set aside before scoring
    and put back with a null.
    """
    from changemap.operators.predict import complete_or_null

    ok = complete_or_null(df, features)
    if isinstance(model, forest.Forest):
        return score(model, df, out).withColumn(out, F.when(ok, F.col(out)))
    done = score(model, df.where(ok), out)
    rest = df.where(~ok).withColumn(out, F.lit(None).cast("double"))
    return done.unionByName(rest)


def importance(model: PipelineModel | forest.Forest, features: Sequence[str], spark) -> DataFrame:
    """Rank, feature, importance (6 digits) and the parts of the name."""
    values = model.importances() if isinstance(model, forest.Forest) else model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(features, values)), "feature string, importance double")
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return df.select(
        F.row_number().over(w).alias("rank"), "feature", F.round("importance", 6).alias("importance"),
        *[c.alias(k) for k, c in split_name("feature").items()],
    )


def importance_rollup(table: DataFrame) -> DataFrame:
    """Importance summed by period, by band and by reducer: ``dimension, name, total``."""
    dims = ["period", "band", "reducer"]
    sums = table.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(F.sum("importance").alias("total"))
    which = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    return sums.select(which.alias("dimension"), F.coalesce(*dims).alias("name"), "total").orderBy("dimension", F.desc("total"))


def top_features(table: DataFrame, n: int = 10, lowest: bool = False) -> DataFrame:
    return table.orderBy(F.desc("rank") if lowest else F.asc("rank")).limit(n)


# --- out-of-bag error -------------------------------------------------------------


def bootstrap_weight(row_key: Sequence[str], tree: int, seed: int = 0) -> Column:
    """How often a row is drawn for a tree: Poisson(1) from a hash of its key, so
    the same row gets the same draw on every run and executor."""
    return forest.poisson(F.lit(seed), F.lit(tree), *[F.col(c) for c in row_key]).cast("double")


def _for_oob(train: DataFrame, features: Sequence[str], row_key: Sequence[str], n_trees: int, label: str, seed: int):
    """Binned rows with their draws; their draws also tell which trees never saw a row."""
    full = train.na.drop(subset=list(features))
    ends = forest.edges(full, features)
    return forest.binned(full, features, ends, label, forest.draws(n_trees, row_key, seed)), ends


def oob_curve(
    train: DataFrame,
    features: Sequence[str],
    row_key: Sequence[str],
    n_trees: int = P.OOB_COUNTS[-1],
    label: str = "label",
    seed: int = 0,
    subset: str = "sqrt",
    counts: Sequence[int] | None = None,
    **args,
) -> DataFrame:
    """``n_trees, oob_error`` for 1..n trees, or for ``counts`` of them.

    One forest is grown, all trees together; its first n trees are the forest of n. A row is
    judged by those of them that never saw it, in one pass for all n.
    """
    rows, ends = _for_oob(train, features, row_key, n_trees, label, seed)
    settings = forest_settings(seed, **{**args, "numTrees": n_trees, "featureSubsetStrategy": subset})
    curve = forest.oob_errors(rows, next(forest.fit_binned(rows, features, ends, [settings])))
    return curve.where(F.col("n_trees").isin(*counts)) if counts else curve


def oob_elbow(curve: DataFrame, epsilon: float = P.OOB_EPSILON) -> DataFrame:
    """The first tree count after which the error improves by less than ``epsilon``;
    the last one when it keeps improving."""
    w = Window.orderBy("n_trees")  # one row per tree count
    nxt = curve.select("n_trees", "oob_error", (F.col("oob_error") - F.lead("oob_error").over(w)).alias("gain"))
    pick = nxt.agg(
        F.coalesce(F.min(F.when(F.col("gain") < epsilon, F.col("n_trees"))), F.max("n_trees")).alias("n_trees")
    )
    return pick.join(curve, "n_trees")


def oob_by_mtry(
    train: DataFrame, features: Sequence[str], row_key: Sequence[str], values: Sequence[int] = P.MTRY_VALUES,
    n_trees: int = 50, label: str = "label", seed: int = 0, **args,
) -> DataFrame:
    """``mtry, oob_error`` at ``n_trees`` for each number of features tried per cut.

    The forests of all values grow together on one set of binned rows and draws.
    """
    rows, ends = _for_oob(train, features, row_key, n_trees, label, seed)
    several = [forest_settings(seed, **{**args, "numTrees": n_trees, "featureSubsetStrategy": m}) for m in values]
    out = None
    for m, grown in zip(values, forest.fit_binned(rows, features, ends, several)):
        one = forest.oob_errors(rows, grown).where(F.col("n_trees") == n_trees).select(F.lit(m).alias("mtry"), "oob_error")
        out = one if out is None else out.unionByName(one)
    return out
