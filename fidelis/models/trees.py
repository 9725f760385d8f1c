"""Trees, forests and boosting on spark.ml, re-weighted by robust weights of their residuals."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel, classification, regression
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, OneVsRest, OneVsRestModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fidelis.functions import one_hot
from fidelis.models import robust
from fidelis.operators.classification import accuracy
from fidelis.operators.lineage import cut
from fidelis.operators.metrics import evaluation
from fidelis.operators.totals import valid

KINDS = ("tree", "forest", "boosting")
#: Bins of a feature, spark.ml's own default.
BINS = 32


@dataclass
class TreeModel:
    """The last round's spark.ml model, the features' bins that it learned from, and the history of rounds."""

    model: object
    features: list[str]
    label: str
    classes: int | None
    history: list[dict] = field(default_factory=list)
    splits: list[list[float]] = field(default_factory=list)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Adds the prediction, and for classifiers the probability of each label."""
        out = _told(self.model, _assembled(df, self.features, self.splits))
        if self.classes is None:
            return out.select(*df.columns, F.col("prediction").alias(name))
        return out.select(*df.columns, F.col("prediction").cast("int").alias(name), _chances(out).alias("probability"))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the spark.ml model and what belongs to it to any path that Spark writes."""
        self.model.write().overwrite().save(f"{path}/model")
        about = {k: getattr(self, k) for k in ("features", "label", "classes", "history", "splits")} | {"model": type(self.model).__name__}
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        name = about.pop("model")
        kind = PipelineModel if name == "PipelineModel" else getattr(classification, name, None) or getattr(regression, name)
        return cls(kind.load(f"{path}/model"), **about)

    def history_frame(self, spark: SparkSession) -> DataFrame:
        """(iteration, loss, entropy) of each round of re-weighting."""
        return spark.createDataFrame([(h["iteration"], float(h["loss"]), float(h["entropy"])) for h in self.history], "iteration int, loss double, entropy double")

    def score(self, df: DataFrame) -> float:
        """Robust R2, or accuracy for classifiers."""
        told = self.predict(df, "_told")
        if self.classes is None:
            return evaluation(told, self.label, "_told").first()["robr2"]
        return accuracy(told.withColumn("_y", F.col(self.label).cast("int")), "_y", "_told").first()["accuracy"]


def _told(model, rows: DataFrame) -> DataFrame:
    """The rows with the model's prediction; one against rest, with the _margins of all labels, in the JVM.

    OneVsRestModel.transform() of Python takes each label's margin through a Python function.
    A forest is a pipeline of trees: its prediction is their mean, or the label of the largest mean chance.
    """
    if isinstance(model, PipelineModel):
        n, out = len(model.stages), model.transform(rows)
        if "_q0" not in out.columns:
            return out.select(*rows.columns, (sum(F.col(f"_p{i}") for i in range(n)) / n).alias("prediction"))
        each = [vector_to_array(f"_q{i}") for i in range(n)]
        chances = F.transform(each[0], lambda x: x / n)
        for other in each[1:]:
            # a tree that drew no row of the last labels has no chance for them
            chances = F.zip_with(chances, other, lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b / n, F.lit(0.0)))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return out.select(*rows.columns, chances.alias("probability")).withColumn("prediction", best)
    if not isinstance(model, OneVsRestModel):
        return model.transform(rows)
    out = rows
    for i, m in enumerate(model.models):
        out = m.transform(out, {m.rawPredictionCol: f"_raw{i}", m.predictionCol: "", m.probabilityCol: ""})
    margins = F.array(*[vector_to_array(f"_raw{i}")[1] for i in range(len(model.models))])
    best = (F.array_position("_margins", F.array_max("_margins")) - 1).cast("double")
    return out.withColumn("_margins", margins).select(*rows.columns, "_margins", best.alias("prediction"))


def _chances(told: DataFrame) -> Column:
    """The labels' probabilities: the model's own, or, one against rest, the margins' chances scaled to a sum of one."""
    if "probability" in told.columns:
        given = isinstance(told.schema["probability"].dataType, ArrayType)
        return F.col("probability") if given else vector_to_array("probability")
    each = F.transform("_margins", lambda margin: 1 / (1 + F.exp(-2 * margin)))
    total = F.aggregate(each, F.lit(0.0), lambda t, x: t + x)
    return F.transform(each, lambda x: x / total)


def _bins(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """Where each feature is cut: between all its values, if they are BINS at most, or else at its quantiles."""
    at = [i / BINS for i in range(1, BINS)]
    named = [(f"_q{i}", f"_d{i}", F.col(f).cast("double")) for i, f in enumerate(features)]
    found = rows.agg(*[c for q, d, x in named for c in (F.percentile_approx(x, at, 10_000).alias(q), F.approx_count_distinct(x).alias(d))]).first()
    splits = []
    for q, d, x in named:
        cuts = sorted(set(found[q] or []))
        if found[d] <= 2 * BINS:
            values = sorted(r[0] for r in rows.select(x.alias("x")).distinct().collect())
            if len(values) <= BINS:
                cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
        splits.append([-math.inf, *(cuts or [0.0]), math.inf])
    return splits


def _binned(df: DataFrame, features: list[str], splits: list[list[float]]) -> DataFrame:
    """Adds _f0, _f1, ...: the numbers of the features' bins."""
    doubles = df.withColumns({f"_v{i}": F.col(f).cast("double") for i, f in enumerate(features)})
    names = [[f"{c}{i}" for i in range(len(features))] for c in ("_v", "_f")]
    out = Bucketizer(splitsArray=splits, inputCols=names[0], outputCols=names[1], handleInvalid="keep").transform(doubles).drop(*names[0])
    # trees would take a bucketizer's column, by its metadata, as categories without an order
    return out.withColumns({f: F.col(f) + F.lit(0.0) for f in names[1]})


def _assembled(df: DataFrame, features: list[str], splits: list[list[float]]) -> DataFrame:
    """Adds _x, the vector of the features' bins, or of the features where `splits` has none."""
    if not splits:
        return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(df)
    return _vectors(_binned(df, features, splits), len(features))


def _vectors(binned: DataFrame, n: int) -> DataFrame:
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(n)], outputCol="_x", handleInvalid="keep").transform(binned)


#: Chances that a Poisson number of mean 1 is at most 0, 1, 2 and so on, as far as doubles tell them from 1.
_AT_MOST = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(17)]


def _drawn(uniform: Column) -> Column:
    """How often a row is drawn for a tree: the Poisson number of mean 1 at a uniform number."""
    out = F.lit(len(_AT_MOST))
    for k, chance in reversed(list(enumerate(_AT_MOST))):
        out = F.when(uniform < chance, k).otherwise(out)
    return out.cast("long")


def _draws(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_d")]


class GnosticTrees:
    """kind: tree, forest or boosting; classes None for regression, else labels 0..classes-1.

    After the first fit, up to max_iter rounds multiply the rows' weights by the robust
    weights of the residuals, scale them to the number of rows and fit again; a change of
    loss under `tolerance` ends them. Boosting of more than two classes is one against rest.

    Trees cut features at the ends of BINS bins at most. Rows alike in their bins and label
    are therefore counted once, and all rounds run on these rows and counts, however many rows
    there are. Trees and boosting of numbers learn from the mean label of rows alike in their
    bins, which has the same gains and leaves. A forest's trees take all features and draw
    rows: each row is drawn a Poisson number of times for each tree while rows are counted,
    and a tree runs on the sums of its draws in place of the counts. All rounds share the draws.
    """

    def __init__(self, features: list[str], label: str, kind: str = "tree", classes: int | None = None, trees: int = 20, depth: int = 5, max_iter: int = 3, tolerance: float = 1e-4, seed: int = 0, step: float = 0.3, **settings):
        if kind not in KINDS or trees < 1 or max_iter < 0:
            raise ValueError(f"kind of {KINDS}, trees >= 1 and max_iter >= 0 are needed")
        self.features, self.label, self.kind, self.classes = list(features), label, kind, classes
        self.trees, self.depth, self.rounds, self.seed, self.step = trees, depth, max_iter, seed, step
        self.settings = robust.Settings(tolerance=tolerance, **settings)

    def _estimator(self):
        common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": "_w", "maxDepth": self.depth, "seed": self.seed}
        if self.kind in ("tree", "forest"):
            return DecisionTreeRegressor(**common) if self.classes is None else DecisionTreeClassifier(**common)
        common |= {"maxIter": self.trees, "stepSize": self.step}
        if self.classes is None:
            return GBTRegressor(**common)
        if self.classes == 2:
            return GBTClassifier(**common)
        return OneVsRest(classifier=GBTClassifier(**common), featuresCol="_x", labelCol="_y", weightCol="_w")

    def _error(self, told: DataFrame) -> Column:
        if self.classes is None:
            return F.col("prediction") - F.col("_y")
        truth = one_hot(F.col("_y").cast("int"), self.classes)
        return F.sqrt(F.aggregate(F.zip_with(_chances(told), truth, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x))

    def _fitted(self, rows: DataFrame):
        """The model of `rows` (_f0, ..., _y, _c, _w), each of which stands for _c rows of weight _w; a forest's have _d0, ..., the draws."""
        bins, draws = [f"_f{i}" for i in range(len(self.features))], _draws(rows)
        each, numbers = rows, self.classes is None
        if numbers:
            named = [(c, F.col("_w") * F.col(c)) for c in draws or ["_c"]]
            each = rows.groupBy(*bins).agg(*[s for c, w in named for s in (F.sum(w).alias(f"_w{c}"), F.sum(F.col("_y") * w).alias(f"_t{c}"))])
        each, models = _vectors(cut(each) if numbers and draws else each, len(bins)), []
        for c in draws or ["_c"]:
            weight = F.col(f"_w{c}") if numbers else F.col("_w") * F.col(c)
            label = F.try_divide(F.col(f"_t{c}"), weight) if numbers else F.col("_y")
            own = each.select("_x", label.alias("_y"), weight.alias("_w"))
            models.append(self._estimator().fit(own.filter("_w > 0") if numbers or draws else own))
        if not draws:
            return models[0]
        for i, model in enumerate(models):
            model.setPredictionCol(f"_p{i}")
            if not numbers:
                model.setProbabilityCol(f"_q{i}").setRawPredictionCol("")
        return PipelineModel(models)

    def fit(self, df: DataFrame) -> TreeModel:
        known, bins = valid(df, self.label, *self.features), [f"_f{i}" for i in range(len(self.features))]
        splits = _bins(known, self.features)
        draws = [f"_d{i}" for i in range(self.trees)] if self.kind == "forest" and self.trees > 1 else []
        binned = _binned(known, self.features, splits).select(*bins, F.col(self.label).cast("double").alias("_y"))
        binned = binned.withColumns({d: F.rand(self.seed + i) for i, d in enumerate(draws)})
        alike = binned.groupBy(*bins, "_y").agg(F.count("*").alias("_c"), *[F.sum(_drawn(F.col(d))).alias(d) for d in draws])
        rows = cut(alike.withColumn("_w", F.lit(1.0)))
        sums = rows.agg(F.sum("_c").alias("_c"), *[F.sum(d).alias(d) for d in draws]).first()
        n, history = sums["_c"], []
        # of very few rows a tree may draw none: it takes each of them once
        rows = rows.withColumns({d: F.col("_c") for d in draws if not sums[d]})
        model = self._fitted(rows)
        for i in range(1, self.rounds + 1):
            told = _told(model, _vectors(rows, len(bins)))
            scored = cut(told.select(*bins, "_y", "_c", "_w", *draws, F.col("prediction").alias("_fit"), self._error(told).alias("_e")))
            low_high = robust.bounds(scored, e=F.col("_e"), y=F.col("_y"), fit=F.col("_fit"))
            form = self.settings.form
            z = robust.to_z(F.col("_e"), low_high["e"], form)
            own, scale = robust.robust_weight(scored, z, "_c")
            if self.classes is None:
                ratio = robust.safe_ratio(robust.to_z(F.col("_fit"), low_high["fit"], form), robust.to_z(F.col("_y"), low_high["y"], form))
            else:
                ratio = z  # against a residual of zero, which is 1 in the normalised domain
            loss, entropy, total = robust.criterion(scored, ratio, scale, self.settings.loss, F.col("_w") * own, "_c")
            history.append({"iteration": i, "loss": loss, "entropy": entropy})
            if len(history) > 2 and abs(history[-2]["loss"] - loss) < self.settings.tolerance:
                break
            weight = F.col("_w") * own * F.lit(n / total) if total else F.lit(1.0)
            rows = cut(scored.select(*bins, "_y", "_c", *draws, weight.alias("_w")))
            model = self._fitted(rows)
        return TreeModel(model, self.features, self.label, self.classes, history, splits)
