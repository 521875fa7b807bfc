"""The acceptance model: boosted trees on the auction features, with Spark ML."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabinlift import schema as S
from cabinlift.operators import encode, evaluate, features, forest, hot, ranks
from cabinlift.operators.stages import AuctionFeatures, ModelInputs, TargetRates, plain
from cabinlift.sources.shared import written

# Categorical features that are encoded by the rate of their label: those whose
# values grow with the data. The others are indexed, and a tree needs a
# histogram bin per value, so each must stay below ``max_bins`` values.
TARGET_ENCODED = "flight_number"
EVAL_METRIC = "AUC"


@dataclass(frozen=True)
class Params:
    """Fit parameters and their defaults."""

    iterations: int = 200
    depth: int = 8
    learning_rate: float = 0.1
    max_bins: int = 128
    seed: int = 42
    target_encoded: str = TARGET_ENCODED  # names with commas between


def training_table(
    df: DataFrame, test_from: str, keep: list[str] = ["id"], heavy_rows: int = hot.HEAVY_ROWS
) -> DataFrame:
    """Features, ``label`` and ``split`` of every offer.

    The split looks at a column of the auction key, so the group features are
    the same whether they are computed before or after it.
    """
    labelled = features.with_label(features.multiplier_defaults(df))
    built = features.model_features(labelled, [*keep, "label"], heavy_rows)
    return features.with_split(built, test_from)


def balance_weights(table: DataFrame) -> dict[int, float]:
    """Weight per label from the training rows (two rows reach the driver)."""
    train = table.filter(F.col("split") == "train")
    return {row["label"]: row["class_weight"] for row in features.class_weights(train).collect()}


def _weight(weights: dict[int, float]) -> Column:
    return F.when(F.col("label") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0))


@dataclass(frozen=True)
class Fitted:
    """One fit: ``full`` has every iteration, ``model`` those up to the best one.

    Both take plain offers. ``curve`` is the validation AUC after each iteration.
    """

    model: PipelineModel
    full: PipelineModel
    best_iteration: int
    curve: DataFrame


def fit(table: DataFrame, params: Params = Params(), keep_best: bool = True) -> Fitted:
    """Fit on the training part, once; the test part picks the number of iterations.

    ``table`` comes from ``training_table``, best written out first: the
    encoders and the trees each read it. All iterations run. With ``keep_best``
    the model keeps the trees up to the first iteration with the highest
    validation AUC; it is cut from the fitted trees, not fitted again.

    Categories named in ``target_encoded`` become rates of their label: a
    training row gets the rate of the rows before it in a hash order, so it never
    sees its own label; other rows get the rate over the training part.
    """
    spark = table.sparkSession
    inputs = ModelInputs()
    train = inputs.transform(table.filter(F.col("split") == "train"))
    wide = [name for name in S.CATEGORICAL_FEATURES if name in params.target_encoded.split(",")]
    narrow = [plain(name) for name in S.CATEGORICAL_FEATURES if name not in wide]
    indexer = StringIndexer(
        inputCols=narrow, outputCols=[f"{name}_index" for name in narrow], handleInvalid="keep"
    ).fit(train)
    # What the trees read and the place in the order, without the columns that both come from.
    places = {f"_place_{i}": place for i, place in enumerate(_order(train, params.seed))}
    encoders, ready = [], train.withColumns(places).select("label", *map(plain, S.MODEL_FEATURES), *places)
    for name in map(plain, wide):
        rates = written(encode.target_rates(train, name), "rates")
        encoders.append(TargetRates.of(rates, name, f"{name}_rate"))
        ready = encode.ordered_target_rates(ready, name, order=list(places), out=f"{name}_rate")
    encoded = {name: f"{name}_index" for name in narrow} | {plain(name): f"{plain(name)}_rate" for name in wide}
    assembler = VectorAssembler(
        inputCols=[encoded.get(name, name) for name in map(plain, S.MODEL_FEATURES)], outputCol="features")
    weights = balance_weights(table)
    ready = assembler.transform(indexer.transform(ready)).select(
        "features", F.col("label").cast("double").alias("label"), _weight(weights).alias("weight"))
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", maxIter=params.iterations,
        maxDepth=params.depth, stepSize=params.learning_rate, maxBins=params.max_bins,
        seed=params.seed,
    ).fit(ready)
    before = [AuctionFeatures(), inputs, indexer, *encoders, assembler]
    full = PipelineModel([*before, trees])
    curve = written(auc_curve(full, table), "auc_curve")
    best = _best_iteration(curve) if keep_best else None
    if best is None or best == params.iterations:
        return Fitted(full, full, params.iterations, curve)
    return Fitted(PipelineModel([*before, forest.first_trees(spark, trees, best)]), full, best, curve)


def _order(train: DataFrame, seed: int) -> list[Column]:
    """The order in which training rows are seen: a hash of their inputs."""
    return [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in train.columns if c != "label"])]


def _best_iteration(curve: DataFrame) -> int | None:
    """First iteration with the highest validation AUC; None if there is no AUC."""
    top = curve.filter(F.col("roc_auc").isNotNull()).orderBy(F.desc("roc_auc"), "iteration").first()
    return top["iteration"] if top else None


def trees_of(model: PipelineModel) -> GBTClassificationModel:
    return model.stages[-1]


def on_features(model: PipelineModel) -> PipelineModel:
    """The model without its first step, for tables whose features are built already."""
    return PipelineModel(model.stages[1:])


def score_offers(model: PipelineModel, offers: DataFrame, threshold: float = evaluate.THRESHOLD) -> DataFrame:
    """Plain offers with ``score`` and ``prediction``; an auction should be given whole.

    Offers without a complete auction key are not scored and drop out.
    """
    rated = model.transform(offers).withColumn("score", vector_to_array("probability")[1])
    carried = [c for c in offers.columns if c in rated.columns]
    return evaluate.with_prediction(rated.select(*[F.col(f"`{c}`") for c in carried], "score"), threshold)


def score(model: PipelineModel, table: DataFrame, threshold: float = evaluate.THRESHOLD) -> DataFrame:
    """``id``, ``label``, ``split``, acceptance ``score`` and ``prediction`` per row of a training table."""
    rated = on_features(model).transform(table).withColumn("score", vector_to_array("probability")[1])
    carried = [name for name in ("id", "label", "split") if name in table.columns]
    return evaluate.with_prediction(rated.select(*carried, "score"), threshold)


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    """(feature, importance), ascending. Impurity gain, normalised to sum 1."""
    values = trees_of(model).featureImportances.toArray()
    return sorted(zip(S.MODEL_FEATURES, map(float, values)), key=lambda pair: (pair[1], pair[0]))


def importance_table(model: PipelineModel, spark) -> DataFrame:
    return spark.createDataFrame(importances(model), "feature string, importance double")


def change_importances(model: PipelineModel, table: DataFrame) -> list[tuple[str, float]]:
    """(feature, importance), ascending: by how much each feature changes the prediction on ``table``.

    In per cent. Rows are routed to the leaves and counted there; the counts,
    one per leaf, and the nodes of the model reach the driver.
    """
    spark = table.sparkSession
    counts = forest.leaf_rows(trees_of(model), _assembled(model, table)).collect()
    weights = {(row["tree"], row["leaf"]): row["weight"] for row in counts}
    change = forest.prediction_change(forest.trees_of(spark, trees_of(model)), weights, len(S.MODEL_FEATURES))
    return sorted(zip(S.MODEL_FEATURES, map(float, change)), key=lambda pair: (pair[1], pair[0]))


def change_importance_table(model: PipelineModel, table: DataFrame) -> DataFrame:
    return table.sparkSession.createDataFrame(change_importances(model, table), "feature string, importance double")


def _assembled(model: PipelineModel, table: DataFrame) -> DataFrame:
    return PipelineModel(model.stages[1:-1]).transform(table)


def loss_curve(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Class-balanced loss after each iteration on both parts (one number each)."""
    ready = _assembled(model, table).select(
        "features", "split", _weight(balance_weights(table)).alias("weight"),
        F.col("label").cast("double").alias("label"),
    )
    rows = []
    for part in ("train", "test"):
        losses = trees_of(model).evaluateEachIteration(ready.filter(F.col("split") == part))
        rows += [(part, i + 1, float(loss)) for i, loss in enumerate(losses)]
    return table.sparkSession.createDataFrame(rows, "split string, iteration int, loss double")


def validation_margins(model: PipelineModel, table: DataFrame) -> DataFrame:
    """label and margins of the test rows: the margin after 1, 2, ... iterations."""
    rated = _assembled(model, table.filter(F.col("split") == "test"))
    carried = [name for name in ("id", "label") if name in table.columns]
    return forest.with_margins(trees_of(model), rated).select(*carried, "margins")


def auc_curve(model: PipelineModel, table: DataFrame) -> DataFrame:
    """Validation AUC after each iteration, from one routing of the test rows, which is written: it is read three times."""
    margins = written(validation_margins(model, table).select("label", "margins"), "margins")
    return ranks.auc_per_score(margins, "margins")


def run_summary(table: DataFrame, params: Params) -> DataFrame:
    """One row describing a run: features, part sizes, metric and parameters."""
    sizes = table.agg(
        F.count(F.when(F.col("split") == "train", 1)).alias("train_rows"),
        F.count(F.when(F.col("split") == "test", 1)).alias("test_rows"),
    )
    return sizes.select(
        F.lit(len(S.MODEL_FEATURES)).alias("n_features"),
        F.lit(",".join(S.MODEL_FEATURES)).alias("features"),
        F.lit(",".join(S.CATEGORICAL_FEATURES)).alias("categorical_features"),
        "train_rows", "test_rows", F.lit(EVAL_METRIC).alias("eval_metric"),
        *[F.lit(value).alias(name) for name, value in asdict(params).items()],
    )


def parse_params(options: dict[str, str | None]) -> Params:
    """Parameters from text options; absent ones keep their defaults."""
    kinds = {field.name: type(field.default) for field in fields(Params)}
    return Params(**{
        name: kind(options[name]) for name, kind in kinds.items() if options.get(name) is not None
    })
