"""Four random forests: churn, lifetime value, purchase frequency, segment."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custspark.functions.churn import churn_label
from custspark.operators.encoding import MAX_IN_MEMORY, CategoryEncoding, ClassLabels, encode_segment, fit_encoding_and_segments
from custspark.operators.evaluate import accuracy, as_rows, mean_absolute_error, r2
from custspark.operators.features import assemble, with_features
from custspark.operators.scaling import Standardizer, fit_vector_standardizer
from custspark.operators.split import SEED, is_train
from custspark.schema import CUSTOMER_SCHEMA, FEATURES, KEY
from custspark.session import materialise

# Features that give the purchase frequency away when it is the label.
FREQUENCY_TARGET_FEATURES = ["purchase_frequency", "frequency_score"]

# Bounds on the rows of one training task, and the tasks of a table that needs no more.
# Every task of a forest's fit sends the statistics of all open nodes, so there should
# be few. The number follows the rows alone: a forest's samples depend on it, and must
# not depend on the cluster.
MIN_ROWS_PER_TASK = 1_000
MAX_ROWS_PER_TASK = 1_000_000
USUAL_TASKS = 8

# Up to this size per task, keeping each row's node in every tree beats finding it again.
NODE_ID_BYTES_PER_TASK = 32 * 1024 * 1024

TRAINING_COLUMNS = [c for c in CUSTOMER_SCHEMA.names if c != "registration_date"]
LABELS = ["churn_label", "customer_lifetime_value", "purchase_frequency", "segment_label"]


@dataclass(frozen=True)
class ForestParams:
    """Forest size and the settings that decide speed and memory at scale."""

    trees: int = 100
    depth: int = 10
    seed: int = SEED
    feature_subset: str = "auto"  # the classifiers' features per split
    regression_subset: str = "auto"  # the regressors'
    max_bins: int = 32
    max_memory_mb: int = 256
    cache_node_ids: bool | None = None  # None: if they are small; the models are the same either way
    bootstrap: bool = True  # False: every tree sees every training row once

    def as_arguments(self, rows_per_task: int, regression: bool = False) -> dict:
        node_ids = rows_per_task * self.trees * 4
        cached = node_ids <= NODE_ID_BYTES_PER_TASK if self.cache_node_ids is None else self.cache_node_ids
        return {
            "numTrees": self.trees,
            "maxDepth": self.depth,
            "seed": self.seed,
            "featureSubsetStrategy": self.regression_subset if regression else self.feature_subset,
            "maxBins": self.max_bins,
            "maxMemoryInMB": self.max_memory_mb,
            "cacheNodeIds": cached,
            "bootstrap": self.bootstrap,
        }


# The two forest sizes in use. The smaller one's regressors see all features at each split.
# Both keep each row's node in every tree, whatever the rows: finding it again from the root at each level costs more
# CPU time even where what is kept goes to disk. A task's share is bounded by MAX_ROWS_PER_TASK: 400 MB of 100 trees.
LARGE_FORESTS = ForestParams(trees=100, depth=10, cache_node_ids=True)
SMALL_FORESTS = ForestParams(trees=50, depth=8, feature_subset="sqrt", regression_subset="all", cache_node_ids=True)


@dataclass(frozen=True)
class CustomerModels:
    """All fitted state of one training run."""

    encoding: CategoryEncoding
    scaler: Standardizer
    segment_labels: ClassLabels
    frequency_features: list[str]
    params: ForestParams
    churn: RandomForestClassificationModel
    clv: RandomForestRegressionModel
    frequency: RandomForestRegressionModel
    segment: RandomForestClassificationModel

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.encoding.save(f"{path}/encoding", spark)
        self.scaler.save(f"{path}/scaler", spark)
        listed = isinstance(self.segment_labels, list)
        if not listed:
            self.segment_labels.write.mode("overwrite").parquet(f"{path}/segment_labels")
        facts = {
            "segment_labels": self.segment_labels if listed else None,
            "frequency_features": self.frequency_features,
            "params": asdict(self.params),
        }
        spark.createDataFrame([(json.dumps(facts),)], "value string").write.mode("overwrite").text(f"{path}/facts")
        for name in ("churn", "clv", "frequency", "segment"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> CustomerModels:
        spark = SparkSession.active()
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        labels = facts["segment_labels"]
        return cls(
            encoding=CategoryEncoding.load(f"{path}/encoding", spark),
            scaler=Standardizer.load(f"{path}/scaler", spark),
            segment_labels=spark.read.parquet(f"{path}/segment_labels") if labels is None else labels,
            frequency_features=facts["frequency_features"],
            params=ForestParams(**facts["params"]),
            churn=RandomForestClassificationModel.load(f"{path}/churn"),
            clv=RandomForestRegressionModel.load(f"{path}/clv"),
            frequency=RandomForestRegressionModel.load(f"{path}/frequency"),
            segment=RandomForestClassificationModel.load(f"{path}/segment"),
        )

    def predict(self, df: DataFrame) -> DataFrame:
        """Add all four predictions to rows with a ``features`` vector, in one plan."""
        df = with_model_vectors(df, self.scaler, self.frequency_features)
        for model in (self.churn, self.clv, self.frequency, self.segment):
            df = model.transform(df)
        return df.drop("scaled_features", "frequency_vector")


def with_model_vectors(df: DataFrame, scaler: Standardizer, frequency_features: list[str]) -> DataFrame:
    """Add the standardised vector and the frequency model's vector."""
    slicer = VectorSlicer(
        inputCol="features",
        outputCol="frequency_vector",
        indices=[FEATURES.index(c) for c in frequency_features],
    )
    return slicer.transform(scaler.transform_vector(df, "features", "scaled_features"))


def task_count(rows: int) -> int:
    """How many tasks the fits have for ``rows`` customers, on any cluster."""
    return max(1, min(USUAL_TASKS, rows // MIN_ROWS_PER_TASK), -(-rows // MAX_ROWS_PER_TASK))


def prepare(
    df: DataFrame, encoding: CategoryEncoding, segment_labels: ClassLabels, tasks: int, handle_invalid: str
) -> DataFrame:
    """The training table: key, vector, the four labels and the side of the split, written once.

    The split is a folder level: a fit reads training rows only. ``deal`` is a digest of
    the row, by which ``dealt`` hands rows to the fits' tasks.
    """
    rows = with_features(df, encoding)
    rows = encode_segment(rows, segment_labels, skip=handle_invalid == "skip").withColumn("churn_label", churn_label(F.col("churn_probability")))
    rows = assemble(rows, handle_invalid=handle_invalid).withColumn("is_train", is_train())
    deal = F.xxhash64(KEY, *FEATURES, *LABELS).alias("deal")
    placed = rows.select(KEY, "features", *LABELS, "is_train", deal).repartition(tasks, "deal")
    return materialise(placed.sortWithinPartitions("is_train", "deal", KEY), "training", partition_by="is_train")


def dealt(table: DataFrame, tasks: int) -> DataFrame:
    """The rows of each task, and their order, from the rows alone.

    A forest's samples are drawn by a row's task and its place there. So both depend on the row's digest, and
    neither on the files that the customers came from nor on how many cores read the training table.
    Rows that are equal in all columns go to one task.
    """
    return table.repartition(tasks, "deal").sortWithinPartitions("deal", KEY)


def _check_labels(table: DataFrame) -> None:
    facts = table.agg(
        F.count_if("is_train").alias("train"),
        F.count_if(~F.col("is_train")).alias("test"),
        F.count_if(F.col("is_train") & (F.col("churn_label") == 1)).alias("churners"),
        *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in LABELS],
    ).first()
    missing = [c for c in LABELS if facts[f"no_{c}"]]
    if missing:
        raise ValueError(f"labels missing in some rows: {', '.join(missing)}")
    if not facts["train"] or not facts["test"]:
        raise ValueError("both training and test rows are needed")
    if facts["churners"] in (0, facts["train"]):
        raise ValueError("the training rows hold only one churn class")


def train(
    df: DataFrame,
    params: ForestParams = LARGE_FORESTS,
    exclude_target_features: bool = False,
    handle_invalid: str = "error",
    parallel_fits: int = 4,
    max_labels_in_memory: int = MAX_IN_MEMORY,
) -> tuple[CustomerModels, DataFrame]:
    """Fit the four models on 80 % of the customers and evaluate them on the rest.

    ``df`` is read three times (rows, labels, training table), so it should be
    a table and not a long plan. Gives the models and a (model, metric,
    value) DataFrame. The fits are independent and each leaves executors idle
    between its stages, so ``parallel_fits`` of them run at a time. Columns beyond the
    customer table's are not looked at.
    """
    spark = df.sparkSession
    df = df.select(*TRAINING_COLUMNS)
    encoding, segment_labels = fit_encoding_and_segments(df, max_in_memory=max_labels_in_memory)
    n_rows = df.count()
    tasks = task_count(n_rows)
    table = prepare(df, encoding, segment_labels, tasks, handle_invalid)
    _check_labels(table)

    training = dealt(table.filter("is_train"), tasks)
    scaler = fit_vector_standardizer(training, "features", FEATURES)
    left_out = FREQUENCY_TARGET_FEATURES if exclude_target_features else []
    frequency_features = [c for c in FEATURES if c not in left_out]
    rows = with_model_vectors(training, scaler, frequency_features)

    size = params.as_arguments(n_rows // tasks)
    regression = params.as_arguments(n_rows // tasks, regression=True)
    estimators = {
        "churn": RandomForestClassifier(
            featuresCol="features",
            labelCol="churn_label",
            predictionCol="will_churn",
            probabilityCol="churn_vector",
            rawPredictionCol="",
            **size,
        ),
        "clv": RandomForestRegressor(
            featuresCol="features", labelCol="customer_lifetime_value", predictionCol="predicted_clv", **regression
        ),
        "frequency": RandomForestRegressor(
            featuresCol="frequency_vector",
            labelCol="purchase_frequency",
            predictionCol="predicted_frequency",
            **regression,
        ),
        "segment": RandomForestClassifier(
            featuresCol="scaled_features",
            labelCol="segment_label",
            predictionCol="predicted_segment_label",
            probabilityCol="",
            rawPredictionCol="",
            **size,
        ),
    }
    fit = inheritable_thread_target(spark)(lambda estimator: estimator.fit(rows))
    with ThreadPoolExecutor(max_workers=parallel_fits) as pool:
        fitted = dict(zip(estimators, pool.map(fit, estimators.values()), strict=True))
    models = CustomerModels(encoding, scaler, segment_labels, frequency_features, params, **fitted)
    return models, evaluate(table.filter(~F.col("is_train")), models)


def evaluate(test: DataFrame, models: CustomerModels) -> DataFrame:
    """All metrics of the four models in one pass over the test rows."""
    predicted = models.predict(test)
    churn, clv = (F.col("churn_label"), F.col("will_churn")), (F.col("customer_lifetime_value"), F.col("predicted_clv"))
    frequency = F.col("purchase_frequency"), F.col("predicted_frequency")
    segment = F.col("segment_label"), F.col("predicted_segment_label")
    return as_rows(
        predicted,
        {
            ("churn", "accuracy"): accuracy(*churn),
            ("clv", "r2"): r2(*clv),
            ("clv", "mae"): mean_absolute_error(*clv),
            ("frequency", "r2"): r2(*frequency),
            ("frequency", "mae"): mean_absolute_error(*frequency),
            ("segment", "accuracy"): accuracy(*segment),
        },
    )
