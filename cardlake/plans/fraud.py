"""Fraud model: indexing, assembly, gradient-boosted trees, scoring and evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardlake.operators.indexing import category_index, index_sizes
from cardlake.operators.joins import FRAUD_VALUES, feature_base, flag_labels
from cardlake.operators.sampling import balanced_sample, train_test_split
from cardlake.session import ensure_checkpoint_dir, stored

CATEGORICAL = ["merchant_state", "card_brand", "card_type", "has_chip", "description"]
NUMERIC = ["amount_usd", "credit_limit_usd"]
INDEXED = [f"{name}_idx" for name in CATEGORICAL]
FEATURES = NUMERIC + INDEXED

MAX_BINS = 200
# Least parts of the training rows, and rows of a part beyond them.
PARTS, ROWS_PER_PART = 16, 200_000


def parts_for(n_rows: int) -> int:
    """Parts of so many training rows: a number that follows from the rows, not from files or cores."""
    return max(PARTS, -(-n_rows // ROWS_PER_PART))


def fit_indexers(df: DataFrame, columns: list[str] = CATEGORICAL, max_bins: int = MAX_BINS, rare: str = "error") -> PipelineModel:
    """Indexes by falling frequency, then by text; unseen and missing values get the next free index.

    Trees need all values of a column at once, at most ``max_bins`` with that index. A column with more fails with the
    number that it needs; with ``rare="fold"`` its rarest values share the index of unseen ones.
    """
    if rare not in ("error", "fold"):
        raise ValueError(f"rare must be 'error' or 'fold', not {rare!r}")
    index = stored(category_index(df, columns), "index")
    needed, column = max(((index_size + 1, name) for name, index_size in index_sizes(index).items()), default=(0, ""))
    if needed > max_bins and rare == "error":
        raise ValueError(f"{column} needs {needed} bins, and max_bins is {max_bins}")
    # At most max_bins - 1 values of each column.
    kept = index.where(index["idx"] < max_bins - 1).orderBy("name", "idx").collect()
    labels = {name: [row["value"] for row in kept if row["name"] == name] for name in columns}
    return PipelineModel([StringIndexerModel.from_labels(labels[name], name, f"{name}_idx", "keep") for name in columns])


def assembler(handle_invalid: str = "error") -> VectorAssembler:
    """Feature vectors; a missing number fails the job, or leaves out the row with ``skip``."""
    return VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid=handle_invalid)


def missing_features(df: DataFrame) -> DataFrame:
    """Rows that ``skip`` would leave out, per missing number."""
    return df.agg(
        *[F.count_if(F.col(name).isNull()).alias(f"n_without_{name}") for name in NUMERIC],
        F.count("*").alias("n_rows"),
    )


def training_rows(
    transactions: DataFrame,
    labels: DataFrame,
    cards: DataFrame,
    mcc_codes: DataFrame,
    fraud_values: tuple[str, ...] = FRAUD_VALUES,
    seed: int = 42,
    keep_one_in: int = 10,
) -> DataFrame:
    """The balanced sample with its features.

    Whether a row is in the sample depends on its label and id only, so the labels are sampled
    and all later joins are a tenth as large.
    """
    sampled = balanced_sample(flag_labels(labels, fraud_values), keep_one_in=keep_one_in, seed=seed)
    base = feature_base(transactions, sampled, cards, mcc_codes)
    return base.select("id", "fraud_label", *NUMERIC, *CATEGORICAL)


def arranged(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """The rows in ``parts`` parts by hash of the id, each sorted by all columns.

    Trees depend on which rows lie together and in which order; so they depend on the rows and on
    ``parts`` only, not on files or cores.
    """
    keys = ["id"] if "id" in rows.columns else rows.columns
    return rows.repartition(parts, *keys).sortWithinPartitions(*rows.columns)


def prepare_training(
    transactions: DataFrame,
    labels: DataFrame,
    cards: DataFrame,
    mcc_codes: DataFrame,
    fraud_values: tuple[str, ...] = FRAUD_VALUES,
    seed: int = 42,
    keep_one_in: int = 10,
    train_percent: int = 80,
) -> tuple[DataFrame, DataFrame]:
    """Train and test part of the balanced sample.

    The sample is written to shared storage: the many passes of the training read it from there
    instead of repeating the joins, and it outlives lost executors.
    """
    rows = training_rows(transactions, labels, cards, mcc_codes, fraud_values, seed, keep_one_in)
    return train_test_split(stored(rows, "training"), train_percent=train_percent, seed=seed)


def train(
    training: DataFrame,
    max_iter: int = 30,
    max_bins: int = MAX_BINS,
    seed: int = 42,
    handle_invalid: str = "error",
    parts: int | None = None,
    rare: str = "error",
) -> PipelineModel:
    """Fit indexers, assembler and boosted trees. The model depends on the rows and the arguments only.

    Without ``parts`` their number follows from the number of rows. ``training_of`` tells rows and parts of a model.
    """
    n_rows = training.count()
    if not n_rows:
        raise ValueError("the training set is empty; check the labels and the sample")
    # With a checkpoint folder the boosting cuts its lineage every few rounds.
    ensure_checkpoint_dir(training.sparkSession)
    parts = parts or parts_for(n_rows)
    rows = arranged(training, parts)
    indexers = fit_indexers(training, CATEGORICAL, max_bins, rare)
    classifier = GBTClassifier(
        labelCol="fraud_label",
        featuresCol="features",
        maxIter=max_iter,
        maxBins=max_bins,
        seed=seed,
    )
    model = Pipeline(stages=[indexers, assembler(handle_invalid), classifier]).fit(rows)
    model.training = {"rows": n_rows, "parts": parts}
    return model


def check_inputs(rows: DataFrame) -> DataFrame:
    """The rows, if they have all columns that the model reads."""
    missing = [name for name in NUMERIC + CATEGORICAL if name not in rows.columns]
    if missing:
        raise ValueError(f"columns that the model needs are missing: {missing}")
    return rows


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``probability``, and the probability of fraud as a number."""
    scored = model.transform(rows)
    return scored.withColumn("fraud_probability", vector_to_array("probability")[1])


def area_under_roc(scored: DataFrame, score_column: str = "rawPrediction", label_column: str = "fraud_label") -> float:
    """Exact area under the ROC curve: every distinct score is a threshold, ties count half."""
    return BinaryClassificationEvaluator(
        rawPredictionCol=score_column, labelCol=label_column, metricName="areaUnderROC", numBins=0
    ).evaluate(scored)


def training_of(model: PipelineModel) -> dict[str, int]:
    """Rows and parts that the model was trained on; a rerun with these parts gives the same trees."""
    return dict(getattr(model, "training", {}))


def _training_path(path: str) -> str:
    return f"{path.rstrip('/')}/training"


def save(model: PipelineModel, path: str) -> None:
    """Store the model, and beside its stages what it was trained on."""
    model.write().overwrite().save(path)
    known = training_of(model)
    if known:
        spark = SparkSession.active()
        spark.createDataFrame([(known["rows"], known["parts"])], "rows bigint, parts int").coalesce(1).write.json(_training_path(path))


def load(path: str) -> PipelineModel:
    model = PipelineModel.load(path)
    spark = SparkSession.active()
    notes = spark._jvm.org.apache.hadoop.fs.Path(_training_path(path))
    if notes.getFileSystem(spark._jsc.hadoopConfiguration()).exists(notes):
        model.training = spark.read.schema("rows bigint, parts int").json(_training_path(path)).first().asDict()
    return model
