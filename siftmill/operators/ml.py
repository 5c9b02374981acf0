"""Quality classifiers: rule features, training, prediction, threshold search."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.scores import lookup, ratio
from siftmill.operators.metrics import best_threshold, f1_of

RULE_FEATURES = ["pattern_length", "special_chars", "groups", "fp_rate", "tp_rate", "fix_rate", "severity_code"]
SEVERITY_CODE = {"CRITICAL": 3, "HIGH": 2, "SUGGEST": 1, "INFO": 0}
GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def rule_features(rules: DataFrame) -> DataFrame:
    """Seven numbers per rule: shape of its pattern, its rates and its severity."""
    p = F.col("pattern")
    fixes = F.col("fix_success") + F.col("fix_failure")
    one = F.lit(1).cast("long")
    return rules.select(
        "*", F.length(p).alias("pattern_length"), F.regexp_count(p, F.lit(r"[.*+?\[\]{}()|\\^$]")).alias("special_chars"), F.regexp_count(p, F.lit(r"\(")).alias("groups"),
        (F.col("false_positives") / F.greatest("total_hits", one)).alias("fp_rate"), (F.col("true_positives") / F.greatest("total_hits", one)).alias("tp_rate"),
        (F.col("fix_success") / F.greatest(fixes, one)).alias("fix_rate"), lookup(SEVERITY_CODE, F.col("severity"), F.lit(2)).alias("severity_code"),
    )


def split_by_hash(rows: DataFrame, key: Column, train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """A split that does not depend on partitioning, so a retried task keeps its side."""
    part = F.pmod(F.xxhash64(key), F.lit(10))
    return rows.filter(part < train_tenths), rows.filter(part >= train_tenths)


def train_forest(rows: DataFrame, features: list[str], label: str, trees: int = 100, depth: int = 10, min_rows: int = 5, seed: int = 42) -> PipelineModel:
    """Random forest over the feature columns; trees are grown level by level over all partitions."""
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    forest = RandomForestClassifier(
        featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed, subsamplingRate=1.0
    )
    return Pipeline(stages=[assembler, forest]).fit(rows)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with ``quality``: the probability of the positive class."""
    out = model.transform(rows)
    return out.withColumn("quality", F.get(vector_to_array("probability"), F.lit(1))).drop("features", "rawPrediction", "probability")


def evaluation(predictions: DataFrame, label: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of the predictions in one pass."""
    yes, said = F.col(label) == 1, F.col("prediction") == 1
    out = predictions.agg(
        F.count("*").alias("samples"), F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(yes & ~said).alias("fn"), F.count_if(~yes & ~said).alias("tn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        "samples", ratio(tp + F.col("tn"), F.col("samples")).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1_of(tp, fp, fn).alias("f1")
    )


def best_probability_threshold(predictions: DataFrame, label: str) -> DataFrame:
    rows = predictions.select(F.col("quality"), (F.col(label) == 1).alias("truth"))
    return best_threshold(rows, "quality", "truth", GRID, default=0.5, min_rows=1)
