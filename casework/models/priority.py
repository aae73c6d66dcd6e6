"""Priority regressor K16, K17."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.functions.risk import clipped
from casework.models import boosting
from casework.models.features import PRIORITY_FEATURES, priority_features, priority_target
from casework.models.split import SEED, holdout
from casework.models.stored import read_facts, read_part, write_facts
from casework.operators.metrics import regression
from casework.session import cut_lineage


@dataclass
class PriorityModel:
    model: boosting.Boosted | PipelineModel
    mae: float
    r2: float

    def score(self, cases: DataFrame, as_of) -> DataFrame:
        """Whole priority 0..100 beside the input columns, which stay as filed whatever the features fill in."""
        inputs = [c for c in cases.columns if c in PRIORITY_FEATURES]
        filed = {c: f"__filed_{c}" for c in inputs}
        rows = self.model.transform(priority_features(cases.withColumns({f: F.col(c) for c, f in filed.items()}), as_of))
        kept = [F.col(filed.get(c, c)).alias(c) for c in cases.columns if c != "priority_score"]
        return rows.select(*kept, clipped(F.bround("prediction", 0)).alias("priority_score"))

    def save(self, spark: SparkSession, path: str) -> None:
        write_facts(spark, {"mae": self.mae, "r2": self.r2, "model": self.model.facts()}, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PriorityModel:
        """Also of models that were stored as a Spark ML pipeline."""
        facts = read_facts(spark, path)
        model = boosting.Boosted(**facts.pop("model")) if "model" in facts else read_part("PipelineModel", f"{path}/model")
        return cls(model, **facts)


def train(cases: DataFrame, as_of, rounds: int = 300) -> PriorityModel:
    """Fitted and scored on all rows."""
    rows = priority_features(cases, as_of).withColumn("label", priority_target())
    fit_rows, test_rows = holdout(cut_lineage(rows.select("id", "label", *PRIORITY_FEATURES)))
    model = boosting.fit(fit_rows, PRIORITY_FEATURES, rounds, depth=4, step=0.06, share=0.9, seed=SEED)
    quality = regression(model.transform(test_rows), "label", "prediction").first()
    return PriorityModel(model, quality["mae"], quality["r2"])
