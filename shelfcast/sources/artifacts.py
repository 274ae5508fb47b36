"""Saved models: pipelines in Spark's own format beside one JSON row of metadata, in versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = "payload string"
POINTER_SCHEMA = "number long, version string"


@dataclass
class ForecastArtifact:
    """What a later session needs to forecast or to report on a trained model.

    ``models`` are fitted on training rows only, ``deployed`` is the champion refitted on
    all rows.
    """

    model_name: str
    feature_names: list[str]
    lags: list[int]
    windows: list[int]
    test_size: int
    residual_sigma: float
    metrics: dict[str, dict[str, float]]
    last_training_date: str
    settings: dict[str, float] = field(default_factory=dict)
    models: Mapping[str, PipelineModel] = field(default_factory=dict)
    deployed: PipelineModel | None = None


def _folder(name: str) -> str:
    return name.lower().replace(" ", "_")


def save_artifact(spark: SparkSession, artifact: ForecastArtifact, path: str) -> None:
    """Write a new version beside earlier ones, then point to it.

    The pointer is a row of its own in a folder that holds one row for each version; the newest number
    counts. It is written last and appended, so a save that fails half way leaves the artifact before
    it, whole and current.
    """
    number = (_current(spark, path) or (0, ""))[0] + 1
    version = f"{number}-{uuid.uuid4().hex}"
    folder = f"{path}/versions/{version}"
    facts = {k: v for k, v in artifact.__dict__.items() if k not in ("models", "deployed")}
    facts["models"] = sorted(artifact.models)
    for name, model in artifact.models.items():
        model.write().save(f"{folder}/models/{_folder(name)}")
    if artifact.deployed is not None:
        artifact.deployed.write().save(f"{folder}/deployed")
    facts["deployed"] = artifact.deployed is not None
    row = spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], METADATA_SCHEMA)
    row.coalesce(1).write.json(f"{folder}/metadata")
    spark.createDataFrame([(number, version)], POINTER_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/current")


def _current(spark: SparkSession, path: str) -> tuple[int, str] | None:
    """Number and folder of the version that counts."""
    try:
        row = spark.read.schema(POINTER_SCHEMA).json(f"{path}/current").orderBy(F.desc("number"), "version").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return (row["number"], row["version"]) if row else None


def load_artifact(spark: SparkSession, path: str) -> ForecastArtifact | None:
    """The artifact saved last; ``None`` if there is none at ``path``."""
    current = _current(spark, path)
    if current is None:
        return None
    folder = f"{path}/versions/{current[1]}"
    facts = json.loads(spark.read.schema(METADATA_SCHEMA).json(f"{folder}/metadata").first()["payload"])
    names, deployed = facts.pop("models"), facts.pop("deployed")
    return ForecastArtifact(
        **facts,
        models={name: PipelineModel.load(f"{folder}/models/{_folder(name)}") for name in names},
        deployed=PipelineModel.load(f"{folder}/deployed") if deployed else None,
    )
