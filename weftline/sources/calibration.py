"""The calibrator as a versioned object on the shared file system."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import percent_score, sigmoid
from .records import read_json_object, write_object

# What an artifact states of its kind.
VERSION, METHOD = "platt-logistic-v1", "positive-scale-platt"


def _number(value, name: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return float(value)


@dataclass(frozen=True)
class Calibrator:
    """Scale (above zero, so that order is kept) and bias of a logistic map of the logits of one version of the scorer."""

    scale: float
    bias: float
    scorer_version: str
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if _number(self.scale, "scale") <= 0:
            raise ValueError("scale must be above zero")
        _number(self.bias, "bias")
        if not str(self.scorer_version).strip():
            raise ValueError("scorer_version is missing")

    def probability(self, logit: Column) -> Column:
        return sigmoid(logit * F.lit(float(self.scale)) + F.lit(float(self.bias)))

    def score(self, logit: Column) -> Column:
        return percent_score(self.probability(logit))

    def artifact(self) -> dict:
        return {"calibration_version": VERSION, "method": METHOD, "scorer_version": self.scorer_version, "scale": self.scale, "bias": self.bias, "metadata": dict(self.metadata)}

    @staticmethod
    def of(artifact: dict) -> Calibrator:
        missing = [k for k in ("calibration_version", "method", "scorer_version", "scale", "bias") if k not in artifact]
        if missing:
            raise ValueError(f"the artifact lacks {', '.join(missing)}")
        if (artifact["calibration_version"], artifact["method"]) != (VERSION, METHOD):
            raise ValueError("an artifact of another version or method")
        if not isinstance(artifact.get("metadata", {}), dict):
            raise ValueError("metadata must be an object")
        return Calibrator(artifact["scale"], artifact["bias"], str(artifact["scorer_version"]).strip(), artifact.get("metadata", {}))


def save(spark: SparkSession, calibrator: Calibrator, path: str) -> None:
    write_object(spark, calibrator.artifact(), path)


def load(spark: SparkSession, path: str) -> Calibrator:
    return Calibrator.of(read_json_object(spark, path))
