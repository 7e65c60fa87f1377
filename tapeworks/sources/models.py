"""Small models and results as text: JSON or Parquet of parameters, never pickles."""

from __future__ import annotations

import json
from dataclasses import asdict, fields, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _plain(x):
    if is_dataclass(x):
        return {"__class__": type(x).__name__, **{f.name: _plain(getattr(x, f.name)) for f in fields(x)}}
    if isinstance(x, np.ndarray):
        return x.tolist()
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def to_json(model) -> str:
    """A detector's model as JSON."""
    return json.dumps(_plain(model))


def from_json(text: str):
    """The model that ``to_json`` wrote."""
    from ..functions.regimes import Config, Model

    x = json.loads(text)
    if x.pop("__class__") != "Model":
        raise ValueError("not a regime model")
    cfg = Config(**{k: v for k, v in x.pop("cfg").items() if k != "__class__"})
    return Model(**{k: v if k == "names" else np.array(v) for k, v in x.items()}, cfg=cfg)


def save_models(models: DataFrame, path: str, version: int) -> None:
    """Models (symbol, rows, model) as a version of a table; versions aren't changed once written."""
    models.write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_models(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Models of a version, the newest unless one is named."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.selectExpr("max(version) AS v").first()["v"]
    return stored.where(stored["version"] == version).drop("version")


def save_spark_model(model, path: str) -> None:
    """A fitted ``pyspark.ml`` model in its own format."""
    model.write().overwrite().save(path)


def parameters(model) -> dict:
    return asdict(model) if is_dataclass(model) else dict(model)
