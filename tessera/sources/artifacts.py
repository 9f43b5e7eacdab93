"""Artifacts in and out: fitted schemas, selectors, predictions, parameters, model tags."""

from __future__ import annotations

import dataclasses
import enum
import json
import os
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where it is unset
    on one machine (a local master, as in tests) a temporary folder, once a session; on a
    cluster that would be another folder on each machine, so it is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder and read back: what follows may use it many times
    without its plan being repeated, and a lost executor costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Schema:
    """What is fitted on training data: gene statistics (gene_id, gene_idx, mu, sigma) and
    category codes (feature, category, code), with the switches of preprocessing."""

    stats: DataFrame
    codes: DataFrame
    use_log: bool = False
    use_zscore: bool = True
    target_sum: float = 1e4

    def switches(self) -> dict:
        return {"use_log": self.use_log, "use_zscore": self.use_zscore, "target_sum": self.target_sum}


def save_schema(schema: Schema, path: str) -> None:
    schema.stats.write.mode("overwrite").parquet(f"{path}/stats")
    schema.codes.write.mode("overwrite").parquet(f"{path}/codes")
    spark = schema.stats.sparkSession
    spark.createDataFrame([(json.dumps(schema.switches()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/switches")


def load_schema(spark: SparkSession, path: str) -> Schema:
    switches = json.loads(spark.read.text(f"{path}/switches").first()["value"])
    return Schema(spark.read.parquet(f"{path}/stats"), spark.read.parquet(f"{path}/codes"), **switches)


def selector(spark: SparkSession, path: str, key: str = "cell_id") -> DataFrame:
    """Row keys from a text file, one integer a line; blank lines are skipped, an empty file
    selects nothing, anything else is an error when rows are read."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.trim("value").cast("long").alias(key))


def predictions_table(cells: DataFrame, predictions: DataFrame, model_type: str) -> DataFrame:
    """Cells with ``<model>_prediction``, matched by key and never by position."""
    return cells.join(predictions.select("cell_id", F.col("p").alias(f"{model_type}_prediction")), "cell_id")


def results_table(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    rest = [c for c in scored.columns if c not in ("cell_id", "y", "p")]
    return scored.select("cell_id", F.col("y").alias("y_true"), F.col("p").alias("y_pred_prob"), (F.col("p") > threshold).cast("int").alias("y_pred"), *rest)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def check_predictions(cells: DataFrame, predictions: DataFrame) -> None:
    """ValueError unless there are predictions, all in [0, 1] and one for each cell."""
    got = predictions.agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).first()
    if not got["n"] or got["lo"] is None or got["lo"] < 0 or got["hi"] > 1:
        raise ValueError("predictions must be non-empty and lie in [0, 1]")
    if cells.count() != got["n"]:
        raise ValueError("there must be one prediction for each cell")


def plain(value):
    """A value for JSON: enums by value, dataclasses as dicts, recursively."""
    if isinstance(value, enum.Enum):
        return value.value
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        return {k: plain(v) for k, v in dataclasses.asdict(value).items()}
    if isinstance(value, dict):
        return {str(plain(k)): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def save_params(params, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(params), f, indent=2, sort_keys=True)


def load_params(kind: type, path: str, **overrides):
    """Parameters of a dataclass from JSON (a file, or a folder with ``parameters.json``);
    unknown fields are a ValueError."""
    if os.path.isdir(path):
        path = os.path.join(path, "parameters.json")
    with open(path, encoding="utf-8") as f:
        values = json.load(f) | overrides
    unknown = set(values) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return kind(**values)


def write_model_type(folder: str, model_type: str) -> None:
    with open(os.path.join(folder, "model_type.txt"), "w", encoding="utf-8") as f:
        f.write(model_type)


def read_model_type(folder: str) -> str:
    """The tag of a model folder, without quotes and spaces; its lack is explained."""
    path = os.path.join(folder, "model_type.txt")
    if not os.path.exists(path):
        raise FileNotFoundError(f"{folder} has no model_type.txt, so the kind of model is unknown")
    with open(path, encoding="utf-8") as f:
        tag = re.sub("[\"']", "", f.read()).strip().lower()
    if not tag:
        raise ValueError(f"{path} is empty")
    return tag


def versioned(path: str) -> str:
    """The path itself if it is missing or empty, else the next free ``<path>_v_<n>``."""
    if not os.path.exists(path) or not os.listdir(path):
        return path
    folder, name = os.path.split(path.rstrip("/"))
    taken = [int(m[1]) for x in os.listdir(folder or ".") if (m := re.fullmatch(re.escape(name) + r"_v_(\d+)", x))]
    return f"{path.rstrip('/')}_v_{max(taken, default=0) + 1}"
