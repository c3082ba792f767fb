"""Files in and out: JSON arrays, JSON lines, CSV, matrices, metric documents and appended answers."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a response file.
RESPONSES = "id string, response string, reasoning_content string"


def read_records(spark: SparkSession, path: str, schema: str = RESPONSES, strict: bool = True) -> DataFrame:
    """A .json array, .jsonl lines, .csv with a header, or parquet, by the path's suffix; another suffix is an error.

    A .json file that holds lines instead of one array is read as lines. With ``strict`` a broken record raises; else it goes
    to ``_corrupt_record``.
    """
    suffix = Path(path).suffix
    mode = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    if suffix == ".parquet":
        return spark.read.parquet(path)
    fields = schema if strict or suffix == ".csv" else schema + ", _corrupt_record string"
    r = spark.read.schema(fields).options(**mode)
    if suffix == ".jsonl":
        return r.json(path)
    if suffix == ".json":
        first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
        lines = bool(first) and first[0][0].lstrip().startswith("{") and first[0][0].rstrip().endswith("}")
        return r.json(path) if lines else r.option("multiLine", True).json(path)
    if suffix == ".csv":
        return r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raise ValueError(f"{path}: .json, .jsonl, .csv or .parquet is expected")


def read_matrix(spark: SparkSession, path: str, rows: int = 8192) -> DataFrame:
    """A .npy matrix as (row, embedding), read in slices from a file that all executors see."""
    shape = np.load(path, mmap_mode="r").shape
    starts = spark.range(0, max(1, shape[0]), rows).repartition(max(1, -(-shape[0] // rows)))

    def load(batches):
        import pandas as pd

        m = np.load(path, mmap_mode="r")
        for b in batches:
            for s in b["id"]:
                part = np.asarray(m[s : s + rows], np.float32)
                yield pd.DataFrame({"row": np.arange(s, s + len(part)), "embedding": list(part)})

    return starts.mapInPandas(load, "row bigint, embedding array<float>")


@dataclasses.dataclass(frozen=True)
class ModelConfig:
    model_id: str
    use_vllm: bool = False
    tensor_parallel_size: int = 1
    model_args: dict = dataclasses.field(default_factory=dict)
    generation_args: dict = dataclasses.field(default_factory=dict)


def read_config(path: str) -> ModelConfig:
    """A model's configuration; only .json is known."""
    if Path(path).suffix != ".json":
        raise NotImplementedError(f"{path}: only .json is known")
    raw = json.loads(Path(path).read_text())
    names = {f.name for f in dataclasses.fields(ModelConfig)}
    if unknown := set(raw) - names:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return ModelConfig(**raw)


def save_name(dataset: str) -> str:
    """File name of a dataset's answers: its name without the first two parts."""
    return "-".join(dataset.split("-")[2:]) + ".json"


#: Rows of a metric document, which is one object on the driver.
MOST_METRICS = 10_000


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file of any file system that Spark knows, over what was there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_metrics(df: DataFrame, path: str, indent: int = 4) -> None:
    """A small metric table as one indented JSON document, over what was there: an object for one row, else an array of them."""
    rows = [json.loads(r) for r in df.limit(MOST_METRICS + 1).toJSON().collect()]
    if len(rows) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} rows are no metric document; use write_lines")
    write_text(df.sparkSession, path, json.dumps(rows[0] if len(rows) == 1 else rows, indent=indent, ensure_ascii=False) + "\n")


def write_lines(df: DataFrame, folder: str) -> None:
    """A table of any size as JSON lines, a file for each task, over what was there; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def write_matrix(df: DataFrame, path: str, vector: str = "embedding", row: str = "row") -> None:
    """Vectors in the order of ``row`` as a .npy matrix; rows stream through the driver, which holds one partition at a time."""
    n = df.count()
    width = len(df.select(vector).first()[0]) if n else 0
    out = np.lib.format.open_memmap(path, "w+", np.float32, (n, width))
    for i, r in enumerate(df.select(row, vector).orderBy(row).toLocalIterator()):
        out[i] = r[1]
    out.flush()


def take_rows(df: DataFrame, indexes: list[int], key: str = "id") -> DataFrame:
    """Rows at the given places (from 0) in the order of ``key``, once for each mention and in the order of the list (column ``place``)."""
    from assize.operators.pairing import with_ordinal

    wanted = df.sparkSession.createDataFrame(list(enumerate(indexes)), "place long, _at long")
    return with_ordinal(df, key, "_at").join(F.broadcast(wanted), "_at").drop("_at")  # a stated list


def append_answers(df: DataFrame, path: str) -> None:
    """Adds answers; the commit of the write takes the place of a lock, and readers take each (id, seed) once."""
    df.write.mode("append").parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.dropDuplicates([c for c in ("id", "seed") if c in df.columns])


def write_version(df: DataFrame, folder: str) -> str:
    """A new version of a table beside the earlier ones, since a table that is read can't be written over; its path."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = [f.getPath().getName() for f in fs.listStatus(hadoop)] if fs.exists(hadoop) else []
    n = 1 + max([int(h[1:]) for h in have if h[:1] == "v" and h[1:].isdigit()], default=0)
    path = f"{folder.rstrip('/')}/v{n:06d}"
    df.write.parquet(path)
    return path


def debug_head(df: DataFrame, key: str = "id", n: int = 10) -> DataFrame:
    """The first rows in the order of the key, for a look at them."""
    return df.orderBy(F.col(key)).limit(n)
