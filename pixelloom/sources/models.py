"""A store of fitted models: versions in a folder, each a table of parameters, a description, and tables or pipelines that a model holds.

A version is written beside the others under a name of its own and takes its number by a rename, so readers see whole versions only and two
writers never share one. Nothing is pickled: a model is described field by field, its arrays are rows (name, shape, numbers), and only
classes of this package are made again."""

from __future__ import annotations

import dataclasses
import importlib
import json
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

ARRAYS = "name string, kind string, shape array<long>, numbers array<double>"
PACKAGE = __name__.partition(".")[0]


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class _Writer:
    def __init__(self):
        self.arrays: list[tuple] = []
        self.tables: dict[str, DataFrame] = {}
        self.pipelines: dict[str, Any] = {}

    def encode(self, x: Any) -> Any:
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        if isinstance(x, np.generic):
            return x.item()
        if isinstance(x, np.ndarray):
            if x.dtype.kind not in "bif":
                raise TypeError(f"arrays of {x.dtype} can't be stored")
            self.arrays.append((f"a{len(self.arrays)}", x.dtype.str, list(x.shape), x.astype(float).ravel().tolist()))
            return {"$array": self.arrays[-1][0]}
        if isinstance(x, DataFrame):
            self.tables[f"t{len(self.tables)}"] = x
            return {"$table": f"t{len(self.tables) - 1}"}
        if hasattr(x, "write") and hasattr(x, "transform"):  # a fitted model of Spark's own
            self.pipelines[f"p{len(self.pipelines)}"] = x
            return {"$spark": f"p{len(self.pipelines) - 1}", "class": f"{type(x).__module__}:{type(x).__name__}"}
        if isinstance(x, (list, tuple)):
            return {"$list": [self.encode(v) for v in x], "tuple": isinstance(x, tuple)}
        if isinstance(x, dict):
            return {"$dict": [[self.encode(k), self.encode(v)] for k, v in x.items()]}
        kind = type(x)
        if kind.__module__.partition(".")[0] == PACKAGE:
            fields = [f.name for f in dataclasses.fields(x)] if dataclasses.is_dataclass(x) else list(vars(x))
            return {"$class": f"{kind.__module__}:{kind.__name__}", "fields": {f: self.encode(getattr(x, f)) for f in fields}}
        raise TypeError(f"{kind.__name__} can't be stored")


class _Reader:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.arrays = {r["name"]: np.array(r["numbers"], float).reshape(r["shape"]).astype(r["kind"]) for r in spark.read.schema(ARRAYS).parquet(f"{folder}/arrays").collect()}

    def decode(self, x: Any) -> Any:
        if not isinstance(x, dict):
            return x
        if "$array" in x:
            return self.arrays[x["$array"]]
        if "$table" in x:
            return self.spark.read.parquet(f"{self.folder}/{x['$table']}")
        if "$spark" in x:
            return self._class(x["class"], "pyspark").load(f"{self.folder}/{x['$spark']}")
        if "$list" in x:
            out = [self.decode(v) for v in x["$list"]]
            return tuple(out) if x["tuple"] else out
        if "$dict" in x:
            return {self.decode(k): self.decode(v) for k, v in x["$dict"]}
        made = object.__new__(self._class(x["$class"], PACKAGE))
        for f, v in x["fields"].items():
            object.__setattr__(made, f, self.decode(v))
        return made

    @staticmethod
    def _class(name: str, package: str) -> type:
        module, _, kind = name.partition(":")
        if module.partition(".")[0] != package:
            raise ValueError(f"{name} is not a class of {package}")
        return getattr(importlib.import_module(module), kind)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions, in order."""
    files, p = _files(spark, path)
    if not files.exists(p):
        return []
    names = [s.getPath().getName() for s in files.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())


def save(spark: SparkSession, model: Any, path: str) -> int:
    """Store a model as the next version of a folder; its number."""
    w = _Writer()
    described = w.encode(model)
    folder = f"{path.rstrip('/')}/.new-{uuid.uuid4().hex}"
    spark.createDataFrame(w.arrays, ARRAYS).coalesce(1).write.parquet(f"{folder}/arrays")
    for name, table in w.tables.items():
        table.write.parquet(f"{folder}/{name}")
    for name, pipeline in w.pipelines.items():
        pipeline.write().save(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(described),)], "description string").coalesce(1).write.text(f"{folder}/description")
    number = max(versions(spark, path), default=0) + 1
    files, source = _files(spark, folder)
    while True:
        _, target = _files(spark, f"{path.rstrip('/')}/v{number}")
        if not files.exists(target) and files.rename(source, target):
            # where another writer took the number in between, a rename may move into its folder: move on
            if files.exists(_files(spark, f"{path.rstrip('/')}/v{number}/{source.getName()}")[1]):
                source = _files(spark, f"{path.rstrip('/')}/v{number}/{source.getName()}")[1]
            else:
                return number
        number += 1


def load(spark: SparkSession, path: str, version: int | None = None) -> Any:
    """The model of a version, the last one by default."""
    found = versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no version {version or ''} in {path}")
    folder = f"{path.rstrip('/')}/v{version or found[-1]}"
    described = spark.read.text(f"{folder}/description").first()[0]
    return _Reader(spark, folder).decode(json.loads(described))
