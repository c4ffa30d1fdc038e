"""Runs and corpora on shared storage that a later process can trust.

Everything lies in a folder named by what it was made from: a corpus by the content of its rows, a run by its corpus, its development set, its
settings and the version of the code.  Other input or other settings are another folder, so nothing stale can be returned.  Tables are written first, each under a name of its
own; a manifest that lists them is published last, by a rename.  A part without a manifest was not finished and is made again; two
processes that make the same part do not write into each other's tables.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import os
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.io import _fs, path_exists, write_table

MANIFEST = "manifest.json"
#: The modules whose code decides what a corpus or a round holds.
CODE = ("kestrel.functions.arrow_words", "kestrel.functions.text", "kestrel.operators.beams", "kestrel.operators.classify", "kestrel.operators.expand", "kestrel.operators.lists", "kestrel.operators.pseudo",
        "kestrel.operators.relational", "kestrel.operators.rerank", "kestrel.operators.soft_targets", "kestrel.operators.tfidf", "kestrel.plans.rounds")


@cache
def code_version() -> str:
    """A digest of the source of ``CODE``: changed code never reads the tables of older code."""
    sources = [inspect.getsource(importlib.import_module(m)) for m in CODE]
    return hashlib.sha256("\n".join(sources).encode()).hexdigest()[:16]


def content_key(df: DataFrame | None) -> str:
    """What tells one set of rows from another, in any order: their number and two sums over row hashes.  One scan."""
    if df is None:
        return "none"
    cols = sorted(df.columns)
    row = [*cols, *(F.col(c).isNull() for c in cols)]  # a hash passes over nulls
    h = df.select(F.xxhash64(F.lit(1), *row).alias("a"), F.xxhash64(F.lit(2), *row).alias("b"))
    n, a, b = h.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(20,0)")), F.bit_xor("b")).first()
    return hashlib.sha256(repr((cols, n, str(a), b)).encode()).hexdigest()[:16]


def key_of(*parts) -> str:
    return hashlib.sha256(json.dumps([code_version(), *parts], sort_keys=True, default=str).encode()).hexdigest()[:16]


def shared_root(spark: SparkSession, name: str) -> str:
    """A folder that every session with the same checkpoint folder sees."""
    return os.path.join(os.path.dirname(ensure_checkpoint_dir(spark)), name)


def publish(spark: SparkSession, folder: str, content: dict) -> None:
    """Writes the manifest under another name and renames it: readers see all of it or nothing."""
    fs, final = _fs(spark, f"{folder}/{MANIFEST}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    draft = path(f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(content, sort_keys=True, default=str).encode()))
    out.close()
    if not fs.rename(draft, final) and not fs.exists(final):
        raise OSError(f"could not publish {folder}/{MANIFEST}")


def manifest(spark: SparkSession, folder: str) -> dict | None:
    at = f"{folder}/{MANIFEST}"
    if not path_exists(spark, at):
        return None
    return json.loads(spark.read.text(at, wholetext=True).first()[0])


class Part:
    """The tables of one folder: written one by one, then published together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tables, self.schemas = spark, folder, {}, {}

    def put(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        self.tables[name] = f"{name}-{uuid.uuid4().hex[:8]}"
        write_table(df, f"{self.folder}/{self.tables[name]}", by)
        self.schemas[name] = df.schema.jsonValue()  # a table without rows may leave no file to tell it
        return self._read(name)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(self.schemas[name])).parquet(f"{self.folder}/{self.tables[name]}")

    def publish(self, **more) -> None:
        publish(self.spark, self.folder, {"tables": self.tables, "schemas": self.schemas, **more})

    def load(self) -> tuple[dict[str, DataFrame], dict] | None:
        """(tables, manifest), or None if the part was never finished."""
        m = manifest(self.spark, self.folder)
        if m is None:
            return None
        self.tables, self.schemas = m["tables"], m["schemas"]
        return {name: self._read(name) for name in self.tables}, m
