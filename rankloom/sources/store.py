"""Tables kept under a content key: token counts, teacher labels, and models with their metadata. Nothing is pickled."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import multiset_key
from .readers import path_exists

VERSION = 1


def content_of(texts: DataFrame, column: str) -> str:
    """A 16-digit key of a column's texts, whatever their order."""
    return texts.agg(multiset_key(F.col(column)).alias("k")).first()[0]


def label_key(dataset: str, teachers: list[str]) -> str:
    return hashlib.sha256(f"{dataset}:{','.join(sorted(teachers))}".encode()).hexdigest()[:16]


def checksums(table: DataFrame) -> dict[str, tuple[int, int]]:
    """Of each file of a stored table its rows and the sum of their hashes, whatever their order; read from the data.
    Columns are hashed as they are, with where nulls stand, and maps as JSON; a hash is summed in halves, which 64-bit
    sums hold for two billion rows of a file."""
    row = F.xxhash64(*[c if "map<" not in t else F.to_json(F.struct(c)) for c, t in table.dtypes], *[F.isnull(c) for c in table.columns])
    halves = [F.sum(F.shiftright("h", 32)), F.sum(F.col("h").bitwiseAND(0xFFFFFFFF))]
    found = table.select(F.input_file_name().alias("file"), row.alias("h")).groupBy("file").agg(F.count("*"), *halves)
    return {file.rsplit("/", 1)[-1]: (n, (high << 32) + low) for file, n, high, low in found.collect()}


class TableStore:
    """Parquet tables below one folder, each built at most once, with a manifest of the rows and checksum of each file.

    The manifest is written after the table and marks it complete. A table whose files are missing, damaged or not those
    of the manifest is built anew; each get reads it once to tell, unless verify is False."""

    def __init__(self, spark: SparkSession, root: str, verify: bool = True) -> None:
        self.spark, self.root, self.verify = spark, root.rstrip("/"), verify

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def _manifest(self, key: str) -> str:
        return f"{self.root}/_manifest-{key}"

    def _sound(self, key: str) -> bool:
        """Whether the table under the key is complete and as it was written. Any failure to read it says no."""
        if not path_exists(self.spark, f"{self._manifest(key)}/_SUCCESS"):
            return False
        if not self.verify:
            return True
        try:
            rows = self.spark.read.schema("file string, n bigint, h string").json(self._manifest(key)).collect()
            return checksums(self.spark.read.parquet(self.path(key))) == {r.file: (r.n, int(r.h)) for r in rows if r.file}
        except (PySparkException, Py4JError):
            return False

    def get_or_build(self, key: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
        """The table under the key; built if it is missing, unsound or forced."""
        if force or not self._sound(key):
            manifest = self.spark._jvm.org.apache.hadoop.fs.Path(self._manifest(key))
            manifest.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(manifest, True)
            build().write.mode("overwrite").parquet(self.path(key))
            rows = [(f, n, str(h)) for f, (n, h) in checksums(self.spark.read.parquet(self.path(key))).items()]
            self.spark.createDataFrame(rows, "file string, n bigint, h string").coalesce(1).write.mode("overwrite").json(self._manifest(key))
        return self.spark.read.parquet(self.path(key))


def save_model(spark: SparkSession, path: str, kind: str, settings: dict[str, str], tables: dict[str, DataFrame]) -> None:
    """A model as metadata and named tables; the metadata are written last and mark it complete."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [("kind", kind), ("version", str(VERSION)), ("tables", ",".join(sorted(tables))), *((f"set:{k}", str(v)) for k, v in settings.items())]
    spark.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, str], dict[str, DataFrame]]:
    """Settings and tables of a saved model of this kind and version."""
    if not path_exists(spark, f"{path}/meta/_SUCCESS"):
        raise FileNotFoundError(f"no complete model at {path}")
    meta = {r[0]: r[1] for r in spark.read.schema("key string, value string").json(f"{path}/meta").collect()}
    if meta.get("kind") != kind:
        raise ValueError(f"{path} holds a {meta.get('kind')}, not a {kind}")
    if meta.get("version") != str(VERSION):
        raise ValueError(f"{path} has version {meta.get('version')}, not {VERSION}")
    names = [n for n in meta["tables"].split(",") if n]
    return {k[4:]: v for k, v in meta.items() if k.startswith("set:")}, {n: spark.read.parquet(f"{path}/{n}") for n in names}
