"""Staged publishing: write, count back, then switch; readers see the old tables or the new ones, never a half.

A version is a folder of gzipped CSV tables. It is published when the pointer file names it, which a rename replaces in one
step (on file systems whose rename is atomic: HDFS and local ones; object stores need a table format for that).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

POINTER = "CURRENT"


class PublishError(RuntimeError):
    """What was read back isn't what was to be written; the version before it stays published."""


def _context(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())


def _switch(spark: SparkSession, path: str, said: dict) -> None:
    jvm, files = _context(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}-{uuid.uuid4().hex}")
    fs = new.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files.rename(new, jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}"), how)


def current(spark: SparkSession, path: str) -> dict | None:
    """What is published: {"version", "tables": {name: {"rows", "schema"}}}; None before the first publication."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/{POINTER}").collect()))  # one short line


def _read(spark: SparkSession, path: str, version: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("emptyValue", "").option("nullValue", "\\N").option("mode", "FAILFAST").csv(f"{path}/versions/{version}/{name}")


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A published table, with the types that it was written with."""
    said = current(spark, path)
    if said is None or name not in said["tables"]:
        raise KeyError(name)
    return _read(spark, path, said["version"], name, said["tables"][name]["schema"])


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Publishes all ``tables`` together as a full reload; returns (name, rows), counted back from what was written.

    Rows are counted in the job that writes them and again from the files; a difference, or a write that fails, raises and
    leaves the version before it published. Columns must be of types that CSV holds. Old versions are left to the user to
    clear.
    """
    version, said = uuid.uuid4().hex, {}
    for name, table in tables.items():
        observed = Observation(f"rows-{uuid.uuid4().hex}")
        out = table.observe(observed, F.count(F.lit(1)).alias("rows"))
        out.write.option("header", True).option("compression", "gzip").option("escape", '"').option("emptyValue", '""').option("nullValue", "\\N").csv(f"{path}/versions/{version}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        written, back = observed.get["rows"], _read(spark, path, version, name, schema).count()
        if written != back:
            raise PublishError(f"{name}: {written} rows were written and {back} read back")
        said[name] = {"rows": back, "schema": schema}
    _switch(spark, path, {"version": version, "tables": said})
    return spark.createDataFrame([(n, t["rows"]) for n, t in said.items()], "name string, rows bigint")
