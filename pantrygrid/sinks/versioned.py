"""Tables in versions: a change writes new files beside the old ones, then one small pointer file is renamed over.

A table's folder holds <column>=<value>/_version=<version> for each partition (_version=<version> alone for a table without one), and the
pointer, a JSON object with the live version of each partition. Readers follow the pointer, so that they see the table
as it was or as it is, wherever a writer is lost; files that no pointer names are swept later. Only partitions that a
change touches are written. The rename must replace a file in one step, as on HDFS or a local disk; writers come one at a
time, and one that finds the pointer changed since it began raises.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER, ALL = "_current", ""


class Changed(RuntimeError):
    """Another writer was faster."""


def _at(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts if p))
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> dict | None:
    """What the pointer says: version, by (partition column or null), schema, format, live {partition: version}; None where there is no table."""
    file, fs = _at(spark, path, POINTER)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, now: dict, before: dict | None) -> None:
    """The one step that makes a change visible."""
    if (pointer(spark, path) or {}).get("version") != (before or {}).get("version"):
        raise Changed(path)
    beside, fs = _at(spark, path, f"{POINTER}-{now['version']}")
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps(now, ensure_ascii=False).encode()))
    stream.close()
    _renamed(spark, beside, _at(spark, path, POINTER)[0])


def _renamed(spark: SparkSession, old, new) -> None:
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    qualify = context.makeQualified
    context.rename(qualify(old), qualify(new), options)


def read(spark: SparkSession, path: str, parts: list[str] | None = None) -> DataFrame | None:
    """The table as its pointer has it, or some of its partitions; None where there is none."""
    now = pointer(spark, path)
    if now is None:
        return None
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(now["schema"])
    live = [_folder(path, now["by"], p, v) for p, versions in sorted(now["live"].items()) if parts is None or p in parts for v in versions]
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(now["format"]).option("basePath", path).load(live).select(*schema.names)


def _folder(path: str, by: str | None, part: str, version: str) -> str:
    return "/".join([path.rstrip("/"), *([f"{by}={part}"] if by else []), f"_version={version}"])


def change(df: DataFrame, path: str, by: str | None = None, gone: list[str] | None = None, add: bool = False, kind: str = "parquet") -> dict:
    """df in place of the partitions that it has rows for and of those of gone, and beside all others; with add, beside their rows too. Returns the new pointer.

    A table that is not there yet is made; by and kind are those of the first change. Partitions are as many as the values
    of by, which is a column of few values (a day, a bucket), never null. df may read the table itself.
    """
    spark, before = df.sparkSession, pointer(df.sparkSession, path)
    by, kind = (before["by"], before["format"]) if before else (by, kind)
    version = uuid.uuid4().hex
    live = dict(before["live"]) if before else {}
    if by is None:
        df.write.format(kind).save(_folder(path, None, ALL, version))
        made = [ALL]
    else:
        beside, fs = _at(spark, path, f"_new-{version}")
        df.withColumn("_version", F.lit(version)).write.format(kind).partitionBy(by, "_version").save(beside.toString())
        made = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(beside) if s.isDirectory()]
        for part in made:  # a folder for each partition, one step each; none is live before the pointer
            home = _at(spark, path, f"{by}={part}")[0]
            fs.mkdirs(home)
            fs.rename(_at(spark, beside.toString(), f"{by}={part}", f"_version={version}")[0], _at(spark, home.toString(), f"_version={version}")[0])
        fs.delete(beside, True)
    for part in gone or []:
        live.pop(part, None)
    for part in made:
        live[part] = [*(live.get(part, []) if add else []), version]
    now = {"version": version, "by": by, "schema": before["schema"] if before else json.loads(df.schema.json()), "format": kind, "live": live}
    _point(spark, path, now, before)
    return now


def drop(spark: SparkSession, path: str, parts: list[str]) -> None:
    """The table without some of its partitions."""
    before = pointer(spark, path)
    live = {p: v for p, v in before["live"].items() if p not in parts}
    _point(spark, path, before | {"version": uuid.uuid4().hex, "live": live}, before)


def sweep(spark: SparkSession, path: str) -> int:
    """Takes away the files that the pointer does not name; readers of older versions must be done. Returns how many versions went."""
    now, n = pointer(spark, path), 0
    if now is None:
        return 0
    root, fs = _at(spark, path)
    live = {_at(spark, _folder(path, now["by"], p, v))[0].toUri().getPath() for p, versions in now["live"].items() for v in versions}
    depth = "_version=*" if now["by"] is None else f"{now['by']}=*/_version=*"
    for s in [*(fs.globStatus(_at(spark, path, depth)[0]) or []), *(fs.globStatus(_at(spark, path, "_new-*")[0]) or []), *(fs.globStatus(_at(spark, path, f"{POINTER}-*")[0]) or [])]:
        if s.getPath().toUri().getPath() not in live:
            fs.delete(s.getPath(), True)
            n += 1
    return n
