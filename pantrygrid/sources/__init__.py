"""Tables and logs that the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantrygrid.sinks import versioned


#: Bytes that Spark puts into one Arrow batch for Python: rows hold whole texts, or blocks of vectors of megabytes each.
BATCH_BYTES = 4 << 20


def sized_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes too; by rows alone, 10,000 of any length would stand in a Python worker at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sized_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; blank and malformed lines are left out."""
    rows = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to spark.checkpoint.dir; only where that is unset and all run on one machine, as in tests, to a folder beside the warehouse."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON array or object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Fixed value: characters from which an abstract is kept.
LEAST_ABSTRACT = 400
_ARTICLE = "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string>>>>>"


def articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, journal, year, abstract of XML articles: sections that are not empty, each under its label, with an empty line between; short abstracts are left out."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("valueTag", "_VALUE").schema(_ARTICLE).load(path)
    a = F.col("MedlineCitation.Article")
    said = F.filter(F.transform(a["Abstract"]["AbstractText"], lambda x: F.struct(x["_Label"].alias("label"), F.trim(x["_VALUE"]).alias("text"))), lambda x: F.length(x["text"]) > 0)
    abstract = F.array_join(F.transform(said, lambda x: F.concat(F.when(x["label"].isNotNull(), F.concat(F.initcap(x["label"]), F.lit(": "))).otherwise(""), x["text"])), "\n\n")
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    got = rows.select(text(F.col("MedlineCitation.PMID")).alias("pmid"), text(a["ArticleTitle"]).alias("title"), text(a["Journal"]["Title"]).alias("journal"), text(a["Journal"]["JournalIssue"]["PubDate"]["Year"]).alias("year"), abstract.alias("abstract"))
    return got.where(F.length("abstract") >= LEAST_ABSTRACT)


def missing_files(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Of the files that an unpacked archive must hold, those that are not there."""
    path = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{n}")
    fs = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in names if not fs.exists(path(n))]


def vectors(spark: SparkSession, path: str, with_vector: bool = False, ids: list[int] | None = None) -> DataFrame | None:
    """The vector table (chunk_id, vector, others), without its vectors unless asked for, all rows or those of ids; None where there is no table."""
    rows = versioned.read(spark, path)
    if rows is None:
        return None
    rows = rows if ids is None else rows.where(F.col("chunk_id").isin(ids))
    return rows if with_vector else rows.drop("vector")


def log(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame | None:
    """The records of a log, or those of some UTC days; None where there is no log."""
    return versioned.read(spark, path, days)
