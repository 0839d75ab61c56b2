"""A training corpus from raw documents: quality, exact copies, near copies, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The two
dedup stages number the rows and decide by row, so that rows without an id, or with one that repeats, go like any other.
Null texts are empty texts, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pantrygrid.llm import exact_dedup, mixing, ngram_join, quality, shared, tokens
from pantrygrid.llm.queries import MIX, labelled_domains


#: The columns of row numbers, files and their numbers inside a dedup stage; most files whose numbers are sent to all tasks.
ROW, FILE, NUMBER, FILES = "_corpus_row", "_corpus_file", "_corpus_number", 1_000_000


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a number for each row that is the same whenever it is read: that of its file, and its place in it. Rows that come from no files are written first."""
    place = "struct(_metadata.file_path AS file, _metadata.row_index AS at)"
    try:
        placed = docs.withColumn(ROW, F.expr(place))
    except AnalysisException:
        docs = shared.written(docs)
        placed = docs.withColumn(ROW, F.expr(place))
    files = placed.select(F.col(f"{ROW}.file").alias(FILE)).distinct()
    files = shared.written(files.withColumn(NUMBER, F.row_number().over(Window.orderBy(FILE)).cast("long")))  # one row a file
    met = placed.join(F.broadcast(files) if files.count() <= FILES else files, placed[f"{ROW}.file"] == files[FILE])
    return met.withColumn(ROW, F.shiftleft(NUMBER, 40) + F.col(f"{ROW}.at")).drop(FILE, NUMBER)


def _one_of_each(docs: DataFrame, grouped, best) -> DataFrame:
    """Of each group of rows, the one that the aggregate best picks. grouped: numbered docs to ROW, group."""
    numbered = _numbered(docs)
    groups = shared.written(grouped(numbered))
    stays = groups.join(numbered.select(ROW, "doc_id"), ROW).groupBy("group").agg(best.alias("best")).select(f"best.{ROW}")
    gone = shared.written(groups.select(ROW).join(shared.written(stays), ROW, "left_anti"))
    return numbered.join(gone, ROW, "left_anti").select(*[numbered[f"`{c}`"] for c in docs.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return quality.accepted_documents(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id; a null one is below any other."""
    return _one_of_each(docs, lambda rows: exact_dedup.exact_dedup(rows, id_col=ROW).where("group_size > 1").select(ROW, F.col("keep_id").alias("group")), F.max(F.struct("doc_id", ROW)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that similarity links connect, one row with the smallest doc_id; a null one is above any other."""
    return _one_of_each(docs, lambda rows: ngram_join.ngram_join(rows, id_col=ROW).select(ROW, F.col("component_id").alias("group")), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW)))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say. No document goes: domains below their target have documents repeat."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.mixed_documents(docs, labelled_domains(docs, labels), MIX, never_less=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    import public_tokenizers

    return tokens.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_domains),
    ("byte-level BPE encoding and decoding", encode),
]
#: SQL cannot train the classifiers; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
