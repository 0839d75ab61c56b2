"""Exact dedup by counting quotient filters.

Every partition turns the fingerprints of its texts into a counting quotient filter: a fingerprint's high bits are
its quotient (the block that it lies in), its low bits the remainder; a block holds its remainders in order, each with
a count. Filters of all partitions merge block by block by their sorted remainders, without loss, into the counts of
the whole table. Fingerprints with a count above one route their rows to byte verification: those rows are grouped by
the text itself, never by a hash alone.

A block's rows are at most one for each partition, and a partition has counted its own copies before anything moves, so
that a group of copies of any size is a single entry. The rows of a large group meet only in a join that Spark can
split, never in one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pantrygrid.llm import shared

#: Blocks of a filter: 2 ** QUOTIENT_BITS at least, more where a block would hold over BLOCK_ENTRIES fingerprints.
QUOTIENT_BITS, BLOCK_ENTRIES = 11, 1 << 15
_FILTER = "block long, remainders array<long>, counts array<long>"


def _partition_filter(bits: int):
    """Fingerprints of one partition to the blocks of its filter."""
    schema = pa.schema([("block", pa.int64()), ("remainders", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def build(batches):
        have = [np.asarray(b.column(0)).view(np.uint64) for b in batches if b.num_rows]
        if not have:
            return
        prints, counts = np.unique(np.concatenate(have), return_counts=True)
        block = (prints >> np.uint64(64 - bits)).astype(np.int64)
        remainder = (prints & np.uint64((1 << (64 - bits)) - 1)).astype(np.int64)
        blocks, first = np.unique(block, return_index=True)
        offsets = pa.array(np.append(first, len(block)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.ListArray.from_arrays(offsets, pa.array(remainder)), pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64)))], schema=schema)

    return build


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of all partitions' filters: sorted runs of remainders merge, counts of equal ones add up."""
    runs = np.concatenate(pdf["remainders"].to_numpy())
    order = np.argsort(runs, kind="stable")
    runs, counts = runs[order], np.concatenate(pdf["counts"].to_numpy())[order]
    first = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "remainders": [runs[first]], "counts": [np.add.reduceat(counts, first)]})


def quotient_filter(prints: DataFrame, rows: int) -> DataFrame:
    """The counting quotient filter of a column of 64-bit fingerprints: block, sorted remainders, counts. rows: of the table, for the number of blocks."""
    bits = max(QUOTIENT_BITS, int(np.ceil(np.log2(max(rows, 1) / BLOCK_ENTRIES))))
    own = prints.mapInArrow(_partition_filter(bits), _FILTER)
    return own.groupBy("block").applyInPandas(_merged, _FILTER).withColumn("bits", F.lit(bits))


def repeated_prints(filtered: DataFrame) -> DataFrame:
    """The fingerprints of a filter whose count is above one."""
    pairs = filtered.select("block", "bits", F.explode(F.filter(F.arrays_zip("remainders", "counts"), lambda x: x["counts"] > 1)).alias("x"))
    return pairs.select(F.expr("shiftleft(block, 64 - bits) | x.remainders").alias("print"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal ones, the row with the largest id stays.
    Null texts are empty texts, and empty texts are equal. A null id is below any other; a group that has only null ids
    has a null keep_id, and kept is true for its rows. Rows that repeat both id and text count one by one in group_size
    and stay or go together. An empty table gives an empty result. Columns beside the two named ones are not read.
    """
    norm = shared.texts(docs, id_col, text_col).withColumn("text", shared.lower_ascii_column(F.col("text")))
    marked = norm.select("id", F.xxhash64("text").alias("print"), F.sha2("text", 256).alias("sha"), "text")
    light = marked.select("id", "print", "sha")
    repeated = shared.written(repeated_prints(quotient_filter(light.select("print"), docs.count())))
    routed = marked.join(repeated, "print", "left_semi")
    # Grouping by the text compares bytes. Each partition first groups its own rows, so a text moves once from each.
    verified = routed.groupBy("print", "sha", "text").agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    # Classes travel on under fingerprint and digest; two texts under one such pair would stop the job.
    size = F.when(F.count("*") == 1, F.max("size")).otherwise(F.raise_error(F.lit("two texts share a fingerprint and a digest")))
    classes = verified.groupBy("print", "sha").agg(F.max("keep").alias("keep"), size.cast("long").alias("size"))
    out = light.join(shared.written(classes), ["print", "sha"], "left")
    keep = F.coalesce("keep", "id")
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), F.col("sha").alias("text_sha256"))
