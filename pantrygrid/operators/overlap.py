"""Texts that share words or passages: recall of gold texts, one-to-one matches, labels carried to other chunks, sources of passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrygrid import functions as fn

#: Shared words that make a chunk match a gold text, and that carry a label to a chunk of another cut.
MATCH, CARRY = 0.3, 0.5
#: Characters of a probe, and from one probe to the next.
PROBE, STEP = 120, 200


def token_set(text: Column) -> Column:
    return F.array_distinct(fn.words(text))


def body(text: Column, title: Column) -> Column:
    """The words of a text that its title does not have."""
    return F.array_except(token_set(text), token_set(title))


def recall(tokens: Column, gold: Column) -> Column:
    """The share of gold words that are among tokens; 0 without gold words."""
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(tokens, gold)) / F.size(gold)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the smaller set; 0 where one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def matched(ranked: DataFrame, gold: DataFrame, least: float = MATCH) -> DataFrame:
    """query_id, rank, any_match, rel of ranked texts (query_id, rank, text) and gold texts (query_id, pos, text).

    any_match: some gold text has enough of its words in the text. rel: in order of rank each text takes the first gold
    text, by pos, that no earlier one took. A query's rankings and gold texts are few.
    """
    g = gold.select("query_id", "pos", token_set(F.col("text")).alias("gold"))
    r = ranked.select("query_id", "rank", token_set(F.col("text")).alias("tokens"))
    hits = r.join(g, "query_id").where(recall(F.col("tokens"), F.col("gold")) >= least).groupBy("query_id", "rank").agg(F.array_sort(F.collect_list("pos")).alias("fits"))
    whole = r.select("query_id", "rank").join(hits, ["query_id", "rank"], "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("fits", F.array().cast("array<int>")).alias("fits")))).alias("x"))

    def step(taken: Column, x: Column) -> Column:
        return F.concat(taken, F.array(F.coalesce(F.get(F.array_except(x["fits"], taken), 0), F.lit(-1))))  # -1 stands for nothing taken

    taken = F.aggregate("x", F.array().cast("array<int>"), step)
    each = whole.withColumn("taken", taken).select("query_id", F.posexplode("x").alias("i", "y"), "taken")
    return each.select("query_id", F.col("y.rank").alias("rank"), (F.size("y.fits") > 0).alias("any_match"), (F.col("taken")[F.col("i")] >= 0).cast("int").alias("rel"))


def carried(chunks: DataFrame, relevant: DataFrame, least: float = CARRY) -> DataFrame:
    """query_id, chunk_id: chunks (doc_id, chunk_id, title, text) of a new cut that are relevant, as they share enough words with a relevant chunk (query_id, doc_id, title, text) of the old cut of their document. Titles do not count."""
    new = chunks.select("doc_id", "chunk_id", body(F.col("text"), F.col("title")).alias("new"))
    old = relevant.select("query_id", "doc_id", body(F.col("text"), F.col("title")).alias("old"))
    return new.join(old, "doc_id").where(overlap(F.col("new"), F.col("old")) >= least).select("query_id", "chunk_id").distinct()


def _key(text: Column) -> Column:
    """The second to fourth whole word of a probe; null where there are fewer."""
    inner = F.slice(F.split(text, " "), 2, 3)
    return F.when(F.size(F.split(text, " ")) >= 5, F.array_join(inner, " "))


def sources(passages: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, chunk_id, probes: of chunks (chunk_id, text) those that hold the most probes of a passage (item_id, text).

    Probes are PROBE characters at every STEP. A chunk and a probe meet by three whole words, then the probe is looked for
    as it is; only probes with fewer words, which are rare, look at every chunk.
    """
    text = F.trim(F.coalesce(F.col("text"), F.lit("")))
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - PROBE - 1, F.lit(0)), F.lit(STEP))
    probes = passages.select("item_id", F.explode(F.transform(at, lambda i: F.substring(text, i + 1, F.lit(PROBE)))).alias("probe")).where("probe <> ''").withColumn("key", _key(F.col("probe")))
    words = F.split("text", " ")
    after = lambda i: F.slice(words, i, F.greatest(F.size(words), F.lit(1)))
    pairs = F.zip_with(words, after(2), lambda a, b: F.concat_ws(" ", a, b))
    runs = F.zip_with(pairs, after(3), lambda a, b: F.concat_ws(" ", a, b))
    keyed = chunks.where("text is not null").select("chunk_id", F.explode(F.array_distinct(runs)).alias("key"))
    keys = probes.where("key is not null").select("key").distinct()
    met = keyed.join(keys, "key", "left_semi").join(probes.where("key is not null"), "key").select("item_id", "probe", "chunk_id").join(chunks, "chunk_id").where(F.contains("text", "probe")).select("item_id", "probe", "chunk_id")
    rest = probes.where("key is null").join(chunks, F.contains(chunks["text"], F.col("probe"))).select("item_id", "probe", "chunk_id")
    counts = met.unionByName(rest).groupBy("item_id", "chunk_id").agg(F.count("*").alias("probes"))
    most = counts.groupBy("item_id").agg(F.max("probes").alias("probes"))
    return counts.join(most, ["item_id", "probes"]).select("item_id", "chunk_id", "probes")
