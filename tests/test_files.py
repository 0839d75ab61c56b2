"""Sources and sinks on small files."""

import datetime as dt
import json

import pytest
from pantrygrid import sinks, sources
from pantrygrid.sinks import versioned

LOG = "session_id string, ts timestamp, text string"


def test_tables_are_written_again_added_to_and_cut(spark, tmp_path):
    at = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(1, 7, [0.5]), (2, 8, [1.5])], "chunk_id int, doc_id int, vector array<double>")
    assert sources.vectors(spark, at) is None
    sinks.vectors(rows, at)
    sinks.vectors(rows.selectExpr("chunk_id + 10 as chunk_id", "doc_id", "vector"), at, add=True)
    assert sources.vectors(spark, at).columns == ["chunk_id", "doc_id"] and sources.vectors(spark, at, True, [12]).collect()[0]["vector"] == [1.5]
    sinks.delete_documents(spark, at, spark.createDataFrame([(7,), (7,)], "doc_id int"))
    assert sorted(r["chunk_id"] for r in sources.vectors(spark, at).collect()) == [2, 12]
    sinks.vectors(rows.limit(0), at)
    assert sources.vectors(spark, at).count() == 0
    sinks.report(rows.drop("vector"), f"file://{tmp_path}/r")
    assert sources.csv(spark, f"file://{tmp_path}/r", "chunk_id int, doc_id int").count() == 2


def log_rows():
    day = lambda d, h: dt.datetime(2024, 5, d, h)
    return [("a", day(1, 3), "x"), ("b", day(1, 4), "y"), ("b", day(2, 1), "z"), ("a", day(3, 1), "w"), (None, day(1, 1), "n")]


def said(df):
    return sorted((r["session_id"] or "", r["text"], r["day"]) for r in df.collect())


def test_a_session_is_erased_everywhere(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    assert sources.log(spark, at) is None
    sinks.append_log(spark.createDataFrame(log_rows()[:3], LOG), at)
    sinks.append_log(spark.createDataFrame(log_rows()[3:], LOG), at)
    second = versioned.pointer(spark, at)["live"]["2024-05-02"]
    assert len(versioned.pointer(spark, at)["live"]["2024-05-01"]) == 2
    assert sinks.forget(spark, at, "nobody") == 0 and sinks.forget(spark, at, "a") == 2
    assert said(sources.log(spark, at)) == [("", "n", "2024-05-01"), ("b", "y", "2024-05-01"), ("b", "z", "2024-05-02")]
    assert versioned.pointer(spark, at)["live"]["2024-05-02"] == second
    assert said(sources.log(spark, at, ["2024-05-02"])) == [("b", "z", "2024-05-02")]
    assert versioned.sweep(spark, at) == 3 and len(said(sources.log(spark, at))) == 3 and versioned.sweep(spark, at) == 0
    assert sinks.retain(spark, at, "2024-05-02") == ["2024-05-01"] and said(sources.log(spark, at)) == [("b", "z", "2024-05-02")]
    assert sinks.forget(spark, at, "b") == 1 and said(sources.log(spark, at)) == []


def test_a_writer_that_is_lost_leaves_the_old_version(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(1, 7, [0.5]), (2, 8, [1.5])], "chunk_id int, doc_id int, vector array<double>")
    sinks.vectors(rows, at)
    log = f"file://{tmp_path}/log"
    sinks.append_log(spark.createDataFrame(log_rows(), LOG), log)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned, "_renamed", lost)  # all is written but the pointer
        for act in (lambda: sinks.delete_documents(spark, at, rows.select("doc_id")), lambda: sinks.forget(spark, log, "a"), lambda: sinks.vectors(rows.limit(0), at)):
            with pytest.raises(RuntimeError, match="lost"):
                act()
        assert sources.vectors(spark, at).count() == 2 and len(said(sources.log(spark, log))) == 5
    with monkeypatch.context() as m:
        m.setattr(versioned, "_point", lost)  # between the files and the pointer
        with pytest.raises(RuntimeError, match="lost"):
            sinks.forget(spark, log, "a")
    assert len(said(sources.log(spark, log))) == 5
    sinks.delete_documents(spark, at, spark.createDataFrame([(7,)], "doc_id int"))
    assert [r["chunk_id"] for r in sources.vectors(spark, at).collect()] == [2] and versioned.sweep(spark, at) > 0
    assert [r["chunk_id"] for r in sources.vectors(spark, at).collect()] == [2]


def test_the_slower_of_two_writers_is_told(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/v"
    rows = spark.createDataFrame([(1, 7, [0.5])], "chunk_id int, doc_id int, vector array<double>")
    sinks.vectors(rows, at)
    seen = versioned.pointer(spark, at)
    sinks.vectors(rows, at, add=True)
    with pytest.raises(versioned.Changed):
        versioned._point(spark, at, seen | {"version": "x"}, seen)
    assert sources.vectors(spark, at).count() == 2


def test_values_by_key_touch_their_buckets_only(spark, tmp_path):
    at = f"file://{tmp_path}/kv"
    kv = lambda rows: spark.createDataFrame(rows, "key string, v int")
    sinks.upsert(kv([(f"k{i}", i) for i in range(40)]), at, "key")
    before = versioned.pointer(spark, at)["live"]
    sinks.upsert(kv([("k3", 300), ("new", 1)]), at, "key")
    after = versioned.pointer(spark, at)["live"]
    assert len({b for b in after if after[b] != before.get(b)}) <= 2
    got = {r["key"]: r["v"] for r in versioned.read(spark, at).collect()}
    assert got == {f"k{i}": i for i in range(40)} | {"k3": 300, "new": 1}
    with pytest.raises(ValueError):
        sinks.upsert(kv([("a", 1), ("a", 2)]), at, "key")


def test_counters_and_values(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert sorted(map(tuple, sinks.upserted(table, spark.createDataFrame([("b", 5), ("c", 6)], "key string, v int"), "key").collect())) == [("a", 1), ("b", 5), ("c", 6)]
    one = spark.createDataFrame([("d", 1)], "day string, calls long")
    assert [tuple(r) for r in sinks.added(one, one).collect()] == [("d", 2)]


def test_json_and_xml(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in sources.records(spark, f"file://{tmp_path}/l.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "d.json").write_text(json.dumps([{"a": 3}, {"a": 4}], indent=1))
    assert sorted(r["a"] for r in sources.document(spark, f"file://{tmp_path}/d.json", "a int").collect()) == [3, 4]
    article = lambda k, parts: f"<PubmedArticle><MedlineCitation><PMID>{k}</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle> T </ArticleTitle><Abstract>{parts}</Abstract></Article></MedlineCitation></PubmedArticle>"
    long = "word " * 60
    (tmp_path / "a.xml").write_text("<PubmedArticleSet>" + article(1, f'<AbstractText Label="BACKGROUND">{long}</AbstractText><AbstractText> </AbstractText><AbstractText>{long}</AbstractText>') + article(2, "<AbstractText>short</AbstractText>") + "</PubmedArticleSet>")
    got = sources.articles(spark, f"file://{tmp_path}/a.xml").collect()
    assert [(r["pmid"], r["title"], r["journal"], r["year"]) for r in got] == [("1", "T", "J", "2020")] and got[0]["abstract"] == f"Background: {long.strip()}\n\n{long.strip()}"
    assert sources.missing_files(spark, f"file://{tmp_path}", ["a.xml", "b.csv"]) == ["b.csv"]


def test_python_sees_long_rows_in_batches_bounded_by_bytes(spark):
    """40 rows of a megabyte each, as blocks of vectors or long texts are, do not stand in a worker at once."""
    import pandas as pd
    from pantrygrid.sources import BATCH_BYTES, table

    table(spark, "/root/testdata/sf0.001", "part")
    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1 << 20) AS text")
    seen = lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches)
    most = max(r["n"] for r in long.mapInPandas(seen, "n long").collect())
    assert most <= BATCH_BYTES / (1 << 20) + 1
