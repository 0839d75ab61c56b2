"""Parts, rules and verdicts of urls; the tree on a small table, and the query against its SQL with odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from pantrygrid.llm import queries, url_filter

ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.Com", "http://a.com?x=/en/", "http://a.com#/en/", "https://WWW.Example.COM/en/1", "x://www.example.com/en", "http://blog.example.com/en/../a", "http://notexample.com/en/1", "http://net/es/", "http://a.net/es", "http://a.net/es/?q=://b.com/", "http://ÄÖ.net/fr/é", "http://a.org/" + "b/" * 50, "http://a.net//es/", "http://a.org:80/en/", "redirect?to=http://c.com/en/"]


def judged(spark, urls, **how):
    df = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    return {r["page_id"]: r.asDict() for r in url_filter.url_filter(df, queries.URL_RULES, **how).collect()}


def plain(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fit)[1] if fit else None, max(fit)[2] if fit else None


def test_parts_and_rules(spark):
    got = judged(spark, ODD)
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        host, path, rule, verdict = plain(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), url
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")


def test_templates_learn_from_labels(spark):
    site = [f"http://s.org/news/{i}" for i in range(40)] + [f"http://s.org/spam/{i}.html" for i in range(40)] + [f"http://s.org/spam/win-{i}/now" for i in range(40)] + [f"http://s.org/topic-{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    bad = [(u, int("/spam/" in u)) for u in site[::2]] + [("http://s.org/news/1", None), (None, 1)]
    labelled = spark.createDataFrame(bad, "url string, label int")
    got = judged(spark, site + ["http://other.org/spam/1"], labelled=labelled)
    assert {got[i]["verdict"] for i, u in enumerate(site) if "/spam/" in u} == {"block"}
    assert {got[i]["verdict"] for i, u in enumerate(site) if "/spam/" not in u} == {"allow"}
    assert got[len(site)]["verdict"] == "allow"  # nothing is known of that host


def test_wildcards_and_merged_branches(spark):
    urls = [(f"http://s.org/{a}/{i}", y) for a, y in (("de", 1), ("fr", 1), ("en", 0)) for i in range(40)] + [(f"http://s.org/u/n{chr(97 + i)}{chr(97 + j)}/p", 0) for i in range(10) for j in range(10)]
    df = spark.createDataFrame(urls, "url string, label int")
    seen = df.select(url_filter.url_host(F.col("url")).alias("host"), url_filter.url_path(F.col("url")).alias("path"), "label")
    state, common = url_filter.path_templates(seen)
    found = {r["template"]: (r["urls"], r["blocked"]) for r in state.groupBy("template").agg(F.sum("urls").alias("urls"), F.sum("blocked").alias("blocked")).collect()}
    assert found == {"/de|fr/#": (80, 80), "/en/#": (40, 0), "/u/*/p": (100, 0)}
    assert common == pytest.approx(80 / 220)


def test_query_equals_its_sql(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    extra = spark.createDataFrame([(1000 + i, u) for i, u in enumerate(ODD)] + [(None, "http://a.net/es/1"), (1, "http://a.net/es/1")], "page_id long, url string")
    pages.unionByName(extra).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op13_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_url_filter"]).fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert url_filter.url_filter(pages.limit(0), queries.URL_RULES).count() == 0
