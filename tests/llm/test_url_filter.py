"""Mined URL rules against every combination of tokens, by literal and by joins, and the query against its SQL."""

import itertools
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import queries, url_filter

LABELLED, PAGES = "url string, block boolean", "page_id long, url string, tokens string, host int"


def farm(seed=2):
    """Bad hosts, bad paths within good hosts, bad only together, implied tokens, nulls, repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        sub, name, word, lang = rng.choice(["www", "m", "blog"]), rng.choice(["pills", "news", "shop", "wiki", "forum"]), rng.choice(["buy", "read", "list"]), rng.choice(["en", "de"])
        bad = name == "pills" or (word == "buy" and name == "shop") or (lang == "de" and name == "forum" and sub == "m") or rng.random() < 0.05
        tail = rng.choice(["", "?page=2", "?ref=x&page=3", "#top"])
        rows.append((f"https://{sub}.{name}.example.org/fixed/way/{word}/{lang}/{i}{tail}", bad))
    return rows + [(None, True), ("no address", True), (rows[0][0], None), rows[1], rows[1]]


def plain_rules(spark, rows):
    """Every combination of up to MAX_TOKENS tokens that passes."""
    known = [(u, b) for u, b in rows if u is not None and b is not None]
    frame = spark.createDataFrame([(u,) for u, _ in known], "url string").select("url", url_filter.tokens_of(F.col("url")).alias("t")).distinct()
    tokens = {r.url: r.t for r in frame.collect()}
    n, bad = len(known), sum(b for _, b in known)
    count, hit = {}, {}
    for u, b in known:
        for k in range(1, url_filter.MAX_TOKENS + 1):
            for s in itertools.combinations(sorted(tokens[u]), k):
                count[s] = count.get(s, 0) + 1
                hit[s] = hit.get(s, 0) + b
    least = max(url_filter.MIN_SUPPORT * bad, url_filter.MIN_COUNT * url_filter.MIN_CONFIDENCE)
    return {
        s for s, c in count.items() if c >= url_filter.MIN_COUNT and hit[s] >= least and hit[s] >= url_filter.MIN_CONFIDENCE * c and hit[s] * n >= url_filter.MIN_LIFT * bad * c
    }


@pytest.mark.parametrize("literal", [0, 200])
def test_verdicts_equal_all_combinations(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "MAX_RULES", literal)
    rows = farm()
    want = plain_rules(spark, rows)
    assert len(want) > 20
    rng = random.Random(4)
    urls = [u for u, _ in farm(9)] + [f"http://{rng.choice(['a', 'm'])}.{rng.choice(['pills', 'forum', 'new'])}.example.net/{rng.choice(['fixed', 'way', 'x'])}/{rng.choice(['buy', 'de'])}" for _ in range(60)]
    pages = spark.createDataFrame([(i, u, "t", 1) for i, u in enumerate(urls)] + [(0, urls[0], None, None), (None, urls[1], "t", 1)], PAGES).repartition(3)
    tokens = {r.page_id: set(r.t) for r in pages.select("page_id", url_filter.tokens_of(F.col("url")).alias("t")).collect()}
    got = url_filter.judged(pages, spark.createDataFrame(rows, LABELLED), policy=()).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        assert r.mined == any(set(s) <= tokens[r.page_id] for s in want), r
        assert r.verdict == ("block" if r.mined else "allow")


def test_tokens_of_the_same_urls_are_one_item(spark):
    """A fixed path of thirty words on every page of a host makes one item, not a thousand million sets."""
    path = "/".join(f"word{chr(97 + i)}{chr(97 + i)}" for i in range(26))
    rows = [(f"http://bad.org/{path}/p{i}", True) for i in range(60)] + [(f"http://good.org/x/p{i}", False) for i in range(60)]
    rules, items = url_filter.mine_rules(spark.createDataFrame(rows, LABELLED))
    assert rules.count() == 1 and items.groupBy("item").count().agg(F.max("count")).first()[0] == 27
    pages = spark.createDataFrame([(1, "http://new.org/wordbb/1"), (2, "http://new.org/x/1")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, spark.createDataFrame(rows, LABELLED)).collect()} == {1: "block", 2: "allow"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELLED)
    assert url_filter.judged(spark.createDataFrame([], PAGES), none).count() == 0
    assert {r.verdict for r in url_filter.judged(spark.createDataFrame([(1, "http://x.org/a", "t", 1)], PAGES), none).collect()} == {"allow"}
    assert url_filter.judged(spark.createDataFrame([], PAGES), spark.createDataFrame(farm(), LABELLED)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    ours, theirs = queries.queries()[name](spark, sf).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda df: sorted(tuple(str(x) if x == x and x is not None else "-" for x in r) for r in df[sorted(ours.columns)].astype(object).itertuples(index=False))
    assert plain(ours) == plain(theirs)


def test_sql_tries_the_same_rules(spark, tmp_path):
    """Tables whose labels depend on the URL: rules are mined, and SQL that tries every combination agrees."""
    rows = farm()
    pages = [(i, u, f"<article><h1>t</h1><p><b>line {i}<br><p>more</article>") for i, (u, _) in enumerate(rows)]
    docs = [(i + 5, f"line {i}\nmore", None, None, 1) for i in range(len(rows))]
    labels = [(i + 5, None if b is None else int(not b), 0) for i, (_, b) in enumerate(rows)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = sorted(tuple(r) for r in queries.op7_url_filters(spark, str(tmp_path)).select("page_id", "verdict", "mined").collect())
    theirs = sorted(con.sql(f"SELECT page_id, verdict, mined FROM ({queries.url_sql()})").fetchall())
    assert ours == theirs and sum(r[2] for r in ours) > 100
