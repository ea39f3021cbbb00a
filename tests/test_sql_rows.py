"""Registered queries and their SQL on a few odd rows, value for value."""

import duckdb
import pytest

from tessera.operators import selectors, web
from tessera.plans import queries

PAGE = '<html><head><title>t</title></head><body><article><h1>{}</h1><div class="ad">the &amp; ad</div><p>x</p></article></body></html>'
TITLES = ["A &amp; b", "cut &amp", "cut &am", "token = &quot;x", "&amp;quot; &lt;b&gt;", "R&D &middot; &copy 2", "&#65;&#x42;"]
EVENTS = [(1, 7, 0.0), (2, 8, 3.25), (3, -1, -0.0), (4, 0, 1e-12), (5, 0, -1e-12)]


def same_rows(spark, name, folder, table):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    df, relation = queries.QUERIES[name](spark, str(folder)), c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    place = [relation.columns.index(k) for k in columns]
    assert sorted(repr([r[k] for k in columns]) for r in df.collect()) == sorted(repr([r[p] for p in place]) for r in relation.fetchall())


@pytest.mark.parametrize("name", ["page_selector", "fallback_chain"])
def test_references_in_titles_are_those_of_the_sql(spark, tmp_path, name):
    rows = [(k, f"http://s/{k}", PAGE.format(x)) for k, x in enumerate(TITLES)]
    if name == "fallback_chain":
        rows.append((99, "http://s/99", PAGE.format("")))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(spark, name, tmp_path, "pages")


def test_rewards_of_zero_keep_their_sign(spark, tmp_path):
    spark.createDataFrame(EVENTS, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    same_rows(spark, "shaped_rewards", tmp_path, "events")


def test_references_as_they_are_written():
    html = "<h1 id='&lt;'>a &amp;amp; &lt; &b<script>1 && '&amp;'</script></h1>"
    (plain,), (raw,) = web.select_elements(html, "h1"), web.select_elements(html, "h1", references=False)
    assert plain == {"text": "a &amp; < &b1 && '&amp;'", "id": "<"}
    assert raw == {"text": "a &amp;amp; &lt; &b1 && '&amp;'", "id": "&lt;"}
    assert selectors.Selector("h1").find(selectors.tree(html, references=False))[0].text() == "a &amp;amp; &lt; &b"
