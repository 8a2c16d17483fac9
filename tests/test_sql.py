"""Queries against their SQL, on small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

#: Titles cut within a reference, as long ones are in the tables. Page 16 has no other change.
CUT = ("Short&amp;&amp", "Said &quot;so&quot", "A&amp;&am", "Less &#39", "Code &#x2", "Whole &amp;")


def page(title):
    return f'<html lang="en"><head><title>{title}</title></head><body><article><h1>{title}</h1><p>Some words.</p></article></body></html>'


@pytest.fixture(scope="module")
def cut_titles(tmp_path_factory):
    folder = tmp_path_factory.mktemp("cut")
    rows = [(16 + 120 * i, f"https://{'abc'[i % 3]}.example.com/en/{i}", page(t)) for i, t in enumerate(CUT)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(f"COPY pages TO '{folder}/pages.parquet' (FORMAT parquet)")
    return folder, con


def told(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("name", ("console_report", "extracted_content", "heading_levels", "page_features", "page_summary", "tool_scan_url"))
def test_cut_references(spark, cut_titles, name):
    folder, con = cut_titles
    assert told(entry.queries()[name](spark, str(folder)).collect()) == told(con.execute(entry.oracle_sql()[name]).fetchall())


def test_discovery_parses_home_pages_only(spark, cut_titles, monkeypatch):
    from crawlens.plans import queries

    given = []
    monkeypatch.setattr(queries, "parsed", lambda df: given.append(df.count()) or df.withColumn("facts", F.expr("named_struct('links', array(url))")))
    monkeypatch.setattr(queries.site, "discovered", lambda sites, robots, sitemaps, homes: (homes, sites))
    homes, _ = queries._discovery(spark, str(cut_titles[0]))
    assert given == [3]
    assert sorted(r.url for r in homes.collect()) == [f"https://{'abc'[i % 3]}.example.com/en/{i}" for i in (3, 4, 5)]
