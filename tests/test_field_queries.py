import datetime

import duckdb
import pytest

from almanac import field_queries
from almanac.operators import dedup, rules
from almanac.queries import QUERIES, SQL

NAMES = [n for n, f in QUERIES.items() if f.__module__ == field_queries.__name__]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders enough for every pair of lists to meet, and a few rows of the other tables."""
    folder = str(tmp_path_factory.mktemp("tables"))
    start = datetime.datetime(1995, 1, 1, 0, 30)
    spark.createDataFrame([(k, start + datetime.timedelta(days=k)) for k in range(1, 800)], "o_orderkey long, o_orderdate timestamp_ntz").coalesce(1).write.parquet(f"{folder}/orders.parquet")
    return folder


def test_every_rule_of_the_queries_changes_rows(spark, tables):
    applied = set(QUERIES["q14_rules_in_order"](spark, tables).selectExpr("explode(split(applied, ','))").distinct().toPandas().iloc[:, 0]) - {""}
    assert applied == {step[1] for step in field_queries.RULE_SQL}
    assert applied == set(rules.RULES) - {"fix_empty_description"}


@pytest.mark.parametrize("name", ["q14_rules_in_order", "n04_place_blocks", "n06_organizers", "p05_quoted_titles", "t02_short_years", "t07_date_ranges", "d10_looked_up"])
def test_agrees_with_sql(spark, tables, name):
    got = QUERIES[name](spark, tables)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tables}/orders.parquet/*.parquet'")
    want = con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(columns).collect()), key=repr)
    assert rows and rows == sorted(want.project(", ".join(columns)).fetchall(), key=repr)


def test_every_query_has_sql():
    assert len(NAMES) > 30 and set(NAMES) <= set(SQL)


def test_lookup_meets_by_pieces(spark):
    """Titles empty, shorter than a piece, with case, null; ties of length; another day."""
    poor = spark.createDataFrame([(1, "Ab", "d1", "x"), (2, "", "d1", "x"), (3, "SOMMER", "d1", "x"), (4, None, "d1", "x"), (5, "Ab", "d2", "x"), (6, "sommer", None, "x"), (7, "Ab", "d1", "long enough")], "id int, title string, date_start string, description string")
    raw = spark.createDataFrame([("Sommerfest", "d1", "tie one"), ("Sommerfest", "d1", "tie two"), ("cab", "d1", "a longer one"), (None, "d1", "no title, not read"), ("Sommer", "d1", "short")], "title string, date_start string, description string")
    assert {r.id: r.description for r in dedup.look_up_descriptions(poor, raw).collect()} == {1: "a longer one", 2: "a longer one", 3: "tie two", 4: "", 5: "", 6: "", 7: "long enough"}
    assert dedup.look_up_descriptions(poor, raw.limit(0)).count() == 7
    assert dedup.look_up_descriptions(poor.limit(0), raw).count() == 0
