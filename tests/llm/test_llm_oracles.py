"""The operators' SQL in DuckDB, on the driver's tables and on awkward rows."""

import duckdb
import pytest

from tests.llm.test_llm_native import AWKWARD
from tests.test_catalog import SF_DIR, canonical, duck  # noqa: F401
from windlass.llm import queries, rules, secrets, sharding

SQL = queries.oracle_sql()


def by_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return sorted(names), canonical(names, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    df = queries.queries()[name](spark, SF_DIR)
    assert (sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])) == by_sql(duck, SQL[name])


def test_awkward_rows_match_sql(spark):
    texts = [*AWKWARD, 'api_key = "abc.def-1" token: secret=abcdef', "AKIA" * 9 + " " + "0a" * 30, "aB3" * 9 + " 123e4567-e89b-12d3-a456-426614174000", "one two three four five six seven eight " * 3]
    docs = spark.createDataFrame([*enumerate(texts), (3, "a copy"), (None, "no id")], "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [tuple(r) for r in docs.collect()])
    made = {
        "op3_sharding": sharding.shard_documents(docs).select("doc_id", "slot", "shard"),
        "op5_secrets": secrets.digest(secrets.find_secrets(docs)),
        "op7_quality_rules": rules.measure(docs).drop("cleaned"),
    }
    for name, df in made.items():
        assert (sorted(df.columns), canonical(df.columns, [tuple(r) for r in df.collect()])) == by_sql(con, SQL[name]), name
