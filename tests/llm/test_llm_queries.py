"""The subpackage's queries on the smallest tables, and their SQL on these and on untidy rows."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from lexloom.llm import chat
from lexloom.llm.queries import ORACLE_SQL, QUERIES

from ..test_queries import DATA, con, rows  # noqa: F401

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_parity(spark, con, name):  # noqa: F811
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_tables
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_table(spark, name):
    n = QUERIES[name](spark, DATA).count()
    assert n == 200 if name not in ("op2_license_scan", "op8_decontaminate") else n > 0


def test_chat_sql_on_untidy_roles(spark, tmp_path):
    rng = random.Random(6)
    made = [(c, t, rng.choice(["system", "user", "assistant", "human", "tool", None]), rng.choice(["a", "b <|x|>", "", None])) for c in range(150) for t in range(rng.randrange(1, 8))]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = chat.formatted(df).toPandas(), c.sql(chat.SQL).df()
    assert rows(got) == rows(want) and got.relabelled.sum() and got.merged.sum() and got.inserted.sum()


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
