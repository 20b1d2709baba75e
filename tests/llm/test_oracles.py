"""SQL on rows that the tables don't have: messages that quote, checked tokens, nulls and repeated rows."""

import compare
import duckdb
from test_conversations import frame, threads
from test_text_operators import HEX, SECRETS, token
from util import docs

from lakemill.llm import oracles, quotation, secrets, sharding


def test_quotation_sql_agrees_on_threads(spark):
    df = frame(spark, threads())
    con = duckdb.connect()
    con.register("c", df.toPandas())
    con.execute("create view conversations as select conv_id, turn, role, text from c")
    assert compare.differences(quotation.link(df), con, oracles.QUOTATIONS) == ""


def documents(df):
    con = duckdb.connect()
    con.register("d", df.toPandas())
    con.execute("create view documents as select * from d")
    return con


def test_secrets_sql_agrees_on_planted_secrets(spark):
    body = "k" * 30
    more = [token(p, body) + end for p in ("ghp_", "npm_") for end in ("", " x", "y", f" {token(p, body, False)}", f"-{HEX}")]
    df = docs(spark, [*SECRETS, *more], doc_id=[i % 20 for i in range(len(SECRETS) + len(more))])
    assert compare.differences(secrets.report(df), documents(df), oracles.SECRETS) == ""


def test_sharding_sql_agrees_on_repeated_rows_and_nulls(spark):
    df = docs(spark, ["a", "a", None, "", "é"] * 40, doc_id=[i % 7 if i % 9 else None for i in range(200)], source=[None if i % 4 == 0 else "hot" for i in range(200)])
    con = documents(df)
    con.execute("create or replace view documents as select doc_id::bigint as doc_id, text, source from d")
    assert compare.differences(sharding.shard(df), con, oracles.SHARDS) == ""
