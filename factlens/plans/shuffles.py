"""The examples in a shuffled order that can be computed."""

from __future__ import annotations

from factlens.operators import shuffle as sh
from factlens.plans import sqlparts as sq
from factlens.plans.probe import BASE, Probe

QUERIES, ORACLE = {}, {}
KEY, BATCH_ROWS = 11, 32


def _pass(source: str) -> str:
    """SQL of one pass of the network over the numbers x of ``source``."""
    sql = f"SELECT uuid, n, lb, rb, x >> rb AS l, x & ((1::BIGINT << rb) - 1) AS r FROM {source}"
    for r in range(sh.ROUNDS):
        half, other, bits = ("l", "r", "lb") if r % 2 == 0 else ("r", "l", "rb")
        h = f"CAST(('0x' || substr(md5('{KEY}|{r}|' || CAST({other} AS VARCHAR)), 1, 8)) AS BIGINT)"
        sql = f"SELECT uuid, n, lb, rb, xor({half}, {h} & ((1::BIGINT << {bits}) - 1)) AS {half}, {other} FROM ({sql})"
    return f"SELECT uuid, n, lb, rb, (l << rb) | r AS x FROM ({sql})"


SHUFFLE_SQL = sq.with_(*BASE, sq.EXAMPLES_CTE, """numbered AS (
  SELECT uuid, row_number() OVER (ORDER BY uuid) - 1 AS x, count(*) OVER () AS n FROM examples
)""", """sized AS (
  SELECT uuid, x, n, CAST(bits // 2 AS INTEGER) AS lb, CAST(bits - bits // 2 AS INTEGER) AS rb
  FROM (SELECT *, greatest(2, length(bin(n - 1))) AS bits FROM numbered)
)""", f"walk AS ({_pass('sized')} UNION ALL {_pass('(SELECT * FROM walk WHERE x >= n)')})") + \
    f"SELECT uuid, x AS place, x // {BATCH_ROWS} AS batch FROM walk WHERE x < n"
SHUFFLE_SQL = SHUFFLE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)


def shuffled_examples(spark, d):
    e = Probe(spark, d).examples.select("uuid")
    return sh.shuffled(e, ["uuid"], KEY, BATCH_ROWS).select("uuid", "place", "batch")


QUERIES["shuffled_examples"], ORACLE["shuffled_examples"] = shuffled_examples, SHUFFLE_SQL
