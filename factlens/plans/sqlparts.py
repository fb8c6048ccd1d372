"""DuckDB SQL fragments mirroring factlens.plans.fixtures (oracle side)."""

from __future__ import annotations

from factlens.functions.text import TOKEN_PATTERN
from factlens.plans.fixtures import RELATIONS


def H(expr: str) -> str:
    """SQL twin of functions.hashing.h32 for one string expression."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT)"


def HS(*exprs: str) -> str:
    """h32 of several parts joined by '|'."""
    return H(" || '|' || ".join(f"CAST({e} AS VARCHAR)" for e in exprs))


def TOKENS(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN_PATTERN}'))"


def WORDS(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN_PATTERN}')"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RELATIONS_CTE = "relations(rel, template, type) AS (VALUES " + ", ".join(
    f"({_lit(r)}, {_lit(t)}, {_lit(ty)})" for r, t, ty in RELATIONS) + ")"

RAW_FACTS_CTE = """raw_facts AS (
  SELECT 'located_in' AS rel, n_name AS subj, r_name AS obj,
         'located_in_' || CAST(n_nationkey AS VARCHAR) AS uuid
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'segment', c_name, c_mktsegment, 'segment_' || CAST(c_custkey AS VARCHAR) FROM customer
  UNION ALL
  SELECT 'brand', p_name || ' ' || CAST(p_partkey AS VARCHAR), p_brand,
         'brand_' || CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL
  SELECT 'supplies', s_name, p_brand,
         'supplies_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR)
           || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR)
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT 'region_no', r_name, 'R' || CAST(r_regionkey AS VARCHAR),
         'region_no_' || CAST(r_regionkey AS VARCHAR) FROM region
)"""

VOCAB_CTE = f"""vocab AS (
  SELECT DISTINCT obj AS token FROM raw_facts WHERE {H('obj')} % 5 <> 0
)"""

FILLED_CTE = """filled AS (
  SELECT f.uuid, f.rel, r.type, f.subj, f.obj AS y,
         replace(replace(r.template, '[X]', f.subj), '[Y]', '[MASK]') AS x
  FROM raw_facts f JOIN relations r ON f.rel = r.rel
)"""

DEDUP_CTE = """dedup AS (
  SELECT * FROM filled
  QUALIFY row_number() OVER (PARTITION BY rel, subj, y ORDER BY uuid) = 1
)"""

EXAMPLES_CTE = f"""examples AS (
  SELECT * FROM dedup
  WHERE coalesce(length(y), 0) > 0 AND coalesce(length(subj), 0) > 0
    AND {TOKENS('x')} <= 100
    AND y IN (SELECT token FROM vocab)
)"""

LOGITS_CTE = f"""cands AS (SELECT rel, obj AS token, count(*) AS cnt FROM raw_facts GROUP BY rel, obj),
logits AS (
  SELECT e.uuid, c.token, ln(1.0e0 + c.cnt) + xor({H('e.uuid')}, {H('c.token')}) / 4294967296.0e0 AS logit
  FROM examples e JOIN cands c ON e.rel = c.rel
)"""


def topk_ctes(logits: str = "logits", keys: str = "uuid", k: int = 20, prefix: str = "",
              allowed: str = "token IN (SELECT token FROM vocab)") -> str:
    """allowed -> softmax -> top-k -> prediction lists, keyed by ``keys``."""
    p = prefix
    return f"""{p}allowed AS (SELECT * FROM {logits} WHERE {allowed}),
{p}mx AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY {keys})) AS e FROM {p}allowed),
{p}sm AS (SELECT *, e / sum(e) OVER (PARTITION BY {keys}) AS prob FROM {p}mx),
{p}ranked AS (
  SELECT {keys}, token, logit, prob,
         row_number() OVER (PARTITION BY {keys} ORDER BY logit DESC, token ASC) AS rank
  FROM {p}sm QUALIFY rank <= {k}
),
{p}preds AS (
  SELECT {keys}, list(token ORDER BY rank) AS preds, list(prob ORDER BY rank) AS probs
  FROM {p}ranked GROUP BY {keys}
)"""


def metric_exprs(preds: str = "preds", probs: str = "probs", targets: str = "targets") -> str:
    """p_at_k / mrr / target_likelihood over lists (lower-cased on both sides)."""
    lp = f"list_transform(coalesce({preds}, []::VARCHAR[]), lambda p: lower(p))"
    lt = f"list_transform(coalesce({targets}, []::VARCHAR[]), lambda t: lower(t))"
    parts = [f"coalesce(list_has_any(list_slice({lp}, 1, {k}), {lt}), false) AS p_at_{k}" for k in (1, 3, 5, 10, 20)]
    pos = f"coalesce(list_position({lp}, t), 0)"
    parts.append(f"coalesce(list_max(list_transform({lt}, lambda t: CASE WHEN {pos} > 0 THEN 1.0e0 / {pos} ELSE 0.0e0 END)), 0.0e0) AS mrr")
    parts.append(f"coalesce(list_max(list_transform({lt}, lambda t: CASE WHEN {pos} > 0 THEN coalesce({probs}, []::DOUBLE[])[{pos}] ELSE 0.0e0 END)), 0.0e0) AS target_likelihood")
    return ",\n  ".join(parts)


METRIC_COLS = ["p_at_1", "p_at_3", "p_at_5", "p_at_10", "p_at_20", "mrr", "target_likelihood"]


def avg_metrics(round_to: int | None = None) -> str:
    if round_to is None:
        return ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}" for c in METRIC_COLS)
    return ", ".join(f"round(avg(CAST({c} AS DOUBLE)), {round_to}) AS {c}" for c in METRIC_COLS)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
