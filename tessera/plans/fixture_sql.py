"""The fixture recipes of ``plans.fixtures`` as DuckDB SQL (for the oracle).

``with_fixtures(sql)`` prepends a ``WITH`` clause holding every fixture the
statement names (and the fixtures those depend on).
"""

from __future__ import annotations

import re

from tessera.plans.fixtures import BACKUP_ALIAS, METRICS, SECTORS, SORRY, SUFFIXES

U = "(('0x'||substr(md5({k}),1,8))::BIGINT / 4294967296.0)"


def sql_uniform(seed: str, *keys: str) -> str:
    """DuckDB twin of ``tessera.functions.random.uniform``."""
    parts = " || '|' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return U.format(k=parts)


def _metric_value(j: int) -> str:
    base = f"CAST(CAST(p_retailprice * {j + 1} AS DECIMAL(14,2)) AS VARCHAR)"
    if j == 3:
        base = "CAST(p_size AS VARCHAR) || ',500'"
    sfx = "[" + ", ".join(f"'{s}'" for s in SUFFIXES) + f"][(p_partkey + {j}) % 4 + 1]"
    return f"({base} || {sfx})"


def _html_metrics() -> str:
    rows = []
    for j, m in enumerate(METRICS):
        val = _metric_value(j)
        if m == "Price/Sales":
            val = f"(CASE WHEN p_partkey % 10 = 0 THEN 'N/A' ELSE {val} END)"
        row = f"('<tr><td>{m}</td><td><span>' || {val} || '</span></td></tr>' || chr(10))"
        if m == "Revenue":
            row = f"(CASE WHEN p_partkey % 9 = 0 THEN '' ELSE {row} END)"
        if m == "Market Cap":
            row = f"(CASE WHEN p_partkey % 6 = 0 THEN '' ELSE {row} END)"
        rows.append(row)
    sorry = SORRY.replace("'", "''")
    body = " || ".join(["'<html><body><table>'"] + rows + ["'</table>'",
                       f"(CASE WHEN p_partkey % 17 = 0 THEN '<p>{sorry}.</p>' ELSE '' END)",
                       "'</body></html>'"])
    return f"SELECT CAST(p_partkey AS VARCHAR) AS ticker, {body} AS html FROM part"


def _html_backup() -> str:
    rows = []
    for j, m in enumerate(METRICS):
        alias = BACKUP_ALIAS.get(m, m) or m
        val = f"(CASE WHEN p_partkey % 8 = 0 THEN '-' ELSE {_metric_value(j)} END)"
        rows.append(f"('<tr><td>{alias}</td><td><b>' || {val} || '</b></td></tr>' || chr(10))")
    body = " || ".join(["'<html><body><table>'"] + rows + ["'</table>'",
                       "(CASE WHEN p_partkey % 13 = 0 THEN '<p>Ticker not found</p>' ELSE '' END)",
                       "'</body></html>'"])
    return f"SELECT CAST(p_partkey AS VARCHAR) AS ticker, {body} AS html FROM part"


def _sector_html() -> str:
    names = "[" + ", ".join(f"'{s}'" for s in SECTORS) + "]"
    return ("SELECT CAST(p_partkey AS VARCHAR) AS ticker, '<div>' || CASE WHEN p_partkey % 12 < 11 "
            f"THEN '<span class=\"sector\">' || {names}[p_partkey % 12 + 1] || '</span>' "
            "ELSE '<span>Unknown</span>' END || '</div>' AS html FROM part")


def _cells_from(filter_sql: str, cohort: bool) -> str:
    pid = ("CASE WHEN vec_id % 37 = 0 THEN 'z' || CAST(vec_id AS VARCHAR) ELSE CAST(vec_id AS VARCHAR) END"
           if cohort else "CAST(vec_id AS VARCHAR)")
    beta = ("CAST(v AS DOUBLE)" if cohort else
            "CASE WHEN pos IN (3, 17) AND vec_id % 50 = 0 THEN NULL ELSE CAST(v AS DOUBLE) END")
    coh = "['a','b','c'][vec_id % 3 + 1] AS cohort, " if cohort else ""
    return (f"SELECT {coh}{pid} AS patient_id, 'cg' || printf('%02d', pos) AS feature, "
            f"{beta} AS beta FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS pos, "
            f"unnest(embedding) AS v FROM embeddings WHERE {filter_sql}) e")


def _status(words) -> str:
    h, l, m = words
    return (f"CASE WHEN vec_id % 11 = 0 THEN NULL WHEN label % 3 = 0 THEN '{h}' "
            f"WHEN label % 3 = 1 THEN '{l}' ELSE '{m}' END")


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PRICE = f"sum({CENTS}) / (sum(CAST(l_quantity AS BIGINT)) * 100.0)"

FIXTURES: dict[str, str] = {
    "series": (f"SELECT l_suppkey AS tk, CAST(l_shipdate AS DATE) AS dt, {PRICE} AS px FROM lineitem GROUP BY 1, 2"),
    "nation_series": ("SELECT 'n' || printf('%02d', s_nationkey) AS tk, CAST(l_shipdate AS DATE) AS dt, "
                      f"{PRICE} AS px FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"),
    "index_series": f"SELECT CAST(l_shipdate AS DATE) AS dt, {PRICE} AS sp FROM lineitem GROUP BY 1",
    "prices_wide": ("SELECT CAST(l_shipdate AS DATE) AS dt, "
                    + ", ".join(f"sum(CASE WHEN s_nationkey = {n} THEN {CENTS} END) / "
                                f"(sum(CASE WHEN s_nationkey = {n} THEN CAST(l_quantity AS BIGINT) END) * 100.0) "
                                f"AS n{n:02d}" for n in range(25))
                    + " FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"),
    "offsets": "SELECT z, 7 * z AS days FROM range(1, 9) t(z)",
    "cells": _cells_from("true", cohort=False),
    "meta": f"SELECT CAST(vec_id AS VARCHAR) AS patient_id, {_status(('Healthy', 'Lung; High Blood Pressure', 'Heme'))} AS status FROM embeddings",
    "clinic": f"SELECT CAST(vec_id AS VARCHAR) AS patient_id, {_status(('Healthy', 'LUNG', 'heme'))} AS clinic FROM embeddings",
    "features": ("SELECT DISTINCT feature FROM cells WHERE CAST(substr(feature, 3) AS INTEGER) % 2 = 0 "
                 "UNION ALL SELECT 'cg_absent_1' UNION ALL SELECT 'cg_absent_2'"),
    "cohorts": _cells_from("true", cohort=True),
    "target": ("SELECT CAST(vec_id AS VARCHAR) AS patient_id, CASE WHEN vec_id % 13 = 0 THEN NULL ELSE "
               "30.0::DOUBLE + 20.0::DOUBLE * CAST(embedding[1] AS DOUBLE) - 10.0::DOUBLE * CAST(embedding[6] AS DOUBLE) "
               "+ 0.5::DOUBLE * label END AS y FROM embeddings"),
    "population": "SELECT c_custkey AS id, c_acctbal AS pace FROM customer",
    "disease": ("SELECT c_custkey AS id, CAST(coalesce(cnt, 0) % 4 AS BIGINT) AS n FROM customer LEFT JOIN "
                "(SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"),
    "scores": (f"SELECT vec_id AS id, CAST(label > 4 AS INTEGER) AS y, 0.7::DOUBLE * {sql_uniform('scores', 'vec_id')} "
               "+ 0.3::DOUBLE * CAST(label > 4 AS INTEGER) AS p FROM embeddings"),
    "preds": (f"SELECT patient_id AS id, y, y + ({sql_uniform('preds', 'patient_id')} - 0.5::DOUBLE) * 4.0::DOUBLE "
              "AS yhat FROM target WHERE y IS NOT NULL"),
    "html_metrics": _html_metrics(),
    "html_backup": _html_backup(),
    "sector_html": _sector_html(),
    "articles": ("SELECT doc_id, substr(text, 1, 40) AS title, "
                 "text AS content FROM documents"),
    "qa": ("SELECT conv_id, turn, text AS question, next_text AS answer FROM (SELECT conv_id, turn, role, text, "
           "lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, "
           "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations) c "
           "WHERE role = 'user' AND next_role = 'assistant'"),
    "labelled_docs": "SELECT * FROM documents JOIN labels USING (doc_id)",
    "class_items": ("SELECT p_partkey AS item_id, p_type AS class, '/graphs/' || p_type || '/' || "
                    "CAST(p_partkey AS VARCHAR) || ['.png', '.PNG', '.jpg', '.jpeg', '.txt'][p_partkey % 5 + 1] AS path "
                    "FROM part"),
}

_ORDER = list(FIXTURES)


def _needed(sql: str, seen: set[str]) -> None:
    for name in FIXTURES:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            seen.add(name)
            _needed(FIXTURES[name], seen)


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with CTEs for every fixture it (transitively) uses."""
    seen: set[str] = set()
    _needed(sql, seen)
    if not seen:
        return sql
    ctes = ",\n".join(f"{n} AS ({FIXTURES[n]})" for n in _ORDER if n in seen)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
