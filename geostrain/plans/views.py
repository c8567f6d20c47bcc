"""Geodetically shaped views of the star-schema tables, for Spark and DuckDB.

One text serves both engines; only the difference of dates is spelled
differently.  Scans read the columns that a view needs and nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_sites": """
SELECT CAST(s_suppkey AS BIGINT) AS site,
       -120e0 + ((s_suppkey * s_suppkey * 37 + s_suppkey * 101) % 1009) / 100e0 AS lon,
       33e0 + ((s_suppkey * s_suppkey * 53 + s_suppkey * 211) % 997) / 100e0 AS lat,
       s_acctbal / 1000e0 AS v, 0.5e0 + (s_suppkey % 7) / 10e0 AS sv
FROM [supplier]""",
    "v_series": """
SELECT CAST(l_suppkey AS BIGINT) AS site, CAST(l_shipdate AS DATE) AS d, SUM(l_quantity) / 1000e0 AS disp
FROM [lineitem] GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "v_steps": """
SELECT DISTINCT CAST(o_custkey AS BIGINT) AS site, CAST(o_orderdate AS DATE) AS d
FROM [orders] WHERE o_custkey IN (SELECT s_suppkey FROM [supplier]) AND o_totalprice > 4e5""",
    "v_acq": "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS d FROM [orders]",
    "v_ifg": "SELECT a.d AS date1, b.d AS date2 FROM [v_acq] a JOIN [v_acq] b ON days_between(a.d, b.d) BETWEEN 1 AND 92",
    "v_pixel": """
SELECT CAST(floor(l_partkey / 50e0) AS INT) AS y, CAST(l_partkey % 50 AS INT) AS x,
       CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d, SUM(l_quantity) / 100e0 AS disp
FROM [lineitem] GROUP BY 1, 2, 3""",
    "v_los": """
SELECT CAST(floor(l_partkey / 50e0) AS INT) AS y, CAST(l_partkey % 50 AS INT) AS x, l_linenumber AS track,
       SUM(l_quantity) / 10e0 AS los, 1e0 + l_linenumber / 10e0 AS std, 30e0 + l_linenumber * 2e0 AS inc,
       CASE WHEN l_linenumber % 2 = 0 THEN 80e0 ELSE -80e0 END AS azi
FROM [lineitem] GROUP BY 1, 2, 3""",
    "v_events": "SELECT user_id AS site, CAST(ts AS DATE) AS d, count(*) AS n FROM [events] GROUP BY 1, 2",
}


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\[(\w+)\]", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table that is none."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = re.sub(r"days_between\(([^,]+), ([^)]+)\)", r"datediff(\2, \1)", VIEWS[name])
    frames = {n: view(spark, sf_dir, n) for n in _names(text)}
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **frames)


def duck(body: str, *names: str) -> str:
    """DuckDB SQL: ``body`` under the views it uses.

    ``body`` may begin with further common tables, as ``name AS (...), ... SELECT``.
    """
    needed: list[str] = []

    def need(n: str) -> None:
        if n in VIEWS and n not in needed:
            for m in _names(VIEWS[n]):
                need(m)
            needed.append(n)

    for n in names or [v for v in VIEWS if re.search(rf"\b{v}\b", body)]:
        need(n)
    tables = [f"{n} AS ({re.sub(r'\[(\w+)\]', r'\1', VIEWS[n]).strip()})" for n in needed]
    text = body.strip()
    if tables:
        text = "WITH " + ", ".join(tables) + (", " if re.match(r"\w+ AS \(", text) else " ") + text
    elif re.match(r"\w+ AS \(", text):
        text = "WITH " + text
    return re.sub(r"days_between\(([^,()]+), ([^,()]+)\)", r"datediff('day', \1, \2)", text)
