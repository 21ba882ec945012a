"""The domain relations over the star-schema tables: each a table and portable SQL expressions.

Spark builds them with select, so filters and column pruning reach the Parquet scan; the same
expressions give the DuckDB views that the oracle queries start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KEY = "CAST(c_custkey AS DOUBLE)"
_MAG = "(14 + (c_acctbal + 1000) / 1100)"
#: name -> (table, {column: expression}); {mjd} is the engine's form of a modified Julian date.
RELATIONS: dict[str, tuple[str, dict[str, str]]] = {
    "sources": (
        "customer",
        {
            "region_id": "CAST(c_nationkey AS BIGINT)",
            "source_id": "c_custkey",
            "ra": f"{_KEY} * 137.508e0 % 360",
            "dec": f"degrees(asin(2 * ({_KEY} * 0.754877666e0 % 1) - 1))",
            "mag": _MAG,
            "bp_rp": f"0.5 + 0.05e0 * {_MAG} + (c_custkey * 7919 % 997) / 2000e0 + CASE WHEN c_custkey % 41 = 7 THEN 3 ELSE 0 END",
            "pmra": "(c_custkey * 31 % 97 - 48) / 6e0 * CASE WHEN c_custkey % 53 = 9 THEN 6 ELSE 1 END",
            "pmdec": "(c_custkey * 57 % 89 - 44) / 6e0",
            "parallax": "(c_custkey * 17 % 53 - 4) / 10e0",
            "parallax_error": "0.1e0 + c_custkey % 7 / 20e0",
            "noise": "c_custkey * 13 % 29 / 30e0 + CASE WHEN c_custkey % 37 = 3 THEN 5 ELSE 0 END",
            "obj_type": "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'galaxy' WHEN 'BUILDING' THEN 'qso' WHEN 'MACHINERY' THEN 'unknown' ELSE 'star' END",
        },
    ),
    "companions": (
        "supplier",
        {
            "region_id": "CAST(s_nationkey AS BIGINT)",
            "source_id": "s_suppkey * 3",
            "ra": "CAST(s_suppkey AS DOUBLE) * 137.508e0 % 360",
            "dec": "degrees(asin(2 * (CAST(s_suppkey AS DOUBLE) * 0.754877666e0 % 1) - 1))",
            "mag": "14 + (s_acctbal + 1000) / 1100",
            "x": "CAST(s_suppkey * 37 % 101 AS DOUBLE)",
            "y": "CAST(s_suppkey * 53 % 103 AS DOUBLE)",
        },
    ),
    "points": (
        "events",
        {"source_id": "user_id", "band": "event_type", "seq": "event_id", "mjd": "{mjd}", "mag": "15 + value / 100", "magerr": "0.05e0 + event_id % 7 / 100e0"},
    ),
    "cmd": (
        "lineitem",
        {"region_id": "l_returnflag", "seq": "l_orderkey * 10 + l_linenumber", "mag": "l_quantity / 5 + 12", "colour": "l_extendedprice / l_quantity / 1000 % 3"},
    ),
    "anomalies": (
        "orders",
        {
            "region_id": "o_custkey % 25",
            "seq": "o_orderkey",
            "anomaly_type": "concat('type_', o_orderstatus)",
            "detector": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'lens' WHEN '2' THEN 'kinematic' WHEN '3' THEN 'wavelet' WHEN '4' THEN 'transient' ELSE 'variability' END",
            "score": "o_totalprice / 600000",
            "p_value": "(o_orderkey * 7919 % 10007 + 1) / 40028e0 * CASE WHEN o_orderkey % 11 = 0 THEN 0.001e0 ELSE 1 END",
            "mjd": "{order_mjd}",
        },
    ),
    "feedback": (
        "documents",
        {"seq": "doc_id", "type": "lang", "detector": "source", "score": "least(1, n_chars / 4000e0)"},
    ),
    "calls": (
        "conversations",
        {"purpose": "role", "conv_id": "conv_id", "turn": "turn", "text": "text", "provider": "concat('p', CAST(conv_id % 3 AS STRING))", "cached": "conv_id % 4 = 1"},
    ),
    "pixels": (
        "lineitem",
        {"image_id": "l_returnflag", "x": "CAST(l_partkey % 32 AS INT)", "y": "CAST(l_suppkey * 7 % 31 AS INT)", "epoch": "{epoch}", "v": "l_quantity + l_tax"},
    ),
    "vectors": ("embeddings", {"vec_id": "vec_id", "vec": "embedding", "label": "label"}),
}

_SPARK = {
    "mjd": "unix_micros(CAST(ts AS TIMESTAMP)) / 86400e6 + 40587",
    "order_mjd": "CAST(datediff(o_orderdate, DATE'1858-11-17') AS DOUBLE)",
    "epoch": "CAST(year(l_shipdate) AS INT)",
}
_DUCK = {"mjd": "epoch_us(ts) / 86400e6 + 40587", "order_mjd": "CAST(date_diff('day', DATE '1858-11-17', o_orderdate::DATE) AS DOUBLE)", "epoch": "CAST(year(l_shipdate) AS INT)"}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RELATIONS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{x.format(**_SPARK) if '{' in x else x} AS {c}" for c, x in columns.items()])


def duck(*names: str) -> str:
    """WITH and the relations, for a DuckDB query to go on with."""
    parts = []
    for name in names:
        table, columns = RELATIONS[name]
        parts.append(f"{name} AS (SELECT " + ", ".join(f"{x.format(**_DUCK) if '{' in x else x} AS {c}" for c, x in columns.items()) + f" FROM {table})")
    return "WITH " + ", ".join(parts)
