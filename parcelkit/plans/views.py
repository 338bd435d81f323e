"""Plan tables derived from the driver's tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.paths import numbered

#: The number of a fragment in its collection, as SQL.
NUMBER = """row_number() OVER (PARTITION BY l_suppkey % 8
         ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
                  l_discount, l_tax, l_shipdate) AS drawing_index"""
#: The columns it is counted by, as those have them that ask for no number.
ORDER = tuple(f"_{c.strip()}" for c in NUMBER.split("ORDER BY")[1].split(")")[0].split(","))

VIEWS = {
    "v_fragments": ("lineitem", f"""
SELECT CAST(l_suppkey % 8 AS INT) AS collection_id,
       {NUMBER},
       CAST(l_partkey  %  950 AS DOUBLE) * 1.2 AS x0,
       CAST(l_orderkey % 1350 AS DOUBLE) * 1.2 AS y0,
       l_quantity / 5.0 AS w, 0.5 + l_discount * 60.0 AS h,
       CASE l_returnflag || l_linestatus WHEN 'RF' THEN '#ff0000' WHEN 'AF' THEN '#ffffff'
            WHEN 'NO' THEN '#d9483f' WHEN 'NF' THEN '#000000' WHEN 'RO' THEN '#86b37f' END AS fill_hex,
       CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN '#222222' ELSE '#ffffff' END AS stroke_hex,
       l_tax * 40.0 AS stroke_width,
       CASE l_linenumber % 4 WHEN 0 THEN '[4 2] 0' WHEN 1 THEN '[] 0' WHEN 2 THEN NULL ELSE '[1 1] 2' END AS dashes,
       CASE WHEN l_linenumber % 2 = 1 THEN 'tri' ELSE 'rect' END AS shape
FROM lineitem
"""),
    "v_tiles": ("lineitem", """
SELECT CAST(l_suppkey % 8 AS INT) AS collection_id, CASE l_linenumber % 3 WHEN 0 THEN '#86b37f' WHEN 1 THEN '#d9483f' END AS fill_hex,
       CAST(l_partkey % 70 AS DOUBLE) * 4.0 AS x0, CAST(l_orderkey % 50 AS DOUBLE) * 4.0 AS y0, l_orderkey * 8 + l_linenumber AS drawing_index
FROM lineitem
"""),
    "v_spans": ("part", """
SELECT CAST(p_partkey % 8 AS INT) AS collection_id, p_partkey AS span_index,
       CASE p_partkey % 20 WHEN 0 THEN 'B' WHEN 1 THEN 'BI' WHEN 2 THEN 'BV' WHEN 3 THEN 'BH' WHEN 4 THEN 'BU'
            WHEN 5 THEN 'BX.c' WHEN 6 THEN 'BX p' WHEN 7 THEN 'BX-r' WHEN 8 THEN 'R' WHEN 9 THEN 'RI' WHEN 10 THEN 'RX'
            WHEN 11 THEN 'S' WHEN 12 THEN 'SO' WHEN 13 THEN 'SV' WHEN 14 THEN 'SC' WHEN 15 THEN 'SX'
            WHEN 16 THEN 'Z.51a' WHEN 17 THEN 'DS' WHEN 18 THEN 'legenda' ELSE 'návrh plochy' END AS raw_text,
       CAST(p_partkey * 37 % 1160 AS DOUBLE) AS x0, CAST(p_partkey * 53 % 1680 AS DOUBLE) AS y0,
       CAST(p_partkey * 37 % 1160 AS DOUBLE) + 16.0 AS x1, CAST(p_partkey * 53 % 1680 AS DOUBLE) + 12.0 AS y1,
       6.0 + p_size % 8 AS font_size, p_brand AS font_name
FROM part
"""),
    "v_collections": ("supplier", """
SELECT CAST(s_suppkey % 8 AS INT) AS collection_id, CAST(s_suppkey AS INT) AS page_index,
       CAST(s_suppkey * 131 % 2400 AS INT) AS drawing_count, CAST(s_nationkey % 3 AS INT) AS image_count,
       CAST(s_suppkey % 5 AS INT) * 40 AS text_span_count,
       CASE WHEN s_suppkey % 7 = 0 THEN 'HLAVNÍ VÝKRES Z12' WHEN s_suppkey % 11 = 0 THEN 'ÚPLNÉ ZNĚNÍ' ELSE s_name END AS page_text
FROM supplier
"""),
    "v_features": ("orders", """
SELECT CAST(o_custkey % 8 AS INT) AS collection_id, o_orderkey AS fid,
       CASE o_orderstatus WHEN 'F' THEN 'RZVP' WHEN 'O' THEN 'ZMEN' ELSE 'CUST' END AS layer,
       CASE o_custkey % 12 WHEN 0 THEN 'BI' WHEN 1 THEN 'SV' WHEN 2 THEN 'Z' WHEN 3 THEN 'T' WHEN 4 THEN 'X' WHEN 5 THEN 'QQ'
            WHEN 6 THEN 'BX.c' WHEN 7 THEN 'LU.h' WHEN 8 THEN 'K' WHEN 9 THEN 'MO' WHEN 10 THEN 'RI' ELSE NULL END AS class,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'STAV' WHEN '2' THEN 'návrh změny' WHEN '3' THEN 'územní rezerva'
            WHEN '4' THEN 'zastavitelné plochy' ELSE NULL END AS type_text,
       CASE WHEN o_custkey % 9 = 0 THEN 'Z' || CAST(o_custkey % 40 AS STRING) END AS text_id,
       CASE o_orderkey % 4 WHEN 0 THEN '#d9483f' WHEN 1 THEN '#d98989' WHEN 2 THEN '#ffffff' END AS style_hex,
       o_totalprice / 100.0 AS area
FROM orders
"""),
    "v_review_events": ("events", """
SELECT event_id, ts, CAST(user_id % 8 AS INT) AS collection_id, user_id AS target_id,
       CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'annotate' WHEN 'purchase' THEN 'approve' WHEN 'signup' THEN 'label' ELSE 'override' END AS action,
       100.0 AS area_before, value AS area_after, props AS note_json
FROM events
"""),
    "v_sources": ("pages", """
SELECT page_id AS source_id, url,
       CASE WHEN page_id % 5 = 0 THEN 'ftp' || substr(url, 5) ELSE url || '&n=a b' END AS raw_url,
       length(html) AS n_chars, CASE WHEN page_id % 3 = 0 THEN 'application/json' ELSE 'application/pdf' END AS content_type
FROM pages
"""),
}


def view(spark: SparkSession, sf_dir: str, name: str, number: bool = True) -> DataFrame:
    """One of VIEWS over the Parquet tables in ``sf_dir``. NUMBER is counted in chunks of its first column, since as a window it puts a collection into one task.

    Without ``number``, ORDER stands in its place, for those that need the order of a few rows only.
    """
    base, sql = VIEWS[name]
    rows = spark.sql(sql.replace(NUMBER, ", ".join(f"{k[1:]} AS {k}" for k in ORDER)).replace(f"FROM {base}", "FROM {rows}"), rows=spark.read.parquet(f"{sf_dir}/{base}.parquet"))
    if NUMBER not in sql or not number:
        return rows
    names = [c for c in rows.columns if c not in ORDER]
    out = numbered(rows, "drawing_index", *ORDER)
    return out.select(names[0], F.col("drawing_index").cast("int").alias("drawing_index"), *names[1:])


def with_views(body: str, *names: str) -> str:
    """``body`` (a SELECT, or CTEs that start with a comma) with the named views as CTEs."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in names)
    return f"WITH {ctes}{body}" if body.lstrip().startswith(",") else f"WITH {ctes} {body}"
