"""A deterministic timetable made from the order tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import spread

SCHED = """
SELECT ord, file, page, degree_name, academic_year_raw, semester, year, grp, day, start_time, end_time, sub_raw, room_raw,
  CASE fmt WHEN 0 THEN concat(name, ' - ', sub_raw, ' (', room_raw, ')')
           WHEN 1 THEN concat(name, ' (', room_raw, ') - ', sub_raw)
           WHEN 2 THEN concat(sub_raw, ' (', room_raw, ') ', name)
           WHEN 3 THEN concat(name, ' (', room_raw, ')')
           WHEN 4 THEN concat(name, ' - ', sub_raw, '* (', room_raw, ') ', 'Redes - 2B1 (SA1)')
           WHEN 5 THEN '- 2A (*) 2A2 (*)'
           ELSE concat('texto sin formato ', name) END AS cell_text
FROM (
  SELECT o_orderkey AS ord,
    concat('F', cast(c_nationkey AS varchar(10)), '.pdf') AS file,
    cast(1 + o_orderkey % 3 AS int) AS page,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS degree_name,
    CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '2025/2020' WHEN 2 THEN '2025/26' ELSE '2025/2026' END AS academic_year_raw,
    cast(1 + o_orderkey % 2 AS int) AS semester,
    cast(1 + c_nationkey % 4 AS int) AS year,
    concat(cast(1 + c_nationkey % 4 AS varchar(10)), chr(cast(65 + o_custkey % 3 AS int))) AS grp,
    CASE o_orderkey % 5 WHEN 0 THEN 'LUNES' WHEN 1 THEN 'MARTES' WHEN 2 THEN 'MIÉRCOLES' WHEN 3 THEN 'JUEVES' ELSE 'VIERNES' END AS day,
    concat(cast(8 + o_orderkey % 10 AS varchar(10)), ':00') AS start_time,
    concat(cast(CASE WHEN o_orderkey % 11 = 0 THEN 7 ELSE 8 + o_orderkey % 10 END AS varchar(10)), ':55') AS end_time,
    concat(cast(1 + c_nationkey % 4 AS varchar(10)), chr(cast(65 + (o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) % 3 AS int)),
           CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE cast(o_orderkey % 4 AS varchar(10)) END) AS sub_raw,
    CASE o_orderkey % 8 WHEN 0 THEN 'NA7' WHEN 1 THEN 'OA 4' WHEN 2 THEN 'LAB' WHEN 3 THEN '*' WHEN 4 THEN 'PEND. ASIG.'
                        WHEN 5 THEN '16:30' WHEN 6 THEN 'SA5B/OL8' ELSE ' ' END AS room_raw,
    CASE (o_custkey + o_orderkey) % 6 WHEN 0 THEN 'Programación Avanzada' WHEN 1 THEN 'De Calidad' WHEN 2 THEN 'GD. 202012-SISTEMAS ELÉCTRICOS'
         WHEN 3 THEN 'Señales  y Sistemas' WHEN 4 THEN 'I-2' ELSE 'Informática' END AS name,
    cast(o_orderkey % 7 AS int) AS fmt
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey) t
"""


def sched(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(SCHED, orders=spread(read("orders")), customer=read("customer"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timetable as the cells that records are built from."""
    return sched(spark, sf_dir).selectExpr("*", "cast(null as string) as degree_code")
