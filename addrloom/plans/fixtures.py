"""Address-shaped tables derived from the star-schema tables; the same expressions serve Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REF = {
    "address_id": "'REF_' || lpad(cast(c_custkey as string), 7, '0')",
    "house_number": "cast(100 + (c_custkey % 37) * 7 as string)",
    "predir": "case c_custkey % 9 when 4 then 'N' when 5 then 'S' when 6 then 'E' when 7 then 'W' else '' end",
    "street_name": "upper(p_name)",
    "street_type": "case c_custkey % 6 when 0 then 'ST' when 1 then 'AVE' when 2 then 'DR' when 3 then 'RD' when 4 then 'LN' else 'CT' end",
    "suffixdir": "''",
    "unit_type": "case c_custkey % 11 when 3 then 'APT' else '' end",
    "unit_value": "case c_custkey % 11 when 3 then cast(c_custkey % 20 as string) else '' end",
    "city": "upper(translate(n_name, '_0123456789', ' ABCDEFGHIJ'))",
    "state": "'MS'",
    "zip_code": "cast(38600 + c_nationkey * 40 + c_custkey % 3 as string)",
    "source_quality": "cast(case c_mktsegment when 'FURNITURE' then 0.62 when 'BUILDING' then 0.92 else 0.8 end as double)",
    "ref_ord": "c_custkey",
}
#: Orders as structured queries: kind 1 no zip, 2 no type, 3 a street letter lost, 4 house + 2, 5 city letters swapped, 7 no city.
QRY = {
    "query_id": "'Q_' || lpad(cast(o_orderkey as string), 7, '0')",
    "true_match_id": "address_id",
    "noise_kind": "cast(o_orderkey % 8 as int)",
    "house_number": "case when o_orderkey % 8 = 4 then cast(cast(house_number as int) + 2 as string) else house_number end",
    "predir": "predir",
    "street_name": "case when o_orderkey % 8 = 3 then substr(street_name, 1, 1) || substr(street_name, 3) else street_name end",
    "street_type": "case when o_orderkey % 8 = 2 then '' else street_type end",
    "suffixdir": "''",
    "unit_type": "unit_type",
    "unit_value": "unit_value",
    "city": "case when o_orderkey % 8 = 7 then '' when o_orderkey % 8 = 5 then substr(city, 2, 1) || substr(city, 1, 1) || substr(city, 3) else city end",
    "state": "state",
    "zip_code": "case when o_orderkey % 8 = 1 then '' else zip_code end",
}
TEXT = "trim(house_number || ' ' || predir || ' ' || street_name || ' ' || street_type || ', ' || city || ' ' || state || ' ' || zip_code)"


def _select(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


SQL = f"""ref AS (SELECT {_select(REF)} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = c_custkey % 50),
qparts AS (SELECT {_select(QRY)} FROM orders JOIN ref ON ref_ord = o_custkey),
qry AS (SELECT *, {TEXT} AS query_address FROM qparts)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reference rows with ref_ord."""
    customer, nation, part = (table(spark, sf_dir, t) for t in ("customer", "nation", "part"))
    joined = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(part, part.p_partkey == customer.c_custkey % 50)
    return joined.selectExpr(*(f"{e} AS {n}" for n, e in REF.items()))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured queries with their text."""
    ref = reference(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    rows = orders.join(ref, orders.o_custkey == ref.ref_ord).selectExpr(*(f"{e} AS {n}" for n, e in QRY.items()))
    return rows.selectExpr("*", f"{TEXT} AS query_address")
