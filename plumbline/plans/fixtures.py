"""Dirtied views of the given tables, defined once as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.readers import read_parquet, spread

PEOPLE = {
    "id": "c_custkey",
    "name": """CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN 'N/A'
         WHEN c_custkey % 31 = 0 THEN concat('  ', lower(c_name)) ELSE c_name END""",
    "email": """CASE c_custkey % 11 WHEN 0 THEN 'bad-email' WHEN 1 THEN 'test@test.com'
         WHEN 2 THEN NULL
         WHEN 3 THEN concat('u', CAST(c_custkey AS STRING), '@mail.example.co.uk')
         ELSE concat('u', CAST(c_custkey AS STRING), '@example.com') END""",
    "age": """CASE WHEN c_custkey % 29 = 0 THEN 150 WHEN c_custkey % 37 = 0 THEN -5
         WHEN c_custkey % 13 = 0 THEN NULL ELSE 18 + c_custkey % 60 END""",
    "score_text": """CASE WHEN c_custkey % 19 = 0 THEN 'twenty' WHEN c_custkey % 41 = 0 THEN '?'
         ELSE CAST(c_custkey % 100 AS STRING) END""",
    "phone": """CASE c_custkey % 9 WHEN 0 THEN '000-000-0000' WHEN 1 THEN '?'
         WHEN 2 THEN '123-45-6789' WHEN 3 THEN '4111 1111 1111 1111' ELSE '555-123-4567' END""",
    "country": """CASE c_custkey % 6 WHEN 0 THEN 'USA' WHEN 1 THEN 'us'
         WHEN 2 THEN 'United States' WHEN 3 THEN 'UK' ELSE 'India' END""",
    "status": """CASE WHEN c_custkey % 499 = 7 THEN 'actve' ELSE
         CASE c_custkey % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'active' WHEN 2 THEN 'ACTIVE'
         ELSE 'inactive' END END""",
    "signup_date": """CASE c_custkey % 12 WHEN 0 THEN '12/05/2023' WHEN 1 THEN '2023/05/12'
         WHEN 2 THEN 'yesterday' WHEN 3 THEN '2024-02-30' WHEN 4 THEN '95/06/01'
         WHEN 5 THEN '1850-01-01' WHEN 6 THEN '1900-01-01' ELSE '2023-05-12' END""",
    "salary": "CASE WHEN c_custkey % 97 = 0 THEN c_acctbal * 100 ELSE c_acctbal END",
    "quantity": "CASE WHEN c_custkey % 43 = 0 THEN 9999 ELSE 1 + c_custkey % 10 END",
    "notes": """CASE c_custkey % 101 WHEN 0 THEN '<script>alert(1)</script>'
         WHEN 1 THEN 'x; DROP TABLE t' WHEN 2 THEN '../../etc/passwd' WHEN 3 THEN 'a; cat f'
         WHEN 4 THEN 'from 10.0.0.1' ELSE c_mktsegment END""",
}
# The second version covers the whole table too: values shift, one column goes, one comes,
# one changes its type.
PEOPLE_V2 = {
    "id": "id", "name": "name", "email": "email",
    "age": "CASE WHEN id % 5 = 0 THEN NULL ELSE age END",
    "score_text": "score_text",
    "phone": "phone",
    "country": "CASE WHEN country = 'India' AND id % 2 = 0 THEN 'Brazil' ELSE country END",
    "status": "CASE WHEN status = 'actve' THEN 'pending' ELSE status END",
    "signup_date": "signup_date",
    "salary": "salary * 1.3",
    "quantity": "CAST(quantity AS DOUBLE)",
    "segment": "notes",
}


def _select(exprs: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in exprs.items())


PEOPLE_CTE = (f"base AS (SELECT {_select(PEOPLE)} FROM customer), "
              "people AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE id % 50 = 0)")
PEOPLE_V2_CTE = f"people_v2 AS (SELECT {_select(PEOPLE_V2)} FROM base)"

QUALITY_HISTORY = """
SELECT user_id AS dataset_id,
       CAST(floor((EXTRACT(DAY FROM ts) - 1) / 5) AS BIGINT) + 1 AS version,
       avg(CASE WHEN value > 100 THEN 100.0 ELSE value END) AS score
FROM events GROUP BY 1, 2"""
ALERTS = """
SELECT event_id AS alert_id, user_id AS dataset_id,
       CASE event_type WHEN 'error' THEN 'quality_degraded' WHEN 'purchase' THEN 'high_missing'
                       WHEN 'view' THEN 'drift_detected' ELSE 'anomaly_detected' END
         AS alert_type,
       CASE WHEN value >= 100 THEN 'critical' WHEN value >= 60 THEN 'high'
            WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity,
       ts AS triggered_at, event_id % 3 = 0 AS is_read
FROM events"""
DATASETS = ("SELECT c_custkey AS dataset_id, c_name AS name, c_mktsegment AS file_type "
            "FROM customer WHERE c_custkey % 5 <> 0")
VERSIONS = """
SELECT o_custkey AS dataset_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS version,
       CASE WHEN o_orderkey % 7 = 0 THEN 'delete' WHEN o_orderkey % 11 = 0 THEN 'restore'
            ELSE 'create' END AS event,
       CAST(floor(o_totalprice) AS BIGINT) AS row_count, o_orderdate AS event_time
FROM orders"""


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A given table; wide=True spreads small files over all cores for costly rules."""
    df = read_parquet(spark, f"{sf_dir}/{name}.parquet")
    return spread(df) if wide else df


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr(
        *[f"{e} AS `{n}`" for n, e in PEOPLE.items()])
    return base.unionAll(base.where("id % 50 = 0"))


def people_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr(
        *[f"{e} AS `{n}`" for n, e in PEOPLE.items()])
    return base.selectExpr(*[f"{e} AS `{n}`" for n, e in PEOPLE_V2.items()])


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run one of the SQL views above over the given tables."""
    return spark.sql(_braced(sql, tables), **{t: table(spark, sf_dir, t) for t in tables})


def _braced(sql: str, tables) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return sql
