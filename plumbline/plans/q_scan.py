"""Security and PII scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.operators import pii, security
from plumbline.plans import sqltext as s
from plumbline.plans.fixtures import people, table
from plumbline.plans.registry import query


def threat(v: str, name: str) -> str:
    if name == "null_byte":
        return f"contains({v}, chr(0))"
    return s.match(v, vocab.THREATS[name][0])


def _counts_cte(cells: str) -> str:
    parts = [f"""SELECT "column", '{t}' AS threat_type, count_if({threat('v', t)}) AS n,
      '{sev}' AS severity, {w} AS weight FROM {cells} GROUP BY 1"""
             for t, (_, sev, w) in vocab.THREATS.items()]
    return f"threats AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0)"


COUNTS = _counts_cte("cells")
_PAGE_CELLS = s.cells(("url", "html"), "pages")
_DOC_CELLS = s.cells(("text", "lang", "source"), "documents")


def _finding_rows(source: str, key: str, names) -> str:
    rows = []
    for n in names:
        for t, (pattern, sev, _) in vocab.THREATS.items():
            got = "chr(0)" if t == "null_byte" else f"regexp_extract({n}, '{pattern}', 0)"
            rows.append(f"SELECT {key}, '{n}' AS \"column\", '{t}' AS threat_type, "
                        f"'{sev}' AS severity, {n} AS value, "
                        f"{got} AS matched_pattern FROM {source} "
                        f"WHERE {threat(n, t)}")
    return " UNION ALL ".join(rows)


@query("security_findings", f"{s.people()} {_finding_rows('people', 'id', s.STRINGS)}")
def security_findings(spark, d):
    return security.findings(people(spark, d), ["id"])


@query("security_findings_pages", _finding_rows("pages", "page_id", ("url", "html")))
def security_findings_pages(spark, d):
    return security.findings(table(spark, d, "pages", wide=True), ["page_id"])


@query("security_threats", f"{s.people(s.cells(s.STRINGS), COUNTS)} SELECT * FROM threats")
def security_threats(spark, d):
    return security.threat_counts(people(spark, d))


_SUMMARY = """SELECT threat_type, severity, CAST(sum(n) AS BIGINT) AS occurrences,
  string_agg("column", ',' ORDER BY "column") AS columns FROM threats GROUP BY 1, 2"""


def _summary(df):
    return security.summary(security.threat_counts(df)).withColumn(
        "columns", F.array_join("columns", ","))


@query("security_summary", f"{s.people(s.cells(s.STRINGS), COUNTS)} {_SUMMARY}")
def security_summary(spark, d):
    return _summary(people(spark, d))


@query("security_summary_documents", f"WITH {_DOC_CELLS}, {COUNTS} {_SUMMARY}")
def security_summary_documents(spark, d):
    return _summary(table(spark, d, "documents", wide=True).drop("doc_id", "n_chars"))


@query("security_verdict", f"""{s.people(s.cells(s.STRINGS), COUNTS)}
SELECT CAST(sum(n) AS BIGINT) AS total_threats, bool_or(severity = 'critical') AS has_critical,
  string_agg(DISTINCT "column", ',') AS columns_affected,
  CAST(sum(weight) AS BIGINT) AS score_deduction FROM threats""")
def security_verdict(spark, d):
    return security.verdict(security.threat_counts(people(spark, d))).withColumn(
        "columns_affected", F.array_join("columns_affected", ","))


@query("security_display", f"""{s.people()} SELECT id, "column", threat_type, value FROM (
{_finding_rows('people', 'id', s.STRINGS)}) ORDER BY id, "column", threat_type LIMIT 100""")
def security_display(spark, d):
    """The findings list a report shows: the first hundred in a fixed order."""
    found = security.findings(people(spark, d), ["id"])
    return security.display(found, ["id"]).select("id", "column", "threat_type", "value")


def _hit(v: str, kind: str) -> str:
    cond = s.match(v, vocab.PII_PATTERNS[kind])
    return f"({cond} AND {s.luhn(v)})" if kind == "credit_card" else cond


def _pii_counts(cells: str) -> str:
    parts = [f"""SELECT "column", count(*) AS total, '{k}' AS pii_type, {i} AS type_order,
      count_if({_hit('v', k)}) AS matches FROM {cells} WHERE v IS NOT NULL GROUP BY 1"""
             for i, k in enumerate(vocab.PII_PATTERNS)]
    return f"pii AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE matches > 0)"


PII_COUNTS = _pii_counts("cells")
_HINT = "CASE lower(trim(\"column\")) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in vocab.PII_NAME_HINTS.items()) + " END"
PII_COLUMNS = f"""pii_columns AS (SELECT "column", pii_type, CASE WHEN {_HINT} = pii_type
  THEN 'high' WHEN matches * 100.0 / total > 80 THEN 'high'
  WHEN matches * 100.0 / total > 30 THEN 'medium' ELSE 'low' END AS confidence,
  matches AS match_count, total AS total_rows,
  round(matches / CAST(total AS DOUBLE), 4) AS match_ratio
  FROM (SELECT *, row_number() OVER (PARTITION BY "column"
    ORDER BY matches DESC, type_order) AS r FROM pii) WHERE r = 1)"""


@query("pii_matches", f"""{s.people(s.cells(), PII_COUNTS)}
SELECT "column", total, pii_type, matches FROM pii""")
def pii_matches(spark, d):
    return pii.match_counts(people(spark, d)).drop("type_order")


@query("pii_columns", f"{s.people(s.cells(), PII_COUNTS, PII_COLUMNS)} SELECT * FROM pii_columns")
def pii_columns(spark, d):
    return pii.columns(pii.match_counts(people(spark, d)))


@query("pii_documents", f"""WITH {s.cells(('doc_id', 'text', 'lang', 'source', 'n_chars'),
                                          'documents')}, {PII_COUNTS}, {PII_COLUMNS}
SELECT * FROM pii_columns""")
def pii_documents(spark, d):
    return pii.columns(pii.match_counts(table(spark, d, "documents", wide=True)))


@query("pii_risk", f"""{s.people(s.cells(), PII_COUNTS, PII_COLUMNS)}
SELECT count(*) AS pii_columns, CASE WHEN count_if(confidence = 'high') >= 1 THEN 'high'
  WHEN count_if(confidence = 'medium') >= 2 THEN 'medium' WHEN count(*) > 0 THEN 'low'
  ELSE 'none' END AS risk_level FROM pii_columns""")
def pii_risk(spark, d):
    return pii.risk(pii.columns(pii.match_counts(people(spark, d))))


_PICK = " OR ".join(f"(pii_type = '{k}' AND {_hit('v', k)})" for k in vocab.PII_PATTERNS)


@query("pii_samples", f"""{s.people(s.cells(), PII_COUNTS, PII_COLUMNS,
  f'hits AS (SELECT DISTINCT "column", v FROM cells JOIN pii_columns USING ("column") WHERE {_PICK})')}
SELECT "column", rank, regexp_replace(v, '[0-9A-Za-z]', '*', 'g') AS sample FROM (
  SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) AS rank FROM hits)
WHERE rank <= 5""")
def pii_samples(spark, d):
    df = people(spark, d)
    return pii.samples(df, pii.columns(pii.match_counts(df)))
