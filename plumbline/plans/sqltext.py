"""Building blocks of the SQL texts the results are checked against."""

from __future__ import annotations

from plumbline import vocab
from plumbline.plans.fixtures import PEOPLE_CTE, PEOPLE_V2_CTE

STRINGS = ("name", "email", "score_text", "phone", "country", "status", "signup_date", "notes")
NUMBERS = ("id", "age", "salary", "quantity")
COLUMNS = ("id", "name", "email", "age", "score_text", "phone", "country", "status",
           "signup_date", "salary", "quantity", "notes")


def values(items) -> str:
    """('a', 'b') list for IN."""
    return "(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + ")"


def strip(v: str) -> str:
    return rf"regexp_replace({v}, '^\s+|\s+$', '', 'g')"


def folded(v: str) -> str:
    return f"lower({strip(v)})"


def is_num(v: str) -> str:
    return f"regexp_matches({v}, '{vocab.NUMBER}')"


def as_num(v: str) -> str:
    return f"(CASE WHEN {is_num(v)} THEN CAST({strip(v)} AS DOUBLE) END)"


def match(v: str, pattern: str) -> str:
    return f"regexp_matches({v}, '{pattern}')"


def ambiguous(v: str) -> str:
    return match(strip(v), vocab.AMBIGUOUS_DATE)


def as_date(v: str) -> str:
    """Numeric notations only: the ones the dirtied views hold."""
    s = strip(v)
    return f"""(CASE
      WHEN {match(s, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$')} THEN try_strptime({s}, '%Y-%m-%d')
      WHEN {match(s, '^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$')} THEN try_strptime({s}, '%Y/%m/%d')
      WHEN {match(s, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$')}
        THEN try_strptime({s}, ['%m/%d/%Y', '%d/%m/%Y'])
      WHEN {match(s, '^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$')}
        THEN try_strptime({s}, ['%m-%d-%Y', '%d-%m-%Y'])
      WHEN {match(s, '^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$')}
        THEN try_strptime({s}, ['%m.%d.%Y', '%d.%m.%Y'])
      WHEN {match(s, '^[0-9]{8}$')} THEN try_strptime({s}, '%Y%m%d') END)"""


def label(v: str, table) -> str:
    s = strip(v)
    return "(CASE " + " ".join(f"WHEN {match(s, p)} THEN '{x}'" for p, x in table) + " END)"


def cells(names=COLUMNS, source: str = "people", name: str = "cells") -> str:
    """CTE with one row per cell: "column", v (text)."""
    parts = [f"SELECT '{n}' AS \"column\", CAST({n} AS VARCHAR) AS v FROM {source}"
             for n in names]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def numbers(names, source: str, name: str = "nums") -> str:
    parts = [f"SELECT '{n}' AS \"column\", CAST({n} AS DOUBLE) AS v FROM {source}"
             for n in names]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def null_words(v: str) -> str:
    return f"(CASE WHEN {v} IN {values(vocab.NULL_PATTERNS)} THEN NULL ELSE {v} END)"


def people(*ctes: str) -> str:
    return "WITH " + ", ".join((PEOPLE_CTE,) + ctes)


def both_versions(*ctes: str) -> str:
    return "WITH " + ", ".join((PEOPLE_CTE, PEOPLE_V2_CTE) + ctes)


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    return (f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform("
            f"range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 "
            f"THEN CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT) "
            f"WHEN CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT) > 4 "
            f"THEN 2 * CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT) - 9 "
            f"ELSE 2 * CAST(substr(reverse({d}), CAST(i AS INT), 1) AS INT) END)) % 10 = 0)")
