"""Column roles, decided on the driver from the schema alone before expressions are built."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import vocab

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)
_NAME_ROLES = {
    "age": vocab.AGE_NAMES,
    "date": vocab.DATE_NAMES,
    "cause_date": vocab.CAUSE_DATE_NAMES,
    "future_allowed": vocab.FUTURE_ALLOWED_NAMES,
    "email": vocab.EMAIL_NAMES,
    "id": vocab.ID_NAMES,
    "status": vocab.STATUS_NAMES,
    "short_text": vocab.SHORT_TEXT_NAMES,
    "person": vocab.PERSON_NAMES,
    "identity": vocab.IDENTITY_NAMES,
    "country": vocab.COUNTRY_NAMES_CLEANING,
    "cause_country": vocab.COUNTRY_NAMES_CAUSE,
    "sentinel": vocab.SENTINEL_NAMES,
    "numeric_intent": vocab.NUMERIC_INTENT_NAMES,
}


#: Columns that carry a row's identity and are no data.
ROW_IDENTITY = ("_row_file", "_row_index")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def norm(name: str) -> str:
    """Column name as the role tables compare it."""
    return name.lower().strip()


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_atomic(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType,
                                  T.VariantType))


@dataclass(frozen=True)
class Col:
    """One column with its kind ('numeric', 'string', 'other') and name roles."""

    name: str
    kind: str
    dtype: T.DataType
    roles: frozenset = field(default_factory=frozenset)

    def has(self, role: str) -> bool:
        return role in self.roles


def columns(df: DataFrame, overrides: dict[str, set[str]] | None = None) -> list[Col]:
    """Atomic columns of df with kinds and roles; overrides replaces the name-derived roles.

    Nested columns lie outside the rules and are left out (see skipped_columns), and so are
    the row-identity columns.
    """
    out = []
    for f in df.schema.fields:
        if f.name in ROW_IDENTITY or not is_atomic(f.dataType):
            continue
        kind = ("numeric" if is_numeric(f.dataType)
                else "string" if is_string(f.dataType) else "other")
        if overrides and f.name in overrides:
            roles = frozenset(overrides[f.name])
        else:
            roles = frozenset(r for r, names in _NAME_ROLES.items() if norm(f.name) in names)
        out.append(Col(f.name, kind, f.dataType, roles))
    return out


def dates_as_text(df: DataFrame) -> DataFrame:
    """df with date and timestamp columns that are named as dates in ISO notation, so that the
    rules for written dates hold for them too."""
    typed = [c.name for c in columns(df) if c.dtype.typeName() in ("date", "timestamp", "timestamp_ntz")
             and (c.has("date") or c.has("cause_date"))]
    return df.withColumns({n: F.date_format(col(n), "yyyy-MM-dd") for n in typed}) if typed else df


def skipped_columns(df: DataFrame) -> list[tuple[str, str]]:
    """(column, reason) for columns the rules do not cover."""
    return [(f.name, f"nested type {f.dataType.simpleString()}") for f in df.schema.fields
            if f.name not in ROW_IDENTITY and not is_atomic(f.dataType)]


def domain_rule(name: str, rules, whole_words: bool = False):
    """First (lo, hi) whose keyword occurs in the column name, or None.

    The keyword may sit anywhere in the name, so 'percentage' meets the 'age' rule first;
    whole_words=True compares '_'-separated words instead.
    """
    n = norm(name)
    for keywords, lo, hi in rules:
        if whole_words:
            hit = bool(set(n.replace("-", "_").split("_")) & set(keywords))
        else:
            hit = any(k in n for k in keywords)
        if hit:
            return lo, hi
    return None
