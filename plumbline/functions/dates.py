"""Date parsing and date-format labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import vocab
from plumbline.functions.text import strip

# Shape -> formats tried in order.  The shape test keeps the parser from raising (and
# swallowing) an exception per cell: only impossible calendar dates reach that path.
_SHAPES = (
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", ("yyyy-M-d",)),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", ("yyyy/M/d",)),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", ("M/d/yyyy", "d/M/yyyy")),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", ("M-d-yyyy", "d-M-yyyy")),
    (r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$", ("M.d.yyyy", "d.M.yyyy")),
    (r"^[A-Za-z]{3} [0-9]{1,2} [0-9]{4}$", ("MMM d yyyy",)),
    (r"^[A-Za-z]{4,9} [0-9]{1,2} [0-9]{4}$", ("MMMM d yyyy",)),
    (r"^[A-Za-z]{3} [0-9]{1,2}, ?[0-9]{4}$", ("MMM d,yyyy", "MMM d, yyyy")),
    (r"^[A-Za-z]{4,9} [0-9]{1,2}, ?[0-9]{4}$", ("MMMM d,yyyy", "MMMM d, yyyy")),
    (r"^[0-9]{1,2} [A-Za-z]{3} [0-9]{4}$", ("d MMM yyyy",)),
    (r"^[0-9]{1,2} [A-Za-z]{4,9} [0-9]{4}$", ("d MMMM yyyy",)),
    (r"^[0-9]{8}$", ("yyyyMMdd",)),
)
_TIMESTAMP = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?"
              r"(Z|[+-][0-9]{2}:?[0-9]{2})?$")


def _parse(c: Column, fmt: str) -> Column:
    return F.try_to_timestamp(c, F.lit(fmt)).cast("date")


def as_date(c: Column) -> Column:
    """Text to date, month before day, over a closed list of formats; null if none fits.

    Needs spark.sql.legacy.timeParserPolicy=CORRECTED (the default).
    """
    v = strip(c)
    out = None
    for shape, formats in _SHAPES:
        parsed = F.coalesce(*[_parse(v, f) for f in formats])
        cond = v.rlike(shape)
        out = F.when(cond, parsed) if out is None else out.when(cond, parsed)
    return out.when(v.rlike(_TIMESTAMP), v.try_cast("timestamp").cast("date"))


def is_ambiguous(c: Column) -> Column:
    """All three parts have two digits, so the order of year, month and day is unknown."""
    return strip(c).rlike(vocab.AMBIGUOUS_DATE)


def is_invalid_date(c: Column) -> Column:
    """Neither parseable nor merely ambiguous; null cells give null."""
    return F.when(c.isNotNull(), ~is_ambiguous(c) & as_date(c).isNull())


def date_label(c: Column, labels=vocab.DATE_LABELS_SCORE) -> Column:
    """Name of the first notation the text fits, null if none."""
    v = strip(c)
    out = None
    for pattern, label in labels:
        cond = v.rlike(pattern)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def strict_date(c: Column, shape: str, fmt: str) -> Column:
    """Date in exactly one format (text as it stands, no trimming), else null."""
    return F.when(c.rlike(shape), _parse(c, fmt))
