"""Text predicates and normalisers as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import vocab


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(c, F.lit(vocab.WHITESPACE))


def folded(c: Column) -> Column:
    """Trimmed, lower-cased text: the form the word lists are compared in."""
    return F.lower(strip(c))


def null_normalise(c: Column) -> Column:
    """Cells spelled exactly like a null word become null; no trimming."""
    return F.when(~c.isin(*vocab.NULL_PATTERNS), c)


def junk_normalise(c: Column) -> Column:
    """Cells that are junk after trim + lower become null."""
    return F.when(~folded(c).isin(*vocab.JUNK_REPAIR), c)


def as_num(c: Column) -> Column:
    """Text to double, null where the text is no plain decimal number.

    The guard matters: a bare cast accepts type suffixes such as '12d'.
    """
    return F.when(c.rlike(vocab.NUMBER), strip(c).try_cast("double"))


def is_num(c: Column) -> Column:
    return c.rlike(vocab.NUMBER)


def email_strict(c: Column) -> Column:
    """One-dot domain rule used by the score and root causes."""
    return strip(c).rlike(vocab.EMAIL_STRICT)


def email_lenient(c: Column) -> Column:
    """Multi-dot domains allowed; used by cleaning and suggestions."""
    return strip(c).rlike(vocab.EMAIL_LENIENT)


def num_text(c: Column) -> Column:
    """Double as text with plain digits: integral values end in '.0', no exponent below 1e16."""
    plain = F.rtrim(c.cast("decimal(38,15)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mag = F.abs(c)
    return (F.when((mag >= 1e7) & (mag < 1e16), plain)
            .otherwise(c.cast("string")))


def _digit_sum(c: Column) -> Column:
    """Sum of the decimal digits of a digit string, by counting each digit."""
    n = F.length(c)
    return sum((F.lit(k) * (n - F.length(F.replace(c, F.lit(str(k)), F.lit(""))))
                for k in range(2, 10)), n - F.length(F.replace(c, F.lit("1"), F.lit(""))))


def luhn(c: Column) -> Column:
    """13 to 19 digits (other characters ignored) with a valid mod-10 check digit.

    From the right, every second digit is doubled with its digits summed; the pairs are
    split by regex and the doubling is a character translation, so all stays generated code.
    """
    digits = F.regexp_replace(c, "[^0-9]", "")
    back = F.reverse(digits)
    kept = F.regexp_replace(back, "(.).?", "$1")
    doubled = F.translate(F.regexp_replace(back, ".(.?)", "$1"), "0123456789", "0246813579")
    return F.length(digits).between(13, 19) & (
        (_digit_sum(kept) + _digit_sum(doubled)) % 10 == 0)


def canonical(c: Column, synonyms: dict[str, str]) -> Column:
    """Replace known spellings (trim + lower) by their canonical name; others stay."""
    lookup = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, folded(c)), c)


def title(c: Column) -> Column:
    """Capitalise the first letter after every non-letter, lower-case the rest.

    Unlike initcap this also capitalises after hyphens, apostrophes and digits.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                             F.lower(F.substr(r, F.lit(2))))), "")


def cased(c: Column, case: str | None) -> Column:
    """'lower', 'upper', 'title' or no change."""
    how = (case or "").lower()
    if how == "lower":
        return F.lower(c)
    if how == "upper":
        return F.upper(c)
    if how == "title":
        return title(c)
    return c


def matched(c: Column, pattern: str) -> Column:
    """Text of the first match of pattern in c ('' if none)."""
    return F.regexp_extract(c, pattern, 0)
