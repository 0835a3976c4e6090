"""Golden micro-cases of the row-local rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import roles, vocab
from plumbline.functions import dates, stats, text


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_strict_email(spark):
    got = values(spark, ["rbrown@work", "mj@nike", "a@b.com", "a@b.co.uk", " a@b.com "],
                 text.email_strict)
    assert got == [False, False, True, False, True]


def test_lenient_email(spark):
    assert values(spark, ["a@b.co.uk", "a@b"], text.email_lenient) == [True, False]


def test_null_patterns_match_exactly(spark):
    got = values(spark, ["?", "--", "n/a", "---", " NULL", "", None], text.null_normalise)
    assert got == [None, None, None, "---", " NULL", None, None]


def test_numbers(spark):
    got = values(spark, ["12", " -3.5 ", "1e3", ".5", "5.", "12d", "1_000", "1,000", "0x1f",
                         "inf", "twenty", ""], text.as_num)
    assert got == [12.0, -3.5, 1000.0, 0.5, 5.0] + [None] * 7


def test_luhn(spark):
    got = values(spark, ["4111 1111 1111 1111", "4111 1111 1111 1112", "1234",
                         "378282246310005", "79927398713", ""], text.luhn)
    assert got == [True, False, False, True, False, False]


def test_strip_is_unicode_aware(spark):
    assert values(spark, [" a 　\n", "\x0bb\x1c"], text.strip) == ["a", "b"]


def test_title_capitalises_after_any_non_letter(spark):
    got = values(spark, ["o'neil mary-jane 3rd", "USA"], text.title)
    assert got == ["O'Neil Mary-Jane 3Rd", "Usa"]


def test_country(spark):
    got = values(spark, [" USA", "u.k.", "France"],
                 lambda c: text.canonical(c, vocab.COUNTRY_MAP_CLEANING))
    assert got == ["United States", "United Kingdom", "France"]


def test_plain_number_text(spark):
    df = spark.createDataFrame([(1234567890.0,), (1.5,), (55509.99999999999,)], "v double")
    assert [r[0] for r in df.select(text.num_text(F.col("v"))).collect()] == [
        "1234567890.0", "1.5", "55509.99999999999"]


@pytest.mark.parametrize("value,expected", [
    ("2024-02-30", None), ("00-00-0000", None), ("yesterday", None), ("2024-2-9", "2024-02-09"),
    ("2023/05/12", "2023-05-12"), ("Jan 16 2023", "2023-01-16"), ("12/05/2023", "2023-12-05"),
    ("13/05/2023", "2023-05-13"), ("January 5, 2020", "2020-01-05"), ("20240131", "2024-01-31"),
    ("5 March 2021", "2021-03-05"), ("2024-01-02T03:04:05Z", "2024-01-02"),
    ("31.12.2020", "2020-12-31"), ("95/06/01", None), ("2024", None)])
def test_dates(spark, value, expected):
    got = values(spark, [value], dates.as_date)[0]
    assert got == (dt.date.fromisoformat(expected) if expected else None)


def test_ambiguous_is_neither_valid_nor_invalid(spark):
    rows = ["95/06/01", "24-01-24", "24.01.24", "2024-02-30", "2023/05/12"]
    assert values(spark, rows, dates.is_ambiguous) == [True, True, True, False, False]
    assert values(spark, rows, dates.is_invalid_date) == [False, False, False, True, False]


def test_date_labels(spark):
    rows = ["2023-05-12", "12/05/2023", "Jan 5, 2020", "5 May 2020", "20240131", "95/06/01"]
    assert values(spark, rows, dates.date_label) == [
        "YYYY-MM-DD", "DD/MM/YYYY", "Month DD YYYY", "DD Month YYYY", "YYYYMMDD", None]
    assert values(spark, rows[-1:], lambda c: dates.date_label(c, vocab.DATE_LABELS_CAUSE)) == [
        "MM/DD/YY"]


def test_chi_square_tail(spark):
    cases = [(3.841458820694124, 1.0, 0.05), (10.0, 2.0, 0.006737946999085467),
             (124.342, 100.0, 0.05), (0.0, 3.0, 1.0)]
    df = spark.createDataFrame(cases, "x double, df double, p double")
    for r in df.select(stats.chi2_pvalue("x", "df").alias("got"), "p").collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-6)


def test_ks_tail(spark):
    # effective size 100: lambda 1.358 is the 5 % point
    p = spark.range(1).select(stats.ks_pvalue(F.lit(0.1358), F.lit(200), F.lit(200)),
                              stats.ks_pvalue(F.lit(0.0), F.lit(9), F.lit(9)),
                              stats.ks_pvalue(F.lit(1.0), F.lit(500), F.lit(500))).first()
    assert p[0] == pytest.approx(0.05, abs=2e-4)
    assert p[1] == 1.0 and p[2] < 1e-12


def test_bias_corrected_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "v double")
    r = df.agg(stats.skew_g1(F.count("v"), F.skewness("v")),
               stats.kurt_g2(F.count("v"), F.kurtosis("v"))).first()
    assert r[0] == pytest.approx(2.2324, abs=1e-4)
    assert r[1] == pytest.approx(4.9869, abs=1e-4)


def test_domain_rule_is_substring_and_first_wins():
    assert roles.domain_rule("percentage", vocab.DOMAIN_RULES_CLEANING) == (0, 120)
    assert roles.domain_rule("percentage", vocab.DOMAIN_RULES_CLEANING, True) == (0, 100)
    assert roles.domain_rule("unit_price", vocab.DOMAIN_RULES_CLEANING) == (0, None)
    assert roles.domain_rule("city", vocab.DOMAIN_RULES_CLEANING) is None


def test_nested_columns_are_skipped_with_a_reason(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, vec array<double>")
    assert [c.name for c in roles.columns(df)] == ["id"]
    assert roles.skipped_columns(df)[0][0] == "vec"
