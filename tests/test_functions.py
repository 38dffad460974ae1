import datetime as dt

import pytest
from pyspark.sql import functions as F

from pointline.functions import arrays, text
from pointline.functions import calendar as cal


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def day(text_):
    return F.lit(text_).cast("date")


def ts(text_):
    return F.lit(text_).cast("timestamp_ntz")


@pytest.mark.parametrize("value, start, end", [
    ("2024-03-10", "2024-03-04", "2024-03-10"), ("2024-03-11", "2024-03-11", "2024-03-17")])
def test_week_edges(spark, value, start, end):
    assert one(spark, *cal.week_bounds(day(value))) == (dt.date.fromisoformat(start), dt.date.fromisoformat(end))


@pytest.mark.parametrize("value, start, end", [
    ("2024-09-01", "2024-09-01", "2024-12-31"), ("2024-12-31", "2024-09-01", "2024-12-31"),
    ("2024-02-29", "2024-01-01", "2024-03-31"), ("2024-04-01", "2024-04-01", "2024-06-30"),
    ("2024-07-14", "2024-04-01", "2024-06-30"), ("2024-08-31", "2024-04-01", "2024-06-30")])
def test_terms(spark, value, start, end):
    assert one(spark, *cal.term_bounds(day(value))) == (dt.date.fromisoformat(start), dt.date.fromisoformat(end))


def test_strict_terms_leave_out_summer(spark):
    assert one(spark, *cal.term_bounds(day("2024-07-14"), strict=True)) == (None, None)


@pytest.mark.parametrize("value, months, wanted", [
    ("2024-01-31 10:20:30.5", 1, "2024-03-02 10:20:30.5"), ("2023-01-31", 1, "2023-03-03"),
    ("2023-11-30", 3, "2024-03-01"), ("2024-05-31", -3, "2024-03-02"), ("2024-05-15", 2, "2024-07-15")])
def test_month_shift_overflows(spark, value, months, wanted):
    assert one(spark, cal.month_shift(ts(value), months)) == (dt.datetime.fromisoformat(wanted),)


@pytest.mark.parametrize("value, months", [("2024-05-31 12:00:00", 3), ("2001-03-15 12:00:00", 3), ("2024-01-10", 14)])
def test_months_before_is_month_shift_on_the_driver(spark, value, months):
    at = dt.datetime.fromisoformat(value)
    assert one(spark, cal.month_shift(ts(value), -months)) == (cal.months_before(at, months),)


@pytest.mark.parametrize("period", cal.PERIOD_TYPES)
@pytest.mark.parametrize("value", ["2024-01-01", "2024-02-29", "2024-07-31", "2024-12-31", "2023-12-31"])
def test_period_range_agrees_with_columns(spark, period, value):
    at = dt.datetime.fromisoformat(value)
    assert one(spark, *cal.period_bounds(day(value), period)) == cal.period_range(at, period)


def test_unknown_period(spark):
    with pytest.raises(ValueError):
        cal.period_range(dt.datetime(2024, 1, 1), "year")
    with pytest.raises(ValueError):
        cal.period_bounds(day("2024-01-01"), "year")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_wall_clock_survives_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instant = cal.as_instant(ts("2024-02-01 01:02:03.000004"))
        assert one(spark, F.unix_micros(instant), cal.as_wall_clock(instant)) == (
            1706749323000004, dt.datetime(2024, 2, 1, 1, 2, 3, 4))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_local_day(spark):
    late = ts("2024-01-07 23:30:00")
    assert one(spark, cal.local_day(late), cal.local_day(late, "Europe/Paris")) == (
        dt.date(2024, 1, 7), dt.date(2024, 1, 8))


@pytest.mark.parametrize("action, category", [
    ("🏀 match", "sport"), ("HARDWORKER", "sport"), ("Défaite", "sport"), ("DÉFAITE", "sport"),
    ("📚", "academic"), ("Félicitations du conseil", "academic"), ("RETARD", "academic"),
    ("victoire en classe", "sport"), ("bonus scolaire", "academic"), ("rien", "unknown"), ("", "unknown"),
    ("Table de marque", "sport")])
def test_classify(spark, action, category):
    assert one(spark, text.classify(F.lit(action))) == (category,)


def test_classify_null_and_case(spark):
    assert one(spark, text.classify(F.lit(None).cast("string"))) == ("unknown",)
    yes = text.contains_any(F.lit("des félicitations"), ["Félicitations"])
    no = text.contains_any(F.lit("des félicitations"), ["Félicitations"], case_sensitive=True)
    assert one(spark, yes, no) == (True, False)


def test_small_texts(spark):
    assert one(spark, text.signed_label(F.lit(5)), text.signed_label(F.lit(-5)), text.signed_label(F.lit(0))) == (
        "Points franchise (+5)", "Points franchise (-5)", "Points franchise (0)")
    assert one(spark, *[text.one_decimal(F.lit(v)) for v in (12.0, 12.25, -3.04, 1e8)]) == (
        "12", "12.3", "-3.0", "100000000")
    assert one(spark, text.share_pct(F.lit(1), F.lit(3)), text.share_pct(F.lit(0), F.lit(0))) == (33.3, 0.0)
    code, = one(spark, text.pseudonym_key(F.lit("Some NAME"), "s"))
    again, = one(spark, text.pseudonym_key(F.lit("some name"), "s"))
    other, = one(spark, text.pseudonym_key(F.lit("some name"), "t"))
    assert code == again != other and len(code) == 7 and code[3] == "-"


def test_arrays(spark):
    days = F.array(*[day(f"2024-01-0{i}") for i in (1, 3, 4, 5)])
    last = one(spark, arrays.keep_last(days, 2))[0]
    assert last == [dt.date(2024, 1, 4), dt.date(2024, 1, 5)]
    assert one(spark, arrays.days_in_a_row(days, 3), arrays.days_in_a_row(days, 4), arrays.days_in_a_row(days, 9)) == (
        True, False, False)
    assert one(spark, arrays.keep_last(days, 9), arrays.from_json_days(arrays.to_json_days(days)))[0] == one(spark, days)[0]
