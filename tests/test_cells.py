"""Cell-level functions: typing, days, bands, display, answers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frames import one
from ledgerline.functions import answers, bands, coerce, days, display


def each(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.v for r in df.select("i", build.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_moment_is_utc_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = each(
            spark,
            ["2025-03-09T02:30:00.000Z", "2025-04-02", "2025-04-02T01:00:00+05:30", "2025-04-02T01:00:00.5-0100", "soon", "", None],
            coerce.moment("c"),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [
        datetime(2025, 3, 9, 2, 30),
        datetime(2025, 4, 2),
        datetime(2025, 4, 1, 19, 30),
        datetime(2025, 4, 2, 2, 0, 0, 500000),
        None,
        None,
        None,
    ]


def test_number(spark):
    assert each(spark, ["1.50", "-2", "x", "", None], coerce.number("c")) == [1.5, -2.0, None, None, None]


def test_item_key(spark):
    got = each(spark, ["000010", "10", "000", "00 1 ", " 10", None], coerce.item_key("c"))
    assert got == ["10", "10", "", "1", "10", None]


def test_null_tokens_and_parse(spark):
    assert each(spark, ["", "nan", "None", "x"], coerce.null_tokens(F.col("c"))) == [None, None, None, "x"]
    assert each(spark, ["nan", "2025-01-02T00:00:00Z"], coerce.parse_or_null("c")) == [None, datetime(2025, 1, 2)]


def test_finite(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.0, None]
    assert each(spark, values, coerce.finite(F.col("c")), "double") == [None, None, None, 1.0, None]


def test_true_text_and_blank(spark):
    assert each(spark, ["True", "False", "true", None], coerce.true_text(F.col("c"))) == [True, False, False, False]
    assert each(spark, ["a", "", None], coerce.not_blank(F.col("c"))) == [True, False, False]


def test_payment_terms(spark):
    assert each(spark, ["Z001", "Z009", "Z777", None], coerce.payment_term_days(F.col("c"))) == [30, 0, 30, 30]
    assert each(spark, ["A", "B"], coerce.payment_term_days(F.col("c"), {"A": 5}, 9)) == [5, 9]


def span(spark, start, end, build):
    df = spark.createDataFrame([(start, end)], "a string, b string")
    cast = [F.col(c).cast("timestamp_ntz") for c in ("a", "b")]
    return one(df.select(build(*cast).alias("v"))).v


@pytest.mark.parametrize(
    "start,end,floor,near",
    [
        ("2025-01-01", "2025-01-04", 3, 3),
        ("2025-01-01 12:00:00", "2025-01-04 11:59:59", 2, 3),
        ("2025-01-01 01:00:00", "2025-01-01 00:00:00", -1, 0),
        ("2025-01-02 12:00:00", "2025-01-01", -2, -1),
        ("2025-01-01", "2025-01-02 12:00:00", 1, 2),
        ("2025-01-03", "2025-01-01", -2, -2),
        (None, "2025-01-01", None, None),
    ],
)
def test_days(spark, start, end, floor, near):
    assert span(spark, start, end, days.elapsed_days) == floor
    assert span(spark, start, end, days.rounded_days) == near


def test_overdue_keeps_time_of_day(spark):
    df = spark.createDataFrame([("2025-01-01 10:00:00",), (None,)], "b string")
    billed = F.col("b").cast("timestamp_ntz")

    def overdue(as_of):
        at = F.lit(as_of).cast("timestamp_ntz")
        return [r.v for r in df.select(days.overdue_as_of(billed, F.lit(30), at).alias("v")).collect()]

    assert overdue("2025-01-31 10:00:00") == [False, False]
    assert overdue("2025-01-31 10:00:01") == [True, False]


def test_severity_and_tiers(spark):
    scores = [0, 1, 2, 3, 4, 5, 30, None]
    c = F.col("c")
    assert each(spark, scores[:6], bands.severity_level(c), "int") == ["info", "info", "warning", "warning", "critical", "critical"]
    assert each(spark, scores[:6], bands.severity_caption(c), "int")[::2] == ["Low", "Warning", "Critical"]
    assert each(spark, scores, bands.severity_band(c), "int") == [0, 1, 2, 3, 4, 4, 4, 0]
    assert each(spark, [4, 5, 24, 99], bands.card_tier(c), "bigint") == [0, 1, 4, 5]
    assert each(spark, [4, 5, 24], bands.table_tier(c), "bigint") == [4, 5, 5]


def test_stage_position_and_track(spark):
    c = F.col("c")
    stages = ["ordered", "paid", "cancelled", None]
    assert each(spark, stages, bands.stage_position(c)) == [0, 3, -1, -1]
    (track,) = each(spark, ["billed"], bands.stage_track(c))
    assert [(s.stage, s.state) for s in track] == [
        ("ordered", "done"), ("delivered", "done"), ("billed", "active"), ("paid", "open"),
    ]


def test_display(spark):
    c = F.col("c")
    amounts = [1234567.0, 999.6, -100000.0, 0.0, None]
    assert each(spark, amounts, display.rupees(c), "double") == ["₹1,234,567", "₹1,000", "₹-100,000", "₹0", "—"]
    assert each(spark, amounts, display.rupees_lakh(c), "double") == ["₹12,34,567", "₹1,000", "₹-1,00,000", "₹0", "—"]
    assert each(spark, [1234567.5, 12.0, -0.12345], display.number_lakh(c), "double") == ["12,34,567.5", "12", "-0.123"]
    assert each(spark, [12.0, 1234.5678], display.number_lakh(c, 2), "double") == ["12.00", "1,234.568"]
    assert each(spark, [56.0, None], display.percent(c), "double") == ["56.0%", "—"]
    assert each(spark, [2.5, -0.5, 2.4, None], display.day_count(c), "double") == ["3d", "0d", "2d", "—"]
    assert each(spark, ["2025-04-02 23:00:00", None], display.short_date(c.cast("timestamp_ntz"))) == ["02 Apr 2025", "—"]
    assert each(spark, ["paid"], display.stage_name(c)) == ["Paid"]


ONE = '{"title":"Late","summary":"Two weeks","recommendation":"Call","severity":"warning"}'


@pytest.mark.parametrize(
    "text,titles",
    [
        (f"[{ONE}]", ["Late"]),
        (f"```json\n[{ONE},\n{ONE}]\n```", ["Late", "Late"]),
        (f"Here: [{ONE}] so far.", ["Late"]),
        (ONE, ["Late"]),
        ("[]", []),
        (f"[{ONE}, null]", ["Late"]),
        ("no brackets anywhere", ["AI Insight"]),
        (f"[{ONE}] and [more]", ["AI Insight"]),
        (f'[{ONE}], "b": [1]', ["AI Insight"]),
        (f'{ONE}, "b": 2', ["AI Insight"]),
        (f"[{ONE}", ["AI Insight"]),
        ('{"title":"a [b] c"}', ["a [b] c"]),
        ("", ["AI Insight"]),
    ],
)
def test_insights(spark, text, titles):
    (found,) = each(spark, [text], answers.insights(F.col("c")))
    assert [i.title for i in found] == titles


def test_default_insight_quotes_the_text(spark):
    (found,) = each(spark, ["x" * 500], answers.insights(F.col("c")))
    assert found[0].summary == "x" * 500
    assert (found[0].severity, found[0].recommendation) == ("info", "See full response for details.")
    (found,) = each(spark, ["x" * 500], answers.insights(F.col("c"), summary_chars=300))
    assert found[0].summary == "x" * 300


def test_split_answer(spark):
    text = " First part. \n\nSecond.\n1. Do this\nin two lines\n 2. 3. Then that \n6. six\n12. twelve 3.5 times\n"
    c = F.col("c")
    assert each(spark, [text], answers.analysis(c)) == ["First part. Second."]
    steps = ["Do this in two lines", "Then that", "six", "twelve 3.5 times"]
    assert each(spark, [text], answers.recommendations(c)) == [steps]
    assert each(spark, ["1. only"], answers.analysis(c)) == ["1. only"]
    assert each(spark, ["6. six\nmore"], answers.recommendations(c)) == [["six more"]]
    assert each(spark, ["plain"], answers.recommendations(c)) == [["Review order lifecycle for any incomplete stages."]]
    assert each(spark, [" " * 500], answers.analysis(c)) == [" " * 500]
    assert each(spark, [" " * 500], answers.analysis(c, chars=400)) == [" " * 400]
