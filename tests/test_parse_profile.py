"""Hand-computed cases for parsing, profiling and cleaning (messy-string table)."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import parse as P
from quarry.operators import clean as C
from quarry.operators import profile as B
from quarry.sources.delimited import normalize_columns, suggest_mapping


def _parse(spark, values, european=False, keep_sign=True):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(P.parse_numeric(F.col("v"), european, keep_sign)).collect()]


def test_parse_numeric_plain(spark):
    got = _parse(spark, ["$1,200", "12.5%", "€ 4", "-5", "-$3", "(5)", "abc", "NaN", "inf", " 7 ", None])
    assert got == [1200.0, 12.5, 4.0, -5.0, -3.0, None, None, None, None, 7.0, None]


def test_parse_numeric_reference_sign_mode(spark):
    assert _parse(spark, ["-5", "-$3"], keep_sign=False) == [5.0, 3.0]


def test_parse_numeric_european_column(spark):
    # in a European column, plain thousands notation fails (as in the reference)
    assert _parse(spark, ["1.200,50", "1,000", "2.000.000"], european=True) == [1200.5, None, 2000000.0]


def test_european_flag_needs_unambiguous_values(spark):
    df = spark.createDataFrame([("0.125",), ("1.5",)], "v string")
    assert df.agg(F.count_if(P.euro_row(F.col("v")))).first()[0] == 0
    df2 = spark.createDataFrame([("1.200,50",)], "v string")
    assert df2.agg(F.count_if(P.euro_row(F.col("v")))).first()[0] == 1


def test_bool_tokens(spark):
    df = spark.createDataFrame([("Yes",), ("off",), ("T",), ("0",), (None,), (" y ",)], "v string")
    got = [r[0] for r in df.select(P.to_bool(F.col("v"))).collect()]
    assert got == [True, False, True, False, False, True]
    assert all(r[0] for r in df.where("v IS NOT NULL").select(P.is_bool_token(F.col("v"))).collect())


def test_datetime_layouts(spark):
    df = spark.createDataFrame([("2024-01-03",), ("2024-01-04T10:00:00",), ("03/01/2024",), ("20240101",), ("2024",)], "v string")
    parsed = df.select(F.coalesce(*[P.parse_datetime(F.col("v"), f) for f, _ in P.DATETIME_FORMATS]).alias("t")).collect()
    got = [str(r[0]) if r[0] else None for r in parsed]
    assert got == ["2024-01-03 00:00:00", "2024-01-04 10:00:00", "2024-03-01 00:00:00", None, None]


def test_more_datetime_layouts_and_utc(spark):
    cases = {
        "2024-01-03 10:00": "2024-01-03 10:00:00", "2024-01-03T10:00:00Z": "2024-01-03 10:00:00",
        "2024-01-03 10:00:00.250": "2024-01-03 10:00:00.250000", "2024-01-03T10:00:00+02:00": "2024-01-03 08:00:00",
        "2024-01-03T10:00:00.5-0530": "2024-01-03 15:30:00.500000", "25/12/2024": "2024-12-25 00:00:00",
        "12/25/2024 08:30": "2024-12-25 08:30:00", "03-01-2024": "2024-03-01 00:00:00", "31-01-2024": "2024-01-31 00:00:00",
        "Jan 3, 2024": "2024-01-03 00:00:00", "3 Jan 2024": "2024-01-03 00:00:00", "32/13/2024": None, "1234": None, "3.14": None,
    }
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            got = {r["v"]: r["t"] for r in df.select("v", P.parse_any_datetime(F.col("v")).alias("t")).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert {k: str(v) if v else None for k, v in got.items()} == cases, zone


def test_one_column_with_mixed_layouts_keeps_its_time_axis(spark):
    df = spark.createDataFrame([("2024-01-03 10:00", "1"), ("25/12/2024", "2"), ("2024-01-03T10:00:00+01:00", "3")], "date string, x string")
    roles = C.plan_roles(df)
    assert roles.datetime == "date"
    got = [str(r["date"]) for r in C.typed(df, roles).orderBy("x").collect()]
    assert got == ["2024-01-03 10:00:00", "2024-12-25 00:00:00", "2024-01-03 09:00:00"]


def test_name_score_and_normalisation(spark):
    assert P.name_score("order_date") == pytest.approx(1 - 3 / 13 * 0.5)
    assert P.name_score("amount") == 0.0
    assert P.normalize_name(" Unit Price-USD ") == "unit_price_usd"
    df = spark.createDataFrame([(1, 2)], "`A b` int, `c-D` int")
    assert normalize_columns(df).columns == ["a_b", "c_d"]
    with pytest.raises(ValueError):
        normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int"))
    assert suggest_mapping(["Date", "Sales", "Store Location", "Error Rate"]) == {"Date": "date", "Sales": "sales", "Error Rate": "error_rate"}


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        ("2024-01-03", "$1,200", "yes", "north", "a", None),
        ("2024-01-04", "12.5%", "no", "south", "b", None),
        ("2024-01-05", "€ 4", "Y", "north", "c", None),
        ("2024-01-06", "abc", "off", "  ", "d", "x"),
        (None, None, None, None, None, None),
        ("bad", "7", "t", "east", "e", None),
    ]
    return spark.createDataFrame(rows, "when_date string, amount string, flag string, region string, code string, sparse string")


def test_profile_and_schema(spark, messy):
    prof = {r["column"]: r for r in B.detect_schema(B.profile_columns(messy)).collect()}
    assert prof["when_date"]["role"] == "datetime"
    assert prof["when_date"]["datetime_ratio"] == pytest.approx(4 / 5)
    assert prof["amount"]["inferred_type"] == "numeric" and prof["amount"]["numeric_ratio"] == pytest.approx(4 / 5)
    assert prof["flag"]["role"] == "boolean"
    assert prof["region"]["role"] == "text"
    assert prof["sparse"]["null_ratio"] == pytest.approx(5 / 6)
    assert prof["code"]["sample_values"] == "a|b|c|d|e"
    assert prof["code"]["unique_count"] == 5


def test_clean_report_and_flags(spark, messy):
    roles = C.plan_roles(messy)
    assert roles.datetime == "when_date" and "amount" in roles.numeric and roles.boolean == ["flag"]
    rep = C.transformation_report(messy, roles).first()
    assert rep["total_records"] == 5 and rep["dropped_empty_rows"] == 1
    assert rep["timestamp_failures"] == 1 and rep["invalid_records"] == 1
    assert rep["numeric_failures__amount"] == 1
    assert rep["valid_ratio"] == pytest.approx(0.8)
    flags = {(r["flag"], r["column"]) for r in C.quality_flags(C.transformation_report(messy, roles), roles).collect()}
    assert {("TIMESTAMP_PARSE_FAILURES", "when_date"), ("NUMERIC_COERCION_FAILURE", "amount"), ("LOW_VALID_RATIO", None),
            ("EMPTY_ROWS_DROPPED", None), ("HIGH_NULL_RATIO", "sparse")} <= flags
    rec = C.records(messy, roles).where("timestamp IS NOT NULL").orderBy("timestamp").first()
    assert '"region":"north"' in rec["payload"] and '"sparse":null' in rec["payload"]
    assert not math.isnan(rec["amount"])


def test_fingerprints_and_delimited_read(spark, tmp_path):
    from quarry.sources.delimited import file_fingerprints, new_files, read_delimited

    utf = tmp_path / "a.csv"
    utf.write_text(" Unit Price-USD ,city\n1,Zürich\nNA,Köln\n", encoding="utf-8")
    lat = tmp_path / "b.tsv"
    lat.write_bytes(" Unit Price-USD \tcity\n2\tZürich\n".encode("latin-1"))
    df = read_delimited(spark, [str(utf), str(lat)])
    rows = [(r[0], r[1]) for r in df.collect()]
    assert ("1", "Zürich") in rows and ("2", "Zürich") in rows and (None, "Köln") in rows
    fp = file_fingerprints(spark, [str(utf), str(lat)])
    assert fp.count() == 2
    registry = fp.where(F.col("path").endswith("a.csv")).select("md5")
    assert [r["path"].endswith("b.tsv") for r in new_files(fp, registry).collect()] == [True]


def test_all_layouts_share_one_test_and_no_hopeless_cast(spark):
    """Each of the layouts once repeated the test for dates; text without a number in it cost a failed cast."""
    plan = spark.range(1).select(P.parse_any_datetime(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[-/.]\\d{1,2}[-/.]") == 1
    values = ["5-LOW", "1996-01-02", "-1e-5", "1E+3", "+.5", "12:30", "1/2", "x", "", None, "$1,234", "7%", "-3", "nan", "0-", "1.234,00"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(P.parse_numeric(F.col("v"), False)).collect()]
    assert got == [None, None, -1e-5, 1e3, 0.5, None, None, None, None, None, 1234.0, 7.0, -3.0, None, None, 1.234]
    cast = spark.range(1).select(P.parse_numeric(F.lit("x"), False).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "[0-9][-:/]" in cast
