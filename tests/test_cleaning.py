from helpers import rows
from pyspark.sql import functions as F

from panelwright.functions import cleaning as C


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_firm_id_forms(spark):
    got = apply(spark, ["f0042", "F-0042", " 0042 ", "firm_0042", "F0042", "UNKNOWN-X", "", None, "F12345"], C.norm_firm_id)
    assert got == ["F0042"] * 5 + [None, None, None, "F12345"]


def test_quarter_forms(spark):
    got = apply(spark, ["2024Q1", "2024-Q3", "2024-12-31", " 2025q2 ", "2024Q7", "soon", None], C.norm_quarter)
    assert got == ["2024Q1", "2024Q3", "2024Q4", "2025Q2", None, None, None]


def test_quarter_end(spark):
    assert [str(d) for d in apply(spark, ["2024Q1", "2024Q4"], C.quarter_end)] == ["2024-03-31", "2024-12-31"]


def test_money_label_date(spark):
    assert apply(spark, ["$1,234.50", "7", "n/a"], C.parse_money) == [1234.5, 7.0, None]
    assert apply(spark, ["Central ", "south", "EAST"], C.norm_label) == ["Central", "South", "East"]
    assert [str(d) for d in apply(spark, ["2024-06-01", "not-a-date"], C.parse_date)] == ["2024-06-01", "None"]


def test_date_spellings(spark):
    got = apply(spark, ["2024-03-04", "04/03/2024", "03-04-2024", "4 March"], C.parse_date_multi)
    assert [str(d) for d in got] == ["2024-03-04"] * 3 + ["None"]


def test_account_is_matched_whole(spark):
    got = apply(spark, ["A00000001", "A00000001\n", "xA00000001", "A0000001", "", None], C.valid_account)
    assert got == [True, False, False, False, False, False]


def test_bucket_edges(spark):
    bands = lambda c: C.bucket(c, [(0.0, "0%"), (0.10, "1-10%"), (0.20, "11-20%")], "21%+")
    assert apply(spark, [0.0, 0.05, 0.10, 0.15, 0.25], bands, "double") == ["0%", "1-10%", "1-10%", "11-20%", "21%+"]


def test_month_index_round_trip(spark):
    df = spark.sql("select explode(sequence(date'1999-11-01', date'2001-02-01', interval 1 month)) as d")
    back = df.select("d", C.month_from_index(C.month_index(F.col("d"))).alias("b"), C.month_index(F.col("d")).alias("i")).orderBy("d").collect()
    assert all(r.d == r.b for r in back)
    assert [r.i for r in back] == list(range(back[0].i, back[0].i + len(back)))


def test_normalize_text(spark):
    assert apply(spark, ["  ANNUAL  Review.\n"], C.normalize_text) == ["annual review."]


def test_json_and_logs(spark):
    assert apply(spark, ['{"k": 5}', "{}", "x"], lambda c: C.json_field(c, "$.k")) == ["5", None, None]
    assert apply(spark, [1.0, 0.0, -1.0], C.safe_log, "double") == [0.0, None, None]


def test_rounding_is_half_up(spark):
    assert rows(spark.range(1).select(C.half_up(F.lit(2.5), 0), C.half_up(F.lit(1.125), 2))) == [(3.0, 1.13)]
