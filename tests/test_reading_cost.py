"""Readings look for cheap signs first: how many regular expressions a plan holds, and results on odd texts."""

import re

import pytest
from pyspark.sql import functions as F

from plinth.functions import members as M, signals as S

REGEX = re.compile(r"RLIKE|regexp_\w+\(")


def regexes(df):
    """Regular expressions in the optimized plan."""
    return len(REGEX.findall(df._jdf.queryExecution().optimizedPlan().toString()))


def column(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_slot_record_reads_a_text_by_few_expressions(spark):
    """F6."""
    df = spark.createDataFrame([(["a"],)], "texts array<string>").repartition(1)
    assert regexes(df.select(M.slot_record(F.col("texts")))) <= 100


def test_slot_record_of_odd_texts(spark):
    """F6."""
    texts = ["  N A M E N A M E　", "(T&B) hoop bar", "부 호 부 호", None, " ", "Cx", "C1 D10", "fck=24", "fck=24 3-D10", "D10@1", "D10@2", "D10@3", "3 0 0x400", "x" * 33, "y" * 41]
    got = spark.createDataFrame([(texts,)], "texts array<string>").select(M.slot_record(F.col("texts")).alias("r")).select("r.*").first()
    assert tuple(got) == ("Cx", "y" * 41, "3 0 0x400", "fck=24", "C1 D10", "D10@1", "D10@3")


@pytest.mark.parametrize("last, want", [(["D10@1"], ("D10@1", "")), ([], ("", "")), (["D10@1", "z", "D12@2"], ("D10@1", "D12@2"))])
def test_slot_record_hoops(spark, last, want):
    """F6."""
    got = spark.createDataFrame([(["C1", *last],)], "texts array<string>").select(M.slot_record(F.col("texts")).alias("r")).select("r.*").first()
    assert (got.mid_hoop, got.end_hoop) == want


def test_signals_stay_out_of_one_long_method(spark):
    """in whole-stage code all of the signals are one method, which the JVM doesn't compile."""
    df = S.with_signals(column(spark, ["3-D10"]).repartition(1), "text", "s")
    assert regexes(df) <= 50
    top = df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]
    assert top.startswith("Project") and "lambdafunction" in top


def test_signals_of_odd_texts(spark):
    """F7, F10."""
    texts = ["　3-D10 @200 300x400 ", "uhd 12", "SHD 13", "99999999999x5", "120(80)", "12 / 34", "1f ~ 3F", "rf", "2층", "3 - 5 G1 1200", "B1F", "", None, "C1 300\u0085"]
    got = [tuple(r) for r in S.with_signals(column(spark, texts).coalesce(1), "text", "s").select("s.*").collect()]
    none = (None,) * 7
    assert got == [
        (3, 10, 200, [300, 400], None, None, None), (None, 12, *none[2:]), (None, 13, *none[2:]), (*none[:3], [None, 5], *none[4:]), (*none[:4], [120, 80], None, None), (*none[:4], [12, 34], None, None),
        (*none[:5], ["1f", "3F"], None), (*none[:6], ["rf"]), (*none[:6], ["2층"]), (*none[:5], ["3", "5"], None), (*none[:6], ["B1F"]), none, none, none,
    ]


def test_member_title_asks_for_zones_last(spark):
    """F9."""
    df = column(spark, ["RG1"]).repartition(1)
    assert regexes(df.select(M.is_member_title(F.col("text")))) <= 120
    texts = ["RG13 (1000x900)", "INT.", "END (INT.)", "G1 INT", "1,200", "3-D10", "width", "all", "mid span", "양단부 2", "RC", None, "가나"]
    got = [r[0] for r in column(spark, texts).coalesce(1).select(M.is_member_title(F.col("text"))).collect()]
    assert got == [True, False, False, True, False, False, False, False, False, True, False, False, True]
