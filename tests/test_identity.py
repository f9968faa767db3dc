"""One identity of values and numbers on every path, and no bound that changes an answer."""
import json

import pandas as pd
from pyspark.sql import functions as F, types as T

from tenetdq.functions.values import as_text, number_of
from tenetdq.operators import linear
from tenetdq.plans import algebra
from tenetdq.plans.frame import from_df
from tenetdq.sources.readers import read_csv, read_json


def test_kinds_follow_normalized_values_at_any_width(spark):
    values = [" " * (i % 700) + "abcde"[i % 5] for i in range(2100)]
    narrow = spark.createDataFrame(pd.DataFrame({"row_id": range(2100), "x": values}))
    wide = narrow.select("*", *[F.lit(str(i)).alias(f"c{i}") for i in range(70)])
    for table in (narrow, wide):
        found = from_df(table, "row_id").profile.by_column["x"]
        assert (found.kind, found.distinct) == ("categorical", 5)


def test_both_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,), (float("nan"),)], "x double")
    assert [r[0] for r in df.select(as_text(F.col("x"), T.DoubleType())).collect()] == ["0.0", "0.0", "1.5", "", ""]
    assert [str(r[0]) for r in df.select(number_of(F.col("x"), T.DoubleType())).collect()] == ["0.0", "0.0", "1.5", "None", "None"]


def test_a_float_is_the_number_its_text_shows(spark):
    df = spark.createDataFrame([(0.1,), (3.3,)], "x float")
    assert [r[0] for r in df.select(number_of(F.col("x"), T.FloatType())).collect()] == [0.1, 3.3]


def test_float_columns_get_linear_scores(spark):
    n = 600
    pdf = pd.DataFrame({"row_id": range(n), "x": [(i * 7 % 40) / 10 for i in range(n)], "y": [(i * 11 % 60) / 10 for i in range(n)]})
    pdf["z"] = (pdf.x + pdf.y).round(1)
    df = spark.createDataFrame(pdf).select("row_id", *[F.col(c).cast("float").alias(c) for c in "xyz"])
    frame = from_df(df, "row_id")
    scores = linear.LinearLearner().fit(frame).score(frame)
    assert scores.where("x is null or y is null or z is null").count() == 0


def test_all_keys_are_found():
    deps = [(frozenset(a), b) for a, b in [*zip("abcde", "ABCDE"), *zip("ABCDE", "abcde")]]
    found = algebra.keys("abcdeABCDE", deps)
    assert len(found) == 32 and {len(k) for k in found} == {5}


def test_csv_reads_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "a.csv")).collect())) == [("1", "x\ny"), ("2", "z")]


def test_json_columns_follow_a_long_first_record(spark, tmp_path):
    keys = [f"k{(i * 37) % 300}" for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps([dict.fromkeys(keys, 1)], indent=2))
    assert read_json(spark, str(tmp_path / "a.json")).columns == keys
