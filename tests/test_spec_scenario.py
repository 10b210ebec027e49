import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefero.operators import scenario
from prefero.operators.mnl import MNL
from prefero.operators.spec import choice_index, compile_spec, spec_of_matrix
from prefero.sources.tables import read_table


def test_compile():
    d = compile_spec({"a": {"x": "UNO", "y": "Sero"}, "b": {"x": "c0", "y": 2}, "c": {"y": None}}, ("x", "y"), ["c0"], segments=2)
    assert d.names == ("a", "b", "c", "a_s2", "b_s2", "c_s2")
    assert d.cells[0] == (1.0, "c0", None) * 2 and d.cells[1] == (None, 2.0, None) * 2
    assert d.columns() == ["c0"]
    with pytest.raises(ValueError, match="'C0'"):
        compile_spec({"b": {"x": "C0"}}, ("x",), ["c0"])
    with pytest.raises(ValueError):
        spec_of_matrix([["uno"]], ("x", "y"))


def test_choice_index(spark):
    df = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 0)], "a int, b int, c int")
    assert [r[0] for r in df.select(choice_index(["a", "b", "c"])).collect()] == [1, 0, 0]


def test_overrides_swap_and_refuse(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert scenario.apply_overrides(df, {"a": "b", "b": "a"}).first() == (2.0, 1.0)
    assert scenario.apply_overrides(df, {"a": 5}).first() == (5.0, 2.0)
    for bad in ({"z": 1}, {"a": "z"}):
        with pytest.raises(ValueError, match="'z'"):
            scenario.apply_overrides(df, bad)
    assert scenario.scenarios_of(pd.DataFrame({"a": [1, 2]})) == {"0": {"a": 1}, "1": {"a": 2}}


def test_comparison_of_zero_is_nan(spark):
    df = spark.createDataFrame([("b", "x", 0.5), ("t", "x", 0.6), ("b", "y", 0.0), ("t", "y", 0.1)], "scenario string, alternative string, share double")
    got = {r["alternative"]: r["change"] for r in scenario.comparison(df, "b", "t").collect()}
    assert got["x"] == pytest.approx(20.0) and math.isnan(got["y"])


def test_unavailable_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0), (0, 1, 1.0, 0.0)], "x int, y int, ax double, ay double")
    m = MNL(df, ["x", "y"], {"c": {"y": "uno"}}, ["ax", "ay"])
    m.from_estimates([0.3])
    rows = m.predict().collect()
    assert (rows[0]["p_x"], rows[0]["p_y"]) == (0.0, 0.0) and (rows[1]["p_x"], rows[1]["p_y"]) == (1.0, 0.0)
    with pytest.raises(ValueError, match="nulls"):
        MNL(df.withColumn("z", F.lit(None).cast("double")), ["x", "y"], {"c": {"y": "z"}}).fit()


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "a.dat").write_text("x  y\n1   2\n3 4\n")
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "a.csv")).collect()] == [(1, 2), (3, 4)]
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "a.dat")).collect()] == [(1.0, 2.0), (3.0, 4.0)]
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "no.csv"))
