"""Rows that carry errors, in all modes."""

import pytest

from wavelake.operators import modes


def test_modes(spark):
    rows = [("a", 2, "late"), ("a", 1, None), ("b", 1, "two"), ("b", 0, "one"), ("c", 0, None)]
    df = spark.createDataFrame(rows, "file string, n long, error string").repartition(4)
    assert sorted(map(tuple, modes.first_errors(df, ["file"], ["n"]).collect())) == [("a", 2, "late"), ("b", 0, "one")]
    assert modes.in_mode(df, "PERMISSIVE", ["n"]).count() == 5 and modes.in_mode(df, "DROPMALFORMED", ["n"]).count() == 2
    with pytest.raises(Exception, match="file b, n 0: one"):
        modes.in_mode(df.where("file <> 'a'"), "FAILFAST", ["file", "n"]).collect()
    assert modes.in_mode(df.where("error is null"), "FAILFAST", ["file", "n"]).count() == 2
    assert sorted(r.file for r in modes.strict(df, ["file"], "error is not null").collect()) == ["c"]
    with pytest.raises(ValueError):
        modes.in_mode(df, "other", ["n"])
