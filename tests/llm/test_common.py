"""Scratch tables go with their block."""

import os

import pytest

from auditframe.llm.common import scratch, stored


def test_scratch(spark, tmp_path):
    df = spark.range(10)
    with scratch(spark) as outer:
        table = stored(df, "kept")
        with scratch(spark) as inner:
            assert stored(df, "gone").count() == 10 and inner.startswith(outer)
        assert not os.path.exists(inner) and table.count() == 10
        table.write.parquet(str(tmp_path / "out"))
    assert not os.path.exists(outer) and spark.read.parquet(str(tmp_path / "out")).count() == 10
    with pytest.raises(ZeroDivisionError), scratch(spark) as failed:
        stored(df, "x")
        1 / 0  # noqa: B018
    assert not os.path.exists(failed) and stored(df, "y").count() == 10
