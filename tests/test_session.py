import threading
import time

import pytest
from pyspark.sql import functions as F

from tesserae.session import Latest, collect_within, scratch, staged, staging


def slow(spark):
    @F.udf("long")
    def wait(x):
        time.sleep(20)
        return x

    return spark.range(1).select(wait("id").alias("id"))


def test_collect_within(spark):
    assert [r.id for r in collect_within(spark.range(2), 60)] == [0, 1]
    began = time.time()
    assert collect_within(slow(spark), 0.5) is None and time.time() - began < 15
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        collect_within(spark.sql("select 1 / 0"), 60)


def test_latest_question_wins(spark):
    ask, got = Latest(spark), {}
    first = threading.Thread(target=lambda: got.update(first=ask.ask(lambda: slow(spark))))
    first.start()
    time.sleep(2)
    assert [r.id for r in ask.ask(lambda: spark.range(1))] == [0]
    first.join(30)
    assert got == {"first": None}


def test_staged_tables_go_with_their_scope(spark):
    import os

    with staging(spark):
        path = scratch(spark, "x").removeprefix("file://")
        df = staged(spark.range(3))
        folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder) and not os.path.exists(path)
