import os

from koine.sources.scratch import clear, shared_dir, written


def test_tables_are_written_read_and_removed(spark):
    got = written(spark.range(5), "numbers")
    assert got.count() == 5 and written(spark.range(0), "none").count() == 0
    folder = shared_dir(spark).removeprefix("file:")
    assert os.listdir(folder)
    clear(spark)
    assert not os.path.exists(folder)
    assert written(spark.range(2), "again").count() == 2
