import os

from fleetskein import session
from fleetskein.session import discard, passing, written


def places(*tables):
    return [os.path.dirname(t.inputFiles()[0]).removeprefix("file://") for t in tables]


def test_tables_of_a_block_end_with_it(spark):
    with passing():
        with passing():
            inner, kept = written(spark.range(3), "inner"), written(spark.range(3), "kept", keep=True)
            (at_inner, at_kept) = places(inner, kept)
        assert not os.path.exists(at_inner) and kept.count() == 3
    assert not os.path.exists(at_kept) and not session._blocks()


def test_a_failure_ends_a_block(spark):
    try:
        with passing():
            (at,) = places(written(spark.range(3), "lost"))
            raise KeyError
    except KeyError:
        assert not os.path.exists(at) and not session._blocks()


def test_only_written_tables_are_discarded(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/own")
    own, made = spark.read.parquet(f"{tmp_path}/own"), written(spark.range(2), "made")
    (at,) = places(made)
    discard(own, made)
    discard(made)
    assert own.count() == 2 and not os.path.exists(at)
