"""Tables that cut lineage, and their release."""

import os

import pytest

from tablesmith.session import cut_lineage, ensure_checkpoint_dir, temporary_tables


def folders(spark):
    top = f"{ensure_checkpoint_dir(spark).removeprefix('file://')}/tablesmith-tables"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_release_removes_what_nothing_keeps(spark):
    outside = cut_lineage(spark.range(3))
    before = folders(spark)
    with temporary_tables(spark) as tables:
        a = cut_lineage(spark.range(10))
        with temporary_tables(spark) as inner:
            b = cut_lineage(a.where("id > 4"))
            assert inner.release() == 1
        c = cut_lineage(a.where("id > 6"))
        assert len(folders(spark) - before) == 2
        assert tables.release(keep=c) == 1 and c.count() == 3
        assert tables.release(keep=c) == 0
    assert len(folders(spark) - before) == 1 and before <= folders(spark)
    assert outside.count() == 3 and cut_lineage(spark.range(2)).count() == 2
    for gone in (a, b):
        with pytest.raises(Exception):
            gone.count()
