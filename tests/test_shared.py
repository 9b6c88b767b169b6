"""Tables in the folder that the cluster shares."""

import os

import pytest

from skein.sources import shared


def test_recorded_tables_are_removed(spark):
    with shared.recorded() as outer:
        kept = shared.stored(spark.range(5), "kept")
        with shared.recorded() as inner:
            assert shared.stored(spark.range(3), "gone").count() == 3
    assert len(outer) == 2 and len(inner) == 1
    where = [p.removeprefix("file://") for p in outer]
    assert all(map(os.path.exists, where))
    shared.remove(spark, inner)
    assert [os.path.exists(p) for p in where] == [True, False] and kept.count() == 5
    assert shared.scratch(spark, "x") not in outer


def test_a_cluster_must_name_its_folder():
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster)
