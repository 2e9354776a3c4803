"""Tables of operators that work in several threads."""

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from vidimus.llm import common


def test_threads_leave_each_others_tables(spark):
    def work(n):
        with common.scratch(spark) as keep:
            gone = common.written(spark.range(n))
            kept = keep(common.written(spark.range(n + 1)))
            inner = [common.written(spark.range(3)) for _ in range(3)]
            assert gone.count() == n and all(t.count() == 3 for t in inner)
        return kept.count(), Path(gone.scratch_path).exists(), common.left_behind() == [kept.scratch_path]

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(8))) == [(n + 1, False, True) for n in range(8)]


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *_: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session)
