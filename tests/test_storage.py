import subprocess
import sys
from pathlib import Path

import pytest

from quire.plans import storage

ROOT = Path(storage.__file__).parents[2]


class Cluster:
    """A session on a cluster that has no shared folder."""

    class sparkContext:  # noqa: N801
        master = "spark://somewhere:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return type("Context", (), {"getCheckpointDir": lambda self: type("None_", (), {"isEmpty": lambda self: True})()})()

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default=None):
            return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        storage.folder(Cluster)


def test_nothing_is_left_behind(tmp_path):
    """What is stored and checkpointed goes when the program ends."""
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from quire.plans import storage
assert storage.stored(spark.range(9)).count() == 9
storage.folder(spark)
assert spark.range(5).checkpoint().count() == 5
import os
assert sum(len(f) for _, _, f in os.walk({str(tmp_path / "shared")!r})) > 2
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=200)
    assert [p for p in (tmp_path / "shared").rglob("*") if p.is_file()] == []
