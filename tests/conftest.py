import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [ROOT, f"{ROOT}/tests"]


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.executorEnv.PYTHONPATH", ROOT).getOrCreate()
    s.sparkContext.addPyFile(_zip())
    yield s
    s.stop()


def _zip():
    import tempfile
    import zipfile

    where = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "stepgraph.zip"
    with zipfile.ZipFile(where, "w") as z:
        for p in sorted(Path(ROOT, "stepgraph").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    return str(where)
