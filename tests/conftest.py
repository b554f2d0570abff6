import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from gustline.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield configure(s)
    s.stop()


def rows(df, *cols):
    """Rows as plain tuples in a stable order."""
    out = [tuple(r[c] for c in (cols or df.columns)) for r in df.collect()]
    return sorted(out, key=repr)
