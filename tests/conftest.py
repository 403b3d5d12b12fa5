import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tillroll.session import DEFAULT_CONF, checkpoint_dir

    builder = SparkSession.builder.master("local[*]").appName("tillroll-tests")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    s = builder.config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="tillroll-tests-"))
    yield s


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
