import textwrap

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def project(tmp_path):
    """Writes files given by path and text, and returns their folder."""

    def write(**files):
        for name, text in files.items():
            path = tmp_path / name.replace("__SLASH__", "/")
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(textwrap.dedent(text))
        return tmp_path

    return lambda files: write(**{k.replace("/", "__SLASH__"): v for k, v in files.items()})
