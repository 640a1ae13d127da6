import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def findings_of(spark):
    """Scan {file name: text} and return {file name: {(line, rule_id)}}."""
    from taintlake.plans.scan import scan

    def run(files, **kwargs):
        df = spark.createDataFrame([(n, n, t) for n, t in files.items()], "path string, file_name string, content string")
        out = {n: set() for n in files}
        for r in scan(df.repartition(3), **kwargs).collect():
            out[r.file_path].add((r.line, r.rule_id))
        return out
    return run
