"""Session settings that suit a scan."""

from pyspark.sql import SparkSession

SETTINGS = {
    # Token rows arrive sorted by file, so a sort aggregate streams one file at a
    # time; the hash variant would hold many files and then sort them again.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # Source text grows manyfold as tokens: keep more, smaller partitions than the
    # size of the shuffled text suggests.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
}
# The lexer and the rules become large generated methods, which the JVM leaves
# uncompiled by default.  Set it for driver and executors when they start.
JVM_OPTION = "-XX:-DontCompileHugeMethods"


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (builder.config("spark.driver.extraJavaOptions", JVM_OPTION)
            .config("spark.executor.extraJavaOptions", JVM_OPTION))
