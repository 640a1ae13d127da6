"""Explicit Spark schemas; nothing in this package infers a schema."""

from pyspark.sql import types as T

SRC_FILES = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("content", T.StringType()),
])

FINDING = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("line", T.IntegerType()),
    T.StructField("end_line", T.IntegerType()),
    T.StructField("vuln_type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("code_snippet", T.StringType()),
    T.StructField("taint_source", T.StringType()),
    T.StructField("rule_id", T.StringType()),
])
FINDING_COLUMNS = FINDING.fieldNames()

RULE = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("engine", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("cwe", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("languages", T.ArrayType(T.StringType())),
    T.StructField("sink_patterns", T.ArrayType(T.StringType())),
    T.StructField("args_pattern", T.StringType()),
    T.StructField("args_must_match", T.StringType()),
    T.StructField("lhs_name_pattern", T.StringType()),
    T.StructField("requires_taint", T.BooleanType()),
    T.StructField("recommendation", T.StringType()),
    T.StructField("explanation", T.StringType()),
])

DEPENDENCY = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("package", T.StringType()),
    T.StructField("ecosystem", T.StringType()),
])

# One record of an OSV export, restricted to the fields that are used.
OSV_RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("affected", T.ArrayType(T.StructType([
        T.StructField("package", T.StructType([
            T.StructField("name", T.StringType()),
            T.StructField("ecosystem", T.StringType()),
        ])),
    ]))),
])
