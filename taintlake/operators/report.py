"""Union, deduplication, ranking and roll-ups of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from taintlake.plans.storage import saved
from taintlake.rules.catalog import CONFIDENCE_RANK, SEVERITY_RANK
from taintlake.schemas import FINDING_COLUMNS

KEY = ["file_path", "line", "vuln_type"]


def rank_of(col: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, value in ranks.items():
        out = F.when(col == name, value).otherwise(out)
    return out


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def key_of(findings: DataFrame) -> list[str]:
    """What one finding is told apart by; dependency findings also by their project."""
    return [*KEY, "project"] if "project" in findings.columns else KEY


def dedupe(findings: DataFrame) -> DataFrame:
    """One finding per file, line and type: the most confident, among equals the
    first met.  A minimum is taken instead of a row number, so copies are merged
    before the shuffle and no group has to be held in one task.  ``first_seq`` is
    where the key was met first."""
    key = key_of(findings)
    rest = [c for c in findings.columns if c not in (*key, "seq")]
    best = F.struct((-rank_of(F.col("confidence"), CONFIDENCE_RANK)).alias("c"), F.col("seq"),
                    *[F.col(c) for c in rest])
    out = findings.groupBy(*key).agg(F.min(best).alias("b"), F.min("seq").alias("first_seq"))
    return out.select(*[F.col(c) if c in key else F.col(f"b.{c}").alias(c)
                        for c in findings.columns if c != "seq"],
                      F.col("b.seq").alias("seq"), "first_seq")


def _order() -> list[Column]:
    return [rank_of(F.col("severity"), SEVERITY_RANK).desc(), F.col("score").desc(), F.col("file_path").asc(),
            F.col("line").asc(), F.col("first_seq").asc()]


def rank(findings: DataFrame) -> DataFrame:
    """Findings in report order: severity, score, file, line, order met."""
    return findings.orderBy(*_order())


def with_rank(findings: DataFrame) -> DataFrame:
    """Explicit global ``rank`` column without a one-task window: rows are range
    partitioned in report order, sorted and numbered where they lie, and written
    once, so that a lost task cannot number them anew.  A row's number holds its
    partition in the upper bits; adding the sizes of the partitions before, one
    row each, needs no further shuffle of the findings."""
    order = _order()
    parts = saved(findings.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_row", F.monotonically_increasing_id()), "ranked")
    parts = parts.withColumn("_range", F.shiftright("_row", 33)).withColumn(
        "_row", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = parts.groupBy("_range").count().select("_range", F.expr(
        "coalesce(sum(count) OVER (ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    ).alias("_before"))
    return (parts.join(before, "_range").withColumn("rank", F.col("_before") + F.col("_row"))
            .drop("_range", "_row", "_before"))


def finished(findings: DataFrame) -> DataFrame:
    """The 16 public columns."""
    return findings.select(*FINDING_COLUMNS)


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("file_path").agg(F.count("*").alias("n_findings"))


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "cwe", "category").agg(
        F.count("*").alias("n_findings"), F.max("score").alias("max_score"))


def _in_file(findings: DataFrame) -> tuple[list[str], list[Column]]:
    """What a report is made for, and the order of findings inside it."""
    keys = [c for c in ("project", "file_path") if c in findings.columns]
    return keys, [(-rank_of(F.col("severity"), SEVERITY_RANK)).alias("s"), (-F.col("score")).alias("n"),
                  F.col("line").alias("l"), F.col("first_seq").alias("q")]


def write_nested(findings: DataFrame, path: str) -> None:
    """The nested reports as text files of JSON documents, a document per file (and
    project) and a line per finding, in report order.

    No report is held as a value: rows are sorted by file, which spills, and each becomes
    its line of the document.  The first one opens the document and the last one closes
    it, so a file may have any number of findings."""
    keys, order = _in_file(findings)
    finding = F.struct(*[c for c in FINDING_COLUMNS if c != "file_path"])
    # Equal rows in all of the order are told apart by the rest, as in ``nested_report``.
    over = Window.partitionBy(*keys).orderBy(*order, finding)
    rows = findings.select(*keys, F.to_json(finding).alias("json"), F.row_number().over(over).alias("i"),
                           F.lead(F.lit(1)).over(over).isNull().alias("last"))
    head = F.to_json(F.struct(*keys))
    opens = F.concat(F.substring(head, F.lit(1), F.char_length(head) - 1), F.lit(',"findings":['))
    closes = F.concat(F.lit('],"n_findings":'), F.col("i").cast("string"), F.lit("}"))
    rows.select(F.concat(F.when(F.col("i") == 1, opens).otherwise(","), F.col("json"),
                         F.when(F.col("last"), closes).otherwise("")).alias("value")).write.text(path)


def nested_report(findings: DataFrame) -> DataFrame:
    """One row per file with its findings in report order.  A file's findings are
    bounded by its lines times the rules, after deduplication; for dependency
    findings, one row per project and package, bounded by the package's advisories.
    ``write_nested`` writes the same without a row that holds them all."""
    keys, order = _in_file(findings)
    order = F.struct(*order, F.struct(*[c for c in FINDING_COLUMNS if c != "file_path"]).alias("finding"))
    return (findings.groupBy(*keys)
            .agg(F.count("*").alias("n_findings"), F.sort_array(F.collect_list(order)).alias("f"))
            .select(*keys, "n_findings", F.col("f.finding").alias("findings")))
