"""Row-wise projections: language, routing, lines, defaults."""

from pyspark.sql import Column, DataFrame, functions as F

from taintlake.functions import text
from taintlake.rules.catalog import EXT_LANG, STRUCT_LANGS
from taintlake.schemas import FINDING


def lang_of(file_name: Column) -> Column:
    by_ext = F.create_map(*[F.lit(x) for pair in EXT_LANG.items() for x in pair])
    return F.coalesce(F.try_element_at(by_ext, text.extension(file_name)), F.lit("unknown"))


def with_lang(src_files: DataFrame) -> DataFrame:
    return src_files.withColumn("lang", lang_of(F.col("file_name")))


def engine_of(lang: Column) -> Column:
    return (F.when(lang == "html", "html").when(lang.isin(STRUCT_LANGS), "struct").otherwise("fallback"))


def with_engine(src_files: DataFrame) -> DataFrame:
    return src_files.withColumn("engine", engine_of(F.col("lang")))


def to_lines(src_files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1, without any shuffle."""
    keep = [c for c in src_files.columns if c != "content"]
    return (src_files
            .select(*keep, F.posexplode(text.split_lines(F.col("content"))).alias("_i", "line"))
            .select(*keep, (F.col("_i") + 1).alias("line_no"), "line"))


def fill_finding_defaults(findings: DataFrame) -> DataFrame:
    """Complete partial finding rows to the 16 columns, in order."""
    have = set(findings.columns)

    def get(name, default):
        return F.coalesce(F.col(name), default) if name in have else default

    line = F.col("line")
    end = F.col("end_line") if "end_line" in have else F.lit(None)
    cols = {
        "end_line": F.when(F.coalesce(end, F.lit(0)) == 0, line).otherwise(end),
        "confidence": get("confidence", F.lit("Medium")),
    }
    out = []
    for field in FINDING:
        value = cols.get(field.name)
        if value is None:
            value = F.col(field.name) if field.name in ("line", "score") else get(field.name, F.lit(""))
        out.append(value.cast(field.dataType).alias(field.name))
    extra = [c for c in findings.columns if c not in FINDING.fieldNames()]
    return findings.select(*out, *extra)


