"""The scan: source files in, findings out, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taintlake.operators import detect, facts, html, line_rules, report
from taintlake.operators.project import engine_of, fill_finding_defaults, with_lang
from taintlake.rules.catalog import JS, RULES, Rule, rules_frame
from taintlake.rules.custom import merge_rules


def units_of(files: DataFrame) -> DataFrame:
    """What a parser reads: whole files, and the scripts of pages, in one read."""
    item = "array<struct<lang:string,out_lang:string,line_offset:int,content:string>>"
    scripts = F.transform(html.scripts_of(F.col("content")), lambda s: F.struct(
        F.lit(JS).alias("lang"), F.lit(html.INLINE_LABEL).alias("out_lang"), s["line_offset"].alias("line_offset"), s["content"].alias("content")))
    whole = F.array(F.struct("lang", F.col("lang").alias("out_lang"), F.lit(0).alias("line_offset"), "content"))
    engine = engine_of(F.col("lang"))
    return files.select("path", F.posexplode(
        F.when(engine == "struct", whole.cast(item)).when(engine == "html", scripts.cast(item))
    ).alias("unit_no", "u")).select("path", "unit_no", "u.*")


def rule_hits(src_files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Hits of all engines: one read for those that look at a row alone, one for
    those that parse.  A branch exists only if a rule asks for it."""
    files = with_lang(src_files).select("path", "lang", "content")
    hits = []

    structural = detect.struct_rules(rules)
    by_call = [r for r in structural if r.rule_id != "XSS-4"]
    if by_call:
        units = units_of(files).where(detect.worth_parsing(by_call))
        found = detect.candidates(facts.file_facts(facts.as_units(units), all_uses=False), by_call)
        hits.append(detect.struct_hits(found, by_call))

    by_row = [r for r in rules if r.engine != "struct"]
    in_attr = [r for r in structural if r.rule_id == "XSS-4"]
    if by_row or in_attr:
        hits.append(line_rules.local_hits(files, by_row, in_attr))
    return report.union_findings(*hits)


def to_findings(hits: DataFrame, rules: list[Rule], keep: list[str] | None = None) -> DataFrame:
    """Hits to finding rows.  The catalogue is a handful of constants; the join
    is on its ordinal and Spark broadcasts it by its known size."""
    catalogue = rules_frame(hits.sparkSession, rules, [
        "rule_ord", "rule_id", "name", "severity", "score", "cwe", "confidence", "category", "explanation",
        "recommendation"])
    rows = hits.join(catalogue, "rule_ord").select(
        F.col("path").alias("file_path"), "line", F.col("name").alias("vuln_type"), "severity", "score", "cwe",
        "confidence", "category", "explanation", "recommendation", "lang",
        F.col("snippet").alias("code_snippet"), "rule_id", "seq", *(keep or []))
    return fill_finding_defaults(rows)


def raw_findings(src_files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    rules = RULES if rules is None else rules
    return to_findings(rule_hits(src_files, rules), rules)


def best_hits(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """The hits that ``report.dedupe`` keeps of their findings, with ``first_seq``.  They are
    sorted and shuffled without what the catalogue says of their rules, which is several
    times their size; nulls are those of ``fill_finding_defaults``."""
    names = rules_frame(hits.sparkSession, rules, ["rule_ord", "name", "confidence"])
    empty = F.lit("")
    rows = hits.join(names, "rule_ord").select(
        F.coalesce("path", empty).alias("file_path"), "line", F.coalesce("name", empty).alias("vuln_type"),
        F.coalesce("confidence", F.lit("Medium")).alias("confidence"), F.coalesce("lang", empty).alias("lang"),
        F.coalesce("snippet", empty).alias("snippet"), "rule_ord", "seq")
    return report.dedupe(rows).drop("vuln_type", "confidence").withColumnRenamed("file_path", "path")


def scan(src_files: DataFrame, rules: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """Deduplicated findings of all engines, with ``seq`` and ``first_seq``.

    ``rules`` adds user rules to the catalogue; ``only`` keeps the rules of the
    given kinds or engines."""
    chosen = RULES if rules is None else merge_rules(RULES, rules)
    if only is not None:
        chosen = [r for r in chosen if r.kind in only or r.engine in only]
    return to_findings(best_hits(rule_hits(src_files, chosen), chosen), chosen, keep=["first_seq"])
