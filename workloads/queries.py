"""Queries over the given tables, one per operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from taintlake.functions import text
from taintlake.operators import deps, facts, html, line_rules, project, report, rule_index, taint, views
from taintlake.plans.scan import raw_findings, scan
from taintlake.plans.storage import saved, shared_dir
from taintlake.rules.catalog import STRUCT_LANGS
from taintlake.schemas import FINDING_COLUMNS
from taintlake.sources import packages
from taintlake.sources.files import as_source_files, read_archives, split_blank
from taintlake.sources.packages import read_dependencies
from taintlake.sources.sinks import read_batches, write_batch
from taintlake.streaming.scan_stream import line_findings_stream, scan_batches
from workloads import catalogue, corpus

SHOWN = ["file_path", "line", "rule_id", "vuln_type", "severity", "score", "cwe", "confidence", "category", "lang",
         "code_snippet"]


def shown(findings: DataFrame) -> DataFrame:
    return findings.select(*[F.col(c).cast("long").alias(c) if c == "line" else F.col(c) for c in SHOWN])


def scan_findings(spark: SparkSession, sf: str) -> DataFrame:
    return shown(scan(corpus.code_corpus(spark, sf)))


def _scan_only(*only: str, lang: str | None = None, where: str = "true"):
    """A scan with some kinds of rules, of files in one language if it is given."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        files = corpus.code_corpus(spark, sf)
        if lang is not None:
            files = files.where(project.lang_of(F.col("file_name")) == lang)
        return shown(scan(files, only=list(only)).where(where))
    return query


# ------------------------------------------------------------------ projections
def ingest_lenient(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with broken bytes on both sides come back whole; blank rows apart."""
    docs = corpus.table(spark, sf, "documents")
    broken = docs.select("doc_id", F.concat(F.unhex(F.lit("FF62")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
                         .alias("content"))
    decoded = broken.select("doc_id", text.decode_lenient(F.col("content")).alias("content"))
    ok, blank = split_blank(decoded, "content")
    both = ok.withColumn("reject_reason", F.lit("")).unionByName(blank)
    return both.select("doc_id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"),
                       "reject_reason")


def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    files = project.with_engine(project.with_lang(corpus.code_corpus(spark, sf)))
    return files.select("path", "lang", "engine")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus.table(spark, sf, "documents")
    return as_source_files(docs, F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"))


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    lines = project.to_lines(_documents(spark, sf))
    return lines.select("path", F.col("line_no").cast("long").alias("line_no"),
                        text.snippet(F.col("line")).alias("snippet"), F.length("line").cast("long").alias("n_chars"))


ARCHIVE_FILES = 200


def archived_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into ZIP archives, some of them cut off, and read again: members
    and archives that cannot be read, by their reason."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / ARCHIVE_FILES).alias("archive"))
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    corpus.write_archives(docs, folder)
    rows = read_archives(spark, folder, exts=[".txt"])
    name = F.regexp_extract("path", "/(a[0-9]+x?\\.zip.*)$", 1)
    return rows.select(name.alias("name"), F.octet_length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"),
                       F.split("reject_reason", ":")[0].alias("reason"))


def sink_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written to the sink in three batches, one of them twice, and read back."""
    found = saved(scan(corpus.code_corpus(spark, sf), only=["config"]), "findings")
    path = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    for batch in (0, 1, 1, 2):
        write_batch(found.where(F.pmod(F.crc32(F.col("file_path").cast("binary")), F.lit(3)) == batch), path, batch)
    return shown(read_batches(spark, path))


# ------------------------------------------------------------------ line engines
def line_rule_scan(spark: SparkSession, sf: str) -> DataFrame:
    return shown(scan(_documents(spark, sf), only=["fallback"]))


CUSTOM_RULES = [
    ("CUSTOM-email", "E-mail Address", r"[a-z0-9._-]+@[a-z0-9.-]+\.[a-z]{2,}", "Low", 2.0),
    ("CUSTOM-licence", "Licence Text", r"licen[cs]e", "Low", 1.0),
    ("CUSTOM-ipv4", "IPv4 Address", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "Medium", 3.0),
]


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([(i, n, [p], s, x) for i, n, p, s, x in CUSTOM_RULES],
                                  "rule_id string, name string, sink_patterns array<string>, severity string,"
                                  " score double")
    found = scan(_documents(spark, sf), rules=rules, only=["config"]).where("category = 'Custom'")
    return found.select("file_path", F.col("line").cast("long").alias("line"), "rule_id", "vuln_type", "severity",
                        "score", "confidence", "code_snippet")


def pattern_match(spark: SparkSession, sf: str) -> DataFrame:
    """Dynamic pattern lists over whole documents."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    rules = [(i, p) for i, _, p, _, _ in CUSTOM_RULES] + [("CUSTOM-digits", r"[0-9]{6,}")]
    return line_rules.match_rules(docs, "text", rules).select("doc_id", "rule_id")


def rule_table(docs: DataFrame) -> DataFrame:
    """A rule per document: its first three words, for some of them also the next three,
    with any blanks before the last; and a few that demand no literal."""
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0))
    some = lambda i: F.concat(F.get("w", F.lit(i)), F.lit(" "), F.get("w", F.lit(i + 1)), F.lit("[ ]+"), F.get("w", F.lit(i + 2)))
    rows = docs.select("doc_id", words.alias("w")).where("size(w) >= 6")
    pattern = (F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("[0-9]{"), (F.col("doc_id") % 7 + 3).cast("string"), F.lit("}")))
               .when(F.col("doc_id") % 5 == 0, F.concat(F.lit("(?:"), some(0), F.lit("|"), some(3), F.lit(")"))).otherwise(some(0)))
    return rows.select(F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("rule_id"), pattern.alias("pattern"))


def rule_table_match(spark: SparkSession, sf: str) -> DataFrame:
    """A rule table as long as the documents, against the documents."""
    docs = corpus.table(spark, sf, "documents").select("doc_id", "text")
    return rule_index.match_rule_table(docs, "text", rule_table(docs)).select("doc_id", "rule_id")


# -------------------------------------------------------------------------- HTML
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = corpus.table(spark, sf, "pages")
    path = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".html"))
    return project.with_lang(as_source_files(pages, path, F.col("html")))


PAGE_TAIL = '\n<script>\nvar h = location.hash;\nout.innerHTML = h;\n</script>\n<a href="javascript:go()">x</a>\n'


def html_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_scripts(_pages(spark, sf)).select(
        "path", F.col("unit_no").cast("long").alias("unit_no"), F.col("line_offset").cast("long").alias("line_offset"),
        "content")


def html_attrs(spark: SparkSession, sf: str) -> DataFrame:
    return html.html_attrs(_pages(spark, sf)).select("path", F.col("line").cast("long").alias("line"), "attr", "value")


def page_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Real pages through every engine: text that merely looks like code.  Every second
    page ends in a script and a link that are to be found."""
    tail = F.when(F.col("path").rlike("[02468]\\.html$"), F.lit(PAGE_TAIL)).otherwise("")
    return shown(scan(_pages(spark, sf).withColumn("content", F.concat("content", tail))))


# ------------------------------------------------------------------------- facts
def _units(spark: SparkSession, sf: str) -> DataFrame:
    files = project.with_lang(corpus.code_corpus(spark, sf))
    return facts.as_units(files.where(F.col("lang").isin(STRUCT_LANGS)))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    return facts.file_facts(_units(spark, sf))


def token_lines(spark: SparkSession, sf: str) -> DataFrame:
    units = _units(spark, sf)
    rows = views.tokens(units)
    # Spark takes the size of lines for that of the orders' columns and would broadcast them.
    return (rows.groupBy("file_id", "line").agg(F.count("*").alias("n_tokens"))
            .join(units.select("file_id", "path").hint("merge"), "file_id")
            .select("path", F.col("line").cast("long").alias("line"), "n_tokens"))


def call_facts(spark: SparkSession, sf: str) -> DataFrame:
    return views.calls(_facts(spark, sf)).select("path", F.col("line").cast("long").alias("line"), "callee", "args")


def assign_facts(spark: SparkSession, sf: str) -> DataFrame:
    return views.defs(_facts(spark, sf)).select(
        "path", F.col("line").cast("long").alias("line"), "lhs_text", "rhs_text", "is_simple", "is_literal")


def reaching_defs(spark: SparkSession, sf: str) -> DataFrame:
    return views.reached_uses(_facts(spark, sf)).select(
        "path", "ctx_kind", F.col("line").cast("long").alias("line"), "var",
        F.col("def_line").cast("long").alias("def_line"))


def flow_taint(spark: SparkSession, sf: str) -> DataFrame:
    return views.tainted_defs(_facts(spark, sf)).select("path", F.col("line").cast("long").alias("line"), "var")


# ------------------------------------------------------------------------- taint
def taint_closure(spark: SparkSession, sf: str) -> DataFrame:
    files = project.with_lang(corpus.code_corpus(spark, sf)).where("lang = 'unknown'")
    lines = project.to_lines(files)
    seeds, edges = corpus.order_graph(spark, sf)
    out = taint.taint_closure(seeds.unionByName(taint.taint_seeds(lines)),
                              edges.unionByName(taint.taint_edges(lines)))
    return out.select("path", "var", F.col("depth").cast("long").alias("depth"))


def tainted_lines(spark: SparkSession, sf: str) -> DataFrame:
    files = project.with_lang(corpus.code_corpus(spark, sf)).where("lang = 'unknown'")
    lines = project.to_lines(files).select("path", "line_no", "line")
    closure = taint.taint_closure(taint.taint_seeds(lines), taint.taint_edges(lines))
    return taint.tainted_lines(lines, closure).select("path", F.col("line_no").cast("long").alias("line_no"), "line")


# ------------------------------------------------------------------ dependencies
LABELS = ["Python Package", "Node.js Package", "Java Package", "Go Package", "C / C++ Library",
          "Linux Package (Debian/Ubuntu)", "Alpine Linux Package"]


def _deps_and_advisories(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    found = corpus.dependencies(spark, sf)
    # Every customer adds a padded name, a blank one and an unknown ecosystem.
    key = F.col("c_custkey").cast("string")
    more = corpus.table(spark, sf, "customer").select(F.explode(F.array(
        F.struct(F.concat(F.lit("cust"), key).alias("project"),
                 F.concat(F.lit(" \t pkg"), (F.col("c_custkey") % 500).cast("string"), F.lit("\n")).alias("package"),
                 F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("c_custkey") % 7 + 1).cast("int"))
                 .alias("ecosystem")),
        F.struct(F.concat(F.lit("cust"), key).alias("project"), F.lit(" \t ").alias("package"),
                 F.lit("npm").alias("ecosystem")),
        F.struct(F.concat(F.lit("cust"), key).alias("project"), F.lit("pkg1").alias("package"),
                 F.lit("Unknown").alias("ecosystem")))).alias("x")).select("x.*")
    ok, _ = split_blank(found.unionByName(more), "package")
    return deps.normalise_ecosystem(read_dependencies(ok)), corpus.advisories(spark, sf)


def dep_advisories(spark: SparkSession, sf: str) -> DataFrame:
    found, adv = _deps_and_advisories(spark, sf)
    return deps.match_advisories(found, adv).select(
        "project", "file_path", F.col("line").cast("long").alias("line"), "vuln_type", "severity", "score",
        "explanation", "lang", "confidence")


def dep_clean(spark: SparkSession, sf: str) -> DataFrame:
    return deps.clean_dependencies(*_deps_and_advisories(spark, sf))


def advisory_records(spark: SparkSession, sf: str) -> DataFrame:
    """An advisory export, a record per part, written and read again: what names a package,
    and what is rejected (broken JSON, no affected package, an entry without a name)."""
    part, key = corpus.table(spark, sf, "part"), F.col("p_partkey")
    name = F.when(key % 6 != 0, F.concat(F.lit("pkg"), key.cast("string")))
    entry = lambda n, e: F.struct(F.struct(n.alias("name"), F.lit(e).alias("ecosystem")).alias("package"))
    affected = F.when(key % 10 != 0, F.array(entry(name, "PyPI"), entry(F.lit("shared"), "npm")))
    record = F.to_json(F.struct(F.concat(F.lit("ADV-"), key.cast("string")).alias("id"), F.col("p_name").alias("summary"), affected.alias("affected")))
    folder = f"{shared_dir(spark)}/advisories-{uuid.uuid4().hex}"
    part.select(F.when(key % 7 == 0, F.substring(record, 1, 20)).otherwise(record).alias("value")).write.text(folder)
    good = packages.read_advisories(spark, folder).select("id", "package", "ecosystem", F.lit("").alias("reject_reason"))
    bad = packages.rejected_advisories(packages.read_advisory_records(spark, folder))
    return good.unionByName(bad.select(F.coalesce("id", F.lit("")).alias("id"), F.lit("").alias("package"), F.lit("").alias("ecosystem"), "reject_reason"))


# ----------------------------------------------------------------------- reports
def _line_item_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings with many duplicates of one key, over all of ``lineitem``."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    sev = F.col("l_suppkey") % 5
    return corpus.table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), (F.col("l_orderkey") % 5000).cast("string")).alias("file_path"),
        F.col("l_linenumber").alias("line"), pick(["A", "B", "C"], F.col("l_suppkey") % 3).alias("vuln_type"),
        pick(["Critical", "High", "Medium", "Low", "Other"], sev).alias("severity"),
        (F.lit(10.0) - F.col("l_suppkey") % 7).alias("score"),
        pick(["High", "Medium", "Low", "?"], F.col("l_partkey") % 4).alias("confidence"),
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))


def dedupe_findings(spark: SparkSession, sf: str) -> DataFrame:
    return report.dedupe(_line_item_findings(spark, sf)).select(
        "file_path", F.col("line").cast("long").alias("line"), "vuln_type", "severity", "score", "confidence", "seq",
        "first_seq")


def ranked_findings(spark: SparkSession, sf: str) -> DataFrame:
    return report.with_rank(report.dedupe(_line_item_findings(spark, sf))).select(
        F.col("rank").cast("long").alias("rank"), "file_path", F.col("line").cast("long").alias("line"), "vuln_type",
        "severity", "score")


def file_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per file: count, and the nested report flattened to its order."""
    found = scan(corpus.code_corpus(spark, sf))
    return report.nested_report(found).select(
        "file_path", "n_findings",
        F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["line"].cast("string"), f["rule_id"])), ",")
        .alias("rules"))


def severity_report(spark: SparkSession, sf: str) -> DataFrame:
    return report.by_severity(scan(corpus.code_corpus(spark, sf)))


def union_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Findings per engine before deduplication (a bag union)."""
    found = raw_findings(corpus.code_corpus(spark, sf))
    engine = (F.when(F.col("rule_id").startswith("FALLBACK-"), "fallback")
              .when(F.col("rule_id").startswith("CONFIGSCAN-"), "config")
              .when(F.col("rule_id").startswith("SECRETSCAN-"), "secrets").otherwise("struct"))
    return found.groupBy(engine.alias("engine")).agg(F.count("*").alias("n_findings"))


# --------------------------------------------------------------------- streaming
def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus as a stream over ``orders``, scanned batch by batch."""
    name = "orders"
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")
    files = corpus.code_files(corpus.spread(stream, spark.read.parquet(f"{sf}/{name}*.parquet").count()))
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def sink(found: DataFrame, batch_id: int) -> None:
        write_batch(found, f"{folder}/out", batch_id)

    scan_batches(files, sink, f"{folder}/state").awaitTermination()
    return shown(read_batches(spark, f"{folder}/out"))


def whole(findings: DataFrame) -> DataFrame:
    """All sixteen columns of a finding."""
    return findings.select(*[F.col(c).cast("long").alias(c) if c in ("line", "end_line") else F.col(c) for c in FINDING_COLUMNS])


def rule_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule of the catalogue, over one file per customer."""
    return whole(scan(catalogue.table(spark, sf)))


def stream_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The stateless line engines over a stream of the same files."""
    name = "customer"
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = catalogue.source_files(stream).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    found = line_findings_stream(files)
    (found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).start().awaitTermination())
    return whole(spark.read.schema(found.schema).parquet(f"{folder}/out"))


QUERIES = {
    "scan_findings": scan_findings,
    "ingest_lenient": ingest_lenient,
    "lang_detect": lang_detect,
    "line_split": line_split,
    "archived_documents": archived_documents,
    "line_rule_scan": line_rule_scan,
    "config_scan": _scan_only("config"),
    "secret_tokens": _scan_only("secrets"),
    "custom_rules": custom_rules,
    "pattern_match": pattern_match,
    "rule_table_match": rule_table_match,
    "html_scripts": html_scripts,
    "html_attrs": html_attrs,
    "html_findings": _scan_only("struct", lang="html"),
    "page_findings": page_findings,
    "token_lines": token_lines,
    "call_facts": call_facts,
    "assign_facts": assign_facts,
    "reaching_defs": reaching_defs,
    "flow_taint": flow_taint,
    "taint_closure": taint_closure,
    "tainted_lines": tainted_lines,
    "fallback_taint_scan": _scan_only("fallback"),
    "call_taint": _scan_only("call_taint"),
    "call_always": _scan_only("call_always"),
    "assign_taint": _scan_only("assign_taint"),
    "assign_literal": _scan_only("assign_literal"),
    "missing_flag": _scan_only("missing_flag"),
    "weak_random": _scan_only("lhs_random"),
    "php_echo": _scan_only("call_taint", lang="php", where="rule_id = 'XSS-1'"),
    "dep_advisories": dep_advisories,
    "dep_clean": dep_clean,
    "advisory_records": advisory_records,
    "dedupe_findings": dedupe_findings,
    "ranked_findings": ranked_findings,
    "file_report": file_report,
    "severity_report": severity_report,
    "union_counts": union_counts,
    "sink_batches": sink_batches,
    "stream_scan": stream_scan,
    "rule_findings": rule_findings,
    "stream_lines": stream_lines,
}
