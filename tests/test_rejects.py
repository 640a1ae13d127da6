"""Inputs that cannot be read, keys with a project, streams with user rules, and plans."""

import io
import json
import struct
import zipfile

from pyspark.sql import functions as F

from taintlake.operators import deps, html, report, views
from taintlake.operators.facts import as_units, file_facts
from taintlake.sources import files, packages
from taintlake.streaming.scan_stream import line_findings_stream, read_file_stream, scan_batches


def _zip(members: dict[str, str]) -> bytearray:
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return bytearray(blob.getvalue())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_damaged_archives_and_members(spark):
    bad_sum = _zip({"a.py": "eval(1)\n", "b.py": "eval(2)\n"})
    at = bad_sum.index(b"eval(1)")
    bad_sum[at:at + 4] = b"EVAL"
    locked = _zip({"c.py": "eval(3)\n"})
    for mark, offset in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        at = locked.index(mark) + offset
        locked[at:at + 2] = struct.pack("<H", 1)
    df = spark.createDataFrame([("sum.zip", bad_sum), ("locked.zip", locked), ("text.zip", bytearray(b"no archive")),
                                ("empty.zip", bytearray()), ("null.zip", None), ("ok.zip", _zip({"d.py": "x\n"}))],
                               "path string, content binary").repartition(3)
    assert sorted(r.path for r in files.expand_archives(df).collect()) == ["ok.zip!/d.py", "sum.zip!/b.py"]
    reasons = {r.path: r.reject_reason.split(":")[0] for r in files.rejected_archives(df).collect()}
    assert reasons == {"sum.zip!/a.py": "member", "locked.zip!/c.py": "member", "text.zip": "archive",
                       "empty.zip": "archive", "null.zip": "archive"}


def test_corrupt_advisories(spark, tmp_path):
    good = {"id": "A-1", "summary": "bad", "affected": [{"package": {"name": "p", "ecosystem": "PyPI"}}]}
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join([json.dumps(good), '{"id": "A-2", ', '{"id": "A-3", "affected": []}', '{"id": "A-4"}']))
    assert [r.id for r in packages.read_advisories(spark, str(lines)).collect()] == ["A-1"]
    gone = packages.rejected_advisories(packages.read_advisory_records(spark, str(lines))).collect()
    assert sorted((r.id or "", r.reject_reason) for r in gone) == [
        ("", "malformed JSON"), ("A-3", "no affected package"), ("A-4", "no affected package")]
    assert any(r.record.startswith('{"id": "A-2"') for r in gone)

    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps([good, dict(good, id="A-5")], indent=2))
    assert sorted(r.id for r in packages.read_advisories(spark, str(whole), multi_line=True).collect()) == ["A-1", "A-5"]


def test_dependency_findings_keep_their_project(spark):
    found = spark.createDataFrame([("x", "p", "PyPI"), ("y", "p", "PyPI"), ("y", "p", "PyPI")],
                                  "project string, package string, ecosystem string")
    adv = spark.createDataFrame([("A-1", "s", "p", "PyPI"), ("A-2", "s", "p", "PyPI")],
                                "id string, summary string, package string, ecosystem string")
    rows = deps.match_advisories(found, adv).withColumn("seq", F.col("vuln_type"))
    once = report.dedupe(rows)
    assert sorted((r.project, r.vuln_type) for r in once.collect()) == [
        ("x", "A-1"), ("x", "A-2"), ("y", "A-1"), ("y", "A-2")]
    nested = report.nested_report(once)
    assert {(r.project, r.file_path, r.n_findings) for r in nested.collect()} == {
        ("x", "dependency:p", 2), ("y", "dependency:p", 2)}


def test_ranks_are_gapless_over_many_ranges(spark):
    rows = spark.range(0, 3000).selectExpr(
        "concat('f', id % 7) AS file_path", "CAST(id AS INT) AS line", "'t' AS vuln_type",
        "element_at(array('Critical', 'High', 'Low'), CAST(id % 3 + 1 AS INT)) AS severity",
        "CAST(id % 5 AS DOUBLE) AS score", "'High' AS confidence", "id AS seq", "id AS first_seq").repartition(9)
    got = report.with_rank(rows).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 3001))
    weight = {"Critical": 4, "High": 3, "Low": 1}
    key = [(-weight[r.severity], -r.score, r.file_path, r.line) for r in got]
    assert key == sorted(key)


def test_streams_take_rules_and_keep_the_best(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.py").write_text("DEBUG = True\nfoo()\n")
    stream = read_file_stream(spark, str(folder))
    rules = spark.createDataFrame([("U-1", "Debug Mode Enabled", ["DEBUG"], "High"), ("U-2", "Foo", ["foo"], "Low")],
                                  "rule_id string, name string, sink_patterns array<string>, confidence string")
    q = (line_findings_stream(stream, rules=rules).writeStream.format("memory").queryName("best_findings")
         .option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted((r.line, r.rule_id) for r in spark.table("best_findings").collect()) == [(1, "U-1"), (2, "U-2")]

    seen = []
    q = scan_batches(stream, lambda df, i: seen.extend(df.collect()), str(tmp_path / "s2"), rules=rules,
                     trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert {(r.line, r.rule_id) for r in seen} == {(1, "U-1"), (2, "U-2")}


def test_plans(spark):
    pages = spark.createDataFrame([("p.html", "html", "<a href='x'>\n<b id=1>")], "path string, lang string, content string")
    assert "Exchange" not in plan_of(html.html_attrs(pages))
    assert [(r.pos, r.line, r.attr, r.value) for r in html.html_attrs(pages).orderBy("pos").collect()] == [
        (2, 1, "href", "x"), (7, 2, "id", "1")]
    code = spark.createDataFrame([("a.py", "python", "x = 1\ny = x")], "path string, lang string, content string")
    assert plan_of(views.reached_uses(file_facts(as_units(code)))).count("Join") == 0


def test_a_scan_reads_its_input_twice(spark, tmp_path):
    from taintlake.plans.scan import scan

    rows = [("a.py", "a.py", "q = input()\neval(q)\n"), ("b.html", "b.html", "<a href='javascript:x'>\n<script>eval(1)</script>"),
            ("c.txt", "c.txt", "x = argv[1]\nsystem(x)\nDEBUG = True\n"), ("d.py", "d.py", None)]
    spark.createDataFrame(rows, "path string, file_name string, content string").write.parquet(str(tmp_path / "src"))
    found = scan(spark.read.parquet(str(tmp_path / "src")))
    assert {(r.file_path, r.line, r.rule_id) for r in found.collect()} == {
        ("a.py", 2, "EVAL-1"), ("b.html", 1, "XSS-4"), ("b.html", 2, "EVAL-1"), ("c.txt", 2, "FALLBACK-Command_Injection"),
        ("c.txt", 3, "CONFIGSCAN-Debug_Mode_Enabled"), ("c.txt", 3, "FALLBACK-Information_Disclosure")}
    assert plan_of(scan(spark.read.parquet(str(tmp_path / "src")))).count("FileScan parquet") == 2
