"""Hot keys, repeated batches, huge archives and long files."""

import io
import json
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from taintlake.operators import deps
from taintlake.plans.scan import scan
from taintlake.sources import files, packages, sinks


def test_hot_packages(spark, monkeypatch):
    """One package with half the rows: no task gets twice the median, and none is lost."""
    rows = spark.range(60_000).select(F.concat(F.lit("proj"), F.col("id").cast("string")).alias("project"),
                                      F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 4_000).cast("string"))).alias("package"),
                                      F.lit("PyPI").alias("ecosystem"))
    adv = spark.range(4_000).select(F.concat(F.lit("A-"), F.col("id").cast("string")).alias("id"), F.lit("s").alias("summary"),
                                    F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id").cast("string"))).alias("package"), F.lit("PyPI").alias("ecosystem"))
    small = deps.match_advisories(rows, adv).groupBy("vuln_type").count()
    monkeypatch.setattr(deps, "BROADCAST_BYTES", 0)
    hot = deps.hot_packages(rows, 8)
    assert set(hot) == {"hot\x00PyPI"}
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    found = deps.match_advisories(rows, adv)
    sizes = sorted(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect())
    for k, v in old.items():
        spark.conf.set(k, v)
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    assert sorted(found.groupBy("vuln_type").count().collect()) == sorted(small.collect()) and found.count() == 60_000


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_advisories_are_met_in_packs(spark, monkeypatch, broadcast):
    """A dependency is joined with packs of its advisories, not with each; all of them are
    found, repeated ones too, and nulls meet nothing."""
    monkeypatch.setattr(deps, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(deps, "PACKED", 3)
    rows = [(f"proj{i}", f"p{i % 4}", "PyPI" if i % 3 else None) for i in range(40)] + [("proj1", "p1", "PyPI")]
    adv = [(f"A{i % 9}" if i % 5 else None, "s" if i % 4 else None, f"p{i % 3}", "PyPI") for i in range(50)] + [("B", "s", "p1", None)]
    df = spark.createDataFrame(rows, "project string, package string, ecosystem string")
    found = deps.match_advisories(df, spark.createDataFrame(adv, "id string, summary string, package string, ecosystem string"))
    want = sorted((p, a or deps.ADVISORY_DEFAULT_ID, s or deps.ADVISORY_DEFAULT_SUMMARY) for p, n, e in rows for a, s, m, f in adv if n == m and e and e == f)
    assert sorted((r.project, r.vuln_type, r.explanation) for r in found.collect()) == want and len(want) > 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner")


def test_entries_without_a_package(spark, tmp_path):
    entry = lambda n: {"package": {"name": n, "ecosystem": "PyPI"}}
    path = tmp_path / "osv.json"
    path.write_text("\n".join(map(json.dumps, [{"id": "A", "affected": [entry("p"), entry(None), {}]}, {"id": "B", "affected": [entry("q")]}])))
    assert sorted((r.id, r.package) for r in packages.read_advisories(spark, str(path)).collect()) == [("A", "p"), ("B", "q")]
    bad = packages.rejected_advisories(packages.read_advisory_records(spark, str(path))).collect()
    assert sorted((r.id, r.reject_reason) for r in bad) == [("A", "affected entry 2 names no package"), ("A", "affected entry 3 names no package")]


def test_batches_are_written_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    found = scan(spark.createDataFrame([(f"f{i}.py", f"f{i}.py", "requests.get(u, verify=False)\n" * (i + 1)) for i in range(3)],
                                       "path string, file_name string, content string"), only=["config"]).cache()
    assert sinks.read_batches(spark, path).count() == 0
    for batch, again in ((0, False), (1, False), (1, True)):
        part = found.where(F.col("file_path") == f"f{batch}.py")
        assert sinks.write_batch(part, path, batch) is not again
    # An attempt that broke off before its line of the manifest leaves files only.
    from taintlake.operators.report import finished
    finished(found).write.parquet(f"{path}/data/batch_id=2/attempt=broken")
    assert sorted((r.batch_id, r.file_path, r.line) for r in sinks.read_batches(spark, path).collect()) == [(0, "f0.py", 1), (1, "f1.py", 1), (1, "f1.py", 2)]
    assert sinks.write_batch(found.where("file_path = 'f2.py'"), path, 2)
    assert sinks.read_batches(spark, path).where("batch_id = 2").count() == 3
    assert sinks.write_batch(found.limit(0), path, 3) and sinks.read_batches(spark, path).count() == 6


def test_archives_by_ranges(spark, tmp_path):
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(400):
            z.writestr(f"d/f{i}.py", f"eval({i})\n" * 50)
        z.writestr("d/skip.bin", b"x")
        z.writestr("d/sub/", b"")
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "big.ZIP").write_bytes(big.getvalue())
    (folder / "text.zip").write_bytes(b"no archive")
    (folder / "empty.zip").write_bytes(b"")
    (folder / "other.txt").write_bytes(b"x")
    torn = bytearray(big.getvalue())
    at = torn.index(b"d/f7.py") + 12
    torn[at:at + 6] = os.urandom(6)
    (folder / "torn.zip").write_bytes(bytes(torn))
    rows = files.read_archives(spark, str(tmp_path / "in"))
    got = rows.withColumn("task", F.spark_partition_id()).collect()
    good = {r.path.split("deep/")[1]: bytes(r.content) for r in got if r.reject_reason is None}
    assert good == {f"{a}!/d/f{i}.py": f"eval({i})\n".encode() * 50 for a in ("big.ZIP", "torn.zip") for i in range(400) if (a, i) != ("torn.zip", 7)}
    assert {(r.path.split("deep/")[1], r.reject_reason.split(":")[0]) for r in got if r.reject_reason} == {
        ("text.zip", "archive"), ("torn.zip!/d/f7.py", "member")}  # Spark lists no empty files
    assert len({r.task for r in got if "big.ZIP" in r.path}) >= 3  # one archive, several tasks
    nothing = tmp_path / "none"
    nothing.mkdir()
    assert files.read_archives(spark, str(nothing)).collect() == []


def test_nested_reports_as_text(spark, tmp_path):
    """The same documents as the nested rows, one of them with very many findings."""
    from taintlake.operators import report
    from taintlake.schemas import FINDING_COLUMNS

    rows = spark.range(0, 60_000).selectExpr(
        "if(id < 50000, 'big \"x\".py', concat('f', id % 40)) AS file_path", "CAST(id % 7000 AS INT) AS line", "'t' AS vuln_type",
        "element_at(array('Critical', 'High', 'Low'), CAST(id % 3 + 1 AS INT)) AS severity", "CAST(id % 5 AS DOUBLE) AS score", "id AS first_seq")
    rows = rows.select("*", *[F.lit(None if c == "cwe" else f'a"{c}\\').alias(c) for c in FINDING_COLUMNS if c not in rows.columns]).repartition(5)
    path = str(tmp_path / "report")
    report.write_nested(rows, path)
    decode, got = json.JSONDecoder().raw_decode, {}
    for name in os.listdir(path):
        if name.startswith("part-"):
            text, at = (tmp_path / "report" / name).read_text(), 0
            while text[at:].strip():
                doc, at = decode(text, at)
                at += len(text[at:]) - len(text[at:].lstrip()) if len(text) - at < 200 else 1
                got[doc["file_path"]] = doc
    want = {r.file_path: json.loads(r.j) for r in report.nested_report(rows).select("file_path", F.to_json(F.struct("file_path", "findings", "n_findings")).alias("j")).collect()}
    assert got == want and got['big "x".py']["n_findings"] == 50_000


def test_a_stronger_finding_wins_while_held(spark, tmp_path):
    from taintlake.streaming.scan_stream import line_findings_stream

    rules = spark.createDataFrame([("U-1", "Thing", ["alpha"], "Low"), ("U-2", "Thing", ["beta"], "High")],
                                  "rule_id string, name string, sink_patterns array<string>, confidence string")
    form, folder = "path string, file_name string, content string, ts timestamp", str(tmp_path / "in")
    batches = [[("a.py", "alpha\nalpha\n", 0), ("b.py", "beta\n", 0)], [("a.py", "beta\nx\n", 600), ("b.py", "alpha\n", 600)], [("c.py", "alpha\n", 20_000)]]
    for n, batch in enumerate(batches):
        df = spark.createDataFrame([(p, p, t, at) for p, t, at in batch], "path string, file_name string, content string, at long")
        df.select("path", "file_name", "content", F.timestamp_seconds(F.col("at") + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by the time they were written
    stream = spark.readStream.schema(form).option("maxFilesPerTrigger", 1).parquet(folder)
    q = (line_findings_stream(stream, rules=rules, hold=True).writeStream.format("memory").queryName("held")
         .option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r.file_path, r.line, r.rule_id) for r in spark.table("held").collect())
    assert got == [("a.py", 1, "U-2"), ("a.py", 2, "U-1"), ("b.py", 1, "U-2")]  # c.py is still held


@pytest.mark.parametrize("lang", ["py"])
def test_long_files_take_time_in_proportion(spark, lang):
    """Verdicts of a long chain are right, and twice the lines take far less than four times as long."""
    def run(n):
        lines = ["q = input()"]
        for i in range(n):
            lines.append((f"v{i} = q + {i}", f"w{i} = v{i - 1} + str({i})", f"os.system(w{i - 1})", f"v{i} = v{i - 3}", f"w{i} = 'x'", f"os.system(w{i - 1})")[i % 6])
        df = spark.createDataFrame([("a.py", "a.py", "\n".join(lines))], "path string, file_name string, content string")
        start = time.time()
        got = {r.line for r in scan(df, only=["call_taint"]).collect()}
        assert got == {i + 2 for i in range(n) if i % 6 == 2}
        return time.time() - start

    run(300)
    short, long = run(6_000), run(12_000)
    assert long < 2.5 * short


def test_findings_of_dependencies_are_made_before_the_join(spark):
    rows = spark.createDataFrame([("p", "a", "PyPI"), ("q", "b", "npm")], "project string, package string, ecosystem string")
    adv = spark.createDataFrame([(None, None, "a", "PyPI"), ("X", "s", "a", "PyPI")], "id string, summary string, package string, ecosystem string")
    found = deps.match_advisories(rows, adv, salts=2)
    assert sorted((r.project, r.file_path, r.vuln_type, r.lang) for r in found.collect())[1:] == [("p", "dependency:a", "X", "pypi")] and found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("concat(dependency:") and plan.index("Join") < plan.index("lower(")


def test_tasks_grow_with_the_text(spark, monkeypatch, tmp_path):
    """Tokens of a task are bounded: more text is dealt over more tasks, when files are built and when they are parsed."""
    from taintlake.operators import facts
    from workloads import corpus

    units = lambda n: facts.as_units(spark.range(n).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("py").alias("lang"), F.lit("x = 1\n").alias("content")))
    monkeypatch.setattr(facts, "TASK_BYTES", 600)
    assert facts._one_per_file(units(0)).count() == 0
    some = facts._one_per_file(units(1_000).unionByName(units(1_000)))
    assert some.rdd.getNumPartitions() == 20 and some.count() == 1_000
    monkeypatch.setattr(corpus, "FILES_PER_TASK", 100)
    spark.range(3_000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert corpus.code_corpus(spark, str(tmp_path)).rdd.getNumPartitions() == 30


def test_findings_are_compared_without_the_catalogue(spark):
    """Hits are sorted and shuffled narrow; texts of a rule come after deduplication.  Equal
    paths with other texts, and no path, keep the finding they always kept."""
    from taintlake.operators import report
    from taintlake.plans.scan import raw_findings
    from taintlake.rules.catalog import RULES

    files = spark.createDataFrame([("a.py", "a.py", "eval(z)\n"), ("a.py", "a.py", "eval(y)\n"), ("a.py", "a.py", "eval(y)\n"),
                                   (None, "b.py", "requests.get(u, verify=False)\npassword = 'hunter22'\n"), ("c.txt", "c.txt", "SECRET\n")],
                                  "path string, file_name string, content string")
    found = scan(files)
    want = report.dedupe(raw_findings(files, RULES))
    assert found.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.count() >= 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    compared = next(row for row in plan.splitlines() if "Aggregate [" in row)
    assert "rule_ord" in compared and "recommendation" not in compared


def test_files_of_a_stream_are_built_in_tasks_that_grow_with_it(spark, monkeypatch, tmp_path):
    from taintlake.schemas import FINDING
    from workloads import corpus, queries

    monkeypatch.setattr(corpus, "FILES_PER_TASK", 100)
    spark.range(3_000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    seen = []
    monkeypatch.setattr(queries, "scan_batches", lambda files, sink, state: (
        files.writeStream.foreachBatch(lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count())))
        .option("checkpointLocation", state).trigger(availableNow=True).start()))
    monkeypatch.setattr(queries, "read_batches", lambda spark, _: spark.createDataFrame([], FINDING))
    assert queries.stream_scan(spark, str(tmp_path)).count() == 0 and seen == [(30, 3_000)]


def test_lines_of_all_files_are_not_broadcast(spark, tmp_path):
    from workloads import queries

    (spark.range(40).unionByName(spark.range(1)).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1)
     .write.parquet(str(tmp_path / "orders.parquet")))
    found = queries.token_lines(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.where("path LIKE '%/f13.py'").count() == 1 and found.groupBy("path", "line").count().where("count > 1").count() == 3


def test_tokens_run_as_compiled_code_and_stay_narrow(spark):
    """The JVM leaves methods of more than 8,000 bytes uncompiled, and each window and sort
    copies every column of a token."""
    from taintlake.operators import facts

    units = facts.as_units(spark.range(3).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.lit("py").alias("lang"), F.lit("x = f(1)\n").alias("content")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = facts.file_facts(units, all_uses=False)._jdf.queryExecution()
        query.executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(query.executedPlan())
    sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(sizes) > 5 and max(sizes) < 8000
    nodes, widths = [query.optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() in ("Window", "Sort"):
            widths.append(node.output().size())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    assert max(widths) <= 34


def test_flow_of_sliced_and_empty_files():
    """Verdicts as by a plain loop over rows, also for parts of a batch and for nulls."""
    import random

    import pyarrow as pa

    from taintlake.operators.detect import _flow

    kind = pa.list_(pa.struct([("sets", pa.string()), ("defines", pa.bool_()), ("wanted", pa.bool_()), ("source", pa.bool_()),
                               ("reads", pa.list_(pa.string()))]))
    pick = random.Random(3)
    event = lambda: {"sets": pick.choice("abcd"), "defines": pick.random() < .5, "wanted": pick.random() < .6, "source": pick.random() < .15,
                     "reads": [pick.choice("abcd") for _ in range(pick.randrange(4))]}
    files = [None if pick.random() < .1 else [event() for _ in range(pick.randrange(9))] for _ in range(2_000)]

    def plainly(events):
        names, hits = set(), []
        for i, e in enumerate(events or [], 1):
            hit = e["source"] or any(r in names for r in e["reads"])
            hits += [i] * (hit and e["wanted"])
            if e["defines"]:
                names = names | {e["sets"]} if hit else names - {e["sets"]}
        return hits

    want, batch = [plainly(f) for f in files], pa.array(files, kind)
    assert _flow.func(batch).to_pylist() == want and sum(map(len, want)) > 500
    assert _flow.func(batch.slice(70, 500)).to_pylist() == want[70:570]
    assert _flow.func(batch.slice(0, 0)).to_pylist() == [] and _flow.func(pa.array([None, []], kind)).to_pylist() == [[], []]


def test_files_of_the_catalogue_are_built_in_tasks_that_grow_with_them(spark, monkeypatch, tmp_path):
    from workloads import catalogue, corpus

    monkeypatch.setattr(corpus, "FILES_PER_TASK", 100)
    keys = spark.range(3_000).unionByName(spark.range(1)).selectExpr("id AS c_custkey").unionByName(spark.sql("SELECT CAST(null AS BIGINT) AS c_custkey"))
    keys.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    files = catalogue.table(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 31
    plain = catalogue.source_files(spark.read.parquet(str(tmp_path / "customer.parquet")))
    rows = sorted(map(repr, files.collect()))
    assert rows == sorted(map(repr, plain.collect())) and len(rows) == 3_002
