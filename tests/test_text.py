from pyspark.sql import functions as F

from taintlake.functions import text
from taintlake.functions.patterns import required_words
from taintlake.operators.project import fill_finding_defaults, lang_of, to_lines
from taintlake.rules.catalog import RULES, TAINT_SOURCES
from taintlake.schemas import FINDING_COLUMNS
from taintlake.sources.files import split_blank


def test_extension(spark):
    cases = {"a.py": ".py", ".py": "", "..py": "", "a.tar.PY": ".py", "a.": ".", "noext": "", ".a.py": ".py"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r.n: r.e for r in df.select("n", text.extension(F.col("n")).alias("e")).collect()}
    assert got == cases


def test_language(spark):
    df = spark.createDataFrame([("A.TSX",), ("x.hpp",), ("x.htm",), ("x.rb",), ("py",)], "n string")
    assert [r[0] for r in df.select(lang_of(F.col("n"))).collect()] == [
        "javascript", "cpp", "html", "unknown", "unknown"]


def test_decode_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytes.fromhex("61FF62C3A9"),)], "b binary")
    assert df.select(text.decode_lenient(F.col("b"))).first()[0] == "ab\u00e9"


def test_lines(spark):
    cases = ["a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j\u2028k\u2029l\n", "", "\n", "a", "a\n\n", "x\n\ny"]
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cases)], "path string, content string")
    got = {i: [] for i in range(len(cases))}
    for r in to_lines(df).orderBy("path", "line_no").collect():
        got[int(r.path)].append(r.line)
        assert r.line_no == len(got[int(r.path)])
    assert [got[i] for i in range(len(cases))] == [c.splitlines() for c in cases]


def test_strip_and_blank(spark):
    cases = [" a ", "\t\n", "\u00a0x\u3000", "", None, "\x1c y"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.strip(F.col("t"))).collect()] == [
        None if c is None else c.strip() for c in cases]
    ok, rejected = split_blank(df, "t")
    assert ok.count() == 3 and rejected.count() == 3
    assert rejected.first().reject_reason == "t is blank"


def test_defaults(spark):
    df = spark.createDataFrame([("f", 3, "t", "High", 1.0)],
                               "file_path string, line int, vuln_type string, severity string, score double")
    row = fill_finding_defaults(df).first()
    assert list(row.asDict()) == FINDING_COLUMNS
    assert (row.end_line, row.confidence, row.cwe, row.reason) == (3, "Medium", "", "")


def test_every_builtin_pattern_has_a_required_word():
    for r in RULES:
        for p in [*r.sink_patterns, *([r.lhs_name_pattern] if r.lhs_name_pattern else [])]:
            assert required_words(p), p
    for patterns in TAINT_SOURCES.values():
        assert all(required_words(p) for p in patterns)


def test_required_words():
    assert required_words(r"\bquery\(") == {"query("}
    assert required_words(r"(api_key|secret)") == {"api_key", "secret"}
    assert required_words(r"a?b*") is None
    assert required_words(r"(foo)?") is None
    assert required_words(r"(foo|b?)") is None
    assert required_words(r"(?:ABC)+") == {"abc"}
