"""Shapes around assignments and calls that once hid facts."""

import pytest
from pyspark.sql import functions as F

CASES = {
    "def.py": ("def g():\n    pass\napi_key = 'abcdefgh'\nq = input()\nos.system(q)", {(3, "SECRET-1"), (5, "CMDI-1")}),
    "list.py": ("a = []\nb = {}\nq = input()\nos.system(q)\nf()", {(4, "CMDI-1")}),
    "fun.php": ('function f() { return 1; } $q = $_GET["q"]; system($q);', {(1, "CMDI-1")}),
    "fun.js": ("function init() { x(1) }\nconst q = req.query.q\ndocument.write(q)", {(3, "XSS-3")}),
    "none.js": ("foo()\nconst s = 'a'\nlet t = 'b'\nconst q = req.query.q\ndocument.write(s)", set()),
    "empty.js": ("const a = [], b = {}\nfoo();\nconst q = req.query.q;\ndocument.write(q);", {(4, "XSS-3")}),
    "fun.java": ('void f() { }\nString id = request.getParameter("id");\nstmt.executeQuery("select " + id);', {(3, "SQLI-1")}),
    "fun.c": ('int f() { return 0; }\nint main(int argc, char **argv) {\n  char *c = getenv("X");\n  system(c);\n}', {(4, "CMDI-1")}),
    "fun.cpp": ('int f() { return 0; }\nint main() {\n  char *c = getenv("X");\n  system(c);\n}', {(4, "CMDI-1")}),
    "class.c": ('int main() {\n  char *class = getenv("X");\n  system(class);\n}', {(3, "CMDI-1")}),
    "try.c": ('int main() {\n  char *try = getenv("X");\n  system(try);\n}', {(3, "CMDI-1")}),
    "match.py": ("match = input()\nos.system(match)", {(2, "CMDI-1")}),
    "set.js": ("const set = req.query.a; document.write(set)", {(1, "XSS-3")}),
    "get.js": ("const get = req.query.a;\nconst of = get;\ndocument.write(of);", {(3, "XSS-3")}),
    "async.js": ("const async = req.query.a; document.write(async)", {(1, "XSS-3")}),
    "far.php": ("$c = file_get_contents(\n" + " " * 45 + "'php://input');\nsystem($c);", {(3, "CMDI-1")}),
    "regex.js": ("const r =         /[\"']/;\nconst q = req.query.q;\ndocument.write(q);", {(3, "XSS-3")}),
    "deep.js": ("const q = req.query.q;\ndocument.write(`${f({a: {b: q}})}`);", {(2, "XSS-3")}),
    # Code in strings, at any depth and beside text that looks like code.
    "objects.js": ("const q = req.query.q;\ndocument.write(`${a({x:{x:{x:{x:{x:{x:{x:q}}}}}}})}`);", {(2, "XSS-3")}),
    "templates.js": ("const q = req.query.q;\ndocument.write(" + "`it's ${" * 30 + "q" + "} isn't`" * 30 + ");", {(2, "XSS-3")}),
    "siblings.js": ("const q = req.query.q;\nconst a = `${1}${`${2} \"`}`, b = `${a}${`${q}`}`;\ndocument.write(a);\ndocument.write(b);", {(4, "XSS-3")}),
    "clean.js": ("const q = req.query.q;\ndocument.write(`${`${encodeURI(f({a: {b: `${q}`}}))}`}`);", set()),
    "escaped.js": ("const q = req.query.q;\ndocument.write(`\\${q} $ {q} {q}`);\ndocument.write(q);", {(3, "XSS-3")}),
    "calls.js": ("x = `a ${eval(`b`)} c`;\ny = `a ${1\n} c`\nz = eval(y)", {(1, "EVAL-1"), (4, "EVAL-1")}),
    "open.js": ("const q = req.query.q;\ndocument.write(q);\nx = `${ {", {(2, "XSS-3")}),
    "hundred.js": ("const q = req.query.q;\ndocument.write(`${" + "[{x:" * 150 + "q" + "}]" * 150 + "}`);", {(2, "XSS-3")}),
    "fields.py": ("q = input()\nos.system(" + "f'{" * 25 + "q" + "}'" * 25 + ")\nos.system(f'{\"a\"}')", {(2, "CMDI-1")}),
    "quotes.py": ('q = input()\nos.system(f"{d["k"]} {q}")\nos.system(f"{{q}}" + "{q}")\nos.system(rf"\\d{{2}} {1!r:>{3}}")', {(2, "CMDI-1")}),
    "spec.py": ("r = input()\nq = 1\nos.system(f'{q!r}')\nos.system(f'{q:r}')\nos.system(f'{q:{r}}')", {(5, "CMDI-1")}),
    "literal.py": ("api_key = f'abc{x}def'\ntoken = f'abc{x}' + y\npassword = f'''pq{x}\n{y}rs'''", {(1, "SECRET-1"), (3, "SECRET-1")}),
}


@pytest.fixture(scope="module")
def found(findings_of):
    return findings_of({name: text for name, (text, _) in CASES.items()})


@pytest.mark.parametrize("name", CASES)
def test_shape(found, name):
    assert found[name] == CASES[name][1]


def test_many_user_rules(spark):
    from taintlake.rules.catalog import RULES
    from taintlake.rules.custom import merge_rules

    extra = spark.range(600).selectExpr("concat('U-', id) AS rule_id", "concat('user rule ', id) AS name", "array(concat('word', id)) AS sink_patterns")
    assert len(merge_rules(RULES, extra)) == len(RULES) + 600


def test_uses_without_a_source(spark):
    from taintlake.operators import facts, views

    df = spark.createDataFrame([("a.py", "python", "x = 1\ny = x\nprint(x)")], "path string, lang string, content string")
    got = {(r.line, r.var, r.def_line) for r in views.reached_uses(facts.file_facts(facts.as_units(df))).collect()}
    assert got == {(2, "x", 1), (3, "x", 1)}


def test_hostile_nesting_ends(spark):
    """Braces beyond DEEPEST are left in their string; nothing fails and the rest is read."""
    from taintlake.operators import facts, lexer

    deep = "`${" + "{" * 5_000 + "q" + "}" * 5_000 + "}`; done(1)"
    df = spark.createDataFrame([("a.js", "javascript", deep), ("b.py", "python", "f'" + "{" * 9_999 + "'")], "path string, lang string, content string")
    rows = lexer.lex(facts.as_units(df).withColumn("has_src", F.lit(True)), ["path", "content"]).where("pos = 0").collect()
    assert all("".join(r.pieces) == r.unit.content for r in rows)
    assert [r.pieces[-4:] for r in rows if r.unit.path == "a.js"] == [[" done", "(", "1", ")"]]
