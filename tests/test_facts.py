import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from taintlake.operators import facts, lexer, taint, views
from taintlake.operators.html import html_attrs, html_scripts

TEXTS = [
    ("python", 'x = f"a{q}" # hi\ny = """a\nb""".format(x)\nz += 1\\\n + 2'),
    ("javascript", 'const t = `a ${f(`x`)} b`; r = /[(]a"/g.test(x) / 2; a?.b(...c) /* q\n */ => new Foo.Bar(1)'),
    ("php", '<html><?php $a .= $_GET["n"]; echo $this->db->query("x $a"); $x = <<<EOT\nhi\n  EOT;\n?> tail'),
    ("java", 'List<String> a = new ArrayList<Map<String,X>>(b); String s = "x\\"y"; foo::bar; // c'),
    ("c", "#include <x.h>\n#define X(a) \\\n strcpy(a)\nint main(int c, char **v) {\n p->q = L\"x\";}"),
    ("javascript", "a = `x${`y${ {z: `${1} '` } }` }$ ` + `\\${b}`; c = `${d}${e}`"),
    ("python", "a = f'{b!r:>{w}} {{c}}' + rf\"{d[\"e\"] :%Y}\" + f'{f'{g}'}'\nh = f\"\"\"i {j}\n{ k }\"\"\""),
    ("cpp", 'auto x = R"d(a)" )d"; std::cin >> y; a <<= 2;'),
]


def units(spark, rows):
    df = spark.createDataFrame([(f"p{i}", lang, text) for i, (lang, text) in enumerate(rows)],
                               "path string, lang string, content string")
    return facts.as_units(df)


def test_pieces_join_back_to_the_text(spark):
    df = units(spark, TEXTS).withColumn("has_src", F.lit(True))
    rows = lexer.lex(df, ["content"]).where("pos = 0").collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert "".join(r.pieces) == r.unit.content


def test_long_tokens_do_not_overflow_the_matcher(spark):
    n = 300_000
    rows = [("javascript", 'x = "' + "a" * n + '"; y=`' + "b" * n + "`; /*" + "c*" * n + "*/ " + "foo." * 50_000 + "x"),
            ("python", '"""' + "q" * n + '"""\n#' + "c" * n), ("php", '$a="' + 'q\\"' * n + '";')]
    assert facts.located_tokens(units(spark, rows)).count() > 10


def test_brackets(spark):
    rows = views.brackets(units(spark, [("python", "x = f(g(a), h(b))")])).orderBy("open_pos").collect()
    # Positions count from 1.
    assert [(r.open_pos - 1, r.close_pos - 1) for r in rows] == [(3, 13), (5, 7), (10, 12)]


def test_equal_copies_count_once(spark):
    df = units(spark, [("python", "a = f(1)")])
    got = views.calls(facts.file_facts(df.unionByName(df).unionByName(df))).collect()
    assert [(r.callee, r.args) for r in got] == [("f(", "(1)")]


def calls_of(spark, lang, text):
    rows = views.calls(facts.file_facts(units(spark, [(lang, text)]))).orderBy("start_pos", F.desc("open_pos"))
    return [(r.line, r.callee) for r in rows.collect()]


def test_calls_and_definitions(spark):
    assert calls_of(spark, "python", "def f(x):\n    return g(x)\nclass A(B):\n    pass\na.b(1).c(2)\n") == [
        (2, "g("), (5, "a.b(1).c("), (5, "a.b(")]
    assert calls_of(spark, "javascript", "function f(a) { g(a) }\nclass A { m(x) { if (x) h(x) } }\nnew Foo(1)\n") == [
        (1, "g("), (2, "h("), (3, "new Foo(")]
    assert calls_of(spark, "c", "char *dup(char *s) {\n  return strdup(s);\n}\nint g(int);\n") == [(2, "strdup(")]
    assert calls_of(spark, "java", "void run(String s) throws X { new T(s) { }; a.b(s); }") == [
        (1, "new T("), (1, "a.b(")]


def defs_of(spark, lang, text):
    rows = views.defs(facts.file_facts(units(spark, [(lang, text)]))).orderBy("def_pos").collect()
    return [(r.lhs_text if not r.is_simple else r.var, r.rhs_text, r.is_simple) for r in rows]


def test_assignments(spark):
    assert defs_of(spark, "python", "x: int = f(a=1)\na, b = 1, 2\nif c == 1: d = 2\n") == [
        ("x", "f(a=1)", True), ("b", "1, 2", False), ("d", "2", True)]
    assert defs_of(spark, "javascript", "let a = 1, b = c\nvar d = e +\n f\no.p = q\nfunction g(h = 2) {}\n") == [
        ("a", "1", True), ("b", "c", True), ("d", "e +\n f", True), ("o.p", "q", False)]
    assert defs_of(spark, "c", 'char *p = getenv("A"); char b[8] = x; *p = y; b[0] = z; while ((n = r()) > 0) {}') == [
        ("p", 'getenv("A")', True), ("b", "x", True), ("p", "y", False), ("b[0]", "z", False), ("n", "r()", True)]
    assert defs_of(spark, "php", "$a['k'] = 1; $b .= $c; function f($d = 'x') {}") == [
        ("$a['k']", "1", False), ("b", "$c", True)]


def test_reaching_definitions(spark):
    d = spark.createDataFrame([("f", v, p) for v, p in [("x", 1), ("y", 2), ("x", 3), ("z", 4), ("x", 5)]],
                              "file_id string, var string, def_pos int")
    u = spark.createDataFrame([("f", v, p) for v, p in [("x", 2), ("x", 4), ("y", 5), ("z", 4), ("x", 1)]],
                              "file_id string, var string, eval_pos int")
    got = {(r.var, r.eval_pos, r.def_pos) for r in taint.reaching_defs(d, u).collect()}
    assert got == {("x", 2, 1), ("x", 4, 3), ("y", 5, 2)}


def test_html(spark):
    page = ('<p a=1 b="x>y"\n c>\n<!-- <script>no()</script> <i d="1"> -->\n<script src="s">\nf("</p>")\n</script>'
            "<style q='1'>e {}</style><br z>\n<script>g()</script>")
    df = spark.createDataFrame([("p", "html", page)], "path string, lang string, content string")
    scripts = html_scripts(df).orderBy("unit_no").collect()
    assert [(r.line_offset, r.content) for r in scripts] == [(3, '\nf("</p>")\n'), (6, "g()")]
    attrs = html_attrs(df).orderBy("pos").collect()
    assert [(r.line, r.attr, r.value) for r in attrs] == [
        (1, "a", "1"), (1, "b", "x>y"), (2, "c", ""), (4, "src", "s"), (6, "q", "1"), (6, "z", "")]


def brute_closure(seeds, edges):
    depth, queue = {s: 0 for s in seeds}, sorted(seeds)
    for node in queue:
        for src, dst in edges:
            if src == node and dst not in depth:
                depth[dst] = depth[node] + 1
                queue.append(dst)
    return depth


def test_closure_equals_brute_force(spark):
    rng = random.Random(7)
    seeds, edges, want = [], [], {}
    for g in range(12):
        names = [f"n{i}" for i in range(rng.randint(1, 25))]
        s = set(rng.sample(names, rng.randint(0, min(2, len(names)))))
        e = {(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 40))}
        seeds += [(f"g{g}", v) for v in s]
        edges += [(f"g{g}", a, b) for a, b in e]
        want.update({(f"g{g}", v): d for v, d in brute_closure(s, e).items()})
    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    seeds.append(("chain", "c0"))
    edges += [("chain", a, b) for a, b in chain]
    want.update({("chain", f"c{i}"): i for i in range(21)})
    got = taint.taint_closure(spark.createDataFrame(seeds, "path string, var string"),
                              spark.createDataFrame(edges, "path string, src string, dst string"))
    assert {(r.path, r.var): r.depth for r in got.collect()} == want


def test_closure_moves_edges_once(spark):
    """After they are placed, edges and known names are read where they lie."""
    from taintlake.plans.storage import Workspace

    work = Workspace(spark, "test")
    edges = work.save(spark.range(500).selectExpr("cast(id % 7 AS string) AS path", "cast(id AS string) AS src", "cast(id + 1 AS string) AS dst"), ("path", "src"))
    names = spark.range(40).selectExpr("cast(id % 7 AS string) AS path", "cast(id AS string) AS var", "0 AS depth")
    known = [work.save(names, ("path", "var")) for _ in range(3)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with names beyond that size
    step = taint._next_names(spark.table(known[-1]), spark.table(edges), [spark.table(k) for k in known], 1)
    plan = step._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The newest names lie where their edges do, too: only what they reach is moved.
    assert plan.count("Exchange") == 1 and plan.count("Bucketed: true") == 5
    before = set(spark.catalog.listDatabases("taintlake_closure*"))
    chain = spark.range(30).selectExpr("'p' AS path", "cast(id AS string) AS src", "cast(id + 1 AS string) AS dst")
    got = taint.taint_closure(spark.createDataFrame([("p", "0")], "path string, var string"), chain)
    assert {(int(r.var), r.depth) for r in got.collect()} == {(i, i) for i in range(31)}
    assert set(spark.catalog.listDatabases("taintlake_closure*")) == before
    work.close()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=12),
                min_size=1, max_size=20))
def test_row_local_closure_equals_relational(spark, graphs):
    files = [(f"f{i}", "h = input()\n" + "".join(f"{d} = {s} + 1\n" for d, s in g)) for i, g in enumerate(graphs)]
    df = spark.createDataFrame(files, "path string, content string")
    from taintlake.operators.project import to_lines
    lines = to_lines(df).select("path", "line")
    local = {(r.path, v) for r in df.select("path", taint.tainted_names(F.split("content", "\n")).alias("v")).collect()
             for v in r.v}
    want = {(f"f{i}", v) for i, g in enumerate(graphs)
            for v in brute_closure({"h"}, [(s, d) for d, s in g])}
    assert local == want
    seeds = {(r.path, r.var) for r in taint.taint_seeds(lines).collect()}
    assert seeds == {(p, "h") for p, _ in files}


def test_text_is_cut_behind_the_explode(spark):
    """Calls leave a file as numbers and their text is cut out by compiled code, one call at a
    time; statements that act like calls keep their names."""
    php = "<?php include_once $q; ECHO f($q), 'a'; print $q; ?>x<?= g($q) ?>"
    got = calls_of_rows(spark, [("php", php), ("python", "os.run(a, b(c)[d](e)\n"), ("python", "x = 1")])
    assert got == [("p0", "echo", "f($q), 'a'"), ("p0", "echo", "g($q)"), ("p0", "f(", "($q)"), ("p0", "g(", "($q)"), ("p0", "include_once(", "$q"),
                   ("p0", "print", "$q"), ("p1", "b(", "(c)"), ("p1", "b(c)[d](", "(e)"), ("p1", "os.run(", "(a, b(c)[d](e)\n")]
    plan = views.calls(facts.file_facts(units(spark, [("php", php)])))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode" in line and "array_join" in line]


def calls_of_rows(spark, rows):
    return sorted((r.path, r.callee, r.args) for r in views.calls(facts.file_facts(units(spark, rows))).collect())


def test_flow_needs_no_calls(spark):
    """Only assignments to plain variables are events of the flow; none of their text is cut."""
    rows = [("python", "a = input()\nb = f(a)\nc.d = a\nsink(b)\na = 1\ne = a\nb += 2\nb = g(1)\nh: str = input()\ni = escape(h)\nj = k = h\n"),
            ("php", "<?php $x = $_GET['q']; echo $x; $y = $x . 'a'; $x = 1; $z = $x; ?>"), ("python", "m = n\n")]
    found = views.tainted_defs(facts.file_facts(units(spark, rows)))
    got = sorted((r.path, r.line, r["var"]) for r in found.collect())
    assert got == [("p0", 1, "a"), ("p0", 2, "b"), ("p0", 7, "b"), ("p0", 9, "h"), ("p0", 11, "j"), ("p0", 11, "k"), ("p1", 1, "x"), ("p1", 1, "y")]
    assert "array_join" not in found._jdf.queryExecution().optimizedPlan().toString()
