"""A hit and a miss for every rule, and the evaluation order of taint."""

import pytest

from taintlake.operators import report
from taintlake.plans.scan import scan

PYT, JST, PHT, JAT, CT = "q = request.args.get('q')\n", "const q = req.query.q;\n", "$q = $_GET['q'];\n", \
    'String q = request.getParameter("q");\n', "char *q = getenv(\"Q\");\n"
# rule -> (extension, text with a hit on the last line, text without one)
STRUCT = {
    "SQLI-1": (".py", PYT + "db.query(q)", PYT + "db.query('a')"),
    "CMDI-1": (".php", PHT + "shell_exec($q);", PHT + "shell_exec('ls');"),
    "SSTI-1": (".py", PYT + "Template(q)", "Template(q)"),
    "NOSQLI-1": (".js", JST + "users.find(q);", "users.find(q);"),
    "LDAPI-1": (".java", JAT + "ctx.bind(q);", JAT + 'ctx.bind("a");'),
    "HEADERI-1": (".js", JST + "res.setHeader('a', q);", JST + "res.setHeader('a', 'b');"),
    "XSS-1": (".php", PHT + "print $q;", PHT + "print 'a';"),
    "XSS-2": (".js", JST + "el.outerHTML = q;", JST + "el.outerHTML = 'a';"),
    "XSS-3": (".js", JST + "document.writeln(q);", JST + "document.writeln('a');"),
    "XSS-4": (".html", '<a href="JavaScript:x()">', '<a href="x">javascript:</a>'),
    "MEM-1": (".c", "strcat(a, b);", "strlcat(a, b); int strcat(char *a);"),
    "MEM-2": (".cpp", "fprintf(f, x);", 'fprintf(f, "%s", x);'),
    "MEM-3": (".c", "memcpy(a, b, n);", "memmove(a, b, n);"),
    "INTOVF-1": (".c", CT + "malloc(q);", "malloc(q);"),
    "PATH-1": (".py", PYT + "open(q)", PYT + "open('a')"),
    "LFI-1": (".php", PHT + "include $q;", PHT + "include 'a.php';"),
    "DESERIAL-1": (".py", PYT + "yaml.load(q)", PYT + "yaml.load(q, Loader=SafeLoader)"),
    "XXE-1": (".py", "etree.parse(f)", "etree.dump(f)"),
    "SSRF-1": (".js", JST + "fetch(q);", JST + "fetch('a');"),
    "REDIR-1": (".java", JAT + "r.sendRedirect(q);", JAT + 'r.sendRedirect("a");'),
    "REDIR-2": (".js", JST + "location.href = q;", JST + "location.hrefs = q;"),
    "EVAL-1": (".js", "new Function(a);", "evaluate(a);"),
    "PROTOPOLLUTE-1": (".js", JST + "Object.assign({}, q);", "Object.assign({}, q);"),
    "REDOS-1": (".js", "/x/.test('(a+)+');", "/x/.test('(a+)');"),
    "CRYPTO-1": (".php", "md5($a);", "sha256($a);"),
    "CRYPTO-1B": (".java", 'MessageDigest.getInstance("SHA-1");', 'MessageDigest.getInstance("SHA-256");'),
    "CRYPTO-2": (".java", 'Cipher.getInstance("AES/ECB/X");', 'Cipher.getInstance("DESede/CBC/X");'),
    "CRYPTO-3": (".java", 'new SecretKeySpec("k", 1);', "new SecretKeySpec(k, 1);"),
    "RAND-1": (".py", "otp = random.randint(1, 2)", "dice = random.randint(1, 2)"),
    "SECRET-1": (".java", 'String apiKey = "abcd";', 'String apiKey = "abc";'),
    "SECRET-2": (".php", "$db_pass = 'abcd';", "$db_pass = 'todo';"),
    "CORS-1": (".js", "cors({origin: '*'});", "cors({origin: 'a'});"),
    "COOKIE-1": (".js", "res.cookie('a', 'b');", "res.cookie('a', 'b', {httpOnly: true});"),
    "JWT-1": (".py", "jwt.decode(t, verify=False)", "jwt.decode(t, verify=True)"),
    "MASSASSIGN-1": (".py", PYT + "User.create(q)", "User.create(q)"),
    "DEBUG-1": (".java", "e.printStackTrace();", "e.getMessage();"),
    "DEBUG-2": (".py", "app.run(debug = True)", "app.run(debug=False)"),
}
SEED = "v = input()\n"
LINES = {
    "FALLBACK-SQL_Injection": (".txt", SEED + "executeQuery v", SEED + "executeQuery w"),
    "FALLBACK-Command_Injection": (".rb", SEED + "system(v)", SEED + "ecosystem(v)"),
    "FALLBACK-Reflected_XSS": (".txt", SEED + "echo v", SEED + " echo v"),
    "FALLBACK-DOM-based_XSS": (".txt", "a.innerHTML", "a.inner"),
    "FALLBACK-Buffer_Overflow": (".txt", "gets x", "fgets x"),
    "FALLBACK-Path_Traversal": (".txt", SEED + "../ v", SEED + "../ V"),
    "FALLBACK-File_Inclusion": (".txt", SEED + "require v", "require v"),
    "FALLBACK-Hardcoded_Secret": (".txt", "SECRET", "sec ret"),
    "FALLBACK-Insecure_Hash_Algorithm": (".txt", "sha1(", "sha1 ("),
    "FALLBACK-Use_of_eval()": (".txt", "eval (x", "evil(x"),
    "FALLBACK-Information_Disclosure": (".txt", "debug", "bug"),
    "CONFIGSCAN-Disabled_TLS/Certificate_Verification": (".yml", "rejectUnauthorized : false", "rejectUnauthorized"),
    "CONFIGSCAN-Debug_Mode_Enabled": (".ini", "  debug = true", "x debug = true"),
    "CONFIGSCAN-Overly_Permissive_CORS_Policy_(raw_config)": (".yml", "allow_origins=['*']", "allow_origins=['a']"),
    "CONFIGSCAN-JWT_'none'_Algorithm_Accepted": (".yml", "algorithms=['none']", "algorithms=['RS256']"),
    "SECRETSCAN-AWS_Access_Key": (".yml", "AK" + "IA" + "A1" * 8, "ak" + "ia" + "A1" * 8),
    "SECRETSCAN-GitHub_Token": (".yml", "gh" + "p_" + "a1" * 18, "gh" + "p_" + "a1" * 5),
    "SECRETSCAN-Stripe_Key": (".yml", "sk" + "_live_" + "a1" * 10, "sk" + "_live_"),
    "SECRETSCAN-Slack_Token": (".yml", "xo" + "xb-" + "1234567890", "xo" + "xb-1"),
    "SECRETSCAN-Google_API_Key": (".yml", "AI" + "za" + "a" * 35, "AI" + "za" + "a" * 34),
    "SECRETSCAN-Private_Key_Block": (".yml", "-----BEGIN RSA PRIVATE" + " KEY-----", "-----BEGIN CERTIFICATE-----"),
    "SECRETSCAN-JSON_Web_Token": (".yml", "ey" + "J" + "a" * 10 + ".ey" + "J" + "b" * 10 + "." + "c" * 10, "eyJ.eyJ.c"),
}
CASES = {**STRUCT, **LINES}


@pytest.fixture(scope="module")
def found(findings_of):
    files = {}
    for rule, (ext, hit, miss) in CASES.items():
        safe = "".join(c if c.isalnum() else "_" for c in rule)
        files[f"hit/{safe}{ext}"], files[f"miss/{safe}{ext}"] = hit + "\n", miss + "\n"
    return findings_of(files)


@pytest.mark.parametrize("rule", CASES)
def test_rule(found, rule):
    ext, hit, _ = CASES[rule]
    safe = "".join(c if c.isalnum() else "_" for c in rule)
    assert (hit.count("\n") + 1, rule) in found[f"hit/{safe}{ext}"]
    assert rule not in {r for _, r in found[f"miss/{safe}{ext}"]}


SEMANTICS = {
    # An assignment counts before the calls inside its right side.
    "order.py": (PYT + "q = os.system(q)\n", {(2, "CMDI-1")}),
    "clear.py": (PYT + "q = 1\nos.system(q)\n", set()),
    "augmented.py": (PYT + "s = 'a'\ns += q\ns += 'b'\nos.system(s)\n", {(5, "CMDI-1")}),
    "receiver.py": (PYT + "os.system('{}'.format(q))\nos.system(q.strip())\n", {(2, "CMDI-1")}),
    "source_receiver.py": ("os.system(request.args.get('a').strip())\n", {(1, "CMDI-1")}),
    "sanitized_inside.py": ("os.system(shlex.quote(request.args['a']))\nos.system('a' + escape(input()))\n", set()),
    "in_sanitizer.py": ("escape(os.system(input()))\n", {(1, "CMDI-1")}),
    "input_name.py": ("x = input.strip()\nos.system(x)\ny = input\nos.system(y)\n", {(4, "CMDI-1")}),
    "fstring.py": (PYT + "os.system(f'a {q}')\nos.system(f'{escape(q)}')\nos.system('{q}')\n", {(2, "CMDI-1")}),
    "comment.py": ("# os.system(input())\nx = '''\neval(1)\n'''\n", set()),
    "multiline.py": ("os.system(\n  'a',\n  input()\n)\n", {(1, "CMDI-1")}),
    "template.js": (JST + "eval(`a`);\ndocument.write(`<b>${q}</b>`);\ndocument.write(`${encodeURIComponent(q)}`);\n",
                    {(2, "EVAL-1"), (3, "XSS-3")}),
    "nosemi.js": ("const q = req.query.q\nel.innerHTML = q\nel.innerHTML = 'a'\n", {(2, "XSS-2")}),
    "callback.js": ("app.get('/', function (req, res) {\n  var q = req.query.q\n  db.query('a' + q)\n})\n",
                    {(3, "SQLI-1")}),
    "key.js": (JST + "document.write({q: 1});\n", set()),
    "string.php": (PHT + "system(\"ls $q\");\nsystem('ls $q');\nsystem(\"ls \\$q\");\n", {(2, "CMDI-1")}),
    "tags.php": ("<b>eval(1)</b>\n<?= $_GET['a'] ?>\n<i>\n<?php eval($a); ?>\n", {(2, "XSS-1"), (4, "EVAL-1")}),
    "receiver.java": ('Runtime.getRuntime().exec(request.getParameter("a"));\n', {(1, "CMDI-1")}),
    "pointer.c": ("char *p = getenv(\"A\");\nsystem(p);\n", {(2, "CMDI-1")}),
    "page.html": ("<p>\n<script>eval(1)</script>\n<script>\n\neval(2)</script>\n", {(2, "EVAL-1"), (5, "EVAL-1")}),
    "empty.py": ("", set()),
    "open.py": ("os.system(input(\n", {(1, "CMDI-1")}),
}


def test_semantics(findings_of):
    got = findings_of({n: t for n, (t, _) in SEMANTICS.items()})
    assert got == {n: want for n, (_, want) in SEMANTICS.items()}


def test_partitions_and_order_do_not_matter(spark):
    rows = [(n, n, t) for n, (t, _) in SEMANTICS.items()]
    schema = "path string, file_name string, content string"
    kinds = ["call_taint"]
    a = scan(spark.createDataFrame(rows, schema).repartition(1), only=kinds).collect()
    b = scan(spark.createDataFrame(rows[::-1] + rows, schema).repartition(7), only=kinds).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))


def test_custom_struct_rule(spark, findings_of):
    rules = spark.createDataFrame(
        [("MY-1", "struct", "call_taint", "Mine", ["launch\\("], ["python"], True)],
        "rule_id string, engine string, kind string, name string, sink_patterns array<string>,"
        " languages array<string>, requires_taint boolean")
    got = findings_of({"a.py": PYT + "launch(q)\nlaunch(1)\n"}, rules=rules, only=["call_taint"])
    assert got == {"a.py": {(2, "MY-1")}}


@pytest.mark.parametrize("row", [("SQLI-1", "line", "x", "High"), ("A", "other", "x", "High"),
                                 ("A", "line", "(", "High"), ("A", "line", "x", "Huge")])
def test_bad_rules_are_refused(spark, row):
    from taintlake.rules.catalog import RULES
    from taintlake.rules.custom import merge_rules
    df = spark.createDataFrame([(row[0], row[1], "n", [row[2]], row[3])],
                               "rule_id string, kind string, name string, sink_patterns array<string>, severity string")
    with pytest.raises(ValueError):
        merge_rules(RULES, df)


def test_dedupe_and_rank(spark):
    rows = [("f", 1, "A", "Low", "High", 5.0, 0), ("f", 1, "A", "High", "High", 5.0, 1),
            ("f", 2, "A", "Medium", "Low", 5.0, 2), ("f", 2, "A", "Medium", "Critical", 1.0, 3),
            ("a", 9, "B", "?", "Odd", 9.0, 4)]
    df = spark.createDataFrame(rows, "file_path string, line int, vuln_type string, confidence string,"
                                     " severity string, score double, seq long")
    once = report.dedupe(df)
    assert {(r.line, r.confidence, r.seq, r.first_seq) for r in once.collect()} == {
        (1, "High", 1, 0), (2, "Medium", 2, 2), (9, "?", 4, 4)}
    twice = report.dedupe(once.drop("first_seq"))
    assert {r.seq for r in twice.collect()} == {1, 2, 4}
    ranked = report.with_rank(once).orderBy("rank").collect()
    assert [(r["rank"], r.line) for r in ranked] == [(1, 1), (2, 2), (3, 9)]
    assert [r.line for r in report.rank(once).collect()] == [1, 2, 9]


def test_code_deep_inside_strings(findings_of):
    """Braces inside the braces of an f-string, doubled braces, calls inside sanitizers."""
    found = findings_of({
        "deep.py": PYT + "os.system(f'{q:{w}}')\nos.system(f\"{q + str({'a': 1})}\")\nos.system(f'{{{q}}}')\nos.system(f'{{q}}')\n"
                   "os.system(f'{escape(f(g(h(q))))}')\n",
        "deep.js": JST + "document.write(`${encodeURIComponent(f(g(q)))}`);\ndocument.write(`${f(g(q))}`);\n"})
    assert {line for line, rule in found["deep.py"] if rule == "CMDI-1"} == {2, 3, 4}
    assert {line for line, rule in found["deep.js"] if rule == "XSS-3"} == {3}
