"""Small files that between them meet every rule, and shapes that are easy to misread:
calls and functions without arguments, names that are keywords elsewhere, text outside
PHP regions, CRLF, literals after wide blanks.  One file per row of ``customer``.

Expected findings are listed by hand beside each file: (line, rule, snippet), and the
language where it is not that of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taintlake.rules.catalog import RULES
from workloads.corpus import spread_by

INLINE = "html (inline <script>)"
# Shapes of credentials are put together here, so that no scanner takes them for real ones.
_SHAPES = [
    ("SECRETSCAN-AWS_Access_Key", "AK" + "IA" + "A1" * 8), ("SECRETSCAN-GitHub_Token", "gh" + "p_" + "a1" * 18),
    ("SECRETSCAN-Stripe_Key", "sk" + "_live_" + "a1" * 10), ("SECRETSCAN-Slack_Token", "xo" + "xb-" + "1234567890"),
    ("SECRETSCAN-Google_API_Key", "AI" + "za" + "a" * 35),
    ("SECRETSCAN-Private_Key_Block", "-----BEGIN RSA PRIVATE" + " KEY-----"),
    ("SECRETSCAN-JSON_Web_Token", "ey" + "J" + "a" * 10 + ".ey" + "J" + "b" * 10 + "." + "c" * 10),
]
# Code in strings, twenty levels deep.
_TEMPLATES = "`${" * 20 + "q" + "}`" * 20
_OBJECTS = "f({x:" * 20 + "q" + "})" * 20
_FIELDS = "f'{" * 20 + "q" + "}'" * 20
FILES: list[tuple[str, str, str, list[tuple]]] = [
    (".py", "python", "def g():\n    pass\napi_key = 'abcdefgh'\nq = input()\nos.system(q)\n",
     [(3, "SECRET-1", "api_key = 'abcdefgh'"), (5, "CMDI-1", "os.system(q)")]),
    (".php", "php", 'function f() { return 1; } $q = $_GET["q"]; system($q);\nsystem("ls");\n',
     [(1, "CMDI-1", "system($q)")]),
    (".js", "javascript", "foo()\nconst s = 'a'\nlet t = 'b'\nconst q = req.query.q\ndocument.write(s)\ndocument.write(q)\n"
     "const set = req.query.a\ndocument.write(set)\nfunction init() { x(1) }\nel.outerHTML = set\n",
     [(6, "XSS-3", "document.write(q)"), (8, "XSS-3", "document.write(set)"), (10, "XSS-2", "el.outerHTML = set")]),
    (".c", "c", 'char *class = getenv("X");\nsystem(class);\nmemcpy(a, b, n);\nint f() { return 1; }\nmalloc(class);\nmemmove(a, b, n);\n',
     [(2, "CMDI-1", "system(class)"), (3, "MEM-3", "memcpy(a, b, n)"), (5, "INTOVF-1", "malloc(class)")]),
    (".py", "python", "q = request.args.get('q')\nTemplate(q)\nopen(q)\nyaml.load(q)\nyaml.load(q, Loader=SafeLoader)\netree.parse(f)\n"
     "users.find(q)\nUser.create(q)\nrequests.get(q)\nredirect(q)\nconn.search(q)\nresp.add_header('a', q)\nopen('a')\n"
     "open(secure_filename(q))\nopen(shlex.quote(q))\n",
     [(2, "SSTI-1", "Template(q)"), (3, "PATH-1", "open(q)"), (4, "DESERIAL-1", "yaml.load(q)"), (6, "XXE-1", "etree.parse(f)"),
      (7, "NOSQLI-1", "users.find(q)"), (8, "MASSASSIGN-1", "User.create(q)"), (9, "SSRF-1", "requests.get(q)"),
      (10, "REDIR-1", "redirect(q)"), (11, "LDAPI-1", "conn.search(q)"), (12, "HEADERI-1", "resp.add_header('a', q)")]),
    (".js", "javascript", "const q = req.body;\nres.setHeader('a', q);\nfetch(q);\ncors({origin: '*'});\ncors({origin: 'a'});\nnew Function(a);\n"
     "res.cookie('a', 'b');\nres.cookie('a', 'b', {httpOnly: true});\nModel(q);\nusers.findOne(q);\n/x/.test('(a+)+');\n",
     [(2, "HEADERI-1", "res.setHeader('a', q)"), (3, "SSRF-1", "fetch(q)"), (4, "CORS-1", "cors({origin: '*'})"),
      (6, "EVAL-1", "new Function(a)"), (7, "COOKIE-1", "res.cookie('a', 'b')"), (9, "MASSASSIGN-1", "Model(q)"),
      (10, "NOSQLI-1", "users.findOne(q)"), (11, "REDOS-1", "/x/.test('(a+)+')")]),
    (".java", "java", 'String q = request.getHeader("q");\nctx.bind(q);\nr.sendRedirect(q);\nnew SecretKeySpec("k", 1);\nnew SecretKeySpec(k, 1);\n'
     'e.printStackTrace();\nCipher.getInstance("AES/ECB/X");\nin.readObject();\nout.println(q);\nout.println(escapeHtml(q));\n'
     'MessageDigest.getInstance("SHA-256");\nMessageDigest.getInstance("SHA-1");\n',
     [(2, "LDAPI-1", "ctx.bind(q)"), (3, "REDIR-1", "r.sendRedirect(q)"), (4, "CRYPTO-3", 'new SecretKeySpec("k", 1)'),
      (6, "DEBUG-1", "e.printStackTrace()"), (7, "CRYPTO-2", 'Cipher.getInstance("AES/ECB/X")'), (9, "XSS-1", "out.println(q)"),
      (12, "CRYPTO-1B", 'MessageDigest.getInstance("SHA-1")')]),
    (".php", "php", "<b>eval(1)</b>\r\n<?php\r\n$q = $_GET['a'];\r\ninclude $q;\r\nunserialize($q);\r\n?>\r\n<i>\r\n<?php eval($a); ?>\r\n",
     [(4, "LFI-1", "include $q"), (5, "DESERIAL-1", "unserialize($q)"), (8, "EVAL-1", "eval($a)")]),
    (".php", "php", "$q = $_COOKIE['a'];\n$a = intval($q);\n$b = htmlentities($q);\nprint $a;\nprint $b;\nprint $q;\nphpinfo();\nmd5($q);\nsha256($q);\n"
     "$db_pass = 'abcd';\n$db_password = 'todo';\n",
     [(6, "XSS-1", "print $q"), (7, "DEBUG-1", "phpinfo()"), (8, "CRYPTO-1", "md5($q)"), (10, "SECRET-2", "$db_pass = 'abcd'")]),
    (".cpp", "cpp", 'fprintf(f, x);\nfprintf(f, "%s", x);\ngets(buf);\nsprintf(buf, "%s", x);\nalloca(n);\nstd::cin >> z;\n',
     [(1, "MEM-2", "fprintf(f, x)"), (3, "MEM-1", "gets(buf)"), (4, "MEM-1", 'sprintf(buf, "%s", x)'), (5, "MEM-3", "alloca(n)")]),
    (".txt", "unknown", "v = input()\nexecuteQuery v\nsystem(v)\necho v\n../ v\nrequire v\na.innerHTML\ngets x\nSECRET\nsha1(\neval (x\n  debug\necho w\n",
     [(2, "FALLBACK-SQL_Injection", "executeQuery v"), (3, "FALLBACK-Command_Injection", "system(v)"),
      (4, "FALLBACK-Reflected_XSS", "echo v"), (5, "FALLBACK-Path_Traversal", "../ v"), (6, "FALLBACK-File_Inclusion", "require v"),
      (7, "FALLBACK-DOM-based_XSS", "a.innerHTML"), (8, "FALLBACK-Buffer_Overflow", "gets x"), (9, "FALLBACK-Hardcoded_Secret", "SECRET"),
      (10, "FALLBACK-Insecure_Hash_Algorithm", "sha1("), (11, "FALLBACK-Use_of_eval()", "eval (x"),
      (12, "FALLBACK-Information_Disclosure", "debug")]),
    (".ini", "unknown", "rejectUnauthorized : false\ndebug = true\nallow_origins=['*']\nalgorithms=['none']\nallow_origins=['a']\n",
     [(1, "CONFIGSCAN-Disabled_TLS/Certificate_Verification", "rejectUnauthorized : false"),
      (2, "CONFIGSCAN-Debug_Mode_Enabled", "debug = true"), (2, "FALLBACK-Information_Disclosure", "debug = true"),
      (3, "CONFIGSCAN-Overly_Permissive_CORS_Policy_(raw_config)", "allow_origins=['*']"),
      (4, "CONFIGSCAN-JWT_'none'_Algorithm_Accepted", "algorithms=['none']")]),
    (".java", "java", "".join(f"// {shape}\n" for _, shape in _SHAPES),
     [(i + 1, rule, f"// {shape}") for i, (rule, shape) in enumerate(_SHAPES)]),
    (".py", "python", "match = input()\nos.system(match)\ndef h(): return []\nx = h()\ny = []\nos.popen(y)\nz = h()\nz = match\nos.popen(z)\n"
     "jwt.decode(t, verify=False)\napp.run(debug = True)\ndb.query(match)\n",
     [(2, "CMDI-1", "os.system(match)"), (9, "CMDI-1", "os.popen(z)"), (10, "JWT-1", "jwt.decode(t, verify=False)"),
      (10, "CONFIGSCAN-Disabled_TLS/Certificate_Verification", "jwt.decode(t, verify=False)"),
      (11, "DEBUG-2", "app.run(debug = True)"), (12, "SQLI-1", "db.query(match)")]),
    (".php", "php", "$d = file_get_contents(\n" + " " * 45 + "'php://input');\nsystem($d);\n$e = file_get_contents('a');\nsystem($e);\n",
     [(3, "CMDI-1", "system($d)")]),
    (".html", "html", '<p>\n<script>eval(1)</script>\n<script>\nconst u = location.hash;\na.href = u;\n</script>\n<a href="JavaScript:x()">\n',
     [(2, "EVAL-1", "eval(1)", INLINE), (5, "REDIR-2", "a.href = u", INLINE), (7, "XSS-4", 'href="JavaScript:x()"')]),
    (".js", "javascript", "const r =     /\"/;\nconst q = req.query.q;\ndocument.write(q);\ndocument.write(`${f({a: {b: q}})}`);\ndocument.write(`${encodeURI(q)}`);\n"
     "const otp = Math.random();\nconst dice = Math.random();\nObject.assign({}, q);\n",
     [(3, "XSS-3", "document.write(q)"), (4, "XSS-3", "document.write(`${f({a: {b: q}})}`)"), (6, "RAND-1", "otp = Math.random()"),
      (8, "PROTOPOLLUTE-1", "Object.assign({}, q)")]),
    (".js", "javascript", f"const q = req.query.q;\ndocument.write({_TEMPLATES});\ndocument.write(`${{{_OBJECTS}}} it's`);\ndocument.write(`${{`${{encodeURI(q)}}`}}`);\n"
     "x = `${eval(1)} isn't`;\nconst password = `pw ${1} it`\nlet p = `${q}`;\nlet s = `q`;\ndocument.write(s);\ndocument.write(p);\n",
     [(2, "XSS-3", f"document.write({_TEMPLATES})"), (3, "XSS-3", f"document.write(`${{{_OBJECTS}}} it's`)"), (5, "EVAL-1", "eval(1)"),
      (6, "SECRET-1", "password = `pw ${1} it`"), (10, "XSS-3", "document.write(p)")]),
    (".py", "python", f"q = input()\nos.system({_FIELDS})\nos.system(f'{{escape(q)}} {{q!r:>3}}')\nos.system(f'{{{{q}}}} {{1:{{2}}}}')\nos.system(f\"{{d['a']}}{{w:{{q}}}}\")\n",
     [(2, "CMDI-1", f"os.system({_FIELDS})"), (3, "CMDI-1", "os.system(f'{escape(q)} {q!r:>3}')"), (5, "CMDI-1", "os.system(f\"{d['a']}{w:{q}}\")")]),
]


def source_files(customers: DataFrame) -> DataFrame:
    """``src_files`` built on customer keys."""
    tid = (F.col("c_custkey") % len(FILES)).cast("int") + 1
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.element_at(F.array(*[F.lit(f[0]) for f in FILES]), tid))
    return customers.select(F.concat(F.lit("app/"), name).alias("path"), name.alias("file_name"),
                            F.element_at(F.array(*[F.lit(f[2]) for f in FILES]), tid).alias("content"))


def expected() -> list[tuple]:
    """The sixteen columns of a finding, after the number and extension of its file.  What
    a rule says of itself is read from the catalogue; where it holds is not."""
    said = {r.rule_id: r for r in RULES}
    out = []
    for tid, (ext, lang, _, hits) in enumerate(FILES):
        for line, rule, snippet, *other in hits:
            r = said[rule]
            out.append((tid, ext, line, r.name, r.severity, r.score, r.cwe, r.confidence, r.category, r.explanation, r.recommendation,
                        other[0] if other else lang, snippet, rule))
    return out


def table(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return source_files(spread_by(customers, customers.count(), "c_custkey"))
