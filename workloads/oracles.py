"""SQL that says independently what each query must return.

Findings are listed by hand per template and joined with ``orders``; they do not
repeat the way the findings are computed.
"""

from __future__ import annotations

from workloads import catalogue

# tid, line, rule_id, vuln_type, severity, score, cwe, confidence, category, lang, snippet
GOLDEN: list[tuple] = [
    (0, 3, "SQLI-1", "SQL Injection", "Critical", 9.8, "CWE-89", "High", "Injection", "php",
     "mysqli_query($conn, $sql)"),
    (1, 4, "SQLI-1", "SQL Injection", "Critical", 9.8, "CWE-89", "High", "Injection", "python", "cursor.execute(q)"),
    (2, 5, "CMDI-1", "OS Command Injection", "Critical", 9.7, "CWE-78", "High", "Injection", "python",
     "os.system(y)"),
    (3, 3, "EVAL-1", "Use of eval() / Dynamic Code Execution", "High", 8.6, "CWE-95", "High", "CodeExec", "python",
     "eval(w)"),
    (3, 4, "CMDI-1", "OS Command Injection", "Critical", 9.7, "CWE-78", "High", "Injection", "python",
     "subprocess.run(v)"),
    (4, 2, "XSS-2", "DOM-based Cross-Site Scripting (XSS)", "Critical", 9.2, "CWE-79", "High", "XSS", "javascript",
     "el.innerHTML = q"),
    (4, 3, "XSS-3", "DOM XSS via document.write", "Critical", 9.0, "CWE-79", "High", "XSS", "javascript",
     "document.write(q)"),
    (5, 1, "RAND-1", "Insecure Randomness for Security-Sensitive Value", "Medium", 6.5, "CWE-330", "Medium", "Crypto",
     "javascript", "token = Math.random()"),
    (5, 3, "PROTOPOLLUTE-1", "Prototype Pollution", "High", 7.8, "CWE-1321", "Low", "CodeExec", "javascript",
     "merge({}, req.body)"),
    (6, 4, "MEM-1", "Buffer Overflow (unsafe memory function)", "Critical", 9.6, "CWE-120", "High", "Memory", "c",
     "strcpy(buf, argv[1])"),
    (6, 5, "MEM-2", "Format String Vulnerability", "High", 8.7, "CWE-134", "Medium", "Memory", "c", "printf(buf)"),
    (7, 2, "SQLI-1", "SQL Injection", "Critical", 9.8, "CWE-89", "High", "Injection", "java",
     'stmt.executeQuery("select * from t where id=" + id)'),
    (7, 3, "CRYPTO-1B", "Insecure Hash Algorithm (MessageDigest)", "Medium", 6.8, "CWE-327", "High", "Crypto", "java",
     'MessageDigest.getInstance("MD5")'),
    (7, 4, "CRYPTO-2", "Weak Cipher / Insecure Mode (DES or ECB)", "High", 8.1, "CWE-327", "Medium", "Crypto", "java",
     'Cipher.getInstance("DES/ECB/PKCS5Padding")'),
    (8, 1, "SECRET-1", "Hardcoded Secret / Credential", "Critical", 9.1, "CWE-798", "Medium", "Secrets", "python",
     'api_key = "k{k}abcdef"'),
    (8, 3, "SECRET-1", "Hardcoded Secret / Credential", "Critical", 9.1, "CWE-798", "Medium", "Secrets", "python",
     'db_password = "hunter{k}"'),
    (8, 3, "SECRET-2", "Hardcoded Database Credential", "Medium", 6.0, "CWE-798", "Medium", "Secrets", "python",
     'db_password = "hunter{k}"'),
    (8, 4, "CONFIGSCAN-Debug_Mode_Enabled", "Debug Mode Enabled", "Medium", 6.1, "CWE-489", "Medium", "Config",
     "python", "DEBUG = True"),
    (8, 5, "CONFIGSCAN-Disabled_TLS/Certificate_Verification", "Disabled TLS/Certificate Verification", "High", 8.0,
     "CWE-295", "Medium", "Config", "python", "requests.get(url, verify=False)"),
    (9, 2, "XSS-1", "Reflected Cross-Site Scripting (XSS)", "High", 8.5, "CWE-79", "Medium", "XSS", "php", "echo $n"),
    (9, 4, "COOKIE-1", "Cookie Missing Secure/HttpOnly Flag", "Medium", 5.4, "CWE-614", "Low", "Config", "php",
     'setcookie("a", "b")'),
    (9, 6, "DEBUG-1", "Information Disclosure (debug output)", "Low", 4.8, "CWE-200", "Medium", "InfoLeak", "php",
     "print_r($n)"),
    (10, 2, "XSS-4", "javascript: URI Scheme", "Medium", 6.1, "CWE-79", "Low", "XSS", "html",
     'href="javascript:alert({k})"'),
    (10, 5, "XSS-2", "DOM-based Cross-Site Scripting (XSS)", "Critical", 9.2, "CWE-79", "High", "XSS",
     "html (inline <script>)", 'document.getElementById("o").innerHTML = h'),
    (11, 3, "FALLBACK-SQL_Injection", "SQL Injection", "Critical", 9.8, "CWE-89", "Low", "Fallback", "unknown",
     "cursor.execute(b)"),
    (11, 5, "FALLBACK-Insecure_Hash_Algorithm", "Insecure Hash Algorithm", "Medium", 6.8, "CWE-327", "Low",
     "Fallback", "unknown", "md5(x)"),
    (12, 4, "FALLBACK-Command_Injection", "Command Injection", "Critical", 9.7, "CWE-78", "Low", "Fallback",
     "unknown", "system(p)"),
    (13, 1, "CRYPTO-1", "Insecure Hash Algorithm", "Medium", 6.8, "CWE-327", "High", "Crypto", "python",
     'hashlib.md5(hashlib.sha1(b"x").digest())'),
    (14, 1, "REDOS-1", "Potential ReDoS (catastrophic backtracking)", "Medium", 6.2, "CWE-1333", "Low", "ReDoS",
     "python", 're.compile("(a+)+$")'),
    (15, 1, "SECRETSCAN-AWS_Access_Key", "AWS Access Key", "Critical", 9.1, "CWE-798", "High", "Secrets", "python",
     'aws = "{aws}"'),
    (16, 1, "JWT-1", "JWT 'none' Algorithm or Disabled Verification", "Critical", 9.0, "CWE-347", "High", "Auth",
     "python", 'jwt.decode(t, key, algorithms=["none"])'),
    (16, 1, "CONFIGSCAN-JWT_'none'_Algorithm_Accepted", "JWT 'none' Algorithm Accepted", "Critical", 9.0, "CWE-347",
     "Medium", "Config", "python", 'jwt.decode(t, key, algorithms=["none"])'),
    (18, 2, "REDIR-2", "Open Redirect via location assignment", "Medium", 6.3, "CWE-601", "Low", "Redirect",
     "javascript", "window.location = u"),
    (18, 3, "REDIR-2", "Open Redirect via location assignment", "Medium", 6.3, "CWE-601", "Low", "Redirect",
     "javascript", "location.href = u"),
    (19, 1, "DEBUG-2", "Debug Mode Enabled", "Medium", 6.1, "CWE-489", "Medium", "InfoLeak", "python",
     "app.run(debug=True)"),
]
EXTENSIONS = [".php", ".py", ".py", ".py", ".js", ".js", ".c", ".java", ".py", ".php", ".html", ".txt", ".txt", ".py",
              ".py", ".py", ".py", ".py", ".js", ".py"]


def _sql(value) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)


EXT_VALUES = _values(enumerate(EXTENSIONS))
PATH = "'repo' || (o_custkey % 50) || '/f' || o_orderkey || x.ext"


def _filled(col: str) -> str:
    return (f"replace(replace({col}, '{{k}}', o_orderkey::VARCHAR), '{{aws}}',"
            " 'AK' || 'IA' || lpad(o_orderkey::VARCHAR, 16, '0'))")


def _per_template(columns: str, rows, select: str, path: str = "path") -> str:
    return f"""
        WITH x(tid, ext) AS (VALUES {EXT_VALUES}), g({columns}) AS (VALUES {_values(rows)})
        SELECT {PATH} AS {path}, {select}
        FROM orders JOIN x ON o_orderkey % 20 = x.tid JOIN g ON g.tid = x.tid"""


def _findings(keep=lambda row: True) -> str:
    rows = [r for r in GOLDEN if keep(r)]
    return _per_template(
        "tid, line, rule_id, vuln_type, severity, score, cwe, confidence, category, lang, snippet", rows,
        "line::BIGINT AS line, rule_id, vuln_type, severity, score::DOUBLE AS score, cwe, confidence, category, lang, "
        + _filled("snippet") + " AS code_snippet", path="file_path")


def _rule(*prefixes: str):
    return lambda row: row[2].startswith(prefixes)


_LINE_ENGINES = ("FALLBACK-", "CONFIGSCAN-", "SECRETSCAN-")
_CALL_TAINT = ("SQLI-", "CMDI-", "PROTOPOLLUTE-", "XSS-1", "XSS-3")
_CALL_ALWAYS = ("EVAL-", "MEM-1", "MEM-2", "CRYPTO-", "DEBUG-", "XSS-4", "REDOS-", "JWT-")

# ---- facts, by hand per template: (tid, line, callee, args) -------------------------
CALLS = [
    (0, 3, "mysqli_query(", "($conn, $sql)"),
    (1, 1, "request.args.get(", '("q")'), (1, 2, "escape(", "(q)"), (1, 3, "cursor.execute(", "(safe)"),
    (1, 4, "cursor.execute(", "(q)"),
    (2, 1, "input(", "()"), (2, 4, "os.system(", "(x)"), (2, 5, "os.system(", "(y)"),
    (3, 1, "request.args.get(", '("v")'), (3, 2, "v.strip(", "()"), (3, 3, "eval(", "(w)"),
    (3, 4, "subprocess.run(", "(v)"), (3, 5, "os.popen(", "(w)"),
    (4, 3, "document.write(", "(q)"), (4, 4, "DOMPurify.sanitize(", "(q)"),
    (5, 1, "Math.random(", "()"), (5, 2, "Math.random(", "()"), (5, 3, "merge(", "({}, req.body)"),
    (6, 4, "strcpy(", "(buf, argv[1])"), (6, 5, "printf(", "(buf)"), (6, 6, "printf(", '("%s", buf)'),
    (7, 1, "request.getParameter(", '("id")'),
    (7, 2, "stmt.executeQuery(", '("select * from t where id=" + id)'),
    (7, 3, "MessageDigest.getInstance(", '("MD5")'),
    (7, 4, "Cipher.getInstance(", '("DES/ECB/PKCS5Padding")'),
    (7, 5, "Cipher.getInstance(", '("DESede/CBC/PKCS5Padding")'),
    (8, 5, "requests.get(", "(url, verify=False)"),
    (9, 2, "echo", "$n"), (9, 3, "echo", "htmlspecialchars($n)"), (9, 3, "htmlspecialchars(", "($n)"),
    (9, 4, "setcookie(", '("a", "b")'), (9, 5, "setcookie(", '("a", "b", secure: true)'), (9, 6, "print_r(", "($n)"),
    (13, 1, "hashlib.md5(", '(hashlib.sha1(b"x").digest())'), (13, 1, "hashlib.sha1(", '(b"x")'),
    (13, 1, 'hashlib.sha1(b"x").digest(', "()"),
    (14, 1, "re.compile(", '("(a+)+$")'), (14, 2, "re.compile(", '("a+b")'),
    (16, 1, "jwt.decode(", '(t, key, algorithms=["none"])'),
    (17, 1, "print(", '("hello {k}")'),
    (19, 1, "app.run(", "(debug=True)"),
]
# (tid, line, lhs, rhs, simple, literal)
DEFS = [
    (0, 1, "$firstname", '$_POST["firstname"]', True, False),
    (0, 2, "$sql", "\"SELECT lastname FROM users WHERE firstname='$firstname'\"", True, True),
    (0, 3, "$result", "mysqli_query($conn, $sql)", True, False),
    (1, 1, "q", 'request.args.get("q")', True, False), (1, 2, "safe", "escape(q)", True, False),
    (2, 1, "x", "input()", True, False), (2, 2, "y", "x", True, False), (2, 3, "x", '"const"', True, True),
    (3, 1, "v", 'request.args.get("v")', True, False), (3, 2, "w", "v.strip()", True, False),
    (4, 1, "q", "req.query.name", True, False), (4, 2, "el.innerHTML", "q", False, False),
    (4, 4, "el.innerHTML", "DOMPurify.sanitize(q)", False, False),
    (5, 1, "token", "Math.random()", True, False), (5, 2, "n", "Math.random()", True, False),
    (7, 1, "id", 'request.getParameter("id")', True, False),
    (7, 3, "md", 'MessageDigest.getInstance("MD5")', True, False),
    (7, 4, "c", 'Cipher.getInstance("DES/ECB/PKCS5Padding")', True, False),
    (7, 5, "d", 'Cipher.getInstance("DESede/CBC/PKCS5Padding")', True, False),
    (8, 1, "api_key", '"k{k}abcdef"', True, True), (8, 2, "password", '"changeme"', True, True),
    (8, 3, "db_password", '"hunter{k}"', True, True), (8, 4, "DEBUG", "True", True, False),
    (9, 1, "$n", '$_GET["n"]', True, False),
    (15, 1, "aws", '"{aws}"', True, True),
    (18, 1, "u", "location.search", True, False), (18, 2, "window.location", "u", False, False),
    (18, 3, "location.href", "u", False, False), (18, 4, "link.href", '"/home"', False, True),
]
# (tid, context, line, variable, line of its definition), files with a source only
REACHED = [
    (0, "def", 2, "firstname", 1), (0, "def", 3, "sql", 2), (0, "call", 3, "sql", 2),
    (1, "call", 2, "q", 1), (1, "def", 2, "q", 1), (1, "call", 3, "safe", 2), (1, "call", 4, "q", 1),
    (2, "def", 2, "x", 1), (2, "call", 4, "x", 3), (2, "call", 5, "y", 2),
    (3, "call", 3, "w", 2), (3, "call", 4, "v", 1), (3, "call", 5, "w", 2),
    (4, "def", 2, "q", 1), (4, "call", 3, "q", 1), (4, "def", 4, "q", 1), (4, "call", 4, "q", 1),
    (7, "call", 2, "id", 1),
    (9, "stmt", 2, "n", 1), (9, "stmt", 3, "n", 1), (9, "call", 3, "n", 1), (9, "call", 6, "n", 1),
    (18, "def", 2, "u", 1), (18, "def", 3, "u", 1),
]
TAINTED = [
    (0, 1, "firstname"), (0, 2, "sql"), (0, 3, "result"), (1, 1, "q"), (2, 1, "x"), (2, 2, "y"), (3, 1, "v"),
    (4, 1, "q"), (7, 1, "id"), (9, 1, "n"), (18, 1, "u"),
]
# (tid, line, tokens that are neither blank nor comment)
TOKENS = [
    (0, 1, 7), (0, 2, 4), (0, 3, 9),
    (1, 1, 6), (1, 2, 6), (1, 3, 4), (1, 4, 4),
    (2, 1, 5), (2, 2, 3), (2, 3, 3), (2, 4, 4), (2, 5, 4),
    (3, 1, 6), (3, 2, 5), (3, 3, 4), (3, 4, 4), (3, 5, 4),
    (4, 1, 5), (4, 2, 4), (4, 3, 5), (4, 4, 7),
    (5, 1, 7), (5, 2, 7), (5, 3, 8),
    (6, 2, 12), (6, 3, 6), (6, 4, 10), (6, 5, 5), (6, 6, 7), (6, 8, 1),
    (7, 1, 8), (7, 2, 7), (7, 3, 8), (7, 4, 8), (7, 5, 8),
    (8, 1, 3), (8, 2, 3), (8, 3, 3), (8, 4, 3), (8, 5, 8),
    (9, 1, 7), (9, 2, 3), (9, 3, 6), (9, 4, 7), (9, 5, 11), (9, 6, 5),
    (13, 1, 10), (14, 1, 4), (14, 2, 4), (15, 1, 3), (16, 1, 12), (17, 1, 4),
    (18, 1, 5), (18, 2, 4), (18, 3, 4), (18, 4, 4), (19, 1, 6),
]

_TRIMMED = ("' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)"
            " || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196)"
            " || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233)"
            " || chr(8239) || chr(8287) || chr(12288)")
_LINES = r"""
    parts AS (SELECT doc_id, regexp_split_to_array(text,
            '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS a FROM documents),
    lines AS (SELECT 'doc' || doc_id || '.txt' AS path, u.line_no, u.line
        FROM parts, LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS line_no) u
        WHERE NOT (u.line_no = len(a) AND u.line = ''))"""
_SNIPPET = f"substring(trim(line, {_TRIMMED}), 1, 200)"
_FALLBACK_FREE = [
    ("FALLBACK-DOM-based_XSS", "DOM-based XSS", "(innerHTML|document\\.write|script\\.src)", "Critical", 9.2, "CWE-79"),
    ("FALLBACK-Buffer_Overflow", "Buffer Overflow", "\\b(sprintf|strcpy|gets)\\b", "Critical", 9.6, "CWE-120"),
    ("FALLBACK-Hardcoded_Secret", "Hardcoded Secret", "(api_key|secret|token|AK" + "IA[0-9A-Z]{16})", "Critical", 9.1,
     "CWE-798"),
    ("FALLBACK-Insecure_Hash_Algorithm", "Insecure Hash Algorithm", "(md5|sha1)\\(", "Medium", 6.8, "CWE-327"),
    ("FALLBACK-Use_of_eval()", "Use of eval()", "\\beval\\s*\\(", "High", 8.6, "CWE-95"),
    ("FALLBACK-Information_Disclosure", "Information Disclosure", "(phpinfo|print_r|var_dump|debug)", "Low", 4.8,
     "CWE-200"),
]
_CUSTOM = [
    ("CUSTOM-email", "E-mail Address", "[a-z0-9._-]+@[a-z0-9.-]+\\.[a-z]{2,}", "Low", 2.0),
    ("CUSTOM-licence", "Licence Text", "licen[cs]e", "Low", 1.0),
    ("CUSTOM-ipv4", "IPv4 Address", "[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}", "Medium", 3.0),
]
_PATTERNS = [(r[0], r[2]) for r in _CUSTOM] + [("CUSTOM-digits", "[0-9]{6,}")]

_PAGE_LINES = _LINES.replace("doc_id", "page_id").replace("'doc'", "'page'").replace("'.txt'", "'.html'").replace(
    "text,", "html,").replace("FROM documents", "FROM pages")
# Line rules that hold for every file, and calls a page's script would be reported for.
_EVERYWHERE = [
    ("CONFIGSCAN-Disabled_TLS/Certificate_Verification", "Disabled TLS/Certificate Verification",
     "(?i)verify\\s*=\\s*False|rejectUnauthorized\\s*:\\s*false|InsecureSkipVerify\\s*[:=]\\s*true", "High", 8.0,
     "CWE-295", "Medium", "Config"),
    ("CONFIGSCAN-Debug_Mode_Enabled", "Debug Mode Enabled",
     "(?i)^\\s*DEBUG\\s*=\\s*True\\b|display_errors\\s*=\\s*1\\b|app\\.debug\\s*=\\s*true", "Medium", 6.1, "CWE-489",
     "Medium", "Config"),
    ("SECRETSCAN-AWS_Access_Key", "AWS Access Key", "\\b(?:AK" + "IA|AS" + "IA)[0-9A-Z]{16}\\b", "Critical", 9.1,
     "CWE-798", "High", "Secrets"),
    ("SECRETSCAN-Private_Key_Block", "Private Key Block", "-----BEGIN (?:[A-Z]+ )*PRIVATE" + " KEY-----", "Critical",
     9.1, "CWE-798", "High", "Secrets"),
]
_IN_SCRIPT = "(?i)<script[^>]*>[^<]*(eval\\(|document\\.write|md5\\(|sha1\\(|console\\.log)"

_ECO = "(['PyPI', 'npm', 'Maven', 'Go', 'Debian'])"
_DEPS = f"""
    deps AS (
        SELECT DISTINCT 'proj' || l_orderkey AS project, 'pkg' || (l_partkey % 700) AS package,
            CASE WHEN l_linenumber = 7 THEN 'PyPI' ELSE {_ECO}[l_suppkey % 5 + 1] END AS ecosystem, l_linenumber = 7 AS d
        FROM lineitem
        UNION ALL SELECT 'cust' || c_custkey, 'pkg' || (c_custkey % 500),
            (['PyPI', 'npm', 'Maven', 'Go', 'Debian', 'Debian', 'Alpine'])[c_custkey % 7 + 1], false FROM customer
        UNION ALL SELECT 'cust' || c_custkey, 'pkg1', 'Unknown', false FROM customer),
    adv AS (SELECT 'ADV-' || p_partkey AS id, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS summary,
            'pkg' || (p_partkey % 500) AS package, {_ECO}[p_partkey % 5 + 1] AS ecosystem FROM part)"""

_RAW = """
    raw AS (SELECT 'f' || (l_orderkey % 5000) AS file_path, l_linenumber::BIGINT AS line,
            (['A', 'B', 'C'])[l_suppkey % 3 + 1] AS vuln_type,
            (['Critical', 'High', 'Medium', 'Low', 'Other'])[l_suppkey % 5 + 1] AS severity,
            (10.0 - l_suppkey % 7)::DOUBLE AS score,
            (['High', 'Medium', 'Low', '?'])[l_partkey % 4 + 1] AS confidence,
            l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS seq FROM lineitem),
    best AS (SELECT *, row_number() OVER (PARTITION BY file_path, line, vuln_type ORDER BY
                CASE confidence WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, seq,
                severity, score) AS rn,
            min(seq) OVER (PARTITION BY file_path, line, vuln_type) AS first_seq FROM raw)"""

_GRAPH = r"""
    li_seed AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, (l_suppkey % 5)::VARCHAR AS var FROM lineitem
        WHERE l_linenumber = 1),
    li_edge AS (SELECT DISTINCT l_orderkey::VARCHAR AS path, (l_partkey % 5)::VARCHAR AS src,
        (l_suppkey % 5)::VARCHAR AS dst FROM lineitem)"""
_TXT = """
    txt AS (SELECT 'repo' || (o_custkey % 50) || '/f' || o_orderkey || '.txt' AS path, o_orderkey % 20 AS tid
        FROM orders WHERE o_orderkey % 20 IN (11, 12))"""

_TAG = r"""<[a-zA-Z?](?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_PIECES = rf"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|{_TAG}|[^<]+|<"""
_IN_TAG = r"""(?s)<[/!?]?[\w:-]*|[^\s=>"''/<]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+))?|\s+|."""

# Line rules that need no taint, which a stream reports.
_NEED_TAINT = ("FALLBACK-SQL_Injection", "FALLBACK-Command_Injection", "FALLBACK-Reflected_XSS", "FALLBACK-Path_Traversal",
               "FALLBACK-File_Inclusion")


def _catalogue(keep=lambda rule: True) -> str:
    rows = [r for r in catalogue.expected() if keep(r[-1])]
    return f"""WITH g(tid, ext, line, vuln_type, severity, score, cwe, confidence, category, explanation, recommendation,
            lang, code_snippet, rule_id) AS (VALUES {_values(rows)})
        SELECT 'app/c' || c_custkey || ext AS file_path, line::BIGINT AS line, line::BIGINT AS end_line, vuln_type, severity,
            score::DOUBLE AS score, cwe, confidence, category, '' AS reason, explanation, recommendation, lang,
            code_snippet, '' AS taint_source, rule_id
        FROM customer JOIN g ON c_custkey % {len(catalogue.FILES)} = g.tid"""


ORACLES: dict[str, str] = {
    "rule_findings": _catalogue(),
    "stream_lines": _catalogue(lambda rule: rule.startswith(_LINE_ENGINES) and rule not in _NEED_TAINT),
    "scan_findings": _findings(),
    "stream_scan": _findings(),
    "ingest_lenient": f"""SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS digest, '' AS reject_reason
        FROM (SELECT doc_id, 'b' || replace(text, chr(65533), '') AS t FROM documents)""",
    "lang_detect": _per_template("tid, lang, engine", [
        (i, {".php": "php", ".py": "python", ".js": "javascript", ".c": "c", ".java": "java", ".html": "html",
             ".txt": "unknown"}[e], {".html": "html", ".txt": "fallback"}.get(e, "struct"))
        for i, e in enumerate(EXTENSIONS)], "lang, engine"),
    "line_split": f"WITH {_LINES} SELECT path, line_no::BIGINT AS line_no, {_SNIPPET} AS snippet,"
                  " length(line)::BIGINT AS n_chars FROM lines",
    "line_rule_scan": f"""WITH {_LINES}, r(rule_id, vuln_type, pattern, severity, score, cwe) AS
            (VALUES {_values(_FALLBACK_FREE)})
        SELECT path AS file_path, line_no::BIGINT AS line, rule_id, vuln_type, severity, score::DOUBLE AS score, cwe,
            'Low' AS confidence, 'Fallback' AS category, 'unknown' AS lang, {_SNIPPET} AS code_snippet
        FROM lines JOIN r ON regexp_matches(line, '(?i)' || pattern)""",
    "config_scan": _findings(_rule("CONFIGSCAN-")),
    "sink_batches": _findings(_rule("CONFIGSCAN-")),
    "secret_tokens": _findings(_rule("SECRETSCAN-")),
    "custom_rules": f"""WITH {_LINES}, r(rule_id, vuln_type, pattern, severity, score) AS (VALUES {_values(_CUSTOM)})
        SELECT path AS file_path, line_no::BIGINT AS line, rule_id, vuln_type, severity, score::DOUBLE AS score,
            'Medium' AS confidence, {_SNIPPET} AS code_snippet
        FROM lines JOIN r ON regexp_matches(line, '(?i)' || pattern)""",
    "archived_documents": """
WITH d AS (SELECT doc_id, doc_id // 200 AS a, coalesce(text, '') AS t FROM documents)
SELECT 'a' || a || '.zip!/d' || doc_id || '.txt' AS name, strlen(t) AS n_bytes, md5(t) AS digest, NULL::VARCHAR AS reason FROM d
UNION ALL SELECT DISTINCT 'a' || a || 'x.zip', NULL::BIGINT, NULL, 'archive' FROM d WHERE a % 3 = 0""",
    "advisory_records": """
WITH p AS (SELECT 'ADV-' || p_partkey AS id, p_partkey AS k, p_partkey % 7 = 0 AS broken, p_partkey % 10 = 0 AS empty FROM part)
SELECT id, 'pkg' || k AS package, 'PyPI' AS ecosystem, '' AS reject_reason FROM p WHERE NOT broken AND NOT empty AND k % 6 <> 0
UNION ALL SELECT id, 'shared', 'npm', '' FROM p WHERE NOT broken AND NOT empty
UNION ALL SELECT '', '', '', 'malformed JSON' FROM p WHERE broken
UNION ALL SELECT id, '', '', 'no affected package' FROM p WHERE NOT broken AND empty
UNION ALL SELECT id, '', '', 'affected entry 1 names no package' FROM p WHERE NOT broken AND NOT empty AND k % 6 = 0""",
    "rule_table_match": """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents),
r AS (SELECT doc_id, w, 'R' || doc_id AS rule_id, CASE WHEN doc_id % 50 = 0 THEN '' ELSE lower(w[1] || ' ' || w[2]) END AS a, CASE WHEN doc_id % 50 = 0 OR doc_id % 5 <> 0 THEN NULL ELSE lower(w[4] || ' ' || w[5]) END AS b,
  CASE WHEN doc_id % 50 = 0 THEN '[0-9]{' || (doc_id % 7 + 3) || '}' WHEN doc_id % 5 = 0 THEN w[1] || ' ' || w[2] || '[ ]+' || w[3] || '|' || w[4] || ' ' || w[5] || '[ ]+' || w[6]
       ELSE w[1] || ' ' || w[2] || '[ ]+' || w[3] END AS p FROM w WHERE len(w) >= 6),
t AS (SELECT doc_id, text, lower(text) AS low FROM documents),
c AS (SELECT t.doc_id, rule_id, text, p FROM t JOIN r ON contains(low, a) OR contains(low, b))
SELECT doc_id, rule_id FROM c WHERE regexp_matches(text, p, 'i')""",
    "pattern_match": f"""WITH r(rule_id, pattern) AS (VALUES {_values(_PATTERNS)})
        SELECT doc_id, rule_id FROM documents JOIN r ON regexp_matches(text, '(?i)' || pattern)""",
    "html_scripts": r"""WITH s AS (SELECT 'page' || page_id || '.html' AS path,
            regexp_extract(html, '(?is)^(.*?<script[^>]*>)', 1) AS head,
            regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script\s*>', 1) AS bodies FROM pages)
        SELECT path, 0::BIGINT AS unit_no, (length(head) - length(replace(head, chr(10), '')))::BIGINT AS line_offset,
            unnest(bodies) AS content FROM s""",
    "html_attrs": rf"""WITH p AS (SELECT page_id, regexp_extract_all(html, '{_PIECES}') AS a FROM pages),
        t AS (SELECT page_id, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM p),
        l AS (SELECT *, 1 + coalesce(sum(length(piece) - length(replace(piece, chr(10), ''))) OVER
            (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t),
        s AS (SELECT page_id, i, line, regexp_extract_all(piece, '{_IN_TAG}') AS b FROM l
            WHERE regexp_matches(piece, '^<[A-Za-z?]') AND NOT regexp_matches(piece, '(?i)^<(script|style)\b')),
        u AS (SELECT page_id, i, line, unnest(b) AS part, generate_subscripts(b, 1) AS j FROM s),
        v AS (SELECT *, coalesce(sum(length(part) - length(replace(part, chr(10), ''))) OVER
            (PARTITION BY page_id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS down FROM u)
        SELECT 'page' || page_id || '.html' AS path, (line + down)::BIGINT AS line,
            regexp_extract(part, '^([^\s=>"''/<]+)', 1) AS attr,
            coalesce(regexp_extract(part, '(?s)=\s*"([^"]*)"', 1), '')
            || CASE WHEN part LIKE '%"%' THEN '' ELSE coalesce(regexp_extract(part, '(?s)=\s*''([^'']*)''', 1), '')
               || CASE WHEN part LIKE '%''%' THEN '' ELSE coalesce(regexp_extract(part, '=\s*(\S+)$', 1), '') END END
            AS value
        FROM v WHERE regexp_matches(part, '^[^\s=>"''/<]')""",
    "page_findings": f"""WITH {_PAGE_LINES}, r(rule_id, vuln_type, pattern, severity, score, cwe, confidence,
            category) AS (VALUES {_values(_EVERYWHERE)})
        SELECT path AS file_path, line_no::BIGINT AS line, rule_id, vuln_type, severity, score::DOUBLE AS score, cwe,
            confidence, category, 'html' AS lang, {_SNIPPET} AS code_snippet
        FROM lines JOIN r ON regexp_matches(line, pattern)
        UNION ALL
        SELECT 'page' || page_id || '.html', 0, 'script', 'script', '', 0, '', '', '', 'html', html
        FROM pages WHERE regexp_matches(html, {_sql(_IN_SCRIPT)}) OR regexp_matches(html, '(?i)<[^>]+javascript:')
        UNION ALL
        SELECT 'page' || page_id || '.html', length(html) - length(replace(html, chr(10), '')) + down, rule_id, vuln_type,
            severity, score::DOUBLE, cwe, confidence, 'XSS', lang, snippet
        FROM pages CROSS JOIN (VALUES
            (4, 'XSS-2', 'DOM-based Cross-Site Scripting (XSS)', 'Critical', 9.2, 'CWE-79', 'High', 'html (inline <script>)',
             'out.innerHTML = h'),
            (6, 'XSS-4', 'javascript: URI Scheme', 'Medium', 6.1, 'CWE-79', 'Low', 'html', 'href="javascript:go()"'))
            t(down, rule_id, vuln_type, severity, score, cwe, confidence, lang, snippet) WHERE page_id % 2 = 0""",
    "html_findings": _findings(lambda r: r[0] == 10),
    "token_lines": _per_template("tid, line, n", TOKENS, "line::BIGINT AS line, n::BIGINT AS n_tokens"),
    "call_facts": _per_template("tid, line, callee, args", CALLS,
                                "line::BIGINT AS line, callee, " + _filled("args") + " AS args"),
    "assign_facts": _per_template(
        "tid, line, lhs_text, rhs, is_simple, is_literal", DEFS,
        "line::BIGINT AS line, lhs_text, " + _filled("rhs") + " AS rhs_text, is_simple, is_literal"),
    "reaching_defs": _per_template("tid, ctx_kind, line, var, def_line", REACHED,
                                   "ctx_kind, line::BIGINT AS line, var, def_line::BIGINT AS def_line"),
    "flow_taint": _per_template("tid, line, var", TAINTED, "line::BIGINT AS line, var"),
    "taint_closure": f"""WITH RECURSIVE {_GRAPH}, {_TXT},
        seed AS (SELECT * FROM li_seed UNION SELECT path, 'a' FROM txt WHERE tid = 11
            UNION SELECT path, unnest(['q', 'argv']) FROM txt WHERE tid = 12),
        edge AS (SELECT * FROM li_edge UNION SELECT path, 'a', 'b' FROM txt WHERE tid = 11
            UNION SELECT path, 'q', 'p' FROM txt WHERE tid = 12 UNION SELECT path, 'p', 'q' FROM txt WHERE tid = 12),
        walk(path, var, depth) AS (SELECT path, var, 0 FROM seed
            UNION SELECT w.path, e.dst, w.depth + 1 FROM walk w JOIN edge e ON e.path = w.path AND e.src = w.var
            WHERE w.depth < 6)
        SELECT path, var, min(depth)::BIGINT AS depth FROM walk GROUP BY path, var""",
    "tainted_lines": f"""WITH {_TXT}, g(tid, line_no, line) AS (VALUES (11, 1, 'a = input()'), (11, 2, 'b = a'),
            (11, 3, 'cursor.execute(b)'), (12, 1, 'p = q'), (12, 2, 'q = p'), (12, 3, 'q = argv[1]'),
            (12, 4, 'system(p)'))
        SELECT path, line_no::BIGINT AS line_no, line FROM txt JOIN g USING (tid)""",
    "fallback_taint_scan": _findings(_rule("FALLBACK-")),
    "call_taint": _findings(_rule(*_CALL_TAINT)),
    "call_always": _findings(_rule(*_CALL_ALWAYS)),
    "assign_taint": _findings(_rule("XSS-2", "REDIR-2")),
    "assign_literal": _findings(_rule("SECRET-")),
    "missing_flag": _findings(_rule("COOKIE-1")),
    "weak_random": _findings(_rule("RAND-1")),
    "php_echo": _findings(_rule("XSS-1")),
    "dep_advisories": f"""WITH {_DEPS} SELECT project, 'dependency:' || package AS file_path, 0::BIGINT AS line,
            coalesce(id, 'Unknown CVE') AS vuln_type, 'High' AS severity, 7.5::DOUBLE AS score,
            coalesce(summary, 'Package vulnerability') AS explanation, lower(ecosystem) AS lang,
            'Medium' AS confidence
        FROM deps JOIN adv USING (package, ecosystem)""",
    "dep_clean": f"""WITH {_DEPS} SELECT project, package, ecosystem FROM deps WHERE NOT EXISTS
        (SELECT 1 FROM adv WHERE adv.package = deps.package AND adv.ecosystem = deps.ecosystem)""",
    "dedupe_findings": f"WITH {_RAW} SELECT file_path, line, vuln_type, severity, score, confidence, seq, first_seq"
                       " FROM best WHERE rn = 1",
    "ranked_findings": f"""WITH {_RAW} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'Critical' THEN 4
            WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END DESC, score DESC, file_path, line,
            first_seq) AS rank, file_path, line, vuln_type, severity, score FROM best WHERE rn = 1""",
    "severity_report": f"""WITH f AS ({_findings()}) SELECT severity, cwe, category, count(*) AS n_findings,
            max(score) AS max_score FROM f GROUP BY severity, cwe, category""",
    "file_report": f"""WITH f AS ({_findings()}) SELECT file_path, count(*) AS n_findings,
            string_agg(line || ':' || rule_id, ',' ORDER BY CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3
            WHEN 'Medium' THEN 2 ELSE 1 END DESC, score DESC, line, rule_id DESC) AS rules FROM f GROUP BY file_path""",
    "union_counts": """SELECT engine, sum(n)::BIGINT AS n_findings FROM orders JOIN (VALUES
            (0, 'struct', 1), (1, 'struct', 1), (2, 'struct', 1), (3, 'struct', 2), (4, 'struct', 2), (5, 'struct', 2),
            (6, 'struct', 2), (7, 'struct', 3), (8, 'struct', 3), (8, 'config', 2), (9, 'struct', 3), (10, 'struct', 2),
            (11, 'fallback', 2), (12, 'fallback', 1), (13, 'struct', 3), (14, 'struct', 1), (15, 'secrets', 1),
            (16, 'struct', 1), (16, 'config', 1), (18, 'struct', 2), (19, 'struct', 1)) g(tid, engine, n)
        ON o_orderkey % 20 = g.tid GROUP BY engine""",
}
