"""The rule catalogue as data.

Patterns, names, CWE ids, severities, scores and the look-up lists are fixed
values: results are only right when they are exactly these.  The advice texts
are this project's own wording.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from taintlake.functions.patterns import quoted
from taintlake.schemas import RULE


class Rule(NamedTuple):
    rule_id: str
    rule_ord: int
    engine: str
    kind: str
    name: str
    cwe: str
    severity: str
    score: float
    category: str
    confidence: str
    languages: list[str]
    sink_patterns: list[str]
    args_pattern: str | None
    args_must_match: str | None
    lhs_name_pattern: str | None
    requires_taint: bool
    recommendation: str
    explanation: str


PY, JS, PHP, JAVA, C, CPP = "python", "javascript", "php", "java", "c", "cpp"
STRUCT_LANGS = [PY, JS, PHP, JAVA, C, CPP]
EVERY = [PY, JS, PHP, JAVA, C, CPP, "html"]

# ---- fixed values: extension -> language -----------------------------------
EXT_LANG = {
    ".py": PY,
    ".js": JS, ".jsx": JS, ".ts": JS, ".tsx": JS,
    ".php": PHP,
    ".java": JAVA,
    ".c": C, ".h": C,
    ".cpp": CPP, ".cc": CPP, ".hpp": CPP,
    ".html": "html", ".htm": "html",
}

# ---- fixed values: ordinals -------------------------------------------------
SEVERITY_RANK = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
CONFIDENCE_RANK = {"High": 3, "Medium": 2, "Low": 1}

# ---- fixed values: taint sources and sanitizers per language ----------------
TAINT_SOURCES = {
    PY: [r"^input$", r"request\.(args|form|values|json|GET|POST|COOKIES|data|headers|files)\b",
         r"\bsys\.argv\b", r"\.get_json\b", r"flask\.request\b"],
    JS: [r"req\.(query|body|params|headers|cookies)\b", r"document\.location\b", r"window\.location\b",
         r"document\.cookie\b", r"location\.(hash|search)\b", r"process\.argv\b", r"\.searchParams\b"],
    PHP: [r"^\$_(GET|POST|REQUEST|COOKIE|SERVER|FILES)\b", r"\bfile_get_contents\(\s*['\"]php://input"],
    JAVA: [r"request\.getParameter", r"request\.getHeader", r"request\.getQueryString", r"request\.getCookies",
           r"request\.getInputStream", r"\bSystem\.getenv\b", r"\bSystem\.in\b"],
    C: [r"\bargv\b", r"\bgetenv\(", r"\bscanf\(", r"\bgets\("],
    CPP: [r"\bargv\b", r"\bgetenv\(", r"\bscanf\(", r"\bgets\(", r"\bcin\b"],
}
SANITIZERS = {
    PY: [r"\bescape\b", r"bleach\.clean", r"markupsafe\.escape", r"shlex\.quote", r"secure_filename",
         r"\bquote_plus\b", r"html\.escape"],
    JS: [r"escapeHtml", r"DOMPurify\.sanitize", r"encodeURIComponent", r"encodeURI", r"validator\.escape",
         r"sanitize-html", r"\.escape\("],
    PHP: [r"htmlspecialchars", r"htmlentities", r"filter_var", r"escapeshellarg", r"real_escape_string",
          r"mysqli_real_escape_string", r"\bbasename\(", r"intval\(", r"\(int\)"],
    JAVA: [r"escapeHtml", r"StringEscapeUtils", r"Encode\.forHtml", r"\bsanitize\b"],
    C: [r"\bsnprintf\b"],
    CPP: [r"\bsnprintf\b"],
}
FALLBACK_SOURCES = [
    r"\$_(GET|POST|REQUEST|COOKIE)", r"request\.getParameter", r"\binput\s*\(", r"\bargv\s*\[",
    r"document\.location", r"window\.location", r"document\.cookie",
]

# ---- fixed values: literals that are no secrets ------------------------------
PLACEHOLDERS = [
    "", "todo", "changeme", "change_me", "xxx", "example", "your_api_key", "your_api_key_here", "none", "null",
    "undefined", "placeholder", "fixme", "test", "dummy", "<secret>", "***",
]
# Literal kinds that count as a hard-coded value besides strings.
NUMBER_LITERAL_LANGS = [PY, JS, C, CPP]

# ---- fixed values: nested-quantifier shapes ----------------------------------
REDOS_SHAPES = [r"\([^()]*[+*]\)[+*]", r"\([^()]*[+*][^()]*\)\{?\d*,?\}?[+*]"]

# ---- fixed values: ecosystem labels and advisory defaults --------------------
ECOSYSTEM_LABELS = {
    "Python Package": "PyPI",
    "Node.js Package": "npm",
    "Java Package": "Maven",
    "Go Package": "Go",
    "C / C++ Library": "Debian",
    "Linux Package (Debian/Ubuntu)": "Debian",
    "Alpine Linux Package": "Alpine",
}
DEFAULT_ECOSYSTEM = "PyPI"
ADVISORY_DEFAULT_ID = "Unknown CVE"
ADVISORY_DEFAULT_SUMMARY = "Package vulnerability"
ADVISORY_SEVERITY, ADVISORY_SCORE = "High", 7.5
ADVISORY_ADVICE = "Move to a release that carries the fix"


def _s(rule_id, kind, name, cwe, severity, score, category, confidence, languages, sinks=(), args=None,
       must=None, lhs=None, fix="", why=""):
    return dict(rule_id=rule_id, engine="struct", kind=kind, name=name, cwe=cwe, severity=severity, score=score,
                category=category, confidence=confidence, languages=list(languages), sink_patterns=list(sinks),
                args_pattern=args, args_must_match=must, lhs_name_pattern=lhs,
                requires_taint=kind in ("call_taint", "assign_taint"), recommendation=fix, explanation=why)


# ---- fixed values: structural rules ------------------------------------------
_STRUCT = [
    _s("SQLI-1", "call_taint", "SQL Injection", "CWE-89", "Critical", 9.8, "Injection", "High", EVERY,
       [r"mysqli_query", r"\bquery\(", r"executeQuery", r"executeUpdate", r"cursor\.execute", r"\.execute\(",
        r"createStatement", r"raw\(", r"PDO::query", r"->query\(", r"db\.query"],
       fix="Bind values as parameters of a prepared statement.",
       why="Request data becomes part of the SQL text, so the caller can change the query."),
    _s("CMDI-1", "call_taint", "OS Command Injection", "CWE-78", "Critical", 9.7, "Injection", "High", EVERY,
       [r"\bsystem\(", r"\bexec\(", r"shell_exec", r"popen\(", r"os\.system", r"os\.popen",
        r"subprocess\.(call|run|Popen|check_output)", r"Runtime\.getRuntime\(\)\.exec", r"ProcessBuilder",
        r"child_process", r"exec_sync", r"execSync"],
       fix="Start the program with an argument vector and no shell; accept only known arguments.",
       why="Request data reaches a command line of the operating system."),
    _s("SSTI-1", "call_taint", "Server-Side Template Injection", "CWE-1336", "Critical", 9.3, "Injection", "Medium",
       [PY, JS, JAVA, PHP],
       [r"render_template_string", r"\bTemplate\(", r"Jinja2", r"\bpug\.render\(", r"\.render\(.*\)",
        r"Velocity\.evaluate", r"twig.*render"],
       fix="Keep template sources constant and hand request data over as context values.",
       why="Request data is compiled as a template on the server."),
    _s("NOSQLI-1", "call_taint", "NoSQL Injection", "CWE-943", "Critical", 9.1, "Injection", "Low", [JS, PY],
       [r"\.find\(", r"\.findOne\(", r"\.aggregate\(", r"\.update\(", r"\.updateOne\(", r"\.deleteMany\("],
       fix="Copy the expected fields one by one and refuse operator keys.",
       why="Request data shapes a document-store filter and may carry query operators."),
    _s("LDAPI-1", "call_taint", "LDAP Injection", "CWE-90", "High", 8.2, "Injection", "Low", [JAVA, PY, PHP],
       [r"\bsearch\(", r"ldap_search", r"DirContext", r"\.bind\("],
       fix="Encode filter metacharacters before the filter is put together.",
       why="Request data is placed in a directory filter as it came."),
    _s("HEADERI-1", "call_taint", "HTTP Header / CRLF Injection", "CWE-93", "High", 7.5, "Injection", "Low",
       [PY, JS, JAVA, PHP], [r"setHeader", r"\.header\(", r"add_header", r"setRequestProperty"],
       fix="Reject line breaks in values that go into headers.",
       why="Request data is written to a header, where a line break starts a new one."),
    _s("XSS-1", "call_taint", "Reflected Cross-Site Scripting (XSS)", "CWE-79", "High", 8.5, "XSS", "Medium",
       [PHP, JAVA, PY], [r"^echo$", r"^print$", r"\bprintln\b", r"getWriter\(\)\.print", r"render_template_string"],
       fix="Encode for HTML at the point of output.",
       why="Request data is sent back in the page without encoding."),
    _s("XSS-2", "assign_taint", "DOM-based Cross-Site Scripting (XSS)", "CWE-79", "Critical", 9.2, "XSS", "High",
       [JS, "html"], [r"\.innerHTML$", r"\.outerHTML$", r"\.insertAdjacentHTML"],
       fix="Assign textContent, or clean the markup first.",
       why="Untrusted text is handed to the browser as markup."),
    _s("XSS-3", "call_taint", "DOM XSS via document.write", "CWE-79", "Critical", 9.0, "XSS", "High", [JS, "html"],
       [r"document\.write", r"document\.writeln"],
       fix="Build nodes with the DOM API.",
       why="Untrusted text is written into the document stream."),
    _s("XSS-4", "call_always", "javascript: URI Scheme", "CWE-79", "Medium", 6.1, "XSS", "Low", ["html", JS],
       [r"javascript:"],
       fix="Use event listeners and accept only http(s) links.",
       why="Following this link runs script in the page."),
    _s("MEM-1", "call_always", "Buffer Overflow (unsafe memory function)", "CWE-120", "Critical", 9.6, "Memory",
       "High", [C, CPP], [r"\bstrcpy\(", r"\bstrcat\(", r"\bgets\(", r"\bsprintf\("],
       fix="Call the variant that takes the size of the destination.",
       why="The function writes without knowing how large the destination is."),
    _s("MEM-2", "call_always", "Format String Vulnerability", "CWE-134", "High", 8.7, "Memory", "Medium", [C, CPP],
       [r"\bprintf\(", r"\bfprintf\(", r"\bsyslog\("], args=r"^\([^\"]*$",
       fix="Print through a constant format such as \"%s\".",
       why="The format is not a constant, so its directives can come from outside."),
    _s("MEM-3", "call_always", "Use of Dangerous Memory Function", "CWE-676", "Medium", 6.4, "Memory", "Low",
       [C, CPP], [r"\balloca\(", r"\bmemcpy\(", r"\bstrncpy\("],
       fix="Check the length argument against the destination.",
       why="The call is safe only if its length argument is right."),
    _s("INTOVF-1", "call_taint", "Potential Integer Overflow in Allocation", "CWE-190", "Medium", 6.0, "Memory",
       "Low", [C, CPP], [r"\bmalloc\(", r"\bcalloc\(", r"\brealloc\("],
       fix="Limit the value before it takes part in a size.",
       why="An outside value decides how much memory is asked for."),
    _s("PATH-1", "call_taint", "Path Traversal", "CWE-22", "High", 8.3, "Path", "Medium", [PY, JS, PHP, JAVA],
       [r"\bopen\(", r"fopen\(", r"readFile", r"createReadStream", r"\bFile\(", r"Paths\.get",
        r"new FileInputStream"],
       fix="Resolve the path and make sure it stays below the allowed directory.",
       why="Request data names a file, so '../' can leave the intended directory."),
    _s("LFI-1", "call_taint", "Local/Remote File Inclusion", "CWE-98", "High", 8.4, "Path", "Medium", [PHP],
       [r"\binclude\(", r"\binclude_once\(", r"\brequire\(", r"\brequire_once\("],
       fix="Choose the file from a fixed list.",
       why="Request data decides which file is executed."),
    _s("DESERIAL-1", "call_taint", "Insecure Deserialization", "CWE-502", "Critical", 9.4, "Deserialization", "High",
       [PY, JAVA, PHP],
       [r"pickle\.loads?\(", r"yaml\.load\((?!.*SafeLoader)", r"\.readObject\(", r"\bunserialize\(",
        r"ObjectInputStream"],
       fix="Exchange plain data formats, or verify a signature first.",
       why="Objects are rebuilt from bytes that an outsider controls."),
    _s("XXE-1", "call_always", "XML External Entity (XXE) - risky parser default", "CWE-611", "High", 8.2, "XML",
       "Low", [PY, JAVA, PHP],
       [r"etree\.parse\(", r"minidom\.parse\(", r"xml\.sax", r"DocumentBuilderFactory", r"SAXParserFactory",
        r"simplexml_load_string", r"simplexml_load_file"],
       fix="Switch off document types and external entities in the parser.",
       why="The parser may fetch entities that the document names."),
    _s("SSRF-1", "call_taint", "Server-Side Request Forgery (SSRF)", "CWE-918", "High", 8.6, "SSRF", "Medium",
       [PY, JS, JAVA, PHP],
       [r"requests\.(get|post|put|delete)\(", r"urllib\.request\.urlopen", r"urlopen\(", r"\baxios\.(get|post)\(",
        r"\bfetch\(", r"curl_exec", r"HttpClient", r"\.openConnection\("],
       fix="Allow known hosts only and refuse internal addresses.",
       why="Request data chooses the host that the server talks to."),
    _s("REDIR-1", "call_taint", "Open Redirect", "CWE-601", "Medium", 6.5, "Redirect", "Medium", [PY, JS, JAVA, PHP],
       [r"sendRedirect", r"redirect\(", r"RedirectResponse"],
       fix="Redirect to known paths only.",
       why="Request data chooses where the visitor is sent."),
    _s("REDIR-2", "assign_taint", "Open Redirect via location assignment", "CWE-601", "Medium", 6.3, "Redirect",
       "Low", [JS, "html"], [r"location\.href$", r"window\.location$", r"\.href$"],
       fix="Compare the target with known addresses first.",
       why="Untrusted text decides where the browser goes."),
    _s("EVAL-1", "call_always", "Use of eval() / Dynamic Code Execution", "CWE-95", "High", 8.6, "CodeExec", "High",
       [PY, JS, PHP], [r"\beval\(", r"\bexec\(", r"new Function\(", r"\bcreate_function\("],
       fix="Replace generated code by a parser or a table of operations.",
       why="Text is run as program code."),
    _s("PROTOPOLLUTE-1", "call_taint", "Prototype Pollution", "CWE-1321", "High", 7.8, "CodeExec", "Low", [JS],
       [r"Object\.assign\(", r"_\.merge\(", r"_\.extend\(", r"\bmerge\("],
       fix="Merge into objects without prototype and drop __proto__ keys.",
       why="Merging request data may change the prototype of all objects."),
    _s("REDOS-1", "call_always", "Potential ReDoS (catastrophic backtracking)", "CWE-1333", "Medium", 6.2, "ReDoS",
       "Low", [PY, JS, PHP, JAVA],
       [r"re\.(match|search|compile|fullmatch)\(", r"preg_match\(", r"Pattern\.compile\(", r"\.test\(",
        r"\.match\("],
       fix="Rewrite the pattern without a quantified group inside a quantifier.",
       why="Nested quantifiers may need exponential time on chosen input."),
    _s("CRYPTO-1", "call_always", "Insecure Hash Algorithm", "CWE-327", "Medium", 6.8, "Crypto", "High", EVERY,
       [r"\bmd5\(", r"\bsha1\(", r"hashlib\.md5", r"hashlib\.sha1"],
       fix="Use SHA-256, or a password hash where passwords are stored.",
       why="Collisions for this hash can be computed."),
    _s("CRYPTO-1B", "call_always", "Insecure Hash Algorithm (MessageDigest)", "CWE-327", "Medium", 6.8, "Crypto",
       "High", [JAVA], [r"MessageDigest\.getInstance\("], args=r"(MD5|SHA-?1)\b",
       fix="Ask for SHA-256, or a password hash where passwords are stored.",
       why="Collisions for this digest can be computed."),
    _s("CRYPTO-2", "call_always", "Weak Cipher / Insecure Mode (DES or ECB)", "CWE-327", "High", 8.1, "Crypto",
       "Medium", [JAVA, PY, PHP], [r"Cipher\.getInstance\(", r"DES\.new\(", r"\bcreate_cipher\("],
       args=r"(DES(?!ede)|ECB)",
       fix="Use AES in an authenticated mode.",
       why="DES keys are too short and ECB shows equal blocks."),
    _s("CRYPTO-3", "call_always", "Hardcoded Cryptographic Key or IV", "CWE-321", "High", 7.9, "Crypto", "Low", EVERY,
       [r"SecretKeySpec\(", r"IvParameterSpec\("], args=r"[\"']",
       fix="Draw initial vectors at random and load keys from a vault.",
       why="Key material seems to be part of the source text."),
    _s("RAND-1", "lhs_random", "Insecure Randomness for Security-Sensitive Value", "CWE-330", "Medium", 6.5, "Crypto",
       "Medium", [PY, JS, PHP, JAVA],
       [r"Math\.random\(", r"\brandom\.random\(", r"\brandom\.randint\(", r"\brand\(", r"\bmt_rand\(",
        r"new Random\("],
       lhs=r"(token|secret|password|session|otp|reset|api[_-]?key|nonce|csrf)",
       fix="Take the value from the platform's cryptographic generator.",
       why="The generator's next values can be predicted."),
    _s("SECRET-1", "assign_literal", "Hardcoded Secret / Credential", "CWE-798", "Critical", 9.1, "Secrets", "Medium",
       EVERY,
       lhs=r"(api[_-]?key|secret|token|passwd|password|access[_-]?key|private[_-]?key|client[_-]?secret)",
       fix="Read credentials from a vault or from the environment.",
       why="A variable with the name of a credential holds a literal."),
    _s("SECRET-2", "assign_literal", "Hardcoded Database Credential", "CWE-798", "Medium", 6.0, "Secrets", "Medium",
       [PHP, PY, JAVA, JS], lhs=r"(db[_-]?password|database[_-]?password|db[_-]?pass|mysql[_-]?password)",
       fix="Read database credentials from a vault or from the environment.",
       why="The password of a database is part of the source text."),
    _s("CORS-1", "call_always", "Overly Permissive CORS Policy", "CWE-942", "High", 7.4, "Config", "High",
       [PY, JS, JAVA], [r"CORSMiddleware", r"\bcors\(", r"Access-Control-Allow-Origin"], args=r"\*",
       fix="List the origins that may call.",
       why="Any site may call this service from a browser."),
    _s("COOKIE-1", "missing_flag", "Cookie Missing Secure/HttpOnly Flag", "CWE-614", "Medium", 5.4, "Config", "Low",
       [PHP, JS, PY], [r"setcookie\(", r"res\.cookie\(", r"set_cookie\("],
       must=r"(secure\s*[:=]\s*true|httponly\s*[:=]\s*true|httponly\s*[:=]\s*True|secure\s*[:=]\s*True)",
       fix="Set Secure and HttpOnly.",
       why="The call shows neither the Secure nor the HttpOnly flag."),
    _s("JWT-1", "call_always", "JWT 'none' Algorithm or Disabled Verification", "CWE-347", "Critical", 9.0, "Auth",
       "High", [PY, JS, JAVA, PHP], [r"jwt\.decode\(", r"jwt\.verify\(", r"JWT::decode\("],
       args=r"(algorithm[s]?\s*=\s*\[?[\"']none|verify\s*=\s*False|verify_signature\s*=\s*False)",
       fix="Name the accepted algorithms and keep verification on.",
       why="The token is accepted without a signature check."),
    _s("MASSASSIGN-1", "call_taint", "Mass Assignment", "CWE-915", "Medium", 6.7, "Config", "Low", [PY, JS],
       [r"\.create\(", r"\.save\(", r"Model\(", r"new \w+\("],
       fix="Copy the permitted fields by name.",
       why="A whole request body fills a model, fields nobody meant included."),
    _s("DEBUG-1", "call_always", "Information Disclosure (debug output)", "CWE-200", "Low", 4.8, "InfoLeak", "Medium",
       [PHP, PY, JS, JAVA],
       [r"\bphpinfo\(", r"\bprint_r\(", r"\bvar_dump\(", r"console\.log\(.*password", r"\.printStackTrace\("],
       fix="Remove debug output or send it to a protected log.",
       why="Debug output may show internals to visitors."),
    _s("DEBUG-2", "call_always", "Debug Mode Enabled", "CWE-489", "Medium", 6.1, "InfoLeak", "Medium", [PY],
       [r"app\.run\("], args=r"debug\s*=\s*True",
       fix="Start production services with debug off.",
       why="Debug mode shows stack traces and offers an interactive console."),
]


def _line(engine, name, pattern, taint, severity, score, cwe, category, confidence, fix, why):
    prefix = {"fallback": "FALLBACK-", "config": "CONFIGSCAN-", "secrets": "SECRETSCAN-"}[engine]
    return dict(rule_id=prefix + name.replace(" ", "_"), engine=engine, kind="line", name=name, cwe=cwe,
                severity=severity, score=score, category=category, confidence=confidence, languages=[],
                sink_patterns=[pattern] if isinstance(pattern, str) else pattern, args_pattern=None, args_must_match=None, lhs_name_pattern=None,
                requires_taint=taint, recommendation=fix, explanation=why)


def _fallback(name, pattern, taint, severity, score, cwe):
    return _line("fallback", name, pattern, taint, severity, score, cwe, "Fallback", "Low",
                 "Check by hand: no structural analysis exists for this kind of file.",
                 f"{name}: a line pattern matched in a file without structural analysis.")


# ---- fixed values: line rules for files without structural analysis -----------
_FALLBACK = [
    _fallback("SQL Injection", r"(mysqli_query|executeQuery|executeUpdate|cursor\.execute|\.execute\()", True,
              "Critical", 9.8, "CWE-89"),
    _fallback("Command Injection", r"(\bsystem\(|\bexec\(|shell_exec|os\.system|Runtime\.getRuntime)", True,
              "Critical", 9.7, "CWE-78"),
    _fallback("Reflected XSS", r"(^echo|^print|<\?=)", True, "High", 8.5, "CWE-79"),
    _fallback("DOM-based XSS", r"(innerHTML|document\.write|script\.src)", False, "Critical", 9.2, "CWE-79"),
    _fallback("Buffer Overflow", r"\b(sprintf|strcpy|gets)\b", False, "Critical", 9.6, "CWE-120"),
    _fallback("Path Traversal", r"\.\./", True, "High", 8.3, "CWE-22"),
    _fallback("File Inclusion", r"(include|require)", True, "High", 8.4, "CWE-98"),
    _fallback("Hardcoded Secret", r"(api_key|secret|token|AKIA[0-9A-Z]{16})", False, "Critical", 9.1, "CWE-798"),
    _fallback("Insecure Hash Algorithm", r"(md5|sha1)\(", False, "Medium", 6.8, "CWE-327"),
    _fallback("Use of eval()", r"\beval\s*\(", False, "High", 8.6, "CWE-95"),
    _fallback("Information Disclosure", r"(phpinfo|print_r|var_dump|debug)", False, "Low", 4.8, "CWE-200"),
]

# ---- publicly documented shapes of credentials ---------------------------------
_SECRET_ADVICE = ("Revoke the credential and load its successor from a vault.",
                  "The line holds text with the published shape of a credential.")
_SECRETS = [
    _line("secrets", name, pattern, False, "Critical", 9.1, "CWE-798", "Secrets", "High", *_SECRET_ADVICE)
    for name, pattern in [
        ("AWS Access Key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
        ("GitHub Token", [r"\bgh[pousr]_[A-Za-z0-9]{36,}", r"\bgithub_pat_[A-Za-z0-9_]{22,}"]),
        ("Stripe Key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
        ("Slack Token", r"\bxox[abprs]-[0-9A-Za-z-]{10,}"),
        ("Google API Key", r"\bAIza[0-9A-Za-z_-]{35}"),
        ("Private Key Block", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
        ("JSON Web Token", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ]
]

# ---- fixed values: configuration line rules ------------------------------------
_CONFIG = [
    _line("config", "Disabled TLS/Certificate Verification",
          r"(verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*[:=]\s*true|"
          r"ALLOW_ALL_HOSTNAME_VERIFIER|setHostnameVerifier\([^)]*ALLOW_ALL)",
          False, "High", 8.0, "CWE-295", "Config", "Medium",
          "Keep verification on and repair the trust store.",
          "Certificates are not checked, so anyone on the path can answer."),
    _line("config", "Debug Mode Enabled",
          r"(^\s*DEBUG\s*=\s*True\b|display_errors\s*=\s*1\b|app\.debug\s*=\s*[Tt]rue)",
          False, "Medium", 6.1, "CWE-489", "Config", "Medium",
          "Ship with debug off.",
          "A debug switch is on; errors will show internals."),
    _line("config", "Overly Permissive CORS Policy (raw config)",
          r"(allow_origins\s*=\s*\[?[\"']\*[\"']|Access-Control-Allow-Origin[\"']?\s*[:=]\s*[\"']\*[\"'])",
          False, "High", 7.4, "CWE-942", "Config", "Medium",
          "List the origins that may call.",
          "The setting lets any site call this service from a browser."),
    _line("config", "JWT 'none' Algorithm Accepted", r"algorithm[s]?\s*=\s*\[?[\"']none[\"']",
          False, "Critical", 9.0, "CWE-347", "Config", "Medium",
          "Name the signing algorithms that are accepted.",
          "Tokens without a signature are accepted."),
]

RULES: list[Rule] = [
    Rule(rule_ord=i, **row) for i, row in enumerate([*_STRUCT, *_FALLBACK, *_SECRETS, *_CONFIG])
]
RULE_KINDS = ["call_taint", "call_always", "missing_flag", "assign_taint", "assign_literal", "lhs_random", "line"]


def _sql(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "CAST(array(" + ", ".join(map(_sql, value)) + ") AS ARRAY<STRING>)"
    return quoted(value)


def rules_frame(spark: SparkSession, rules: list[Rule] | None = None, columns: list[str] | None = None) -> DataFrame:
    """The catalogue as a DataFrame of constants.  It is a local relation, so
    Spark knows its size and decides by it whether to broadcast."""
    fields = [f for f in RULE if columns is None or f.name in columns]
    rows = ", ".join("(" + ", ".join(_sql(getattr(r, f.name)) for f in fields) + ")"
                     for r in (RULES if rules is None else rules))
    names = ", ".join(f.name for f in fields)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})").select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])
