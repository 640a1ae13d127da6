"""Source text to a token table with built-in functions only.

One literal regex per language cuts a text into consecutive pieces; every piece
is ``blanks + token`` so that joining pieces gives the text back.  A dotted name
(``request.args.get``) is one token, as are a comment and a whole string, which
keeps the table small and lets source patterns see the name they expect.

Code inside a string (JavaScript templates, Python f-strings) is cut like other code,
level by level, and sits between braces in the same row of pieces.

Only possessive or lazy single-character loops are used: grouped greedy loops
overflow the stack of the Java matcher on long tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taintlake.functions.patterns import lang_case, one_of, quoted
from taintlake.rules.catalog import C, CPP, JAVA, JS, PHP, PY

_BLANKS = r"[ \t\f]*+"
_WORD = r"[A-Za-z_$\x{80}-\x{10FFFF}][\w$\x{80}-\x{10FFFF}]*+"
_NL = r"\r?\n|\r"
_BLOCK_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
_LINE_COMMENT = r"//[^\r\n]*+"
_DQ = r'"(?:[^"\\\r\n]|\\(?s:.))*+"?'
_SQ = r"'(?:[^'\\\r\n]|\\(?s:.))*+'?"
_DQ_MULTI = r'"(?:[^"\\]|\\(?s:.))*+"?'
_SQ_MULTI = r"'(?:[^'\\]|\\(?s:.))*+'?"
_NUMBER = r"\.?\d[\w.]*+"
_ASSIGN = r"(?:<<|>>>?|\*\*|//|&&|\|\||\?\?|[-+*/%&|^@.])?=(?![=>])"
_COMPARE = r"=>|===?|!==?|<=>|<=|>="
_OPERATOR = r"\.{3}|\+\+|--|&&|\|\||<<|>>|\?\?|->|::|[^\s]"
_DIRECTIVE = r"#(?:[^\r\n\\]|\\\r?\n|\\.)*+"
_GENERIC = r"<[\w\s,.?<>\[\]]*>(?=\s*\()"
_CONTINUED = r"\\\r?\n"


# Code in a string ends at the bracket that matches its first one.  The dialect has no
# recursion, so the pattern is unrolled: to SHALLOW levels as a literal, and for a text
# whose braces nest deeper to as many levels as it has, in steps of two so that few
# patterns occur.  DEEPEST keeps a hostile text from overflowing the matcher's stack.
SHALLOW, DEEPEST = 6, 512
_CODE = "\x00code\x00"  # stands for the code in a string until the depth is known
_JS_INNER = "[^{}`]|`[^`]*+`"  # a template in a template takes its braces along
_PY_INNER = "[^{}]"


def _unrolled(plain: str, levels: int) -> str:
    inner = f"(?:{plain})*+"
    for _ in range(levels):
        inner = f"(?:{plain}|\\{{{inner}\\}})*+"
    return inner


def _name(connector: str, word: str = _WORD, new: bool = False) -> str:
    lead = r"(?:new\s++)?" if new else ""
    return rf"(?:(?:{connector})\s*+)?{lead}{word}(?:\s*+(?:{connector})\s*+{word})*+"


_PHP_WORD = r"\$*+[A-Za-z_\x{80}-\x{10FFFF}][\w\x{80}-\x{10FFFF}]*+"
_PHP_NAME = _name(r"\?->|->|::", rf"(?:\\?(?:\w++\\)*+{_PHP_WORD})", new=True)
_JS_TEMPLATE = rf"`(?:[^`\\$]|\\(?s:.)|\$(?!\{{)|\$\{{{_CODE}\}})*+`" r"|`(?:[^`\\]|\\(?s:.))*+`?"
# Matches start where the last one ended, so what is before the blanks decides.
_JS_REGEX = (rf"(?<=[=(,:\[!&|?{{}};+\n]|\breturn){_BLANKS}"
             r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*+\])++/[a-z]*+")
_PY_CODE = rf"\{{\{{|\\N\{{[^{{}}\r\n]*+\}}|\{{{_CODE}\}}"
_PY_F = "|".join(rf"(?i:f|fr|rf){q}(?:{_PY_CODE}|[^{q}\\\r\n{{]|\\(?s:.))*+{q}" for q in "\"'")
_PY_TRIPLE = r'"""(?s:.*?)(?:"""|\z)' + r"|'''(?s:.*?)(?:'''|\z)"

_ALTERNATIVES = {
    PY: [_NL, _CONTINUED, r"#[^\r\n]*+", rf"(?i:[rbuf]{{1,2}})?(?:{_PY_TRIPLE})", _PY_F, rf"(?i:[rbuf]{{1,2}})?(?:{_DQ}|{_SQ})", _NUMBER, r"\.{3}",
         _name(r"\."), _ASSIGN, _COMPARE, _OPERATOR],
    JS: [_NL, _LINE_COMMENT, _BLOCK_COMMENT, _JS_TEMPLATE, _DQ, _SQ, _NUMBER, r"\.{3}",
         _name(r"\?\.|\.", new=True), _ASSIGN, _COMPARE, _OPERATOR],
    PHP: [_NL, r"\A(?!<\?(?:php|=))(?s:.+?)(?=<\?(?:php|=))", r"\?>(?s:.*?)(?:(?=<\?(?:php|=))|\z)",
          r"<\?php\b", r"<\?=", r"#(?!\[)[^\r\n]*+", _LINE_COMMENT, _BLOCK_COMMENT,
          r"<<<[ \t]*+(['\"]?)(\w++)\1\r?\n(?s:.*?)(?:\n[ \t]*+\2\b|\z)", _DQ_MULTI, _SQ_MULTI, _NUMBER, r"\.{3}",
          _PHP_NAME, _ASSIGN, _COMPARE, _OPERATOR],
    JAVA: [_NL, _LINE_COMMENT, _BLOCK_COMMENT, r'"""(?s:.*?)(?:"""|\z)', _DQ, _SQ, _NUMBER, r"\.{3}",
           _name(r"\.|::", new=True), _GENERIC, _ASSIGN, _COMPARE, _OPERATOR],
    C: [_NL, _CONTINUED, _LINE_COMMENT, _BLOCK_COMMENT, _DIRECTIVE, rf"(?:u8|[uUL])?(?:{_DQ}|{_SQ})", _NUMBER,
        r"\.{3}", _name(r"\.|->"), _ASSIGN, _COMPARE, _OPERATOR],
    CPP: [_NL, _CONTINUED, _LINE_COMMENT, _BLOCK_COMMENT, _DIRECTIVE,
          r'(?:u8|[uUL])?R"([^\s()\\]*+)\((?s:.*?)(?:\)\1"|\z)', rf"(?:u8|[uUL])?(?:{_DQ}|{_SQ})", _NUMBER,
          r"\.{3}", _name(r"\.|->|::", new=True), _GENERIC, _ASSIGN, _COMPARE, _OPERATOR],
}
LEX = {lang: f"{_BLANKS}(?:{'|'.join(alts)})" for lang, alts in _ALTERNATIVES.items()}
LEX[JS] = f"{_JS_REGEX}|{LEX[JS]}"

# ---- fixed values: words that are neither callees nor variables; those that are
# ---- keywords only in some places (match, of, get, set, async) are names -------
_COMMON = "if else for while do switch case default return break continue try catch finally throw class new".split()
KEYWORDS = {
    PY: ("if elif else for while return yield try except finally raise with as def class lambda and or not in is "
         "import from pass del global nonlocal assert async await True False None").split(),
    JS: _COMMON + ("function var let const await typeof instanceof in delete void yield extends import "
                   "export static true false null undefined").split(),
    PHP: _COMMON + ("function fn elseif foreach endif endforeach endwhile as and or xor instanceof global static "
                    "public private protected abstract final const use namespace extends implements match "
                    "true false null").split(),
    JAVA: _COMMON + ("instanceof extends implements throws import package static final public private protected "
                     "abstract synchronized native assert true false null").split(),
    C: _COMMON[:_COMMON.index("try")] + ("goto sizeof typedef static extern const volatile struct enum union inline register "
                       "NULL").split(),
    CPP: _COMMON + ("goto sizeof typedef static extern const volatile struct enum union inline register namespace "
                    "using template typename operator delete virtual public private protected constexpr true false "
                    "nullptr NULL").split(),
}
PHP_OUTPUT = ["echo", "print"]
PHP_INCLUDE = ["include", "include_once", "require", "require_once"]


#: Text before some code in a string, and the code; and what ends the code without being
#: part of it: blanks, and a conversion or a plain format of a Python replacement field.
_SPLIT = {JS: rf"((?:[^\\$]|\\(?s:.)|\$(?!\{{))*+)(?:\$\{{({_CODE})\}}|\z)",
          PY: rf"((?:\{{\{{|\}}\}}|\\N\{{[^{{}}\r\n]*+\}}|[^{{}}])*+)(?:\{{({_CODE})\}}|\z)"}
_REST = {JS: r"[ \t\f]*+\z", PY: r"[ \t\f]*+(?:![rsa])?(?::[^\[\](){}'\":]*+)?[ \t\f]*+\z"}
_INNER = {JS: _JS_INNER, PY: _PY_INNER}
#: What a text must hold for any of its strings to hold code.
_MAY_HOLD_CODE = {JS: "contains(content, '`') AND contains(content, '${')", PY: "contains(content, '{') AND content RLIKE '(?i)f[\"\\']'"}
_OPENS = {JS: r"^[ \t\f]*+`(?s:.)*?\$\{", PY: r"^[ \t\f]*+(?i:f|fr|rf)[\"'][^{]*+\{"}


def _depth(lang: str) -> str:
    """Levels to unroll for a text: 0 if none of its strings holds code, SHALLOW if its
    braces nest no deeper.  Pairs are taken out of the text's bare braces from the inside."""
    braces = "regexp_replace(content, '[^{}]++', '')"
    peeled = "replace(s.b, '{}', '')"
    rounds = f"sequence(1, greatest(1, least({DEEPEST}, CAST(length(x) / 2 AS INT))))"
    depth = f"""element_at(transform(array({braces}), x -> aggregate({rounds}, named_struct('b', x, 'n', 0),
        (s, i) -> if(length({peeled}) = length(s.b), s, named_struct('b', {peeled}, 'n', i)), s -> s.n)), 1)"""
    return f"""CASE WHEN NOT ({_MAY_HOLD_CODE[lang]}) THEN 0
        ELSE element_at(transform(array({depth}), d -> if(d <= {SHALLOW}, {SHALLOW}, CAST(least({DEEPEST}, pow(2, ceil(log2(d)))) AS INT))), 1) END"""


def depth() -> Column:
    return F.expr(lang_case({name: _depth(name) for name in (JS, PY)}, "0"))


def _all_matches(sql: str, regex: str, group: int, lang: str) -> str:
    """``regexp_extract_all`` of a pattern that may hold code, by the row's ``depth``."""
    if _CODE not in regex:
        return f"regexp_extract_all({sql}, {quoted(regex)}, {group})"
    plain = _INNER[lang]
    code = f"""aggregate(sequence(1, depth), {quoted(f'(?:{plain})*+')}, (r, i) -> concat({quoted(f'(?:{plain}|' + chr(92) + '{')}, r, {quoted(chr(92) + '})*+')}))"""
    deep = f"replace({quoted(regex.replace(_CODE, '<code>'))}, '<code>', {code})"
    plain_regex = regex.replace(_CODE, _unrolled(plain, SHALLOW))
    return f"if(depth <= {SHALLOW}, regexp_extract_all({sql}, {quoted(plain_regex)}, {group}), regexp_extract_all({sql}, {deep}, {group}))"


def _opened(lang: str) -> str:
    """Pieces with the code of strings cut in turn, a level of strings each round until
    none is left.  Text before code is a string piece, the code is in braces of its own,
    and text after it is one piece with the brace that closes the code."""
    mark = "$" if lang == JS else ""  # stands before the brace
    inner = _all_matches("concat('{', left(c, length(c) - length(r)))", LEX[lang], 0, lang)
    # A conversion or format is a piece of its own; blanks go to the brace behind them.
    code = f"""element_at(transform(array(regexp_extract(c, {quoted(_REST[lang])}, 0)), r -> concat(
        {inner}, if(trim(r) = '', array(), array(r)))), 1)"""
    blanks = f"element_at(transform(array(regexp_extract(codes[i - 1], {quoted(_REST[lang])}, 0)), r -> if(trim(r) = '', r, '')), 1)"
    part = f"""concat(array(concat(if(i = 0, '', concat({blanks}, '}}')), t, if(i < n, '{mark}', ''))),
        if(i < n, element_at(transform(array(codes[i]), c -> {code}), 1), array()))"""
    # The last match is the rest of the string; one more empty match may follow it.
    parts = f"""flatten(transform(slice(texts, 1, n + 1), (t, i) -> {part}))"""
    bind = f"""element_at(transform(array({_all_matches('p', _SPLIT[lang], 1, lang)}), texts -> element_at(transform(array(
        {_all_matches('p', _SPLIT[lang], 2, lang)}), codes -> element_at(transform(array(
        size(filter({_all_matches('p', _SPLIT[lang], 0, lang)}, (w, i) -> length(w) > length(texts[i])))),
        n -> if(n = 0, array(p), {parts})), 1)), 1)), 1)"""
    opened = f"flatten(transform(s.pieces, p -> if(p RLIKE {quoted(_OPENS[lang])}, {bind}, array(p))))"
    step = f"element_at(transform(array({opened}), q -> named_struct('pieces', q, 'done', size(q) = size(s.pieces))), 1)"
    rounds = "sequence(1, length(content) - length(replace(content, '{', '')))"  # a round opens a brace at least
    start = "named_struct('pieces', pieces, 'done', false)"
    return f"if(depth = 0, pieces, aggregate({rounds}, {start}, (s, k) -> if(s.done, s, {step}), s -> s.pieces))"


def pieces() -> Column:
    """Array of consecutive pieces of ``content``, by ``lang`` and ``depth``."""
    return F.expr(lang_case({name: _all_matches("content", regex, 0, name) for name, regex in LEX.items()},
                            "CAST(array() AS ARRAY<STRING>)"))


def with_code_of_strings() -> Column:
    """``pieces`` with the code in strings as pieces like others."""
    return F.expr(lang_case({name: _opened(name) for name in (JS, PY)}, "pieces"))


def kind_of() -> Column:
    """Kind of a token ``text`` without its blanks, from its length ``size`` and the codes of
    its first three characters ``head``, ``second``, ``third`` and of its last one ``tail``
    (0 where there is none).  Numbers are compared, not strings, as the JVM never compiles
    a method of more than 8,000 bytes, and this one runs for each token."""
    keyword = lang_case({name: one_of("lower(text)" if name == PHP else "text", words)
                         for name, words in KEYWORDS.items()})
    codes = lambda chars: f"({', '.join(str(ord(c)) for c in chars)})"
    between = lambda col, a, z: f"{col} BETWEEN {ord(a)} AND {ord(z)}"
    quotes = codes("\"'`")
    word_end = f"""({between("tail", "a", "z")} OR {between("tail", "A", "Z")} OR {between("tail", "0", "9")}
        OR tail IN {codes("_$")} OR tail > 127)"""
    comparison = f"""(head IN {codes("!<=>")} AND (size = 2 OR (size = 3 AND second = {ord("=")} AND head IN {codes("!=")})))"""
    return F.expr(f"""CASE
        WHEN head IN {codes(chr(10) + chr(13))} THEN 'nl'
        WHEN head IN {codes("([{")} AND size = 1 THEN 'open'
        WHEN head IN {codes(")]}")} THEN 'close'
        WHEN head = {ord(";")} AND size = 1 THEN 'sep'
        WHEN head = {ord(",")} AND size = 1 THEN 'comma'
        WHEN (head = {ord("#")} AND lang IN ('{PY}', '{PHP}', '{C}', '{CPP}'))
             OR (head = {ord("/")} AND lang <> '{PY}' AND (second = {ord("*")}
                 OR (second = {ord("/")} AND NOT (size = 3 AND tail = {ord("=")}))))
             OR (head = {ord(chr(92))} AND tail = 10) THEN 'comment'
        WHEN lang = '{PY}' AND head IN {codes(":!")} THEN 'op'
        WHEN lang = '{PHP}' AND head = {ord("<")} AND second = {ord("?")} THEN if(size = 3 AND tail = {ord("=")}, 'echo', 'sep')
        WHEN lang = '{PHP}' AND ((head = {ord("?")} AND second = {ord(">")})
             OR (head = {ord("<")} AND size > 3 AND second <> {ord("<")})) THEN 'sep'
        WHEN head IN {quotes}
             OR (lang = '{PHP}' AND head = {ord("<")} AND second = {ord("<")} AND third = {ord("<")}) THEN 'str'
        WHEN {between("head", "0", "9")} OR (head = {ord(".")} AND {between("second", "0", "9")}) THEN 'num'
        WHEN lang = '{JS}' AND head = {ord("/")} AND size > 1 AND tail <> {ord("=")} THEN 'regex'
        WHEN tail IN {quotes} THEN 'str'
        WHEN lang = '{PY}' AND (second IN {quotes} OR third IN {quotes}) AND head IN {codes("fFrR")} THEN 'str'
        WHEN tail = {ord("=")} AND NOT {comparison} THEN 'assign'
        WHEN head = {ord("<")} AND size > 1 AND tail = {ord(">")} AND lang IN ('{JAVA}', '{CPP}') THEN 'generic'
        WHEN {word_end} THEN CASE WHEN {keyword} THEN 'kw'
            WHEN lang = '{PHP}' AND {one_of("lower(text)", PHP_OUTPUT)} THEN 'echo'
            WHEN lang = '{PHP}' AND {one_of("lower(text)", PHP_INCLUDE)} THEN 'include' ELSE 'name' END
        ELSE 'op' END""")


def lex(units: DataFrame, carry: list[str]) -> DataFrame:
    """Token rows ``(file_id, pos, piece, text, kind, newlines)`` plus one header
    row per file at position 0.

    ``pos`` counts from 1 and indexes the array of pieces.  Only the header row
    holds that array and the columns named in ``carry``, so the text travels
    once per file and not once per token.
    """
    cut = units.withColumn("depth", depth()).withColumn("pieces", pieces()).withColumn("pieces", with_code_of_strings())
    head = F.col("pos") == 0
    rows = cut.select("file_id", "lang", "has_src", *carry, "pieces",
                      F.posexplode(F.concat(F.array(F.lit("")), F.col("pieces"))).alias("pos", "piece"))
    text = F.ltrim(F.col("piece"), F.lit(" \t\f"))
    rows = rows.select(
        "file_id", "lang", "has_src", "pos", "piece", text.alias("text"),
        F.when(head, F.struct(*carry)).alias("unit"),
        F.when(head, F.col("pieces")).alias("pieces"))
    code = lambda sql, name: f"coalesce(ascii({sql}), 0) AS {name}"
    rows = rows.selectExpr("*", "coalesce(length(text), 0) AS size", code("text", "head"), code("substring(text, 2, 1)", "second"),
                           code("substring(text, 3, 1)", "third"), code("right(text, 1)", "tail"))
    return rows.select(
        "file_id", "lang", "has_src", "pos", "piece", "text", "unit", "pieces",
        F.when(F.col("pos") == 0, "bof").otherwise(kind_of()).alias("kind"),
        F.expr("if(contains(text, '\\n'), length(text) - length(replace(text, '\\n', '')), 0)").alias("newlines"))
