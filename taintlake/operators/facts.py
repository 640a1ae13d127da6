"""Call, assignment and use facts from the token table.

The text is shuffled once, by file.  Everything after that is windows over
``(file_id, pos)`` and ``(file_id, level, pos)``, which keep the partitioning,
and one grouping back to a row per file.  Positions index the array of pieces
on that row, so any source span can be cut out exactly as written.

Vocabulary
    level   bracket depth; a bracket pair lies on the level around it
    chain   a postfix expression such as ``a.b(c)[d].e``; it starts at one token
            and continues over member names and directly following brackets
    call    an opening parenthesis that continues a chain
    use     a token that reads variables or a taint source
    cover   number of callee spans ``[chain start, call parenthesis)`` around a
            token: a receiver does not taint the value of its call
    clean   number of sanitizer spans around a token
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from taintlake.functions.patterns import lang_case, matches, may_match, quoted, widen
from taintlake.operators.lexer import lex
from taintlake.rules.catalog import C, CPP, JAVA, JS, PHP, PY, SANITIZERS, STRUCT_LANGS, TAINT_SOURCES

CARRY = ["path", "unit_no", "out_lang", "line_offset"]
_FILE = "PARTITION BY file_id ORDER BY pos"
_LEVEL = "PARTITION BY file_id, level ORDER BY pos"
_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def may_have_source() -> str:
    """Necessary condition for any tainted value in ``content``."""
    return may_match(TAINT_SOURCES)


def as_units(src_files: DataFrame) -> DataFrame:
    """Files to analysable units.  ``file_id`` identifies path and text, so equal
    copies fall together whatever path column the caller chose."""
    have = src_files.columns
    extra = {
        "unit_no": F.lit(0), "out_lang": F.col("lang"), "line_offset": F.lit(0),
    }
    out = src_files.select("path", "lang", "content",
                           *[(F.col(k) if k in have else v).alias(k) for k, v in extra.items()])
    return out.withColumn("file_id", F.unhex(F.md5(F.concat_ws("\x00", "path", F.col("unit_no").cast("string"),
                                                               "content"))))


#: Bytes of source text for one task.  They grow some 250-fold as token rows under two sorts.
TASK_BYTES = 2 << 20


def _one_per_file(units: DataFrame) -> DataFrame:
    """The only exchange of source text: by file id, equal copies reduced to one where
    they meet.  The text is measured and dealt over as many tasks as its tokens need: by the
    size of the shuffled text alone, a task would get hundreds of times its memory as token
    rows and spill them in every sort.  Nothing is sorted before the exchange, so a task that
    reads much of the input holds none of it."""
    size = units.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES))
    return (units.repartition(tasks, "file_id").groupBy("file_id")
            .agg(F.first(F.struct("lang", "content", *CARRY)).alias("u"))
            .select("file_id", "u.*"))


# ---------------------------------------------------------------- token table
def located_tokens(units: DataFrame, all_uses: bool = True) -> DataFrame:
    """Tokens with line and bracket level, comments and line ends dropped.

    ``has_src`` says whose uses and sources are wanted: all files', or only those
    that may hold a source."""
    files = _one_per_file(units).withColumn("has_src", F.lit(True) if all_uses else F.expr(may_have_source()))
    rows = lex(files, CARRY)
    step = "CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END"
    return rows.selectExpr(
        "*",
        f"CAST(1 + coalesce(sum(newlines) OVER ({_FILE} {_BEFORE}), 0) AS INT) AS line",
        f"CAST(sum({step}) OVER ({_FILE} {_SO_FAR}) - if(kind = 'open', 1, 0) AS INT) AS level",
    ).where("kind NOT IN ('nl', 'comment')")


def _use_names() -> str:
    """Variable names read by a token, without ``$``."""
    plain = f"regexp_replace(text, {quoted(r'^new\s+')}, '')"
    dotted = (f"if(contains(text, '.') OR contains(text, ':') OR startswith(text, 'new'),"
              f" filter(split({plain}, {quoted(r'\s*(?:\.|::)\s*')}), w -> w <> ''), array(text))")
    letters = r"[\w$\x{80}-\x{10FFFF}]+"
    first = f"regexp_extract_all({plain}, {quoted(rf'\A\$*({letters})')}, 1)"
    php_name = quoted(r"\A\$+([\w\x{80}-\x{10FFFF}]+)")
    name = lang_case({PY: dotted, JAVA: dotted, PHP: f"regexp_extract_all({plain}, {php_name}, 1)"}, first)
    in_php = (f"if(startswith(text, '\"') OR (startswith(text, '<<<') AND NOT startswith(text, {quoted('<<<' + chr(39))})),"
              f" regexp_extract_all(text, {quoted(r'(?<!\\)\$\{?(\w+)')}, 1), null)")
    return f"CASE kind WHEN 'name' THEN {name} WHEN 'str' THEN if(lang = '{PHP}', {in_php}, null) ELSE null END"


def _sources_split(lang: str) -> tuple[list[str], list[str], list[str]]:
    """Source patterns by anchoring: free ones, anchored ones, and those that may
    be searched in a string with variables in it."""
    free = [p for p in TAINT_SOURCES[lang] if not p.startswith("^")]
    leaf = [p for p in TAINT_SOURCES[lang] if p.startswith("^")]
    return free, leaf, free + [widen(p) for p in leaf if not p.endswith("$")]


def _neighbours(tokens: DataFrame) -> DataFrame:
    """Per token: what it reads, and all flags that depend on the tokens next to
    it.  Texts end here; the windows that follow move narrow rows only."""
    # Tokens behind are compared with short words only, so a long text need not travel.
    short = "if(length(text) <= 12, text, '')"
    # One struct for each direction, as each of them is made and copied for every token.
    behind = f"named_struct('kind', kind, 'text', {short}, 'pos', pos, 'line', line, 'end_line', line + newlines)"
    ahead = "named_struct('kind', kind, 'text', text, 'pos', pos, 'line', line)"
    rows = tokens.selectExpr(
        "*", *[f"lag({behind}, {i}) OVER ({_FILE}) AS {name}" for i, name in ((1, "p"), (2, "p2"), (3, "p3"))],
        *[f"lead({ahead}, {i}) OVER ({_FILE}) AS {name}" for i, name in ((1, "n"), (2, "n2"))])
    return rows.select(
        "file_id", "lang", "has_src", "pos", "kind", "line", "level", "unit", "pieces",
        F.expr(" | ".join(f"if({sql}, {_BIT[name]}, 0)" for name, sql in _flags().items())).alias("flags"),
        F.expr("n.pos").alias("n_pos"),
        F.expr("CASE n.kind WHEN 'str' THEN 1 WHEN 'num' THEN 2 ELSE 0 END").alias("n_literal"),
        F.expr("p.pos").alias("p_pos"), F.expr("p2.pos").alias("p2_pos"), F.expr("p2.line").alias("p2_line"),
        F.expr(f"if({_FIRST}, p.text, null)").alias("opened_by"),
        *[F.expr(sql).alias(name) for name, sql in _reads().items()])


def _reads() -> dict[str, str]:
    with_paren = "concat(text, if(n.kind = 'open', n.text, ''))"
    probe = f"if(lang = '{PHP}' AND n2.kind = 'str', concat({with_paren}, n2.text), {with_paren})"
    free, leaf, inner = {}, {}, {}
    for name in STRUCT_LANGS:
        f, a, i = _sources_split(name)
        free[name], leaf[name] = matches(probe, f), matches("text", a)
        if name == PHP:
            inner[name] = matches("text", i)
    object_key = f"coalesce(lang = '{JS}' AND n.text = ':' AND p.text IN ('{{', ','), false)"
    sanitizer = lang_case({name: matches(with_paren, pats) for name, pats in SANITIZERS.items()})
    return {
        "src": f"""CASE WHEN NOT has_src THEN 0
            WHEN kind = 'name' THEN CASE WHEN {lang_case(free)} THEN 1 WHEN {lang_case(leaf)} THEN 2 ELSE 0 END
            WHEN kind = 'str' THEN if(coalesce({lang_case(inner)}, false), 1, 0) ELSE 0 END""",
        "names": f"if(has_src AND NOT {object_key}, {_use_names()}, null)",
        "san": f"if(has_src AND kind = 'name', {sanitizer}, false)",
    }


# ------------------------------------------------------------ chains and calls
_CONNECTED = r"^(?:\\.|->|::|\\?\\.|\\?->)"
# A bracket closed right after it opened lies on the outer level and opens nothing.
_FIRST = "(p.kind IN ('open', 'bof') AND kind <> 'close')"


def _flags() -> dict[str, str]:
    brace_langs = f"lang IN ('{JS}', '{PHP}', '{JAVA}', '{C}', '{CPP}')"
    new = "startswith(text, 'new ')"
    c_like = f"lang IN ('{C}', '{CPP}')"
    typed = f"({c_like} OR lang = '{JAVA}') AND p.kind IN ('name', 'generic')"
    ends_js = f"""(lang = '{JS}' AND n.line > line + newlines
        AND kind IN ('name', 'str', 'num', 'regex', 'close')
        AND (n.kind IN ('name', 'kw', 'str', 'num') OR n.text = '{{'))
        AND NOT n.text RLIKE '^(?:\\\\.|\\\\?\\\\.)' AND n.text NOT IN ('instanceof', 'in', 'of')"""
    return {
        "first": _FIRST,
        # A token that continues the chain of the one before it.
        "chain_start": f"""CASE
            WHEN kind = 'close' THEN false
            WHEN kind = 'bof' OR {_FIRST} THEN true
            WHEN kind = 'open' AND text IN ('(', '[')
                 AND (p.kind IN ('name', 'generic') OR (p.kind = 'close' AND p.text IN (')', ']'))
                      OR (p.kind = 'str' AND text = '['))
                 AND NOT (lang = '{PY}' AND level = 0 AND line > p.end_line) THEN false
            WHEN kind = 'generic' AND p.kind = 'name' THEN false
            WHEN kind = 'name' AND text RLIKE '{_CONNECTED}' THEN false
            ELSE true END""",
        "paren": "kind = 'open' AND text = '('",
        "is_new": new,
        # Read at a chain start: what follows declares instead of calling.
        "declares": f"""p.text IN ('def', 'class', 'function', 'fn', 'func', 'interface', 'struct', 'enum', 'union')
            OR (p.text = '*' AND p2.text = 'function')
            OR ({c_like} AND p.text IN ('*', '&') AND p2.kind IN ('name', 'kw')
                AND (p3.kind IN ('sep', 'bof', 'name', 'kw') OR p3.text IN ('{{', '}}')))""",
        "typed": f"{typed} AND NOT {new}",
        "body_after": f"{brace_langs} AND n.text = '{{'",
        "parameters": f"""{_FIRST} AND p.text = '('
            AND (p2.text IN ('function', 'fn') OR p3.text IN ('function', 'fn', 'def'))""",
        "last_in_group": "kind NOT IN ('open', 'bof') AND (n IS NULL OR n.kind IN ('close', 'sep'))",
        "ends_line": f"kind NOT IN ('open', 'bof') AND lang = '{PY}' AND level = 0 AND n.line > line + newlines",
        "ends_js_line": ends_js,
        "before_comma": f"kind NOT IN ('open', 'bof') AND lang <> '{PY}' AND n.kind = 'comma'",
        # Read at the chain before an assignment.
        "plain_name": r"kind = 'name' AND text RLIKE '^[$]*[\\w$\\x{80}-\\x{10FFFF}]+$'",
        "a_name": "kind = 'name'",
        "annotates": f"""p.text = ':' AND p2.kind = 'name' AND (
            (lang = '{PY}' AND level = 0 AND (p2.line > p3.end_line OR p3.kind = 'bof'))
            OR (lang = '{JS}' AND p3.text IN ('const', 'let', 'var')))""",
        "dereferenced": f"{c_like} AND p.text = '*' AND NOT coalesce(p2.kind IN ('name', 'kw') OR p2.text = '*', false)",
        "unpacked": f"lang = '{PY}' AND p.text = ','",
        "augmented": "kind = 'assign' AND text <> '='",
        "has_target": f"kind = 'assign' AND p.kind IN ('name', 'close') AND NOT (lang = '{PY}' AND level > 0)",
        "before_paren": "n.text = '('",
        # A string with code in it starts before a brace and ends with the last brace.
        "opens_str": f"kind = 'str' AND n.text = '{{' AND lang IN ('{JS}', '{PY}')",
        "closes_str": "kind = 'close' AND length(text) > 1 AND NOT coalesce(n.text = '{' AND n.kind = 'open', false)",
        "after_bracket": "kind = 'assign' AND p.text = ']'",
    }


#: Flags travel as bits of one number, as each column of a token is copied by each window and sort.
_BIT = {name: 1 << i for i, name in enumerate(_flags())}


def _is(name: str, of: str = "") -> str:
    """SQL of a flag of a token, or of the token that a struct tells of."""
    return f"(({of + '.' if of else ''}flags & {_BIT[name]}) <> 0)"


def _chains(rows: DataFrame) -> DataFrame:
    """Calls, chain facts, and statement ends, by windows over one level."""
    rows = rows.withColumn("is_use", (F.col("src") > 0) | (F.coalesce(F.size("names"), F.lit(0)) > 0)).selectExpr(
        "*",
        f"CAST(coalesce(sum(if(san, 1, 0)) OVER ({_FILE} {_BEFORE}), 0) AS INT) AS sans",
        f"CAST(sum(if(is_use, 1, 0)) OVER ({_FILE} {_SO_FAR}) AS INT) AS uses_so_far",
    ).where(f"""kind NOT IN ('op', 'kw', 'comma', 'sep') OR is_use OR (flags & {_BIT['first'] | _BIT['last_in_group']
               | _BIT['ends_line'] | _BIT['ends_js_line'] | _BIT['before_comma']}) <> 0""").drop("san")

    chain = ("named_struct('pos', pos, 'line', line, 'sans', sans, 'flags', flags, 'name_pos', p2_pos,"
             " 'name_line', p2_line)")
    rows = rows.selectExpr(
        "*",
        f"last(if({_is('chain_start')}, {chain}, null), true) OVER ({_LEVEL} {_SO_FAR}) AS c",
        f"last(if({_is('first')}, named_struct('open', opened_by, 'flags', flags), null), true)"
        f" OVER ({_LEVEL} {_SO_FAR}) AS g",
        f"if(kind = 'open', lead(named_struct('pos', pos, 'uses', uses_so_far, 'flags', flags))"
        f" OVER ({_LEVEL}), null) AS m")
    call = f"""({_is('paren')} AND NOT {_is('chain_start')} AND NOT {_is('declares', 'c')}
               AND NOT ({_is('typed', 'c')} AND c.pos = p_pos)
               AND NOT (coalesce({_is('body_after', 'm')}, false) AND NOT {_is('is_new', 'c')}))"""
    rows = rows.selectExpr(
        "*", f"coalesce({call}, false) AS call", f"coalesce({_is('parameters', 'g')}, false) AS in_parameters",
        f"{_is('last_in_group')} OR {_is('ends_line')} OR ({_is('ends_js_line')} AND coalesce(g.open, '') IN ('', '{{'))"
        " AS ends_stmt",
    ).withColumn("cleans", F.expr("call AND sans > c.sans")).drop("g", "sans", "opened_by", "p2_pos", "p2_line")

    rows = rows.selectExpr(
        "*",
        f"CAST(sum(if(call, 1, 0)) OVER ({_LEVEL} {_SO_FAR}) AS INT) AS calls_so_far",
        f"CAST(sum(if(cleans, 1, 0)) OVER ({_LEVEL} {_SO_FAR}) AS INT) AS cleans_so_far",
        f"if({_is('closes_str')}, last(if({_is('opens_str')}, pos, null), true) OVER ({_LEVEL} {_SO_FAR}), null) AS string_at",
        f"if(kind = 'close', lag(if(call, named_struct('pos', pos, 'cleans', cleans), null)) OVER ({_LEVEL}), null)"
        " AS opened")

    # A chain's calls are those counted before the next chain on its level begins.
    done = "named_struct('calls', calls_so_far, 'cleans', cleans_so_far)"
    end = ("named_struct('pos', pos, 'uses', uses_so_far, 'chain', c.pos, 'call_open', opened.pos,"
           " 'string', string_at)")
    rows = rows.selectExpr(
        "*",
        f"if({_is('chain_start')}, coalesce(lead(if({_is('chain_start')}, {done}, null)) IGNORE NULLS OVER ({_LEVEL}),"
        f" last({done}) OVER ({_LEVEL} {_ALL})), null) AS d",
        f"lead(if(ends_stmt OR {_is('before_comma')}, {end}, null)) IGNORE NULLS OVER ({_LEVEL}) AS e",
        f"lead(if(ends_stmt, {end}, null)) IGNORE NULLS OVER ({_LEVEL}) AS es",
        f"if(kind = 'assign', lag(c) OVER ({_LEVEL}), null) AS l")
    rows = rows.selectExpr(
        "*",
        f"if({_is('chain_start')}, d.calls - calls_so_far, 0) AS chain_calls",
        f"if({_is('chain_start')}, d.cleans - cleans_so_far, 0) AS chain_cleans",
        "coalesce(opened.cleans, false) AS closes_clean", f"{_KEPT} AS kept",
    ).where("kept OR chain_calls <> 0 OR chain_cleans <> 0 OR closes_clean")
    # What is read of a token from here on; the rest is not carried into the next sort.
    return rows.selectExpr(
        "file_id", "lang", "has_src", "pos", "kind", "line", "unit", "pieces", "flags", "n_pos", "n_literal", "p_pos", "src",
        "names", "is_use", "uses_so_far", "call", "in_parameters", "chain_calls", "chain_cleans", "closes_clean", "kept",
        "if(call, struct(c.pos, c.line), null) AS c", "if(call, m, null) AS m", f"if({_is('has_target')}, e, null) AS e",
        "if(kind IN ('echo', 'include'), es, null) AS es", f"if({_is('has_target')}, l, null) AS l")


#: Tokens that start a file or may state a fact.
_KEPT = f"(kind IN ('bof', 'echo', 'include') OR call OR is_use OR {_is('has_target')})"


def _depths(rows: DataFrame) -> DataFrame:
    """How many callee spans and sanitizer spans lie around each token."""
    return rows.selectExpr(
        "*",
        f"CAST(sum(chain_calls - if(call, 1, 0)) OVER ({_FILE} {_SO_FAR}) AS INT) AS cover",
        f"CAST(sum(chain_cleans) OVER ({_FILE} {_SO_FAR})"
        f" - coalesce(sum(if(closes_clean, 1, 0)) OVER ({_FILE} {_BEFORE}), 0) AS INT) AS clean").where("kept")


# --------------------------------------------------------------- one row per file
def _definition() -> str:
    """Assignment fact, or null where the token assigns nothing.

    An annotated name (``x: int = 1``) and a declared array (``char b[8] = ...``)
    are plain variables; a dereference or a tuple is not."""
    annotates = _is("annotates", "l")
    simple = f"""({annotates}
        OR (lang IN ('{C}', '{CPP}', '{JAVA}') AND {_is('a_name', 'l')} AND {_is('typed', 'l')} AND {_is('after_bracket')})
        OR ({_is('plain_name', 'l')} AND l.pos = p_pos AND NOT {_is('dereferenced', 'l')} AND NOT {_is('unpacked', 'l')}))"""
    return f"""if({_is('has_target')} AND l IS NOT NULL AND NOT in_parameters,
        named_struct(
            'start', if({annotates}, l.name_pos, l.pos),
            'line', if({annotates}, l.name_line, l.line),
            'pos', pos,
            'name_pos', if({annotates}, l.name_pos, l.pos),
            'simple', coalesce({simple}, false),
            'reads_lhs', {_is('augmented')},
            'rhs', n_pos,
            'end', e.pos,
            'literal', coalesce(n_literal > 0 AND (e.pos = n_pos OR e.string = n_pos), false),
            'literal_kind', if(n_literal = 1, 'str', 'num'),
            'call_open', if(e.chain = n_pos, e.call_open, null),
            'uses_lo', uses_so_far, 'uses_hi', e.uses, 'cover', cover, 'clean', clean), null)"""


def file_facts(units: DataFrame, all_uses: bool = True) -> DataFrame:
    """One row per file: pieces and position-ordered arrays of facts.  A scan needs
    no uses in files without a taint source, and says so by ``all_uses``."""
    rows = _depths(_chains(_neighbours(located_tokens(units, all_uses))))
    call = """if(call, named_struct('start', c.pos, 'open', pos, 'close', m.pos, 'line', c.line,
        'uses_lo', uses_so_far, 'uses_hi', m.uses, 'cover', cover, 'clean', clean), null)"""
    stmt = """if(kind IN ('echo', 'include'), named_struct('start', pos, 'kind', kind, 'end', es.pos, 'line', line,
        'uses_lo', uses_so_far, 'uses_hi', es.uses, 'cover', cover, 'clean', clean), null)"""
    # An anchored source counts outside receivers; at the start of a chain its own
    # calls do not count as cover (``$_GET['x']->f()``), for an exact name only if
    # the chain is that one call (``input()``).
    own = f"CASE WHEN src <> 2 OR NOT {_is('chain_start')} THEN 0 WHEN lang = '{PHP}' OR (chain_calls = 1 AND {_is('before_paren')}) " \
          "THEN chain_calls ELSE 0 END"
    use = f"""if(is_use, named_struct('pos', pos, 'names', coalesce(names, CAST(array() AS ARRAY<STRING>)),
        'src', src, 'cover', cover, 'leaf_cover', cover - {own}, 'clean', clean), null)"""
    return (rows.groupBy("file_id")
            .agg(F.first("lang").alias("lang"), F.first("has_src").alias("has_src"),
                 # One row has them.  ``first`` would copy the array for each token of the file.
                 F.get(F.collect_list("unit"), F.lit(0)).alias("unit"), F.get(F.collect_list("pieces"), F.lit(0)).alias("pieces"),
                 F.max("uses_so_far").alias("n_uses"),
                 F.sort_array(F.collect_list(F.expr(call))).alias("calls"),
                 F.sort_array(F.collect_list(F.expr(_definition()))).alias("defs"),
                 F.sort_array(F.collect_list(F.expr(stmt))).alias("stmts"),
                 F.sort_array(F.collect_list(F.expr(use))).alias("uses"))
            .select("file_id", "lang", "has_src", "unit.*", "pieces", "n_uses", "calls", "defs", "stmts", "uses"))
