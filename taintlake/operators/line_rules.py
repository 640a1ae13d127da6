"""Line detectors: configuration, credential shapes and the fallback rules.

All of it is row-local.  A whole-text prefilter drops most files before a line
is cut, and only lines that meet a rule leave the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taintlake.functions import text
from taintlake.functions.patterns import FLAGS, match_any, matches, one_of, prefilter
from taintlake.operators import html
from taintlake.operators.project import engine_of
from taintlake.operators.taint import tainted_names
from taintlake.rules.catalog import CONFIDENCE_RANK, FALLBACK_SOURCES, STRUCT_LANGS, Rule

ENGINE_ORDER = {"struct": 0, "fallback": 0, "secrets": 1, "config": 2}


def _case(rule: Rule) -> str:
    # Credential shapes are case-sensitive by their published definition.
    return "(?U)" if rule.engine == "secrets" else FLAGS


def _any(col: Column, rules: list[Rule]) -> Column:
    loose = [p for r in rules if r.engine != "secrets" for p in r.sink_patterns]
    exact = [p for r in rules if r.engine == "secrets" for p in r.sink_patterns]
    cond = match_any(col, loose)
    if exact:
        cond = cond | col.rlike("(?U)" + "|".join(f"(?:{p})" for p in exact))
    return cond


def _prefilter(rules: list[Rule]) -> Column:
    return prefilter([p for r in rules for p in r.sink_patterns])


def line_hits(src_files: DataFrame, rules: list[Rule], best_only: bool = False) -> DataFrame:
    """Hits of line rules that need no taint, for ``src_files`` with ``lang``.
    A user rule may name languages; an empty list means all files.  With
    ``best_only`` a line has one hit per finding name: the one that
    ``report.dedupe`` would keep."""
    rules = [r for r in rules if not r.requires_taint]
    rows = src_files.where(_prefilter(rules))
    rows = rows.select("path", "lang", F.explode(_lines_with(rules)).alias("x")).select("path", "lang", "x.*")

    def cond(r: Rule) -> str:
        c = matches("text", r.sink_patterns, _case(r))
        return f"{c} AND {one_of('lang', r.languages)}" if r.languages else c

    def best(r: Rule) -> str:
        better = [cond(o) for o in rules if o.name == r.name and _merit(o) < _merit(r)]
        return " AND ".join([cond(r), *(f"NOT ({c})" for c in better)])

    return _explode_hits(rows, rules, best if best_only else cond)


def _merit(rule: Rule) -> tuple[int, int, int]:
    """Order of preference among hits on one line."""
    return -CONFIDENCE_RANK.get(rule.confidence, 0), ENGINE_ORDER[rule.engine], rule.rule_ord


def _numbered(lines: Column) -> Column:
    return F.transform(lines, lambda line, i: F.struct((i + 1).alias("index"), (i + 1).alias("line"), line.alias("text")))


def _lines_with(rules: list[Rule]) -> Column:
    """Lines that meet one of the rules; null for a text that cannot have any."""
    return F.when(_prefilter(rules), F.filter(_numbered(text.split_lines(F.col("content"))),
                                              lambda x: _any(x["text"], rules)))


def _tainted_lines_with(rules: list[Rule]) -> Column:
    """Lines that meet a rule and name a variable of the file's tainted set."""
    def touched(names: Column, lines: Column) -> Column:
        return F.filter(_numbered(lines), lambda x: _any(x["text"], rules) & F.arrays_overlap(
            F.regexp_extract_all(x["text"], F.lit(r"(?U)\w+"), F.lit(0)), names))

    # One-element transforms bind lines and names, so that each is computed once.
    of_lines = F.flatten(F.transform(F.array(text.split_lines(F.col("content"))), lambda lines: F.flatten(F.transform(
        F.array(tainted_names(lines)), lambda names: touched(names, lines)))))
    return F.when(prefilter(FALLBACK_SOURCES) & _prefilter(rules), of_lines)


def local_hits(files: DataFrame, rules: list[Rule], uri_rules: list[Rule]) -> DataFrame:
    """Hits of all engines that look at one row alone, in one read: line rules,
    tainted lines of files without a parser, and attributes with a script address.
    What may hit leaves the row by one explode; rules are then conditions on it."""
    engine = engine_of(F.col("lang"))
    everywhere = [r for r in rules if r.engine in ("secrets", "config")]
    fallback = [r for r in rules if r.engine == "fallback"]
    free, tainted = [r for r in fallback if not r.requires_taint], [r for r in fallback if r.requires_taint]
    parsed = one_of("lang", [*STRUCT_LANGS, "html"])

    def found(kind: str, items: Column) -> Column:
        none = F.array().cast("array<struct<kind:string,index:int,line:int,text:string>>")
        return F.coalesce(F.transform(items, lambda x: F.struct(
            F.lit(kind).alias("kind"), x["index"], x["line"], x["text"])), none)

    parts = []
    if everywhere or free:
        of_rest = F.when(engine == "fallback", _lines_with(free + everywhere))
        parts.append(found("line", of_rest.otherwise(_lines_with(everywhere)) if everywhere else of_rest))
    if tainted:
        parts.append(found("tainted", F.when(engine == "fallback", _tainted_lines_with(tainted))))
    if uri_rules:
        parts.append(found("attr", F.when(engine == "html", html.uri_attrs(F.col("content")).cast(
            "array<struct<index:int,line:int,text:string>>"))))
    rows = files.select("path", "lang", F.explode(F.concat(*parts)).alias("x")).select("path", "lang", "x.*")

    def cond(r: Rule) -> str:
        if r.engine == "struct":
            return "kind = 'attr'"
        c = [f"kind = '{'tainted' if r.requires_taint else 'line'}'", matches("text", r.sink_patterns, _case(r))]
        if r.engine == "fallback":
            c.append(f"NOT {parsed}")
        if r.languages:
            c.append(one_of("lang", r.languages))
        return " AND ".join(c)

    return _explode_hits(rows, everywhere + fallback + uri_rules, cond)


def _explode_hits(rows: DataFrame, rules: list[Rule], cond) -> DataFrame:
    hit = F.expr("array_compact(array(" + ", ".join(
        f"if({cond(r)}, named_struct('rule_ord', {r.rule_ord}, 'engine_ord', {ENGINE_ORDER[r.engine]}), null)"
        for r in rules) + "))")
    return (rows.withColumn("h", F.explode(hit))
            .select("path", "lang", "line", F.col("h.rule_ord").alias("rule_ord"),
                    text.place(F.col("h.engine_ord"), F.lit(0), F.col("index"), F.col("h.rule_ord")),
                    text.snippet(F.col("text")).alias("snippet")))


def match_rules(rows: DataFrame, col: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows with one ``rule_id`` per pattern found in a text column.  Patterns are
    literals in batches, so each row is read once per batch and no join is made."""
    out = None
    for i in range(0, len(rules), 100):
        batch = rules[i:i + 100]
        hit = F.array_compact(F.array(*[F.when(match_any(F.col(col), [p]), F.lit(r)) for r, p in batch]))
        part = rows.where(match_any(F.col(col), [p for _, p in batch])).withColumn("rule_id", F.explode(hit))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no rules given")
    return out
