"""Structural detectors: facts and taint to rule hits.

``file_facts`` leaves one row per file.  Taint is a gen/kill pass in document
order over the file's own facts; a loop of joins would need as many rounds as the
longest chain of assignments in the whole corpus.  Rules are literal conditions
over the exploded candidates.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from taintlake.functions import text
from taintlake.functions.patterns import lang_case, matches, may_match, one_of, quoted, widen
from taintlake.operators.facts import may_have_source
from taintlake.rules.catalog import NUMBER_LITERAL_LANGS, PHP, PLACEHOLDERS, REDOS_SHAPES, STRUCT_LANGS, Rule

CALL_KINDS = ("call_taint", "call_always", "missing_flag")
# PHP statements that act as sinks without being calls.
_PHP_STATEMENTS = [r"<\?=", r"\b(?:echo|print|include|require)"]


def struct_rules(rules: Iterable[Rule]) -> list[Rule]:
    return [r for r in rules if r.engine == "struct"]


def rules_for(rules: Iterable[Rule], lang: str) -> list[Rule]:
    return [r for r in rules if lang in r.languages]


def _patterns(rules: Iterable[Rule], lang: str, kinds: Iterable[str], field: str = "sink_patterns") -> list[str]:
    out: list[str] = []
    for r in rules_for(rules, lang):
        if r.kind in kinds:
            value = getattr(r, field)
            out += value if isinstance(value, list) else [value]
    return list(dict.fromkeys(p for p in out if p))


def worth_parsing(rules: list[Rule]) -> Column:
    """Necessary condition, checked on the raw text before anything is shuffled:
    some rule that needs no taint may match, or a source and a sink both occur."""
    plain, tainted = {}, {}
    for name in STRUCT_LANGS:
        plain[name] = (_patterns(rules, name, ("call_always", "missing_flag"))
                       + _patterns(rules, name, ("assign_literal", "lhs_random"), "lhs_name_pattern"))
        tainted[name] = _patterns(rules, name, ("call_taint", "assign_taint"))
        if name == PHP and tainted[name]:
            tainted[name] = tainted[name] + _PHP_STATEMENTS
    return F.expr(f"{may_match(plain)} OR ({may_have_source()} AND {may_match(tainted)})")


# ------------------------------------------------------------------- candidates
def _cut(first: Column, last: Column) -> Column:
    """Source text from one position to another, as written."""
    last = F.coalesce(last, F.size("pieces"))
    return F.ltrim(F.array_join(F.slice("pieces", first, F.greatest(last - first + 1, F.lit(0))), ""), F.lit(" \t\f"))


def _bare_name(pos: Column) -> Column:
    return F.regexp_replace(F.element_at("pieces", pos), r"^\s*\$*", "")


def _context(x: Column) -> list[Column]:
    return [x["uses_lo"].alias("uses_lo"), F.coalesce(x["uses_hi"], F.col("n_uses")).alias("uses_hi"),
            x["cover"].alias("cover"), x["clean"].alias("clean")]


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _call_events() -> Column:
    return F.transform("calls", lambda c: F.struct(
        c["start"].alias("start"), F.lit(1).alias("rank"), (-c["open"]).alias("outer_first"),
        F.lit("call").alias("kind"), c["line"].alias("line"), *_context(c),
        _cut(c["start"], c["open"]).alias("callee"), c["open"].alias("from"), c["close"].alias("to"),
        _null("string").alias("var"), F.lit(False).alias("reads_lhs"), _null("string").alias("literal")))


def _statement_name(kind: Column, start: Column) -> Column:
    word = F.lower(F.ltrim(F.element_at("pieces", start), F.lit(" \t\f")))
    return F.when(kind == "include", F.concat(word, F.lit("("))).when(word == "<?=", F.lit("echo")).otherwise(word)


def _statement_events() -> Column:
    def event(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(1).alias("rank"), F.lit(0).alias("outer_first"),
            F.lit("call").alias("kind"), s["line"].alias("line"), *_context(s),
            _statement_name(s["kind"], s["start"]).alias("callee"),
            (s["start"] + 1).alias("from"), s["end"].alias("to"),
            _null("string").alias("var"), F.lit(False).alias("reads_lhs"), _null("string").alias("literal"))

    return F.transform("stmts", event)


def _assign_events() -> Column:
    return F.transform("defs", lambda d: F.struct(
        d["start"].alias("start"), F.lit(0).alias("rank"), F.lit(0).alias("outer_first"),
        F.when(d["simple"], F.lit("define")).otherwise(F.lit("assign")).alias("kind"), d["line"].alias("line"),
        *_context(d),
        F.when(d["call_open"].isNotNull(), _cut(d["rhs"], d["call_open"]))
        .when(~d["simple"], _cut(d["start"], d["pos"] - 1)).alias("callee"),
        d["pos"].alias("from"), d["end"].alias("to"),
        F.when(d["simple"], _bare_name(d["name_pos"])).alias("var"),
        d["reads_lhs"].alias("reads_lhs"),
        F.when(d["simple"] & d["literal"]
               & ((d["literal_kind"] == "str") | F.col("lang").isin(NUMBER_LITERAL_LANGS)),
               _cut(d["rhs"], d["end"])).alias("literal")))


def define_events() -> Column:
    """Assignments to plain variables in document order, without source text: all that sets
    or clears a variable, and what the assignments read."""
    return F.sort_array(F.transform(F.filter("defs", lambda d: d["simple"]), lambda d: F.struct(
        d["start"].alias("start"), F.lit("define").alias("kind"), d["line"].alias("line"), *_context(d),
        _bare_name(d["name_pos"]).alias("var"), d["reads_lhs"].alias("reads_lhs"))))


def _text_of(e: Column) -> Column:
    """Source text of an event's whole node."""
    return _cut(e["start"], e["to"])


def _effects(events: Column, wanted) -> Column:
    """What an event does to a file's tainted names: the plain variable it assigns, whether
    its context holds a source outside a nested sanitizer, and the variables it reads that
    lie neither in a nested sanitizer nor in the receiver of a nested call.  An augmented
    assignment also reads its target."""
    def effect(e: Column) -> Column:
        inside = F.filter(F.slice("uses", e["uses_lo"] + 1, F.greatest(e["uses_hi"] - e["uses_lo"], F.lit(0))),
                          lambda u: u["clean"] == e["clean"])
        source = F.exists(inside, lambda u: (u["src"] == 1) | ((u["src"] == 2) & (u["leaf_cover"] == e["cover"])))
        reads = F.flatten(F.transform(F.filter(inside, lambda u: u["cover"] == e["cover"]), lambda u: u["names"]))
        own = F.when(e["reads_lhs"] & e["var"].isNotNull(), F.array(e["var"])).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(e["kind"] == "define", e["var"]).alias("sets"), (e["kind"] == "define").alias("defines"),
                        wanted(e).alias("wanted"), F.coalesce(source, F.lit(False)).alias("source"), F.concat(reads, own).alias("reads"))
    return F.transform(events, effect)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _flow(files: pa.Array) -> pa.Array:
    """Numbers (from 1) of the wanted events with a tainted context, file by file.  Verdicts
    depend on each other in document order, which built-in functions can only fold over
    arrays that they copy at each step; a set is kept here instead."""
    steps = files.flatten()
    # Columns leave Arrow as a whole, which is many times faster than lists of their rows.
    plain = lambda values: values.to_numpy(zero_copy_only=False).tolist()
    reads = steps.field("reads")
    words, ends = plain(reads.flatten()), np.cumsum(plain(pc.fill_null(pc.list_value_length(reads), 0)), dtype=np.int64).tolist()
    rows = zip(*[plain(steps.field(c)) for c in ("sets", "defines", "wanted", "source")], [0, *ends], ends)
    out = []
    for n in plain(pc.fill_null(pc.list_value_length(files), 0)):
        tainted: set[str] = set()
        hits = []
        for i, (name, defines, wanted, source, lo, hi) in enumerate(islice(rows, n), 1):
            hit = source or (tainted and not tainted.isdisjoint(words[lo:hi]))
            if hit and wanted:
                hits.append(i)
            if defines:
                (tainted.add if hit else tainted.discard)(name)
        out.append(hits)
    return pa.array(out, pa.list_(pa.int32()))


def with_hits(rows: DataFrame, wanted) -> DataFrame:
    """Add ``hits``: indexes (from 1) of the wanted ``events`` whose context is tainted, by
    one pass in document order that is linear in the events.  An assignment to a plain
    variable sets or clears it.  Files without a source have no such event."""
    # Effects are named twice, which keeps their nested lambdas out of the arguments of
    # the Python function: the optimizer can't evaluate them there.
    rows = rows.withColumn("effects", F.when(F.col("has_src"), _effects(F.col("events"), wanted)))
    return rows.withColumn("hits", _flow(F.when(F.size("effects") > 0, F.col("effects")))).drop("effects")


def at_hits(event) -> Column:
    """``event`` of each hit's number.  The size is asked first, as Spark would otherwise
    put the Python function into this expression, where it can't run."""
    return F.when(F.size("hits") > 0, F.transform("hits", event))


def with_events(facts: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add ``events``: the file's assignments and calls in document order.

    With rules, calls that no sink pattern can meet are left out, and files
    without any source keep only what taint-free rules can use."""
    calls, defs = _call_events(), _assign_events()
    if rules is not None:
        callee = lang_case({n: matches("c.callee", [widen(p) or p for p in _patterns(rules, n, CALL_KINDS)])
                            for n in STRUCT_LANGS})
        name = lang_case({n: matches("d.var", _patterns(rules, n, ("assign_literal", "lhs_random"),
                                                        "lhs_name_pattern")) for n in STRUCT_LANGS})
        facts = facts.withColumn("call_events", calls).withColumn("def_events", defs)
        calls = F.expr(f"filter(call_events, c -> {callee})")
        defs = F.expr(f"filter(def_events, d -> has_src OR coalesce({name}, false))")
    events = F.sort_array(F.concat(defs, calls, _statement_events()))
    return facts.withColumn("events", events).drop("call_events", "def_events")


def candidates(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows a rule may hit.  A node appears once as it is and, if its context is
    tainted, once more with ``tainted`` set."""
    rows = with_events(facts, rules)
    needs_taint = any(r.requires_taint for r in rules)
    if needs_taint:
        rows = with_hits(rows, lambda e: e["kind"] != "define")

    def out(e: Column, i: Column, tainted: bool) -> Column:
        return F.struct(
            i.alias("idx"), F.lit(tainted).alias("tainted"), e["kind"].alias("kind"), e["line"].alias("line"),
            e["callee"].alias("callee"), e["var"].alias("var"), e["literal"].alias("literal"),
            F.when(e["kind"] == "call", _cut(e["from"], e["to"])).alias("args"), _text_of(e).alias("text"))

    plain = F.filter(F.transform("events", lambda e, i: F.struct(e.alias("e"), (i + 1).alias("i"))), lambda x:
                     (x["e"]["kind"] == "call") | x["e"]["literal"].isNotNull()
                     | ((x["e"]["kind"] == "define") & x["e"]["callee"].isNotNull()))
    found = F.transform(plain, lambda x: out(x["e"], x["i"], False))
    if needs_taint:
        hits = at_hits(lambda i: out(F.element_at("events", i), i, True))
        found = F.flatten(F.array_compact(F.array(found, hits)))  # each is named once, so it is made once
    rows = rows.select("path", "unit_no", "lang", "out_lang", "line_offset", F.explode(found).alias("x"))
    return rows.select("path", "unit_no", "lang", "out_lang",
                       (F.col("line_offset") + F.col("x.line")).alias("line"),
                       *[F.col(f"x.{c}").alias(c) for c in
                         ("idx", "tainted", "kind", "callee", "var", "literal", "args", "text")])


# ------------------------------------------------------------------------ rules
def looks_like_redos(sql: str) -> str:
    return f"({sql} RLIKE {quoted(REDOS_SHAPES[0])} OR {sql} RLIKE {quoted(REDOS_SHAPES[1])})"


def is_real_literal(sql: str) -> str:
    """A literal long enough to be a credential and no known placeholder."""
    bare = f"regexp_replace({sql}, {quoted('^[\"' + chr(39) + ']+|[\"' + chr(39) + ']+$')}, '')"
    bare = f"lower(trim(BOTH {quoted(text.WHITE_SPACE)} FROM {bare}))"
    return f"(NOT {one_of(bare, PLACEHOLDERS)} AND length({bare}) >= 4)"


def _meets_sink(patterns: list[str]) -> str:
    """Sinks are searched in the callee; one with a look-ahead must also hold in
    the whole call, as the look-ahead asks about its arguments."""
    cond = matches("callee", [p for p in patterns if "(?!" not in p])
    for p in patterns:
        if "(?!" in p:
            cond += f" OR ({matches('callee', [widen(p) or p])} AND {matches('text', [p], '(?iUs)')})"
    return f"({cond})"


def rule_condition(r: Rule) -> str:
    langs = [n for n in STRUCT_LANGS if n in r.languages]
    cond = ["tainted" if r.requires_taint else "NOT tainted", one_of("lang", langs) if langs else "false"]
    if r.kind in CALL_KINDS:
        cond += ["kind = 'call'", _meets_sink(r.sink_patterns)]
        if r.args_pattern:
            cond.append(matches("args", [r.args_pattern]))
        if r.kind == "missing_flag":
            cond.append("NOT " + matches("args", [r.args_must_match]))
        if r.rule_id == "REDOS-1":
            cond.append(looks_like_redos("args"))
    elif r.kind == "assign_taint":
        cond += ["kind = 'assign'", matches("callee", r.sink_patterns)]
    elif r.kind == "assign_literal":
        cond += ["literal IS NOT NULL", matches("var", [r.lhs_name_pattern]), is_real_literal("literal")]
    else:  # lhs_random
        cond += ["kind = 'define'", "callee IS NOT NULL", matches("var", [r.lhs_name_pattern]),
                 matches("callee", r.sink_patterns)]
    return " AND ".join(cond)


def struct_hits(cands: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rule hits ``(path, lang, line, rule_ord, seq, snippet)``."""
    hit = F.expr("array_compact(array(" + ", ".join(
        f"if({rule_condition(r)}, {r.rule_ord}, null)" for r in rules) + "))")
    return (cands.withColumn("rule_ord", F.explode(hit))
            .select("path", F.col("out_lang").alias("lang"), "line", "rule_ord",
                    text.place(F.lit(0), F.col("unit_no"), F.col("idx"), F.col("rule_ord")),
                    text.snippet(F.col("text")).alias("snippet")))
