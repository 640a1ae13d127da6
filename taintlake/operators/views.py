"""Fact tables, one row per fact, over the per-file facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taintlake.operators import detect, facts
from taintlake.operators.taint import last_definition


def tokens(units: DataFrame) -> DataFrame:
    rows = facts.located_tokens(units).where("kind <> 'bof'")
    return rows.select("file_id", "lang", "pos", "kind", "text", "line", "level")


def brackets(units: DataFrame) -> DataFrame:
    """Matching pairs; ``close_pos`` is null where a bracket stays open."""
    rows = facts.located_tokens(units).where("kind IN ('open', 'close')")
    over = "PARTITION BY file_id, level ORDER BY pos"
    return (rows.selectExpr("file_id", "kind", "pos AS open_pos", f"lead(pos) OVER ({over}) AS close_pos", "level")
            .where("kind = 'open'").drop("kind"))


def calls(facts_: DataFrame) -> DataFrame:
    """Calls, and statements that act like them.  Numbers leave a file's row by one explode;
    source text is cut out behind it, where Spark compiles the cuts, and of calls only."""
    item = lambda x, *more: F.struct(x["start"].alias("start"), x["line"].alias("line"), *more)
    from_call = F.transform("calls", lambda c: item(c, c["open"].alias("open"), c["close"].alias("close"), F.lit(None).cast("string").alias("kind")))
    from_stmt = F.transform("stmts", lambda s: item(s, (s["start"] + 1).alias("open"), s["end"].alias("close"), s["kind"].alias("kind")))
    rows = facts_.select("file_id", "path", "lang", "unit_no", "line_offset", "pieces", F.explode(F.concat(from_call, from_stmt)).alias("c"))
    rows = rows.select("file_id", "path", "lang", "unit_no", "line_offset", "pieces", "c.*")
    callee = F.when(F.col("kind").isNull(), detect._cut(F.col("start"), F.col("open"))).otherwise(detect._statement_name(F.col("kind"), F.col("start")))
    return rows.select("file_id", "path", "lang", "unit_no", F.col("start").alias("start_pos"), F.col("open").alias("open_pos"), F.col("close").alias("close_pos"),
                       (F.col("line") + F.col("line_offset")).alias("line"), callee.alias("callee"), detect._cut(F.col("open"), F.col("close")).alias("args"))


def defs(facts_: DataFrame) -> DataFrame:
    rows = facts_.select(
        "file_id", "path", "lang", "unit_no", "line_offset", F.explode(F.transform("defs", lambda d: F.struct(
            d["start"].alias("def_pos"), d["line"].alias("line"), d["simple"].alias("is_simple"),
            F.when(d["simple"], detect._bare_name(d["name_pos"])).alias("var"),
            F.trim(detect._cut(d["start"], d["pos"] - 1)).alias("lhs_text"),
            detect._cut(d["rhs"], d["end"]).alias("rhs_text"), d["literal"].alias("is_literal")))).alias("d"))
    return rows.select("file_id", "path", "lang", "unit_no", "d.def_pos",
                       (F.col("d.line") + F.col("line_offset")).alias("line"), "d.var", "d.lhs_text", "d.rhs_text",
                       "d.is_simple", "d.is_literal")


def _contexts():
    """Variables read by each right side and by arguments, outside nested receivers.
    A context is evaluated where its statement starts, so a definition is not
    visible to its own right side."""
    def ctx(kind: str, x):
        inside = F.filter(F.slice("uses", x["uses_lo"] + 1, F.greatest(
            F.coalesce(x["uses_hi"], F.col("n_uses")) - x["uses_lo"], F.lit(0))), lambda u: u["cover"] == x["cover"])
        return F.struct(F.lit(kind).alias("ctx_kind"), x["start"].alias("pos"), x["line"].alias("line"),
                        F.array_distinct(F.flatten(F.transform(inside, lambda u: u["names"]))).alias("names"))
    return F.concat(F.transform("defs", lambda d: ctx("def", d)), F.transform("calls", lambda c: ctx("call", c)),
                    F.transform("stmts", lambda s: ctx("stmt", s)))


def uses(facts_: DataFrame) -> DataFrame:
    """Variables read, with the context that reads them."""
    rows = facts_.select("file_id", "path", "line_offset", F.explode(_contexts()).alias("x"))
    return rows.select("file_id", "path", "x.ctx_kind", F.col("x.pos").alias("eval_pos"),
                       (F.col("x.line") + F.col("line_offset")).alias("line"), F.explode("x.names").alias("var"))


def reached_uses(facts_: DataFrame) -> DataFrame:
    """Uses with the line of the definition that reaches them.  Both leave a file's
    row by one explode, so the facts are made once and nothing is joined."""
    plain = F.transform(F.filter("defs", lambda d: d["simple"]), lambda d: F.struct(
        F.lit(None).cast("string").alias("ctx_kind"), d["start"].alias("pos"), d["line"].alias("line"),
        F.array(detect._bare_name(d["name_pos"])).alias("names")))
    rows = facts_.select("file_id", "path", "line_offset", F.explode(F.concat(plain, _contexts())).alias("x"))
    rows = rows.select("file_id", "path", "x.ctx_kind", (F.col("x.line") + F.col("line_offset")).alias("line"),
                       F.col("x.pos").alias("_at"), F.explode("x.names").alias("var"))
    # At equal positions the use comes first, as in ``reaching_defs``.
    is_def = F.col("ctx_kind").isNull()
    both = rows.withColumn("_k", is_def.cast("int")).withColumn(
        "_def", F.when(is_def, F.struct(F.col("_at").alias("pos"), F.col("line").alias("line"))))
    return last_definition(both, ("file_id", "var")).select(
        "file_id", "path", "ctx_kind", "line", "var", F.col("_at").alias("eval_pos"),
        F.col("_def.pos").alias("def_pos"), F.col("_def.line").alias("def_line"))


def tainted_defs(facts_: DataFrame) -> DataFrame:
    """Plain variables that an assignment makes tainted.  Calls and other assignments change
    no variable and are asked for by nobody here, so they are no events."""
    rows = detect.with_hits(facts_.where("has_src").withColumn("events", detect.define_events()), lambda e: e["kind"] == "define")
    rows = rows.select("path", "line_offset", F.explode(detect.at_hits(lambda i: F.element_at("events", i))).alias("e"))
    return rows.select("path", (F.col("e.line") + F.col("line_offset")).alias("line"), F.col("e.var").alias("var"))
