"""Taint as graph reachability and as-of joins.

``tainted_names`` is the row-local closure that a scan uses: its graph is one
file's own lines.  ``taint_closure`` is the relational form for graphs of any
size: a semi-naive loop of equi-joins over ``(path, name)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taintlake.functions import text
from taintlake.functions.patterns import match_any
from taintlake.plans.storage import Workspace, saved
from taintlake.rules.catalog import FALLBACK_SOURCES

_ASSIGNED = r"(?U)(\$?\w+)\s*="
_ASSIGNMENT = r"(?U)(\$?\w+)\s*=\s*(.+)"
_WORD = r"(?U)\w+"
_NO_CODE = ("//", "#", "<", "/*", "*")


def _seed_names(line: Column) -> Column:
    """Names that a line with a source makes tainted."""
    target = F.replace(F.regexp_extract(line, _ASSIGNED, 1), F.lit("$"), F.lit(""))
    return F.filter(F.array(target, F.when(line.contains("argv"), "argv")), lambda n: n.isNotNull() & (n != ""))


def _is_code(line: Column) -> Column:
    skip = line == ""
    for mark in _NO_CODE:
        skip = skip | line.startswith(mark)
    return ~skip


def _target(line: Column) -> Column:
    return F.replace(F.regexp_extract(line, _ASSIGNMENT, 1), F.lit("$"), F.lit(""))


def _read_words(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_extract(line, _ASSIGNMENT, 2), F.lit(_WORD), F.lit(0)))


def tainted_names(lines: Column) -> Column:
    """Closure within one file: seeds, then passes over its assignments until no
    name is added.  Passes alternate in direction, so both ascending and
    descending chains settle at once."""
    seeds = F.array_distinct(F.flatten(F.transform(
        F.filter(lines, lambda x: match_any(x, FALLBACK_SOURCES)), _seed_names)))
    edges = F.filter(
        F.transform(F.filter(F.transform(lines, text.strip), lambda x: x.contains("=") & _is_code(x)),
                    lambda x: F.struct(_target(x).alias("dst"), _read_words(x).alias("src"))),
        lambda e: e["dst"] != "")

    def sweep(names: Column, es: Column) -> Column:
        return F.aggregate(es, names, lambda acc, e: F.when(
            ~F.array_contains(acc, e["dst"]) & F.arrays_overlap(e["src"], acc), F.array_append(acc, e["dst"])
        ).otherwise(acc))

    def closure(es: Column) -> Column:
        def once(state: Column, i: Column) -> Column:
            def grown(names: Column) -> Column:
                return F.struct(names.alias("names"), (F.size(names) == F.size(state["names"])).alias("done"))
            both = sweep(sweep(state["names"], es), F.reverse(es))
            return F.when(state["done"], state).otherwise(F.element_at(F.transform(F.array(both), grown), 1))
        start = F.struct(seeds.alias("names"), (F.size(seeds) == 0).alias("done"))
        return F.aggregate(F.sequence(F.lit(0), F.size(es)), start, once, lambda s: s["names"])

    return F.element_at(F.transform(F.array(edges), closure), 1)


# ----------------------------------------------------------- relational closure
def taint_seeds(src_lines: DataFrame) -> DataFrame:
    return (src_lines.where(match_any(F.col("line"), FALLBACK_SOURCES))
            .select("path", F.explode(_seed_names(F.col("line"))).alias("var")).distinct())


def taint_edges(src_lines: DataFrame) -> DataFrame:
    """Edges ``src -> dst`` from every word on the right of an assignment.  Names
    are whole words, so mention of a name is equality of words."""
    line = F.col("line")
    return (src_lines.where(line.contains("=")).select("path", text.strip(line).alias("line"))
            .where(_is_code(line))
            .select("path", _target(line).alias("dst"), F.explode(_read_words(line)).alias("src"))
            .where("dst <> ''").select("path", "src", "dst").distinct())


def taint_closure(seeds: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All ``(path, var, depth)`` reachable from the seeds, depth being the least
    number of edges.

    Edges are placed once, by (path, src), and known names by (path, var).  A round
    moves only its newest names: to their edges, and what they reach to its place, where
    known names are removed.  Each round ends in a written table, so its lineage is cut, a
    lost executor costs one round at most and the next join sees real sizes.  Keys are
    (path, name): one large path spreads over its names.  Tables of rounds are merged now
    and then, and all are dropped in the end; the result is one table in the shared folder.
    """
    work = Workspace(seeds.sparkSession, "closure")
    read = seeds.sparkSession.table
    try:
        # Edges out of a name that is its own target only add what is known.
        edges = work.save(edges.where("src <> dst").select("path", "src", "dst"), ("path", "src"))
        parts = [work.save(seeds.select("path", "var").distinct().withColumn("depth", F.lit(0)), _NAME)]
        depth = 0
        while True:
            depth += 1
            if max_rounds is not None and depth > max_rounds:
                raise RuntimeError(f"closure not reached after {max_rounds} rounds")
            newest = work.save(_next_names(read(parts[-1]), read(edges), [read(p) for p in parts], depth), _NAME)
            if read(newest).isEmpty():
                break
            parts.append(newest)
            if len(parts) > _PARTS:  # the newest stays apart, as the next round starts from it
                merged = work.save(_union([read(p) for p in parts[:-1]]), _NAME)
                for old in parts[:-1]:
                    work.drop(old)
                parts = [merged, newest]
        return saved(_union([read(p) for p in parts]), "reached")
    finally:
        work.close()


_NAME = ("path", "var")
_PARTS = 8


def _next_names(newest: DataFrame, edges: DataFrame, known: list[DataFrame], depth: int) -> DataFrame:
    step = (newest.select("path", F.col("var").alias("src")).join(edges, ["path", "src"])
            .select("path", F.col("dst").alias("var")).distinct())
    for part in known:
        step = step.join(part.select("path", "var"), ["path", "var"], "left_anti")
    return step.withColumn("depth", F.lit(depth))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def tainted_lines(src_lines: DataFrame, closure: DataFrame) -> DataFrame:
    """Lines that mention a tainted name, case-sensitively."""
    words = src_lines.withColumn("var", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("line"), F.lit(_WORD), F.lit(0)))))
    hit = words.join(closure.select("path", "var"), ["path", "var"], "left_semi")
    return hit.select(*src_lines.columns).distinct()


# --------------------------------------------------------------- as-of, intervals
def reaching_defs(defs: DataFrame, uses: DataFrame, keys: tuple[str, ...] = ("file_id", "var")) -> DataFrame:
    """The last definition before each use, per file and variable.

    ``defs``: keys, ``def_pos``; ``uses``: keys, ``eval_pos`` and more.  Both are
    laid on one axis and a running ``last`` picks the definition, so there is one
    shuffle and no inequality join.
    """
    # At equal positions the use comes first: a definition is not visible to its own right side.
    d = defs.select(*keys, F.col("def_pos").alias("_at"), F.lit(1).alias("_k"), F.col("def_pos").alias("_def"))
    u = uses.select("*", F.col("eval_pos").alias("_at"), F.lit(0).alias("_k"))
    return last_definition(d.unionByName(u, allowMissingColumns=True), keys).withColumnRenamed("_def", "def_pos").select(
        *uses.columns, "def_pos")


def last_definition(both: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Uses (``_k`` 0) with the ``_def`` of the last definition (``_k`` 1) before
    them on the axis ``_at``; uses without one are left out."""
    over = f"PARTITION BY {', '.join(keys)} ORDER BY _at, _k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return both.withColumn("_def", F.expr(f"last(_def, true) OVER ({over})")).where("_k = 0 AND _def IS NOT NULL")
