"""User rules: validated, then treated like the built-in ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taintlake.rules.catalog import CONFIDENCE_RANK, RULE_KINDS, SEVERITY_RANK, Rule
from taintlake.schemas import RULE


def merge_rules(base: list[Rule], extra: DataFrame) -> list[Rule]:
    """Append a user rule table of any length.  Rules become literals of the plan:
    they are the scan's configuration, and do not grow with the data."""
    have = set(extra.columns)
    typed = extra.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                           for f in RULE])
    rows = typed.collect()
    out, offset = list(base), max((r.rule_ord for r in base), default=-1) + 1
    known = {r.rule_id for r in base}
    for i, row in enumerate(sorted(rows, key=lambda r: (r.rule_ord is None, r.rule_ord or 0, r.rule_id or ""))):
        fields = {k: v for k, v in row.asDict().items() if v is not None}
        fields["rule_ord"] = offset + i
        rule = Rule(**{**_DEFAULTS, **fields})
        _check(rule, known)
        known.add(rule.rule_id)
        out.append(rule)
    _check_patterns(out[len(base):], extra.sparkSession)
    return out


_DEFAULTS = dict(engine="config", kind="line", cwe="", severity="Medium", score=5.0, category="Custom",
                 confidence="Medium", languages=[], sink_patterns=[], args_pattern=None, args_must_match=None,
                 lhs_name_pattern=None, requires_taint=False, recommendation="", explanation="")


def _check(rule: Rule, known: set[str]) -> None:
    if rule.rule_id in known:
        raise ValueError(f"rule {rule.rule_id!r} exists already")
    if rule.kind not in RULE_KINDS:
        raise ValueError(f"rule {rule.rule_id!r}: unknown kind {rule.kind!r}")
    if (rule.kind == "line") == (rule.engine == "struct"):
        raise ValueError(f"rule {rule.rule_id!r}: kind {rule.kind!r} does not fit engine {rule.engine!r}")
    if rule.severity not in SEVERITY_RANK or rule.confidence not in CONFIDENCE_RANK:
        raise ValueError(f"rule {rule.rule_id!r}: unknown severity or confidence")
    if rule.engine in ("config", "secrets") and rule.requires_taint:
        raise ValueError(f"rule {rule.rule_id!r}: taint is tracked by the struct and fallback engines only")


def _check_patterns(rules: list[Rule], spark: SparkSession) -> None:
    """Ask Spark to compile all patterns at once; only a bad one is looked for."""
    named = [(r.rule_id, p) for r in rules for p in [*r.sink_patterns, r.args_pattern, r.args_must_match, r.lhs_name_pattern]
             if p is not None]

    def compiles(part: list[tuple[str, str]]) -> Exception | None:
        try:
            spark.range(1).select(F.array(*[F.lit("").rlike(p) for _, p in part])).collect()
        except Exception as error:
            return error
        return None

    while named and (error := compiles(named)):
        if len(named) == 1:
            raise ValueError(f"rule {named[0][0]!r}: pattern {named[0][1]!r} does not compile") from error
        half = len(named) // 2
        named = named[:half] if compiles(named[:half]) else named[half:]
