"""The corpus of the rule queries covers the whole catalogue."""

import __spark_entry__ as entry

from taintlake.rules.catalog import RULES
from workloads import catalogue


def test_every_rule_has_a_finding():
    assert {r[-1] for r in catalogue.expected()} == {r.rule_id for r in RULES}


def test_lines_hold_their_snippets():
    for _, _, text, hits in catalogue.FILES:
        lines = text.split("\n")
        for line, _, snippet, *_ in hits:
            assert snippet in lines[line - 1]


def test_queries_are_registered_with_sql():
    assert {"rule_findings", "stream_lines"} <= set(entry.queries()) & set(entry.oracle_sql())
