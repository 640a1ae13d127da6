"""Regex helpers shared by all detectors.

Patterns are used as literals, so each is compiled once per task.  ``(?iU)``
gives case-insensitive search with Unicode word boundaries.
"""

from __future__ import annotations

import re
import re._parser as _re_parser
import warnings
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

FLAGS = "(?iU)"


def alternation(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def match_any(col: Column, patterns: Iterable[str]) -> Column:
    """True where one of the patterns occurs; one literal regex for the list."""
    patterns = list(patterns)
    return col.rlike(FLAGS + alternation(patterns)) if patterns else F.lit(False)


def quoted(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(sql: str, patterns: Iterable[str], flags: str = FLAGS) -> str:
    """``match_any`` as SQL text.  Conditions over whole rule lists are written as
    text, since a call into the JVM per operator is slow for the driver."""
    patterns = list(patterns)
    return f"({sql} RLIKE {quoted(flags + alternation(patterns))})" if patterns else "false"


def one_of(sql: str, values: Iterable[str]) -> str:
    return f"({sql} IN ({', '.join(quoted(v) for v in values)}))"


def lang_case(per_lang: dict[str, str], default: str = "false", lang: str = "lang") -> str:
    """CASE over the language; only the branch of the row's language runs."""
    return f"(CASE {lang} " + " ".join(
        f"WHEN {quoted(name)} THEN {sql}" for name, sql in per_lang.items()) + f" ELSE {default} END)"


def widen(pattern: str) -> str | None:
    """The pattern without anchors at its ends and without a final look-ahead."""
    p = re.sub(r"\(\?![^()]*\)$", "", pattern)
    p = re.sub(r"^\^", "", p)
    p = re.sub(r"(?<!\\)\$$", "", p)
    return p or None


def required_words(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern holds at least one;
    None if the pattern demands no literal of two characters or more."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _re_parser.parse(pattern)
    except Exception:
        return None
    found = _words_of(tree)
    return found if found and min(map(len, found)) >= 2 else None


def _rarity(word: str) -> int:
    return len(word) + 2 * sum(not c.isalnum() for c in word) if len(word) > 1 else 0


def _words_of(tree) -> frozenset[str] | None:
    best: frozenset[str] | None = None
    run = ""

    def offer(words):
        nonlocal best
        if words and (best is None or min(map(_rarity, words)) > min(map(_rarity, best))):
            best = words

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if name == "AT":  # anchors and word boundaries take no characters
            continue
        offer(frozenset([run]) if run else None)
        run = ""
        if name == "SUBPATTERN":
            offer(_words_of(arg[3]))
        elif name == "BRANCH":
            branches = [_words_of(b) for b in arg[1]]
            offer(frozenset().union(*branches) if all(branches) else None)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            offer(_words_of(arg[2]))
    offer(frozenset([run]) if run else None)
    return best


def required_pairs(pattern: str) -> frozenset[tuple[str, str]] | None:
    """``required_words``, each with another literal (or ``""``) that a match which holds
    it as demanded holds as well."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _re_parser.parse(pattern)
    except Exception:
        return None
    found = _pairs_of(tree)
    return found if found and min(len(w) for w, _ in found) >= 2 else None


def _pairs_of(tree) -> frozenset[tuple[str, str]] | None:
    """Alternatives of one part of a sequence, each with the best literal beside it."""
    offers: list[frozenset[tuple[str, str]]] = []
    run = ""
    for op, arg in [*tree, ("END", None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        if name == "AT":  # anchors and word boundaries take no characters
            continue
        found = None
        if name == "SUBPATTERN":
            found = _pairs_of(arg[3])
        elif name == "BRANCH":
            branches = [_pairs_of(b) for b in arg[1]]
            found = frozenset().union(*branches) if all(branches) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            found = _pairs_of(arg[2])
        offers += [x for x in (frozenset([(run, "")]) if run else None, found) if x]
        run = ""
    if not offers:
        return None
    best = max(range(len(offers)), key=lambda i: min(_rarity(w) for w, _ in offers[i]))
    # What else the sequence demands, as far as it is one literal.
    beside = [w for i, o in enumerate(offers) if i != best and len(o) == 1 for w, _ in o]
    return frozenset((w, max([also, *beside], key=_rarity)) for w, also in offers[best])


#: Patterns that this module and the JVM read alike: literals, escaped signs, plain classes,
#: groups, alternatives and repeats.  Nothing in them depends on what is around a match.
_PLAIN = re.compile(r"(?:[^\\\[\](){}^$.|*+?]|\\[^A-Za-z0-9\s]|\\[sdw]|\[[^\[\]&^\\]+\]|\((?!\?)|\(\?:|\)|\||[*+?]|\{\d+(?:,\d*)?\})*")


def longest_match(pattern: str, run: int, never: str) -> int | None:
    """How many characters a match has at most, in a text without ``run`` blanks in a row;
    None if that cannot be told or if the pattern names the character ``never``."""
    if not _PLAIN.fullmatch(pattern) or never in pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = _re_parser.parse(pattern)
    except Exception:
        return None
    width = _width_of(tree, run, ord(never))
    return width if width is not None and width <= 1000 else None


def _width_of(tree, run: int, never: int) -> int | None:
    total = 0
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            n = 1
        elif name == "IN":
            n = None if any(str(o) == "NEGATE" or (str(o) == "RANGE" and a[0] <= never <= a[1]) for o, a in arg) else 1
        elif name == "SUBPATTERN":
            n = _width_of(arg[3], run, never)
        elif name == "BRANCH":
            widths = [_width_of(b, run, never) for b in arg[1]]
            n = None if None in widths else max(widths)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            n = _width_of(arg[2], run, never)
            if n is not None and arg[1] != _re_parser.MAXREPEAT:
                n *= arg[1]
            elif not _is_blank(arg[2]):
                n = None
            else:
                n = max(run, arg[0])
        else:
            n = None
        if n is None:
            return None
        total += n
    return total


def _is_blank(tree) -> bool:
    """One character, and that one blank."""
    if len(tree) != 1:
        return False
    items = tree[0][1] if str(tree[0][0]) == "IN" else [tree[0]]
    return all((str(o) == "LITERAL" and chr(a).isspace()) or (str(o) == "CATEGORY" and str(a) == "CATEGORY_SPACE") for o, a in items)


# Letters that fold to ASCII letters under Unicode case rules; a text with one of
# them is passed on, so that comparing lower-case text stays a necessary condition.
_FOLDING = ["\u017f", "\u0131", "\u0307", "\u212a"]


def may_match(per_lang: dict[str, list[str]], content: str = "content") -> str:
    """SQL condition on a whole text, necessary for any of its language's patterns.

    Substring tests on the text in lower case, many times cheaper than an
    alternation of regexes.  The one-element transform binds the lower-case text
    so that it is computed once for all tests.
    """
    tests = {name: _any_word(patterns) for name, patterns in per_lang.items()}
    inner = tests[""] if set(tests) == {""} else lang_case(tests)
    return f"coalesce(element_at(transform(array(lower({content})), t -> {inner}), 1), false)"


def _any_word(patterns: list[str]) -> str:
    sets = [required_words(p) for p in patterns]
    if any(w is None for w in sets):
        return "true"
    words = frozenset().union(*sets)
    # A word that contains another one is found whenever that one is.
    least = sorted(w for w in words if not any(o != w and o in w for o in words))
    if not least:
        return "false"
    return "(" + " OR ".join(f"contains(t, {quoted(w)})" for w in least + _FOLDING) + ")"


def prefilter(patterns: Iterable[str], content: str = "content") -> Column:
    return F.expr(may_match({"": list(patterns)}, content))
