"""Rule-based attribute extraction (A1-A10): rules are data, turned into one SQL expression.

A ``Source`` says where to look, an ``Attribute`` what to take there. Segment
patterns are case-sensitive, predicates and values are not. The result is one
``array<struct<name,value>>`` column in the order the rules find things.

A rule set makes an expression of some hundred functions. As SQL text it reaches the
JVM in one call; built from ``Column`` objects it would take as many calls as it has
functions, which costs more than running it on a small table.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "array<struct<name:string,value:string>>"
NO_PAIRS = f"cast(array() AS {PAIRS})"
NO_VALUES = "cast(array() AS array<string>)"


@dataclass(frozen=True)
class Attribute:
    """One named value to look for in a segment.

    name       attribute name; None for a rule that only runs its children
    contains   literal that every match of ``value`` holds; without it in the segment
               the patterns are not tried, which saves most of their cost
    predicate  must be found in the segment, when given
    value      its first non-empty group is the value
    multiple   take every match of ``value``, not only the first (A6)
    concat     join all non-empty groups by a space (A7)
    explicit   constant value, given when the predicate holds (A8)
    children   rules run on the same segment after each match (A9)
    """

    name: str | None
    predicate: str | None = None
    value: str | None = None
    multiple: bool = False
    concat: bool = False
    explicit: str | None = None
    children: tuple[Attribute, ...] = ()
    contains: str | None = None


@dataclass(frozen=True)
class Source:
    """Where attributes are looked for: each match of ``segment``, or the whole text (A2, A4).

    In a segment the first attribute that succeeds ends the search, unless
    ``all_attributes`` is set (A3). The whole text always tries all attributes.
    """

    attributes: tuple[Attribute, ...] = field(default=())
    segment: str | None = None
    all_attributes: bool = False


def _quote(text: str) -> str:
    """A raw SQL literal; ``${`` is taken apart, as Spark would look up a variable there."""
    if "${" in text:
        before, after = text.split("${", 1)
        return f"concat({_quote(before + '$')}, {_quote('{' + after)})"
    for mark in ("'", '"'):
        if mark not in text:
            return f"r{mark}{text}{mark}"
    return "concat(" + ', "\'", '.join(_quote(part) for part in text.split("'")) + ")"


def _group_count(pattern: str) -> int:
    bare = re.sub(r"\[[^\]]*\]", "", re.sub(r"\\.", "", pattern))
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", bare))


_numbers = itertools.count()


def _bind(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    name = f"x{next(_numbers)}"
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


def _each(items: str, body: Callable[[str], str]) -> str:
    name = f"x{next(_numbers)}"
    return f"transform({items}, {name} -> {body(name)})"


def _pair(name: str | None, value: str) -> str:
    title = "cast(NULL AS string)" if name is None else _quote(name)
    return f"named_struct('name', {title}, 'value', {value})"


def _found(pattern: str, segment: str) -> str:
    return f"{segment} RLIKE {_quote('(?i)' + pattern)}"


def _values(rule: Attribute, segment: str) -> str:
    """Values of a rule in a segment as ``array<string>``; unmatched groups count as empty."""
    groups = range(1, _group_count(rule.value) + 1)
    if not groups:
        return NO_VALUES
    pattern = _quote("(?i)" + rule.value)

    def combine(found: list[str]) -> str:
        known = ", ".join(f"nullif({v}, '')" for v in found)
        return f"nullif(concat_ws(' ', {known}), '')" if rule.concat else f"coalesce({known})"

    if not rule.multiple:
        first = combine([f"regexp_extract({segment}, {pattern}, {g})" for g in groups])
        values = f"array_compact(array({first}))"
    else:
        scans = [f"regexp_extract_all({segment}, {pattern}, {g})" for g in groups]
        if len(scans) == 1:
            values = f"filter({scans[0]}, v -> v != '')"
        else:
            # Each group is one more scan, so first look whether there is anything to scan for.
            columns = [f"m.`{i}`" for i in range(len(scans))]
            zipped = f"arrays_zip({', '.join(scans)})"
            values = (
                f"CASE WHEN {_found(rule.value, segment)} "
                f"THEN array_compact(transform({zipped}, m -> {combine(columns)})) ELSE {NO_VALUES} END"
            )
    if rule.contains is not None:
        return f"CASE WHEN contains({segment}, {_quote(rule.contains)}) THEN {values} ELSE {NO_VALUES} END"
    return values


def _may_fail_with_output(rule: Attribute) -> bool:
    """True when the rule can give pairs without counting as matched: a constant does so."""
    return rule.explicit is not None or any(map(_may_fail_with_output, rule.children))


def _never_succeeds(rule: Attribute) -> bool:
    return rule.value is None and all(map(_never_succeeds, rule.children))


def _result(pairs: str, matched: str) -> str:
    return f"named_struct('pairs', {pairs}, 'matched', {matched})"


def _children(rule: Attribute, segment: str) -> str:
    found = ", ".join(_match(child, segment) for child in rule.children)
    return _bind(
        f"array({found})",
        lambda results: _result(
            f"flatten(transform({results}, c -> c.pairs))", f"exists({results}, c -> c.matched)"
        ),
    )


def _match(rule: Attribute, segment: str) -> str:
    """``struct<pairs,matched>`` of one rule on one segment."""

    def pairs_of(values: str) -> str:
        if not rule.children:
            return _each(values, lambda v: _pair(rule.name, v))
        return "flatten({})".format(
            _each(values, lambda v: f"concat(array({_pair(rule.name, v)}), {_children(rule, segment)}.pairs)")
        )

    if rule.value is not None:
        body = _bind(
            _values(rule, segment),
            lambda vs: _result(f"cast({pairs_of(vs)} AS {PAIRS})", f"size({vs}) > 0"),
        )
    elif rule.children:
        body = _children(rule, segment)
    else:
        body = _result(NO_PAIRS, "false")
    if rule.explicit is not None:
        constant = f"cast(array({_pair(rule.name, _quote(rule.explicit))}) AS {PAIRS})"
        body = _bind(body, lambda b: _result(f"concat({constant}, {b}.pairs)", f"{b}.matched"))
    if rule.predicate is not None:
        body = (
            f"CASE WHEN {_found(rule.predicate, segment)} THEN {body} "
            f"ELSE {_result(NO_PAIRS, 'false')} END"
        )
    return body


def _pairs(rule: Attribute, segment: str) -> str:
    """Only the pairs of a rule; shorter than ``_match`` where the outcome is not asked for."""
    if rule.explicit is None and rule.value is not None and not rule.children:
        found = _each(_values(rule, segment), lambda v: _pair(rule.name, v))
    elif rule.explicit is not None and rule.value is None and not rule.children:
        found = f"array({_pair(rule.name, _quote(rule.explicit))})"
    else:
        return f"{_match(rule, segment)}.pairs"
    found = f"cast({found} AS {PAIRS})"
    if rule.predicate is None:
        return found
    return f"CASE WHEN {_found(rule.predicate, segment)} THEN {found} ELSE {NO_PAIRS} END"


def _all_attributes(rules: Sequence[Attribute], segment: str) -> str:
    return f"concat({', '.join(_pairs(rule, segment) for rule in rules)})"


def _first_success(rules: Sequence[Attribute], segment: str) -> str:
    """Pairs of the rules up to and with the first that matches.

    ``coalesce`` stops at its first non-null argument, so later rules are not even
    evaluated once one has matched.
    """
    if not rules:
        return NO_PAIRS
    if not any(map(_may_fail_with_output, rules)):
        tries = [f"get(filter(array({_pairs(rule, segment)}), p -> size(p) > 0), 0)" for rule in rules]
        return f"coalesce({', '.join(tries)}, {NO_PAIRS})"
    first, rest = rules[0], rules[1:]
    if _never_succeeds(first):
        return f"concat({_pairs(first, segment)}, {_first_success(rest, segment)})"
    return _bind(
        _match(first, segment),
        lambda m: f"CASE WHEN {m}.matched THEN {m}.pairs "
        f"ELSE concat({m}.pairs, {_first_success(rest, segment)}) END",
    )


def _source(source: Source, text: str) -> str:
    if not source.attributes:
        return NO_PAIRS
    if source.segment is None:
        return _all_attributes(source.attributes, text)
    search = _all_attributes if source.all_attributes else _first_success
    segments = f"regexp_extract_all({text}, {_quote(source.segment)}, 0)"
    return f"flatten({_each(segments, lambda s: search(source.attributes, s))})"


def extract_attributes(text: str, sources: Sequence[Source]) -> Column:
    """All pairs of all sources, in rule order; NULL for NULL text (A1).

    ``text`` is a column name or an SQL expression; it is evaluated once.
    """
    body = _bind(text, lambda t: f"concat({', '.join(_source(s, t) for s in sources)})")
    return F.expr(body)
