"""Ordered token rules as one CASE expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from periodica.functions.text import contains_any


@dataclass(frozen=True)
class Rule:
    """A label and the substrings that select it.

    ``text`` tokens are looked for in code and name together, ``code`` tokens in the code only;
    ``equals`` and ``prefixes`` compare the whole text.
    """

    label: str
    text: tuple[str, ...] = ()
    code: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()

    def condition(self, text: Column, code: Column) -> Column:
        hit = contains_any(text, self.text) | contains_any(code, self.code)
        for value in self.equals:
            hit = hit | (text == F.lit(value))
        for prefix in self.prefixes:
            hit = hit | text.startswith(prefix)
        return hit


def first_match(rules: Sequence[Rule], text: Column, code: Column, default: str) -> Column:
    """Label of the first rule that applies; CASE stops at the first hit."""
    out = F.lit(default)
    for rule in reversed(rules):
        out = F.when(rule.condition(text, code), F.lit(rule.label)).otherwise(out)
    return out


def lookup(key: Column, table: Mapping[str, str], default: Column) -> Column:
    """Exact lookup in a small literal map."""
    if not table:
        return default
    literals = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*literals), key), default)
