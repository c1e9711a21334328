"""Rules and policies compiled to Column expressions: group rules, match acceptance, record status."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("in", "not_in", "present", "missing")


def predicate(field: Column, operator: str, values: Sequence[str] = ()) -> Column:
    """in, not_in (the field must be there), present or missing; blank counts as missing. Never null."""
    there = F.coalesce(F.trim(field) != "", F.lit(False))
    if operator == "present":
        return there
    if operator == "missing":
        return ~there
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")
    if not values:
        return F.lit(False) if operator == "in" else there
    among = F.coalesce(field.isin(*values), F.lit(False))
    return among if operator == "in" else there & ~among


def first_rule(rules: Sequence[Mapping], field: Callable[[str], Column], otherwise: Column | str | None = None) -> Column:
    """The group of the first rule whose predicates all hold.

    A rule is {"group": name, "when": [{"field", "op", "values"}]}; without predicates it always holds."""
    out: Column | None = None
    for rule in rules:
        holds = F.lit(True)
        for p in rule.get("when", ()):
            holds = holds & predicate(field(p["field"]), p["op"], p.get("values", ()))
        out = F.when(holds, rule["group"]) if out is None else out.when(holds, rule["group"])
    last = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return last if out is None else out.otherwise(last)


def assign_group(eligible: Column, special: Column, rules: Sequence[Mapping], field: Callable[[str], Column]) -> Column:
    """Null for an ineligible item, the special group where one is set, else the first rule's, else
    unassigned."""
    return F.when(~F.coalesce(eligible, F.lit(False)), F.lit(None).cast("string")).when(special.isNotNull(), special).otherwise(first_rule(rules, field, "unassigned"))


def match_outcome(kind: Column, rank: Column, wanted_rank: Column, confidence: Column, least: int = 90) -> Column:
    """accepted, rank_mismatch, low_confidence, higher_rank, ambiguous or no_match of a name match.

    Exact matches need the rank, fuzzy and variant ones the rank and the confidence. Missing values
    never accept."""
    same = F.coalesce(F.upper(rank) == F.upper(wanted_rank), F.lit(False))
    sure = F.coalesce(confidence >= least, F.lit(False))
    k = F.upper(F.coalesce(kind, F.lit("")))
    near = k.isin("FUZZY", "VARIANT")
    return (
        F.when((k == "EXACT") & same, "accepted").when(near & same & sure, "accepted").when(near & same, "low_confidence").when((k == "EXACT") | near, "rank_mismatch")
        .when(k == "HIGHERRANK", "higher_rank").when(k == "AMBIGUOUS", "ambiguous").otherwise("no_match")
    )


def list_state(labels: Column, outside: Sequence[str], unclear: Sequence[str]) -> Column:
    """missing, outside, unclear, mixed or inside: what kinds of labels a record's list holds."""
    held = F.coalesce(labels, F.array().cast("array<string>"))
    bad, vague = F.exists(held, lambda x: x.isin(*outside)), F.exists(held, lambda x: x.isin(*unclear))
    good = F.exists(held, lambda x: ~x.isin(*outside, *unclear))
    return F.when(F.size(held) == 0, "missing").when(good & (bad | vague), "mixed").when(good, "inside").when(bad & ~vague, "outside").otherwise("unclear")
