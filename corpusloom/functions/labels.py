"""Column functions over list labels: parsing, normalizing and classifying. No Python UDFs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the label vocabularies.
NOT_APPLICABLE_TOKENS = ("NOTAPPLICABLE", "NA", "NONE")
AGGREGATE_TOKENS = ("ALLCOUNTRIES", "ALLREGIONS", "ALLSUBREGIONS", "GLOBAL", "WORLDWIDE")
UNCLEAR_TOKENS = ("UNCLEAR", "UNC", "UNCL", "UNK", "UNKN", "UNKNOWN", "UNS", "UNR", "UNL", "UNP", "")
STATE_UNCLEAR_TOKENS = ("UNCLEAR", "UNCLEARREVIEWNEEDED", "UNC", "UNCL", "UNK", "UNKN", "UNKNOWN", "UNS", "UNR", "UNL", "UNP")
GLOBAL_TOKENS = {"region": ("ALLREGIONS",), "subregion": ("ALLSUBREGIONS",), "country": ("ALLCOUNTRIES", "GLOBAL", "WORLDWIDE")}
THREAT_ALIASES = {"housing & urban areas": "housing & urban area"}
REGION_ALIASES = {"all regions": "all region"}
EMPTY_CELLS = ("", "nan", "none", "null", "[]")

_EDGES = r"^\s+|\s+$"


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends (trim takes spaces only)."""
    return F.regexp_replace(x, _EDGES, "")


def _list_or_null(cell: Column) -> Column:
    """A JSON or single-quoted list as an array; null if it is not one."""
    return F.when(strip(cell).startswith("["), F.from_json(cell, "array<string>"))


def _clean(labels: Column, distinct: bool = True) -> Column:
    kept = F.filter(F.transform(F.filter(labels, lambda x: x.isNotNull()), strip), lambda x: x != F.lit(""))
    return F.array_distinct(kept) if distinct else kept


def parse_list_labels(cell: Column) -> Column:
    """A list cell (JSON list, quoted list or text with `;`) as distinct trimmed labels in order; empty
    markers give none."""
    text = F.coalesce(cell, F.lit(""))
    parsed = F.coalesce(_list_or_null(text), F.split(text, ";"))
    return F.when(F.lower(strip(text)).isin(*EMPTY_CELLS), F.array().cast("array<string>")).otherwise(_clean(parsed))


def split_cell(cell: Column) -> Column:
    """The splitter's reading: `;` and `|` separate, quotes at the ends go, repeats stay."""
    text = F.coalesce(cell, F.lit(""))
    bare = F.transform(F.coalesce(_list_or_null(text), F.split(text, r"[;|]")), lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", ""))
    return F.when(F.lower(strip(text)).isin(*EMPTY_CELLS), F.array().cast("array<string>")).otherwise(_clean(bare, distinct=False))


def sample_cell(cell: Column) -> Column:
    """The sampler's reading: a list, or the whole cell as one label."""
    text = F.coalesce(cell, F.lit(""))
    parsed = F.coalesce(_list_or_null(text), F.array(text))
    return F.when(F.lower(strip(text)).isin(*EMPTY_CELLS), F.array().cast("array<string>")).otherwise(_clean(parsed))


def label_set(cell: Column) -> Column:
    """Evaluation's reading: a lower-cased sorted set; `;` does not separate."""
    return F.array_sort(F.array_distinct(F.transform(sample_cell(cell), F.lower)))


def collapse(labels: Column, aliases: Mapping[str, str]) -> Column:
    """Labels with aliases replaced, as a sorted set."""

    def one(x: Column) -> Column:
        out = x
        for old, new in aliases.items():
            out = F.when(x == old, F.lit(new)).otherwise(out)
        return out

    return F.array_sort(F.array_distinct(F.transform(labels, one)))


def token(x: Column) -> Column:
    """Letters only, upper case."""
    return F.upper(F.regexp_replace(x, "[^A-Za-z]", ""))


def country_bucket(x: Column, known: Column) -> Column:
    """not_applicable, aggregate, unclear, mapped (if known) or unresolved."""
    t = token(F.coalesce(x, F.lit("")))
    return (
        F.when(t.isin(*NOT_APPLICABLE_TOKENS), "not_applicable").when(t.isin(*AGGREGATE_TOKENS), "aggregate").when(t.isin(*UNCLEAR_TOKENS), "unclear")
        .when(known, "mapped").otherwise("unresolved")
    )


def region_bucket(x: Column, known: Column) -> Column:
    """As country_bucket, but not-applicable tokens are unresolved."""
    t = token(F.coalesce(x, F.lit("")))
    return F.when(t.isin(*AGGREGATE_TOKENS), "aggregate").when(t.isin(*UNCLEAR_TOKENS), "unclear").when(known, "mapped").otherwise("unresolved")


def level_state(labels: Column, level: str) -> Column:
    """empty, not_applicable, unclear, global, concrete, or mixed of one hierarchy level."""

    def kind(x: Column) -> Column:
        t = token(x)
        return F.when(t.isin(*NOT_APPLICABLE_TOKENS), "not_applicable").when(t.isin(*STATE_UNCLEAR_TOKENS), "unclear").when(t.isin(*GLOBAL_TOKENS[level]), "global").otherwise("concrete")

    kinds = F.array_distinct(F.transform(labels, kind))
    return F.when(F.size(kinds) == 0, "empty").when(F.size(kinds) > 1, "mixed").otherwise(F.get(kinds, F.lit(0)))


def standard_levels(labels: Column, ancestors_all: Column) -> Column:
    """Empty becomes Not Applicable, any unclear label makes Unclear, below an all-regions ancestor Not
    Applicable."""
    unclear = F.exists(labels, lambda x: token(x).isin(*STATE_UNCLEAR_TOKENS))
    return F.when(ancestors_all | (F.size(labels) == 0), F.array(F.lit("Not Applicable"))).when(unclear, F.array(F.lit("Unclear"))).otherwise(labels)


def ordered_vocabulary(labels: Column, vocabulary: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """The vocabulary's labels that are there, in its order; an unknown one raises."""
    out = {x.lower() for x in exclude}
    unknown = F.filter(labels, lambda x: ~x.isin(*vocabulary) & ~F.lower(x).isin(*(out or {"\0"})))
    held = F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.array_contains(labels, v))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown labels: "), F.array_join(unknown, ", ")))).otherwise(held)


def screening_label(cell: Column) -> Column:
    """ELIGIBLE or NOT_ELIGIBLE of the variants; others upper-cased; empty if missing."""
    raw = F.regexp_replace(F.lower(F.coalesce(F.get(sample_cell(cell), F.lit(0)), F.lit(""))), "[- ]", "_")
    return F.when(raw == "eligible", "ELIGIBLE").when(raw.isin("not_eligible", "noteligible", "ineligible"), "NOT_ELIGIBLE").otherwise(F.upper(raw))


def exactly(labels: Column, only: str) -> Column:
    """Whether the list is that one label."""
    return (F.size(labels) == 1) & (F.get(labels, F.lit(0)) == only)


def blank_if_only(labels: Column, only: str = "Not Applicable") -> Column:
    """Null for a list of that one label; mixed lists stay."""
    return F.when(exactly(labels, only), F.lit(None)).otherwise(labels)


def truthy(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes")


def country_code(x: Column, codes: Mapping[str, str], aliases: Mapping[str, str]) -> Column:
    """Alias, then three letters as they are, then name to code (also without what is in parentheses or
    after a comma), else lower-cased text."""
    text = strip(F.lower(F.coalesce(x, F.lit(""))))
    names = F.create_map(*[F.lit(v) for kv in codes.items() for v in (kv[0].lower(), kv[1])])
    also = F.create_map(*[F.lit(v) for kv in aliases.items() for v in (kv[0].lower(), kv[1])]) if aliases else None
    bare, head = strip(F.regexp_replace(text, r"\s*\([^)]*\)", "")), strip(F.regexp_replace(text, ",.*$", ""))
    found = [*([F.try_element_at(also, text)] if also is not None else []), F.when(text.rlike("^[a-z]{3}$"), F.upper(text)), *[F.try_element_at(names, t) for t in (text, bare, head)]]
    return F.coalesce(*found, text)
