"""Geography labels against a hierarchy of region, subregion and country: standardization, path audit, buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import labels as L

#: Labels that stand for what is missing.
NOT_APPLICABLE, UNCLEAR, REVIEW = "Not Applicable", "Unclear", "Unclear - Review needed"
LEVELS = ("region", "subregion", "country")
NON_CONCRETE = ("empty", "not_applicable", "unclear", "global")


def _array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def standardize(df: DataFrame, columns: Mapping[str, str], others: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(df with standard lists, audit). columns: level -> list column, for region, subregion and country; others are
    list columns in which only empty lists change.

    An empty list becomes Not Applicable; a list with an unclear label becomes Unclear; of a record whose region is
    exactly All Regions the descendants become Not Applicable if neither is concrete. The audit has column, rule and
    changed_values, one row per rule that changed something."""
    own = {columns[level]: level for level in LEVELS}
    first, rules = {}, []
    for c in [*own, *others]:
        v = F.coalesce(F.col(c), _array())
        unclear = F.exists(v, lambda x: F.lower(L.strip(x)) == "unclear") if c in own else F.lit(False)
        first[c] = F.when(F.size(v) == 0, _array(NOT_APPLICABLE)).when(unclear, _array(UNCLEAR)).otherwise(v)
        rules += [(c, "empty_to_not_applicable", F.size(v) == 0), (c, "contains_unclear_to_unclear", unclear & _differs(v, _array(UNCLEAR)))]
    marked = df.withColumns({f"_before_{i}": F.col(c) for i, c in enumerate(first)})
    out = marked.withColumns(first)
    below = [columns["subregion"], columns["country"]]
    calm = L.level_state(F.col(below[0]), "subregion").isin(*NON_CONCRETE) & L.level_state(F.col(below[1]), "country").isin(*NON_CONCRETE)
    everywhere = (F.col(columns["region"]) == _array("All Regions")) & calm
    flags = out.withColumn("_all", everywhere)
    n = [F.count_if(rule).alias(f"r{i}") for i, (_, _, rule) in enumerate(_rewired(rules, list(first)))]
    last = [F.count_if(F.col("_all") & _differs(F.col(c), _array(NOT_APPLICABLE))).alias(f"d{i}") for i, c in enumerate(below)]
    counted = flags.agg(*n, *last)
    named = [(c, rule, f"r{i}") for i, (c, rule, _) in enumerate(rules)] + [(c, "all_regions_descendant_to_not_applicable", f"d{i}") for i, c in enumerate(below)]
    audit = counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(rule).alias("rule"), F.col(at).alias("changed_values")) for c, rule, at in named]))).where("changed_values > 0")
    done = flags.withColumns({c: F.when(F.col("_all"), _array(NOT_APPLICABLE)).otherwise(F.col(c)) for c in below})
    return done.select(*[F.col(f"`{c}`") for c in df.columns]), audit


def _rewired(rules: list, columns: list[str]) -> list:
    """The rules' conditions over the values as they were before."""
    out = []
    for c, rule, _ in rules:
        v = F.coalesce(F.col(f"_before_{columns.index(c)}"), _array())
        empty = F.size(v) == 0
        unclear = F.exists(v, lambda x: F.lower(L.strip(x)) == "unclear") & _differs(v, _array(UNCLEAR))
        out.append((c, rule, empty if rule.startswith("empty") else unclear))
    return out


def _lookup(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])


def path_audit(df: DataFrame, columns: Mapping[str, str], hierarchy: Sequence[tuple[str, str, str]]) -> DataFrame:
    """df with status, primary_reason, reasons and warnings of each record's paths.

    hierarchy: (region, subregion, country code), a few hundred, literals of the plan; a subregion has one region and a
    code one path. status is pass_complete, pass_partial, pass_region_only, global, no_geography or review; a record
    with a reason against it is to be reviewed."""
    parent, region_of, sub_of = {}, {}, {}
    for region, sub, code in hierarchy:
        token = "".join(c for c in code if c.isascii() and c.isalpha()).upper()
        if parent.setdefault(sub, region) != region or (token and (region_of.setdefault(token, region), sub_of.setdefault(token, sub)) != (region, sub)):
            raise ValueError(f"several paths lead to {sub!r} or {code!r}")
    regions = sorted({r for r, _, _ in hierarchy})
    parents, code_region, code_sub = _lookup(parent), _lookup(region_of), _lookup(sub_of)

    def concrete(level: str) -> Column:
        special = {*L.NOT_APPLICABLE_TOKENS, *L.STATE_UNCLEAR_TOKENS, *L.GLOBAL_TOKENS[level]}
        return F.filter(F.coalesce(F.col(columns[level]), _array()), lambda x: ~L.token(x).isin(*sorted(special)))

    work = df.withColumns({f"_{level}": L.level_state(F.coalesce(F.col(columns[level]), _array()), level) for level in LEVELS})
    work = work.withColumns({"_regions": concrete("region"), "_subs": concrete("subregion"), "_codes": F.transform(concrete("country"), L.token)})
    r, s, c = F.col("_region"), F.col("_subregion"), F.col("_country")
    low = s.isin("concrete", "mixed") | c.isin("concrete", "mixed")
    up, both = r == "concrete", (r == "concrete") & (s == "concrete")
    full = both & (c == "concrete")
    known = lambda x, m: F.try_element_at(m, x)
    outside = lambda held, x: ~F.array_contains(held, x)
    tests = [
        ("mixed_special_and_concrete_or_global", (r == "mixed") | (s == "mixed") | (c == "mixed")),
        ("all_regions_with_concrete_descendant", (r == "global") & low),
        ("unknown_region_label", up & F.exists("_regions", lambda x: ~x.isin(*regions))),
        ("unknown_subregion_label", both & F.exists("_subs", lambda x: known(x, parents).isNull())),
        ("subregion_parent_missing", both & F.exists("_subs", lambda x: F.coalesce(outside(F.col("_regions"), known(x, parents)), F.lit(False)))),
        ("unknown_country_label", full & F.exists("_codes", lambda x: known(x, code_region).isNull())),
        ("country_path_missing", full & F.exists("_codes", lambda x: F.coalesce(outside(F.col("_regions"), known(x, code_region)) | outside(F.col("_subs"), known(x, code_sub)), F.lit(False)))),
        ("country_present_subregion_non_concrete", up & ~s.isin("concrete") & (c == "concrete")),
        ("concrete_descendant_without_concrete_region", ~r.isin("global", "concrete") & low),
        ("no_resolvable_geography", ~r.isin("global", "concrete") & ~low & ~((r == "not_applicable") & (s == "not_applicable") & (c == "not_applicable"))),
    ]
    work = work.withColumn("reasons", F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests])))
    passed = [
        ("global", "all_regions_descendants_not_applicable", r == "global"), ("pass_complete", "complete_paths_valid", full), ("pass_partial", "region_subregion_valid_country_non_concrete", both),
        ("pass_region_only", "region_valid_descendants_non_concrete", up),
    ]
    status, reason = F.lit("no_geography"), F.lit("all_levels_not_applicable")
    for name, why, test in reversed(passed):
        status, reason = F.when(test, name).otherwise(status), F.when(test, why).otherwise(reason)
    bad = F.size("reasons") > 0
    work = work.withColumns({"status": F.when(bad, "review").otherwise(status), "primary_reason": F.when(bad, F.get("reasons", F.lit(0))).otherwise(reason)})
    lonely = F.array_except("_regions", F.transform("_subs", lambda x: known(x, parents)))
    bare = F.array_except("_subs", F.transform("_codes", lambda x: known(x, code_sub)))
    noted = [("region_without_listed_subregion", lonely), ("subregion_without_listed_country", bare)]
    warnings = F.when(F.col("status") == "pass_complete", F.array_compact(F.array(*[F.when(F.size(held) > 0, F.lit(name)) for name, held in noted]))).otherwise(_array())
    return work.withColumn("warnings", warnings).drop("_region", "_subregion", "_country", "_regions", "_subs", "_codes")


def summarize_audit(audited: DataFrame) -> DataFrame:
    """status, primary_reason, n_publications, in the order of status, the most frequent first."""
    counts = audited.groupBy("status", "primary_reason").agg(F.count(F.lit(1)).alias("n_publications"))
    return counts.orderBy("status", F.desc("n_publications"), "primary_reason")


def audit_labels(audited: DataFrame, columns: Mapping[str, str], suffix: str = "_audit") -> DataFrame:
    """audited with a second column per level: the labels, or the review label where the record is to be reviewed."""
    review = F.col("status") == "review"
    return audited.withColumns({c + suffix: F.when(review, _array(REVIEW)).otherwise(F.col(c)) for c in columns.values()})


def bucket_audit(places: DataFrame, id_col: str, column: str, known: Sequence[str], labels: str | None = None, names: bool = False) -> DataFrame:
    """metric and n: records_total, records_without_geography, mentions:<bucket> and unresolved:<token>.

    known: country codes, or with names=True names of a level, a small dimension. With labels, a mention is a place and a
    label of a record, so records without labels have none."""
    held = places.select(id_col, F.coalesce(F.col(column), _array()).alias("g"), *([F.col(labels).alias("l")] if labels else []))
    totals = held.agg(F.count_distinct(id_col).alias("t"), F.count_if(F.size("g") == 0).alias("w"))
    totals = totals.select(F.inline(F.array(F.struct(F.lit("records_total").alias("metric"), F.col("t").alias("n")), F.struct(F.lit("records_without_geography").alias("metric"), F.col("w").alias("n")))))
    mentions = held.select(id_col, F.explode("g").alias("x"), *(["l"] if labels else []))
    if labels:
        mentions = mentions.select("x", F.explode("l").alias("l")).where(F.trim("l") != "")
    if names:
        bucket = L.region_bucket(F.col("x"), L.strip(F.col("x")).isin(*known))
    else:
        bucket = L.country_bucket(F.col("x"), L.token(F.col("x")).isin(*known))
    counts = mentions.groupBy(bucket.alias("b"), F.when(bucket == "unresolved", L.strip(F.col("x"))).alias("u")).agg(F.count(F.lit(1)).alias("n"))
    by_bucket = counts.groupBy(F.concat(F.lit("mentions:"), "b").alias("metric")).agg(F.sum("n").alias("n"))
    return totals.union(by_bucket).union(counts.where("u is not null").select(F.concat(F.lit("unresolved:"), "u"), "n"))


def country_names(labels: Column, names: Mapping[str, str]) -> Column:
    """Codes as names, without ` (the)` at the end; what is no code stays as it is. names is a small dimension."""
    known = _lookup({_token(k): v.removesuffix(" (the)") for k, v in names.items() if _token(k)})
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(known, L.token(x)), x))


def _token(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isalpha()).upper()


def unmapped(df: DataFrame, labels: str, names: Mapping[str, str]) -> DataFrame:
    """token and n of the labels that are no code."""
    codes = sorted({_token(k) for k in names} - {""})
    return df.select(F.explode(labels).alias("token")).where(~L.token(F.col("token")).isin(*codes)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
