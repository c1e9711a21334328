"""Items of records with matches and lineages: nesting, wide record tables, paths, states and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Outcomes of a record's inclusion, in their order.
INCLUSION = (
    "Included: at least one benchmarkable broad group", "Excluded: Not applicable only", "Excluded: Unclear only", "Excluded: mixed Not applicable and Unclear",
    "Excluded: accepted taxon but broad hierarchy unresolved", "Excluded: reported taxon but no accepted benchmarkable match", "Excluded: no taxon item returned",
)
NOT_APPLICABLE_NAMES = ("not applicable", "non applicable")
UNCLEAR_NAMES = ("unclear",)


def gaps(df: DataFrame, keys: Sequence[str], position: str, first: int = 0) -> DataFrame:
    """keys, n, lo, hi of the groups whose positions are not first, first + 1, ... each once."""
    found = df.groupBy(*keys).agg(F.count(position).alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return found.where((F.col("n") > 0) & ((F.col("n") != F.col("d")) | (F.col("lo") != first) | (F.col("hi") != F.col("n") - 1 + first))).drop("d")


def nested(lineage: DataFrame, record: str, item: str, item_fields: Sequence[str], position: str, node_fields: Sequence[str]) -> DataFrame:
    """record and items: per record an array of its items in order, each with its fields and its lineage, an array of
    nodes in order. An item without a node (null position) has an empty lineage. Two groupings, no join."""
    node = F.struct(F.col(position).alias("position"), *node_fields)
    nodes = F.filter(F.array_sort(F.collect_list(F.when(F.col(position).isNotNull(), node))), lambda x: x.isNotNull())
    per = lineage.groupBy(record, item).agg(*[F.first(c, ignorenulls=True).alias(c) for c in item_fields], nodes.alias("lineage"))
    return per.groupBy(record).agg(F.array_sort(F.collect_list(F.struct(item, *item_fields, "lineage"))).alias("items"))


def nested_items(links: DataFrame, lineage: DataFrame, record: str, item: str, item_fields: Sequence[str], position: str, node_fields: Sequence[str]) -> DataFrame:
    """record and items as nested has them, where an item is the same in all records: links holds record and item, lineage the
    items' nodes. Each item is nested once, and its nodes are never rows of records; an item without a row in lineage
    is left out."""
    key = "_item"
    per = nested(lineage.withColumn(key, F.col(item)), key, item, item_fields, position, node_fields).select(F.col(key), F.get("items", F.lit(0)).alias("_i"))
    held = links.select(record, F.col(item).alias("_own")).join(per, F.col("_own") == F.col(key))
    return held.groupBy(record).agg(F.array_sort(F.array_distinct(F.collect_list("_i"))).alias("items"))


def ranked_items(nested_: DataFrame, record: str, rank: str, name: str, ranks: Sequence[str]) -> DataFrame:
    """ranked_names of records that are nested."""
    nodes = F.flatten(F.transform("items", lambda i: i["lineage"]))
    of = lambda r: F.transform(F.filter(nodes, lambda x: (F.upper(x[rank]) == r.upper()) & x[name].isNotNull()), lambda x: x[name])
    return nested_.select(record, *[F.array_distinct(of(r)).alias(r.lower()) for r in ranks])


def ranked_names(lineage: DataFrame, record: str, item: str, position: str, rank: str, name: str, ranks: Sequence[str]) -> DataFrame:
    """record and, for each rank, the distinct names of its items' nodes of that rank in the order of items: the wide
    table of records."""
    out = []
    for r in ranks:
        held = F.array_sort(F.collect_list(F.when(F.upper(rank) == r.upper(), F.struct(item, position, F.col(name).alias("v")))))
        out.append(F.array_distinct(F.transform(held, lambda x: x["v"])).alias(r.lower()))
    return lineage.groupBy(record).agg(*out)


def canonical_path(lineage: Column, ranks: Sequence[str] = ("KINGDOM", "PHYLUM", "CLASS", "ORDER")) -> list[Column]:
    """The names of the ranks in an array of (rank, name): Bacteria and Archaea by their domain, anything with a realm
    as Viruses. Two names of one rank are an error."""

    def at(rank: str) -> Column:
        names = F.array_distinct(F.transform(F.filter(lineage, lambda n: (F.upper(F.trim(n["rank"])) == rank) & (F.trim(n["name"]) != "")), lambda n: F.trim(n["name"])))
        return F.when(F.size(names) > 1, F.raise_error(F.concat(F.lit(f"several names of rank {rank}: "), F.array_join(names, ", ")))).otherwise(F.get(names, F.lit(0)))

    top = F.when(at("DOMAIN").isin("Bacteria", "Archaea"), at("DOMAIN")).when(at("REALM").isNotNull(), F.lit("Viruses")).otherwise(at("KINGDOM"))
    return [(top if r == "KINGDOM" else at(r)).alias(r.lower()) for r in ranks]


def flatten_records(df: DataFrame, key: str, flags: Sequence[str], sets: Sequence[str], split: Sequence[str] = ()) -> DataFrame:
    """One row per key of several records: flags as True (any holds) or empty text, sets as sorted distinct values joined
    by `;`, those in split cut at commas first."""
    whole = lambda c: F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))), ";").alias(c)
    cut = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.collect_set(F.split(F.coalesce(F.col(c), F.lit("")), ","))), lambda x: F.trim(x)), lambda x: x != ""))), ";").alias(c)
    any_of = lambda c: F.when(F.coalesce(F.bool_or(F.col(c)), F.lit(False)), "True").otherwise("").alias(c)
    return df.groupBy(key).agg(*[any_of(c) for c in flags], *[cut(c) if c in split else whole(c) for c in sets])


def accepted_first(df: DataFrame, key: Column, status: str, order: Column, fields: Sequence[str]) -> DataFrame:
    """key and fields of one row per key: the first accepted one, else the first. Rows without a key, or whose fields are
    all null, don't count. A minimum, so it combines before the shuffle."""
    some = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull()
    rejected = ~F.coalesce(F.contains(F.lower(status), F.lit("accepted")), F.lit(False))
    kept = df.select(key.alias("key"), rejected.alias("_r"), order.alias("_o"), *fields).where(F.col("key").isNotNull() & some)
    return kept.groupBy("key").agg(F.min_by(F.struct(*fields), F.struct("_r", "_o")).alias("_f")).select("key", *[F.col("_f")[c].alias(c) for c in fields])


def record_status(has_output: Column, items: Column, failures: Column, matched: Column, unresolved: Column) -> Column:
    """missing_llm_output, no_taxa_reported, api_failure, partly_resolved, resolved or unresolved, from numbers of items."""
    return (
        F.when(~has_output, "missing_llm_output").when(items == 0, "no_taxa_reported").when(failures > 0, "api_failure").when((matched > 0) & (unresolved > 0), "partly_resolved")
        .when(matched > 0, "resolved").otherwise("unresolved")
    )


def scheme_state(all_groups: Column, biological: Column, unresolved: str) -> Column:
    return F.when(F.size(biological) > 0, "resolved").when(F.array_contains(all_groups, unresolved), "unresolved_only").otherwise("no_group")


def inclusion_state(groups: Column, names: Column, biological: Sequence[str], unresolved: str) -> Column:
    """The first of INCLUSION's outcomes that holds, of a record's groups and its items' names (null names are items
    that have none)."""
    said = F.filter(F.transform(names, lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    only = lambda values: (F.size(said) > 0) & F.forall(said, lambda x: x.isin(*values))
    return (
        F.when(F.arrays_overlap(groups, F.array(*map(F.lit, biological))), INCLUSION[0]).when(F.array_contains(groups, unresolved), INCLUSION[4]).when(F.size(names) == 0, INCLUSION[6])
        .when(only(NOT_APPLICABLE_NAMES), INCLUSION[1]).when(only(UNCLEAR_NAMES), INCLUSION[2]).when(only((*NOT_APPLICABLE_NAMES, *UNCLEAR_NAMES)), INCLUSION[3]).otherwise(INCLUSION[5])
    )


def status_counts(items: DataFrame, record: str, status: str, statuses: Sequence[str], prefix: str = "match_status_count__") -> DataFrame:
    """A column of counts per status, named by its slug; a missing status counts as <missing>."""
    held = F.coalesce(F.nullif(F.trim(status), F.lit("")), F.lit("<missing>"))
    return items.groupBy(record).agg(*[F.count_if(held == s).alias(prefix + _slug(s)) for s in statuses])


def _slug(text: str) -> str:
    out = "".join(c if c.isascii() and c.isalnum() else "_" for c in text.lower())
    while "__" in out:
        out = out.replace("__", "_")
    return out.strip("_")


def indicators(df: DataFrame, labels: str, vocabulary: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep and a 0/1 column per label of the vocabulary."""
    return df.select(*keep, *[F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int").alias("is_" + _slug(v)) for v in vocabulary])


def item_audit(items: DataFrame, record: str, axes: Sequence[str]) -> DataFrame:
    """axis, value, items, records: for each axis its values' numbers of items and of distinct records, in one pass."""
    long = items.select(record, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("value")) for a in axes])).alias("x")).select(record, "x.axis", "x.value")
    return long.groupBy("axis", "value").agg(F.count(F.lit(1)).alias("items"), F.count_distinct(record).alias("records"))


def benchmark_by_group(taxa: DataFrame, eligible: Column, lineage: Sequence[str], group: Column, unassigned: str = "unassigned") -> DataFrame:
    """group, species, share_pct of the eligible taxa: counted by lineage first, so that the rules run once a lineage."""
    counts = taxa.where(eligible).groupBy(*lineage).agg(F.count(F.lit(1)).alias("n"))
    summed = counts.groupBy(F.coalesce(group, F.lit(unassigned)).alias("group")).agg(F.sum("n").alias("species"))
    return summed.withColumn("share_pct", 100 * F.col("species") / F.sum("species").over(W.partitionBy()))  # a row per group


def parents_of(df: DataFrame, labels: str, dimension: DataFrame, child: str, parent: str, keep: str) -> DataFrame:
    """keep, and parents: the sorted distinct parents of each record's labels, of a small dimension."""
    held = df.select(keep, F.explode_outer(labels).alias("_c")).join(dimension.select(F.col(child).alias("_c"), F.col(parent).alias("_p")), "_c", "left")
    return held.groupBy(keep).agg(F.array_sort(F.collect_set("_p")).alias("parents"))


