"""Predictions joined to the records and truth labels that they are about."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import payloads as P
from corpusloom.operators.contracts import ContractError


def model_outputs(records: DataFrame, text: str = "value") -> DataFrame:
    """custom_id, model, created_at, output_text, payload of output records (JSON text): the payload is valid
    JSON or null."""
    e = records.select(P.envelope(F.col(text)).alias("_e")).select(F.col("_e.custom_id").alias("custom_id"), P.body(F.col("_e")).alias("_b"))
    out = e.select("custom_id", F.col("_b.model").alias("model"), F.col("_b.created_at").alias("created_at"), P.output_text(F.col("_b")).alias("output_text"))
    return out.withColumn("payload", P.json_payload(F.col("output_text")))


def attach_outputs(requests: DataFrame, outputs: DataFrame, key: str, output_key: str = "custom_id") -> DataFrame:
    """requests with their outputs' columns; requests without an output stay."""
    return requests.join(outputs.withColumnRenamed(output_key, "_key"), F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def truth_for_predictions(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Every prediction with the truth labels of its record; labels of records without a prediction are left out
    before the join, so they are not shuffled with it."""
    wanted = predictions.select(key).where(F.col(key).isNotNull()).distinct()
    return predictions.join(labels.join(wanted, key, "left_semi"), key, "left")


def attach_first(dataset: DataFrame, predictions: DataFrame, key: str, columns: Mapping[str, str], *order: Column) -> DataFrame:
    """dataset with the columns (source: new name) of each record's first prediction in the given order. Predictions of
    unknown records are an error; records without one get nulls. The pick combines before the shuffle."""
    unknown = predictions.select(key).distinct().join(dataset.select(key), key, "left_anti").limit(5).collect()
    if unknown:
        raise ContractError(f"predictions of records that the dataset lacks: {[r[0] for r in unknown]}")
    picked = F.min_by(F.struct(*[F.col(c).alias(new) for c, new in columns.items()]), F.struct(*order)).alias("_p")
    first = predictions.groupBy(key).agg(picked)
    return dataset.join(first, key, "left").select(*[F.col(f"`{c}`") for c in dataset.columns], *[F.col("_p")[new].alias(new) for new in columns.values()])


def coverage(dataset: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One row: total, covered, missing records."""
    held = dataset.select(key).join(predictions.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    out = held.agg(F.count(F.lit(1)).alias("total"), F.count("_c").alias("covered"))
    return out.withColumn("missing", F.col("total") - F.col("covered"))


def label_distribution(df: DataFrame, labels: str, top: int = 100) -> DataFrame:
    """label and n of the top most frequent labels (ties by name), and rows _null and _multi: records without a
    label, and with several."""
    held = df.select(F.coalesce(F.col(labels), F.array().cast("array<string>")).alias("l"))
    counts = held.select(F.explode("l").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(top)
    kinds = held.agg(F.count_if(F.size("l") == 0).alias("a"), F.count_if(F.size("l") > 1).alias("b"))
    return counts.union(kinds.select(F.inline(F.array(F.struct(F.lit("_null").alias("label"), F.col("a").alias("n")), F.struct(F.lit("_multi").alias("label"), F.col("b").alias("n"))))))


def rater_agreement(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """first, second and n: what two raters said of the records of the first, one row per pair of values; a record that
    the second lacks has null there."""
    both = first.select(key, F.col(value).alias("first")).join(second.select(key, F.col(value).alias("second")), key, "left")
    return both.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def cascade(docs: DataFrame, previous: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """Next-level requests: docs with outcome and candidates (array of names).

    previous: key, labels (array), go_on, failed of the level before; candidates: parent, name. outcome is request, or
    why a record is skipped: no_output, failed, terminal (no labels, or not to go on), no_candidates. Candidates come in
    the order of the labels, then by name, each once."""
    known = candidates.groupBy("parent").agg(F.array_sort(F.collect_set("name")).alias("_names"))
    exploded = previous.where(F.coalesce("go_on", F.lit(False)) & ~F.coalesce("failed", F.lit(False))).select(key, F.posexplode("labels").alias("_at", "parent"))
    found = exploded.join(known, "parent").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_names"))).alias("_all"))
    found = found.select(key, F.array_distinct(F.flatten(F.transform("_all", lambda x: x["_names"]))).alias("candidates"))
    j = docs.join(previous.withColumn("_had", F.lit(1)), key, "left").join(found, key, "left")
    outcome = (
        F.when(F.col("_had").isNull(), "no_output").when(F.coalesce("failed", F.lit(False)), "failed").when((F.coalesce(F.size("labels"), F.lit(0)) <= 0) | ~F.coalesce("go_on", F.lit(False)), "terminal")
        .when(F.col("candidates").isNull(), "no_candidates").otherwise("request")
    )
    return j.select(*[F.col(f"`{c}`") for c in docs.columns], outcome.alias("outcome"), "candidates")


def request_lines(requests: DataFrame, key: str, text: Column, model: str, instructions: str) -> DataFrame:
    """custom_id and body (JSON) of each request, and the candidates joined, by which they may be sorted so that
    equal candidate lists stand together."""
    content = F.struct(F.lit("user").alias("role"), text.alias("content"))
    ask = F.struct(F.lit("user").alias("role"), F.concat(F.lit("candidates: "), F.array_join("candidates", "; ")).alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(instructions).alias("instructions"), F.array(content, ask).alias("input"), P.enum_schema(F.col("candidates")).alias("schema"))
    return requests.select(F.col(key).cast("string").alias("custom_id"), F.to_json(body).alias("body"), F.array_join("candidates", ";").alias("candidate_key"))


# The tasks' names and the other names for them.
ALIASES = {
    "driver": ("drivers", "direct_driver", "direct_drivers"), "screening": ("screen", "eligibility"), "geography": ("geo", "region", "regions"), "taxa": (), "study": ("studies",),
    "ecosystems_realm": ("ecosystem_realm",), "ecosystems_biome": ("ecosystem_biome",), "ecosystems_efg": ("ecosystem_efg",), "threats_l0": (), "threats_l1": (), "threats_l2": (),
}
#: The columns that a task's payload's results become, and the task of the level above, whose labels its candidates hang on.
COLUMNS = {
    "driver": ("driver",), "screening": ("eligibility",), "geography": ("region", "subregion", "country"), "taxa": ("taxon", "rank"), "study": ("study_design",), "ecosystems_realm": ("realm",), "ecosystems_biome": ("biome",),
    "ecosystems_efg": ("functional_group",), "threats_l0": ("threat_l0",), "threats_l1": ("threat_l1",), "threats_l2": ("threat_l2",),
}
ABOVE = {"ecosystems_biome": "ecosystems_realm", "ecosystems_efg": "ecosystems_biome", "threats_l1": "threats_l0", "threats_l2": "threats_l1"}


def task(name: str) -> str:
    """A task's own name by any of its names, whatever the case; unknown ones are an error."""
    low = (name or "").strip().lower().replace("-", "_")
    for own, others in ALIASES.items():
        if low == own or low in others:
            return own
    raise ValueError(f"unknown task {name!r}; known: {', '.join(sorted(ALIASES))}")


def coded_columns(outputs: DataFrame, name: str, key: str = "custom_id") -> DataFrame:
    """The key and a task's columns from its payloads' first results."""
    return outputs.select(key, *[P.first_result(F.col("payload"), c).alias(c) for c in COLUMNS[task(name)]])


def in_candidate_order(lines: DataFrame) -> DataFrame:
    """Request lines sorted so that equal candidate lists stand together, over all partitions: a service that keeps what
    begins alike reads each list once."""
    return lines.orderBy("candidate_key", "custom_id")
