"""Model outputs as columns: envelopes, payloads that may need repair, screening steps. No Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.json_repair import repair_json

_BODY = "model string, created_at string, output array<struct<type: string, content: array<struct<type: string, text: string>>>>"
#: An output record: the body lies in a response, or in the record itself.
ENVELOPE = f"custom_id string, error string, response struct<body: struct<{_BODY}>>, body struct<{_BODY}>"
#: step: field of its other value in the new schema and in the old one, and what it is called here.
STEPS = {1: ("biodiversity_types", "bio", "s1_bio"), 2: ("direction", "dir", "s2_dir"), 3: ("drivers", "drivers", "s3_drivers"), 4: ("linkage", "link", "s4_link")}


def envelope(record: Column) -> Column:
    return F.from_json(record, ENVELOPE)


def body(envelope_: Column) -> Column:
    return F.coalesce(envelope_["response"]["body"], envelope_["body"])


def output_text(body_: Column) -> Column:
    """The first output text of the first message that has one; null if there is none."""
    messages = F.filter(body_["output"], lambda item: item["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda item: F.coalesce(item["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    return F.get(F.filter(parts, lambda p: p["type"] == "output_text"), F.lit(0))["text"]


def valid_json(text: Column) -> Column:
    """Whether a text is a JSON object or list. Never null."""
    opened = F.coalesce(F.regexp_replace(text, r"^\s+", "").substr(1, 1).isin("{", "["), F.lit(False))
    return opened & F.try_parse_json(text).isNotNull()


def json_payload(text: Column) -> Column:
    """The text if it is JSON, else its first object or list, repaired; null if it has none."""
    return F.when(valid_json(text), text).otherwise(repair_json(text))


def screening_steps(payload: Column) -> dict[str, Column]:
    """Columns s1_r, s1_bio, s2_r, s2_dir, s3_r, s3_drivers, s4_r, s4_link of a payload of the new schema
    (step1 to step4) or the old one (s1 to s4); the new one counts where any of its steps is there."""
    at = lambda path: F.get_json_object(payload, f"$.{path}")
    new = F.coalesce(*[at(f"step{k}") for k in STEPS]).isNotNull()
    out = {}
    for k, (field, old, name) in STEPS.items():
        out[f"s{k}_r"] = F.when(new, at(f"step{k}.results")).otherwise(at(f"s{k}.r"))
        out[name] = F.when(new, at(f"step{k}.{field}")).otherwise(at(f"s{k}.{old}"))
    return out


def first_result(payload: Column, field: str) -> Column:
    """The field of the first result that is an object."""
    results = F.from_json(F.get_json_object(payload, "$.results"), "array<string>")
    return F.get_json_object(F.get(F.filter(results, lambda r: r.startswith("{")), F.lit(0)), f"$.{field}")


def enum_schema(candidates: Column, name: str = "label", also: tuple[str, ...] = ("Unclear",)) -> Column:
    """A JSON schema that allows a list of the candidates (in their order, each once) and of what is always allowed."""
    values = F.array_distinct(F.concat(candidates, F.array(*[F.lit(a) for a in also])))
    return F.concat(F.lit('{"type":"object","properties":{"' + name + '":{"type":"array","items":{"type":"string","enum":'), F.to_json(values), F.lit("}}}}"))
