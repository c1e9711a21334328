"""Queries of model outputs, predictions and requests. Output records are made of events, one per event: the event's
type decides what is the matter with its payload."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import payloads as P
from corpusloom.functions.json_repair import repair_json
from corpusloom.operators import predictions as O
from corpusloom.operators import rows as R
from corpusloom.sources.tables import labels, publications, table


def _records(spark, sf):
    """JSON lines: a new schema (view), an old one (click), a fenced text with stray commas (purchase), no JSON (error),
    no message (signup); k is the event's number."""
    ev = table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    new = F.concat(F.lit('{"step1": {"results": '), "k", F.lit(', "biodiversity_types": ["a", "b"]}, "step3": {"results": 1, "drivers": "d'), "k", F.lit('"}, "results": [1, {"driver": "x'), "k", F.lit('"}]}'))
    old = F.concat(F.lit('{"s1": {"r": '), "k", F.lit(', "bio": "q"}, "s2": {"r": 0, "dir": "negative"}}'))
    fenced = F.concat(F.lit('Here it is:\n```json\n{"step2": {"results": '), "k", F.lit(', "direction": "positive",},}\n```'))
    text = F.when(F.col("event_type") == "view", new).when(F.col("event_type") == "click", old).when(F.col("event_type") == "purchase", fenced).otherwise(F.concat(F.lit("sorry: "), "k"))
    message = lambda kind: F.struct(F.lit(kind).alias("type"), F.array(F.struct(F.when(F.lit(kind) == "message", "output_text").alias("type"), text.alias("text"))).alias("content"))
    output = F.when(F.col("event_type") == "signup", F.array(message("reasoning"))).otherwise(F.array(message("reasoning"), message("message")))
    body = F.struct(F.lit("m1").alias("model"), F.lit(5).alias("created_at"), output.alias("output"))
    wrapped = F.struct(F.col("event_id").cast("string").alias("custom_id"), F.struct(body.alias("body")).alias("response"))
    bare = F.struct(F.col("event_id").cast("string").alias("custom_id"), body.alias("body"))
    return ev.select(F.when(F.col("event_type") == "click", F.to_json(bare)).otherwise(F.to_json(wrapped)).alias("value"))


def model_output_steps(spark, sf):
    """Each event with its screening steps, from its output record."""
    outputs = O.model_outputs(_records(spark, sf))
    found = outputs.select("custom_id", "model", F.col("payload").isNotNull().alias("parsed"), *[c.alias(n) for n, c in P.screening_steps(F.col("payload")).items()], P.first_result(F.col("payload"), "driver").alias("driver"))
    return O.attach_outputs(table(spark, sf, "events").select("event_id"), found, "event_id")


def coded_outputs(spark, sf):
    """A task's columns, by one of its other names, counted."""
    out = O.coded_columns(O.model_outputs(_records(spark, sf)), "Driver")
    return out.groupBy("driver").agg(F.count(F.lit(1)).alias("n"))


def repaired_payloads(spark, sf):
    """Each event's properties cut off at each length and repaired, and a payload of it with single quotes, a line break, bare
    words and an open list, cut off as far. What is alike in several events is repaired once."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "props")
    kinds = ev.select("event_type", "props").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # their cuts are the work, however small they are
    cut = kinds.withColumn("k", F.get_json_object("props", "$.k")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("props"))))
    loose = F.concat(F.lit("{'type': '"), "event_type", F.lit("\n', seen: [True, "), "k", F.lit(", None, {at: ["))
    of = F.length(loose) - F.length("props") + F.col("cut")  # the last of it
    done = cut.select(F.col("event_type").alias("kind"), F.col("props").alias("whole"), "cut", repair_json(F.left("props", F.col("cut"))).alias("cut_props"), repair_json(F.left(loose, of)).alias("loose"))
    return ev.join(done, (F.col("props") == F.col("whole")) & F.col("event_type").eqNullSafe(F.col("kind"))).select("event_id", "cut", F.col("cut_props").alias("props"), "loose")


def truth_for_predictions(spark, sf):
    preds = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", (F.col("n_chars") > 900).alias("predicted"))
    return O.truth_for_predictions(preds, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def first_prediction(spark, sf):
    preds = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    base = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return O.attach_first(base, preds, "c_custkey", {"o_orderpriority": "pred_priority", "o_orderstatus": "pred_status"}, F.col("o_orderkey"))


def prediction_coverage(spark, sf):
    preds = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return O.coverage(table(spark, sf, "customer"), preds, "c_custkey")


def label_distribution(spark, sf):
    held = labels(spark, sf).groupBy("id").agg(F.collect_list("label").alias("labels"))
    return O.label_distribution(publications(spark, sf).join(held, "id", "left"), "labels")


def rater_agreement(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 900, 1).otherwise(0).alias("v"))
    return O.rater_agreement(d, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "v")


def _cascade(spark, sf):
    """Orders, their customers' segment as the label of the level before, brands of parts by type as candidates."""
    seg = {"FURNITURE": "ECONOMY", "MACHINERY": "PROMO", "BUILDING": "LARGE", "AUTOMOBILE": "MEDIUM"}
    as_type = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in seg.items()], F.lit("NONE"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderstatus", "o_orderpriority")
    prev = orders.where("o_orderpriority <> '5-LOW'").join(table(spark, sf, "customer").select("c_custkey", as_type.alias("label")), F.col("o_custkey") == F.col("c_custkey"))
    prev = prev.select("id", F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.array().cast("array<string>")).otherwise(F.array("label", F.lit("STANDARD"), "label")).alias("labels"), (F.col("o_orderstatus") != "F").alias("go_on"), (F.col("o_orderpriority") == "3-MEDIUM").alias("failed"))
    cands = table(spark, sf, "part").where("p_type <> 'STANDARD'").select(F.col("p_type").alias("parent"), F.col("p_brand").alias("name")).distinct()
    return O.cascade(orders.select("id"), prev, cands)


def cascade_outcomes(spark, sf):
    return _cascade(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == "request", F.size("candidates"))), F.lit(0)).alias("candidates"))


def ordered_requests(spark, sf):
    """The same requests' places in the order of their candidate lists."""
    lines = O.request_lines(_cascade(spark, sf).where("outcome = 'request'"), "id", F.col("id").cast("string"), "m1", "code it")
    return R.numbered_rows(O.in_candidate_order(lines).select("custom_id", "candidate_key"), "place", F.col("candidate_key"), F.col("custom_id"))


def cascade_requests(spark, sf):
    """Request lines, and in the order of their candidate lists where a list's requests begin (at)."""
    lines = O.request_lines(_cascade(spark, sf).where("outcome = 'request'"), "id", F.concat(F.lit("doc "), F.col("id").cast("string")), "m1", "code it")
    begins = lines.groupBy("candidate_key").agg(F.count(F.lit(1)).alias("n")).withColumn("at", F.sum("n").over(W.orderBy("candidate_key")) - F.col("n"))  # a row per list
    return lines.join(begins, "candidate_key").select("custom_id", "body", "at")


QUERIES = {f.__name__: f for f in (model_output_steps, coded_outputs, repaired_payloads, truth_for_predictions, first_prediction, prediction_coverage, label_distribution, rater_agreement, cascade_outcomes, cascade_requests, ordered_requests)}

_K = "props->>'k'"
_CASC = """ord AS (SELECT o_orderkey AS id, o_orderstatus AS st, o_orderpriority AS pr, CASE c_mktsegment WHEN 'FURNITURE' THEN 'ECONOMY' WHEN 'MACHINERY' THEN 'PROMO' WHEN 'BUILDING' THEN 'LARGE' WHEN 'AUTOMOBILE' THEN 'MEDIUM' ELSE 'NONE' END AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
br AS (SELECT p_type, list_sort(list(DISTINCT p_brand)) AS names FROM part WHERE p_type <> 'STANDARD' GROUP BY p_type),
casc AS (SELECT id, CASE WHEN pr = '5-LOW' THEN 'no_output' WHEN pr = '3-MEDIUM' THEN 'failed' WHEN pr = '4-NOT SPECIFIED' OR st = 'F' THEN 'terminal' WHEN names IS NULL THEN 'no_candidates' ELSE 'request' END AS outcome, names FROM ord LEFT JOIN br ON label = p_type)"""
ORACLES = {
    "model_output_steps": f"""SELECT event_id, 'm1' AS model, event_type IN ('view', 'click', 'purchase') AS parsed, CASE WHEN event_type IN ('view', 'click') THEN {_K} END AS s1_r,
      CASE event_type WHEN 'view' THEN '["a","b"]' WHEN 'click' THEN 'q' END AS s1_bio, CASE event_type WHEN 'click' THEN '0' WHEN 'purchase' THEN {_K} END AS s2_r, CASE event_type WHEN 'click' THEN 'negative' WHEN 'purchase' THEN 'positive' END AS s2_dir,
      CASE event_type WHEN 'view' THEN '1' END AS s3_r, CASE event_type WHEN 'view' THEN 'd' || ({_K}) END AS s3_drivers, NULL::VARCHAR AS s4_r, NULL::VARCHAR AS s4_link, CASE event_type WHEN 'view' THEN 'x' || ({_K}) END AS driver FROM events""",
    "coded_outputs": f"SELECT CASE event_type WHEN 'view' THEN 'x' || ({_K}) END AS driver, count(*) AS n FROM events GROUP BY ALL",
    "repaired_payloads": """WITH c AS (SELECT event_id, event_type, props, props->>'k' AS k, unnest(range(1, length(props) + 1)) AS cut FROM events),
      t AS (SELECT *, length(props) - cut AS off, '{"type":"' || event_type || '\\n","seen":[true' AS head FROM c)
      SELECT event_id, cut::INTEGER AS cut,
        CASE WHEN cut = 1 THEN '{}' WHEN cut = 2 THEN '{"":""}' WHEN cut <= 6 THEN '{"k":""}' ELSE '{"k":' || left(k, cut - 6) || '}' END AS props,
        head || CASE
          WHEN off = 0 THEN ',' || k || ',null,{"at":[]}]}' WHEN off <= 3 THEN ',' || k || ',null,{"at":""}]}' WHEN off = 4 THEN ',' || k || ',null,{"a":""}]}' WHEN off = 5 THEN ',' || k || ',null,{}]}'
          WHEN off <= 8 THEN ',' || k || ',null]}' ELSE '' END AS loose
      FROM t""",
    "truth_for_predictions": "SELECT d.doc_id, n_chars > 900 AS predicted, quality FROM documents d LEFT JOIN labels USING (doc_id) WHERE lang = 'en'",
    "first_prediction": "SELECT c_custkey, c_mktsegment, o_orderpriority AS pred_priority, o_orderstatus AS pred_status FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) o ON o_custkey = c_custkey AND r = 1",
    "prediction_coverage": "SELECT count(*) AS total, count(k) AS covered, count(*) - count(k) AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000) ON k = c_custkey",
    "label_distribution": "WITH l AS (SELECT DISTINCT l_orderkey AS id, p_type AS label FROM lineitem JOIN part ON l_partkey = p_partkey), k AS (SELECT o_orderkey, count(label) AS k FROM orders LEFT JOIN l ON id = o_orderkey GROUP BY o_orderkey) SELECT * FROM (SELECT label, count(*) AS n FROM l JOIN orders ON id = o_orderkey GROUP BY label ORDER BY n DESC, label LIMIT 100) UNION ALL SELECT '_null', count(*) FILTER (k = 0) FROM k UNION ALL SELECT '_multi', count(*) FILTER (k > 1) FROM k",
    "rater_agreement": "SELECT CASE WHEN n_chars > 900 THEN 1 ELSE 0 END AS first, quality AS second, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL",
    "cascade_outcomes": f"WITH {_CASC} SELECT outcome, count(*) AS n, coalesce(sum(CASE WHEN outcome = 'request' THEN len(names) END), 0)::BIGINT AS candidates FROM casc GROUP BY outcome",
    "ordered_requests": f"WITH {_CASC} SELECT id::VARCHAR AS custom_id, array_to_string(names, ';') AS candidate_key, row_number() OVER (ORDER BY array_to_string(names, ';'), id::VARCHAR) AS place FROM casc WHERE outcome = 'request'",
    "cascade_requests": f"""WITH {_CASC}, r AS (SELECT id, names, array_to_string(names, ';') AS key FROM casc WHERE outcome = 'request')
      SELECT id::VARCHAR AS custom_id, rank() OVER (ORDER BY key) - 1 AS at,
        '{{"model":"m1","instructions":"code it","input":[{{"role":"user","content":"doc ' || id || '"}},{{"role":"user","content":"candidates: ' || array_to_string(names, '; ') || '"}}],"schema":"{{\\"type\\":\\"object\\",\\"properties\\":{{\\"label\\":{{\\"type\\":\\"array\\",\\"items\\":{{\\"type\\":\\"string\\",\\"enum\\":[\\"' || array_to_string(names, '\\",\\"') || '\\",\\"Unclear\\"]}}}}}}}}"}}' AS body FROM r""",
}
