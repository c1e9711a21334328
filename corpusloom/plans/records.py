"""Queries of screening, evaluation, sampling, reshaping and record handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import labels as L
from corpusloom.functions import text as X
from corpusloom.operators import contracts as C
from corpusloom.operators import evaluation as E
from corpusloom.operators import sampling as S
from corpusloom.sources import files
from corpusloom.sources.tables import table

R = 6


def _stages(spark, sf):
    """Tri-state stages of each line: -1, 0 or 1."""
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity").cast("int")
    s = lambda k: F.when(q % k == 0, -1).when(q % k == 1, 0).otherwise(1)
    return li.select("l_orderkey", "l_linenumber", s(7).alias("s1"), s(5).alias("s2"), s(11).alias("s3"), s(3).alias("s4"))


_ST = "st AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_quantity::INT % {k} = 0 THEN -1 WHEN l_quantity::INT % {k} = 1 THEN 0 ELSE 1 END AS s{i}" for i, k in enumerate((7, 5, 11, 3), 1)) + " FROM lineitem)"


def screening_eligibility(spark, sf):
    d = _stages(spark, sf)
    cols = [F.col(f"s{i}") for i in range(1, 5)]
    return d.groupBy(E.eligibility(*cols).alias("eligibility"), E.strictly_eligible(*cols).alias("strict")).agg(F.count(F.lit(1)).alias("n"))


def first_failing_stage(spark, sf):
    d = _stages(spark, sf)
    return d.groupBy(E.first_failing_stage([(f"s{i}", F.col(f"s{i}")) for i in range(1, 5)]).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def exclusion_overlap(spark, sf):
    return E.exclusion_overlap(_stages(spark, sf), ["s1", "s2", "s3", "s4"])


def _judged(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    truth = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    pred = F.array_compact(F.array(F.when(F.col("n_chars") > 400, "good"), F.when(F.col("text").contains("trash"), "toxic")))
    return d.select("doc_id", truth.alias("t"), pred.alias("p"))


_JD = "jd AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS t, list_filter([CASE WHEN n_chars > 400 THEN 'good' END, CASE WHEN contains(text, 'trash') THEN 'toxic' END], lambda x: x IS NOT NULL) AS p FROM documents JOIN labels USING (doc_id))"


def label_confusion_metrics(spark, sf):
    out = E.label_metrics(_judged(spark, sf), "t", "p").where("not startswith(label, '_')")
    return out.withColumns({c: F.round(c, R) for c in ("precision", "recall", "f1", "kappa")})


def normalized_label_metrics(spark, sf):
    """The same of labels written as cells, read as evaluation reads them, one label standing for another; with the summary
    rows."""
    cells = _judged(spark, sf).select(F.to_json("t").alias("t"), F.concat(F.lit("['"), F.array_join(F.transform("p", lambda x: F.initcap(x)), "', '"), F.lit("']")).alias("p"))
    out = E.label_metrics(cells, "t", "p", lambda c: L.collapse(L.label_set(c), {"toxic": "harmful"}))
    return out.withColumns({c: F.round(c, R) for c in ("precision", "recall", "f1", "kappa")})


def per_record_confusion(spark, sf):
    out = E.record_confusion(_judged(spark, sf), "t", "p", 2)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


def binary_metrics(spark, sf):
    out = E.binary_metrics(_judged(spark, sf), F.array_contains("t", "good"), F.array_contains("p", "good"))
    return out.withColumns({c: F.round(c, R) for c in ("precision", "recall", "f1", "kappa", "accuracy")})


def placeholder_mask(spark, sf):
    d = _judged(spark, sf)
    return d.groupBy(E.unmasked(F.col("t"), F.col("p"), ["toxic"]).alias("scored")).agg(F.count(F.lit(1)).alias("n"))


def stratified_split_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.split_rows(d, "lang", "doc_id", {"train": 0.6, "dev": 0.2, "test": 0.2}, 7)


def equal_allocation_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return S.take_per_stratum(d, "lang", "doc_id", S.equal_allocation(S.strata_sizes(d, "lang"), 250), 7)


def keep_first_dedupe(spark, sf):
    return C.keep_first(table(spark, sf, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


def latest_valid_wins(spark, sf):
    """Of each user's events the latest valid one, as of records in files: a type's file is an original or a numbered
    retry; an event of a value of 5 at most is broken and never replaces a good one."""
    ev = table(spark, sf, "events")
    retry = F.when(F.col("event_type") == "click", "out_retry-2.jsonl").when(F.col("event_type") == "view", "out_retry10.jsonl").otherwise("out.jsonl")
    records = ev.select("user_id", "event_id", retry.alias("file"), F.col("event_id").alias("line"), (F.col("value") > 5).alias("valid"))
    return files.latest_valid(records, "user_id").select("user_id", "event_id")


def _wide(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("y"), "l_quantity")
    return li.groupBy("l_suppkey").pivot("y", list(range(1995, 2002))).agg(F.sum("l_quantity"))


def _long(spark, sf):
    years = [str(y) for y in range(1995, 2002)]
    return _wide(spark, sf).unpivot(["l_suppkey"], years, "year", "value").withColumn("year", F.col("year").cast("long"))


def series_unpivot(spark, sf):
    return _long(spark, sf).where("value is not null")


def series_coverage(spark, sf):
    seen = F.when(F.col("value").isNotNull(), F.col("year"))
    return _long(spark, sf).groupBy("l_suppkey").agg(F.count("value").alias("n"), F.min(seen).alias("first_year"), F.max(seen).alias("last_year"))


def series_latest(spark, sf):
    return _long(spark, sf).where("value is not null").groupBy("l_suppkey").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))


_LONG = "lg AS (SELECT s.l_suppkey, y.year, v.value FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(range(1995, 2002))::BIGINT AS year) y LEFT JOIN (SELECT l_suppkey, year(l_shipdate)::BIGINT AS year, sum(l_quantity) AS value FROM lineitem GROUP BY ALL) v ON v.l_suppkey = s.l_suppkey AND v.year = y.year)"


def json_props_extract(spark, sf):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def keyword_regex_feature(spark, sf):
    d = table(spark, sf, "documents")
    kind = X.bucket_by_keywords(F.col("text"), [("license", ["license"]), ("abuse", ["trash", "stupid"])])
    return d.groupBy(kind.alias("bucket"), X.mentions(r"\bthe\b", F.col("text")).alias("mentions")).agg(F.count(F.lit(1)).alias("n"))


def token_normalize(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", L.token(F.col("n_name")).alias("token"), X.slug(F.col("n_name")).alias("slug"))


def partition_assignment(spark, sf):
    """Numbered partitions of 1,000 orders of each year, latest key first."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))
    return files.numbered_parts(o, "year", "o_orderkey", 1000).groupBy("year", "part").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("first_key"))


def ordered_string_agg(spark, sf):
    n = table(spark, sf, "nation")
    held = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return n.groupBy("n_regionkey").agg(F.array_join(F.transform(held, lambda x: x["n_name"]), ";").alias("names"))


def corpus_merge_key_audit(spark, sf):
    left, right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    return C.key_difference(left, right, "k").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def crosswalk_precedence(spark, sf):
    """Suppliers' nations: by exact code, by override, explicitly without a match, or not in the crosswalk."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    exact = table(spark, sf, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    over = table(spark, sf, "nation").where("n_regionkey = 3 or n_nationkey in (4, 9)").select("n_nationkey", F.when(F.col("n_regionkey") == 3, F.upper("n_name")).alias("n_name"))
    return C.crosswalk(s, "s_nationkey", exact, over, "n_nationkey", "n_name").select("s_suppkey", F.col("n_name").alias("name"), "status")


QUERIES = {f.__name__: f for f in (
    screening_eligibility, first_failing_stage, exclusion_overlap, label_confusion_metrics, normalized_label_metrics, per_record_confusion, binary_metrics, placeholder_mask, stratified_split_rows, equal_allocation_sample, keep_first_dedupe, latest_valid_wins,
    series_unpivot, series_coverage, series_latest, json_props_extract, keyword_regex_feature, token_normalize, partition_assignment, ordered_string_agg, corpus_merge_key_audit, crosswalk_precedence,
)}

_CM = "tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(((tp + tn) / n - (((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n))) / nullif(1 - (((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)), 0), 6) AS kappa"
_BAD = "(" + " OR ".join(f"s{i} = 0" for i in range(1, 5)) + ")"
ORACLES = {
    "screening_eligibility": f"WITH {_ST} SELECT CASE WHEN {_BAD} THEN 'NOT_ELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility, (s1 = 1 AND s2 = 1 AND s3 = 1 AND s4 = 1) AS strict, count(*) AS n FROM st GROUP BY ALL",
    "first_failing_stage": f"WITH {_ST} SELECT CASE WHEN s1 = 0 THEN 's1' WHEN s1 = 1 AND s2 = 0 THEN 's2' WHEN s1 = 1 AND s2 = 1 AND s3 = 0 THEN 's3' WHEN s1 = 1 AND s2 = 1 AND s3 = 1 AND s4 = 0 THEN 's4' END AS stage, count(*) AS n FROM st GROUP BY ALL",
    "exclusion_overlap": f"WITH {_ST} SELECT concat_ws(' & ', CASE WHEN s1 = 0 THEN 's1' END, CASE WHEN s2 = 0 THEN 's2' END, CASE WHEN s3 = 0 THEN 's3' END, CASE WHEN s4 = 0 THEN 's4' END) AS combination, count(*) AS n FROM st WHERE {_BAD} GROUP BY ALL",
    "label_confusion_metrics": f"WITH {_JD}, s AS (SELECT * FROM jd WHERE len(t) > 0), u AS (SELECT DISTINCT unnest(list_concat(t, p)) AS label FROM s), c AS (SELECT label, count(*) FILTER (list_contains(t, label) AND list_contains(p, label)) AS tp, count(*) FILTER (NOT list_contains(t, label) AND list_contains(p, label)) AS fp, count(*) FILTER (list_contains(t, label) AND NOT list_contains(p, label)) AS fn, count(*) FILTER (NOT list_contains(t, label) AND NOT list_contains(p, label)) AS tn, count(*) AS n FROM s CROSS JOIN u GROUP BY label) SELECT label, n, {_CM}, tp + fn AS support FROM c",
    "normalized_label_metrics": f"""WITH {_JD}, s AS (SELECT list_transform(t, lambda x: CASE x WHEN 'toxic' THEN 'harmful' ELSE x END) AS t, list_transform(p, lambda x: CASE x WHEN 'toxic' THEN 'harmful' ELSE x END) AS p FROM jd WHERE len(t) > 0), u AS (SELECT DISTINCT unnest(list_concat(t, p)) AS label FROM s),
      c AS (SELECT label, count(*) FILTER (list_contains(t, label) AND list_contains(p, label)) AS tp, count(*) FILTER (NOT list_contains(t, label) AND list_contains(p, label)) AS fp, count(*) FILTER (list_contains(t, label) AND NOT list_contains(p, label)) AS fn, count(*) FILTER (NOT list_contains(t, label) AND NOT list_contains(p, label)) AS tn, count(*) AS n FROM s CROSS JOIN u GROUP BY label),
      raw AS (SELECT *, tp + fn AS support, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f, ((tp + tn) / n - (((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n))) / nullif(1 - (((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)), 0) AS k FROM c),
      m AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(support)::BIGINT AS support, sum(n)::BIGINT AS n FROM raw)
      SELECT label, tp, fp, fn, tn, n, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, round(k, 6) AS kappa, support FROM raw
      UNION ALL SELECT '_macro', NULL, NULL, NULL, NULL, max(n), round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), round(avg(k), 6), sum(support)::BIGINT FROM raw
      UNION ALL SELECT '_weighted', NULL, NULL, NULL, NULL, max(n), round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), round(sum(coalesce(k, 0) * support) / sum(support), 6), sum(support)::BIGINT FROM raw
      UNION ALL SELECT '_micro', tp, fp, fn, tn, n, {_CM.removeprefix("tp, fp, fn, tn, ")}, support FROM m""",
    "per_record_confusion": f"WITH {_JD} SELECT doc_id, len(list_intersect(t, p))::BIGINT AS tp, (len(p) - len(list_intersect(t, p)))::BIGINT AS fp, (len(t) - len(list_intersect(t, p)))::BIGINT AS fn, (2 - len(t) - len(p) + len(list_intersect(t, p)))::BIGINT AS tn FROM jd",
    "binary_metrics": f"WITH {_JD}, b AS (SELECT list_contains(t, 'good') AS t, list_contains(p, 'good') AS p FROM jd), c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) AS n FROM b) SELECT {_CM}, round((tp + tn) / n, 6) AS accuracy FROM c",
    "placeholder_mask": f"WITH {_JD} SELECT NOT (list_contains(t, 'toxic') OR list_contains(p, 'toxic')) AS scored, count(*) AS n FROM jd GROUP BY ALL",
    "stratified_split_rows": "WITH r AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents), a AS (SELECT *, floor(n * 0.6::DOUBLE) AS b1, floor(n * 0.2::DOUBLE) AS b2, n * 0.6::DOUBLE - floor(n * 0.6::DOUBLE) AS f1, n * 0.2::DOUBLE - floor(n * 0.2::DOUBLE) AS f2 FROM r), c AS (SELECT *, n - b1 - 2 * b2 AS x FROM a), e AS (SELECT *, b1 + CASE WHEN (CASE WHEN f2 > f1 THEN 2 ELSE 0 END) < x THEN 1 ELSE 0 END AS n1, b2 + CASE WHEN (CASE WHEN f1 >= f2 THEN 1 ELSE 0 END) < x THEN 1 ELSE 0 END AS n2 FROM c) SELECT doc_id, lang, CASE WHEN r <= n1 THEN 'train' WHEN r <= n1 + n2 THEN 'dev' ELSE 'test' END AS split FROM e",
    "equal_allocation_sample": """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents), s AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS i, count(*) OVER () AS k, least(250, sum(count(*)) OVER ()) AS want FROM documents GROUP BY lang),
      g AS (SELECT *, least(n, want // k + CASE WHEN i < want % k THEN 1 ELSE 0 END) AS got FROM s), h AS (SELECT *, want - sum(got) OVER () AS short, coalesce(sum(n - got) OVER (ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
      SELECT doc_id, r.lang FROM r JOIN h ON r.lang = h.lang WHERE r.r <= got + greatest(0, least(n - got, short - before))""",
    "keep_first_dedupe": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1",
    "latest_valid_wins": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 2 ELSE 0 END DESC, event_id DESC) AS r FROM events WHERE value > 5) WHERE r = 1",
    "series_unpivot": f"WITH {_LONG} SELECT * FROM lg WHERE value IS NOT NULL",
    "series_coverage": f"WITH {_LONG} SELECT l_suppkey, count(value) AS n, min(year) FILTER (value IS NOT NULL) AS first_year, max(year) FILTER (value IS NOT NULL) AS last_year FROM lg GROUP BY l_suppkey",
    "series_latest": f"WITH {_LONG} SELECT l_suppkey, max(year) AS year, max_by(value, year) AS value FROM lg WHERE value IS NOT NULL GROUP BY l_suppkey",
    "json_props_extract": "SELECT event_type, sum((props->>'k')::BIGINT)::BIGINT AS total, count(props->>'k') AS n FROM events GROUP BY event_type",
    "keyword_regex_feature": r"SELECT CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'trash') OR contains(lower(text), 'stupid') THEN 'abuse' ELSE 'other' END AS bucket, CASE WHEN length(trim(text)) > 0 THEN regexp_matches(text, '(?i)\bthe\b') END AS mentions, count(*) AS n FROM documents GROUP BY ALL",
    "token_normalize": "SELECT n_nationkey, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')) AS token, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM nation",
    "partition_assignment": "WITH r AS (SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey DESC) AS r FROM orders) SELECT year, ceil(r / 1000)::BIGINT AS part, count(*) AS n, max(o_orderkey) AS first_key FROM r GROUP BY ALL",
    "ordered_string_agg": "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "corpus_merge_key_audit": "SELECT CASE WHEN r.k IS NULL THEN 'left_only' ELSE 'right_only' END AS side, count(*) AS n FROM (SELECT DISTINCT o_orderkey AS k FROM orders) l FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL GROUP BY ALL",
    "crosswalk_precedence": "SELECT s_suppkey, CASE WHEN n_regionkey < 3 THEN n_name WHEN n_regionkey = 3 THEN upper(n_name) END AS name, CASE WHEN n_regionkey < 3 THEN 'exact' WHEN n_regionkey = 3 THEN 'override' WHEN n_nationkey IN (4, 9) THEN 'no_match' ELSE 'unmapped' END AS status FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
}
