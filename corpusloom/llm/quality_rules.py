"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host the distinct documents that hold a line are counted
(copies of one text count once, unless copies_once is False). A line above the limit is boilerplate:
it is removed from every document but the first that holds it (of the smallest doc_id; null where no
holder has one), so no content leaves the corpus altogether. The limit does not grow with the host.
A document that loses more than a set share of its words, or keeps too few, is depleted and rejected.

DataFrame functions only. The text is read once into a compact table (a hash and a word count per
line); only that table is shuffled. A hot line's counts are combined before the shuffle, and the
join that brings verdicts back can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import UPPER, WORD_GAP, columns_of, fresh, materialize, named, numbered, release, rows_in, table, words_of

#: A line is boilerplate in a host if more than so many distinct documents hold it, however large the host is.
MAX_DOCS = 10
#: Whether copies of one text count as one document there (else every row with its own doc_id does, and whole pages that are copied often are rejected for their first).
COPIES_ONCE = True
#: A document is depleted if more than this share of its words is removed, or fewer words than this are left of a document that lost some.
DEPLETED_SHARE = 0.75
MIN_LEFT = 20
#: Base rules.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bits of a coded window that hold its position; the others hold a part of its hash.
_AT = 31


def normalised_line(line: Column) -> Column:
    """A-Z lower-cased, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, UPPER, UPPER.lower()), WORD_GAP, " "))


def _coded(hashes: Column, high: bool) -> Column:
    """The windows as sorted longs: half of the hash over the position."""
    half = (lambda h: F.shiftleft(F.shiftright(h, _AT), _AT)) if high else (lambda h: F.shiftleft(h, _AT))
    return F.sort_array(F.transform(hashes, lambda h, i: half(h).bitwiseOR(i.cast("long"))))


def _repeats(coded: str) -> Column:
    """Positions of the windows whose half hash a neighbour shares. coded must be a plain column: an
    expression here would be computed again for each element."""
    part = lambda x: F.shiftright(x, _AT)
    near = F.transform(coded, lambda x, i: F.when((part(x) == part(F.get(coded, i - 1))) | (part(x) == part(F.get(coded, i + 1))), x.bitwiseAND(F.lit((1 << _AT) - 1))))
    return F.filter(near, lambda x: x.isNotNull())


def profile(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", keep: str | None = None) -> DataFrame:
    """One row per document: _rid (the column keep, else made), doc_id, host, text hash, base statistics and `lines`, an array of
    (line hash, words) of its lines that have a word."""
    d = docs.select(
        (F.col(keep) if keep else F.monotonically_increasing_id()).alias("_rid"), F.col(doc_id).alias("doc_id"), F.col(host).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    d = d.select("*", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ls"))
    n = F.size("w")
    windows = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    d = d.select(
        "_rid", "doc_id", "host", F.xxhash64("t").alias("text_hash"), n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WORD_GAP, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.transform(windows, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))).alias("wh"),
        F.transform("ls", lambda x: F.struct(F.xxhash64(normalised_line(x)).alias("h"), F.size(F.filter(F.split(x, WORD_GAP), lambda w: w != F.lit(""))).alias("n"))).alias("lines"),
    )
    # A window that repeats shares both halves of its 64-bit hash; sorting plain longs keeps long texts at n log n.
    none = F.array().cast("array<bigint>")
    some = F.size(F.array_distinct("wh")) < F.size("wh")
    d = d.withColumn("wh", F.when(some, F.col("wh")).otherwise(none)).withColumns({"hi": _coded(F.col("wh"), True), "lo": _coded(F.col("wh"), False)})
    d = d.withColumn("at", F.sort_array(F.array_intersect(_repeats("hi"), _repeats("lo"))))
    # starts are sorted: each covers three words, or as many as up to the next
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3).cast("long"), x - s["last"])).alias("n"), x.alias("last")), lambda s: s["n"])
    return d.select("_rid", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "lines")


def judge(profiled: DataFrame, max_docs: int = MAX_DOCS, depleted_share: float = DEPLETED_SHARE, min_left: int = MIN_LEFT, copies_once: bool = COPIES_ONCE) -> tuple[DataFrame, DataFrame]:
    """(verdicts, removed lines) of a profiled table.

    Verdicts: the profile without lines, with words_removed, base_failed and kept. Removed lines:
    (_rid, h), one row per document and line hash that goes from it.
    """
    lines = profiled.select("_rid", "doc_id", "host", "text_hash", F.explode("lines").alias("l")).select("_rid", "doc_id", "host", "text_hash", F.col("l.h").alias("h"), F.col("l.n").alias("n"))
    held = lines.groupBy("host", "h").agg(F.count_distinct("text_hash" if copies_once else "doc_id").alias("held"), F.min("doc_id").alias("first"))
    often = held.where(F.col("held") > max_docs).select(F.col("host").alias("o_host"), F.col("h").alias("o_h"), "first")
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("o_host")) & (F.col("h") == F.col("o_h"))).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    lost = gone.groupBy("_rid").agg(F.sum("n").alias("words_removed"))
    verdicts = profiled.drop("lines").join(lost, "_rid", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0)).cast("long"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("words_removed") > depleted_share * F.col("n_words")) | ((F.col("words_removed") > 0) & (F.col("n_words") - F.col("words_removed") < min_left))
    return verdicts.withColumns({"base_failed": base, "kept": ~base & ~depleted}), gone.select("_rid", "h").distinct()


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """Verdict per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, words_removed.

    A null or empty text has no words and fails the base rules; texts and lines of any length are
    judged whole, a text's words lie in one row. A null host is a host of its own. A
    null doc_id is a line's first only where no holder has another; rows that share the first doc_id
    all keep the line. Rows that repeat are judged row by row; copies of a text count once. An empty
    table gives an empty table; other columns are not looked at.
    """
    verdicts, _ = judge(materialize(profile(docs, doc_id, text, host), "line-profile"), **limits)
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def apply_quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """docs without the rejected documents, boilerplate lines taken out of the others' texts.

    Keeps all columns of docs; n_chars, where there, is counted anew for a text that changed.
    """
    rows, row = numbered(docs, "rule-docs")
    profiled = materialize(profile(rows.select(named(doc_id).alias("doc_id"), named(text).alias("t"), named(host).alias("host"), F.col(row).alias("_rid")), "doc_id", "t", "host", keep="_rid"), "line-profile")
    verdicts, gone = judge(profiled, **limits)
    at, cuts = fresh(rows, "_at"), fresh(rows, "_cuts")
    drops = gone.groupBy("_rid").agg(F.collect_set("h").alias(cuts))
    kept = materialize(verdicts.where("kept").select("_rid").join(drops, "_rid", "left").withColumnRenamed("_rid", at), "rules-kept")
    release(profiled)
    whole = rows_in(rows, row, kept.where(F.col(cuts).isNull()).select(at))
    # only texts that lose lines meet the table of lines
    losing = kept.where(F.col(cuts).isNotNull())
    some = rows_in(rows, row, losing.select(at)).join(losing, F.col(row) == F.col(at))
    cut = F.array_join(F.filter(F.split(named(text), "\n"), lambda x: ~F.array_contains(cuts, F.xxhash64(normalised_line(x))) | ~x.rlike(r"[^\x20\x09-\x0D]")), "\n")
    out = {text: cut}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length(cut).cast(docs.schema["n_chars"].dataType)
    return whole.select(*columns_of(docs)).union(some.select(*[out[c].alias(c) if c in out else named(c) for c in docs.columns]))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_W = r"[\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '{_W}') IF x <> ''] AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls
  FROM documents
), windows AS (
  SELECT rid, i, a || ' ' || lead(a, 1) OVER v || ' ' || lead(a, 2) OVER v AS g
  FROM (SELECT rid, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM d) WINDOW v AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), lines AS (
  SELECT rid, doc_id, host, t, x, trim(regexp_replace(translate(x, '{UPPER}', '{UPPER.lower()}'), '{_W}', ' ', 'g')) AS k,
         len([y FOR y IN regexp_split_to_array(x, '{_W}') IF y <> '']) AS n
  FROM (SELECT rid, doc_id, host, t, unnest(ls) AS x FROM d)
), often AS (
  SELECT host, k, min(doc_id) AS first FROM lines GROUP BY host, k HAVING count(DISTINCT t) > {MAX_DOCS}
), lost AS (
  SELECT rid, sum(n) AS lost FROM lines JOIN often ON lines.k = often.k AND lines.host IS NOT DISTINCT FROM often.host WHERE doc_id IS DISTINCT FROM first GROUP BY rid
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{_W}', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS words_removed
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
), b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (words_removed > {DEPLETED_SHARE} * n_words OR (words_removed > 0 AND n_words - words_removed < {MIN_LEFT})) AS kept, words_removed
FROM b"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
