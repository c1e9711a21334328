"""Repair of the structure of conversations by a dynamic program over turns and grammar states.

Role initials must read `(s?(ua)+)?`. From the last turn back, each grammar state gets the least cost of
edits from there on; from the first turn on, a greedy walk takes the ASCII-least edit among those that
the costs to go show to be on a cheapest way. Turns are rebuilt from the edits and hashed.

A conversation of any length is worked on in blocks of turns. A block's costs are a 4 x 4 matrix
in the (min, +) algebra, so the costs to go at the blocks' ends are a scan of such products from the
end on; with them a block maps the state in which it is entered to that in which it is left, and the
states at the blocks' beginnings are a scan of these maps. Both scans run over a tree of FAN children,
so no task holds a conversation. A conversation's hash and its string of edits are made by one pass over
its lines in order, as a digest's state can't be handed over; of these only the string is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, named, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns of a block, and blocks (or groups of them) of a group.
BLOCK_TURNS = FAN = 1024
SPACES = " \t\n\x0b\x0c\r"
#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
STATES = range(4)
#: The state that a role's initial leads to, by the state before; the state that the role wanted next leads to; its name.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
FILL = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Faults of a turn; the last two must be deleted.
SOUND, CUT_OFF, BLANK, DUPLICATE = range(4)
#: Costs to go when no turn is left.
AT_END = (0, 2 * INSERT, INSERT, 0)
_NEVER = 1 << 50


def _edits(code: str, state: int, after: Sequence[int]) -> Iterator[tuple[str, int, int]]:
    """What can be done with a turn, in the order of letters: the letter, the cost to the end, the state after it."""
    fault, extra = int(code[0]), TRUNCATED if code[0] == str(CUT_OFF) else 0
    yield "D", DELETE + after[state], state
    if fault < BLANK:
        kept = KEPT.get(code[1], {}).get(state)
        if kept is not None:
            yield "K", extra + after[kept], kept
        yield "R", REROLE + extra + after[FILL[state]], FILL[state]


def before(code: str, after: Sequence[int]) -> list[int]:
    """Costs to go before a turn, of the states, from those after it. A turn's code is its fault and its initial."""
    own = [min(cost for _, cost, _ in _edits(code, g, after)) for g in STATES]
    return [min(own[g], INSERT + own[FILL[g]], 2 * INSERT + own[FILL[FILL[g]]]) for g in STATES]


def costs_to_go(codes: Sequence[str], end: Sequence[int]) -> list[Sequence[int]]:
    """Before each turn, and at the end."""
    out = [end]
    for code in reversed(codes):
        out.append(before(code, out[-1]))
    return out[::-1]


def walk(codes: Sequence[str], costs: Sequence[Sequence[int]], state: int) -> tuple[list[tuple[str, int]], int]:
    """The ASCII-least cheapest edits from a state on: for each turn what is inserted before it and done with it, and its
    cost (u, a: inserted; K; U, A: reroled; D), and the state after the last."""
    out = []
    for i, code in enumerate(codes):
        edit, cost = "", 0
        while True:
            options = [*_edits(code, state, costs[i + 1]), ("I", INSERT + costs[i][FILL[state]], FILL[state])]
            letter, _, to = min(o for o in options if o[1] == costs[i][state])
            state = to
            if letter != "I":
                break
            edit, cost = edit + NAMES[to][0], cost + INSERT
        cost += {"D": DELETE, "K": 0, "R": REROLE}[letter] + (TRUNCATED if letter != "D" and code[0] == str(CUT_OFF) else 0)
        out.append((edit + (NAMES[to][0].upper() if letter == "R" else letter), cost))
    return out, state


def closing(state: int) -> str:
    """What is inserted after the last turn."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def matrix(codes: Sequence[str]) -> list[int]:
    """Least costs from the state before the turns to that after them, row by row."""
    columns = [costs_to_go(codes, [0 if g == h else _NEVER for g in STATES])[0] for h in STATES]
    return [min(_NEVER, columns[h][g]) for g in STATES for h in STATES]


def through(m: Sequence[int], costs: Sequence[int]) -> list[int]:
    """Costs to go before a block, from those after it."""
    return [min(_NEVER, *(m[4 * g + h] + costs[h] for h in STATES)) for g in STATES]


def both(m: Sequence[int], n: Sequence[int]) -> list[int]:
    """The matrix of two blocks, one after the other."""
    columns = [through(m, [n[4 * k + h] for k in STATES]) for h in STATES]
    return [columns[h][g] for g in STATES for h in STATES]


def _per_row(make: Callable[[dict], Iterator[tuple] | list[tuple]], schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                out += make(row)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, o)) for o in out], schema)

    return run


_LONGS = pa.list_(pa.int64())


def scan(items: DataFrame, start: Sequence[int], join: Callable, carry: Callable, backward: bool, fan: int = FAN) -> DataFrame:
    """key, at, v of items (key, at, m): start, carried through all items of the key before this one, or after it if
    backward. join(m, n) is one m for two items that follow each other, carry(m, v) is v beyond an item."""
    start_ = F.array(*[F.lit(s).cast("long") for s in start])
    if not items.agg(F.max("at")).first()[0]:
        return items.select("key", "at", start_.alias("v"))
    kids = F.array_sort(F.collect_list(F.struct("at", "m"))).alias("kids")  # fan at most
    groups = materialize(items.groupBy("key", F.expr(f"at div {fan}").alias("up")).agg(kids), "groups")

    def joined(row: dict) -> list[tuple]:
        return [(row["key"], row["up"], reduce(join, [k["m"] for k in row["kids"]]))]

    def handed(row: dict) -> list[tuple]:
        out, v = [], row["v"]
        for k in reversed(row["kids"]) if backward else row["kids"]:
            out.append((row["key"], k["at"], v))
            v = carry(k["m"], v)
        return out

    tops = groups.mapInArrow(_per_row(joined, pa.schema([("key", pa.string()), ("at", pa.int64()), ("m", _LONGS)])), "key string, at long, m array<long>")
    above = scan(materialize(tops, "tops"), start, join, carry, backward, fan).withColumnRenamed("at", "up")
    return groups.join(above, ["key", "up"]).mapInArrow(_per_row(handed, pa.schema([("key", pa.string()), ("at", pa.int64()), ("v", _LONGS)])), "key string, at long, v array<long>")


def _in_order(rows: DataFrame) -> DataFrame:
    """rows with pos, from 0 in each key by turn (nulls first), role, print and row. Ranges of the whole order are numbered by
    themselves and shifted by what lies before them."""
    order = ["turn", "role", "print", "row"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "key", *order).withColumn("part", F.spark_partition_id())
    inner = materialize(dealt.withColumn("pos", F.row_number().over(W.partitionBy("key", "part").orderBy(*order)).cast("long") - 1), "ranges")
    ranges = inner.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("key", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("lower"))
    return inner.join(ranges, ["key", "part"]).withColumn("pos", F.col("pos") + F.col("lower")).drop("part", "lower")


def key_of(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_turns: int = BLOCK_TURNS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Reports and lines.

    Reports: key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation with a
    row; lines: key, pos, edit, cost, role, text of each turn in order, of which rebuilt() makes the repaired turns (edit: u and
    a for turns inserted before it, then K, U or A for a new role, or D; a line without a role ends a conversation).

    Turns follow their number, nulls first; of equal numbers role, then the SHA-256 of the text, then the order of rows
    decide, so equal rows are next to each other. A null role or text is one space: a space is no role that the grammar
    knows, and a blank text. An empty role, or any other initial, has to be replaced or deleted too. A null conversation is one
    conversation, apart from all others; key is key_of() its id. Texts of any length are looked at whole. Other columns are
    not looked at, whatever their names; an empty table gives empty results.
    """
    rows = turns.select(
        F.monotonically_increasing_id().alias("row"), key_of(named(conv)).alias("key"), named(turn).alias("turn"),
        F.coalesce(named(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(named(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("print", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    rows = materialize(rows, "turns")
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    initial = F.left("role", F.lit(1))
    ordered = _in_order(rows.select("row", "key", "turn", "role", "print", last.alias("last"), initial.alias("initial")))
    ordered = materialize(ordered, "ordered")
    first = ordered.groupBy("key", "role", "print").agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    told = ordered.join(first, ["key", "pos"], "left")
    fault = F.when(F.col("last") == "", BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("last").isin(".", "!", "?"), SOUND).otherwise(CUT_OFF)
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("?")
    told = told.select("row", "key", "pos", "turn", fault.alias("fault"), known.alias("initial"))
    told = told.withColumn("at", F.expr(f"pos div {block_turns}"))
    inside = F.array_sort(F.collect_list(F.struct("pos", "row", F.concat(F.col("fault").cast("string"), F.col("initial")).alias("code")))).alias("turns")  # block_turns at most
    blocks = materialize(told.groupBy("key", "at").agg(inside, *[F.count_if(F.col("fault") == f).alias(n) for f, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (CUT_OFF, "truncated"))]), "blocks")

    codes = F.transform("turns", lambda t: t["code"])
    bare = blocks.select("key", "at", codes.alias("codes"))
    ends = pa.schema([("key", pa.string()), ("at", pa.int64()), ("m", _LONGS)])
    matrices = bare.mapInArrow(_per_row(lambda r: [(r["key"], r["at"], matrix(r["codes"]))], ends), "key string, at long, m array<long>")
    many = bool(blocks.agg(F.max("at")).first()[0])
    after = scan(materialize(matrices, "matrices") if many else blocks, AT_END, both, through, True, fan)
    priced = bare.join(after, ["key", "at"])
    states = pa.schema([("key", pa.string()), ("at", pa.int64()), ("m", _LONGS)])

    def exits(r: dict) -> list[tuple]:
        costs = costs_to_go(r["codes"], r["v"])
        return [(r["key"], r["at"], [walk(r["codes"], costs, g)[1] if costs[0][g] < _NEVER else g for g in STATES])]

    maps = materialize(priced.mapInArrow(_per_row(exits, states), "key string, at long, m array<long>"), "maps") if many else blocks
    entered = scan(maps, [0], lambda m, n: [n[s] for s in m], lambda m, v: [m[v[0]]], False, fan).withColumnRenamed("v", "state")
    whole = blocks.select("key", "at", "turns").join(after, ["key", "at"]).join(entered, ["key", "at"])
    whole = whole.join(blocks.groupBy("key").agg(F.max("at").alias("last_at")), "key")

    def edited(r: dict) -> list[tuple]:
        own = [t["code"] for t in r["turns"]]
        done, state = walk(own, costs_to_go(own, r["v"]), r["state"][0])
        out = [(t["row"], r["key"], t["pos"], e, c) for t, (e, c) in zip(r["turns"], done, strict=True)]
        more = closing(state) if r["at"] == r["last_at"] else ""
        return [*out, (None, r["key"], out[-1][2] + 1, more, INSERT * len(more))] if more else out

    kinds = pa.schema([("row", pa.int64()), ("key", pa.string()), ("pos", pa.int64()), ("edit", pa.string()), ("cost", pa.int64())])
    edits = materialize(whole.mapInArrow(_per_row(edited, kinds), "row long, key string, pos long, edit string, cost long"), "edits")
    stays = ~F.col("edit").endswith("D")
    said = rows.select(F.col("row").alias("r"), "role", "text")
    lines = edits.join(said, F.col("row") == F.col("r"), "left").select("key", "pos", "edit", "cost", "role", F.when(stays, F.col("text")).alias("text"))
    digests = lines.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(_digests, "key string, cost long, audit string, repaired_sha256 string")

    # neighbours within a block, and the last of a block with the first of the next
    code = lambda t: F.right(t["code"], F.lit(1))
    bad = lambda pair: ~pair.isin("su", "ua", "au")
    pairs = F.transform(F.sequence(F.lit(1), F.size("turns") - 1), lambda i: F.concat(code(F.element_at("turns", i)), code(F.element_at("turns", i + 1))))
    within = F.when(F.size("turns") > 1, F.size(F.filter(pairs, bad))).otherwise(0)
    edge = blocks.select("key", "at", within.cast("long").alias("within"), code(F.element_at("turns", 1)).alias("head"), "blank", "duplicate", "truncated")
    tail = blocks.select("key", (F.col("at") + 1).alias("at"), code(F.element_at("turns", -1)).alias("tail"))
    counted = edge.join(tail, ["key", "at"], "left").withColumn("illegal", F.col("within") + F.coalesce(bad(F.concat("tail", "head")).cast("long"), F.lit(0)))
    counted = counted.groupBy("key").agg(*[F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")])
    span = ordered.groupBy("key").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    return span.join(counted, "key").join(digests, "key"), lines


def rebuilt(lines: DataFrame) -> DataFrame:
    """key, pos, place, role, text: the repaired turns of lines; their order is that of pos and place."""
    letters = F.array_compact(F.transform(F.split("edit", ""), lambda c: F.when(c.isin("", "D"), None).otherwise(c)))
    one = F.posexplode(letters).alias("place", "letter")
    out = lines.select("key", "pos", F.col("role").alias("old"), F.col("text").alias("old_text"), one)
    role = F.when(F.col("letter") == "K", F.col("old")).when(F.col("letter").isin("u", "U"), NAMES[2]).otherwise(NAMES[3])
    return out.select("key", "pos", "place", role.alias("role"), F.when(F.col("letter").isin("u", "a"), "").otherwise(F.col("old_text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lines in the order of key and pos: each key's cost, letters of edits and hash."""
    names = {"u": b"user:", "a": b"assistant:", "U": b"user:", "A": b"assistant:"}
    key, digest, audit, cost, out = None, None, bytearray(), 0, []

    def told() -> tuple:
        return key, cost, audit.decode().translate({ord("u"): "I", ord("a"): "I", ord("U"): "R", ord("A"): "R"}), digest.hexdigest()

    def result() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(("key", "cost", "audit", "repaired_sha256"), map(list, zip(*out)))), pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    for batch in batches:
        for k, edit, price, role, text in zip(*(batch.column(n).to_pylist() for n in ("key", "edit", "cost", "role", "text"))):
            if k != key or digest is None:
                if digest is not None:
                    out.append(told())
                key, digest, audit, cost, empty = k, hashlib.sha256(), bytearray(), 0, True
            cost += price
            audit += edit.encode()
            for letter in edit:
                if letter != "D":
                    digest.update((b"" if empty else b"\n") + names.get(letter, (role or "").encode() + b":"))
                    empty = False
                    if letter in "KUA":
                        digest.update(text.encode())
        if len(out) > 5000:
            yield result()
            out = []
    if digest is not None:
        out.append(told())
    if out:
        yield result()


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows damaged by crc32(`conv_id:turn`) % 20."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    rows = turns.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), times.alias("copy"))
    return rows.select("conv_id", "turn", "role", "text")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    reports, _ = repair(damage(turns))
    every = turns.select("conv_id").distinct().withColumn("k", key_of(F.col("conv_id")))
    out = every.join(reports, F.col("k") == F.col("key"), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_GAP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
WITH RECURSIVE k AS (
  SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS bytes FROM conversations
), h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
  FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h CROSS JOIN (VALUES (1), (2)) AS t(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS initial, right(rtrim(text, {_GAP}), 1) AS last FROM d
), f AS (
  SELECT *, CASE WHEN last = '' THEN 2 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 3 WHEN last IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 2) AS blank, count(*) FILTER (fault = 3) AS duplicate,
         count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), back AS (
  SELECT conv_id, n AS i, [0, {2 * INSERT}, {INSERT}, 0]::BIGINT[] AS v FROM n
  UNION ALL
  SELECT conv_id, i, list_transform([1, 2, 3, 4], lambda g: least(w[g], {INSERT} + w[([3, 3, 4, 3])[g]], {2 * INSERT} + w[([4, 4, 3, 4])[g]])) FROM (
    SELECT b.conv_id, b.i - 1 AS i, list_transform([1, 2, 3, 4], lambda g: least({DELETE} + b.v[g],
      CASE WHEN f.fault < 2 THEN {REROLE} + {TRUNCATED} * f.fault + b.v[([3, 3, 4, 3])[g]] END,
      CASE WHEN f.fault < 2 THEN {TRUNCATED} * f.fault + CASE WHEN f.initial = 's' AND g = 1 THEN b.v[2] WHEN f.initial = 'u' AND g <> 3 THEN b.v[3] WHEN f.initial = 'a' AND g = 3 THEN b.v[4] END END)) AS w
    FROM back b JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i) AS stepped
), options AS (
  SELECT f.conv_id, f.i, g, letter, CASE letter WHEN 'D' THEN g WHEN 'K' THEN CASE f.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE ([3, 3, 4, 3])[g] END AS to_g,
         CASE WHEN letter = 'K' THEN f.role || ':' || f.text WHEN letter = 'R' THEN CASE WHEN g = 3 THEN 'assistant:' ELSE 'user:' END || f.text WHEN letter = 'I' THEN CASE WHEN g = 3 THEN 'assistant:' ELSE 'user:' END END AS line
  FROM f JOIN back a ON a.conv_id IS NOT DISTINCT FROM f.conv_id AND a.i = f.i JOIN back b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i - 1
  CROSS JOIN (VALUES (1), (2), (3), (4)) AS s(g) CROSS JOIN (VALUES ('D'), ('I'), ('K'), ('R')) AS l(letter)
  WHERE CASE letter
    WHEN 'D' THEN b.v[g] = {DELETE} + a.v[g]
    WHEN 'I' THEN b.v[g] = {INSERT} + b.v[([3, 3, 4, 3])[g]]
    WHEN 'R' THEN f.fault < 2 AND b.v[g] = {REROLE} + {TRUNCATED} * f.fault + a.v[([3, 3, 4, 3])[g]]
    ELSE f.fault < 2 AND (f.initial = 's' AND g = 1 OR f.initial = 'u' AND g <> 3 OR f.initial = 'a' AND g = 3) AND b.v[g] = {TRUNCATED} * f.fault + a.v[CASE f.initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] END
), least_option AS (
  SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY conv_id, i, g ORDER BY letter) = 1
), walked AS (
  SELECT conv_id, 1::BIGINT AS i, 1 AS g, '' AS audit, []::VARCHAR[] AS lines FROM n
  UNION ALL
  SELECT w.conv_id, CASE WHEN l.letter = 'I' THEN w.i ELSE w.i + 1 END, l.to_g, w.audit || l.letter, CASE WHEN l.line IS NULL THEN w.lines ELSE list_append(w.lines, l.line) END
  FROM walked w JOIN least_option l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.i = w.i AND l.g = w.g
), finished AS (
  SELECT w.conv_id, w.audit || CASE g WHEN 2 THEN 'II' WHEN 3 THEN 'I' ELSE '' END AS audit,
         list_concat(w.lines, CASE g WHEN 2 THEN ['user:', 'assistant:'] WHEN 3 THEN ['assistant:'] ELSE [] END) AS lines
  FROM walked w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = n.n + 1
)
SELECT c.conv_id, coalesce(n.gaps, 0)::BIGINT AS gaps, coalesce(n.blank, 0)::BIGINT AS blank, coalesce(n.duplicate, 0)::BIGINT AS duplicate, coalesce(n.truncated, 0)::BIGINT AS truncated,
       coalesce(n.illegal, 0)::BIGINT AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN finished w ON w.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 0"""

QUERIES = {"op13_turn_repair": op13_turn_repair}
ORACLES = {"op13_turn_repair": SQL}
