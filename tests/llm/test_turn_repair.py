"""op13 against SQL (test_contracts) and a search over all edits."""

import hashlib
import heapq
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import turn_repair as t

KIND = "conv_id string, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def cheapest(rows):
    """The report of rows in order, by a search that knows of no table of costs: least cost, then least letters."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0d]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, initials, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            break
        if (i, state := re.sub(r"(ua)+", "ua", initials)) in done:
            continue
        done.add((i, state))
        if not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        for name in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, initials + name[0], (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, initials, lines))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, initials + name[0], (*lines, f"{name}:{text}")))
    numbers = [n for n, _, _ in rows if n is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum((a[1][:1] or "?") + (b[1][:1] or "?") not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def in_order(rows):
    own = [(n, " " if r is None else r, " " if x is None else x) for n, r, x in rows]
    return sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))


def some(seed, n):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant"] * 5 + ["system", "tool", "", None], ["Yes.", "No!", "What?", "cut", " \t", "", None, "Dot.\n ", "end.)"]
    turn = lambda i: rng.choice([i, i, i, None, 3])
    return [(turn(i), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.random()}{rng.choice('.!?x')}") for i in range(n)]


@pytest.mark.parametrize("block_turns, fan", [(1024, 1024), (3, 2), (1, 3)])
def test_reports_match_a_search_over_all_edits(spark, block_turns, fan):
    convs = {str(k): some(k, n) for k, n in enumerate([0, 1, 1, 2, 3, 4, 5, 7, 9, 14, 23, 31])} | {None: some(99, 6), "": some(98, 5)}
    rows = [(c, *r) for c, own in convs.items() for r in own]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, KIND).withColumns({"key": F.lit("k"), "pos": F.lit(1), "a.b": F.lit(2), "fault": F.lit(0)})
    reports, lines = t.repair(turns, block_turns=block_turns, fan=fan)
    got = {r.key: tuple(r[c] for c in COLUMNS) for r in reports.collect()}
    want = {"" if c is None else f"={c}": cheapest(in_order(own)) for c, own in convs.items() if own}
    assert got == want
    made = {}
    for r in sorted(t.rebuilt(lines).collect(), key=lambda r: (r.key, r.pos, r.place)):
        made.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    for k, w in want.items():
        assert hashlib.sha256("\n".join(made.get(k, [])).encode()).hexdigest() == w[-1]
        assert re.fullmatch(r"(s?(ua)+)?", "".join(line[0] for line in made.get(k, [])))


def test_a_conversation_of_many_turns_and_many_copies(spark):
    rows = [("long", i % 700, ("user", "assistant")[i % 2], f"Turn {i % 1500}.") for i in range(4000)] + [("copies", 1, "user", "Hi.")] * 3000 + [("one", 0, "user", "word " * 100_000)]
    reports, _ = t.repair(spark.createDataFrame(rows, KIND), block_turns=64, fan=8)
    got = {r.key: tuple(r[c] for c in COLUMNS) for r in reports.collect()}
    assert got["=copies"] == (0, 0, 2999, 0, 2999, 2999 * 4 + 3, "K" + "D" * 2999 + "I", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    own = in_order([r[1:] for r in rows if r[0] == "long"])
    codes, seen = [], set()
    for _, role, text in own:
        codes.append(("3" if (role, text) in seen else "0") + role[0])
        seen.add((role, text))
    costs = t.costs_to_go(codes, t.AT_END)
    edits, state = t.walk(codes, costs, 0)
    audit = "".join(re.sub("[ua]", "I", re.sub("[UA]", "R", e)) for e, _ in edits) + "I" * len(t.closing(state))
    assert got["=long"][5] == costs[0][0] and got["=long"][6] == audit and got["=one"][3:6] == (1, 0, 4)


def test_empty_tables_and_vanished_conversations(spark, tmp_path):
    none = spark.createDataFrame([], KIND)
    reports, lines = t.repair(none)
    assert reports.count() == 0 and t.rebuilt(lines).count() == 0
    kind = "conv_id long, turn long, role string, text string"
    # crc32("14:0") % 20 and others of the row's own decide; a conversation whose rows are all dropped stays with zeros
    rows = [(i, 0, "user", "Yes.") for i in range(60)] + [(None, None, None, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in t.op13_turn_repair(spark, str(tmp_path)).collect()}
    assert len(out) == 61
    gone = [r for r in out.values() if r.audit == ""]
    assert gone and all(r.repaired_sha256 == hashlib.sha256().hexdigest() and r.cost == 0 for r in gone)
