import hashlib
import random
import re
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from recspark.llm import repair
from recspark.llm.repair import ASSISTANT, END, START, TALK, costs_before, reports, walk

FORM = re.compile(r"(s?(ua)+)?\Z")
NO = 10**6


def cheapest(codes):
    """(cost, audit) by trying all edit strings, the shortest first; only for few rows."""
    best = None
    per_row = [["D"] + ([] if c // 4 >= 2 else ["K", "R"]) for c in codes]
    slots = len(codes) + 1
    for rows in product(*per_row):
        for adds in product(range(3), repeat=slots):
            for targets in product("ua", repeat=rows.count("R") + sum(adds)):
                chosen, said, audit, cost = iter(targets), "", "", 0
                for i in range(slots):
                    for _ in range(adds[i]):
                        said, audit, cost = said + next(chosen), audit + "I", cost + 3
                    if i < len(codes):
                        audit += rows[i]
                        if rows[i] == "D":
                            cost += 4
                        else:
                            said += "sua?"[codes[i] % 4] if rows[i] == "K" else next(chosen)
                            cost += 3 * (rows[i] == "R") + 3 * (codes[i] // 4 == 1)
                if FORM.match(said) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_walk_is_cheapest_and_ascii_least_on_all_short_dialogues():
    codes = [f * 4 + c for f in range(4) for c in range(4)]
    for n in range(3):
        for row in product(codes, repeat=n):
            audit, state, costs = walk(bytes(row))
            while END[state]:
                audit, state = audit + "I", TALK[state]
            assert (costs[START], audit) == cheapest(row), row
    rng = random.Random(3)
    for _ in range(12):
        row = [rng.choice(codes) for _ in range(3)]
        audit, state, costs = walk(bytes(row))
        while END[state]:
            audit, state = audit + "I", TALK[state]
        assert (costs[START], audit) == cheapest(row), row


def forward(rows):
    """Row by row: of each state the cheapest (cost, audit, turns). Rows: (turn, role, text)."""
    seen, faults, best = set(), [], {"": (0, "", ())}
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    follow = {"": "u", "s": "u", "a": "u", "u": "a"}
    speaker = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(2):
            for state, (cost, audit, turns) in list(best.items()):
                to = follow[state]
                best[to] = min(best.get(to, (NO,)), (cost + 3, audit + "I", (*turns, (speaker[to], ""))))
        return best

    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        extra, after = 3 * (fault == "truncated"), {}

        def offer(state, value):
            after[state] = min(after.get(state, (NO,)), value)

        for state, (cost, audit, turns) in inserted(best).items():
            offer(state, (cost + 4, audit + "D", turns))
            if fault not in ("blank", "duplicate"):
                if role[:1] and (role[:1] == follow[state] or (role[0] == "s" and state == "")):
                    offer(role[0], (cost + extra, audit + "K", (*turns, (role, text))))
                offer(follow[state], (cost + 3 + extra, audit + "R", (*turns, (speaker[follow[state]], text))))
        best = after
    best = inserted(best)
    cost, audit, turns = min(best[q] for q in ("", "a") if q in best)
    initials = [r[1][:1] for r in rows]
    numbers = {r[0] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    said = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), turns


def sample(n=60, seed=5):
    rng = random.Random(seed)
    texts = ["Good.", "cut", "Why? \n", "", " \t", "ok!", "é.", "...", "no stop ", "x" * 40000 + ".", None]
    rows = []
    for conv in [*range(n), None]:
        for i in range(rng.choice([0, 1, 2, 3, 8, 20])):
            turn = rng.choice([i, i, i, rng.randrange(30), None, -3])
            rows.append((conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def by_conversation(rows):
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, " " if role is None else role, " " if text is None else text))
    return grouped


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, pos int").repartition(3)


def test_reports_and_turns_equal_a_forward_walk(spark):
    rows = sample()
    df = frame(spark, rows)
    want = {conv: forward(of) for conv, of in by_conversation(rows).items()}
    got = {r.conv_id: tuple(r)[1:] for r in reports(df).collect()}
    assert got == {conv: w[0] for conv, w in want.items()}
    turns = defaultdict(list)
    for r in repair.repair(df).orderBy("pos", "seq").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert dict(turns) == {conv: list(w[1]) for conv, w in want.items() if w[1]}
    assert reports(df.limit(0)).collect() == [] == repair.repair(df.limit(0)).collect()


def test_conversations_over_many_ranges(spark):
    """One conversation holds most rows: it is cut into ranges, and costs and states are linked across them."""
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "system"]), rng.choice([f"t{i}.", f"t{i % 300}.", "cut", "", f"{i}"])) for i in range(900)]
    rows += [(None, i, "user" if i % 3 else "assistant", f"n{i}.") for i in range(400)] + [r for r in sample(20, 9) if r[0] is not None and r[0] > 1]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, rows)
        codes = repair.faults(repair.plain_turns(df))[1]
        assert codes.where("conv = 1").selectExpr("shiftright(pos, 33)").distinct().count() > 2
        want = {conv: forward(of) for conv, of in by_conversation(rows).items()}
        assert {r.conv_id: tuple(r)[1:] for r in reports(df).collect()} == {conv: w[0] for conv, w in want.items()}
        turns = repair.repair(df).where("conv_id = 1").orderBy("pos", "seq").select("role", "text").collect()
        assert [tuple(r) for r in turns] == list(want[1][1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_checkpoints_are_few_and_costs_add_up():
    rng = random.Random(2)
    codes = bytes(rng.randrange(16) for _ in range(20000))
    audit, state, costs = walk(codes)
    assert costs == costs_before(codes) and len(re.sub("I", "", audit)) == len(codes) and state in (START, TALK[ASSISTANT], ASSISTANT)
    price = {"D": 4, "I": 3, "K": 0, "R": 3}
    edits = re.sub("I", "", audit)
    assert costs[START] == sum(price[e] for e in audit) + sum(3 for e, c in zip(edits, codes) if e != "D" and c // 4 == 1) + END[state]


@pytest.mark.parametrize("lots", [range(20)])
def test_damage_follows_the_lots(spark, lots):
    import zlib

    rows = [(c, t, "assistant", f"One {t}. Two!") for c in [*range(30), None] for t in [0, 1, 2, None]]
    got = sorted(repair.damaged(frame(spark, rows)).select(F.col("conv_id"), "turn", "role", "text").collect(), key=str)
    want = []
    for conv, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        assert lot in lots
        row = (conv, turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(lot, 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
