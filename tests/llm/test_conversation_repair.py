import hashlib
import itertools
import random
import re
import zlib

import pytest

from tablesmith.llm.conversation_repair import STACKS, damage_report, damaged, edited, repair, step, transcript_hashes, with_inserts
from tablesmith.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, difference

SCHEMA = "conv_id long, turn long, role string, text string, conv string, no int"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def shown(v):
    return " " if v is None else str(v)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """Over whole histories: state of the role automaton to the best (cost, audit, turns), with up to two insertions at each place."""
    move = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    names = {"u": "user", "a": "assistant"}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for st, (c, audit, turns) in list(out.items()):
                for r in "ua":
                    if (st, r) in move:
                        w = (c + 3, audit + "I", [*turns, (names[r], "")])
                        out[move[st, r]] = min(out.get(move[st, r], w), w, key=lambda x: x[:2])
        return out

    ways = {"": (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(st, w):
            new[st] = min(new.get(st, w), w, key=lambda x: x[:2])

        for st, (c, audit, turns) in inserted(ways).items():
            offer(st, (c + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if (st, role[:1]) in move:
                offer(move[st, role[:1]], (c + more, audit + "K", [*turns, (role, text)]))
            for r in "ua":
                if (st, r) in move:
                    offer(move[st, r], (c + 3 + more, audit + "R", [*turns, (names[r], text)]))
        ways = new
    return min((w for st, w in inserted(ways).items() if st in ("", "a")), key=lambda x: x[:2])


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(own)
        cost, audit, turns = cheapest(own, faults)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        said = "\n".join(f"{r}:{t}" for r, t in turns)
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)


def some_rows(rng, conversations, turns):
    texts = ["Yes.", "No!", "Why?", "well", " \n", "", "Ends. \t", "Same.", None, "a:b\nc."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "assist"]
    rows = []
    for c in range(conversations):
        for t in range(rng.randint(1, turns)):
            rows.append((c, None if rng.random() < 0.05 else t + (rng.random() < 0.1), rng.choice(roles[:4] if rng.random() < 0.7 else roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}."))
    return rows


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_against_histories(spark, block):
    rows = some_rows(random.Random(3), 150, 12) + [(None, t, r, x) for t, r, x in [(0, "user", "Hi."), (1, "user", "Again."), (None, "system", "Be kind.")]]
    rows += [(9007199254740993, 5, "user", "Large."), (9007199254740993, 9007199254740995, "assistant", "Turn.")]
    report, repaired = repair(frame(spark, rows), block)
    hashes = {r.conv_id: r.repaired_sha256 for r in transcript_hashes(repaired).collect()}
    got = {r.conv_id: (*[r[c] for c in COLUMNS], hashes[r.conv_id]) for r in report.collect()}
    assert got == brute([(c, t, shown(r), shown(x)) for c, t, r, x in rows])
    turns = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.part, r.no)):
        turns.setdefault(r.conv_id, []).extend(t.role[0] for t in r.turns)
    assert all(GRAMMAR.fullmatch("".join(x)) for x in turns.values())


def test_damage(spark):
    rows = [r for r in some_rows(random.Random(8), 200, 10)]
    got = {r.conv_id: tuple(r[c] for c in [*COLUMNS, "repaired_sha256"]) for r in damage_report(frame(spark, rows)).collect()}
    left = brute(damage(rows))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: left.get(c, empty) for c in {r[0] for r in rows}}
    assert empty in got.values() or len(left) == len(got)
    assert sorted(map(str, damaged(frame(spark, rows)).select("conv_id", "turn", "role", "text").collect())) == sorted(f"Row(conv_id={c!r}, turn={t!r}, role={r!r}, text={x!r})" for c, t, r, x in damage(rows))


def test_every_edit_row_is_found():
    """Short conversations against all edit rows of up to six letters."""
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 3)
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), "") for i in range(n)]
        faults = [rng.choice([None, None, "truncated", "blank"]) for _ in rows]
        tops = {"0": (0, "")}
        for r, f in zip(rows, faults):
            tops = step(tops, r[2][:1], f)
        best = min(w for s, w in with_inserts(tops).items() if s in ("0", "0H"))
        found = []
        for size in range(n, n + 4):
            for audit in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in audit) != n:
                    continue
                cost, roles, at = 0, [""], iter(zip(rows, faults))
                for e in audit:
                    if e == "I":
                        cost, roles = cost + 3, [x + r for x in roles for r in "ua"]
                        continue
                    row, fault = next(at)
                    cost += (4 if e == "D" else 3 if e == "R" else 0) + (3 if e != "D" and fault == "truncated" else 0)
                    if fault == "blank" and e != "D":
                        roles = []
                    roles = roles if e == "D" else [x + row[2][0] for x in roles] if e == "K" else [x + r for x in roles for r in "ua"]
                if any(GRAMMAR.fullmatch(x) for x in roles):
                    found.append((cost, "".join(audit)))
        assert best == min(found)


def test_one_long_conversation(spark):
    """It spreads over tasks, whose stretches meet at any state."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"{t}." if rng.random() < 0.8 else "same") for t in range(700)] + [(c, 0, "user", "Hi.") for c in range(2, 80)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        report, repaired = repair(frame(spark, rows), 40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert repaired.where("conv_id = 1").select("part").distinct().count() > 1
    hashes = {r.conv_id: r.repaired_sha256 for r in transcript_hashes(repaired).collect()}
    assert {r.conv_id: (*[r[c] for c in COLUMNS], hashes[r.conv_id]) for r in report.collect()} == brute(rows)


def test_odd_rows(spark):
    assert damage_report(frame(spark, [])).collect() == []
    rows = [(1, None, None, None), (2, 3, "user", "x" * 200_000), (3, 1, "user", "Twice.")] + [(3, 1, "user", "Twice.")] * 40
    report, repaired = repair(frame(spark, rows))
    got = {r.conv_id: r for r in report.collect()}
    assert (got[1].audit, got[1].blank, got[1].gaps) == ("D", 1, 0) and got[2].audit == "D"
    assert (got[3].duplicate, got[3].illegal, got[3].audit) == (40, 40, "K" + "D" * 40 + "I")
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in repaired.collect()}
    assert turns == {1: [], 2: [], 3: [("user", "Twice."), ("assistant", "")]}
    assert edited([], "0U", "I") == [{"role": "assistant", "text": ""}] and len(STACKS) == 6


def test_query(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert difference(QUERIES["op12_conversation_repair"](spark, sf), connect(sf), ORACLES["op12_conversation_repair"]) is None
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = brute(damage(rows))
    got = {r.conv_id: r for r in QUERIES["op12_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == {r[0] for r in rows} and all(tuple(got[c][k] for k in [*COLUMNS, "repaired_sha256"]) == want for c, want in left.items())
