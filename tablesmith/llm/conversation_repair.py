"""Conversations repaired to the role grammar: generalised LR parsing with weighted edits.

Role initials of a repaired conversation are ``(s?(ua)+)?``. As a grammar: C -> (nothing) | H, H -> P | s P | H P, P -> u a. A parser's stacks share
what lies below their tops; every row is kept, given another role or deleted, and turns are inserted before it, and each
action shifts its role and reduces. Equal stacks merge to the one of the smallest (cost, audit); the audit is the edits' initials. Of two equal stacks after the same
row, no audit can be a start of the other at the same cost, so the smaller one stays smaller whatever follows, and merging loses nothing.

Costs: keep 0, rerole to user or assistant 3, delete 4 (blank and duplicate rows must go), insert a turn without text 3; a truncated row
that stays adds 3. A row's first fault counts: blank (white space alone), duplicate (role and text seen earlier), truncated (the last sign that is not white space is none of ``.!?``).

Scale: rows are cut by range of (conversation, turn, role, text), so a conversation of any length spreads over tasks, and each task parses its stretch in blocks
of at most ``BLOCK`` rows. A block that may not be a conversation's first is parsed from each of the six stacks that can stand before it; a
conversation's blocks are then put together from their (stack before, stack after, cost, audit) and the chosen edits go back to the blocks. Rows that agree in everything are one row with a count.
One task sees a row per block of a conversation, never its turns.

Defined cases: null roles and texts are one space; null turns come first, rows of one turn are ordered by role, then text (its first 64 characters, then its
hash). Null conversation identifiers are one conversation. Empty texts are blank; very long ones are read whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, new_path
from .common import only, salted_lookup

BLOCK = 1_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\f\r"
# LR table of the grammar; a stack is a string of states, each beginning with "0"
SHIFT = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("H", "u"): "U", ("U", "a"): "A"}
REDUCE = {"A": ("P", 2), "p": ("H", 1), "q": ("H", 2), "r": ("H", 2)}
GOTO = {("0", "P"): "p", ("S", "P"): "q", ("H", "P"): "r", ("0", "H"): "H"}
STACKS = ["0", "0S", "0H", "0U", "0SU", "0HU"]
ACCEPT = {"0", "0H"}
Parse = dict[str, tuple[int, str]]


def shift(stack: str, role: str) -> str | None:
    """The stack after a role's initial and all reductions; None if the grammar has no such turn there."""
    state = SHIFT.get((stack[-1], role))
    if state is None:
        return None
    stack += state
    while stack[-1] in REDUCE:
        symbol, n = REDUCE[stack[-1]]
        stack = stack[:-n]
        stack += GOTO[stack[-1], symbol]
    return stack


NEXT = {(s, r): t for s in STACKS for r in "sua" if (t := shift(s, r))}


def _offer(tops: Parse, stack: str, way: tuple[int, str]) -> bool:
    if stack in tops and tops[stack] <= way:
        return False
    tops[stack] = way
    return True


def with_inserts(tops: Parse) -> Parse:
    """Also what inserted turns lead to."""
    out, new = dict(tops), list(tops)
    while new:
        stack = new.pop()
        cost, audit = out[stack]
        for role in "ua":
            after = NEXT.get((stack, role))
            if after and _offer(out, after, (cost + INSERT, audit + "I")):
                new.append(after)
    return out


def step(tops: Parse, initial: str, fault: str | None) -> Parse:
    """One row: deleted, kept or given another role, after any inserted turns."""
    out: Parse = {}
    extra = TRUNCATED if fault == "truncated" else 0
    for stack, (cost, audit) in with_inserts(tops).items():
        _offer(out, stack, (cost + DELETE, audit + "D"))
        if fault in ("blank", "duplicate"):
            continue
        if (stack, initial) in NEXT:
            _offer(out, NEXT[stack, initial], (cost + KEEP + extra, audit + "K"))
        for role in "ua":
            if (stack, role) in NEXT:
                _offer(out, NEXT[stack, role], (cost + REROLE + extra, audit + "R"))
    return out


def rows_with_faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, copies, blank, duplicate, truncated), one row for all that agree; ``duplicate`` counts the copies that are."""
    r = only(rows, conv="conv_id", turn="turn", role="role", text="text")
    r = r.select(F.col("conv").cast("string"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    r = r.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    r = r.withColumn("digest", F.md5(F.concat_ws(":", F.length("role"), "role", "text")))
    rank = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = r.groupBy("conv", "digest").agg(F.min(rank).alias("first"))
    r = salted_lookup(r, first, ["conv", "digest"], F.xxhash64("turn")).withColumn("late", ~F.col("first").eqNullSafe(rank))
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    r = r.withColumn("blank", end == "").withColumn("late", F.col("late") & ~F.col("blank"))
    again = F.when(F.col("blank"), 0).when(F.col("late"), F.col("copies")).otherwise(F.col("copies") - 1)
    return r.select("conv", "turn", "role", "text", "copies", "blank", again.alias("duplicate"), (~end.isin(".", "!", "?") & ~F.col("blank") & ~F.col("late")).alias("truncated"))


def faults(row) -> Iterator[str | None]:
    for i in range(row["copies"]):
        yield "blank" if row["blank"] else "duplicate" if i >= row["copies"] - row["duplicate"] else "truncated" if row["truncated"] else None


ROW = "struct<turn:long,role:string,text:string,copies:long,blank:boolean,duplicate:long,truncated:boolean>"
WAYS = "array<struct<before:string,after:string,cost:long,audit:string>>"


def parse_blocks(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """Sorted rows to blocks: (conv, part, no, rows, head, tail, illegal, ways)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    columns = ["conv", "part", "no", "rows", "head", "tail", "illegal", "ways"]
    held: list[dict] = []
    conv, no, opens = None, 0, True  # whether a conversation may have begun in another task

    def made() -> tuple:
        first = no == 0 and not opens
        illegal, initials = 0, [r["role"][:1] for r in held]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        illegal += sum((r["copies"] - 1) * (i + i not in LEGAL) for r, i in zip(held, initials))
        ways = []
        for before in STACKS[:1] if first else STACKS:
            tops: Parse = {before: (0, "")}
            for r, i in zip(held, initials):
                for fault in faults(r):
                    tops = step(tops, i, fault)
            ways += [{"before": before, "after": after, "cost": cost, "audit": audit} for after, (cost, audit) in tops.items()]
        return conv, part, no, held, initials[0], initials[-1], illegal, ways

    for b in batches:
        out = []
        for r in b.to_dict("records"):
            own = r.pop("conv")
            r["turn"] = None if r["turn"] is None else int(r["turn"])
            if held and (own != conv or len(held) >= block):
                out.append(made())
                no = no + 1 if own == conv else 0
                opens = opens and own == conv
                held = []
            conv = own
            held.append(r)
        if out:
            yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([made()], columns=columns)


class Way:
    """The cheapest ways through a conversation's blocks so far, by the stack they leave."""

    def __init__(self) -> None:
        self.state: dict[str, tuple[int, str, tuple | None]] = {"0": (0, "", None)}
        self.illegal, self.tail = 0, None

    def add(self, part: int, no: int, head: str, tail: str, illegal: int, ways) -> None:
        self.illegal += illegal + (self.tail is not None and self.tail + head not in LEGAL)
        self.tail = tail
        after: dict[str, tuple[int, str, tuple | None]] = {}
        for w in ways:
            if w["before"] not in self.state:
                continue
            cost, audit, path = self.state[w["before"]]
            cost += w["cost"]
            best = after.get(w["after"])
            if best is None or cost < best[0] or (cost == best[0] and audit + w["audit"] < best[1]):
                after[w["after"]] = (cost, audit + w["audit"], (path, part, no, w["before"], w["audit"]))
        self.state = after

    def end(self) -> tuple[int, str, int, list[dict]]:
        """(cost, audit, illegal, edits per block), after turns that are inserted at the end."""
        ends = []
        for stack, (cost, audit, path) in self.state.items():
            for end, (more, inserted) in with_inserts({stack: (0, "")}).items():
                if end in ACCEPT:
                    ends.append((cost + more, audit + inserted, path, inserted))
        cost, audit, path, inserted = min(ends, key=lambda e: e[:2])
        edits = []
        while path is not None:
            path, part, no, before, own = path
            edits.append({"part": part, "no": no, "before": before, "edits": own + inserted})
            inserted = ""
        return cost, audit, self.illegal, edits


def put_together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order, conversation after conversation, to (conv, cost, audit, illegal, edits)."""
    columns = ["conv", "cost", "audit", "illegal", "edits"]
    conv, way = None, None
    for b in batches:
        out = []
        for own, *block in zip(*(b[c] for c in ("conv", "part", "no", "head", "tail", "illegal", "ways"))):
            if way is None or own != conv:
                if way is not None:
                    out.append((conv, *way.end()))
                conv, way = own, Way()
            way.add(*block)
        yield pd.DataFrame(out, columns=columns)
    if way is not None:
        yield pd.DataFrame([(conv, *way.end())], columns=columns)


def edited(rows, before: str, edits: str) -> list[dict[str, str]]:
    """The turns that a block's edits leave."""
    out, stack, letters = [], before, iter(edits)
    expected = lambda: "a" if stack[-1] == "U" else "u"

    def put(role: str, text: str, initial: str) -> None:
        nonlocal stack
        stack = NEXT[stack, initial]
        out.append({"role": role, "text": text})

    for r in rows:
        for _ in range(r["copies"]):
            while (e := next(letters)) == "I":
                put(ROLES[expected()], "", expected())
            if e == "K":
                put(r["role"], r["text"], r["role"][:1])
            elif e == "R":
                put(ROLES[expected()], r["text"], expected())
    for _ in letters:
        put(ROLES[expected()], "", expected())
    return out


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (conv_id, turn, role, text).

    First result, a row per conversation: conv_id, gaps (turn numbers missing between the smallest and the largest), blank, duplicate, truncated, illegal
    (neighbours whose roles may not follow one another), cost, audit. Second, the repaired turns: conv_id, part, no (order of a conversation's blocks), turns
    (role and text, in order).
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["conv_id"]
    r = cut_lineage(rows_with_faults(rows))
    key = ["conv", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64), F.xxhash64("text")]
    ordered = r.repartitionByRange(*key).sortWithinPartitions(*key)
    fields = ["turn", "role", "text", "copies", "blank", "duplicate", "truncated"]
    # a turn as text: with nulls pandas would make it a float
    blocks = ordered.select("conv", F.col("turn").cast("string"), *fields[1:]).mapInPandas(
        lambda b: parse_blocks(b, block), f"conv string, part int, no int, rows array<{ROW}>, head string, tail string, illegal long, ways {WAYS}"
    )
    path = new_path(spark, "conversation-blocks")
    blocks.write.parquet(path)
    blocks = spark.read.parquet(path)
    ways = blocks.select("conv", "part", "no", "head", "tail", "illegal", "ways")
    in_order = ways.repartition("conv").sortWithinPartitions("conv", "part", "no")
    solved = in_order.mapInPandas(put_together, "conv string, cost long, audit string, illegal long, edits array<struct<part:int,no:int,before:string,edits:string>>")
    solved = cut_lineage(solved)
    counted = r.withColumn("blank", F.when(F.col("blank"), F.col("copies")).otherwise(0)).withColumn("truncated", F.col("truncated").cast("long"))
    by_turn = counted.groupBy("conv", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    found = by_turn.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    s, f = solved.alias("s"), found.alias("f")
    report = s.join(f, F.col("s.conv").eqNullSafe(F.col("f.conv"))).select(F.col("s.conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["turns"] = [edited(r, s, e) for r, s, e in zip(b["rows"], b["before"], b["edits"])]
            yield b[["conv", "part", "no", "turns"]]

    e = solved.select("conv", F.explode("edits").alias("e")).select("conv", "e.*").alias("e")
    b = blocks.select("conv", "part", "no", "rows").alias("b")
    same = F.col("e.conv").eqNullSafe(F.col("b.conv")) & (F.col("e.part") == F.col("b.part")) & (F.col("e.no") == F.col("b.no"))
    chosen = b.join(e, same).select("b.conv", "b.part", "b.no", "rows", "before", "edits")
    repaired = chosen.mapInPandas(apply, "conv string, part int, no int, turns array<struct<role:string,text:string>>")
    return report, repaired.select(F.col("conv").cast(kind).alias("conv_id"), "part", "no", "turns")


def transcript_hashes(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the newline-joined ``role:text``; blocks are hashed as they stream by, in order."""
    kind = dict(repaired.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, digest, begun, any_row = None, None, False, False
        for b in batches:
            out = []
            for own, piece in zip(b["conv"], b["piece"]):
                if not any_row or own != conv:
                    if any_row:
                        out.append((conv, digest.hexdigest()))
                    conv, digest, begun, any_row = own, hashlib.sha256(), False, True
                if piece is not None:
                    digest.update((("\n" if begun else "") + piece).encode("utf-8", "surrogatepass"))
                    begun = True
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if any_row:
            yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])

    piece = F.when(F.size("turns") > 0, F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n"))
    pieces = repaired.select(F.col("conv_id").cast("string").alias("conv"), "part", "no", piece.alias("piece"))
    hashed = pieces.repartition("conv").sortWithinPartitions("conv", "part", "no").select("conv", "piece").mapInPandas(run, "conv string, repaired_sha256 string")
    return hashed.select(F.col("conv").cast(kind).alias("conv_id"), "repaired_sha256")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows damaged by their key's crc32: dropped, emptied, without full stops, twice, or given to the user."""
    r = only(rows, conv_id="conv_id", turn="turn", role="role", text="text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    r = r.withColumn("kind", F.crc32(key) % 20).where("kind <> 0")
    r = r.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
    r = r.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(role))
    return r.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def damage_report(rows: DataFrame) -> DataFrame:
    """Damages conversations and repairs them: one row per original conv_id, zeros and an empty text's hash where no row is left."""
    report, repaired = repair(damaged(rows))
    ids = rows.select("conv_id").distinct().alias("i")
    o, h = report.alias("o"), transcript_hashes(repaired).alias("h")
    found = ids.join(o, F.col("i.conv_id").eqNullSafe(F.col("o.conv_id")), "left").join(h, F.col("i.conv_id").eqNullSafe(F.col("h.conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("i.conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
