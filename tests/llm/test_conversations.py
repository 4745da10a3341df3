"""Operator 11 against every sequence of edits, and its query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from moderato.llm import conversation_repair as cr

RIGHT = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"
ROLES = ["system", "user", "assistant", "tool", " "]


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        kept = text.rstrip(SPACE)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns, costs=cr.Costs()):
    """Least (cost, audit) and its lines, by trying all edits with up to two turns inserted at each place."""
    said = faults(turns)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    ways = []
    for (role, text), fault in zip(turns, said, strict=True):
        row = [("D", None, None, costs.delete)]
        if fault not in ("blank", "duplicate"):
            more = costs.truncated if fault == "truncated" else 0
            row += [("K", role, text, more)] + [("R", r, text, costs.rerole + more) for r in ("user", "assistant")]
        ways.append(row)
    best = None
    for chosen in itertools.product(*ways):
        for added in itertools.product(inserts if costs.insert < 5 else [[]], repeat=len(turns) + 1):
            lines, audit, cost = [], "", 0
            for i in range(len(turns) + 1):
                lines += [(r, "") for r in added[i]]
                audit, cost = audit + "I" * len(added[i]), cost + costs.insert * len(added[i])
                if i < len(turns):
                    letter, role, text, c = chosen[i]
                    audit, cost = audit + letter, cost + c
                    if letter != "D":
                        lines.append((role, text))
            if RIGHT.fullmatch("".join(r[:1] or "?" for r, _ in lines)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, lines)
    return best


def told(conv, turns):
    """The whole row that the operator should give for ``(turn, role, text)`` in order."""
    said = faults([t[1:] for t in turns])
    cost, audit, lines = cheapest([t[1:] for t in turns]) if turns else (0, "", [])
    nums = [t[0] for t in turns if t[0] is not None]
    odd = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    return (conv, max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0, said.count("blank"), said.count("duplicate"),
            said.count("truncated"), odd, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def some_talks(n, seed):
    rng = random.Random(seed)
    texts = ["Hello there.", "Right!", "what", "", " \t", "Why?\n", "Ü", "no end ", "a.b"]
    return [(c, rng.choice([None, *range(6)]), rng.choice(ROLES if rng.random() < .5 else ROLES[:3]), rng.choice(texts))
            for c in [*range(n), None] for _ in range(rng.randrange(7))]


@pytest.mark.parametrize("spill", [cr.SPILL_BYTES, 1])
def test_every_sequence_of_edits(spark, spill):
    rows = some_talks(60, 3)
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows],
                               "conv_id long, turn int, role string, text string, conv string, known int, gone string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {tuple(r) for r in cr.repair_conversations(df, spill_bytes=spill).collect()}
        turns = cr.repair_conversations(df, turns=True, spill_bytes=spill).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {told(c, in_order([r[1:] for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want
    audits = {r[0]: r[-2:] for r in got}
    for conv, (audit, sha) in audits.items():
        mine = sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.place)
        assert "".join(r.edit for r in mine) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == sha


def test_inserting_when_it_is_cheap():
    rng = random.Random(8)
    for _ in range(50):
        costs = cr.Costs(rerole=rng.randrange(1, 5), delete=rng.randrange(2, 6), insert=rng.randrange(1, 4), truncated=rng.randrange(4))
        turns = [(rng.choice(ROLES[:4]), rng.choice(["a.", "b.", "c", "d!", ""])) for _ in range(rng.randrange(1, 3))]
        talk = cr.Conversation(cr.Plan(costs))
        for (role, text), fault in reversed(list(zip(turns, faults(turns), strict=True))):
            talk.add(0, role, text, text.rstrip(SPACE)[-1:], fault == "duplicate")
        got = talk.summary()
        cost, audit, lines = cheapest(turns, costs)
        # the plain version inserts once at a place; two there make a pair, which is never cheaper than none
        assert (got[5], got[6]) == (cost, audit)
        assert got[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_giant_conversation(spark):
    """Most rows in one conversation: same result, with its turns in the task's file."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id")).alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.col("id").cast("string"), F.lit(" said.")).alias("text"))
    small, big = (cr.repair_conversations(rows, spill_bytes=b).orderBy("conv_id").collect() for b in (20_000, cr.SPILL_BYTES))
    assert small == big and len(small) == 10_001
    one = next(r for r in small if r.conv_id == 7)
    assert len(one.audit) == 20_000 and one.gaps == 29_998 + 1 - 20_000 and one.duplicate == 0


def test_query_against_plain_python(spark, tmp_path):
    rows = some_talks(120, 9)
    rows += [(1000 + i, None, None, None) for i in range(30)] + [(None, None, None, None)]
    rows += [(2000, 1, "user", "x" * 200_000 + "."), (2000, 2, "assistant", "ok.")]
    path = str(tmp_path)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    want = set()
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        want.add(told(conv, in_order(kept)))
    got = cr.op11_conversation_repair(spark, path)
    assert {tuple(r) for r in got.collect()} == want
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/none/conversations.parquet")
    assert cr.op11_conversation_repair(spark, f"{path}/none").collect() == []


def test_one_shuffle(spark):
    df = cr.op11_conversation_repair(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
