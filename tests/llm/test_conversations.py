"""Conversation repair against a plain search over all edits, in one and in several chunks."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from quillmart.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    out, ids = [], {r[0] for r in rows}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(x for x in text if x not in ".!?")
        if kind == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if kind == 3 else 1)
    return ids, out


def judge(turns, delete=2, rerole=1):
    """turns: (turn, role, text) in order. Cheapest edits by search over every state, each step tried in full."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def takes(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def best(i, state, inserted):
        """Least (cost, audit, lines) from turn i on; an insertion may follow at most two others."""
        options = []
        if inserted < 3:
            for role in ("user", "assistant"):
                if new := takes(state, role[0]):
                    c, a, lines = best(i, new, inserted + 1)
                    options.append((c + 5, "I" + a, (f"{role}:", *lines)))
        if i == len(turns):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = turns[i]
            c, a, lines = best(i + 1, state, 0)
            options.append((c + delete, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                for name, cost, letter in ((role, 0, "K"), ("user", rerole, "R"), ("assistant", rerole, "R")):
                    if new := takes(state, name[:1]):
                        c, a, lines = best(i + 1, new, 0)
                        options.append((c + cost + (5 if faults[i] == "truncated" else 0), letter + a, (f"{name}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(turns, turns[1:], strict=False))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def in_order(row):
    return (row[1] is not None, row[1] or 0, row[2].encode(), row[3][:64].encode(), hashlib.sha256(row[3].encode()).hexdigest())


def brute(rows):
    ids, kept = damage(rows)
    return sorted(((c, *judge([r[1:] for r in sorted((x for x in kept if x[0] == c), key=in_order)])) for c in ids), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    found = cv.damaged_and_repaired(df)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(n, seed, most=7):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        turn = rnd.randrange(-3, 3)
        for _ in range(rnd.randrange(1, most)):
            rows.append((c, None if rnd.random() < 0.05 else turn, rnd.choice(["user", "user", "assistant", "assistant", "system", "tool", "agent", "", None]), rnd.choice(["One.", "Two! ", "Three", "Four?\n", "", " \t", None, "Five (5).", f"own {rnd.random()}."])))
            turn += rnd.choice([0, 1, 1, 1, 2])
    rnd.shuffle(rows)
    return rows


def test_small_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert got(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_random_conversations(spark):
    rows = made(400, 5)
    wide = table(spark, rows).select("*", *[F.lit(f"other {c}").alias(c) for c in ("conv", "slot", "at", "k", "parts", "blank", "cost", "audit", "best", "dropped", "initial", "head", "digest", "_copy")])
    assert got(wide) == brute(rows)


def test_edges(spark):
    rows = [
        (None, 1, "user", "Who?"), (None, 2, "assistant", "I."), (None, None, "system", "Be kind."), (None, None, None, None),
        (-4, 5, "user", ""), (7, 1, "user", "x" * 200_000 + "."), (7, 2, "assistant", "é" * 100_000 + "!"), (8, None, "system", "Only."), (8, None, "user", "Nulls."),
        (9, 1, "user", "Hi "), (9, 2, "assistant", "It ends in a space that is none.　"), (10, 2**62, "user", "Far."), (10, -(2**61), "assistant", "Near."),
    ]
    assert got(table(spark, rows)) == brute(rows)
    assert got(table(spark, [])) == []


def test_dropped_conversations_stay(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert got(table(spark, [(gone, 0, "user", "Hi.")])) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("chunk", [1, 3, 8])
def test_conversations_of_many_chunks(spark, monkeypatch, chunk):
    """Chunks of a few turns, composed two and three at a time, give what one fold gives."""
    monkeypatch.setattr(cv, "CHUNK", chunk)
    monkeypatch.setattr(cv, "FAN", 2 + chunk % 2)
    rows = [(c + 100, *r) for c, *r in made(60, chunk, 9)]
    rows += [(0, i // 2, random.Random(i).choice(["user", "assistant", "system"]), random.Random(i // 3).choice(["Yes.", "No", f"{i}."])) for i in range(150)]
    assert got(table(spark, rows).repartition(5)) == brute(rows)


def test_insertions_are_made_where_they_are_cheapest(spark, monkeypatch):
    """With dear deletions turns are inserted; the fold, its composition and the repaired turns agree."""
    rows = [(c + 1, *r) for c, *r in made(80, 3)] + [(0, i, r, f"{i}.") for i, r in enumerate(["user", "user", "user", "assistant", "assistant", "system", "user"] * 4)]
    wanted = brute_dear(rows)
    monkeypatch.setattr(cv, "DELETE", 50)
    monkeypatch.setattr(cv, "REROLE", 30)
    plain = table(spark, rows).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("dropped"))
    for chunk in (256, 2):
        monkeypatch.setattr(cv, "CHUNK", chunk)
        found = sorted(((r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in cv.repair_report(plain).collect()), key=repr)
        assert found == wanted and any("I" in x[2] for x in found)
        lines = {}
        for r in cv.repaired_turns(plain).orderBy("conv_id", "chunk", "place").collect():
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c, *_ in found} == {c: sha for c, *_, sha in found}


def brute_dear(rows):
    filled = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = [(c, judge([r[1:] for r in sorted((x for x in filled if x[0] == c), key=in_order)], 50, 30)) for c in {r[0] for r in rows}]
    return sorted(((c, *j[5:]) for c, j in found), key=repr)
