"""Stream upserts against a plain fold: cut in batches, replayed, started again."""

from __future__ import annotations

import random
import shutil

import pytest

from quillmart.streaming import upserts as U

SCHEMA = "owner string, kind string, month string, basis string, seq long"


def made(n=120):
    rnd = random.Random(2)
    bases = [*U.PRIORITY, None, "other"]
    return [(rnd.choice(["a", "b", None]), rnd.choice("xyz"), rnd.choice([None, "2020-01", "2021-02", "2022-03"]), rnd.choice(bases), i) for i in range(n)]


def fold(rows):
    """Each observation in order: a month goes over another one that is believed no more."""
    state = {}
    for owner, kind, month, basis, seq in rows:
        was = state.get((owner, kind))
        if was is None:
            state[owner, kind] = [month, basis, seq, 1]
            continue
        was[3] += 1
        rank = lambda m, b: (m is not None, U.PRIORITY.get(b, 0))
        if rank(month, basis) >= rank(was[0], was[1]):
            was[:3] = [month, basis, seq]
    return {k: tuple(v) for k, v in state.items()}


def put(spark, folder, rows, name):
    folder.mkdir(exist_ok=True)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    for p in (folder.parent / f"{folder.name}-{name}").glob("*.parquet"):
        shutil.copy(p, folder / f"{name}.parquet")


def run(spark, folder, base):
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))
    table, log = U.upserted(spark, stream, ["owner", "kind"], str(base))
    rows = {(r["owner"], r["kind"]): (r["month"], r["basis"], r["seq"], r["rows"]) for r in table.collect()}
    return rows, sorted((tuple(r) for r in log.collect()), key=repr)


@pytest.mark.parametrize("cuts", [1, 3])
def test_batches_give_what_one_fold_gives(spark, tmp_path, cuts):
    rows, base = made(), tmp_path / "base"
    for k in range(cuts):
        put(spark, tmp_path / "in", rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts], f"part{k}")
        table, log = run(spark, tmp_path / "in", base)
    assert table == fold(rows)
    inserts = [r for r in log if r[2] == "insert"]
    assert len(inserts) == len({r[:2] for r in inserts}) == len(table)
    assert sum(r[7] for r in log) == len(rows)
    assert {r[-1] for r in log} <= set(range(cuts))
    # a batch that is run again, as after a crash before its commit, changes neither table nor log
    for name in (f"{cuts - 1}", f".{cuts - 1}.crc"):
        (base / "state" / "commits" / name).unlink(missing_ok=True)
    assert run(spark, tmp_path / "in", base) == (table, log)
    # and so does a start without anything new
    assert run(spark, tmp_path / "in", base) == (table, log)


def test_combining_is_associative(spark):
    rows = made(60)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", rows long")
    whole = sorted((tuple(r) for r in U.combined(df, ["owner", "kind"]).collect()), key=repr)
    halves = U.combined(df.where("seq < 30"), ["owner", "kind"]).unionByName(U.combined(df.where("seq >= 30"), ["owner", "kind"]))
    assert sorted((tuple(r) for r in U.combined(halves, ["owner", "kind"]).collect()), key=repr) == whole


def test_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert run(spark, tmp_path / "in", tmp_path / "base") == ({}, [])
