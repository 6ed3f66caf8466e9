"""The stateful queue against a plain fold, in one and many micro-batches, with replays."""

from __future__ import annotations

import shutil
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest

from quillmart.streaming import jobs as J

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
NAMES = {"q": "enqueue", "c": "claim", "x": "extend", "d": "complete", "f": "fail"}
START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def events(rows):
    """(event_id, hours, user, type)."""
    return [(i, START + h * HOUR, u, t) for i, h, u, t in rows]


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}-{name}")
    folder.mkdir(exist_ok=True)
    for p in (folder.parent / f"{folder.name}-{name}").glob("*.parquet"):
        shutil.copy(p, folder / f"{name}.parquet")


def run(spark, folder, base=None):
    log = J.queue_log(spark, J.commands_of(spark, str(folder), "*.parquet", SCHEMA, NAMES), base=base and str(base))
    return sorted((tuple(r) for r in log.collect()), key=lambda r: (r[0], r[2], r[3]))


def fold(rows, lateness=1):
    """The log that one pass over all commands in order gives, with claims that the watermark ends."""
    out, mine = [], defaultdict(list)
    for i, ts, user, kind in rows:
        if kind in NAMES:
            mine[user].append((round((ts.replace(tzinfo=UTC)).timestamp() * 1000), i, NAMES[kind]))
    end = max((t for x in mine.values() for t, *_ in x), default=0) - lateness * 3600 * 1000
    for user, commands in mine.items():
        item, status, attempts, lease = 0, "none", 0, 0

        def missed(at, event, command):
            nonlocal status, attempts
            attempts += 1
            status = "failed" if attempts >= 3 else "pending"
            out.append((user, item, at, event, command, "running", status, "failed" if status == "failed" else "retry", attempts))  # noqa: B023

        for at, event, command in sorted(commands):
            if status == "running" and lease < at:
                missed(lease, -1, "expire")
            before, verdict = status, "rejected"
            if command == "enqueue":
                verdict = "duplicate" if status in ("pending", "running") else "accepted"
                if verdict == "accepted":
                    item, status, attempts = item + 1, "pending", 0
            elif command == "claim" and status == "pending":
                status, lease, verdict = "running", at + 12 * 3600 * 1000, "accepted"
            elif status == "running" and command == "fail":
                missed(at, event, command)
                continue
            elif status == "running" and command in ("extend", "complete"):
                verdict, lease, status = "accepted", at + 12 * 3600 * 1000 if command == "extend" else lease, "completed" if command == "complete" else status
            out.append((user, item, at, event, command, before, status, verdict, attempts))
        if status == "running" and lease < end:
            missed(lease, -1, "expire")
    return sorted(out, key=lambda r: (r[0], r[2], r[3]))


LIFE = events([
    (1, 0, 1, "q"), (2, 1, 1, "q"), (3, 2, 1, "c"), (4, 3, 1, "q"), (5, 4, 1, "c"), (6, 13, 1, "x"), (7, 24, 1, "d"), (8, 25, 1, "d"), (9, 26, 1, "q"),
    (10, 0, 2, "c"), (11, 1, 2, "q"), (12, 2, 2, "c"), (13, 15, 2, "d"), (14, 16, 2, "c"), (15, 17, 2, "f"), (16, 18, 2, "c"), (17, 19, 2, "f"), (18, 20, 2, "f"), (19, 21, 2, "q"),
    (20, 3, 3, "q"), (21, 4, 3, "c"), (22, 5, 4, "other"), (23, 40, 5, "q"),
])


def test_life_of_items(spark, tmp_path):
    write(spark, tmp_path / "in", LIFE, "a")
    log = run(spark, tmp_path / "in")
    assert log == fold(LIFE)
    verdicts = {(r[0], r[3]): (r[5], r[6], r[7]) for r in log if r[3] > 0}
    assert verdicts[1, 2] == ("pending", "pending", "duplicate") and verdicts[1, 5] == ("running", "running", "rejected")
    assert verdicts[1, 7] == ("running", "completed", "accepted") and verdicts[1, 9] == ("completed", "pending", "accepted")
    # the claim of hour 2 ran out at hour 14: one attempt; two failures later the item has failed for good
    assert (2, 1, 1704067200000 + 14 * 3600 * 1000, -1, "expire", "running", "pending", "retry", 1) in log
    assert verdicts[2, 17] == ("running", "failed", "failed") and verdicts[2, 18] == ("failed", "failed", "rejected")
    # nobody asks for target 3 any more; the watermark ends its claim
    assert [r[4:8] for r in log if r[0] == 3][-1] == ("expire", "running", "pending", "retry")


@pytest.mark.parametrize("cuts", [2, 4])
def test_batches_and_replays_change_nothing(spark, tmp_path, cuts):
    rows = sorted(LIFE, key=lambda r: (r[1], r[0]))
    base = tmp_path / "state"
    for k in range(cuts):
        part = rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts]
        write(spark, tmp_path / "in", part, f"part{k}")
        log = run(spark, tmp_path / "in", base)
        # the same commands once more, under another name
        write(spark, tmp_path / "in", part, f"again{k}")
        assert run(spark, tmp_path / "in", base) == log
    assert log == fold(LIFE)


def test_no_commands(spark, tmp_path):
    write(spark, tmp_path / "in", events([(1, 0, 1, "other")]), "a")
    assert run(spark, tmp_path / "in") == []
