"""Paged source and sinks, there and back."""

from __future__ import annotations

import json
from pathlib import Path

from quillmart.plans import QUERIES
from quillmart.sources import files


def test_office_csv_is_read_back_as_a_dictionary(spark, tmp_path):
    df = spark.createDataFrame([(1, "né, \"x\""), (2, None), (3, "NULL")], "id int, name string")
    files.office_csv_out(df, str(tmp_path / "out"))
    parts = [p for p in Path(tmp_path / "out").glob("*.csv") if p.stat().st_size]
    assert parts and all(p.read_bytes().startswith(b"\xef\xbb\xbfid,name") for p in parts)
    back = files.dictionary(spark, str(tmp_path / "out"), "id string, name string")
    assert sorted(map(tuple, back.collect())) == [("1", "né, \"x\""), ("2", None), ("3", None)]


def test_plans_with_different_columns_share_a_header(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "id int, before string"), spark.createDataFrame([(2, "y")], "id int, reason string")
    files.plans_out([a, b], str(tmp_path / "plan"))
    back = files.dictionary(spark, str(tmp_path / "plan"), "id string, before string, reason string")
    assert sorted(map(tuple, back.collect())) == [("1", "x", None), ("2", None, "y")]


def test_sheets_are_folders(spark, tmp_path):
    files.sheets_out({"left": spark.range(2), "right": spark.range(3)}, str(tmp_path / "book"))
    assert [files.dictionary(spark, str(tmp_path / "book" / n), "id string").count() for n in ("left", "right")] == [2, 3]


def test_requests_go_out_and_results_come_in(spark, tmp_path):
    rows = spark.createDataFrame([(7, "a\n\"b\""), (8, None)], "id long, prompt string")
    files.requests_out(rows, "id", ["prompt"], str(tmp_path / "requests"))
    lines = sorted(x for p in Path(tmp_path / "requests").glob("part-*") for x in p.read_text("utf-8").splitlines())
    assert [json.loads(x) for x in lines] == [{"key": "7", "prompt": "a\n\"b\""}, {"key": "8"}]
    (tmp_path / "results.jsonl").write_text('{"key": "7", "response": {"verdict": "yes"}}\n{"key": "8", "error": "late"}\nnot json\n', "utf-8")
    got = files.results_in(spark, str(tmp_path / "results.jsonl"), "verdict string").collect()
    assert sorted(((r.key, r.error, r.payload and r.payload.verdict) for r in got), key=repr) == sorted([("7", None, "yes"), ("8", "late", None), (None, None, None)], key=repr)
    assert {r.raw for r in got if r.key is None} == {"not json"}


def test_rfc_dates_keep_the_wall_clock(spark):
    df = spark.createDataFrame([("Mon, 01 Jul 2024 09:05:00 +0900",), ("1 Jul 2024 09:05:00 GMT",), ("yesterday",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(files.rfc_timestamp(df.t)).collect()]
    assert [x and x.isoformat() for x in got] == ["2024-07-01T09:05:00", "2024-07-01T09:05:00", None, None, None]


def test_payloads_become_child_tables(spark):
    payload = {"products": [{"name": "p", "company": "c", "coverages": [{"name": "x", "max_amount": 5}, {"name": "y"}], "metrics": []}, {"name": "q", "metrics": [{"name": "m", "value": 1.5, "unit": "u"}]}]}
    df = spark.createDataFrame([(1, json.dumps(payload)), (2, "broken"), (3, None), (4, "{}")], "id int, body string")
    tables = files.payload_tables(df, "id", "body")
    assert sorted((r.id, r.product_no, r.name, r.company) for r in tables["product"].collect()) == [(1, 0, "p", "c"), (1, 1, "q", None)]
    assert sorted(map(tuple, tables["coverage"].collect())) == [(1, 0, 0, "x", 5), (1, 0, 1, "y", None)]
    assert list(map(tuple, tables["metric"].collect())) == [(1, 1, 0, "m", 1.5, "u")]


def test_alignment_adds_what_is_missing(spark):
    got = files.aligned(spark.createDataFrame([(1, "x")], "id int, extra string"), {"id": "bigint", "name": "string"})
    assert got.columns == ["id", "name"] and got.dtypes == [("id", "bigint"), ("name", "string")] and tuple(got.first()) == (1, None)


def test_payload_items_are_the_rows_of_all_tables(spark, sf_dir):
    """One reading of a payload gives what its six tables have; the query reads and moves its lines once."""
    product = {"name": "p", "coverages": [{"name": "x", "max_amount": 5}, {}], "metrics": [{"name": "m", "value": 1.9}, {"value": None}], "features": [], "insights": None, "partners": [{"role": "r"}, {"name": "n"}]}
    bodies = [json.dumps({"products": [product, {}, None, {"features": [{"channel": "c"}], "insights": [{"summary": "s"}]}]}), "broken", None, "{}", '{"products": [', json.dumps({"products": [{"coverages": "none", "name": "q"}]})]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    tables, expected = files.payload_tables(df, "id", "body"), []
    for kind, (name, number) in ({"product": ("name", None)} | files.CHILDREN).items():
        for r in tables[kind].collect():
            expected.append((kind, r["id"], r["product_no"], 0 if kind == "product" else r["item_no"], r[name], None if number is None or r[number] is None else int(r[number])))
    assert sorted(map(tuple, files.payload_items(df, "id", "body").collect()), key=repr) == sorted(expected, key=repr) and len(expected) > 10
    plan = QUERIES["payload_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1 and plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan
