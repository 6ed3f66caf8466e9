"""Entity resolution operators on small rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmart.operators import resolve as V


def test_compatible_kinds(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("a", "c"), ("any", "c"), (None, "c")], "x string, y string")
    assert [r[0] for r in df.select(V.compatible(F.col("x"), F.col("y"), ["any"], [("b", "a")])).collect()] == [True, True, True, False, True, None]


def test_first_veto_then_first_accept(spark):
    df = spark.createDataFrame([(True, True), (False, True), (False, False), (None, None)], "veto boolean, fine boolean")
    got = df.select(V.verdict([("no", F.col("veto"))], [("yes", 90, F.col("fine")), ("also", 10, F.col("fine"))], "none").alias("v")).select("v.*")
    assert sorted(map(tuple, got.collect())) == sorted([(False, 0, "no"), (True, 90, "yes"), (False, 0, "none"), (False, 0, "none")])


def test_mapped_stems_differences_and_ranks(spark):
    df = spark.createDataFrame([(["x", "q", "y", "x", None], "new old name", "low", "high", None, 1)], "l array<string>, name string, a string, b string, m int, n int")
    row = df.select(
        V.mapped(F.col("l"), {"x": "one", "y": "two"}).alias("mapped"),
        V.stems(F.col("name"), ["new"], ["name"]).alias("stems"),
        V.differences({"a": (F.col("a"), F.col("a")), "m": (F.col("m"), F.col("n")), "null": (F.col("m"), F.col("m"))}).alias("changed"),
        V.raised({"high": 2, "low": 1}, F.col("a"), F.col("b")).alias("up"),
        V.raised({"high": 2, "low": 1}, F.col("b"), F.lit(None)).alias("down"),
    ).first()
    assert row.mapped == ["one", "two"] and row.stems == ["new old name", "old name", "new old", "old"]
    assert row.changed == ["m"] and row.up is True and row.down is False


def test_name_similarity_of_all_blocks(spark, sf_dir):
    import difflib
    from collections import defaultdict
    from itertools import combinations

    from quillmart import plans

    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # the smallest table has one such pair
    blocks = defaultdict(lambda: defaultdict(list))
    for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect():
        blocks[r.p_brand, r.p_type, r.p_size][r.p_name].append(r.p_partkey)
    want = set()
    for names in blocks.values():
        for (a, x), (b, y) in combinations(sorted(names.items(), key=lambda n: min(n[1])), 2):
            short, long = sorted((a, b), key=len)
            tokens = set(a.split()), set(b.split())
            score = max(0.82, len(short) / len(long)) if short in long else max(difflib.SequenceMatcher(None, a, b).ratio(), len(tokens[0] & tokens[1]) / len(tokens[0] | tokens[1]))
            want.add((min(x), min(y), len(x), len(y), round(score, 9)))
    got = plans.QUERIES["name_similarity_difflib"](spark, sf_dir).collect()
    assert len(got) == len(want) and {(*r[:4], round(r.similarity, 9)) for r in got} == want


def test_block_pairs_are_all_pairs_of_small_and_split_blocks(spark, monkeypatch):
    from quillmart.operators import hot

    monkeypatch.setattr(hot, "LEAST_ROWS", 10)
    monkeypatch.setattr(V, "CELL_ROWS", 7)
    rows = [(i, 0 if i < 60 else i // 4, f"n{i % 5}") for i in range(90)] + [(200 + i, None, "x") for i in range(3)]
    df = spark.createDataFrame(rows, "id int, b int, name string")
    got = [tuple(r) for r in V.block_pairs(df, ["b"], "id", ["name"]).select("left_id", "right_id", "left_name", "right_name").collect()]
    want = [(i, j, n, m) for i, b, n in rows for j, c, m in rows if i < j and b == c and b is not None]
    assert sorted(got) == sorted(want)
    assert V.block_pairs(df.limit(0), ["b"], "id", ["name"]).count() == 0


def test_rule_table_takes_the_first_that_holds(spark):
    rules = [(False, "0", "veto", "x > 5"), (True, "least(9, x)", "one", "x > 1"), (True, "50", "two", "y")]
    df = spark.createDataFrame([(7, True), (3, True), (0, True), (0, None), (None, None)], "x int, y boolean")
    assert [tuple(r[0]) for r in df.select(F.expr(V.rule_table(rules, "none"))).collect()] == [(False, 0, "veto"), (True, 3, "one"), (True, 50, "two"), (False, 0, "none"), (False, 0, "none")]


def test_metric_values_of_awkward_texts(spark, tmp_path):
    from quillmart.plans.resolution import metric_value

    texts = ["3.5 million sold", "1,200,000 units", "none", None, "", "12345678901 items", "+7 and then, " + "x" * 60 + " thousand", "-4.25%", "5."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["value"] for r in metric_value(spark, str(tmp_path)).collect()}
    assert got == {0: 3500000.0, 1: 1200000.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 12345678901.0, 6: 7000.0, 7: -0.0425, 8: 5.0}


def test_groups_of_a_block_are_compared_once_and_give_all_pairs(spark, monkeypatch):
    from quillmart.operators import hot

    monkeypatch.setattr(hot, "LEAST_ROWS", 10)
    monkeypatch.setattr(V, "CELL_ROWS", 7)
    rows = [(i, i % 2, [None, "x", "y"][i % 3], i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, b int, name string, n int")
    facts = lambda met: met.withColumn("same", F.col("left_name").eqNullSafe(F.col("right_name")))
    want = sorted((x[0], y[0], x[2] == y[2], {x[3], y[3]}) for x in rows for y in rows if x[1] == y[1] and x[0] < y[0])
    for symmetric in (False, True):
        met = V.block_pairs(df, ["b"], "id", ["n"], ["name"], facts, symmetric)
        assert sorted((r.left_id, r.right_id, r.same, {r.left_n, r.right_n}) for r in met.collect()) == want


def test_judged_is_the_first_rule_that_holds(spark):
    rules = [(False, "0", "no", "veto"), (True, "90 + n", "yes", "fine"), (True, "10", "late", "n > 1")]
    df = spark.createDataFrame([(True, True, 1), (False, True, 2), (None, None, 2), (False, False, 0)], "veto boolean, fine boolean, n int")
    got = V.judged(df, rules, "grey").select("accepted", "confidence", "reason").collect()
    assert [tuple(r) for r in got] == [(False, 0, "no"), (True, 92, "yes"), (True, 10, "late"), (False, 0, "grey")]


def test_rules_are_compiled(spark, sf_dir, capsys):
    """The JVM compiles no method of more than 8,000 bytes; Spark would run it row by row as it reads it."""
    import re

    from quillmart import plans

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans.QUERIES["merge_rules"](spark, sf_dir).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert len(sizes) > 3 and max(sizes) < 8000


def test_many_rules_are_judged_in_parts(spark, monkeypatch):
    monkeypatch.setattr(V, "RULES", 3)
    rules = [(i % 3 > 0, str(i), f"rule {i}", f"x = {i} OR y = {i}") for i in range(11)]
    rows = [(x, y) for x in (None, *range(12)) for y in (None, *range(12))]
    got = V.judged(spark.createDataFrame(rows, "x int, y int"), rules, "grey").collect()
    for r in got:
        i = min([v for v in (r.x, r.y) if v is not None and v < 11], default=None)
        assert (r.accepted, r.confidence, r.reason) == ((False, 0, "grey") if i is None else (i % 3 > 0, i, f"rule {i}"))
    assert len(got) == len(rows)
