import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cotejo.operators import names, outer_join
from cotejo.operators.cross import (
    apply_pairs,
    column_pairs,
    cross,
    cross_summary,
    key_uniqueness,
)
from cotejo.operators.grouped import grouped
from cotejo.operators.merge import derive, outer_merge, stack
from cotejo.plans.outer_merge import run_outer_merge
from cotejo.plans.reconcile import reconcile_summary, run_reconcile
from cotejo.plans.worktable import run_worktable
from cotejo.sources import history
from cotejo.sources.tables import (
    CSV_DIALECT,
    NO_TEXT,
    read_csv,
    read_source,
    replace_table,
    replace_version,
    write_csv,
)

NOW = datetime(2024, 1, 1)


def sides(spark, seed):
    rng = random.Random(seed)

    def rows(count, lone):
        keys = [1, 1, 1, 1, 2, 2, 3, None, None, *lone]
        return [(rng.choice(keys), rng.choice([0, 0, 1, None])) for _ in range(count)]

    a = spark.createDataFrame(rows(120, [7, 7, 7, 8]), "ka int, x int")
    b = spark.createDataFrame(rows(80, [9, 9, 9, 10]), "kb int, y int")
    return a, b


@pytest.mark.parametrize("null_safe", [False, True])
def test_join_strategies_give_the_same_rows(spark, monkeypatch, null_safe):
    a, b = sides(spark, 1)
    on = [("ka", "kb")]

    def bag(**how):
        rows = outer_join.full_outer(a, b, on, null_safe=null_safe, **how).collect()
        return Counter(map(tuple, rows))

    expected = Counter()
    rows_a, rows_b = [tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]

    def same(one, other):
        return one == other and (null_safe or one is not None)

    for left in rows_a:
        hits = [left + right for right in rows_b if same(left[0], right[0])]
        expected.update(hits or [left + (None, None)])
    for right in rows_b:
        if not any(same(left[0], right[0]) for left in rows_a):
            expected[(None, None) + right] += 1

    assert bag(strategy="full") == expected
    assert bag(strategy="split") == expected
    for hot_rows in (1, 5, 20):
        assert bag(hot_rows=hot_rows) == expected
    monkeypatch.setattr(outer_join, "HOT_PAIRS", 50)
    assert bag(hot_rows=6) == expected


def test_large_inputs_choose_a_plan_by_size(spark):
    a, b = sides(spark, 2)
    conf = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"
    expected = Counter(map(tuple, outer_join.full_outer(a, b, [("ka", "kb")], strategy="full").collect()))
    before = spark.conf.get(conf)
    spark.conf.set(conf, "1b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = outer_join.full_outer(a, b, [("ka", "kb")])
        assert Counter(map(tuple, counted.collect())) == expected
    finally:
        spark.conf.set(conf, before)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")


def test_a_row_without_key_reads_only_b(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    pairs = column_pairs("v", "v", "IGUALDAD")
    rows = cross(a, b, "k", "k", pairs).collect()
    assert sorted((r["llave_cruce"] or "", r["estado_cruce"], r["0_v_a"] or "") for r in rows) == [
        ("", "Only B", "y"), ("1", "Match", "x"), ("2", "Only B", ""),
    ]


def chunk(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_pair_application(spark):
    df = chunk(spark, [(10.0, 10.0), (20.0, 25.0)], "`0_cantidad_a` double, `0_cantidad_b` double")
    result = apply_pairs(df, column_pairs("cantidad", "cantidad", "DIFERENCIA"))
    assert result.columns == [
        "0_cantidadA", "0_cantidadB", "0_metodo_aplicado", "0_diferencia",
    ]
    assert [r["0_diferencia"] for r in result.collect()] == [0.0, 5.0]
    equal = apply_pairs(df, column_pairs("cantidad", "cantidad", "IGUALDAD"))
    assert [r["0_igualdad"] for r in equal.collect()] == [True, False]
    assert "0_is_match" not in equal.columns
    with pytest.raises(KeyError, match="0_otra_a"):
        apply_pairs(df, column_pairs("otra", "cantidad", "math_add"))


def test_pairs_may_repeat_columns(spark):
    df = chunk(
        spark,
        [(10.0, 5.0, 3.0, 1.0), (20.0, 8.0, 4.0, 2.0), (None, 3.0, None, None)],
        "`0_val_a` double, `0_val_b` double, `1_val_a` double, `1_val_b` double",
    )
    rows = apply_pairs(df, column_pairs("val, val", "val, val", "math_add, math_sub")).collect()
    assert [(r["0_math_add"], r["1_math_sub"]) for r in rows] == [
        (15.0, 2.0), (28.0, 2.0), (None, None),
    ]
    text = chunk(spark, [("hola", "hola")], "`0_nombre_a` string, `0_nombre_b` string")
    row = apply_pairs(text, column_pairs("nombre", "nombre", "fuzzy_levenshtein")).first()
    assert (row["0_fuzzy_levenshtein"], row["0_is_match"]) == (1.0, True)


def test_pair_lists_must_fit():
    with pytest.raises(ValueError, match="equally many"):
        column_pairs("a, b", "a", "math_add")
    with pytest.raises(ValueError, match="unknown"):
        column_pairs("a", "a", "nope")


def test_summary(spark):
    crossed = chunk(
        spark, [("Match",), ("Only A",), ("Only B",), ("Match",)], "estado_cruce string"
    )
    a = spark.createDataFrame([(1,), (2,)], "k int")
    unique = key_uniqueness(a, a, "k", "k")
    assert tuple(unique.first()) == (2, 2, 2, 2)
    assert tuple(cross_summary(crossed, unique).first()) == (4, 2, 1, 1, False)
    repeated = key_uniqueness(a.union(a), a, "k", "k")
    assert cross_summary(crossed, repeated).first()["hasDuplicates"] is True
    keyless = a.union(spark.createDataFrame([(None,)], "k int"))
    assert tuple(key_uniqueness(keyless, a, "k", "k").first()) == (3, 2, 2, 2)


def test_history_numbers_runs_and_evolves(spark):
    spark.sql("DROP TABLE IF EXISTS hist")
    a = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id int, q double")
    b = spark.createDataFrame([(1, 10.0), (3, 5.0)], "id int, q double")
    common = {"target_table": "hist", "created_at": NOW, "source": "s"}
    first = run_reconcile(a, b, "id", "id", column_pairs("q", "q", "DIFERENCIA"), job_id="j", **common)
    second = run_reconcile(
        a, b, "id", "id", column_pairs("q", "q", "math_tolerance"), analysis_name="n", **common
    )
    third = run_reconcile(a, b, "id", "id", column_pairs("q", "q", "DIFERENCIA"), **common)
    assert [r.run_id for r in (first, second, third)] == [1, 2, 3]
    assert [r.schema_changed for r in (first, second, third)] == [True, True, False]
    assert tuple(third.summary.first()) == (3, 1, 1, 1, False)
    assert second.rows.columns[-7:] == [
        "run_id", "created_at", "timestamp", "job_id", "estado_cruce", "analysis_name", "source",
    ]
    old = spark.table("hist").filter("run_id = 1")
    assert old.filter("`0_math_tolerance` IS NOT NULL OR analysis_name IS NOT NULL").isEmpty()
    assert spark.table("hist").count() == 9
    empty = run_reconcile(
        a.limit(0), b.limit(0), "id", "id", column_pairs("q", "q", "DIFERENCIA"), **common
    )
    assert empty.run_id is None and history.next_run_id(spark, "hist") == 4
    assert tuple(empty.summary.first()) == (0, 0, 0, 0, False)
    common["target_table"] = "never_filled"
    run_reconcile(a.limit(0), b.limit(0), "id", "id", column_pairs("q", "q", "DIFERENCIA"), **common)
    assert not spark.catalog.tableExists("never_filled")


def test_run_id_of_a_table_that_is_not_partitioned(spark):
    spark.sql("DROP TABLE IF EXISTS plain_runs")
    spark.range(3).selectExpr("id AS run_id").write.saveAsTable("plain_runs")
    assert history.next_run_id(spark, "plain_runs") == 3
    spark.sql("DROP TABLE IF EXISTS no_runs")
    spark.range(3).write.saveAsTable("no_runs")
    assert history.next_run_id(spark, "no_runs") == 1


def test_metadata_stands_last(spark):
    df = spark.range(1).selectExpr("'s' AS source", "id", "1 AS run_id", "'Match' AS estado_cruce")
    assert history.metadata_last(df).columns == ["id", "run_id", "estado_cruce", "source"]


@pytest.fixture
def contract(spark):
    return spark.createDataFrame(
        [(1, "P001", "m2", 10.0), (2, "P002", "m3", 20.0), (3, "P003", "kg", 15.0)],
        "id int, codigo_partida string, unidad string, cantidad_contrato double",
    )


@pytest.fixture
def model(spark):
    return spark.createDataFrame(
        [(1, "P001", "m2", 10.0), (2, "P002", "m3", 25.0), (4, "P004", "ud", 5.0)],
        "id int, codigo_partida string, unidad string, cantidad_modelo double",
    )


def test_outer_merge_job(spark, tmp_path, contract, model):
    path = str(tmp_path / "out.csv")
    rules = [
        ("broken", "nothing_here + 1"),
        ("delta_cantidad", "cantidad_modelo - cantidad_contrato"),
    ]
    result = run_outer_merge(
        [contract], [model], ["id"], rules, run_id="r", created_at=NOW, csv_path=path, ordered=True
    )
    assert result.columns == [
        "id", "cantidad_contrato", "cantidad_modelo", "estado_bttf", "codigo_partida", "unidad",
        "delta_cantidad", "run_id", "created_at",
    ]
    assert [tuple(row)[:7] for row in result.collect()] == [
        (1, 10.0, 10.0, "Match", "P001", "m2", 0.0),
        (2, 20.0, 25.0, "Match", "P002", "m3", 5.0),
        (3, 15.0, None, "Only A", "P003", "kg", None),
        (4, None, 5.0, "Only B", "P004", "ud", None),
    ]
    assert read_source(spark, path=path).count() == 4


def test_merge_keys_match_on_null(spark):
    a = spark.createDataFrame([(None, "x", 1), (2, "y", 2)], "k int, v string, p_x int")
    b = spark.createDataFrame([(None, None, 5), (3, "z", 6)], "k int, v string, p_y int")
    rows = outer_merge(a, b, ["k"], ordered=True).collect()
    assert [(r["k"], r["estado_bttf"], r["v"], r["p"]) for r in rows] == [
        (2, "Only A", "y", 2), (3, "Only B", "z", 6), (None, "Match", "x", 1),
    ]
    with pytest.raises(KeyError, match="missing"):
        outer_merge(a, b, ["nope"])


def test_stack_and_derive(spark, contract, model):
    stacked = stack([contract, model])
    assert stacked.count() == 6 and "cantidad_modelo" in stacked.columns
    chained = derive(contract, [("twice", "cantidad_contrato * 2"), ("more", "twice + 1")])
    assert chained.first()["more"] == 21.0


def test_csv_sink_replaces_then_appends(spark, tmp_path, contract):
    path = str(tmp_path / "sink.csv")
    nested = contract.withColumn("s", F.struct("id"))
    write_csv(nested, path)
    write_csv(nested, path)
    write_csv(nested, path, append=True)
    rows = read_csv(spark, path)
    assert rows.count() == 6 and rows.filter("id = 1").first()["s"] == '{"id":1}'


def test_order_rules(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("b", None), (None, 2), ("c", 3)], "g string, n int"
    )
    up = [tuple(r) for r in grouped(df, "g, n", "n ASC").collect()]
    down = [tuple(r) for r in grouped(df, "g, n", "n DESC").collect()]
    assert up == [("a", 1), (None, 2), ("c", 3), ("b", None)]
    assert down == up[::-1]
    totals = grouped(df, "g", "total DESC", {"total": F.sum("n")}).collect()
    assert totals[0]["g"] == "b"
    for rules in ("n", "n UP", "other ASC"):
        with pytest.raises(ValueError):
            grouped(df, "g, n", rules)
    with pytest.raises(ValueError, match="empty"):
        grouped(df, " , ")


def test_worktable_job(spark):
    spark.sql("DROP TABLE IF EXISTS wt")
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "g string, n int")
    runs = [
        run_worktable(df, "g", "g DESC", target_table="wt", created_at=NOW, job_id="w")
        for _ in range(2)
    ]
    assert [run.run_id for run in runs] == [1, 2]
    assert [run.schema_changed for run in runs] == [True, False]
    row = runs[1].rows.filter("g = 'a'").first()
    assert (row["source"], row["job_id"], row["run_id"]) == ("worktable", "w", 2)
    assert spark.table("wt").count() == 4


def test_names():
    assert names.safe_part(" Valor/Total  (m²) ") == "valor_total_m"
    assert names.identifier("schema.table") == "table"
    for bad in ("", "1x", "a b"):
        with pytest.raises(ValueError):
            names.identifier(bad)
    with pytest.raises(ValueError):
        names.safe_part("²")


def test_csv_values_come_back_as_they_were(spark, tmp_path):
    texts = ['a ""b"" c', "two\nlines\r\nand more", " blanks ", "back\\slash", "", None, "NA", ",", '"']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    path = str(tmp_path / "odd.csv")
    write_csv(df, path)
    assert dict(read_csv(spark, path, df.schema).collect()) == dict(enumerate(texts))
    assert dict(read_csv(spark, path).collect()) == dict(enumerate(texts))
    marked = dict(read_csv(spark, path, df.schema, null_value="NA").collect())
    assert marked[6] is None and marked[7] == ","


def test_csv_types_beside_missing_values(spark, tmp_path):
    path = tmp_path / "types.csv"
    path.write_text('id,text,value\n1,"a ""b"" c",1.5\n2,"x\ny",NA\n3,,2\n')
    rows = read_csv(spark, str(path), null_value="NA")
    assert [f.dataType.simpleString() for f in rows.schema] == ["int", "string", "double"]
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [
        (1, 'a "b" c', 1.5), (2, "x\ny", None), (3, None, 2.0),
    ]


def test_rows_that_fail_leave_the_table(spark):
    good = spark.createDataFrame([(1,), (2,)], "a int")
    assert replace_table(good, "kept_table") == 2
    bad = good.withColumn("a", F.when(F.col("a") == 2, F.raise_error("no")).otherwise(F.col("a")))
    with pytest.raises(Exception, match="no"):
        replace_table(bad, "kept_table")
    assert sorted(r[0] for r in spark.table("kept_table").collect()) == [1, 2]
    assert replace_table(good.limit(1), "kept_table") == 1
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("kept_table")]
    assert names == ["kept_table"]
    spark.sql("DROP TABLE kept_table")


def test_appending_never_loses_values(spark):
    table = "typed_runs"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    one = spark.createDataFrame([(1, 2)], "q int, run_id int")
    history.append(one, table)
    with pytest.raises(TypeError, match="q is int"):
        history.append(spark.createDataFrame([(2.7, 2, "x")], "q double, run_id int, more string"), table)
    assert spark.table(table).columns == ["q", "run_id"]
    history.append(spark.createDataFrame([(7, 3)], "q smallint, run_id int"), table)
    assert sorted(r["q"] for r in spark.table(table).collect()) == [1, 7]
    spark.sql(f"DROP TABLE {table}")


def test_summary_follows_from_rows_per_key(spark):
    a, b = sides(spark, 3)
    crossed = cross(a, b, "ka", "kb", [])
    wanted = cross_summary(crossed, key_uniqueness(a, b, "ka", "kb")).first()
    counted = reconcile_summary(a, b, "ka", "kb")
    assert counted.first() == wanted
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_grid_reads_each_side_twice(spark, tmp_path):
    a, b = sides(spark, 4)
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    joined = outer_join.full_outer(a, b, [("ka", "kb")], hot_rows=1)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    # once here and once for the counts; the third scan is that of the hot keys
    assert plan.count("Relation [") == 4
    assert "Join FullOuter" in plan and "Union" not in plan


def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(6)
    pieces = ['a', 'b c', '""', ',', '\n', '\r\n', '\n\n', 'é', ' ', "'", '\\']
    rows = []
    for i in range(400):
        words = ["".join(rng.choices(pieces, k=rng.randint(0, 6))) for _ in range(2)]
        fields = [w if w and not set(w) & set(',\n\r"') else f'"{w}"' for w in words]
        rows.append(f"{i},{fields[0]},{rng.choice(['', fields[1]])}")
    long = '"' + "line\n" * 400 + '"'  # a value longer than several ranges
    rows[100:100] = [f"1000,{long},x", f"1001,x,{long}"]
    for name, end in (("unix.csv", "\n"), ("dos.csv", "\r\n")):
        text = "id,one,two" + end + end.join(rows) + end * (name == "unix.csv")
        (tmp_path / name).write_bytes(text.encode())
        schema = "id int, one string, two string"
        options = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
        before = {key: spark.conf.get(key) for key in options}
        for key, value in options.items():
            spark.conf.set(key, value)
        try:
            path = str(tmp_path / name)
            assert spark.read.text(path).rdd.getNumPartitions() > 20
            got = Counter(map(tuple, read_csv(spark, path, schema).collect()))
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
        serial = spark.read.options(
            **CSV_DIALECT, multiLine=True, nullValue=NO_TEXT, emptyValue=""
        )
        wanted = Counter(map(tuple, serial.schema(schema).csv(path).collect()))
        if end == "\r\n":  # the serial reader writes such an end in a value as the shorter one
            got = Counter(
                tuple(v.replace("\r\n", "\n") if isinstance(v, str) else v for v in row)
                for row in got.elements()
            )
        assert got == wanted
        assert sum(got.values()) == 402


def test_readers_are_never_without_a_version(spark):
    from threading import Event, Thread

    spark.sql("DROP VIEW IF EXISTS shown")
    assert replace_version(spark.range(10), "shown") == 10
    seen, problems, done = set(), [], Event()

    def read():
        while not done.is_set():
            try:
                seen.add(tuple(spark.table("shown").agg(F.count("*"), F.max("id")).first()))
            except Exception as problem:
                problems.append(problem)

    reader = Thread(target=read)
    reader.start()
    for n in (20, 30, 40):
        assert replace_version(spark.range(n), "shown") == n
    done.set()
    reader.join()
    assert not problems and seen <= {(n, n - 1) for n in (10, 20, 30, 40)} and seen
    assert spark.table("shown").count() == 40
    left = spark.sql("SHOW TABLES LIKE 'shown_v*'").count()
    assert left == 2
    broken = spark.range(3).select(F.raise_error(F.lit("no rows")).alias("id"))
    with pytest.raises(Exception, match="no rows"):
        replace_version(broken, "shown")
    assert spark.table("shown").count() == 40
    replace_table(spark.range(1), "plain_table")
    with pytest.raises(ValueError, match="is a table"):
        replace_version(spark.range(1), "plain_table")


def test_parts_of_a_hot_key_do_not_shrink_with_its_limit(spark):
    a = spark.range(20_000).select((F.col("id") % 2).alias("ka"), F.col("id").alias("x"))
    b = spark.range(3_000).select((F.col("id") % 2).alias("kb"), F.col("id").alias("y"))
    hot = outer_join.hot_keys(a, b, [("ka", "kb")], False, 60)
    # 10,000 and 1,500 rows a key: by the limit of 60 rows, 167 and 25 parts
    assert {tuple(row[1:3]) for row in hot.collect()} == {(40, 8)}


def test_a_join_that_makes_many_rows_has_many_tasks(spark, monkeypatch):
    a, b = sides(spark, 5)
    wanted = Counter(map(tuple, outer_join.full_outer(a, b, [("ka", "kb")], strategy="full").collect()))
    monkeypatch.setattr(outer_join, "HOT_PAIRS", 100)
    joined = outer_join.full_outer(a, b, [("ka", "kb")], hot_rows=5)
    assert Counter(map(tuple, joined.collect())) == wanted
    # coalesced by their bytes, they would be one
    assert joined.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
