import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cotejo.functions.cleaning import number_digits, number_type, typed_value
from cotejo.operators import scd2, skew
from cotejo.operators.pivot import wide_entities
from cotejo.operators.state import (
    INVENTORY_SCHEMA,
    VAULT_SCHEMA,
    empty,
)
from cotejo.plans.edits import apply_edits, run_edits
from cotejo.plans.materialize import run_materialize
from cotejo.plans.refine import refine, run_refine
from cotejo.sources import history
from cotejo.sources.claims import claim_next, create_if_absent, read_file
from cotejo.sources.config import ConfigRow, load_config
from cotejo.session import setting
from cotejo.sources.vault_store import VaultStore
from replay import Replay

CONFIG = [
    ConfigRow("codigo", "internal_id", True, True),
    ConfigRow("nombre", "texto", False, True),
    ConfigRow("precio", "moneda", False, True),
    ConfigRow("nota", "texto", False, False),
    ConfigRow("zona", "texto", True, False),
]
KEPT = {row.columna_origen: row.tipo_dato_generico for row in CONFIG if row.guardar}
SCHEMA = "seq int, codigo string, zona string, nombre string, precio double, nota string"


def random_rows(rng, count):
    rows = []
    for seq in range(count):
        rows.append(
            (
                seq,
                rng.choice(["A", "A", "A", "B", "C", "D", "E", " ", None]),
                rng.choice(["n", "n", None]),
                rng.choice(["x", "x ", "y", "  ", None, "x  y"]),
                rng.choice([1.0, 2.5, None, 12345678.9]),
                "n",
            )
        )
    return rows


def as_dicts(rows):
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return [dict(zip(names, row)) for row in rows]


def vault_rows(df):
    return Counter(tuple(row[name] for name in VAULT_SCHEMA.names) for row in df.collect())


def replay_rows(replay):
    return Counter(tuple(row[name] for name in VAULT_SCHEMA.names) for row in replay.vault)


def inventory_rows(df):
    return {row["entidad_interna_id"]: row.asDict() for row in df.collect()}


def replay_inventory(replay):
    return {
        entity: {"entidad_interna_id": entity, **known}
        for entity, known in replay.inventory.items()
    }


def assert_invariants(vault):
    current = vault.filter("estado = 'VIGENTE'")
    doubled = current.groupBy("entidad_interna_id", "propiedad_origen").count().filter("count > 1")
    assert doubled.isEmpty()
    assert current.filter("hasta IS NOT NULL").isEmpty()
    assert vault.filter("estado <> 'VIGENTE' AND (hasta IS NULL OR hasta < desde)").isEmpty()


@pytest.mark.parametrize("seed", [1])
@pytest.mark.parametrize("hot_rows", [None, 3])
def test_runs_equal_row_by_row_replay(spark, tmp_path, seed, hot_rows):
    rng = random.Random(seed)
    store = VaultStore(spark, str(tmp_path / "store"))
    replay = Replay()
    for number, source in enumerate(["uno", "uno", "dos", "uno"], start=1):
        rows = random_rows(rng, 40 if number < 4 else 5)
        at, job = datetime(2024, 1, number), f"job{number}"
        expected = replay.refine(
            as_dicts(rows), ["codigo", "zona"], KEPT, source, job, at
        )
        run = refine(
            spark.createDataFrame(rows, SCHEMA),
            CONFIG,
            store.current(),
            store.inventory(),
            source_table=source,
            job_id=job,
            at=at,
            order_by=["seq"],
            hot_rows=hot_rows,
        )
        version = store.version() + 1
        store.write_changes(version, run.changes)
        changes = store.changes(version)
        store.write_inventory(version, run.inventory(changes))
        store.commit(version, job, at)

        assert vault_rows(store.vault()) == replay_rows(replay)
        assert inventory_rows(store.inventory()) == replay_inventory(replay)
        summary = run.summary(changes).first().asDict()
        assert {name: summary[name] for name in expected} == expected
        assert run.errors.count() == expected["errores"]
        assert_invariants(store.vault())


def test_edits_equal_row_by_row_replay(spark, tmp_path):
    rng = random.Random(5)
    store = VaultStore(spark, str(tmp_path / "store"))
    replay = Replay()
    config = spark.createDataFrame(
        [("uno", *vars(row).values()) for row in CONFIG],
        "tabla string, columna_origen string, tipo_dato_generico string, es_llave boolean, "
        "guardar boolean",
    )
    rows = random_rows(rng, 30)
    replay.refine(as_dicts(rows), ["codigo", "zona"], KEPT, "uno", "j1", datetime(2024, 1, 1))
    run_refine(
        store,
        spark.createDataFrame(rows, SCHEMA),
        config,
        source_table="uno",
        job_id="j1",
        at=datetime(2024, 1, 1),
        order_by=["seq"],
    )
    entities = sorted(replay.inventory)
    edits = [
        (
            i,
            "uno",
            rng.choice([*entities[:3], "unknown"]),
            rng.choice(["nombre", "precio", "codigo", "nota", "other"]),
            rng.choice(["1,5", " a  b ", None, "z"]),
            "ana@example.org",
        )
        for i in range(40)
    ]
    names = "seq source_table entidad_interna_id propiedad nuevo_valor usuario_email".split()
    expected = replay.edit(
        [dict(zip(names, edit)) for edit in edits], KEPT, "uno", "j2", datetime(2024, 1, 2)
    )
    frame = spark.createDataFrame(
        edits,
        "seq int, source_table string, entidad_interna_id string, propiedad string, "
        "nuevo_valor string, usuario_email string",
    )
    hot = apply_edits(
        frame, CONFIG, store.current(), store.inventory(), source_table="uno", job_id="j2",
        at=datetime(2024, 1, 2), order_by=["seq"], hot_rows=4,
    )
    run = run_edits(
        store, frame, config, source_table="uno", job_id="j2", at=datetime(2024, 1, 2),
        order_by=["seq"],
    )
    assert vault_rows(store.vault()) == replay_rows(replay)
    assert vault_rows(hot.changes.drop("cambio")) == replay_rows(replay) - Counter(
        tuple(row[name] for name in VAULT_SCHEMA.names)
        for row in replay.vault
        if row["estado"] != "VIGENTE" and row["job_id"] == "j1"
    )
    assert inventory_rows(store.inventory()) == replay_inventory(replay)
    assert run.summary.first().asDict() == expected
    assert run.errors.count() == expected["errores"]
    refused = frame.limit(1).withColumn("usuario_email", F.lit("nobody"))
    batch = apply_edits(
        refused, CONFIG, store.current(), store.inventory(), source_table="uno", job_id="j3",
        at=datetime(2024, 1, 3),
    )
    assert batch.summary().first()["errores"] == 1


def test_stored_id_wins_over_derived_id(spark):
    inventory = spark.createDataFrame(
        [("custom-1", "A|n", "uno", "INACTIVO", 0, datetime(2023, 1, 1), "old")], INVENTORY_SCHEMA
    )
    rows = spark.createDataFrame([(1, "A", "n", "x", 1.0, "")], SCHEMA)
    run = refine(
        rows, CONFIG, empty(spark, VAULT_SCHEMA), inventory,
        source_table="uno", job_id="j", at=datetime(2024, 1, 1),
    )
    assert {row[0] for row in run.changes.select("entidad_interna_id").collect()} == {"custom-1"}
    entity = run.inventory().first()
    assert (entity["estado_entidad"], entity["total_propiedades_activas"]) == ("ACTIVO", 3)


def test_rows_without_key_columns_are_anchored_by_id(spark):
    config = [ConfigRow("nombre")]
    rows = spark.createDataFrame([(42, "foo"), (None, "bar")], "id int, nombre string")
    run = refine(
        rows, config, empty(spark, VAULT_SCHEMA), empty(spark, INVENTORY_SCHEMA),
        source_table="uno", job_id="j", at=datetime(2024, 1, 1),
    )
    assert [r["llave_humana_completa"] for r in run.changes.collect()] == ["ANCLA:42"]
    assert run.errors.count() == 1


@pytest.mark.parametrize(
    ("dtype", "values", "kept"),
    [
        ("boolean", [True, False, None], 1),
        ("string", ["true", " Sí ", "0", None, "Y"], 3),
        ("int", [1, 0, 7, None], 2),
    ],
)
def test_acceptance_filter(spark, dtype, values, kept):
    rows = spark.createDataFrame(
        [(i, value) for i, value in enumerate(values)], f"id int, Req_Aceptado {dtype}"
    )
    run = refine(
        rows, [ConfigRow("id")], empty(spark, VAULT_SCHEMA), empty(spark, INVENTORY_SCHEMA),
        source_table="uno", job_id="j", at=datetime(2024, 1, 1),
    )
    summary = run.summary().first()
    assert (summary["filas_procesadas"], summary["filas_omitidas"]) == (kept, len(values) - kept)


def test_interrupted_run_leaves_last_version(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "A", "n", "x", 1.0, "")], SCHEMA)
    run = refine(
        rows, CONFIG, store.current(), store.inventory(),
        source_table="uno", job_id="j", at=datetime(2024, 1, 1),
    )
    store.write_changes(1, run.changes)  # no commit follows
    assert store.version() == 0
    assert store.vault().isEmpty() and store.inventory().isEmpty()


def test_materialize_gives_back_the_cleaned_source(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"))
    config = spark.createDataFrame(
        [
            ("uno", "codigo", "texto", True, True),
            ("uno", "precio", "moneda", False, True),
            ("uno", "precio", "texto", False, True),
        ],
        "Tabla string, columna_origen string, tipo_dato_generico string, es_llave boolean, "
        "guardar boolean",
    )
    rows = spark.createDataFrame(
        [("A", "$ 1,50"), ("B", None), ("C", "-2")], "codigo string, precio string"
    )
    run_refine(
        store, rows, config, source_table="uno", job_id="j", at=datetime(2024, 1, 1)
    )
    spark.sql("DROP TABLE IF EXISTS wide_uno")
    for _ in range(2):  # replacing is idempotent
        run = run_materialize(
            store.vault(), config, source_table="uno", target_table="wide_uno"
        )
    assert (run.entidades_materializadas, run.columnas_creadas) == (3, 8)
    got = {r["codigo"]: r["precio"] for r in spark.table("wide_uno").collect()}
    assert {k: None if v is None else float(v) for k, v in got.items()} == {
        "A": 1.5, "B": None, "C": -2.0,
    }
    broken = spark.createDataFrame([("A", "1.234,56")], "codigo string, precio string")
    run_refine(store, broken, config, source_table="uno", job_id="k", at=datetime(2024, 1, 2))
    with pytest.raises(Exception, match="not a number"):
        run_materialize(store.vault(), config, source_table="uno", target_table="wide_uno")
    spark.sql("DROP TABLE IF EXISTS wide_uno")
    run_materialize(
        store.vault(), config, source_table="uno", target_table="wide_uno", on_bad_number="null"
    )
    assert spark.table("wide_uno").filter("precio IS NULL").count() == 1


def test_config_is_read_tolerantly(spark):
    config = spark.createDataFrame(
        [
            ("uno", " b ", None, "false", None),
            ("uno", "a", "peso", "si", "0"),
            ("uno", "  ", None, None, None),
            ("dos", "z", None, None, None),
        ],
        "TABLA string, propiedad string, tipoDatoGenerico string, esLlave string, guardar string",
    )
    assert load_config(config, "uno") == [
        ConfigRow("a", "peso", True, False),
        ConfigRow("b", "texto", False, True),
    ]
    with pytest.raises(ValueError, match="no configuration rows"):
        load_config(config, "tres")
    with pytest.raises(ValueError, match="tabla"):
        load_config(config.drop("TABLA"), "uno")


def test_older_tables_are_aligned(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"))
    vault = spark.createDataFrame(
        [("e", "p", "v", "uno")],
        "entidad_interna_id string, propiedad_origen string, valor_limpio string, tabla_origen string",
    )
    inventory = spark.createDataFrame(
        [("e", "k")], "entidad_interna_id string, llave_humana_completa string"
    )
    store.load(vault, inventory, datetime(2024, 1, 1))
    row = store.current().first()
    assert (row["origen_dato"], row["estado"], row["firma_auditoria"]) == (
        "carga_masiva", "VIGENTE", "",
    )
    entity = store.inventory().first()
    assert (entity["estado_entidad"], entity["tabla_origen"]) == ("ACTIVO", "")


def test_a_committed_version_must_be_there(spark, tmp_path):
    import shutil

    store = VaultStore(spark, str(tmp_path / "store"))
    assert store.vault().isEmpty() and store.current().isEmpty()
    vault = spark.createDataFrame([("e", "p")], "entidad_interna_id string, propiedad_origen string")
    store.load(vault, empty(spark, INVENTORY_SCHEMA), datetime(2024, 1, 1))
    assert store.current().count() == 1
    shutil.move(str(tmp_path / "store" / "vault" / "version=1"), str(tmp_path / "elsewhere"))
    for read in (store.current, store.vault):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            read().count()


def test_a_failed_run_is_listed(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"))
    assert store.failures().isEmpty()
    rows = spark.createDataFrame([(1, "A", "n", "x", 1.0, "")], SCHEMA)
    config = spark.createDataFrame([("dos", "codigo")], "tabla string, columna_origen string")
    with pytest.raises(ValueError):
        run_refine(
            store, rows, config, source_table="uno", job_id="j9", at=datetime(2024, 1, 1)
        )
    failure = store.failures().first()
    assert failure["job_id"] == "j9" and "no configuration rows" in failure["error"]
    assert store.version() == 0


def test_a_run_reads_its_source_twice(spark, tmp_path):
    path = str(tmp_path / "source")
    spark.createDataFrame([(1, "A", "n", "x", 1.0, "")], SCHEMA).write.parquet(path)
    source = spark.read.parquet(path)
    written = []

    def keep(counted):
        written.append(counted._jdf.queryExecution().optimizedPlan().toString())
        counted.write.parquet(str(tmp_path / "counted"))
        return spark.read.parquet(str(tmp_path / "counted"))

    run = refine(
        source, CONFIG, empty(spark, VAULT_SCHEMA), empty(spark, INVENTORY_SCHEMA),
        source_table="uno", job_id="j", at=datetime(2024, 1, 1), keep=keep,
    )
    # the columns of the source are named in its own scans only
    assert written[0].count("Relation [") == 1
    changes = run.changes._jdf.queryExecution().optimizedPlan().toString()
    assert sum("zona" in line for line in changes.splitlines() if "Relation [" in line) == 1
    stored = spark.createDataFrame(run.changes.collect(), run.changes.schema)
    for later in (run.inventory(stored), run.summary(stored)):
        plan = later._jdf.queryExecution().optimizedPlan().toString()
        assert not any("zona" in line for line in plan.splitlines() if "Relation [" in line)


def _wide_vault(spark, entities: int, properties: int):
    """Current rows of entities, some properties missing or NULL, one value with odd characters."""
    ids = spark.range(entities).select(F.col("id").cast("string").alias("entidad_interna_id"))
    names = F.explode(F.sequence(F.lit(0), F.lit(properties - 1))).alias("p")
    value = F.when(F.col("p") % 7 == 3, None).otherwise(
        F.concat(F.col("entidad_interna_id"), F.lit('"\\é.'), F.col("p"))
    )
    number = F.concat(F.col("entidad_interna_id"), F.lit("."), F.col("p"))
    return ids.select("*", names).where("(entidad_interna_id + p) % 11 <> 5").select(
        "entidad_interna_id",
        F.concat(F.lit("K"), "entidad_interna_id").alias("llave_humana_completa"),
        F.concat(F.lit("p `x`."), F.col("p")).alias("propiedad_origen"),
        F.when(F.col("p") % 5 == 0, number).otherwise(value).alias("valor_limpio"),
        F.lit("uno").alias("tabla_origen"),
        F.lit("VIGENTE").alias("estado"),
        F.lit("carga_masiva").alias("origen_dato"),
        F.lit(None).cast("string").alias("creado_por"),
        F.lit(datetime(2024, 1, 1)).alias("desde"),
    )


def test_pivot_by_map_equals_pivot_by_conditions(spark):
    vault = _wide_vault(spark, 30, 60).unionByName(_wide_vault(spark, 3, 2)).cache()
    config = [
        ConfigRow(f"p `x`.{i}", "numero" if i % 5 == 0 else "texto") for i in range(62)
    ]
    one, two = (
        wide_entities(vault, config, source_table="uno", map_from=n) for n in (1, 1000)
    )
    assert one.schema == two.schema
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    types = {f.name: f.dataType.simpleString() for f in one.schema}
    assert types["p `x`.55"] == "decimal(4,2)" and types["p `x`.60"] == "decimal(1,0)"


def test_numbers_of_any_scale(spark):
    texts = ["+007.50", "-0", ".5", "5.", "8.219999999999999", "-508.05999999999995", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "valor_limpio string")
    whole, decimals = number_digits(F.col("valor_limpio"))
    most = rows.agg(F.max(whole), F.max(decimals)).first()
    kind = number_type(*most)
    assert kind == "decimal(18,15)"
    for scale in (kind, "string"):
        typed = rows.select("valor_limpio", typed_value(F.col("valor_limpio"), "peso", scale=scale))
        for text, number in typed.collect():
            assert number is None if not text else Decimal(number) == Decimal(text)
    assert number_type(30, 9) == "string" and number_type(None, None) == "decimal(1,0)"
    for bad in ("1.2.3", "+-1", ".", "-", "1-"):
        one = spark.createDataFrame([(bad,)], "v string")
        for scale in ("string", "decimal(5,2)", 3):
            assert one.select(typed_value(F.col("v"), "peso", "null", scale)).first()[0] is None


CONFIG_ROWS = [("uno", *vars(row).values()) for row in CONFIG]
CONFIG_SCHEMA = (
    "tabla string, columna_origen string, tipo_dato_generico string, es_llave boolean, "
    "guardar boolean"
)


def test_an_edit_writes_the_bucket_of_its_entity(spark, tmp_path):
    path = tmp_path / "store"
    store = VaultStore(spark, str(path), buckets=50)
    config = spark.createDataFrame(CONFIG_ROWS, CONFIG_SCHEMA)
    rows = [(i, f"c{i}", "z", f"n{i}", float(i), "") for i in range(400)]
    source = spark.createDataFrame(rows, SCHEMA)
    run_refine(store, source, config, source_table="uno", job_id="j1", at=datetime(2024, 1, 1))
    before = vault_rows(store.vault())
    entity = store.current().filter("valor_limpio = 'n7'").first()["entidad_interna_id"]
    edit = spark.createDataFrame(
        [("uno", entity, "nombre", "other", "ana@example.org")],
        "source_table string, entidad_interna_id string, propiedad string, nuevo_valor string, "
        "usuario_email string",
    )
    run = run_edits(
        store, edit, config, source_table="uno", job_id="j2", at=datetime(2024, 1, 2)
    )
    assert VaultStore(spark, str(path), buckets=3).buckets == 50
    written = spark.read.parquet(str(path / "vault" / f"version={run.version}"))
    inventory = spark.read.parquet(str(path / "inventory" / f"version={run.version}"))
    assert written.count() < 1200 / 10 and written.select("bucket").distinct().count() == 1
    assert inventory.count() < 400 / 10
    after = vault_rows(store.vault())
    assert sum((after - before).values()) == 2 and sum((before - after).values()) == 1
    assert store.inventory().count() == 400
    assert run.summary.first()["registros_actualizados"] == 1
    nothing = run_edits(
        store, edit, config, source_table="uno", job_id="j3", at=datetime(2024, 1, 3)
    )
    assert nothing.summary.first()["registros_sin_cambio"] == 1
    assert vault_rows(store.vault()) == after


def test_two_runs_at_a_time_lose_nothing(spark, tmp_path, monkeypatch):
    config = spark.createDataFrame(CONFIG_ROWS, CONFIG_SCHEMA)
    first, second = (VaultStore(spark, str(tmp_path / "store")) for _ in range(2))
    one, two = (
        spark.createDataFrame([(1, code, "n", "x", 1.0, "")], SCHEMA) for code in ("A", "B")
    )
    commit, versions = VaultStore.commit, []

    def late(store, version, job_id, at, base=None):
        """The first run is about to commit when the second one runs from start to end."""
        versions.append((job_id, version))
        if store is first and len(versions) == 1:
            run_refine(second, two, config, source_table="dos", job_id="b", at=at)
        commit(store, version, job_id, at, base)

    config = config.unionByName(config.withColumn("tabla", F.lit("dos")))
    monkeypatch.setattr(VaultStore, "commit", late)
    run = run_refine(first, one, config, source_table="uno", job_id="a", at=datetime(2024, 1, 1))
    assert versions == [("a", 1), ("b", 2), ("a", 3)] and run.version == 3
    assert [c["version"] for c in first.commits()] == [2, 3]
    found = {(r["tabla_origen"], r["job_id"]) for r in second.current().collect()}
    assert found == {("uno", "a"), ("dos", "b")}
    assert second.inventory().count() == 2


def test_claims_are_given_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda _: claim_next(spark, str(tmp_path / "c"), 0), range(24)))
    assert sorted(numbers) == list(range(1, 25))
    assert create_if_absent(spark, str(tmp_path / "f"), "é") and read_file(spark, str(tmp_path / "f")) == "é"
    assert not create_if_absent(spark, str(tmp_path / "f"), "x")
    assert read_file(spark, str(tmp_path / "none")) is None


def test_interleaved_history_runs_get_two_numbers(spark):
    spark.sql("DROP TABLE IF EXISTS raced")
    rows = [spark.createDataFrame([(i,)], "v int") for i in range(2)]
    numbers = [history.claim_run_id(spark, "raced") for _ in rows]
    assert numbers[1] == numbers[0] + 1
    for row, number in reversed(list(zip(rows, numbers, strict=True))):
        history.append(history.stamp(row, number, datetime(2024, 1, 1)), "raced")
    found = {(r["v"], r["run_id"]) for r in spark.table("raced").collect()}
    assert found == {(0, numbers[0]), (1, numbers[1])}
    assert history.claim_run_id(spark, "raced") == numbers[1] + 1
    spark.sql("DROP TABLE raced")


def test_ranges_of_hot_entities_follow_their_records(spark, monkeypatch):
    rows = [(i, "k", "z", f"n{i}", float(i % 3), "n") for i in range(200)]
    asked = []
    chained = scd2._chained_in_ranges

    def counted(current, records, ranges):
        asked.append(ranges)
        return chained(current, records, ranges)

    monkeypatch.setattr(scd2, "_chained_in_ranges", counted)
    run = refine(
        spark.createDataFrame(rows, SCHEMA), CONFIG, empty(spark, VAULT_SCHEMA),
        empty(spark, INVENTORY_SCHEMA), source_table="uno", job_id="j",
        at=datetime(2024, 1, 1), order_by=["seq"], hot_rows=3,
    )
    assert run.changes.filter("estado = 'VIGENTE'").count() == len(KEPT)
    # a range for every three records would be a task each
    assert asked == [8]


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_a_first_run_neither_stages_nor_looks_for_missing_entities(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"))
    config = spark.createDataFrame(CONFIG_ROWS, CONFIG_SCHEMA)
    rows = [(i, f"c{i}", "z", f"n{i}", float(i), "") for i in range(40)]
    source = spark.createDataFrame(rows, SCHEMA)
    run_refine(store, source, config, source_table="uno", job_id="j1", at=datetime(2024, 1, 1))
    assert not (tmp_path / "store" / "staged").exists()
    assert store.current().count() == 40 * len(KEPT) and store.inventory().count() == 40
    second = refine(
        source, CONFIG, store.current(), store.inventory(), source_table="dos", job_id="j2",
        at=datetime(2024, 1, 2),
    )
    assert second.missing.isEmpty() and "LeftOuter" not in _plan(second.changes)
    assert second.inventory().count() == 40
    third = refine(
        source.limit(3), CONFIG, store.current(), store.inventory(), source_table="uno",
        job_id="j3", at=datetime(2024, 1, 3),
    )
    assert third.missing.count() == 37


def test_hot_values_are_bounded_by_groups_first(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") % 500).cast("string").alias("k"))
    monkeypatch.setattr(skew, "written", lambda *_: pytest.fail("all values were counted"))
    assert skew.hot_values(rows, F.col("k"), 900, within=rows) is None
    monkeypatch.undo()
    one = rows.unionByName(spark.range(950).select(F.lit("7").alias("k")))
    for alike in (None, F.concat(F.lit("x"), "k")):
        hot = skew.hot_values(one, F.col("k"), 900, within=one, alike=alike)
        assert [tuple(row) for row in hot.collect()] == [("7", 960)]
    assert skew.hot_values(one, F.col("k"), 9, within=one).count() == 500


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    store = VaultStore(spark, str(tmp_path / "store"), buckets=1)
    config = spark.createDataFrame(CONFIG_ROWS, CONFIG_SCHEMA)
    source = spark.range(4000).select(
        F.col("id").cast("int").alias("seq"), F.concat(F.lit("c"), "id").alias("codigo"),
        F.lit("z").alias("zona"), F.sha1(F.col("id").cast("string")).alias("nombre"),
        F.rand(1).alias("precio"), F.lit("").alias("nota"),
    ).repartition(8)
    with (
        setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k"),
        setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"),
    ):
        run_refine(store, source, config, source_table="uno", job_id="j", at=datetime(2024, 1, 1))
    files = list((tmp_path / "store" / "vault").rglob("*.parquet"))
    assert len(files) > 1 and store.current().count() == 4000 * len(KEPT)
