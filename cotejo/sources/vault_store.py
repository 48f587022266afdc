"""Vault and inventory on plain parquet, in numbered versions of buckets of entities.

Rows are dealt into a fixed number of buckets by a hash of their entity. A run writes, under its own
version number, the buckets that it changes: their current rows, and the rows it closed. The
version's manifest says for every bucket which version holds its current rows, so buckets that a run
does not touch are listed by reference and neither read nor written for the store's sake.

A run claims its number first, so two runs never write to the same folder. It becomes visible by a
commit that names the version it builds on; a version can be followed once only, by whichever run
commits first. The other one finds its base outdated (``Outdated``), and is run again on the new one.
A run that dies leaves a folder that no commit mentions. Closed rows are those of all committed
versions.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime
from typing import TypeVar

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cotejo.operators.scd2 import CHANGE, DROPPED, ENDED, KEPT, PROPERTY
from cotejo.operators.state import CURRENT, INVENTORY_SCHEMA, VAULT_SCHEMA, aligned, empty
from cotejo.sources.claims import claim_next, create_if_absent, names_in, read_file

#: Of a new store: choose more for large ones, a bucket's current rows are read and written as one.
BUCKETS = 16
ENTITY = "entidad_interna_id"
#: How often a run is planned anew because another one committed first.
ATTEMPTS = 5

_BUCKET = T.StructField("bucket", T.IntegerType())
_STORED_VAULT = T.StructType(
    [f for f in VAULT_SCHEMA if f.name != "estado"]
    + [
        T.StructField(CHANGE, T.StringType()),
        T.StructField("version", T.IntegerType()),
        _BUCKET,
        T.StructField("estado", T.StringType()),
    ]
)
_STORED_INVENTORY = T.StructType(
    [*INVENTORY_SCHEMA, T.StructField("version", T.IntegerType()), _BUCKET]
)
Manifest = dict[str, dict[int, int]]  # part -> bucket -> version that holds it
Result = TypeVar("Result")


def _compact(rows: DataFrame) -> DataFrameWriter:
    """Ids and hashes are most of a vault: texts of hex digits, which zstd halves."""
    return rows.write.mode("overwrite").option("compression", "zstd")


class Outdated(RuntimeError):
    """Another run has committed on the version that this one builds on."""


class VaultStore:
    """``buckets`` counts for a new store; an existing one keeps its number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self._wanted = buckets
        self._pending: dict[int, Manifest] = {}  # versions written and not committed by this store
        self._bases: dict[int, int] = {}

    # --- versions ---

    def commits(self) -> list[dict]:
        """What was committed, in order: version, base, job and time."""
        folder = f"{self.path}/commits"
        texts = [read_file(self.spark, f"{folder}/{n}") for n in names_in(self.spark, folder)]
        return sorted(map(json.loads, texts), key=lambda c: c["version"])

    def version(self) -> int:
        """The last committed version, 0 for a new store."""
        names = names_in(self.spark, f"{self.path}/commits")
        if not names:
            return 0
        # versions that follow one another rise, so the commit on the highest base is the last
        return json.loads(read_file(self.spark, f"{self.path}/commits/{names[-1]}"))["version"]

    def claim(self) -> int:
        """A version number of this run's own."""
        return claim_next(self.spark, f"{self.path}/claims", self.version())

    def commit(self, version: int, job_id: str, at: datetime, base: int | None = None) -> None:
        """Make a written version visible, as the one that follows its base."""
        base = self._bases.get(version, self.version()) if base is None else base
        manifest = json.dumps(self._manifest(version))
        create_if_absent(self.spark, f"{self.path}/manifests/{version:012d}", manifest)
        entry = {"version": version, "base": base, "job_id": job_id, "committed_at": at.isoformat()}
        if not create_if_absent(self.spark, f"{self.path}/commits/{base:012d}", json.dumps(entry)):
            raise Outdated(f"version {base} has been followed by another run's")
        self._pending.pop(version, None)

    def _manifest(self, version: int) -> Manifest:
        if version in self._pending:
            return self._pending[version]
        if not version:
            return {"vault": {}, "inventory": {}}
        text = read_file(self.spark, f"{self.path}/manifests/{version:012d}")
        if text is None:
            raise FileNotFoundError(f"version {version} of {self.path} has no manifest")
        return {part: {int(b): v for b, v in m.items()} for part, m in json.loads(text).items()}

    def _draft(self, version: int) -> Manifest:
        """The manifest of a version being written; it starts as that of its base."""
        if version not in self._pending:
            base = self._bases.setdefault(version, self.version())
            self._pending[version] = {p: dict(m) for p, m in self._manifest(base).items()}
        return self._pending[version]

    def begin(self, base: int) -> int:
        """Claim a version that will follow ``base``."""
        version = self.claim()
        self._bases[version] = base
        return version

    def run_again(self, run: Callable[[], Result]) -> Result:
        """A run that claims, writes and commits, planned anew while others commit before it."""
        for _ in range(ATTEMPTS - 1):
            try:
                return run()
            except Outdated:
                continue
        return run()

    # --- buckets ---

    @property
    def buckets(self) -> int:
        path = f"{self.path}/buckets"
        create_if_absent(self.spark, path, str(self._wanted))
        return int(read_file(self.spark, path))

    def bucket_of(self, entity: Column) -> Column:
        """The bucket of an entity; one without id has a bucket like any other."""
        return F.pmod(F.xxhash64(entity), F.lit(self.buckets)).cast("int")

    def touched(self, entities: DataFrame) -> list[int]:
        """The buckets of the ids in the first column: at most as many rows as there are buckets."""
        bucket = self.bucket_of(F.col(entities.columns[0])).alias("bucket")
        return sorted(row["bucket"] for row in entities.select(bucket).distinct().collect())

    def _files(
        self, part: str, schema: T.StructType, version: int, buckets: Sequence[int] | None
    ) -> DataFrame:
        held = self._manifest(version)[part]
        wanted = held if buckets is None else [b for b in buckets if b in held]
        root = f"{self.path}/{part}"
        paths = [f"{root}/version={held[b]}/bucket={b}" for b in sorted(wanted)]
        if not paths:
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    # --- reading ---

    def current(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        wanted = self.version() if version is None else version
        rows = self._files("vault", _STORED_VAULT, wanted, buckets)
        return rows.filter(F.col("estado") == CURRENT).select(*VAULT_SCHEMA.names)

    def _closed(self, versions: Sequence[int]) -> DataFrame:
        root = f"{self.path}/vault"
        paths = [f"{root}/version={v}" for v in versions]
        if not paths:
            return empty(self.spark, _STORED_VAULT)
        rows = self.spark.read.schema(_STORED_VAULT).option("basePath", root).parquet(*paths)
        return rows.filter(F.col("estado") != CURRENT)

    def changes(self, version: int) -> DataFrame:
        """Current rows after a run and the rows it closed, with its labels."""
        rows = self._files("vault", _STORED_VAULT, version, None).filter(F.col("estado") == CURRENT)
        own = F.when(F.col("version") == version, F.col(CHANGE)).otherwise(KEPT).alias(CHANGE)
        names = VAULT_SCHEMA.names
        return rows.select(*names, own).unionByName(self._closed([version]).select(*names, CHANGE))

    def vault(self) -> DataFrame:
        """Current and closed rows."""
        closed = self._closed([c["version"] for c in self.commits()])
        return self.current().unionByName(closed.select(*VAULT_SCHEMA.names))

    def inventory(
        self, version: int | None = None, buckets: Sequence[int] | None = None
    ) -> DataFrame:
        wanted = self.version() if version is None else version
        rows = self._files("inventory", _STORED_INVENTORY, wanted, buckets)
        return rows.select(*INVENTORY_SCHEMA.names)

    # --- writing ---

    def load(self, vault: DataFrame, inventory: DataFrame, at: datetime) -> None:
        """Take over existing tables; columns they lack are added with their defaults."""
        version = self.begin(self.version())
        rows = aligned(vault, VAULT_SCHEMA).withColumn(CHANGE, F.lit(KEPT))
        self._draft(version)["vault"].clear()
        self._write_vault(version, self._bucketed(rows))
        self.write_inventory(version, aligned(inventory, INVENTORY_SCHEMA))
        self.commit(version, "load", at)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self.bucket_of(F.col(ENTITY)))

    def _write(self, part: str, version: int, rows: DataFrame, keys: list[str]) -> list[int]:
        """Write rows by bucket and state, large buckets in several files; gives the buckets that
        have some."""
        target = f"{self.path}/{part}/version={version}"
        placed = rows.hint("rebalance", F.col("bucket"))
        _compact(placed).partitionBy(*keys).parquet(target)
        found = (name.partition("=") for name in names_in(self.spark, target))
        return sorted(int(value) for key, _, value in found if key == "bucket")

    def _write_vault(self, version: int, rows: DataFrame) -> None:
        placed = rows.select(*VAULT_SCHEMA.names, CHANGE, "bucket")
        found = self._write("vault", version, placed, ["bucket", "estado"])
        self._draft(version)["vault"].update(dict.fromkeys(found, version))

    def write_changes(self, version: int, rows: DataFrame) -> None:
        """Write the buckets that the labelled rows of a run change. What the run left as it was is
        taken from the stored buckets, so it need not be computed to be written."""
        self._draft(version)
        base = self._bases[version]
        path = f"{self.path}/staged/version={version}"
        moved = self._bucketed(rows.filter(F.col(CHANGE) != KEPT))
        if not self._manifest(base)["vault"]:
            self._write_vault(version, moved)  # there is nothing to be put beside
            return
        _compact(moved).parquet(path)
        staged = self.spark.read.schema(moved.schema).parquet(path)
        buckets = [row["bucket"] for row in staged.select("bucket").distinct().collect()]
        left = staged.filter(F.col(CHANGE).isin(ENDED, DROPPED)).select(*PROPERTY)
        same = self._bucketed(self.current(base, buckets)).withColumn(CHANGE, F.lit(KEPT))
        matched = [F.col(f"old.{k}").eqNullSafe(F.col(f"left.{k}")) for k in PROPERTY]
        kept = same.alias("old").join(left.alias("left"), matched, "left_anti")
        self._write_vault(version, kept.unionByName(staged))

    def write_inventory(
        self, version: int, rows: DataFrame, buckets: Sequence[int] | None = None
    ) -> None:
        """Write the inventory, or with ``buckets`` those of it that a run touched."""
        draft = self._draft(version)["inventory"]
        found = self._write("inventory", version, self._bucketed(rows), ["bucket"])
        for bucket in list(draft) if buckets is None else buckets:
            draft.pop(bucket, None)
        draft.update(dict.fromkeys(found, version))

    def keep_counted(self, version: int, rows: DataFrame) -> DataFrame:
        """What a run counted of its source, written beside its changes and read back."""
        path = f"{self.path}/counted/version={version}"
        _compact(rows).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    # --- failures ---

    @contextmanager
    def recorded(self, job_id: str, at: datetime) -> Iterator[None]:
        """A run whose failure is listed before it is raised."""
        try:
            yield
        except Exception as problem:
            row = self.spark.range(1, numPartitions=1).select(
                F.lit(job_id).alias("job_id"),
                F.lit(at).alias("failed_at"),
                F.lit(f"{type(problem).__name__}: {problem}"[:2000]).alias("error"),
            )
            row.write.mode("append").parquet(f"{self.path}/failures")
            raise

    def failures(self) -> DataFrame:
        """Runs that failed: job, time and reason."""
        schema = T.StructType(
            [
                T.StructField("job_id", T.StringType()),
                T.StructField("failed_at", T.TimestampType()),
                T.StructField("error", T.StringType()),
            ]
        )
        if not names_in(self.spark, f"{self.path}/failures"):
            return empty(self.spark, schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/failures")
