"""Memory tables as Parquet, partitioned by tenant, and a cache table with expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from mnemoria.errors import StorageError
from mnemoria.functions import exprs as X
from mnemoria.operators.graph import within_nodes
from mnemoria.operators.lineage import cut
from mnemoria.operators.resolve import latest
from mnemoria.schema import KEYS, TABLES, TENANT


def live_entries(cache: DataFrame, now, invalidated: list[tuple[str, str]] = ()) -> DataFrame:
    """Cache rows that haven't expired and whose tenant columns equal no invalidated value."""
    out = cache.where(F.col("expires_at") > now)
    for column, value in invalidated:
        out = out.where(~F.col(column).eqNullSafe(F.lit(value)))
    return out


def conform(df: DataFrame, schema) -> DataFrame:
    """df with the columns of a schema, in order; missing ones are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


class ParquetStore:
    """Tables under ``path``: <table>/user_id=.../memory_id=.../*.parquet.

    Saving replaces the tenants' partitions that the rows belong to and no others.  The merged rows are
    computed before anything is replaced, so a failed save leaves the old ones.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str) -> DataFrame:
        empty = self.spark.createDataFrame([], TABLES[table])
        try:
            return conform(self.spark.read.schema(TABLES[table]).parquet(f"{self.path}/{table}"), TABLES[table])
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return empty
            raise StorageError(f"table {table} can't be read", table=table) from e

    def load(self, table: str, user_id: str | None = None, memory_id: str | None = None) -> DataFrame:
        """A table's rows; with a tenant, only its partitions are read."""
        out = self._read(table)
        for column, value in (("user_id", user_id), ("memory_id", memory_id)):
            out = out if value is None else out.where(F.col(column) == value)
        return out

    def load_graph(self, user_id: str, memory_id: str) -> tuple[DataFrame, DataFrame]:
        """A tenant's nodes, and its edges with both ends among them."""
        nodes = self.load("nodes", user_id, memory_id)
        return nodes, within_nodes(self.load("edges", user_id, memory_id), nodes)

    def replace(self, table: str, rows: DataFrame, tenant: tuple[str, str] | None = None) -> None:
        """The rows become the whole content of the tenants that they belong to; with ``tenant``, of that tenant
        even where there are none."""
        out = cut(conform(rows, TABLES[table]))
        if tenant is not None and out.isEmpty():
            self._drop(table, *tenant)
            return
        out.repartition(*TENANT).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TENANT).parquet(f"{self.path}/{table}")

    def _drop(self, table: str, user_id: str, memory_id: str) -> None:
        jvm = self.spark.sparkContext._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/user_id={name(user_id)}/memory_id={name(memory_id)}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def upsert(self, table: str, rows: DataFrame, by: tuple[str, ...] = ("updated_at",)) -> None:
        """Rows replace those with their key; the one updated last wins."""
        rows = cut(conform(rows, TABLES[table]))
        tenants = rows.select(*TENANT).distinct()
        old = self._read(table).join(tenants, TENANT, "left_semi").withColumn("__new", F.lit(0))
        merged = latest(old.unionByName(rows.withColumn("__new", F.lit(1))), [*TENANT, *KEYS[table]], tuple(b for b in (*by, "__new") if b in (*old.columns,)))
        self.replace(table, merged.drop("__new"))

    def append(self, table: str, rows: DataFrame) -> None:
        conform(rows, TABLES[table]).write.mode("append").partitionBy(*TENANT).parquet(f"{self.path}/{table}")

    def clear(self, user_id: str, memory_id: str) -> None:
        """One tenant's partitions go, in every table."""
        for table in TABLES:
            self._drop(table, user_id, memory_id)

    def tenants(self) -> DataFrame:
        return self._read("nodes").select(*TENANT).distinct()

    def stats(self, user_id: str, memory_id: str) -> dict[str, int]:
        return {t: self.load(t, user_id, memory_id).count() for t in ("nodes", "edges", "clusters")}

    def edges_at(self, t, user_id: str, memory_id: str, bounds: str = "closed") -> DataFrame:
        return self.load("edges", user_id, memory_id).where(X.valid_at(t, bounds=bounds))


class CacheTable:
    """Key -> value with expiry, by tenant; embeddings may be shared with user_id ``*``."""

    def __init__(self, store: ParquetStore):
        self.store = store

    def put(self, entries: DataFrame) -> None:
        self.store.upsert("cache", entries, ("expires_at",))

    def get(self, key: str, now, user_id: str, memory_id: str) -> str | None:
        row = live_entries(self.store.load("cache", user_id, memory_id).where(F.col("key") == key), now).select("value").first()
        return row[0] if row else None

    def invalidate(self, user_id: str, memory_id: str, now) -> None:
        """The tenant's entries expire now; no other tenant's do, whatever their names."""
        own = self.store.load("cache", user_id, memory_id)
        self.store.replace("cache", own.withColumn("expires_at", F.least("expires_at", now)))
