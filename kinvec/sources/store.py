"""The identity store on Parquet tables.

Key material is public and Galois keys only; audit rows hold no binary or vector.
A Store's tables are folders named by a manifest; a transaction writes new
folders and then one new manifest, so all its tables change at once or none does.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.identity import OUTCOMES

MAX_VECTORS = 16
SCHEMAS = {
    "enrolled_user": "id string, display_name string, enrolled_at timestamp",
    "key_material": "user_id string, public_key binary, galois_keys binary, created_at timestamp",
    "encrypted_gallery": "user_id string, ciphertext binary, vector_count int, created_at timestamp",
    "enrolment_audit": "id long, user_id string, photos_offered int, photos_usable int, outcome string, reason string, occurred_at timestamp",
}


def check_audit(schema: T.StructType) -> None:
    for f in schema:
        if isinstance(f.dataType, T.BinaryType | T.ArrayType | T.MapType | T.StructType):
            raise ValueError(f"audit column {f.name} may not hold {f.dataType.simpleString()}")


def insert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and rows; a key that is there already, or twice in rows, raises."""
    twice = rows.groupBy(key).count().where("count > 1").select(key).union(rows.join(table, key, "left_semi").select(key)).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {twice[0][0]!r}")
    return table.unionByName(rows)


def upsert(table: DataFrame, rows: DataFrame, key: str, kept: str = "created_at") -> DataFrame:
    """rows replace those of their key; the column `kept` stays as it was there."""
    old = table.select(key, F.col(kept).alias("_old"))
    new = rows.join(old, key, "left").withColumn(kept, F.coalesce("_old", kept)).drop("_old")
    return table.join(rows, key, "left_anti").unionByName(new.select(table.columns))


def checked_gallery(rows: DataFrame) -> DataFrame:
    """rows, each with 1 to 16 vectors and a ciphertext; others raise when read."""
    good = F.col("vector_count").between(1, MAX_VECTORS) & (F.length("ciphertext") > 0)
    return rows.withColumn("vector_count", F.when(good, F.col("vector_count")).otherwise(F.raise_error(F.lit("vector_count must be 1 to 16, ciphertext not empty")).cast("int")))


def checked_outcome(rows: DataFrame) -> DataFrame:
    return rows.withColumn("outcome", F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("unknown enrolment outcome: '"), "outcome", F.lit("'"))).cast("string")))


def audit_for(table: DataFrame, user_id: str) -> DataFrame:
    return table.where(F.col("user_id") == user_id).orderBy("id")


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the users in gone (id)."""
    return {name: df.join(gone.select(F.col("id").alias("id" if name == "enrolled_user" else "user_id")), "id" if name == "enrolled_user" else "user_id", "left_anti") for name, df in tables.items()}


class Conflict(RuntimeError):
    """Another transaction was first."""


class Store:
    """The tables of SCHEMAS under a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._pending: dict[str, DataFrame] | None = None

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _version(self) -> int:
        where = self._path("manifest")
        if not self._fs.exists(where):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(where)], default=0)

    def _manifest(self) -> dict[str, str]:
        n = self._version()
        if not n:
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{n}", wholetext=True).first()[0])

    def table(self, name: str) -> DataFrame:
        """A table as it is, with what this transaction has put in."""
        if self._pending is not None and name in self._pending:
            return self._pending[name]
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{self._manifest()[name]}")

    def migrate(self) -> int:
        """Make the tables that are not there yet; the manifest's number.  Again changes nothing."""
        have = self._manifest()
        if set(SCHEMAS) - set(have):
            with self.transaction():
                for name in SCHEMAS:
                    if name not in have:
                        self._pending[name] = self.spark.createDataFrame([], SCHEMAS[name])
        return self._version()

    @contextmanager
    def transaction(self):
        """All writes inside become visible together at the end; an exception leaves the store as it was."""
        if self._pending is not None:
            raise RuntimeError("a transaction is open")
        began, self._pending = self._version(), {}
        try:
            yield self
            if self._pending:
                folders = self._manifest()
                for name, df in self._pending.items():
                    folders[name] = f"{name}/{uuid.uuid4().hex}"
                    df.write.parquet(f"{self.path}/{folders[name]}")
                self._publish(began + 1, folders)
        finally:
            self._pending = None

    def _publish(self, number: int, folders: dict[str, str]) -> None:
        try:
            out = self._fs.create(self._path(f"manifest/{number}"), False)  # no overwriting: the first of two wins
        except Exception as e:
            raise Conflict(f"manifest {number} is there already") from e
        try:
            out.write(json.dumps(folders).encode())
        finally:
            out.close()

    def _put(self, name: str, df: DataFrame) -> None:
        if self._pending is None:
            with self.transaction():
                self._pending[name] = df
        else:
            self._pending[name] = df

    def insert_users(self, rows: DataFrame) -> None:
        """New users; an id that is there already raises."""
        self._put("enrolled_user", insert(self.table("enrolled_user"), rows, "id"))

    def put_keys(self, rows: DataFrame) -> None:
        """Public and Galois keys by user: new, or in place of the old, whose created_at stays."""
        self._put("key_material", upsert(self.table("key_material"), self._known(rows), "user_id"))

    def get_keys(self, user_id: str) -> DataFrame:
        """(public_key, galois_keys) of a user; no row without any."""
        return self.table("key_material").where(F.col("user_id") == user_id).select("public_key", "galois_keys")

    def put_galleries(self, rows: DataFrame) -> None:
        """Ciphertexts of 1 to 16 vectors by user, new or in place of the old."""
        self._put("encrypted_gallery", upsert(self.table("encrypted_gallery"), checked_gallery(self._known(rows)), "user_id"))

    def get_gallery(self, user_id: str) -> DataFrame:
        """(ciphertext, vector_count) of a user; no row without any."""
        return self.table("encrypted_gallery").where(F.col("user_id") == user_id).select("ciphertext", "vector_count")

    def record(self, rows: DataFrame) -> None:
        """Audit rows (without id), numbered on from the last; outcomes other than the four raise."""
        from ..operators.ordered import positions

        check_audit(rows.schema)
        table = self.table("enrolment_audit")
        last = table.agg(F.max("id")).first()[0] or 0
        new = positions(checked_outcome(self._known(rows)).withColumn("_o", F.xxhash64("user_id")), "_o", "user_id", "occurred_at").withColumn("id", F.col("pos") + last + 1)
        self._put("enrolment_audit", table.unionByName(new.select(table.columns)))

    def for_user(self, user_id: str) -> DataFrame:
        return audit_for(self.table("enrolment_audit"), user_id)

    def delete_users(self, gone: DataFrame) -> None:
        """Users (id) and all rows of theirs."""
        left = cascade_delete({name: self.table(name) for name in SCHEMAS}, gone)
        with self.transaction():
            self._pending.update(left)

    def _known(self, rows: DataFrame) -> DataFrame:
        """rows, each of a user that is there; others raise when read."""
        users = self.table("enrolled_user").select(F.col("id").alias("user_id"), F.lit(True).alias("_there"))
        out = rows.join(users, "user_id", "left")
        return out.withColumn("user_id", F.when(F.col("_there"), F.col("user_id")).otherwise(F.raise_error(F.concat(F.lit("unknown user "), "user_id")).cast("string"))).drop("_there")


def jdbc_options(url: str, user: str, password: str, connections: int = 4) -> dict[str, str]:
    """Options for spark.read.jdbc and write.jdbc on a database with the same tables; at most so many connections at once."""
    if not url.startswith("jdbc:"):
        raise ValueError("a JDBC address begins with jdbc:")
    return {"url": url, "user": user, "password": password, "numPartitions": str(connections), "isolationLevel": "READ_COMMITTED"}
