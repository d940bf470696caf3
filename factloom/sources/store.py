"""A store of observations, evidence, states and relations as a log of commits.

A commit writes the rows that are new or changed under a folder of its own and then puts its manifest in place by one
rename that fails where the name is taken. So a commit is seen whole or not at all: rows without a manifest (a torn
write, a lost task's leftovers) are never read, and of two writers of one number one fails. A manifest names its parent's
digest, its tables, their rows and an order-free digest of them. ``load`` goes through all manifests and stops with an
error at a gap, a parent that doesn't match or, where asked, rows that aren't those that were written. A commit is
known by its key: the same rows under a key that is there already change nothing, other rows are an error.

The state of a table is the last row of each id. ``compact`` writes it as one commit from which readers start. Files
are reached through Spark's file systems alone; the driver reads manifests only, which hold no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.sources import snapshot

CONDITIONS = "array<struct<key:string,value:string>>"
#: Schema of each table and the columns that name a row.
TABLES = {
    "observations": ("group_id string, observation_id string, observation_index long, observed_at timestamp_ntz, status string, reason string", ["group_id", "observation_id"]),
    "evidence": ("group_id string, evidence_id string, observation_id string, observed_at timestamp_ntz, source_text string, span string", ["group_id", "evidence_id"]),
    "states": (
        f"group_id string, state_id string, version_id string, slot_id string, entity string, attribute string, value string, status string, uncertainty string, revalidate boolean, t0 timestamp_ntz, t1 timestamp_ntz, cond {CONDITIONS}, confidence double, observed_at timestamp_ntz, observation_id string, observation_index long, sequence_index long, span string, evidence_ids array<string>, duplicate_of string",
        ["group_id", "state_id"],
    ),
    "relations": ("group_id string, relation_id string, source string, target string, relation_type string, strength string, reason string, evidence_id string, created_at timestamp_ntz", ["group_id", "relation_id"]),
}
FORMAT = 1


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table][0])


class StoreError(RuntimeError):
    """The log is not what was written."""


class Conflict(StoreError):
    """Another writer has taken the number, or a key has other rows."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.FileContext.getFileContext(self._at("").toUri(), spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        util = self._files.util()
        if not util.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in util.listStatus(self._at(folder)))

    def _read(self, name: str) -> str:
        stream = self._files.open(self._at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Writes a small file that is there whole or not at all; one of that name is an error."""
        java = self.spark._jvm
        flag, parent = java.java.util.EnumSet, self.spark.sparkContext._gateway.new_array(self._hadoop.Options.CreateOpts, 1)
        parent[0] = self._hadoop.Options.CreateOpts.createParent()
        part = f"{name.rpartition('/')[0] or '.'}/.{uuid.uuid4().hex}.part"
        stream = self._files.create(self._at(part), flag.of(self._hadoop.CreateFlag.CREATE), parent)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        none[0] = self._hadoop.Options.Rename.NONE
        try:
            self._files.rename(self._at(part), self._at(name), none)
        except Exception as e:
            self._files.delete(self._at(part), False)
            raise Conflict(f"{name} is taken") from e

    def load(self, verify: bool = False) -> list[dict]:
        """All manifests in order; an error where the log has a gap, a wrong parent or (``verify``) other rows."""
        out, parent = [], None
        for name in self._names("commits"):
            if not name.endswith(".json"):
                continue
            text = self._read(f"commits/{name}")
            try:
                m = json.loads(text)
                if m["format"] != FORMAT:
                    raise StoreError(f"{name} has format {m['format']}")
            except (ValueError, KeyError, TypeError) as e:
                raise StoreError(f"{name} can't be read") from e
            if m["number"] != len(out) + 1 or name != f"{m['number']:012d}.json":
                raise StoreError(f"the log goes from {len(out)} to {name}")
            if m["parent"] != parent:
                raise StoreError(f"{name} doesn't follow the commit before it")
            parent = hashlib.sha256(text.encode()).hexdigest()
            out.append({**m, "digest": parent})
        if verify:
            for m in out:
                found = self._digests({table: self._data(table, t["path"]) for table, t in m["tables"].items()})
                for table, t in m["tables"].items():
                    if found[table] != (t["rows"], t["digest"]):
                        raise StoreError(f"commit {m['number']}: {table} isn't what was written")
        return out

    def _data(self, table: str, path: str) -> DataFrame:
        return self.spark.read.schema(schema(table)).parquet(f"{self.path}/{path}")

    def _digests(self, frames: dict[str, DataFrame]) -> dict[str, tuple[int, str]]:
        """Of each frame its rows and two sums over them that don't depend on their order, in one job."""
        parts = []
        for name, df in frames.items():
            one = F.sha2(F.to_json(F.struct(*sorted(df.columns)), snapshot.FORMAT), 256)
            half = lambda at, one=one: F.sum(F.conv(F.substring(one, at, 12), 16, 10).cast("decimal(38,0)"))
            parts.append(df.agg(F.count("*").alias("n"), half(1).alias("a"), half(13).alias("b")).withColumn("name", F.lit(name)))
        rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
        return {r["name"]: (r["n"], f"{int(r['a'] or 0):x}.{int(r['b'] or 0):x}") for r in rows}

    def commit(self, tables: dict[str, DataFrame], key: str, base: bool = False, dealt: bool = False) -> int:
        """Appends rows (new, or changed ones in whole) and returns the commit's number. ``dealt``: the rows lie in parts of a size to be files already."""
        log = self.load()
        written = {}
        paths = {table: f"data/{table}/{uuid.uuid4().hex}" for table in tables}
        for table, df in tables.items():
            rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema(table)])
            # ids are hex digits, which only an entropy coder makes shorter
            (rows if dealt else rows.hint("rebalance")).write.option("compression", "zstd").parquet(f"{self.path}/{paths[table]}")
        for table, (rows, digest) in self._digests({t: self._data(t, p) for t, p in paths.items()}).items():
            if rows:
                written[table] = {"path": paths[table], "rows": rows, "digest": digest}
        same = [m for m in log if m["key"] == key]
        if same:
            if {t: x["digest"] for t, x in same[0]["tables"].items()} != {t: x["digest"] for t, x in written.items()}:
                raise Conflict(f"key {key} is commit {same[0]['number']} with other rows")
            return same[0]["number"]
        number = len(log) + 1
        manifest = {"format": FORMAT, "number": number, "parent": log[-1]["digest"] if log else None, "key": key, "base": base, "tables": written}
        self._put(f"commits/{number:012d}.json", json.dumps(manifest, sort_keys=True))
        return number

    def table(self, name: str, groups: DataFrame | None = None) -> DataFrame:
        """The last row of each id, of all groups or those in ``groups`` (group_id): others are left out before rows are dealt by id."""
        log = self.load()
        start = max((i for i, m in enumerate(log) if m["base"]), default=0)
        parts = [(m["number"], m["tables"][name]["path"]) for m in log[start:] if name in m["tables"]]
        if not parts:
            return self.spark.createDataFrame([], schema(name))
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/data/[a-z]+/([0-9a-f]{32})/", 1)
        order = F.create_map(*[F.lit(x) for n, p in parts for x in (p.rsplit("/", 1)[1], n)])
        read = self.spark.read.schema(schema(name)).parquet(*[f"{self.path}/{p}" for _, p in parts]).withColumn("_commit", order[folder])
        if groups is not None:
            read = read.join(groups.select("group_id").distinct(), "group_id", "left_semi")
        row = F.struct(*[f.name for f in schema(name)])
        if len(parts) == 1:
            return read.select(*[f.name for f in schema(name)])
        last = read.groupBy(*TABLES[name][1]).agg(F.max_by(row, "_commit").alias("_row"))
        return last.select("_row.*")

    def compact(self) -> int:
        """One commit that holds the state of all tables; readers start from it."""
        number = len(self.load())
        return self.commit({t: self.table(t) for t in TABLES}, f"compact-{number}", base=True)

    def states(self, groups: DataFrame | None = None, statuses: list[str] | None = None) -> DataFrame:
        """States of the groups (group_id) with one of the statuses."""
        out = self.table("states", groups)
        return out if statuses is None else out.where(F.col("status").isin(statuses))

    def relations(self, groups: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
        out = self.table("relations", groups)
        return out if types is None else out.where(F.col("relation_type").isin(types))

    def evidence_of(self, wanted: DataFrame) -> DataFrame:
        """wanted (group_id, evidence_id) with the evidence's columns; null where there is none."""
        return wanted.join(self.table("evidence"), ["group_id", "evidence_id"], "left")

    def clear_groups(self, groups: DataFrame, key: str) -> int:
        """A base commit of everything but the groups' rows."""
        gone = groups.select("group_id").distinct()
        return self.commit({t: self.table(t).join(gone, "group_id", "left_anti") for t in TABLES}, key, base=True)

    def export(self, path: str) -> None:
        """Every table as canonical JSON lines with digests, and what they must add up to."""
        for name in TABLES:
            snapshot.write(self.table(name), f"{path}/{name}")
        totals = self._digests({name: self.table(name) for name in TABLES})
        Store(self.spark, path)._put("snapshot.json", json.dumps({"format": FORMAT, "tables": totals}, sort_keys=True))

    @classmethod
    def restore(cls, spark: SparkSession, snapshot_path: str, path: str) -> Store:
        """A new store from an export; a damaged line, a missing table or other totals are an error."""
        store, source = cls(spark, path), cls(spark, snapshot_path)
        totals = json.loads(source._read("snapshot.json"))
        if totals["format"] != FORMAT or set(totals["tables"]) != set(TABLES):
            raise StoreError("the snapshot has another format")
        tables = {name: snapshot.restored(spark.read.parquet(f"{snapshot_path}/{name}"), schema(name)) for name in TABLES}
        for name, found in store._digests(tables).items():
            if list(found) != totals["tables"][name]:
                raise StoreError(f"{name} isn't what was exported")
        store.commit(tables, "restore", base=True)
        return store
