"""Stage tables with a manifest: built from what they were built from, in versions that are whole, changed records alone rebuilt.

A stage's folder has versions (`versions/v-<number>-<id>`), each a manifest file, and the data of partitions
(`data/<id>/part=<k>`) that versions refer to. A version is there once its manifest has been renamed into place; two builders
at once each leave a whole one under its own name. Nothing that a reader may hold is overwritten.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of a stage by the hash of its key: what a changed record makes new.
PARTS = 32


class _Store:
    """Files of a folder by Hadoop's file system, so any that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        at = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        f = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def write(self, name: str, text: str) -> None:
        """Put a file of a new name there, whole or not at all."""
        own = self.path(f".{uuid.uuid4().hex}")
        f = self.fs.create(own)
        f.write(bytearray(text.encode()))
        f.close()
        self.fs.mkdirs(self.path(name).getParent())
        if not self.fs.rename(own, self.path(name)):
            raise OSError(f"{self.root}/{name} can't be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Stage:
    """A table built from one or more inputs by `build`, which gets a name's rows of the keys to build and gives rows with `key`.

    `code` names the version of the code, `params` what it was called with: another of either builds everything anew.
    A build must give each key's rows from that key's input rows alone.
    """

    name: str
    key: str
    build: Callable[..., DataFrame]
    code: str
    params: dict

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.key, self.code, self.params], sort_keys=True, default=str).encode()).hexdigest()


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(PARTS)).cast("int")


def fingerprints(inputs: dict[str, DataFrame], key: str) -> dict[str, str]:
    """Per partition a digest of all inputs' rows: their number, and two sums of hashes, which don't depend on the order. One aggregate per input, a row per partition."""
    out: dict[int, list] = {}
    for name in sorted(inputs):
        df = inputs[name]
        columns = sorted(df.columns)
        row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        h = lambda salt, row=row: F.sum(F.xxhash64(row, F.lit(salt)).cast("decimal(38,0)"))
        for r in df.groupBy(_part(key).alias("part")).agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).collect():
            out.setdefault(r.part, []).append([name, columns, r.n, str(r.a), str(r.b)])
    return {str(k): hashlib.sha256(json.dumps(v).encode()).hexdigest() for k, v in sorted(out.items())}


def versions(spark: SparkSession, root: str) -> list[dict]:
    """Manifests of all whole versions, the newest last."""
    store = _Store(spark, root)
    return sorted((json.loads(store.read(f"versions/{n}")) for n in store.names("versions") if n.startswith("v-")), key=lambda m: (m["number"], m["id"]))


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest version's rows."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"{root}: no version of this stage")
    return _read(spark, root, found[-1])


def _read(spark: SparkSession, root: str, manifest: dict) -> DataFrame:
    schema = manifest["schema"]
    paths = [f"{root.rstrip('/')}/data/{p['at']}/part={k}" for k, p in sorted(manifest["parts"].items()) if p["rows"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def refresh(spark: SparkSession, root: str, stage: Stage, inputs: dict[str, DataFrame]) -> DataFrame:
    """The stage's table for these inputs. What is there is read if inputs, code and parameters are the same; partitions of changed, new or vanished keys are built, the others taken over.

    A record is one or more rows of each input with its key, a NULL key is one of its own. The new version is put
    in place by one rename; a builder that fails before leaves the version before it, and files that no version has.
    """
    mark, now = stage.fingerprint(), fingerprints(inputs, stage.key)
    before = next((m for m in reversed(versions(spark, root)) if m["stage"] == mark), None)
    old = before["parts"] if before else {}
    stale = sorted(int(k) for k in now if k not in old or old[k]["inputs"] != now[k])
    latest = versions(spark, root)[-1:]
    if before and not stale and set(old) == set(now):
        if latest[0]["id"] == before["id"]:
            return _read(spark, root, before)
        made, schema = {}, before["schema"]
    else:
        run = uuid.uuid4().hex
        built = stage.build(**{n: df.where(_part(stage.key).isin(stale)) for n, df in inputs.items()})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in built.schema.fields)
        to = f"{root.rstrip('/')}/data/{run}"
        built.withColumn("part", _part(stage.key)).repartition(PARTS, "part").write.partitionBy("part").parquet(to)
        counts = {r.part: r.n for r in spark.read.parquet(to).groupBy("part").agg(F.count("*").alias("n")).collect()} if _Store(spark, to).names() != ["_SUCCESS"] else {}
        made = {str(k): {"inputs": now[str(k)], "at": run, "rows": counts.get(k, 0)} for k in stale}
        if before and schema != before["schema"]:
            raise ValueError(f"{stage.name}: other columns than before with the same code: {schema}")
    parts = {k: made.get(k) or old[k] for k in now}
    number = (versions(spark, root) or [{"number": 0}])[-1]["number"] + 1
    manifest = {"number": number, "id": uuid.uuid4().hex, "stage": mark, "name": stage.name, "code": stage.code, "params": stage.params, "schema": schema, "built": sorted(int(k) for k in made), "parts": parts}
    _Store(spark, root).write(_file(manifest), json.dumps(manifest, default=str))
    return _read(spark, root, manifest)


def _file(manifest: dict) -> str:
    return f"versions/v-{manifest['number']:08d}-{manifest['id']}"


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Drop all but the newest versions and data that none of these has; what was dropped. Not while a builder is at work."""
    store, found = _Store(spark, root), versions(spark, root)
    gone = [_file(m) for m in found[:-keep]]
    held = {p["at"] for m in found[-keep:] for p in m["parts"].values()}
    gone += [f"data/{n}" for n in store.names("data") if n not in held]
    for name in gone:
        store.delete(name)
    return gone
