"""A versioned store of documents: snapshots per collection, atomic commits, optimistic transactions, a change log.

A manifest names the Parquet folders that make the current version; a commit writes new folders for the collections it
touches, appends its changes, and then swaps the manifest by one rename. Readers keep the folders they opened. There is
one writer per store; a lock in the driver orders its commits. Each document has the number of the version that wrote it,
which transactions compare, so two commits in one microsecond differ.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillon.functions import values as V
from quillon.sources.collections import DYNAMIC_SCHEMA

from .writes import Write, WriteError, dump_write, fold_writes

CHANGES_SCHEMA = "seq long, xid long, doc_name string, collection_id string, kind string, at timestamp"
TRANSACTION_SECONDS = 300


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._lock = spark, root.rstrip("/"), threading.RLock()
        self._reads: dict[str, tuple[float, dict[str, int | None]]] = {}

    # -- files --

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _read_json(self, name: str, default):
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return default
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect()))

    def _write_json(self, name: str, value) -> None:
        """One rename makes the new file visible; a reader sees the old or the new one."""
        fs, tmp = self._fs(f"{self.root}/.{name}.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        _, to = self._fs(f"{self.root}/{name}")
        jvm = self.spark.sparkContext._jvm
        rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        rename.rename(tmp, to, options)

    def manifest(self) -> dict:
        return self._read_json("CURRENT", {"version": 0, "collections": {}, "changes": []})

    # -- reads --

    def documents(self, collection_ids: Iterable[str] | None = None) -> DataFrame:
        """All documents of some collections, or of all: DYNAMIC_SCHEMA."""
        m = self.manifest()["collections"]
        paths = [p for c, p in m.items() if collection_ids is None or c in set(collection_ids)]
        return self.spark.read.schema(DYNAMIC_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], DYNAMIC_SCHEMA)

    def get(self, names: list[str], transaction: str | None = None) -> dict[str, dict]:
        """Fields of the documents that exist, by name; a transaction remembers the versions it has read first."""
        wanted = {V.document_name(n).collection_id for n in names}
        rows = self.documents(wanted).filter(F.col("name").isin(list(names))).select("name", "data", "version").collect()
        if transaction is not None:
            seen = self._transaction(transaction)
            versions = {r.name: r.version for r in rows}
            for n in names:
                seen.setdefault(n, versions.get(n))
        return {r.name: V.loads(r.data) for r in rows}

    def changes(self) -> DataFrame:
        paths = self.manifest()["changes"]
        return self.spark.read.schema(CHANGES_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGES_SCHEMA)

    # -- writes --

    def commit(self, writes: list[Write], transaction: str | None = None) -> tuple[list[list], V.Timestamp]:
        """All writes or none, in order, later ones seeing earlier ones, at one time. Returns the transforms' results."""
        rows = [(i, w.name, dump_write(w)) for i, w in enumerate(writes)]
        if bad := [w for w in writes if not w.name]:
            raise WriteError("INVALID_ARGUMENT", f"a write without a document: {bad[0].op}")
        for w in writes:
            try:
                V.document_name(w.name)
            except V.BadName as e:
                raise WriteError("INVALID_ARGUMENT", str(e)) from e
        return self.commit_table(self.spark.createDataFrame(rows, "seq long, name string, write string"), transaction, len(writes))

    def commit_table(self, writes: DataFrame, transaction: str | None = None, n_results: int | None = None):
        """Commits a table of writes (seq, name, write). With ``n_results`` the results come back, in order of seq."""
        with self._lock:
            reads = self._consume(transaction) if transaction is not None else {}
            m, now = self.manifest(), V.Timestamp(time.time_ns() // 1000)
            version = m["version"] + 1
            self._verify(reads)
            collection = F.element_at(F.split("name", "/"), -2)
            touched = [r[0] for r in writes.select(collection.alias("c")).distinct().collect()]
            docs = self.documents(touched)
            hit = docs.join(writes.select("name").distinct(), "name", "left_semi")
            current = hit.select("name", "data", F.unix_micros("create_time").alias("create_us"), F.unix_micros("update_time").alias("update_us"))
            folder = f"{self.root}/v{version:08d}-{uuid.uuid4().hex[:8]}"
            fold_writes(current, writes, now).write.parquet(f"{folder}/folded")
            folded = self.spark.read.parquet(f"{folder}/folded")
            error = folded.filter("error IS NOT NULL").select("error").orderBy("error").first()
            if error:
                self._delete(folder)
                code, _, message = error.error.partition(": ")
                raise WriteError(code, message)
            names = F.split("name", "/")
            moment = lambda c: F.timestamp_micros(F.col(c))
            new = folded.filter("data IS NOT NULL").select(
                "name", F.array_join(F.slice(names, F.lit(1), F.size(names) - 2), "/").alias("parent_path"), F.element_at(names, -2).alias("collection_id"),
                F.element_at(names, -1).alias("doc_id"), "data", moment("create_us").alias("create_time"), moment("update_us").alias("update_time"), F.lit(version).cast("long").alias("version"),
            )
            after = docs.join(folded.select("name"), "name", "left_anti").unionByName(new)
            written = {c: f"{folder}/docs-{i}" for i, c in enumerate(touched)}
            for c, path in written.items():
                after.filter(F.col("collection_id") == c).write.parquet(path)
            seq = m.get("seq", 0)
            kinds = folded.filter("changed").select(F.col("name").alias("doc_name"), F.element_at(names, -2).alias("collection_id"), F.when(F.col("data").isNull(), "delete").otherwise("write").alias("kind"))
            ranked = kinds.orderBy("doc_name").rdd.zipWithIndex().map(lambda x: (x[1] + seq, version, *x[0])).toDF("seq long, xid long, doc_name string, collection_id string, kind string")
            ranked.withColumn("at", F.timestamp_micros(F.lit(now.micros))).write.parquet(f"{folder}/log")
            collections = {c: p for c, p in m["collections"].items() if c not in touched} | written
            empty = [c for c, p in written.items() if self.spark.read.schema(DYNAMIC_SCHEMA).parquet(p).isEmpty()]
            collections = {c: p for c, p in collections.items() if c not in empty}
            n_changes = self.spark.read.parquet(f"{folder}/log").count()
            self._write_json("CURRENT", {"version": version, "collections": collections, "pruned": m.get("pruned", 0), "changes": [*m["changes"], *[f"{folder}/log"] * bool(n_changes)], "seq": seq + n_changes})
            self.publish_changes()
            if n_results is None:
                return None, now
            results: dict[str, list] = {}
            for r in folded.select("results").collect():
                results |= json.loads(r.results)
            return [[V.decode(x) for x in results.get(str(i), [])] for i in range(n_results)], now

    def batch_write(self, writes: list[Write]) -> list[str]:
        """One commit per write; each write's status."""
        out = []
        for w in writes:
            try:
                self.commit([w])
                out.append("OK")
            except WriteError as e:
                out.append(e.code)
        return out

    def drop_collection(self, collection_id: str) -> int:
        """Deletes all documents of a collection id, with their changes logged. Returns how many."""
        names = self.documents([collection_id]).select("name")
        n = names.count()
        if n:
            rest = [F.lit("delete").alias("op"), F.create_map().cast("map<string,string>").alias("fields"), F.array().cast("array<string>").alias("transforms")]
            nulls = [F.lit(None).cast("string").alias(c) for c in ("mask", "exists", "update_time")]
            text = F.to_json(F.struct("name", *rest, *nulls), {"ignoreNullFields": "false"})
            self.commit_table(names.select(F.lit(0).cast("long").alias("seq"), "name", text.alias("write")))
        return n

    def publish_changes(self) -> int:
        """Shows the logs of visible commits to streams, by a copy that appears with one rename; a run that was cut off is made
        up for by the next. Returns how many were shown. A stream never sees a commit before its state can be read."""
        shown = 0
        with self._lock:
            for log in self.manifest()["changes"]:
                folder, _, kind = log.rpartition("/")
                fs, to = self._fs(f"{folder}/changes")
                if kind != "log" or fs.exists(to):
                    continue
                tmp = f"{folder}/showing-{uuid.uuid4().hex}"
                self.spark.read.schema(CHANGES_SCHEMA).parquet(log).coalesce(1).write.parquet(tmp)
                shown += fs.rename(self._fs(tmp)[1], to)
        return shown

    def prune_changes(self, before_micros: int) -> int:
        """Forgets changes older than a time. Returns how many."""
        with self._lock:
            m = self.manifest()
            old = self.changes()
            keep = old.filter(F.unix_micros("at") >= before_micros)
            gone = old.count() - keep.count()
            if gone:
                path = f"{self.root}/changes-{uuid.uuid4().hex}"
                keep.write.parquet(path)
                last = old.filter(F.unix_micros("at") < before_micros).agg(F.max("xid")).first()[0]
                self._write_json("CURRENT", m | {"changes": [path], "pruned": max(last, m.get("pruned", 0))})
            return gone

    # -- transactions --

    def begin(self) -> str:
        token = uuid.uuid4().hex
        with self._lock:
            now = time.monotonic()
            self._reads = {k: v for k, v in self._reads.items() if now - v[0] < TRANSACTION_SECONDS}
            self._reads[token] = (now, {})
        return token

    def _transaction(self, token: str) -> dict[str, int | None]:
        began, reads = self._reads.get(token, (0.0, None))
        if reads is None or time.monotonic() - began >= TRANSACTION_SECONDS:
            raise WriteError("INVALID_ARGUMENT", "unknown or ended transaction")
        return reads

    def _consume(self, token: str) -> dict[str, int | None]:
        reads = self._transaction(token)
        del self._reads[token]
        return reads

    def rollback(self, token: str) -> None:
        self._reads.pop(token, None)

    def _verify(self, reads: dict[str, int | None]) -> None:
        """ABORTED where a document's version is no longer the one that was read."""
        if not reads:
            return
        seen = self.spark.createDataFrame(list(reads.items()), "name string, seen long")
        current = self.documents({V.document_name(n).collection_id for n in reads}).select("name", "version")
        if not seen.join(current, "name", "left").filter(~F.col("seen").eqNullSafe(F.col("version"))).isEmpty():
            raise WriteError("ABORTED", "a document that the transaction read has changed")

    # -- helpers --

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
