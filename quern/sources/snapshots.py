"""Tables as versioned snapshots with an atomic pointer, and JSON exchange files.

A version is a list of folders of Parquet files.  ``commit`` writes a whole new
folder, ``append`` adds one to those of the current version, so that a small batch
costs what it holds and not what the table holds.  The one-line pointer file is
replaced last: a reader sees the old or the new version whole; what a failed writer
leaves is never pointed to.  Writers claim the next number by creating a file that
may not exist yet; one whose base is no longer current raises.  Paths go through the
Hadoop file system, so a shared store works as well as a local folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "_CURRENT"


class CommitConflict(RuntimeError):
    """Another writer has committed, or is about to."""


class Snapshots:
    """One table under a root folder, per namespace."""

    def __init__(self, spark: SparkSession, root: str, namespace: str, lease: float = 600.0):
        if not namespace:
            raise ValueError("the namespace is empty")
        self.spark, self.path, self.lease = spark, f"{root.rstrip('/')}/namespace={namespace}", lease
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _pointer(self) -> dict:
        at = self._path(f"{self.path}/{POINTER}")
        if not self._fs.exists(at):
            return {"version": None, "parts": [], "before": []}
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def version(self) -> int | None:
        """The current version, or None before the first commit."""
        return self._pointer()["version"]

    def parts(self) -> list[str]:
        """The folders of the current version."""
        return self._pointer()["parts"]

    def read(self, schema: StructType | str) -> DataFrame:
        """The current rows; an empty table of the schema before the first commit."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts])

    def _claim(self, n: int):
        """Creates the file that says that version ``n`` is being pointed to; one older than the lease is of a failed writer."""
        at = self._path(f"{self.path}/_claim-{n}")
        if self._fs.exists(at) and time.time() - self._fs.getFileStatus(at).getModificationTime() / 1000 > self.lease:
            self._fs.delete(at, False)
        try:
            self._fs.create(at, False).close()
        except Exception as e:
            raise CommitConflict(f"{self.path}: version {n} is being written") from e
        return at

    def _point(self, base: dict, n: int, parts: list[str]) -> int:
        claim = self._claim((base["version"] or 0) + 1)
        try:
            if self.version() != base["version"]:
                raise CommitConflict(f"{self.path}: version {base['version']} is no longer current")
            temporary = self._path(f"{self.path}/_{uuid.uuid4().hex}.tmp")
            out = self._fs.create(temporary, True)
            try:
                out.write(bytearray(json.dumps({"version": n, "parts": parts, "before": base["parts"]}).encode()))
            finally:
                out.close()
            fs = self.spark._jvm.org.apache.hadoop.fs
            kind = getattr(fs, "Options$Rename")
            how = self.spark._sc._gateway.new_array(kind, 1)
            how[0] = kind.OVERWRITE
            fs.FileContext.getFileContext(temporary.toUri(), self._conf).rename(temporary, self._path(f"{self.path}/{POINTER}"), how)
        finally:
            self._fs.delete(claim, False)
        return n

    def _write(self, df: DataFrame, base: dict, tag: str) -> tuple[int, str]:
        n = (base["version"] or 0) + 1
        while self._fs.exists(self._path(f"{self.path}/v={n}{tag}")):  # left by a writer that failed
            n += 1
        df.write.parquet(f"{self.path}/v={n}{tag}")
        return n, f"v={n}{tag}"

    def commit(self, df: DataFrame) -> int:
        """Writes a new version and points to it.  ``df`` may read the current one."""
        base = self._pointer()
        n, part = self._write(df, base, "")
        return self._point(base, n, [part])

    def append(self, df: DataFrame, tag: str) -> int:
        """Adds the rows of ``df`` to the current version as one folder.

        Rows that were appended under the same ``tag`` are replaced, so a batch that
        runs again is not doubled.
        """
        if not tag.isidentifier():
            raise ValueError("the tag must be an identifier")
        base = self._pointer()
        n, part = self._write(df, base, f"-{tag}")
        return self._point(base, n, [p for p in base["parts"] if p.split("-", 1)[1:] != [tag]] + [part])

    def compact(self, schema: StructType | str, most: int = 16) -> None:
        """Rewrites a version of more than ``most`` folders as one, and removes folders that neither it nor the version before uses."""
        if len(self.parts()) > most:
            self.commit(self.read(schema))
            self.expire()

    def expire(self) -> list[str]:
        """Removes the folders that neither the current version nor the one before uses."""
        now = self._pointer()
        kept = {*now["parts"], *now["before"]}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)) if s.isDirectory()]
        gone = [g for g in gone if g.startswith("v=") and g not in kept]
        for g in gone:
            self._fs.delete(self._path(f"{self.path}/{g}"), True)
        return gone


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines, trimmed: ``text``."""
    return spark.read.text(path).select(F.trim("value").alias("text")).filter("text <> ''")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per file: ``file_path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file_path"), F.col("value").alias("text"))


def read_or(spark: SparkSession, path: str, fallback: list[str]) -> DataFrame:
    """The documents at a path, or given texts if it cannot be read."""
    from pyspark.errors import AnalysisException

    try:
        return read_documents(spark, path)
    except AnalysisException:
        return spark.createDataFrame([(None, t) for t in fallback], "file_path string, text string")


def _whole(spark: SparkSession, path: str) -> DataFrame | None:
    """The text of one exact file, or None if it is missing or empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).getLen() == 0:
        return None
    return spark.read.text(path, wholetext=True)


def load_records(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """``{id: record}`` as rows; a missing or empty file is an empty table, a malformed one an error.

    A null or absent list becomes an empty one.
    """
    fields = StructType([f for f in schema.fields if f.name != key])
    whole = _whole(spark, path)
    if whole is None:
        return spark.createDataFrame([], StructType([schema[key], *fields.fields]))
    rows = whole.select(F.explode(F.from_json("value", f"map<string, {fields.simpleString()}>", {"mode": "FAILFAST"})).alias(key, "r")).select(key, "r.*")
    return rows.select(key, *[F.coalesce(f.name, F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else f.name for f in fields.fields])


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``namespace, dim, id, vector, metadata`` of a vector file."""
    row = "struct<embedding_dim:int, namespace:string, data:array<struct<__id__:string, vector:array<float>, metadata:map<string,string>>>>"
    whole = _whole(spark, path)
    if whole is None:
        return spark.createDataFrame([], "namespace string, dim int, id string, vector array<float>, metadata map<string,string>")
    parsed = whole.select(F.from_json("value", row, {"mode": "FAILFAST"}).alias("j"))
    return parsed.select("j.namespace", F.col("j.embedding_dim").alias("dim"), F.explode("j.data").alias("d")).select("namespace", "dim", F.col("d.__id__").alias("id"), "d.vector", "d.metadata")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph file.

    Nameless nodes and invalid edges are skipped, of repeated keys the last is
    kept, ends that no node declares are added.
    """
    from quern.operators import graph

    node, edge = "name:string, type:string, description:string, source_ids:array<string>", "src_id:string, tgt_id:string, keywords:string, description:string, weight:double, source_ids:array<string>"
    whole = _whole(spark, path)
    if whole is None:
        return (spark.createDataFrame([], "name string, type string, description string, source_ids array<string>"),
                spark.createDataFrame([], "src_id string, tgt_id string, keywords string, description string, weight double, source_ids array<string>, a string, b string"))
    j = whole.select(F.from_json("value", f"struct<version:int, nodes:array<struct<{node}>>, edges:array<struct<{edge}>>>", {"mode": "FAILFAST"}).alias("j"))
    nodes = j.select(F.posexplode("j.nodes").alias("p", "n")).filter("n.name <> ''").groupBy("n.name").agg(F.max_by("n", "p").alias("n")).select("n.*")
    edges = graph.keyed(j.select(F.posexplode("j.edges").alias("p", "e")).select("p", "e.*")).groupBy("a", "b").agg(F.max_by(F.struct("src_id", "tgt_id", "keywords", "description", "weight", "source_ids"), "p").alias("e"))
    edges = edges.select("e.*", "a", "b")
    return graph.with_endpoints(nodes, edges), edges


def _save(spark: SparkSession, path: str, texts: Iterable[str]) -> None:
    """Writes one text, piece by piece, to a file that appears whole."""
    at, temporary = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.tmp"))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    held: list[str] = []
    try:
        for text in texts:
            held.append(text)
            if len(held) == 1000:
                out.write(bytearray("".join(held).encode()))
                held = []
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()
    fs.delete(at, False)
    fs.rename(temporary, at)


def _stream(df: DataFrame, path: str, head: str, tail: str) -> None:
    """Writes one JSON text, row by row; the rows pass through the driver one partition at a time."""
    def texts():
        yield head
        for i, r in enumerate(df.toLocalIterator(prefetchPartitions=True)):
            yield (",\n" if i else "\n") + r[0]
        yield tail

    _save(df.sparkSession, path, texts())


def export_records(df: DataFrame, path: str, key: str) -> None:
    """``{id: record}`` in key order, for exchange; large tables stay in Parquet."""
    rest = F.to_json(F.struct(*[c for c in df.columns if c != key]))
    _stream(df.orderBy(key).select(F.concat(F.substring(F.to_json(F.array(F.col(key).cast("string"))), 2, 1 << 30), F.lit("")).alias("k"), rest.alias("r"))
            .select(F.concat(F.expr("substring(k, 1, length(k) - 1)"), F.lit(": "), "r")), path, "{", "\n}\n")


def export_vectors(df: DataFrame, path: str, namespace: str, dim: int) -> None:
    row = F.to_json(F.struct(F.col("id").alias("__id__"), "vector", "metadata"))
    _stream(df.orderBy("id").select(row), path, f'{{"embedding_dim": {dim}, "namespace": {json.dumps(namespace)}, "data": [', "\n]}\n")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by name, edges by their canonical ends, so equal graphs give equal files."""
    n = nodes.orderBy("name").select(F.lit(0).alias("s"), "name", F.lit("").alias("x"), F.to_json(F.struct("name", "type", "description", "source_ids")).alias("j"))
    e = edges.select(F.lit(1).alias("s"), F.col("a").alias("name"), F.col("b").alias("x"), F.to_json(F.struct("src_id", "tgt_id", "keywords", "description", "weight", "source_ids")).alias("j"))

    def texts():
        yield '{"version": 1, "nodes": ['
        last, first = 0, True
        for r in n.unionByName(e).orderBy("s", "name", "x").select("s", "j").toLocalIterator():
            if r["s"] != last:
                yield '\n], "edges": ['
                last, first = 1, True
            yield ("\n" if first else ",\n") + r["j"]
            first = False
        yield '\n], "edges": [\n]}\n' if last == 0 else "\n]}\n"

    _save(nodes.sparkSession, path, texts())


def manifest(df: DataFrame, text: str, vector: str, components: int = 6) -> DataFrame:
    """One JSON text a row: the text, the first components and the dimension."""
    return df.select(F.to_json(F.struct(F.col(text).alias("text"), F.slice(vector, 1, components).alias("head"), F.size(vector).alias("dim"))).alias("value"))
