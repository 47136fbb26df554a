"""Writing a graph: Parquet datasets, bulk-import CSV, JSON models.

Every writer keeps the partitions its input has: nothing is gathered by label or type, so a
label that holds most of the rows is still written by many tasks. Overwriting replaces what a
rerun would write again, which makes loads idempotent.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.edges import EDGE_COLUMNS
from .scratch import scratch_folder as scratch_folder
from .scratch import shared_folder as shared_folder


def write_nodes(
    nodes: Mapping[str, DataFrame],
    path: str,
    *,
    clear: bool = False,
    sort_by: Mapping[str, Sequence[str]] | None = None,
    parallel: int = 4,
) -> None:
    """One Parquet dataset per label, laid out as a partition directory ``label=<Label>``.

    Appends by default; ``clear`` replaces the label. Labels do not depend on each other, so
    ``parallel`` of them are written at a time. ``sort_by`` maps a label to the properties
    that lookups use: rows are range-partitioned and sorted on them, so a lookup skips files and
    row groups by their min/max. The node key breaks ties, so a value that fills a third of the
    rows still spreads over many files.
    """
    if not nodes:
        return

    @inheritable_thread_target(next(iter(nodes.values())).sparkSession)
    def write(label: str) -> None:
        df, by = nodes[label], (sort_by or {}).get(label)
        if by:
            df = df.repartitionByRange(*by, "node_key").sortWithinPartitions(*by, "node_key")
        df.write.mode("overwrite" if clear else "append").parquet(f"{path}/label={label}")

    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(write, nodes))


def write_bucketed(df: DataFrame, table: str, key: str, *, buckets: int = 64, path: str | None = None) -> DataFrame:
    """``df`` as a catalog table in ``buckets`` buckets by ``key``, sorted by it within each; returns the table.

    Tables in as many buckets by the same key are joined without an exchange on either side. A lookup of
    one key reads one bucket, and in it only row groups whose Bloom filter may hold the key. Rows are
    dealt out by the key first, so every bucket is one file.
    """
    writer = df.repartition(buckets, F.col(f"`{key}`")).write.bucketBy(buckets, key).sortBy(key).mode("overwrite")
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
    (writer.option("path", path) if path else writer).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def write_edges(edges: DataFrame, path: str, *, clear: bool = False) -> None:
    """Edges partitioned by type; ``clear`` replaces only the types that are written."""
    writer = edges.write.partitionBy("rel_type")
    if clear:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode("append")
    writer.parquet(path)


def clear_graph(spark: SparkSession, path: str) -> None:
    """Removes a written graph (``<path>/nodes``, ``<path>/edges``), labels and types of earlier loads included."""
    jvm = spark.sparkContext._jvm
    for part in ("nodes", "edges"):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# -- versions of a stored graph -----------------------------------------------------------------


def _filesystem(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were completed, ascending."""
    hadoop, fs = _filesystem(spark, path)
    folder = hadoop.Path(f"{path}/manifests")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the stored graph (``nodes``, ``edges`` below it); None if no load has been completed."""
    done = versions(spark, path)
    return f"{path}/version={done[-1]}" if done else None


def new_version(spark: SparkSession, path: str) -> tuple[int, str]:
    """Number and folder for the next load. What a load that failed left there is removed."""
    number = (versions(spark, path) or [0])[-1] + 1
    hadoop, fs = _filesystem(spark, path)
    fs.delete(hadoop.Path(f"{path}/version={number}"), True)
    return number, f"{path}/version={number}"


def commit_version(spark: SparkSession, path: str, number: int, facts: Mapping | None = None, *, keep: int = 2) -> None:
    """Makes a version the current one by renaming its manifest into place, then removes all but the last ``keep``.

    A reader sees the old graph or the new one, never a part. Of two loads at once the later one to
    get here fails, because the manifest's name is taken. ``keep`` leaves readers of the version
    before time to end.
    """
    hadoop, fs = _filesystem(spark, path)
    folder = hadoop.Path(f"{path}/manifests")
    fs.mkdirs(folder)
    written, final = hadoop.Path(folder, f"_{number}.tmp"), hadoop.Path(folder, f"{number}.json")
    out = fs.create(written, True)
    out.write(bytearray(json.dumps({"version": number, **(facts or {})}).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(written, final):
        raise RuntimeError(f"version {number} of {path} was written by another load")
    for old in versions(spark, path)[:-keep]:
        fs.delete(hadoop.Path(f"{path}/version={old}"), True)
        fs.delete(hadoop.Path(folder, f"{old}.json"), False)


#: What makes an edge the same edge in a later load.
EDGE_KEY = ("rel_type", "fk_name", "from_label", "from_key", "to_label", "to_key")


def upsert_nodes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The new nodes, and the old ones whose key none of them has."""
    if old is None:
        return new
    return new.unionByName(old.join(new.select("node_key"), "node_key", "left_anti"), allowMissingColumns=True)


def upsert_edges(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The new edges, and the old ones that no new one repeats."""
    if old is None:
        return new
    a, b = old.alias("a"), new.select(*EDGE_KEY).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in EDGE_KEY]
    return new.unionByName(a.join(b, same, "left_anti").select(*new.columns))


def store_graph(spark: SparkSession, graph: Graph, path: str, *, clear: bool = True, sort_by: Mapping[str, Sequence[str]] | None = None) -> str:
    """Writes a graph as the next version below ``path`` and switches to it; returns the version's folder.

    ``clear`` replaces the graph that is there. Without it nodes replace those of the same label and
    key, and edges those of the same type, foreign key and ends, so the same load twice gives the same
    graph; everything else of the old graph is carried over. A load that fails leaves the old graph
    as it was.
    """
    before = None if clear else current_version(spark, path)
    number, folder = new_version(spark, path)
    nodes, edges, labels = dict(graph.nodes), graph.edges, []
    if before is not None:
        hadoop, fs = _filesystem(spark, path)
        at = hadoop.Path(f"{before}/nodes")
        labels = [f.getPath().getName().removeprefix("label=") for f in fs.listStatus(at)] if fs.exists(at) else []
        stored = {label: read_nodes(spark, f"{before}/nodes", label) for label in labels if not label.startswith(("_", "."))}
        nodes = {**stored, **{label: upsert_nodes(stored.get(label), df) for label, df in nodes.items()}}
        if fs.exists(hadoop.Path(f"{before}/edges")):
            edges = upsert_edges(spark.read.schema(edges.schema).parquet(f"{before}/edges"), edges)
    write_nodes(nodes, f"{folder}/nodes", clear=True, sort_by=sort_by)
    write_edges(edges, f"{folder}/edges", clear=True)
    commit_version(spark, path, number, {"labels": sorted(nodes)})
    return folder


def read_nodes(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{path}/label={label}")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _csv_cells(df: DataFrame, columns: list[str]) -> list:
    """CSV holds flat text only: nested and variant values become JSON."""
    nested = ("array", "map", "struct", "variant")
    return [
        (F.to_json(c) if df.schema[c].dataType.simpleString().startswith(nested) else F.col(c)).alias(c)
        for c in columns
    ]


def bulk_nodes(df: DataFrame, label: str) -> DataFrame:
    """Node rows in bulk-import shape: ``:ID``, properties, ``:LABEL``."""
    properties = [c for c in df.columns if c not in ("node_key", "label")]
    return df.select(
        F.col("node_key").alias(f":ID({label})"), *_csv_cells(df, properties), F.lit(label).alias(":LABEL")
    )


def bulk_edges(df: DataFrame) -> DataFrame:
    """Edge rows in bulk-import shape: ``:START_ID``, ``:END_ID``, ``:TYPE`` and the properties."""
    return df.select(
        F.col("from_key").alias(":START_ID"),
        F.col("to_key").alias(":END_ID"),
        F.col("rel_type").alias(":TYPE"),
        "cardinality",
        "props",
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(catalog: dict[str, DataFrame], path: str) -> None:
    """Model tables (catalog, conceptual model, graph model) as JSON lines, one folder each."""
    for name, df in catalog.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, model: Graph) -> Graph:
    """A written graph under the model it was built from: the current version, or else ``<path>/nodes`` and ``<path>/edges``.

    Types are partition folders, so a pattern reads only the types it names. Edges that no foreign key of
    the model gave, such as the user's, are the set ``user``.
    """
    path = current_version(spark, path) or path
    edges = spark.read.schema(model.edges.schema).parquet(f"{path}/edges")
    tables = {e.fk.table for e in model.edge_types}
    sets = {
        t: edges.where(F.col("rel_type").isin([e.rel_type for e in model.edge_types if e.fk.table == t]))
        .where(F.col("fk_name").isin([e.fk.name for e in model.edge_types if e.fk.table == t]))
        .select(*EDGE_COLUMNS)
        for t in tables
    }
    own = F.col("fk_name").isNull() | ~F.col("fk_name").isin([e.fk.name for e in model.edge_types])
    if set(model.edge_sets) - tables:
        sets["user"] = edges.where(own).select(*EDGE_COLUMNS)
    nodes = {label: read_nodes(spark, f"{path}/nodes", label) for label in model.nodes}
    return replace(model, nodes=nodes, edge_sets=sets, carriers={})
