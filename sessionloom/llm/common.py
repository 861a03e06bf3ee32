"""Helpers that the corpus operators share: session folders, normalisation, connected groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract in this subpackage: space and U+0009 to U+000D.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Folders that stored() has written since the innermost settled() began.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and runs on one machine (tests) a temporary folder is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if spark.sparkContext.getCheckpointDir() is None:  # the setting itself cannot be changed in a running session
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(**options).parquet(path)
    if (folders := _written.get()) is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make()`` gives, stored; whatever was stored on the way to it is deleted then, so ``make`` may hand out nothing else."""
    outer, folders = _written.get(), []
    token = _written.set(folders)
    try:
        out = stored(make())
    finally:
        _written.reset(token)
    *passed, own = folders
    for folder in passed:
        _delete(out.sparkSession, folder)
    if outer is not None:
        outer.append(own)
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` frame that nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as keep it apart from ``columns`` (case is ignored, as in Spark)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, result: tuple[str, ...]) -> tuple[list[Column], list[Column]]:
    """The columns of ``docs`` but those of ``result`` under names by number, and the columns that give them their names back."""
    taken = {r.lower() for r in result}
    carried = [c for c in docs.columns if c.lower() not in taken]
    return [docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(carried)], [F.col(f"_{i}").alias(c) for i, c in enumerate(carried)]


def ascii_lower(col: Column) -> Column:
    """``col`` with A-Z lower-cased; translate() looks every character up, so it is kept for strings with others than ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def crc32_sql(text: str) -> str:
    """DuckDB expression: the unsigned CRC-32 of the UTF-8 bytes of ``text``, bit by bit, as DuckDB has no function for it."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    byte = "list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, octet))"
    return f"xor(list_reduce({octets}, lambda crc, octet: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; the component is its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in
    MapReduce and Beyond"): all state is rows on disk, the driver sees one count a round.
    """
    spark = edges.sparkSession
    e = stored(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u")
        if large:
            return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    while last[0]:
        last_e, e = e, stored(star(star(e, True), False))
        discard(last_e)
        now = mark(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: they import the helpers of its tasks."""
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_sessionloom_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), "sessionloom_llm.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("sessionloom/__init__.py", "")
        here = os.path.join(root, "sessionloom", "llm")
        for name in sorted(os.listdir(here)):
            if name.endswith(".py"):
                z.write(os.path.join(here, name), f"sessionloom/llm/{name}")
    sc.addPyFile(path)
    sc._sessionloom_sent = True
