"""Source trees and git history (SRC-10, SRC-12)."""

from __future__ import annotations

import os
import subprocess
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "java", "go", "rs", "scala", "sql", "md")
IGNORED = ("node_modules", "dist", "build", ".git", "coverage", "__pycache__")


def source_tree(spark: SparkSession, root: str, module: str | None = None) -> DataFrame:
    """path and size of source files; only metadata is read, file contents are pruned."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    ok = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*EXTENSIONS) & ~F.col("path").rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")
    return files.where(ok & F.contains("path", F.lit(module))) if module else files.where(ok)


GIT_LOG = ["log", "--all", "--name-only", "--format=%x1e%H%x1f%an%x1f%ct%x1f%S%x1f%s"]


def git_commits(spark: SparkSession, repo: str, days: int | None = None, path: str | None = None) -> DataFrame:
    """hash, author, timestamp, branch (the ref it was reached by), message, files_changed of a repository's commits.

    git runs where the repository is, on the driver, and writes its log to a file, which goes to the shared folder; Spark reads and
    parses it by record, so the driver holds no commit. For a log that was written elsewhere use :func:`parse_git_log`.
    """
    args = ["git", "-C", repo, *GIT_LOG]
    args += [f"--since={days} days ago"] if days else []
    args += ["--", path] if path else []
    log = os.path.join(tempfile.mkdtemp(prefix="git-"), f"{uuid.uuid4().hex}.log")
    with open(log, "wb") as out:
        subprocess.run(args, stdout=out, check=True, timeout=600)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return parse_git_log(spark, f"file://{log}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    to = path(f"{base.rstrip('/')}/{os.path.basename(log)}")
    to.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, path(f"file://{log}"), to)
    return parse_git_log(spark, to.toString())


def parse_git_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a file that ``git log`` wrote with GIT_LOG: records end at U+001E, so a large log is split between tasks."""
    blocks = spark.read.option("lineSep", "\x1e").text(path).where("trim(value) <> ''")
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), "\x1f", 5)
    part = lambda i: F.get(head, F.lit(i))
    files = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda f: f != "")
    return blocks.select(part(0).alias("hash"), part(1).alias("author"), (part(2).cast("long") * 1000).alias("timestamp"), F.regexp_replace(part(3), "^refs/(?:heads|remotes)/", "").alias("branch"), part(4).alias("message"), files.alias("files_changed"))
