"""Readers and writers: source trees, git revisions, JSON artifacts, stores and caches."""

from __future__ import annotations

import json
import os
import stat
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tracelake.functions.canonical import blob_oid, canonical
from tracelake.operators import corpus

MOST_ARTIFACT = 16 * 1024 * 1024


def checked_root(root: str) -> str:
    """A directory that is no symbolic link."""
    if os.path.islink(root) or not os.path.isdir(root):
        raise ValueError(f"{root} is not a plain directory")
    return os.path.abspath(root)


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: ``path, length, content``.

    Spark's own file listing leaves out names that begin with an underscore,
    ``__init__.py`` among them. Links are not followed; a file that changes while
    it is read has no row; content beyond ``MOST_BYTES`` is null and not read.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return "path string, length long, content binary"

    def reader(self, schema):
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.parts = checked_root(options["path"]), int(options.get("partitions", "8"))

    def partitions(self):
        found = []
        for folder, names, files in os.walk(self.root, followlinks=False):
            # Their files are reported once, but version control and caches are not entered.
            names[:] = sorted(n for n in names if n not in (".git", ".hg", "__pycache__") and not os.path.islink(os.path.join(folder, n)))
            found += [os.path.relpath(os.path.join(folder, f), self.root) for f in sorted(files)]
        size = max(1, -(-len(found) // self.parts))
        return [InputPartition(found[i : i + size]) for i in range(0, len(found), size)]

    def read(self, partition):
        for path in partition.value:
            try:
                fd = os.open(os.path.join(self.root, path), os.O_RDONLY | os.O_NOFOLLOW)
            except OSError:
                continue
            with os.fdopen(fd, "rb") as f:
                before = os.fstat(fd)
                if not stat.S_ISREG(before.st_mode):
                    continue
                raw = f.read() if before.st_size <= corpus.MOST_BYTES else None
                after = os.fstat(fd)
            if (before.st_size, before.st_mtime_ns, before.st_ctime_ns) == (after.st_size, after.st_mtime_ns, after.st_ctime_ns):
                yield path.replace(os.sep, "/"), before.st_size, raw


def _decoded(raw: DataFrame, length) -> DataFrame:
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = raw.select("path", text.alias("text"), F.sha2("content", 256).alias("file_sha256"), length.cast("long").alias("n_bytes"))
    return rows.withColumn("reason", corpus.exclusion(F.col("path"), F.col("text"), F.col("n_bytes")))


def _tree(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(SourceTree)
    return _decoded(spark.read.format("source_tree").load(checked_root(root)), F.col("length"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, text, file_sha256, n_bytes`` of the files that the content policy lets in."""
    return _tree(spark, root).where(F.col("reason").isNull()).drop("reason")


def exclusions(spark: SparkSession, root: str) -> DataFrame:
    """``path, reason`` of the files left out."""
    return _tree(spark, root).where(F.col("reason").isNotNull()).select("path", "reason")


class GitTree(DataSource):
    """``spark.read.format("git_tree").option("ref", …).load(repository)``.

    Regular blobs of one revision: ``path, oid, content``. Nothing is fetched;
    every blob's name is checked against its content. A partition reads a slice
    of the tree with one ``cat-file`` process.
    """

    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        return "path string, oid string, content binary"

    def reader(self, schema):
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.ref, self.parts = options["path"], options.get("ref", "HEAD"), int(options.get("partitions", "8"))

    def _git(self, *args, data=None):
        env = {"PATH": os.environ.get("PATH", ""), "GIT_NO_LAZY_FETCH": "1", "GIT_TERMINAL_PROMPT": "0", "HOME": "/nonexistent"}
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", self.root, *args], input=data, capture_output=True, check=True, env=env).stdout

    def partitions(self):
        commit = self._git("rev-parse", "--verify", "--end-of-options", f"{self.ref}^{{commit}}").decode().strip()
        entries = []
        for line in self._git("ls-tree", "-r", "-z", commit).split(b"\0")[:-1]:
            head, path = line.split(b"\t", 1)
            mode, kind, oid = head.decode().split()
            if kind == "blob" and mode in ("100644", "100755"):
                entries.append((path.decode("utf-8", "replace"), oid))
        size = max(1, -(-len(entries) // self.parts))
        return [InputPartition(entries[i : i + size]) for i in range(0, len(entries), size)]

    def read(self, partition):
        out = self._git("cat-file", "--batch", data="".join(f"{oid}\n" for _, oid in partition.value).encode())
        at = 0
        for path, oid in partition.value:
            end = out.index(b"\n", at)
            name, kind, size = out[at:end].decode().split()
            raw = out[end + 1 : end + 1 + int(size)]
            at = end + 2 + int(size)
            if name != oid or kind != "blob" or blob_oid(raw, len(oid)) != oid:
                raise ValueError(f"blob {oid} does not have its name")
            yield path, oid, raw


def read_git(spark: SparkSession, repository: str, ref: str = "HEAD") -> DataFrame:
    """A revision's files under the content policy."""
    spark.dataSource.register(GitTree)
    raw = spark.read.format("git_tree").option("ref", ref).load(repository)
    return _decoded(raw, F.octet_length("content")).where(F.col("reason").isNull()).drop("reason")


def read_revision(spark: SparkSession, root: str, ref: str | None = None) -> DataFrame:
    return read_tree(spark, root) if ref in (None, "WORKTREE") else read_git(spark, root, ref)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_artifact(path: str) -> dict:
    """One JSON object of 16 MiB at most."""
    if os.path.getsize(path) > MOST_ARTIFACT:
        raise ValueError("artifact is too large")
    with open(path, encoding="utf-8") as f:
        value = json.load(f)
    if not isinstance(value, dict):
        raise ValueError("artifact is no object")
    return value


def write_artifact(value, path: str) -> None:
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True)
        f.write("\n")


def freeze(df: DataFrame, path: str) -> None:
    """A table that is written once: an equal second write passes, another one is an error."""
    from tracelake.operators.diff import identical

    spark = df.sparkSession
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as e:  # the analysis error's class differs between versions
        if "EXISTS" not in str(e).upper():
            raise
        if not identical(df, spark.read.parquet(path)):
            raise ValueError(f"{path} is frozen with other rows") from e


def freeze_json(value, path: str) -> None:
    text = canonical(value) + "\n"
    try:
        with open(path, "x", encoding="utf-8") as f:
            f.write(text)
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            if f.read() != text:
                raise ValueError(f"{path} is frozen with another value") from None


class FactCache:
    """Facts by ``(path, file_sha256)`` in a Parquet folder under a policy name.

    Only misses are parsed; a cached row counts only if its chunks are spans of
    the file just hashed. Rows of removed paths are left behind by :meth:`prune`.
    """

    def __init__(self, spark: SparkSession, folder: str, policy: str = "v1"):
        self.spark, self.path = spark, f"{folder}/policy={policy}"

    def _held(self):
        try:
            return self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def facts(self, files: DataFrame) -> DataFrame:
        from tracelake.operators.facts import extract

        keyed = files.select("path", "text", F.sha2("text", 256).alias("sha"))
        held = self._held()
        missing = keyed
        if held is not None:
            spans = F.forall("chunks", lambda c: F.contains(F.col("text"), c["text"]))
            valid = held.join(keyed, ["path", "sha"]).where(spans).select("path", "sha")
            missing = keyed.join(valid, ["path", "sha"], "left_anti")
        extract(missing.select("path", "text")).join(missing.select("path", "sha"), "path").write.mode("append").parquet(self.path)
        return self.spark.read.parquet(self.path).join(keyed.select("path", "sha"), ["path", "sha"], "left_semi").dropDuplicates(["path", "sha"])

    def prune(self, files: DataFrame, folder: str) -> None:
        """Writes the rows of present files to another folder."""
        self._held().join(files.select("path").distinct(), "path", "left_semi").write.parquet(folder)


def missing_blobs(wanted: DataFrame, store: DataFrame) -> DataFrame:
    return wanted.join(store.select("oid").distinct(), "oid", "left_anti")
