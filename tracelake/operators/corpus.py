"""Corpus layer: content policy, manifest, lines, chunks and snapshot identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T

CHUNK_LINES, MOST_BYTES = 80, 2 * 1024 * 1024
SUFFIXES = ("py", "pyi", "js", "jsx", "ts", "tsx", "java", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "rb", "php", "sh", "sql", "md", "rst", "txt", "toml", "yaml", "yml", "json", "ini", "cfg", "html", "css")
DIRECTORIES = (".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", "env", "node_modules", "__pycache__", "build", "dist", "site-packages", ".mypy_cache", ".pytest_cache", ".ruff_cache", "vendor")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "pipfile.lock", "cargo.lock", "composer.lock")
SECRET_NAME = r"^(\.env(\..*)?|.*\.(pem|key|p12|pfx|jks)|id_(rsa|dsa|ecdsa|ed25519)|credentials(\..*)?|secrets?(\..*)?)$"
MARKERS = r"(?i)(@generated|do not edit|automatically generated|autogenerated|code generated by)"


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def exclusion(path: Column, text: Column, n_bytes: Column) -> Column:
    """The first reason to leave a file out, null if it is in. The order matters."""
    name = base_name(path)
    folders = F.expr("false") | F.exists(F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(*DIRECTORIES) | p.endswith(".egg-info"))
    head = F.array_join(F.slice(T.source_lines(text), 1, 5), "")
    return (
        F.when(T.unsafe_path(path), "unsafe_path")
        .when(folders, "excluded_directory")
        .when(name.rlike(SECRET_NAME), "secret_name")
        .when(name.isin(*LOCKFILES), "lockfile")
        .when(name.rlike(r"\.min\.(js|css)$|_pb2(_grpc)?\.pyi?$|\.generated\."), "generated_name")
        .when(~F.element_at(F.split(name, r"\."), -1).isin(*SUFFIXES) | ~name.contains("."), "suffix")
        .when(n_bytes > MOST_BYTES, "too_large")
        .when(text.isNull(), "not_utf8")
        .when(text.contains("\x00"), "nul_byte")
        .when(text.contains("PRIVATE KEY-----"), "private_key")
        .when(head.rlike(MARKERS), "generated_marker")
    )


def documents_as_files(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: the document table as a tree of text files."""
    return docs.select("doc_id", F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")


def manifest(files: DataFrame) -> DataFrame:
    """``path, file_sha256, n_bytes, n_lines``."""
    return files.select("path", F.sha2("text", 256).alias("file_sha256"), F.octet_length("text").cast("long").alias("n_bytes"), T.line_count(F.col("text")).cast("long").alias("n_lines"))


def lines(files: DataFrame) -> DataFrame:
    """``path, line_no, line``, from 1."""
    return files.select("path", F.posexplode(T.source_lines(F.col("text"))).alias("pos", "line")).select("path", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


#: Parts of the paths by which repeated ones are told; as many numbers are broadcast at most.
BUCKETS = 1 << 20


def apart(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files whose path no other row has, and the rest, which hold some of the former too.

    Texts are not shuffled to tell them: repeated paths are known by the bucket of their hash.
    """
    keyed = files.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
    again = F.broadcast(keyed.groupBy("path", "bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket").distinct())
    return keyed.join(again, "bucket", "left_anti").drop("bucket"), keyed.join(again, "bucket", "left_semi").drop("bucket")


def once(files: DataFrame) -> DataFrame:
    """``path, text, copies``: equal rows as one."""
    single, several = apart(files.select("path", "text"))
    return single.withColumn("copies", F.lit(1).cast("long")).unionByName(several.groupBy("path", "text").agg(F.count("*").alias("copies")))


def chunks(files: DataFrame, width: int = CHUNK_LINES) -> DataFrame:
    """Windows of lines of one owner; blank ones are dropped but keep their numbers.

    A chunk's id hashes the compact JSON list of its place, owner and file. ``copies`` of a file stay with its chunks.
    """
    more = ["copies"] if "copies" in files.columns else []
    ls = T.source_lines(F.col("text"))
    n = F.size("ls")
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(width)))
    cut = files.select("path", *more, F.sha2("text", 256).alias("file_sha256"), ls.alias("ls")).select("path", *more, "file_sha256", "ls", F.explode(starts).alias("start_line"))
    end = F.least(F.col("start_line") + width - 1, n)
    rows = cut.select("path", *more, "file_sha256", F.col("start_line").cast("long").alias("start_line"), end.cast("long").alias("end_line"), F.array_join(F.slice("ls", F.col("start_line"), end - F.col("start_line") + 1), "").alias("text"))
    return with_chunk_id(rows.where(~T.is_blank(F.col("text"))).withColumns({"symbol": F.lit("<text>"), "kind": F.lit("text")}))


def with_chunk_id(rows: DataFrame) -> DataFrame:
    """ASCII paths need no escapes, so the JSON list is put together in the JVM."""
    identity = F.concat(F.lit('["'), "path", F.lit('",'), "start_line", F.lit(","), "end_line", F.lit(',["'), "symbol", F.lit('","'), "kind", F.lit('"],"'), "file_sha256", F.lit('"]'))
    return rows.withColumn("id", F.sha2(identity, 256))


def islands(owned_lines: DataFrame, width: int = CHUNK_LINES) -> DataFrame:
    """Gaps and islands: runs of lines of one owner, at most ``width`` lines each.

    ``path, line_no, owner, line`` in; ``path, owner, start_line, end_line, text`` out.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    change = (~F.col("owner").eqNullSafe(F.lag("owner").over(w)) | (F.row_number().over(w) == 1)).cast("int")
    runs = owned_lines.withColumn("run", F.sum(change).over(w))
    piece = runs.withColumn("piece", F.floor((F.row_number().over(Window.partitionBy("path", "run").orderBy("line_no")) - 1) / width))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return piece.groupBy("path", "run", "piece").agg(F.first("owner").alias("owner"), F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), text.alias("text")).select("path", "owner", "start_line", "end_line", "text")


def snapshot_id(files: DataFrame, policy: str = "v1") -> DataFrame:
    """One row: a digest over all file digests that no task has to hold at once.

    Files are hashed into 4,096 ranges of their digest; each range's sorted list
    is hashed, then the ranges' hashes.
    """
    own = files.select(F.sha2(F.concat_ws("\x00", "path", F.sha2("text", 256)), 256).alias("h"))
    ranges = own.groupBy(F.substring("h", 1, 3).alias("r")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    return ranges.agg(F.sha2(F.concat(F.lit(policy), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), ",")), 256).alias("snapshot_id"))
