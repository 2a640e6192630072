"""File-tree sources.

Submission trees are read with the ``binaryFile`` source: the extension filter
is a path glob/regex, the size filter is pushed into the file listing
(``length``), and ``content`` is only read when it is selected.  Paths are
turned into columns with ``split``; per-key choices are aggregates.

Where a choice or a join on paths comes first (S1, S6), only paths are shuffled:
the tasks that hold the chosen paths read those files (``read_contents``), so no
exchange carries bytes and no other file is opened.
"""

from __future__ import annotations

import codecs

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions.text import file_extension


def extension_glob(extensions) -> str:
    """Path glob of the listed extensions (case-sensitive)."""
    return "*.{" + ",".join(sorted(extensions)) + "}"


def _tree(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """Files below ``root``; with ``extensions``, others are not even listed as input."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions:
        r = r.option("pathGlobFilter", extension_glob(extensions))
    return r.load(root)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root`` (the binaryFile ``path`` is a file URI)."""
    root = root.rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, r"^file:", ""), "^.*?" + _re_escape(root) + "/", "")


def _re_escape(s: str) -> str:
    return "".join("\\" + c if c in r".^$*+?()[]{}|\\" else c for c in s)


@F.pandas_udf(T.StringType())
def _decode_fallback(content: pd.Series) -> pd.Series:
    """Bytes that are not valid UTF-8: UTF-16 with a byte order mark, else
    Windows-1252; null where neither fits."""
    def one(b):
        if b is None:
            return None
        b = bytes(b)
        for mark, name in ((codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
            if b.startswith(mark):
                try:
                    return b[2:].decode(name)
                except UnicodeDecodeError:
                    return None
        try:
            return b.decode("cp1252")
        except UnicodeDecodeError:
            return None
    return content.map(one)


def decode_bytes(content: Column) -> Column:
    """Text of a file.  Valid UTF-8 (BOM stripped) is decoded on the JVM;
    only the other files go through the pandas fallback.  Null: undecodable (F8)."""
    as_str = content.cast("string")
    utf8 = F.regexp_replace(as_str, "^\ufeff", "")
    return F.when(F.is_valid_utf8(as_str), utf8).otherwise(_decode_fallback(content))


def _open(path: str, known: dict):
    """Readable stream of a path as the file listing spells it (not URL-encoded)."""
    from pyarrow import fs
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        scheme, rest = "file", path
    host, at = "", rest
    if rest.startswith("//"):
        host, _, at = rest[2:].partition("/")
        at = "/" + at
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream(at)
    if (scheme, host) not in known:
        known[scheme, host] = fs.FileSystem.from_uri(f"{scheme}://{host}/")[0]
    inside = at if scheme in ("hdfs", "viewfs") else host + at  # object stores: bucket/key
    return known[scheme, host].open_input_stream(inside)


_READ_BYTES = 32 << 20  # bytes of files in one batch of rows


def read_contents(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """``files`` with the bytes of the file at ``path_col`` (null path: null).
    Each task opens the paths of its own rows, through Arrow's file systems, and
    hands rows on in batches of bounded size.  An unreadable file is an error."""
    def run(batches):
        known: dict = {}
        for b in batches:
            paths = b.column(b.schema.get_field_index(path_col)).to_pylist()
            first, held, size = 0, [], 0
            for i, p in enumerate(paths):
                if p is None:
                    held.append(None)
                else:
                    with _open(p, known) as f:
                        held.append(f.read())
                    size += len(held[-1])
                if size >= _READ_BYTES or i + 1 == len(paths):
                    part = b.slice(first, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())],
                                                     [*b.schema.names, content_col])
                    first, held, size = i + 1, [], 0
    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField(content_col, T.BinaryType())]))


def ingest_contest_tree(spark: SparkSession, root: str, extensions, min_size: int = 100,
                        keep_repeats: bool = False, direct: bool = True) -> DataFrame:
    """S1 + F1 + F2 + F9 + X3 + F8 + J3: ``contest/user/problem/solution/.../file``
    files with a listed extension (case-sensitive) and more than ``min_size``
    bytes; the lexicographically last solution of a (contest, user, problem,
    file name) wins unless ``keep_repeats``.

    Output (contest, username, problem, solution, filepath, file_content,
    replaced) — ``replaced`` flags U+FFFD in the decoded text.  ``direct=False``
    is for storage that only Spark's readers can open: bytes then go through
    Spark's scan and a semi-join with the chosen paths.
    """
    files = _tree(spark, root, extensions).where(F.col("length") > min_size)
    rel = relative_path(F.col("path"), root)
    parts = F.split(rel, "/")
    # the winners are chosen on paths: no byte is read and no content shuffled for that
    names = files.select("path", parts.alias("_parts"))
    names = names.where(file_extension(F.element_at("_parts", -1)).isin(list(extensions)))
    key = [F.col("_parts")[i] for i in range(4 if keep_repeats else 3)] + [F.element_at("_parts", -1)]
    # later in a sorted depth-first walk == larger path-component array
    best = names.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(
        F.max_by("path", F.col("_parts")).alias("path")).select("path")
    chosen = read_contents(best) if direct else files.join(best, "path", "left_semi")
    out = chosen.select(
        parts[0].alias("contest"), parts[1].alias("username"), parts[2].alias("problem"), parts[3].alias("solution"),
        rel.alias("filepath"), decode_bytes(F.col("content")).alias("file_content"))
    out = out.where(F.col("file_content").isNotNull())
    return out.withColumn("replaced", F.col("file_content").contains("\ufffd"))


def build_file_index(spark: SparkSession, root: str) -> DataFrame:
    """(username, filepath) for every file below ``root``; ``content`` is
    never read (only ``path`` is selected)."""
    rel = relative_path(F.col("path"), root)
    return _tree(spark, root).select(F.split(rel, "/")[1].alias("username"), rel.alias("filepath"))


def attach_contents(spark: SparkSession, subs: DataFrame, root: str, path_col: str = "filepath",
                    strict: bool = False, direct: bool = True) -> DataFrame:
    """Left-join file bytes by relative path; ``strict`` keeps only valid UTF-8.
    Paths are joined first, then the rows' tasks read the files that were found;
    ``direct=False`` joins Spark's scan of the tree instead."""
    tree = _tree(spark, root).select(relative_path(F.col("path"), root).alias(path_col),
                                     "path" if direct else "content")
    if direct:
        found = subs.join(tree.withColumnRenamed("path", "_uri"), path_col, "left")
        joined = read_contents(found, "_uri", "content").drop("_uri")
    else:
        joined = subs.join(tree, path_col, "left")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    if not strict:
        text = decode_bytes(F.col("content"))
    return joined.withColumn("file_content", text).drop("content")


def read_text_by_path(pairs: DataFrame, contents: DataFrame, path_col: str = "filepath",
                      text_col: str = "file_content") -> DataFrame:
    """Both texts of every pair; pairs with an unreadable file are dropped
    (inner joins)."""
    c1 = contents.select(F.col(path_col).alias("file_1"), F.col(text_col).alias("text_1"))
    c2 = contents.select(F.col(path_col).alias("file_2"), F.col(text_col).alias("text_2"))
    return pairs.join(c1, "file_1").join(c2, "file_2")
