"""Files of the storage that the session's Hadoop configuration reaches: small
listings, states and small texts. A remote session (no local JVM) falls back to local
paths."""

from __future__ import annotations

import datetime as dt
import hashlib
import os
import re
import shutil
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    """(FileSystem, Path) of a URI through the session's Hadoop configuration,
    or None when the session has no local JVM (then local paths are used)."""
    try:
        context = spark.sparkContext
    except AttributeError:  # a remote session has none
        return None
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def entries(spark: SparkSession, folder: str, match: str = "") -> list[tuple]:
    """Direct children of a folder whose names match: (path, name, length, mtime,
    is_dir), one listing call. The length of a directory is None."""
    h = _hadoop(spark, folder)
    if h is None:
        return [e for e in _local_entries(_local(folder)) if re.search(match, e[1])]
    fs, root = h
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        return []
    out = []
    for st in fs.listStatus(root):
        p = st.getPath()
        if not re.search(match, p.getName()):
            continue
        is_dir = st.isDirectory()
        mtime = dt.datetime.fromtimestamp(st.getModificationTime() / 1000.0, dt.timezone.utc)
        out.append((p.toString(), p.getName(), None if is_dir else int(st.getLen()),
                    mtime.replace(tzinfo=None), is_dir))
    return out


def _local_entries(folder: str) -> list[tuple]:
    if not os.path.isdir(folder):
        return []
    out = []
    for name in sorted(os.listdir(folder)):
        full = os.path.join(folder, name)
        is_dir = os.path.isdir(full)
        mtime = dt.datetime.fromtimestamp(os.path.getmtime(full), dt.timezone.utc)
        out.append((full, name, None if is_dir else os.path.getsize(full), mtime.replace(tzinfo=None), is_dir))
    return out


def files(spark: SparkSession, path: str):
    """(path, bytes, modification time) of a file, or of all files below a folder, one
    after the other."""
    h = _hadoop(spark, path)
    if h is not None:
        if not h[0].exists(h[1]):
            return
        found = h[0].listFiles(h[1], True)
        while found.hasNext():
            st = found.next()
            yield st.getPath().toString(), int(st.getLen()), int(st.getModificationTime())
        return
    top = _local(path)
    for f in [top] if os.path.isfile(top) else [os.path.join(r, f) for r, _, fs in os.walk(top) for f in fs]:
        yield f, os.path.getsize(f), os.stat(f).st_mtime_ns


def file_identity(spark: SparkSession, paths: list[str]) -> tuple:
    """(path, number of files, bytes, digest of the files' names, lengths and
    modification times) of each path, a file or a directory of part files. A
    rewritten part file changes it."""
    out = []
    for path in paths:
        found = sorted(files(spark, path))
        digest = hashlib.sha1(repr(found).encode()).hexdigest()
        out.append((path, len(found), sum(f[1] for f in found), digest))
    return tuple(out)


def path_exists(spark: SparkSession, path: str) -> bool:
    h = _hadoop(spark, path)
    return bool(h[0].exists(h[1])) if h is not None else os.path.exists(_local(path))


def path_size(spark: SparkSession, path: str) -> int:
    h = _hadoop(spark, path)
    if h is not None:
        return int(h[0].getContentSummary(h[1]).getLength())
    return sum(f[1] for f in files(spark, path))


def is_larger(spark: SparkSession, path: str, least: int) -> bool:
    """Whether a file or a folder's files hold more than `least` bytes; stops
    listing as soon as that is known."""
    size = 0
    for _, length, _ in files(spark, path):
        size += length
        if size > least:
            return True
    return False


def read_text(spark: SparkSession, path: str) -> str:
    h = _hadoop(spark, path)
    if h is None:
        with open(_local(path), encoding="utf-8") as f:
            return f.read()
    stream = h[0].open(h[1])
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def first_line(spark: SparkSession, path: str) -> str:
    h = _hadoop(spark, path)
    if h is None:
        with open(_local(path), encoding="utf-8") as f:
            return f.readline().rstrip("\r\n")
    jvm = spark.sparkContext._jvm
    stream = h[0].open(h[1])
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet."""
    h = _hadoop(spark, path)
    if h is None:
        os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
        with open(_local(path), "x", encoding="utf-8") as f:
            f.write(text)
        return
    stream = h[0].create(h[1], False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder with its content."""
    h = _hadoop(spark, path)
    if h is not None:
        h[0].delete(h[1], True)
    elif os.path.isdir(_local(path)):
        shutil.rmtree(_local(path))
    elif os.path.exists(_local(path)):
        os.remove(_local(path))


def partition_values(spark: SparkSession, path: str, column: str = "activity_date") -> list[str]:
    """Values of a top-level ``column=value`` partition layout, from the
    directory listing alone (no data read). The null partition is skipped."""
    prefix = f"{column}="
    names = [e[1] for e in entries(spark, path) if e[4] and e[1].startswith(prefix)]
    vals = [unquote(n[len(prefix):]) for n in names]
    return sorted(v for v in vals if v != "__HIVE_DEFAULT_PARTITION__")
