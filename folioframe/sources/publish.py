"""Publishing a table whole or not at all, mirroring another one, and deleting below a guarded prefix.

A version is written beside the ones before it, checked as it was written, and only then named by the file `current`, which one rename replaces. Readers
follow that name, so they see the old state or the new one, never a part; a publish that fails leaves the name, and with it the old state, as it was. All
paths go through Spark's own file systems.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _context(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.Path(f"file:{root}").toUri(), spark.sparkContext._jsc.hadoopConfiguration()), jvm


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the published version, None before the first."""
    files, jvm = _context(spark, root)
    name = jvm.org.apache.hadoop.fs.Path(f"{root}/current")
    if not files.util().exists(name):
        return None
    return f"{root}/versions/{spark.read.text(f'{root}/current').first()[0]}"


def published(spark: SparkSession, root: str) -> DataFrame:
    """The table as last published."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    return spark.read.parquet(version)


def publish(rows: DataFrame, root: str, partition: Sequence[str] = (), *, check: Callable[[DataFrame], None] | None = None) -> str:
    """Writes `rows` as the next version, checks what was written, and names it; returns its folder.

    The check may raise; so may the write. Either way the version is removed and the published one stays. Rows that the version before had and this one lacks are gone
    with the switch, as a mirror wants it; older versions are left for readers that still use them (`remove_old`)."""
    spark = rows.sparkSession
    files, jvm = _context(spark, root)
    fs = jvm.org.apache.hadoop.fs
    version = uuid.uuid4().hex
    folder = f"{root}/versions/{version}"
    try:
        rows.write.partitionBy(*partition).parquet(folder) if partition else rows.write.parquet(folder)
        if check is not None:
            check(spark.read.parquet(folder))
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(f"{root}/named/{version}")
    except BaseException:
        files.delete(fs.Path(folder), True)
        raise
    part = next(s.getPath() for s in files.util().listStatus(fs.Path(f"{root}/named/{version}")) if s.getPath().getName().startswith("part-"))
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    files.rename(part, fs.Path(f"{root}/current"), how)
    files.delete(fs.Path(f"{root}/named/{version}"), True)
    return folder


def remove_old(spark: SparkSession, root: str) -> int:
    """Removes all versions but the published one; how many there were."""
    files, jvm = _context(spark, root)
    fs, keep = jvm.org.apache.hadoop.fs, current_version(spark, root)
    try:
        found = [s.getPath() for s in files.util().listStatus(fs.Path(f"{root}/versions"))]
    except Py4JJavaError:  # no version was ever written
        return 0
    old = [p for p in found if keep is None or p.getName() != keep.rsplit("/", 1)[1]]
    for p in old:
        files.delete(p, True)
    return len(old)


def guarded_prefix(prefix: str, allowed: str) -> str:
    """The prefix as it is used, ending in a slash; raises unless it lies below `allowed` and names more than that itself."""
    parts = [p for p in prefix.replace("\\", "/").split("/") if p not in ("", ".")]
    base = [p for p in allowed.split("/") if p]
    if ".." in parts or parts[: len(base)] != base or len(parts) <= len(base):
        raise ValueError(f"unsafe prefix: {prefix!r}")
    return "/".join(parts) + "/"


def below(key: str | Column, prefix: str) -> Column:
    return F.startswith(F.col(key) if isinstance(key, str) else key, F.lit(prefix))


def delete_prefix(spark: SparkSession, root: str, key: str, prefix: str, allowed: str, partition: Sequence[str] = ()) -> int:
    """Publishes the table at `root` without the rows whose `key` begins with the guarded prefix, so that a failure deletes nothing; how many rows went."""
    prefix = guarded_prefix(prefix, allowed)
    before = published(spark, root)
    gone = before.filter(below(key, prefix)).count()
    if gone:
        publish(before.filter(~F.coalesce(below(key, prefix), F.lit(False))), root, partition)
    return gone
