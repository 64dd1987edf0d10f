"""Tables in the folder that all executors share, and column names that don't clash."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a temporary folder serves, on one machine only: on a
    cluster each machine would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spindrel-"))
        atexit.register(shutil.rmtree, _own[0][len("file://") :], ignore_errors=True)
    return _own[0]


def kept(df: DataFrame, name: str = "rows") -> DataFrame:
    """The rows as a table in the shared folder: what follows starts from there, also when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(*frames: DataFrame) -> None:
    """Deletes tables made by kept() that nothing will read again."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(names: Iterable[str], wish: str) -> str:
    """A column name like `wish` that none of `names` takes, in any case."""
    taken = {n.lower() for n in names}
    while wish.lower() in taken:
        wish += "_"
    return wish
