"""The shared working folder and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_unset: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    On a cluster the setting has to name a shared folder. Where it is unset, as in tests
    on one machine, a fresh temporary folder serves the application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _unset:
        _unset[context.applicationId] = tempfile.mkdtemp(prefix="callscope-")
    return _unset[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the working folder."""
    return f"{work_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Of tables whose rows take megabytes each. Parquet's writer looks at sizes only every 100 rows otherwise: a task's rows
#: would be one page and one row group, held at once by who writes and who reads them.
LARGE_ROWS = {
    "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a result and read it back: the plan behind it is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options or {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop's path, its file system): whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    place, system = _file_system(spark, path)
    system.delete(place, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    place, system = _file_system(spark, path)
    return system.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders directly in a folder, sorted; none if it is not there."""
    place, system = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(place)) if system.exists(place) else []


def move_path(spark: SparkSession, source: str, target: str) -> None:
    """Rename inside one store; the target must not be there."""
    (old, system), (new, _) = _file_system(spark, source), _file_system(spark, target)
    system.mkdirs(new.getParent())
    if not system.rename(old, new):
        raise OSError(f"cannot rename {source} to {target}")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step: under another name first, then renamed over an older one."""
    place, system = _file_system(spark, path)
    part, _ = _file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = system.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    system.delete(place, False)
    if not system.rename(part, place):
        raise OSError(f"cannot write {path}")


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None."""
    place, system = _file_system(spark, path)
    if not system.exists(place):
        return None
    stream = system.open(place)
    text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    stream.close()
    return text
