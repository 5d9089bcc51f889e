"""Reading the given tables, and tables that a job writes for itself in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space separates words, as in the contracts of the operators.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is unset, a local master gets a temporary one; a cluster has none that all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-attesta-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders of the tables that written() has made, by name of the application, until they are released.
_made: dict[str, list[str]] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/attesta-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession, since: int = 0) -> list[str]:
    """Paths of the tables written so far, from the since-th on."""
    return _made.get(spark.sparkContext.applicationId, [])[since:]


def release(spark: SparkSession, paths: list[str], *still_read: DataFrame) -> None:
    """Deletes tables that written() has made, but for those that the given frames read."""
    plain = lambda path: re.sub("^[a-z0-9]+:/+", "/", path)
    files = [plain(f) for df in still_read for f in df.inputFiles()]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        folder = path.rpartition("/")[0]
        if not any(f.startswith(plain(folder) + "/") for f in files):
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number for each row, as a table in the shared folder.

    Operators that meet a row's results again by this number read docs more than once. How a scan is
    split, and so how it numbers rows, follows the cores that are there when it is planned; hence the
    numbers are written once, beside what is read again with them.
    """
    return written(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
