"""Files of any store that Spark reads, through its file system interface: what there is, how large, made and removed."""

from pyspark.sql import DataFrame, SparkSession

FILES = "path string, name string, is_folder boolean, bytes long, modified_ms long"


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, is_folder, bytes, modified_ms) of what a folder holds, by name; the names of one folder go through the driver."""
    at, fs = _path(spark, folder)
    rows = [(s.getPath().toString(), s.getPath().getName(), s.isDirectory(), 0 if s.isDirectory() else s.getLen(), s.getModificationTime()) for s in fs.listStatus(at)]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), FILES)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder."""
    at, fs = _path(spark, path)
    return fs.getContentSummary(at).getLength()


def make_folder(spark: SparkSession, path: str) -> None:
    """Makes a folder and those above it; one that is there stays as it is."""
    at, fs = _path(spark, path)
    fs.mkdirs(at)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a file or a folder with all it holds; False if there was none."""
    at, fs = _path(spark, path)
    return fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes one small file, in the place of an older one."""
    at, fs = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return bytes(spark.read.format("binaryFile").load(path).first().content).decode()
