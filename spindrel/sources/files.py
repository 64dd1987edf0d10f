"""Text, JSONL and paired files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import has_extension


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, name, text: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(F.col(text_col).cast("string")).write.mode("overwrite").text(path)


def to_lines(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """line: each row as one JSON object; null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in columns or df.columns])).alias("line"))


def save_jsonl(df: DataFrame, path: str) -> str:
    """Writes one JSON object per line under <path>.jsonl (the ending comes once)."""
    path = path if path.endswith(".jsonl") else path + ".jsonl"
    to_lines(df).write.mode("overwrite").text(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Typed rows (or, without a schema, line and its parsed VARIANT). Blank lines are dropped; a malformed
    line fails the job when it is read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if schema is None:
        return lines.select(F.col("value").alias("line"), F.parse_json("value").alias("parsed"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def json_array_to_jsonl(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Turns files that hold one JSON array into JSONL; gives the items."""
    items = spark.read.json(source, multiLine=True)
    save_jsonl(items, target)
    return items


def list_files(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """path, name, length of the files directly in a folder, by ending of the lower-cased name."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "length")
    return files.where(has_extension(F.col("name"), extensions or []))


def base_name(name: Column) -> Column:
    """What pairs x.md, x.txt and x.md.jsonl."""
    return F.regexp_replace(name, r"(?:\.md\.jsonl|\.jsonl|\.md|\.txt)$", "")


def pair_outputs(content: DataFrame, jsonl: DataFrame, key: str = "base", order: str = "name") -> DataFrame:
    """Content rows with the jsonl row of the same key; of several jsonl rows the last by `order`."""
    last = jsonl.groupBy(key).agg(F.max_by(F.struct(*[c for c in jsonl.columns if c != key]), order).alias("r")).select(key, "r.*")
    renamed = [F.col(c).alias(c if c == key or c not in content.columns else f"jsonl_{c}") for c in last.columns]
    return content.join(last.select(*renamed), key)


def unpaired(content: DataFrame, jsonl: DataFrame, key: str = "base") -> DataFrame:
    return content.join(jsonl.select(key), key, "left_anti")


def process_parsed(content: DataFrame, lines: DataFrame, key: str = "base") -> DataFrame:
    """identifier, content, json_data: texts with all their parsed lines in order."""
    grouped = lines.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("json_data"))
    return content.join(grouped, key).select(F.col(key).alias("identifier"), F.col("text").alias("content"), "json_data")


def existing_answers(jsonl: DataFrame, json: DataFrame, least: int, key: str = "base") -> DataFrame:
    """key, source, n: jsonl answers where there are at least so many, else json ones; keys with neither don't come."""
    counts = lambda df, name: df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("source", F.lit(name))
    both = counts(jsonl, "jsonl").unionByName(counts(json, "json"))
    return both.groupBy(key).agg(F.max_by("n", "source").alias("n"), F.max("source").alias("source")).select(key, "source", "n")


def existing_answer_file(spark: SparkSession, jsonl_path: str, json_path: str, least: int) -> DataFrame | None:
    """The answers of a jsonl file if it has at least so many, else those of a file of one JSON array, which
    is then written as that jsonl file; None if neither has."""
    if path_exists(spark, jsonl_path):
        lines = read_jsonl(spark, jsonl_path).select("line")
        if lines.count() >= least:
            return lines
    if path_exists(spark, json_path):
        items = spark.read.json(json_path, multiLine=True)
        if items.count() >= least:
            save_jsonl(items, jsonl_path)
            return read_jsonl(spark, jsonl_path).select("line")
    return None


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def write_bytes(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> int:
    """Writes a stream of bytes (a response's, say) to a file, piece by piece; the number written. A file that breaks off is removed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out, n = fs.create(p, True), 0
    try:
        for chunk in chunks:
            out.write(bytearray(chunk))
            n += len(chunk)
    except BaseException:
        out.close()
        fs.delete(p, False)
        raise
    out.close()
    return n


def read_bytes(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """A file's bytes, `size` at a time."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    left, stream = fs.getFileStatus(p).getLen(), fs.open(p)
    try:
        while left > 0:
            chunk = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, left)))
            left -= len(chunk)
            yield chunk
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> bool:
    """True when nothing is there any more, whether or not something was."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.delete(p, True)) or not fs.exists(p)


def copy_path(spark: SparkSession, source: str, target: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    return bool(jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf))


def move_files(spark: SparkSession, source: str, target: str, prefix: str = "") -> int:
    """Moves the files directly in a folder (none where there is no such folder) into another that exists; how many."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    here, there = a.getFileSystem(conf), b.getFileSystem(conf)
    if not here.exists(a):
        return 0
    found = [f.getPath() for f in here.listStatus(a) if f.isFile()]
    for path in found:
        to = jvm.org.apache.hadoop.fs.Path(b, prefix + path.getName())
        moved = here.rename(path, to) if here.getUri().equals(there.getUri()) else jvm.org.apache.hadoop.fs.FileUtil.copy(here, path, there, to, True, conf)
        if not moved:
            raise OSError(str(path))
    return len(found)


def ensure_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p))
