"""Incremental jobs: ticks of rows, JSONL sinks, resumable reading, a job table, batched log lines."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ansi
from ..sources.files import copy_path, ensure_folder, move_files
from ..sources.tables import drop_kept, fresh, kept

ROWS_PER_TICK, SLICE_BYTES = 1000, 131072
LOG_BATCH, LOG_SECONDS = 10, 5
TERMINAL = ("completed", "failed", "cancelled", "expired")
STEPS = ("build input", "upload", "create", "wait", "capture ids", "download", "process outputs")


def _ordered(df: DataFrame, order: list[str]) -> tuple[DataFrame, str, str]:
    """The rows sorted by range, as a table, with the number of each one's range and its place there: from
    a table, as ranges cut twice may differ. The names of the two columns are new ones."""
    part, place = fresh(df.columns, "__part"), fresh(df.columns, "__place")
    number = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, number)
    return kept(ranged.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1)), "ordered"), part, place


def _before(ordered: DataFrame, part: str, amount: Column, name: str) -> DataFrame:
    """part, name: the sum of `amount` over all earlier ranges. One row a range."""
    sums = ordered.groupBy(part).agg(F.sum(amount).alias(name))
    return sums.withColumn(name, F.coalesce(F.sum(name).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def ticks(df: DataFrame, order: list[str], per_tick: int = ROWS_PER_TICK, partition: list[str] | None = None) -> DataFrame:
    """Adds tick, from 0: rows in order, so many at a time. Without partition columns the numbers come
    from sizes of ranges and places in them, so no single task sorts all rows."""
    if partition:
        return df.withColumn("tick", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1) / per_tick).cast("long"))
    ordered, part, place = _ordered(df, order)
    base = fresh(ordered.columns, "__base")
    return ordered.join(_before(ordered, part, F.lit(1), base), part).withColumn("tick", F.floor((F.col(base) + F.col(place)) / per_tick).cast("long")).drop(part, place, base)


def byte_slices(lines: DataFrame, order: list[str], line_col: str = "line", slice_bytes: int = SLICE_BYTES, partition: list[str] | None = None) -> DataFrame:
    """Adds begin, end (bytes, with the line end) and slice: the read of so many bytes that completes the
    line. Without partition columns all lines are one file; sums by range keep any task from sorting all."""
    size = F.octet_length(line_col) + 1
    if partition:
        out = lines.withColumn("end", F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ordered, part, place = _ordered(lines, order)
        base = fresh(ordered.columns, "__base")
        within = F.sum(size).over(Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        out = ordered.join(_before(ordered, part, size, base), part).withColumn("end", F.col(base) + within).drop(part, place, base)
    return out.withColumn("begin", F.col("end") - size).withColumn("slice", F.floor((F.col("end") - 1) / slice_bytes).cast("long"))


def append_jsonl(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Writes all that there is as JSON lines, each row once, and stops; called again it goes on from there."""
    query = stream.writeStream.format("json").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def tail_jsonl(spark: SparkSession, path: str, files_per_tick: int = 1) -> DataFrame:
    """Stream of line: whole lines of files as they come, the last one with or without a line end."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_tick).text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))


def for_each_line(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every micro-batch to on_batch; the checkpoint is the resume token."""
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_json_lines(stream: DataFrame, id_col: str, doc_col: str) -> DataFrame:
    """One JSON line per document that came through; each comes once."""
    return stream.select(F.to_json(F.struct(F.col(id_col), F.col(doc_col))).alias("value"))


def parse_line(line: Column) -> Column:
    """struct<custom_id,ok,body,error,status_code> of an output line; a line that isn't JSON is an error."""
    get = lambda p: F.get_json_object(line, p)
    bad = F.try_parse_json(line).isNull()
    error = F.when(bad, F.lit("malformed")).otherwise(get("$.error"))
    return F.struct(get("$.custom_id").alias("custom_id"), error.isNull().alias("ok"), F.coalesce(get("$.response.body"), get("$.body")).alias("body"), error.alias("error"), get("$.response.status_code").cast("int").alias("status_code"))


def new_jobs(ids: DataFrame, out_dir: str, window: str = "24h") -> DataFrame:
    """The job table: one row per id, at its first step."""
    return ids.select(
        F.col("job_id"), F.concat(F.lit(out_dir.rstrip("/") + "/"), "job_id", F.lit(".input.jsonl")).alias("input_path"), F.lit(window).alias("completion_window"), F.lit(0).alias("next_step"),
        F.lit("active").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("reason", "input_file_id", "batch_id", "batch_status", "output_file_id", "error_file_id")], F.lit(0).cast("long").alias("line_count"),
    )


def waiting(batch_status: Column) -> Column:
    """Reason to wait for a batch: null once it has ended."""
    return F.when(F.lower(batch_status).isin(*TERMINAL), F.lit(None).cast("string")).otherwise(F.concat(F.lit("batch:"), F.coalesce(batch_status, F.lit("unknown"))))


class Client:
    """What a job needs of the service; tests and users bring their own. Runs on the driver, per job."""

    def build(self, job: dict) -> int | None:
        """Lines written so far when the input is complete, else None."""
        raise NotImplementedError

    def upload(self, path: str) -> str:
        raise NotImplementedError

    def create(self, file_id: str, window: str) -> tuple[str, str]:
        raise NotImplementedError

    def poll(self, batch_id: str) -> dict:
        raise NotImplementedError

    def download(self, file_id: str, path: str) -> None:
        raise NotImplementedError

    def process(self, job: dict) -> bool:
        raise NotImplementedError


@dataclass(frozen=True)
class Cursor:
    """How far a file of lines has been read: bytes, up to a line's start, and lines. Two numbers, so it can be stored anywhere."""

    pos: int = 0
    count: int = 0


def read_lines(spark: SparkSession, path: str, cursor: Cursor, slice_bytes: int = SLICE_BYTES) -> tuple[list[str], Cursor, bool]:
    """The lines that end in the next slice_bytes, where to go on, and whether that was all. What the slice
    cuts off is read with the next one, so no character is split; a line that is longer than a slice comes
    whole; the last one comes with or without a line end."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    size, data, much = fs.getFileStatus(p).getLen(), b"", slice_bytes
    while cursor.pos < size:
        much = min(much, size - cursor.pos)
        stream = fs.open(p)
        try:
            stream.seek(cursor.pos)
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, much))
        finally:
            stream.close()
        if cursor.pos + much >= size:
            break
        if b"\n" in data:
            data = data[: data.rindex(b"\n") + 1]
            break
        much *= 2
    lines = [x.decode("utf-8", "replace") for x in data.split(b"\n") if x.strip()]
    after = Cursor(cursor.pos + len(data), cursor.count + len(lines))
    return lines, after, after.pos >= size


class FolderClient(Client):
    """A service that is a folder: files are folders of text in it, and `answer` makes output lines of
    input lines (a table of `line` each) once a batch has been polled so often. All work on lines is
    Spark's; the state is what the service would keep."""

    def __init__(self, lines: DataFrame, order: list[str], root: str, answer: Callable[[DataFrame], DataFrame], per_tick: int = ROWS_PER_TICK, polls: int = 2):
        self.spark, self.root, self.answer, self.polls = lines.sparkSession, root.rstrip("/"), answer, polls
        # each tick's lines are files of their own, written once: a tick moves them and reads nothing
        numbered = kept(ticks(lines, order, per_tick), "numbered")
        self.count, last = numbered.agg(F.count("*"), F.max("tick")).first()
        self.last, self.staged = last or 0, f"{self.root}/staged-{uuid.uuid4().hex}"
        numbered.select("line", "tick").write.partitionBy("tick").text(self.staged)
        drop_kept(numbered)
        self.next_tick, self.files = 0, 0
        self.batches: dict[str, dict] = {}

    def _new(self) -> str:
        self.files += 1
        return f"file-{self.files}"

    def build(self, job: dict) -> int | None:
        ensure_folder(self.spark, job["input_path"])
        move_files(self.spark, f"{self.staged}/tick={self.next_tick}", job["input_path"], f"tick-{self.next_tick}-")
        self.next_tick += 1
        return None if self.next_tick <= self.last else self.count

    def upload(self, path: str) -> str:
        name = self._new()
        if not copy_path(self.spark, path, f"{self.root}/{name}"):
            raise OSError(path)
        return name

    def create(self, file_id: str, window: str) -> tuple[str, str]:
        name = f"batch-{len(self.batches) + 1}"
        self.batches[name] = {"status": "validating", "file": file_id, "polls": self.polls, "output_file_id": None, "error_file_id": None}
        return name, "validating"

    def poll(self, batch_id: str) -> dict:
        batch = self.batches[batch_id]
        if batch["status"] not in TERMINAL:
            batch["status"] = "in_progress" if batch["polls"] > 0 else "completed"
            batch["polls"] -= 1
            if batch["status"] == "completed":
                batch["output_file_id"] = self._new()
                self.answer(self.spark.read.text(f"{self.root}/{batch['file']}").select(F.col("value").alias("line"))).select("line").write.text(f"{self.root}/{batch['output_file_id']}")
        return batch

    def download(self, file_id: str, path: str) -> None:
        if not copy_path(self.spark, f"{self.root}/{file_id}", path):
            raise OSError(path)

    def process(self, job: dict) -> bool:
        return True


def output_path(job: dict, kind: str = "output") -> str:
    return job["input_path"].rsplit("/", 1)[0] + f"/{job['job_id']}.{kind}.jsonl"


def tick(job: dict, client: Client) -> dict:
    """One step of one job row. A step that throws fails the job and says why; it doesn't go on."""
    job = {**job, "reason": None}
    try:
        step = STEPS[job["next_step"]] if job["next_step"] < len(STEPS) else None
        if step == "build input":
            n = client.build(job)
            if n is None:
                return {**job, "reason": "awaiting-input"}
            job["line_count"] = n
        elif step == "upload":
            job["input_file_id"] = client.upload(job["input_path"])
        elif step == "create":
            job["batch_id"], job["batch_status"] = client.create(job["input_file_id"], job["completion_window"])
        elif step == "wait":
            job["batch_status"] = client.poll(job["batch_id"])["status"]
            if job["batch_status"] not in TERMINAL:
                return {**job, "reason": f"batch:{job['batch_status']}"}
        elif step == "capture ids":
            seen = client.poll(job["batch_id"])
            job["output_file_id"], job["error_file_id"] = seen.get("output_file_id"), seen.get("error_file_id")
        elif step == "download":
            for kind, file_id in (("output", job["output_file_id"]), ("errors", job["error_file_id"])):
                if file_id:
                    client.download(file_id, output_path(job, kind))
        elif step == "process outputs":
            if not client.process(job):
                return {**job, "reason": "processing-outputs"}
        if step is not None:
            job["next_step"] += 1
        if job["next_step"] >= len(STEPS):
            job["status"] = "done"
    except Exception as e:
        return {**job, "status": "failed", "reason": f"error: {e}"}
    return job


def run_job(job: dict, client: Client, sleep: Callable[[float], None] | None = None, delay: float = 60.0, until: str | None = None) -> dict:
    """Ticks until the job has ended, or first waits for a reason that starts with `until`."""
    while job["status"] == "active":
        job = tick(job, client)
        if until and (job["reason"] or "").startswith(until):
            break
        if sleep and (job["reason"] or "").startswith("batch:"):
            sleep(delay)
    return job


def log_batches(lines: DataFrame, order: list[str], level_col: str, text_col: str, per_batch: int = LOG_BATCH, partition: list[str] | None = None) -> DataFrame:
    """batch, n, message: lines in order, ten to a message, colours stripped."""
    keys = partition or []
    numbered = ticks(lines, order, per_batch, partition).withColumnRenamed("tick", "batch")
    text = F.concat(F.lit("["), F.col(level_col), F.lit("] "), strip_ansi(F.col(text_col)))
    grouped = numbered.groupBy(*keys, "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(*order, text.alias("__t")))).alias("m"))
    return grouped.select(*keys, "batch", "n", F.array_join(F.transform("m", lambda x: x["__t"]), "\n").alias("message"))


#: Levels of the log, from the gravest; a level lets through those up to it.
LEVELS = ("error", "warn", "info", "impt", "attn")


def append_log(stream: DataFrame, path: str, checkpoint: str, on_message: Callable[[list[str]], None] | None = None, level: str = "attn", seconds: float | None = None):
    """Log sink: a file of lines, and messages of ten lines at most for a listener. Lines whose column
    `level` (where there is one) is beyond `level` go. Takes what there is and stops, or with `seconds`
    (LOG_SECONDS, say) runs on and flushes so often; stop() ends it."""
    if "level" in stream.columns:
        stream = stream.where(F.col("level").isin(*LEVELS[: LEVELS.index(level) + 1]))

    def write(batch: DataFrame, number: int) -> None:
        batch.select(strip_ansi(F.col("line")).alias("line")).write.mode("append").text(path)
        if on_message:
            held: list[str] = []
            for row in batch.select(strip_ansi(F.col("line"))).toLocalIterator():
                held.append(row[0])
                if len(held) == LOG_BATCH:
                    on_message(held)
                    held = []
            if held:
                on_message(held)

    if seconds is None:
        return for_each_line(stream, write, checkpoint)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
