"""What the operators share: whole-text input, bounded Arrow batches, shared staging and sampling."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch may hold. Texts are long, so this is far below Spark's default.
ROWS_PER_BATCH = 500
#: Bytes of text that an operator turns into numpy arrays at once.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to ROWS_PER_BATCH, for small output batches, unless it asks for fewer.

    What bounds an input batch's memory is spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default).
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of every row; a null text is the empty text. Other columns are left out."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a new temporary one on a local master, else an error:
    executors would not see a folder of the driver's machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chromaspan-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    This cuts the lineage: what was computed survives a lost executor, and later steps read columns of a
    file instead of running Python again. The caller's cluster owns the folder's clean-up, as with
    checkpoints.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows with ``at``: their places, from 0, in the given order over the whole table.

    Rows are sorted in ranges; what the driver gets is one count a range. Where the order names every row, no key is
    gathered in one task. The table is staged.
    """
    spark = rows.sparkSession
    placed = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, begin, offsets = F.shiftright("at", 33), 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        offsets.append((r["part"], begin - (r["part"] << 33)))
        begin += r["count"]
    shifts = spark.createDataFrame(offsets, "part long, shift long")
    return placed.withColumn("part", part).join(F.broadcast(shifts), "part").withColumn("at", F.col("at") + F.col("shift")).drop("part", "shift")


def text_chunks(sizes: list[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (from, to) index ranges whose sizes sum to at most ``most``, or that hold one text."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield begin, k
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def hash_share(column: str, wanted: int, there: int) -> Column:
    """True for about wanted of there rows, picked by a hash of the column: the same rows in every run."""
    share = min(1.0, wanted / max(1, there))
    return F.pmod(F.xxhash64(F.col(column), F.lit(7)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, keep: Column | None = None) -> DataFrame:
    """(doc_id, text, y) of about ``most`` labelled documents: the bound is the parameter, the pick a hash of doc_id.

    Label rows with a null id or label are left out, of repeated ones the smallest label counts. The picked
    labels are at most about ``most`` rows, so they may be broadcast; the documents are not shuffled.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if keep is not None:
        marks = marks.where(keep)
    picked = marks.where(hash_share("doc_id", most, marks.count())).groupBy("doc_id").agg(F.min("y").alias("y"))
    return whole_texts(docs).join(F.broadcast(picked), "doc_id")


Batches = Iterator["pyarrow.RecordBatch"]  # noqa: F821
BatchFunction = Callable[[Batches], Batches]
