"""CSV files with line breaks inside quoted fields, read by many tasks each.

A file is read by byte ranges, as lines. Whether a range begins inside a quoted field follows from the number of
quotes before it, so the reader counts the quotes of every range, adds them up along the file, and then lets each
range find its own records: a record ends with a line up to which the quotes are even in number. A record that goes
on over the end of its range is put together from the ranges it touches. Only those pieces are shuffled.

The file is read three times: for the counts, for the records, and for the pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}
BROADCAST_RANGES = 1_000_000  # their marks take about 100 bytes each


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The batches cut where another range begins. A range is read by one task, in order."""
    for batch in batches:
        if not len(batch):
            continue
        start = batch.column("start").to_numpy()
        file = batch.column("file").dictionary_encode()
        which = file.indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((start[1:] != start[:-1]) | (which[1:] != which[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, len(batch)]):
            yield file.dictionary[which[low]].as_py(), int(start[low]), batch.slice(low, high - low)


def _odd(lines: pa.Array, before: int) -> np.ndarray:
    """1 for each line at whose end the number of quotes is odd."""
    return (before + np.cumsum(pc.count_substring(lines, '"').to_numpy(zero_copy_only=False))) & 1


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range whether its quotes are odd, and whether it ends a record if it begins outside or inside one."""
    rows, at = [], None
    for file, start, batch in _runs(batches):
        if at != (file, start):
            at = (file, start)
            rows.append([file, start, 0, False, False])
        odd = _odd(batch.column("value"), rows[-1][2])
        rows[-1][2:] = [int(odd[-1]), rows[-1][3] or not odd.all(), rows[-1][4] or bool(odd.any())]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()])],
        ["file", "start", "odd", "ends_outside", "ends_inside"],
    )


def _records(pieces: bool):
    """Whole records of each range but the header; or, as ``pieces``, what is left at its two ends: the end of a record
    begun earlier, and the beginning (``own``) of one that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carry, odd, inside, first = None, [], 0, False, False

        def piece(text: str, own: bool) -> pa.RecordBatch:
            file, start = at
            return pa.RecordBatch.from_pylist(
                [{"file": file, "start": start, "own": own, "header": first and own, "record": text}], schema
            )

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("own", pa.bool_()), ("header", pa.bool_()), ("record", pa.string())])
        if not pieces:
            schema = pa.schema([("record", pa.string())])

        def rest() -> Iterator[pa.RecordBatch]:
            if pieces and carry:
                yield piece("\n".join(t for c in carry for t in c.to_pylist()), not inside)

        for file, start, batch in _runs(batches):
            if at != (file, start):
                yield from rest()
                at, carry, inside, first = (file, start), [], batch.column("open")[0].as_py(), start == 0
                odd = int(inside)
            lines = batch.column("value")
            state = _odd(lines, odd)
            odd = int(state[-1])
            ends = np.flatnonzero(state == 0)
            if not len(ends):
                carry.append(lines)
                continue
            before = sum(map(len, carry))
            lines = pa.concat_arrays([*carry, lines])
            offsets = np.concatenate([[0], ends + 1 + before])
            carry = [lines[offsets[-1] :]] if offsets[-1] < len(lines) else []
            found = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), lines[: offsets[-1]]), "\n")
            if inside:  # the end of a record that began in an earlier range
                if pieces:
                    yield piece(found[0].as_py(), False)
                found = found[1:]
            elif first:
                found = found[1:]
            inside = first = False
            if not pieces:
                yield pa.RecordBatch.from_arrays([found], ["record"])
        yield from rest()

    return run


def _marked(lines: DataFrame, marks: DataFrame, few: bool) -> DataFrame:
    """Lines, in order within a range, with ``open``: their range begins inside a record. With too many ranges for a
    broadcast the lines are shuffled and sorted again."""
    on = ["file", "start"]
    if few:
        marked = lines.join(F.broadcast(marks), on, "left")
    else:
        marked = lines.withColumn("line", F.monotonically_increasing_id()).join(marks, on, "left")
        parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        marked = marked.repartition(parts, *on).sortWithinPartitions(*on, "line").drop("line")
    return marked.withColumn("open", F.coalesce("open", F.lit(False)))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of each record of the CSV files at ``path`` but the header that each file begins with,
    without its line end. Empty lines are no records. Ranges are as long as ``spark.sql.files.maxPartitionBytes`` says;
    a compressed file is one range. Quotes must stand around fields, and be doubled within them."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )
    ranges = lines.mapInArrow(_summaries, "file string, start long, odd int, ends_outside boolean, ends_inside boolean")
    along = Window.partitionBy("file").orderBy("start")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    goes_on = F.col("open") != (F.col("odd") == 1)
    begins = goes_on & (~F.col("open") | F.col("ends_inside"))
    ranges = ranges.withColumn("owner", F.last(F.when(begins, F.col("start")), True).over(before))
    marks = ranges.filter("open").select("file", "start", "open", "owner")

    longest = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sizes = spark.read.format("binaryFile").load(path).select("length")  # no content is read
    many = sizes.agg(F.sum(F.ceil(F.col("length") / _bytes(longest)))).first()[0] or 0
    marked = _marked(lines, marks.select("file", "start", "open"), many <= BROADCAST_RANGES)

    whole = marked.mapInArrow(_records(False), "record string")
    pieces = marked.mapInArrow(_records(True), "file string, start long, own boolean, header boolean, record string")
    pieces = pieces.join(marks.select("file", "start", "owner"), ["file", "start"], "left")
    owner = F.when(F.col("own"), F.col("start")).otherwise(F.col("owner")).alias("owner")
    parts = F.array_sort(F.collect_list(F.struct("start", "record")))
    joined = (
        pieces.groupBy("file", owner).agg(F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.bool_or("header").alias("header"))
        .filter("not header").select("record")
    )
    record = F.regexp_replace("record", r"\r\z", "")
    return whole.union(joined).select(record.alias("record")).filter("record <> ''")


def read_csv_in_ranges(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of the CSV files at ``path``, as Spark's own reader gives them with ``header``, ``multiLine`` and
    ``escape='"'``, but with every file read by as many tasks as it has ranges. Columns are those of the header, as
    text, or those of ``schema``. The order of rows is not kept. Line ends must be of one kind."""
    if schema is None:
        names = spark.read.csv(path, header=True, multiLine=True, escape='"').columns
        schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return csv_records(spark, path).select(F.from_csv("record", schema, OPTIONS).alias("row")).select("row.*")


def _bytes(size: str) -> int:
    """A size as Spark's settings write it: a number with b, k, m, g or t, or plain bytes."""
    size = size.strip().lower().removesuffix("b")
    unit = "kmgt".find(size[-1]) + 1
    return int(size[:-1] if unit else size) << (10 * unit)
