"""Records of delimited files whose quoted cells may hold line breaks, read by as many tasks as the files have splits.

A split cannot know whether it begins inside a quoted cell. So each one reports where it ends in either case, a prefix
scan over the splits of a file picks the case that holds, and a second pass cuts the records. A record that crosses splits
is put together from one fragment of each. Where no cell of any file holds a line break, lines are records and the second
pass is left out.

Text is taken as bytes in an encoding whose line feeds, quotes and separators are single ASCII bytes (UTF-8, ISO-8859-1).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = b'"'
_BOM = b"\xef\xbb\xbf"
MAX_RECORD = 1 << 26  # bytes; a longer record (as a rule a quote that is never closed) comes back cut, and marked
CUT = 1000  # bytes that are left of such a record

# Parts of a split: a whole record, the rest of a record that began in an earlier split, the beginning of one that goes on.
WHOLE, REST, BEGIN = 0, 1, 2
_PART_SCHEMA = "file string, block long, part int, text binary, long boolean"
_PART_TYPES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("text", pa.binary()), ("long", pa.bool_())])


def ends_inside(line: bytes, inside: bool, separator: bytes) -> bool:
    """Whether a quoted cell is open at the end of a line that begins inside of one, or at the start of a record."""
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            at += not inside
            close = line.find(QUOTE, at)
            while close >= 0 and line.startswith(QUOTE, close + 1):
                close = line.find(QUOTE, close + 2)
            if close < 0:
                return True
            inside, at = False, close + 1
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def lines_of(spark: SparkSession, paths: str | list[str], line_end: str = "\n") -> DataFrame:
    """(file, block, line): the bytes of each line with the split it begins in. A byte order mark is left out."""
    line = F.col("value").cast("binary")
    block = F.col("_metadata.file_block_start")
    marked = (block == 0) & (F.substring(line, 1, 3) == F.lit(_BOM))
    return spark.read.option("lineSep", line_end).text(paths).select(
        F.col("_metadata.file_path").alias("file"), block.alias("block"),
        F.when(marked, F.expr("substring(cast(value as binary), 4)")).otherwise(line).alias("line"),
    )


def split_outcomes(lines: DataFrame, separator: str) -> DataFrame:
    """(file, block, from_outside, from_inside, breaks): the state each split ends in, by the state it begins in.

    Only lines with a quote leave the JVM; a split without any changes nothing and has no row. `breaks` says
    whether a line of the split may leave a cell open.
    """
    mark = separator.encode()

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "from_outside", "from_inside", "breaks"]
        spot, out, ins, breaks = None, False, True, False
        for batch in batches:
            made = []
            for file, block, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != spot:
                    if spot:
                        made.append((*spot, out, ins, breaks))
                    spot, out, ins, breaks = (file, block), False, True, False
                after = ends_inside(line, False, mark), ends_inside(line, True, mark)
                out, ins = after[out], after[ins]
                breaks = breaks or after[0]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], names)
        if spot:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*spot, out, ins, breaks)], names)

    quoted = lines.filter(F.expr("contains(line, X'22')"))  # by bytes: a position in text would skip over what looks like a wide character
    return quoted.select("file", "block", "line").mapInArrow(
        follow, "file string, block long, from_outside boolean, from_inside boolean, breaks boolean"
    )


def _begin_inside(blocks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(file, block) of the splits that begin inside a quoted cell: a prefix scan over the outcomes.

    A split either ends in one state whatever it begins in, or changes the state, or leaves it. So the state before a split
    is that of the last settled one before it, turned by the number of changes since.
    """
    same = F.col("from_outside") == F.col("from_inside")
    steps = blocks.join(outcomes, ["file", "block"], "left").select(
        "file", "block",
        F.when(same, F.col("from_outside").cast("int")).alias("settled"),
        F.coalesce((~same & F.col("from_outside")).cast("int"), F.lit(0)).alias("turn"),
    )
    upto = Window.partitionBy("file").orderBy("block")
    turned = steps.withColumn("turns", F.sum("turn").over(upto))
    last = F.last(F.when(F.col("settled").isNotNull(), F.struct("settled", "turns")), ignorenulls=True).over(upto)
    state = F.coalesce(last["settled"], F.lit(0)) + F.col("turns") - F.coalesce(last["turns"], F.lit(0))
    ended = turned.withColumn("after", F.pmod(state, F.lit(2)))
    return ended.select("file", "block", F.lag("after", 1, 0).over(upto).alias("inside")).filter("inside = 1").select("file", "block")


def _cut_records(lines: DataFrame, separator: str, line_end: str) -> DataFrame:
    """Whole records and fragments of `lines`, which has `inside` for the state each split begins in."""
    mark, joint = separator.encode(), line_end.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, state, part, held, size = None, False, WHOLE, [], 0

        def taken(part: int) -> tuple:
            return (*spot, part, joint.join(held), size > MAX_RECORD)

        for batch in batches:
            made = []
            for file, block, line, inside in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != spot:
                    if held:
                        made.append(taken(part if part == REST else BEGIN))
                    spot, state, held, size = (file, block), inside, [], 0
                    part = REST if inside else WHOLE
                size += len(line) + len(joint)
                if size <= MAX_RECORD:
                    held.append(line)
                else:
                    held = [joint.join([*held, line])[:CUT]]
                state = ends_inside(line, state, mark) if state or QUOTE in line else False
                if not state:
                    made.append(taken(part))
                    part, held, size = WHOLE, [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), _PART_TYPES.types)], schema=_PART_TYPES)
        if held:
            last = [taken(part if part == REST else BEGIN)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*last), _PART_TYPES.types)], schema=_PART_TYPES)

    return lines.select("file", "block", "line", "inside").mapInArrow(cut, _PART_SCHEMA)


def _stitched(parts: DataFrame, line_end: str) -> DataFrame:
    """Records that cross splits, each at the split it begins in. A file has at most two fragments a split."""
    order = Window.partitionBy("file").orderBy("block", "part")
    pieces = parts.filter(F.col("part") != WHOLE).withColumn("record", F.sum((F.col("part") == BEGIN).cast("int")).over(order))
    upto = Window.partitionBy("file", "record").orderBy("block", "part")
    sized = pieces.withColumn("size", F.sum(F.length("text") + len(line_end)).over(upto))
    sized = sized.withColumn("over", F.col("long") | (F.col("size") > MAX_RECORD))
    piece = F.struct("block", "part", F.when(F.col("over"), F.substring("text", 1, CUT)).otherwise(F.col("text")).alias("text"))
    gathered = sized.groupBy("file", "record").agg(
        F.min("block").alias("block"), F.max("over").alias("long"),
        # whole fragments end at the bound; beyond it only the first ones are looked at
        F.sort_array(F.collect_list(F.when(~F.col("over") | (F.col("size") - F.length("text") <= MAX_RECORD), piece))).alias("pieces"),
    )
    text = F.expr(f"aggregate(slice(pieces, 2, size(pieces)), pieces[0].text, (a, p) -> concat(a, X'{line_end.encode().hex()}', p.text))")
    return gathered.select("file", "block", F.when(F.col("long"), F.substring(text, 1, CUT)).otherwise(text).alias("text"), "long")


def read_records(spark: SparkSession, paths: str | list[str], separator: str, line_end: str = "\n") -> tuple[DataFrame, DataFrame | None]:
    """(records that lie in one split, records that cross splits or None): file, block, text (bytes), long.

    Those of the first table are in scan order; a record of the second follows all of them that have its split. `long`
    marks a record above MAX_RECORD bytes, of which the first CUT are left. The splits that begin inside a cell are
    broadcast: at most one row of two values for each split.
    """
    lines = lines_of(spark, paths, line_end)
    outcomes = split_outcomes(lines, separator)
    if not outcomes.agg(F.coalesce(F.max("breaks"), F.lit(False))).first()[0]:
        return lines.select("file", "block", F.col("line").alias("text"), F.lit(False).alias("long")), None
    begin = _begin_inside(lines.select("file", "block").distinct(), outcomes)
    known = lines.join(F.broadcast(begin.withColumn("inside", F.lit(True))), ["file", "block"], "left")
    parts = _cut_records(known.withColumn("inside", F.coalesce("inside", F.lit(False))), separator, line_end)
    whole = parts.filter(F.col("part") == WHOLE).select("file", "block", "text", "long")
    return whole, _stitched(parts, line_end)


def number_records(whole: DataFrame, crossing: DataFrame | None, name: str, skip: int = 0) -> DataFrame:
    """Both tables of `read_records` (after filters and row-wise work) with their row numbers in each file.

    Numbers begin at 1 after `skip` rows, which are left out. Counts are kept for each split, in a table that Spark scans by file.
    """
    marked = whole.withColumn("_id", F.monotonically_increasing_id())
    splits = marked.groupBy("file", "block").agg(F.min("_id").alias("_low"), F.count("*").alias("_n"))
    if crossing is not None:
        extra = crossing.groupBy("file", "block").agg(F.lit(None).cast("long").alias("_low"), F.lit(0).cast("long").alias("_n"), F.count("*").alias("_more"))
        splits = splits.withColumn("_more", F.lit(0).cast("long")).unionByName(extra).groupBy("file", "block").agg(
            F.min("_low").alias("_low"), F.sum("_n").alias("_n"), F.sum("_more").alias("_more"))
    total = F.col("_n") + (F.col("_more") if crossing is not None else F.lit(0))
    before = F.sum(total).over(Window.partitionBy("file").orderBy("block")) - total
    splits = splits.withColumn("_before", before)
    table = splits.select("file", "block", (F.col("_before") - F.col("_low") + 1 - skip).alias("_shift"))
    numbered = marked.join(table, ["file", "block"]).withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_shift")
    if crossing is not None:
        places = splits.select("file", "block", (F.col("_before") + F.col("_n") + 1 - skip).alias(name))
        numbered = numbered.unionByName(crossing.join(places, ["file", "block"]))
    return numbered.filter(F.col(name) > 0)
