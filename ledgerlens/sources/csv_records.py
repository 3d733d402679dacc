"""Splittable CSV: one large file with line breaks in quoted fields, read by many tasks.

Spark reads a CSV file in byte ranges only if no field holds a line break. Whether a line begins inside a quoted
field depends on all quotes before it, so that is found in two passes over lines, which Spark splits freely:

1. For a line taken alone, two things are known: whether it ends inside a quoted field if it begins outside of one, and
   if it begins inside of one. These two bits are a function on {outside, inside}; a byte range's function is that of its
   lines, one after the other. A prefix composition over the ranges of a file (one row each) gives where each begins.
   (For files whose quotes are all balanced within fields this is the parity of the quotes; the functions also get
   quotes right that stand in the middle of an unquoted field, which are plain characters.)
2. Each range composes the functions of its lines from there on, and passes on whole records. A record that lies in two
   ranges or more is put together from its parts, at most two a range, and joined to the others.

Records are then parsed by ``from_csv``, in the JVM. If no line of the input ends inside a quoted field - a JVM-side check -
every line is a record, and Spark's own reader takes the file, split as usual.

Left to the reader that takes a file as a whole: encodings other than UTF-8, files with bare carriage returns as
line ends, and a single record (or what would be one) of more than ``PART_BYTES`` in one range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlens.plans.ship import ship
from ledgerlens.plans.stage import Run

#: A byte range keeps at most so many characters of a record that it shares with another range.
PART_BYTES = 8 << 20
#: Lines with more quotes or separators than this aren't matched in the JVM, whose patterns recurse; they count as open.
_MATCHED = 400

_RANGE = "file string, start long, lines long, from_out int, from_in int, head string, tail_out string, tail_in string, any boolean"


def _opens(sep: str, possessive: str = "+") -> str:
    """A line that begins outside of quotes and ends inside of them: whole fields, then a quoted one that isn't closed."""
    d = re.escape(sep)
    quoted = f'"[^"]*{possessive}(?:""[^"]*{possessive})*{possessive}'
    return f'(?:(?:{quoted}"[^{d}]*{possessive}|[^"{d}][^{d}]*{possessive}|){d})*{possessive}{quoted}$'


def file_key(path: str) -> str:
    """A path as ``file_name`` gives it."""
    return re.sub("^file:/+", "file:/", unquote(path))


def file_name() -> Column:
    """The path of the file that a row of a scan is from."""
    plus = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(plus), "^file:/+", "file:/")


def lines_of(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``value``, and the file and byte range (its start) that a line is from. A carriage return before a line feed stays."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", file_name().alias("file"), F.col("_metadata.file_block_start").alias("start"))


def opens(value: Column, sep: str) -> Column:
    """Whether the line may end inside a quoted field, if it begins outside of one."""
    count = lambda c: F.length(value) - F.length(F.replace(value, F.lit(c), F.lit("")))
    many = (count('"') > _MATCHED) | (count(sep) > _MATCHED)
    return F.contains(value, F.lit('"')) & F.when(many, True).otherwise(value.rlike("^" + _opens(sep)))


class _Ends:
    """For lines: whether each ends inside of quotes, beginning outside of them, and inside of them."""

    def __init__(self, sep: str):
        self.sep, self.out, self.inside = sep, re.compile(_opens(sep)), re.compile('[^"]*+(?:""[^"]*+)*+')

    def __call__(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(len(lines), np.int8), np.ones(len(lines), np.int8)
        at = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
        for i, line in zip(at.tolist(), lines.take(pa.array(at)).to_pylist()):
            a[i] = self.out.match(line) is not None
            close = self.inside.match(line).end()
            if close < len(line):  # a quote that ends the field; what follows up to the separator is literal
                rest = line.find(self.sep, close + 1)
                b[i] = rest >= 0 and self.out.match(line, rest + len(self.sep)) is not None
        return a, b


def states_after(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """The state (0 outside, 1 inside) after each line, from ``start`` before the first one."""
    n = np.arange(len(a))
    fixed = np.maximum.accumulate(np.where(a == b, n, -1)) if len(a) else n
    flips = np.cumsum((a > b).astype(np.int64))
    last = np.maximum(fixed, 0)
    base, seen = np.where(fixed >= 0, a[last], start), np.where(fixed >= 0, flips[last], 0)
    return (base + flips - seen) % 2


def _parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """Lines, cut where the byte range changes."""
    for batch in batches:
        lines, files, starts = (batch.column(n) for n in ("value", "file", "start"))
        if not batch.num_rows:
            continue
        at = starts.to_numpy()
        names = files.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (names[1:] != names[:-1])) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            yield files[i].as_py(), int(at[i]), lines.slice(i, j - i)


def _is_empty(record: str) -> bool:
    return record in ("", "\r")


class _Open:
    """A record that isn't complete: its lines, or None once they are too long to be kept."""

    def __init__(self):
        self.lines: list[str] | None = []
        self.size = 0

    def add(self, lines: list[str]) -> None:
        self.size += sum(map(len, lines)) + len(lines)
        self.lines = None if self.lines is None or self.size > PART_BYTES else self.lines + lines

    def text(self) -> str | None:
        return None if self.lines is None else "\n".join(self.lines)


class _Range:
    """What pass one knows of a byte range, for both states it may begin in."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.lines, self.state = file, start, 0, [0, 1]
        self.head, self.in_head, self.tail = _Open(), True, [_Open(), _Open()]
        self.any = False  # a record that isn't empty, if it begins outside of quotes

    def add(self, lines: pa.Array, a: np.ndarray, b: np.ndarray) -> None:
        self.lines += len(lines)
        for s in (0, 1):
            after = states_after(a, b, self.state[s])
            closed = np.flatnonzero(after == 0)
            first = 0
            if not s and not self.any:
                self.any = any(not _is_empty(x) for x in lines.take(pa.array(closed)).to_pylist())
            if s and self.in_head:
                first = int(closed[0]) + 1 if len(closed) else len(lines)
                self.head.add(lines.slice(0, first).to_pylist() if self.head.lines is not None else [])
                self.in_head = not len(closed)
            if first < len(lines):
                if len(closed) and closed[-1] >= first:
                    self.tail[s], first = _Open(), int(closed[-1]) + 1
                if first < len(lines):
                    self.tail[s].add(lines.slice(first).to_pylist() if self.tail[s].lines is not None else [])
            self.state[s] = int(after[-1])

    def row(self) -> dict:
        return {"file": self.file, "start": self.start, "lines": self.lines, "from_out": self.state[0], "from_in": self.state[1], "head": self.head.text(),
                "tail_out": self.tail[0].text(), "tail_in": self.tail[1].text(), "any": self.any}


def _ranges(sep: str):
    def rows(batches):
        ends, now = _Ends(sep), None
        for file, start, lines in _parts_of(batches):
            if now is None or (now.file, now.start) != (file, start):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema=_SCHEMA)
                now = _Range(file, start)
            now.add(lines, *ends(lines))
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_SCHEMA)

    return rows


_SCHEMA = pa.schema([("file", pa.string()), ("start", pa.int64()), ("lines", pa.int64()), ("from_out", pa.int32()), ("from_in", pa.int32()),
                     ("head", pa.string()), ("tail_out", pa.string()), ("tail_in", pa.string()), ("any", pa.bool_())])


def _whole_records(sep: str, begins: dict[tuple[str, int], int]):
    """The records that begin and end in a byte range, without empty ones, and without a file's first, its header."""

    def rows(batches):
        ends, at, state, skip, header, held = _Ends(sep), None, 0, False, False, []
        for file, start, lines in _parts_of(batches):
            if at != (file, start):
                at, held, header = (file, start), [], start == 0
                if at not in begins:
                    raise RuntimeError(f"the byte ranges of {file} have changed since they were scanned; read the file again")
                state = begins[at]
                skip = state == 1
            after = states_after(*ends(lines), state)
            state = int(after[-1])
            texts, first, out = lines.to_pylist(), 0, []
            for i in np.flatnonzero(after == 0).tolist():
                record = "\n".join([*held, *texts[first:i + 1]]) if held or i > first else texts[i]
                if skip:
                    skip = False
                elif not _is_empty(record):
                    if not header:
                        out.append(record)
                    header = False
                held, first = [], i + 1
            if not skip:
                held += texts[first:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([file] * len(out), pa.string())], names=["record", "file"])

    return rows


def records(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame | None:
    """``record`` and ``file``: the text of each record behind its file's header; None if a range shares too long a record with another."""
    ship(spark)
    lines = lines_of(spark, path)
    run = Run(spark)
    ranges = run.keep(lines.mapInArrow(_ranges(sep), _RANGE), "csv-ranges")  # a row for each byte range
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.sum((F.col("from_out") > F.col("from_in")).cast("int"))
    seen = ranges.withColumn("_f", F.coalesce(flips.over(before), F.lit(0))).withColumn("_upto", flips.over(by_file.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("start", (F.col("from_out") - F.col("_upto")).alias("v")))
    begun = seen.withColumn("begins", F.pmod(F.col("_f") + F.coalesce(F.max(fixed).over(before)["v"], F.lit(0)), F.lit(2)).cast("int"))
    begun = run.keep(begun.withColumn("head", F.when(F.col("begins") == 1, F.col("head"))).withColumn(
        "tail", F.when(F.col("begins") == 1, F.col("tail_in")).otherwise(F.col("tail_out"))).withColumn("long", (F.col("begins") == 1) & F.col("head").isNull() | F.col("tail").isNull())
        .select("file", "start", "begins", "head", "tail", "any", "long"), "csv-begins")
    begins = {(r.file, r.start): r.begins for r in begun.select("file", "start", "begins").toLocalIterator()}  # as many as tasks
    if begun.where("long").limit(1).count():
        return None
    parts = (begun.where("begins = 1").select("file", "start", F.lit(0).alias("kind"), F.col("head").alias("text"), F.lit(False).alias("header"))
             .union(begun.where("tail <> ''").select("file", "start", F.lit(1), "tail", (F.col("start") == 0) & ~F.col("any"))))
    ordered = Window.partitionBy("file").orderBy("start", "kind")
    glued = (parts.withColumn("n", F.sum("kind").over(ordered)).groupBy("file", "n")
             .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "text"))).alias("p"), F.max("header").alias("header")).where("not header")
             .select(F.array_join(F.transform("p", lambda x: x.text), "\n").alias("record"), "file"))
    return lines.mapInArrow(_whole_records(sep, begins), "record string, file string").union(glued)


def parse(record_rows: DataFrame, schema: StructType, options: dict[str, str], file_column: str | None = None) -> DataFrame:
    """Records to typed columns, in the JVM, and the path of each one's file if asked for."""
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    record = F.regexp_replace("record", "\r$", "")
    more = [F.col("file").alias(file_column)] if file_column else []
    return record_rows.select(F.from_csv(record, fields, options).alias("_r"), *more).select("_r.*", *[file_column] * bool(file_column))


def shape(spark: SparkSession, path: str | list[str], sep: str) -> str:
    """'lines' if every line is a record, 'records' if records may span lines, 'whole' if only the whole file can be read."""
    value = F.col("value")
    bare = F.instr(F.expr("substring(value, 1, length(value) - 1)"), "\r") > 0
    found = lines_of(spark, path).agg(F.max(bare).alias("bare"), F.max(opens(value, sep)).alias("opens")).first()
    return "whole" if found.bare else "records" if found.opens else "lines"
