"""CSV files as pandas writes them, read in many tasks: quoted line ends, a header per file, any width.

A record may hold line ends inside quotes, so where a record begins cannot be seen from the middle of a file. Quotes are
doubled inside quoted fields, so the number of quotes before a place tells: an odd number means inside. The files are read
as physical lines, split by byte ranges (blocks) as any text:

1. Every block reports whether it holds an odd number of quotes, and the first block of a file its header line. A running
   parity over a file's blocks says which blocks begin inside a quoted field. This table has one short row a block.
2. The lines are read again together with the state of their block. A task parses the records that lie in its block; the lines
   of a record that goes on in the next block, and those that end one, leave as fragments. Only files that have blocks
   beginning inside quotes are read for fragments; fragments are joined per record and parsed alike.
3. Each record meets the header of its file, by which fields are found: files may have their columns in any order, more
   columns than asked for, or fewer.

The state table is broadcast while it has at most ``FEW_BLOCKS`` rows; beyond, lines and states meet in a shuffle and are put
in order again. So is the table of headers if they also have at most ``SHORT_HEADERS`` characters, each block's counted. Neither
lines nor records are shuffled below that.

Defined results: an unquoted empty field is null, a quoted one an empty string; blank lines are skipped; line ends may be
``\\n`` or ``\\r\\n``; a byte order mark is dropped; an empty file has no rows, a file with only a header none either; columns a
file lacks are null. Raised as errors: a record with another number of fields than its header, an odd number of quotes in
an unquoted field, text after a closing quote, a file that ends inside quotes, a header that holds a line end, a value that is
not of the asked type.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import pin

FEW_BLOCKS = 100_000
SHORT_HEADERS = 1 << 23
INDEX_NAMES = ("", "_c0", "Unnamed: 0")
LARGEST_FIELD = 1 << 30
RECORDS = "key long, seq long, r array<string>, error string, fragment string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows that are equal in all columns."""
    n = len(columns[0])
    if not n:
        return
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    at = [*np.flatnonzero(change).tolist(), n]
    yield from zip(at[:-1], at[1:])


def _quotes(batches) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, header) of every run of lines of one block; the header of a file comes with its first line."""
    seen = None
    for batch in batches:
        value, file, block = batch.columns
        for a, b in _runs(file, block):
            where = file[a].as_py(), block[a].as_py()
            odd = (pc.sum(pc.count_substring(value.slice(a, b - a), '"')).as_py() or 0) % 2
            header = value[a].as_py() if where[1] == 0 and where != seen else None
            seen = where
            yield pa.RecordBatch.from_pydict({"file": [where[0]], "block": [where[1]], "odd": pa.array([odd], pa.int32()),
                                              "header": pa.array([header], pa.string())})


def _names(batches) -> Iterator[pa.RecordBatch]:
    """(header, h): column names of header lines."""
    for batch in batches:
        h = [next(csv.reader([x.removeprefix("\ufeff")], strict=True), []) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.list_(pa.string()))], names=["header", "h"])


def blocks_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, key, inside, header, cut): one row per block that holds lines; ``header`` is the file's, ``cut`` tells whether
    any block of the file begins inside quotes."""
    found = _lines(spark, path).mapInArrow(_quotes, "file string, block long, odd int, header string")
    each = found.groupBy("file", "block").agg(F.bit_xor("odd").alias("odd"), F.max("header").alias("header"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    each = each.select("file", "block", F.coalesce(F.bit_xor("odd").over(before), F.lit(0)).alias("inside"),
                       F.max("header").over(whole).alias("header"), F.bit_xor("odd").over(whole).alias("open"))
    each = each.withColumn("cut", F.max("inside").over(whole) == 1)
    each = pin(each.withColumn("key", F.monotonically_increasing_id()))
    bad = each.filter("open = 1 or header is null").select("file").first()
    if bad:
        raise ValueError(f"{bad['file']}: ends inside quotes")
    if each.filter("length(header) - length(replace(header, '\"', '')) & 1 = 1").first():
        raise ValueError(f"{path}: a header record holds a line end")
    return each.drop("open")


class _Block:
    """Parser of the lines of one block, fed in order."""

    def __init__(self, key: int, inside: int, first: bool):
        self.key, self.state, self.first = key, inside, first
        self.held: list[str] = []                           # lines of a record that is not complete yet
        self.head = bool(inside)                            # ... and that began in an earlier block
        self.seq = 0
        self.rows: list[tuple] = []

    def feed(self, lines: pa.Array) -> None:
        odd = np.asarray(pc.count_substring(lines, '"')).astype(np.int64) & 1
        after = np.bitwise_xor.accumulate(np.concatenate(([self.state], odd)))[1:]
        self.state = int(after[-1])
        lines = lines.to_pylist()
        if self.first:
            lines[0], self.first = lines[0].removeprefix("\ufeff"), False
        ends = np.flatnonzero(after == 0)
        if not len(ends):
            self.held += lines
            return
        done = 0
        if self.head:
            done = int(ends[0]) + 1
            self.rows.append((self.key, -1, None, None, "\n".join(self.held + lines[:done])))
            self.held, self.head = [], False
        stop = int(ends[-1]) + 1
        if stop > done:
            body = self.held + lines[done:stop]
            line_ends = np.concatenate((np.ones(len(self.held), np.int64), after[done:stop]))
            self._parse(body, line_ends)
            self.held = []
        self.held += lines[max(stop, done):]

    def _parse(self, lines: list[str], after: np.ndarray) -> None:
        reader = csv.reader((x + "\n" for x in lines), strict=True, quoting=csv.QUOTE_NOTNULL)
        at = 0
        try:
            for row in reader:
                now = reader.line_num
                if after[now - 1] or not after[at:now - 1].all():
                    raise csv.Error("a quote inside an unquoted field")
                at = now
                if row:
                    self.rows.append((self.key, self.seq, row, None, None))
                    self.seq += 1
        except csv.Error as e:
            self.rows.append((self.key, self.seq, None, str(e), None))
            self.seq += 1

    def close(self) -> None:
        if self.held:
            self.rows.append((self.key, -1 if self.head else self.seq, None, None, "\n".join(self.held)))

    def taken(self, fragments: bool) -> list[tuple]:
        rows, self.rows = self.rows, []
        return [r for r in rows if (r[4] is not None) == fragments]


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=[f.split()[0] for f in RECORDS.split(", ")])


def _parsed(batches, fragments: bool) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(LARGEST_FIELD)
    now = None
    for batch in batches:
        value, key, inside, block = batch.columns
        for a, b in _runs(key):
            if not key[a].is_valid:
                raise RuntimeError("the files' blocks changed between two reads")
            if now is None or now.key != key[a].as_py():
                if now:
                    now.close()
                    rows = now.taken(fragments)
                    if rows:
                        yield _out(rows)
                now = _Block(key[a].as_py(), inside[a].as_py(), block[a].as_py() == 0)
            now.feed(value.slice(a, b - a))
            rows = now.taken(fragments)
            if rows:
                yield _out(rows)
    if now:
        now.close()
        rows = now.taken(fragments)
        if rows:
            yield _out(rows)


def _with_state(lines: DataFrame, states: DataFrame, few: bool, how: str = "left") -> DataFrame:
    """(value, key, inside, block), the lines of a block together and in order; inner: only those of the blocks in ``states``."""
    shown = ["value", "key", "inside", "block"]
    if few:
        return lines.join(F.broadcast(states), ["file", "block"], how).select(shown)
    placed = lines.withColumn("pos", F.monotonically_increasing_id())
    return placed.join(states, ["file", "block"], how).repartition("file", "block") \
                 .sortWithinPartitions("file", "block", "pos").select(shown)


def _joined_records(fragments: DataFrame, blocks: DataFrame) -> DataFrame:
    """Records that go over a block's end, from their fragments: a tail, whole blocks, a head."""
    order = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, 0)
    tail = F.col("seq") >= 0
    parts = (fragments.join(blocks.select("key", "file", "block"), "key")
             .withColumn("record", F.sum(tail.cast("long")).over(order)))
    whole = parts.groupBy("file", "record").agg(
        F.min_by(F.struct("key", "seq"), F.struct("block", "seq")).alias("at"),
        F.array_sort(F.collect_list(F.struct("block", "seq", "fragment"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["fragment"]), "\n")

    def parse(batches) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LARGEST_FIELD)
        for batch in batches:
            out = []
            for key, seq, text in zip(*(c.to_pylist() for c in batch.columns)):
                lines = text.split("\n")
                own = _Block(key, 0, False)
                own.feed(pa.array(lines, pa.string()))
                out += [(key, seq, r, e, None) for _, _, r, e, _ in own.rows]
            if out:
                yield _out(out)
    return whole.select(F.col("at.key").alias("key"), F.col("at.seq").alias("seq"), text.alias("text")).mapInArrow(parse, RECORDS)


def read_records(spark: SparkSession, path: str, few_blocks: int = FEW_BLOCKS) -> DataFrame:
    """(file, h, r): header and fields of every record of the files at ``path`` but the headers themselves."""
    blocks = blocks_of(spark, path)
    few, short = blocks.agg(F.count("*") <= few_blocks, F.coalesce(F.sum(F.length("header")), F.lit(0)) <= SHORT_HEADERS).first()
    states = blocks.select("file", "block", "key", "inside")
    lines = _lines(spark, path)
    rows = _with_state(lines, states, few).mapInArrow(lambda b: _parsed(b, False), RECORDS)
    cut = blocks.filter("cut").select("file", "block", "key", "inside")
    if cut.first():
        # the states pick the lines: a join with the files alone would shuffle every line once more
        fragments = _with_state(lines, cut, few, "inner").mapInArrow(lambda b: _parsed(b, True), RECORDS)
        rows = rows.unionByName(_joined_records(fragments, blocks))
    names = blocks.select("header").distinct().mapInArrow(_names, "header string, h array<string>")
    heads = blocks.join(names, "header").select("key", "file", "block", "h")
    # said here: left to the sizes, the records are shuffled before those of the headers are known
    rows = rows.join(F.broadcast(heads) if few and short else heads, "key").filter(~((F.col("block") == 0) & (F.col("seq") == 0)))
    width = F.size("h") == F.size("r")
    why = F.coalesce("error", F.concat(F.lit("a record of "), F.size("r"), F.lit(" fields, the header has "), F.size("h")))
    message = F.concat("file", F.lit(": malformed near byte "), "block", F.lit(", record "), "seq", F.lit(": "), why)
    r = F.when(F.col("error").isNull() & width, F.col("r")).otherwise(F.raise_error(message))
    return rows.select("file", "h", r.alias("r"))


def field(name: str) -> Column:
    """The value of a named column of a record; null if the file lacks it."""
    return F.try_element_at("r", F.nullif(F.array_position("h", F.lit(name)), F.lit(0)).cast("int"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of one file, a folder or a pattern. Fields are found by the header of each file.

    Give a schema in production; without one all files are read once more to choose the narrowest of bigint, double, boolean
    and string for each column, and an unnamed first column (an index) is dropped.
    """
    rows = read_records(spark, path)
    if schema is None:
        wanted = _inferred(rows)
    else:
        wanted = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    return rows.select(*[field(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])


def _inferred(rows: DataFrame) -> T.StructType:
    heads = [h for (h,) in rows.select("h").distinct().collect()]      # layouts, not rows
    names = list(dict.fromkeys(n for h in heads for i, n in enumerate(h) if i or n not in INDEX_NAMES))
    kinds = [T.LongType(), T.DoubleType(), T.BooleanType()]
    fits = [F.min(field(n).isNull() | field(n).try_cast(k).isNotNull()).alias(f"c{i}_{j}")
            for i, n in enumerate(names) for j, k in enumerate(kinds)]
    found = rows.agg(*fits).first() if names else None
    return T.StructType([T.StructField(n, next((k for j, k in enumerate(kinds) if found[f"c{i}_{j}"]), T.StringType()))
                         for i, n in enumerate(names)])
