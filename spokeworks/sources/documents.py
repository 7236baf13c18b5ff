"""Reading large JSON documents in parallel: the elements of an array in them, in order, numbered over all files.

Spark splits the files into byte ranges at closing braces, wherever these stand. A first pass tells of
each range what it does to the scan that comes in from its left, within or outside of a string: how it
leaves it, and how many levels it opens. Put together range by range, this tells where each range
begins. The second pass cuts the elements out of the ranges; an element that crosses a border comes in
pieces, one from each range, which are joined again. Numbers are sums over the ranges before.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.order import running_sum
from ..session import cut

#: Ranges whose beginnings are broadcast at most; more are joined.
MOST_RANGES = 200_000
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+(?:(")(\s*:)?|\Z)|[{}\[\]]', re.DOTALL)
_STRING_END = re.compile(r'(?:[^"\\]|\\.)*+("|\Z)', re.DOTALL)
OPEN, STRING, KEY = "open", "string", "key"


def scan(text: str, inside: bool) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of a text's brackets, which are their own kind, and strings; first of what ends a string that is open."""
    at = 0
    if inside:
        m = _STRING_END.match(text)
        yield 0, m.end(), STRING if m.group(1) else OPEN
        at = m.end()
    for m in _TOKEN.finditer(text, at):
        mark = m.group()
        yield m.start(), m.end(), mark if mark in "{}[]" else KEY if m.group(2) else STRING if m.group(1) else OPEN


def passed(text: str, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after the text, and the levels it opens less those it closes."""
    depth, kind = 0, ""
    for _, _, kind in scan(text, inside):
        depth += (kind in ("{", "[")) - (kind in ("}", "]"))
    return kind == OPEN, depth


class Cutter:
    """Cuts the elements, objects in the array of a name in an outermost object, out of the texts of one range.

    Elements before the range's first key of an outermost object are inherited: the name of their array
    stands in an earlier range.
    """

    def __init__(self, inside: bool, depth: int, array: str):
        self.inside, self.depth, self.array, self.key = inside, depth, array, None
        self.begun = {False: 0, True: 0}  # inherited elements and own ones
        self.part, self.held = ("tail", [] if depth >= 3 else None)

    def feed(self, text: str) -> Iterator[tuple[str, bool, int, str]]:
        """(whole or tail, own, number among those, text) of elements that end; a tail has the number -1."""
        at, kind = 0, ""
        for start, end, kind in scan(text, self.inside):
            if kind in ("{", "["):
                self.depth += 1
                if self.depth == 3 and kind == "{" and self.key in (None, self.array):
                    self.part, self.held, at = "whole", [], start
                    self.begun[self.key is not None] += 1
            elif kind in ("}", "]") and self.depth > 0:  # after a file's last brace a brace more may stand
                self.depth -= 1
                if self.depth == 2 and self.held is not None:
                    yield self._piece(self.part, text[at:end])
                    self.held = None
            elif self.depth == 1 and kind == KEY:
                self.key = json.loads(text[start : text.rindex('"', start, end) + 1])
        self.inside = kind == OPEN
        if self.held is not None:
            self.held.append(text[at:])

    def rest(self) -> Iterator[tuple[str, bool, int, str]]:
        """The piece of an element that goes on in the next range."""
        if self.held is not None:
            yield self._piece("head" if self.part == "whole" else "middle", "")

    def _piece(self, part: str, text: str) -> tuple[str, bool, int, str]:
        own = self.key is not None
        return part, own, self.begun[own] - 1 if part in ("whole", "head") else -1, "".join([*self.held, text])


def _by_range(batches: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[tuple, str | None]]:
    """(file, start and ``extra`` further columns, text) in order, then the range with None at its end."""
    now = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        held: list[str] = []
        for *key, value in zip(*columns[: 2 + extra], columns[-1], strict=True):
            if now is not None and tuple(key) != now:
                if held:
                    yield now, "}".join([*held, ""])
                    held = []
                yield now, None
            now = tuple(key)
            held.append(value)
        if held:
            yield now, "}".join([*held, ""])
    if now is not None:
        yield now, None


def _record(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range), value (what stands before each closing brace), in order within a range."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def beginnings(texts: DataFrame) -> DataFrame:
    """file, start, inside boolean, depth int: for each range whether a string is open where it begins, and at which level."""
    names, kinds = ["file", "start", "inside0", "depth0", "inside1", "depth1"], [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.int32()]

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(False, 0), (True, 0)]
        for key, text in _by_range(batches, 0):
            if text is None:
                yield _record(names, kinds, [(*key, *state[0], *state[1])])
                state = [(False, 0), (True, 0)]
            else:
                state = [(now[0], depth + now[1]) for inside, depth in state for now in (passed(text, inside),)]

    def follow(t: pa.Table) -> pa.Table:
        out, inside, depth = [], False, 0
        for row in sorted(t.to_pylist(), key=lambda r: r["start"]):
            out.append({"file": row["file"], "start": row["start"], "inside": inside, "depth": depth})
            k = int(inside)
            inside, depth = row[f"inside{k}"], depth + row[f"depth{k}"]
        return pa.Table.from_pylist(out, pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int32())]))

    told = texts.mapInArrow(tell, "file string, start long, inside0 boolean, depth0 int, inside1 boolean, depth1 int")
    return told.groupBy("file").applyInArrow(follow, "file string, start long, inside boolean, depth int")  # one row a range


def pieces(texts: DataFrame, array: str) -> DataFrame:
    """file, start, part, own, number, element: what each range holds of elements; the row with part 'end' has its last key in element.

    In that row number counts the range's inherited elements, n_own its own ones.
    """
    at = cut(beginnings(texts))
    few = at.count() <= MOST_RANGES
    placed = texts.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(at) if few else at, ["file", "start"])
    if not few:
        placed = placed.repartition("file", "start").sortWithinPartitions("file", "start", "__row")
    names = ["file", "start", "part", "own", "number", "n_own", "element"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = None
        for (file, start, inside, depth), text in _by_range(batches, 2):
            cutter = cutter or Cutter(inside, depth, array)
            found = [(file, start, part, own, n, None, element) for part, own, n, element in (cutter.feed(text) if text is not None else cutter.rest())]
            if text is None:
                found.append((file, start, "end", None, cutter.begun[False], cutter.begun[True], cutter.key))
                cutter = None
            if found:
                yield _record(names, kinds, found)

    return placed.select("file", "start", "inside", "depth", "value").mapInArrow(work, "file string, start long, part string, own boolean, number long, n_own long, element string")


def read_elements(spark: SparkSession, path: str, array: str) -> DataFrame:
    """seq long, file string, element string: the objects in the arrays named ``array`` of the documents' outermost objects.

    seq counts from 0 over all files, in the order of their paths and of the objects in each. A file may
    hold one document or several, one after another. Empty files and documents without the array give no
    rows. Of a document that is cut short the object at its end is undefined. The path may name a file,
    a folder or a pattern; an element must fit a task.
    """
    found = cut(pieces(ranges(spark, path), array))
    ends = found.filter("part = 'end'").select("file", "start", F.col("element").alias("key"), F.col("number").alias("n_inherited"), "n_own")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    known = F.coalesce(F.last("key", ignorenulls=True).over(before) == array, F.lit(False))
    ends = ends.withColumn("known", known).withColumn("n_inherited", F.when(F.col("known"), F.col("n_inherited")).otherwise(0))
    n = F.col("n_inherited") + F.col("n_own")
    places = cut(running_sum(ends, ["file", "start"], n, "upto").select("file", "start", "known", "n_inherited", (F.col("upto") - n).alias("offset")))
    parts = found.filter("part <> 'end'").join(F.broadcast(places) if places.count() <= MOST_RANGES else places, ["file", "start"]).filter("own or known")
    seq = F.col("offset") + F.col("number") + F.when(F.col("own"), F.col("n_inherited")).otherwise(0)
    parts = parts.select(seq.alias("seq"), "file", "start", "part", "element")
    several = F.array_sort(F.collect_list(F.struct("start", "element")))  # the pieces of one element, one a range
    joined = parts.filter("part <> 'whole'").groupBy("seq", "file").agg(F.array_join(F.transform(several, lambda p: p["element"]), "").alias("element"), F.max(F.col("part") == "tail").alias("ended"))
    return parts.filter("part = 'whole'").select("seq", "file", "element").unionByName(joined.filter("ended").drop("ended"))
