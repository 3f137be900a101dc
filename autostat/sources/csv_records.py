"""CSV records from files of any size, also where quoted cells hold line breaks.

Spark cuts a file into byte ranges and deals whole lines of a range to one task, but whether a line begins a record
depends on all quotes before it. A range is therefore first reduced to a map of two states (outside or inside quotes at
its start -> at its end); these maps are composed along each file, which gives every range its starting state. A second
pass puts lines together to records. Records that cross from one range to the next are sent as pieces, at most two from
a range, and joined. One file is read by as many tasks as it has ranges.

A quote opens a cell only as its first character; inside, two quotes stand for one. Records end at line feeds (a carriage
return before one belongs to it); empty lines outside quotes are left out. A cell that is never closed ends with its file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
WHOLE, ENDS, CROSSES, BEGINS = range(4)


def inside_after(line: str, inside: bool, sep: str) -> bool:
    """Whether a line that starts outside or inside quotes leaves a quoted cell open."""
    at, opening = 0, not inside
    while True:
        if inside:
            at = line.find(QUOTE, at)
            if at < 0:
                return True
            if line.startswith(QUOTE, at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif opening and line.startswith(QUOTE, at):
            inside, at = True, at + 1
        else:
            at = line.find(sep, at)
            if at < 0:
                return False
            at += len(sep)
            opening = True
            continue
        opening = False


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each (file, range) of a batch."""
    if not batch.num_rows:
        return
    file, start = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
    code = file.indices.to_numpy()
    cuts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (start[1:] != start[:-1])])
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows], strict=True):
        yield (batch.column("file")[a].as_py(), int(start[a])), batch.slice(a, b - a)


def _transitions(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, states = None, [False, True]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": here[0], "start": here[1], "from_outside": states[0], "from_inside": states[1]}])

        for batch in batches:
            for at, rows in _stretches(batch):
                if at != here:
                    if here is not None:
                        yield out()
                    here, states = at, [False, True]
                for line in rows.column("value").drop_null().to_pylist():
                    states = [inside_after(line, s, sep) for s in states]
        if here is not None:
            yield out()

    return run


def _starting_inside(maps: pa.Table) -> pa.Table:
    """Of one file's ranges, those that start inside quotes; one more, at -1, if its end is inside."""
    maps, inside, found = maps.sort_by("start"), False, []
    for row in maps.to_pylist():
        if inside:
            found.append({"file": row["file"], "start": row["start"]})
        inside = row["from_inside"] if inside else row["from_outside"]
    if inside:
        found.append({"file": row["file"], "start": -1})
    return pa.Table.from_pylist(found, pa.schema([("file", pa.string()), ("start", pa.int64())]))


PIECE = "record string, file string, start long, kind int, first boolean"


def _assembled(sep: str, starting_inside):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, entered, lines, first = None, False, False, [], False

        def rows(records, at, kind: int, is_first: np.ndarray | bool) -> pa.RecordBatch:
            n = len(records)
            values = records if isinstance(records, pa.Array) else pa.array(records, pa.string())
            flags = pa.array(np.broadcast_to(is_first, n).copy())
            return pa.RecordBatch.from_arrays(
                [values, pa.array([at[0]] * n), pa.array(np.full(n, at[1])), pa.array(np.full(n, kind, np.int32)), flags],
                [c.split()[0] for c in PIECE.split(", ")],
            )

        def leave():
            """What is open when a range ends goes on in the next one."""
            if lines:
                yield rows(["\n".join(lines)], here, CROSSES if entered else BEGINS, first)

        for batch in batches:
            for at, part in _stretches(batch):
                if at != here:
                    yield from leave()
                    here, lines, first = at, [], at[1] == 0
                    inside = entered = at in starting_inside.value
                values = part.column("value")
                quoted = pc.match_substring(values, QUOTE).to_numpy(zero_copy_only=False)
                if not inside and not quoted.any():
                    kept = values.filter(pc.not_equal(pc.utf8_rtrim(values, "\r"), ""))
                    if len(kept):
                        yield rows(kept, here, WHOLE, np.r_[first, np.zeros(len(kept) - 1, bool)])
                        first = False
                    continue
                done, is_first = [], []
                for line, has_quote in zip(values.to_pylist(), quoted.tolist(), strict=True):
                    if not inside and not line.rstrip("\r"):
                        continue
                    lines.append(line)
                    inside = inside_after(line, inside, sep) if has_quote else inside
                    if inside:
                        continue
                    record = "\n".join(lines)
                    lines = []
                    if entered:
                        yield rows([record], here, ENDS, False)
                        entered = False
                    else:
                        done.append(record)
                        is_first.append(first)
                        first = False
                if done:
                    yield rows(done, here, WHOLE, np.array(is_first))
        yield from leave()

    return run


def records(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """(record) of all files at `path`, each whole as it stands in its file; without the first of each file if `header`."""
    lines = spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    # Only lines with quotes can change the state.
    marked = lines.select(F.when(F.contains("value", F.lit(QUOTE)), F.col("value")).alias("value"), "file", "start")
    maps = marked.mapInArrow(_transitions(sep), "file string, start long, from_outside boolean, from_inside boolean")
    inside = maps.groupBy("file").applyInArrow(_starting_inside, "file string, start long").collect()  # at most one a range
    starting_inside = spark.sparkContext.broadcast({(r["file"], r["start"]) for r in inside})
    pieces = lines.mapInArrow(_assembled(sep, starting_inside), PIECE)
    whole = pieces.where(F.col("kind") == WHOLE).select("record", "first")
    if not inside:
        found = whole
    else:
        along = Window.partitionBy("file").orderBy("start", "kind")
        crossing = pieces.where(F.col("kind") != WHOLE).withColumn("number", F.count_if(F.col("kind") == BEGINS).over(along))
        parts = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
        joined = crossing.groupBy("file", "number").agg(
            F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.bool_or("first").alias("first")
        )
        found = whole.unionByName(joined.select("record", "first"))
    found = found.where(~F.col("first")) if header else found
    return found.select(F.regexp_replace("record", "\r$", "").alias("record"))
