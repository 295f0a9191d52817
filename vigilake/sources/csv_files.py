"""CSV files read by line: delimiter, header and the borders of records are found from all lines.

A quoted cell may hold line breaks, so where a record begins depends on all lines before it. A line is a function of one
bit (does it begin inside a quoted cell?) to one bit (does the next one?): constant, swap or identity. Such functions
are composed in two levels, first over the lines of a split, then over the splits of a file, so a file is never read in one
task; only files that have such cells pay for it. Lines do not move: one small row per split tells how it begins, and a
second pass joins the lines of records where they stand. Only records over the border of a split move between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.functions.text_types import infer_text_type, pick_type, render_type
from vigilake.session import cut_lineage, stash
from vigilake.sources.prefix import stretches

DELIMITERS = (",", ";", "\t", "|")
#: A quoted cell over more lines than this is a stray quote: each line of such a file is a record.
RECORD_LINES = 100_000
VOTES = ("integer", "number", "string")


def _escaped(delimiter: str) -> str:
    return delimiter if delimiter.isalnum() or delimiter == "\t" else "\\" + delimiter


def csv_cells(line: Column, delimiter: str) -> Column:
    """Cells of one CSV record, quotes removed."""
    d = _escaped(delimiter)
    # Possessive, so that a long cell takes no stack.
    cell = f'{d}("[^"]*+(?:""[^"]*+)*+"|[^{d}]*+)'
    cells = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(cell), F.lit(1))
    return F.transform(cells, lambda c: F.when(
        c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def _for_delimiter(delimiter: Column, delimiters: Sequence[str], body: Callable[[str], Column]) -> Column:
    out = F.when(delimiter == delimiters[0], body(delimiters[0]))
    for d in delimiters[1:]:
        out = out.when(delimiter == d, body(d))
    return out


#: What a task reads of a file in one stretch. Two passes over the same lines are dealt over the same tasks.
SPLIT = ["path", "block", "task"]
_SPLIT_SCHEMA = "path string, block long, task int"


def _dealt(lines: DataFrame, *columns: str) -> DataFrame:
    """``path, block, task, n, line, columns``; the lines of a split stand in order, as a reader gives them."""
    return lines.select("path", F.col("line_id.block").alias("block"), F.spark_partition_id().alias("task"), F.col("line_id.n").alias("n"), "line", *columns)


def _split_columns(split: tuple, n: int) -> list[pa.Array]:
    return [pa.repeat(pa.scalar(split[0], pa.string()), n), pa.repeat(pa.scalar(split[1], pa.int64()), n), pa.repeat(pa.scalar(split[2], pa.int32()), n)]


def _split_of(rows: pa.RecordBatch) -> tuple:
    return tuple(rows.column(k)[0].as_py() for k in SPLIT)


def _numbers(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _record_counts(width: int) -> Callable:
    """Counts of delimiters by line to those of records: ``part`` -1 for a whole one, 0 for what precedes a split's first record, 1 for its last record."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(part: int, counts: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), pa.array(counts.ravel()))
            return pa.RecordBatch.from_arrays(
                [*_split_columns(split, len(n)), pa.repeat(pa.scalar(part, pa.int32()), len(n)), lists, pa.array(n)], names=[*SPLIT, "part", "counts", "n"])

        split = None
        for new, rows in stretches(batches, SPLIT):
            if new:
                if split:
                    yield out(part, held[None, :], np.ones(1, dtype=np.int64))
                split, part, held, state = _split_of(rows), 0, np.zeros(width, dtype=np.int64), rows.column("_open")[0].as_py()
            odd = _numbers(rows, "odd")
            upto = np.cumsum(odd) + state
            inside = (upto - odd) % 2 == 1
            state = int(upto[-1] % 2)
            outer, inner = (rows.column(c).flatten().cast(pa.int64()).to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("c0", "c1"))
            counts = np.where(inside[:, None], inner, outer)
            begins = np.flatnonzero(~inside & (_numbers(rows, "blank") == 0))
            held = held + counts[: begins[0] if len(begins) else None].sum(axis=0)
            if len(begins):
                sums = np.add.reduceat(counts, begins, axis=0)
                whole = sums[:-1]
                if part:
                    whole = np.vstack([held[None, :], whole])
                else:
                    yield out(0, held[None, :], np.ones(1, dtype=np.int64))
                if len(whole):
                    shapes, n = np.unique(whole, axis=0, return_counts=True)
                    yield out(-1, shapes, n.astype(np.int64))
                part, held = 1, sums[-1]
        if split:
            yield out(part, held[None, :], np.ones(1, dtype=np.int64))

    return count


def find_delimiters(lines: DataFrame, candidates: Sequence[str] = DELIMITERS) -> DataFrame:
    """``path, delimiter``: the candidate whose number per line, or per record, is the same for most of the file.

    Delimiters inside quotes do not count. Where a line has an odd number of quotes, the lines up to the next such line also
    count as one record. Of equally steady candidates the more frequent one wins, then the earlier one; a file without any is one column wide
    and gets the first.
    """
    names = [f"c{i}" for i in range(len(candidates))]

    def counts(bare: Column) -> list[Column]:
        return [(F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias(c) for d, c in zip(candidates, names, strict=True)]

    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    kept = _dealt(lines).withColumn("odd", (quotes % 2).cast("int"))
    by_line = kept.where(F.trim("line") != "").select("path", *counts(F.regexp_replace("line", '"[^"]*+"', "")))
    sums = kept.groupBy(*SPLIT).agg(F.sum("odd").alias("_sum"))
    before = Window.partitionBy("path").orderBy(*SPLIT[1:]).rowsBetween(Window.unboundedPreceding, -1)
    # One small row per split of the files with such lines, as the reader's own list of splits has it.
    begun = sums.withColumn("_open", (F.coalesce(F.sum("_sum").over(before), F.lit(0)) % 2).cast("int")).withColumn(
        "_any", F.max("_sum").over(Window.partitionBy("path"))).where("_any > 0").select(*SPLIT, "_open")
    both = [F.array(*[c.cast("int") for c in counts(F.regexp_replace(text, '"[^"]*+(?:"|$)', ""))]).alias(f"c{i}") for i, text in enumerate((F.col("line"), F.concat(F.lit('"'), "line")))]
    told = kept.select(*SPLIT, "odd", (F.trim("line") == "").alias("blank"), *both).join(F.broadcast(begun), SPLIT)
    found = told.mapInArrow(_record_counts(len(names)), f"{_SPLIT_SCHEMA}, part int, counts array<long>, n long")
    shape = [F.col("counts")[i].cast("int").alias(c) for i, c in enumerate(names)]
    # Of a split, the lines before its first record belong to the last one of an earlier split.
    upto = Window.partitionBy("path").orderBy(*SPLIT[1:], "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = found.where("part >= 0").withColumn("record", F.sum("part").over(upto)).where("record > 0")
    cut = over.groupBy("path", "record").agg(*[F.sum(F.col("counts")[i]).cast("int").alias(c) for i, c in enumerate(names)])
    by_record = found.where("part < 0").select("path", *shape, "n").unionByName(cut.select("path", *names, F.lit(1).cast("long").alias("n")))
    shapes = by_line.withColumns({"n": F.lit(1).cast("long"), "way": F.lit(0)}).unionByName(by_record.withColumn("way", F.lit(1))).groupBy(
        "path", "way", *names).agg(F.sum("n").alias("n"))
    each = shapes.select("path", "way", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("cells")) for i, c in enumerate(names)])).alias("c"))
    steady = each.groupBy("path", "way", "c.i", "c.cells").agg(F.sum("n").alias("n")).groupBy("path", "way", "i").agg(
        F.sum("n").alias("_all"), F.max(F.struct(F.when(F.col("cells") > 0, F.col("n")).otherwise(0).alias("n"), "cells")).alias("_top"))
    best = steady.groupBy("path").agg(F.max(F.struct(
        (F.col("_top.n") / F.col("_all")).alias("share"), F.when(F.col("_top.n") > 0, F.col("_top.cells")).otherwise(0).alias("cells"), (-F.col("i")).alias("i"))).alias("_b"))
    return best.select("path", F.element_at(F.array(*[F.lit(d) for d in candidates]), 1 - F.col("_b.i")).alias("delimiter"))


def _stays_open(line: Column, delimiter: str) -> Column:
    """Whether a record that begins with this line goes on after it: a quoted cell has not ended."""
    d = _escaped(delimiter)
    whole = F.regexp_replace(line, f'(^|{d})"[^"]*+(?:""[^"]*+)*+"', "$1x")
    return whole.rlike(f'(^|{d})"')


def _states_before(closed: np.ndarray, opened: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The state before each line, and behind the last, if the first begins with ``start``.

    ``closed`` and ``opened``: the state behind each line if it begins closed, or open. A state is that of the last line
    that fixes it, turned by every swap since.
    """
    at = np.arange(len(closed))
    swaps = np.cumsum((closed == 1) & (opened == 0))
    last = np.maximum.accumulate(np.where(closed == opened, at, -1))
    fixed = np.where(last >= 0, closed[last], start)
    after = (fixed + swaps - np.where(last >= 0, swaps[last], 0)) % 2
    return np.concatenate([[start], after[:-1]]), int(after[-1])


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split, for both cases: state behind it, lines before its first record, records, lines of its last and of its longest."""
    names = [f"{c}{p}" for p in (0, 1) for c in ("after", "head", "records", "tail", "most")]

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*_split_columns(split, 1), *[pa.array([facts[c]], pa.int64()) for c in names]], names=[*SPLIT, *names])

    split = None
    for new, rows in stretches(batches, SPLIT):
        if new:
            if split:
                yield out()
            split, facts = _split_of(rows), dict.fromkeys(names, 0) | {"after1": 1}
        closed, opened = _numbers(rows, "s"), _numbers(rows, "q")
        for p in (0, 1):
            before, facts[f"after{p}"] = _states_before(closed, opened, facts[f"after{p}"])
            begins = np.flatnonzero(before == 0)
            first = int(begins[0]) if len(begins) else len(closed)
            facts[f"tail{p}" if facts[f"records{p}"] else f"head{p}"] += first
            if len(begins):
                sizes = np.diff([*begins, len(closed)])
                facts[f"most{p}"] = max(facts[f"most{p}"], facts[f"tail{p}"], int(sizes.max()))
                facts[f"records{p}"] += len(begins)
                facts[f"tail{p}"] = int(sizes[-1])
            facts[f"most{p}"] = max(facts[f"most{p}"], facts[f"tail{p}"])
    if split:
        yield out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the state before their split (``_open``) to records; ``part`` as in ``_record_counts``. A stray file's lines are records."""

    def out(part: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [*_split_columns(split, n), pa.array(ids, pa.int64()), pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(delimiter, pa.string()), n), pa.array(texts, pa.binary())],
            names=[*SPLIT, "n", "part", "delimiter", "line"])

    split, held = None, []
    for new, rows in stretches(batches, SPLIT):
        if new:
            if held:
                yield out(part, [begun], [b"\n".join(held)])
            split, part, held, state = _split_of(rows), 0, [], rows.column("_open")[0].as_py()
            delimiter, stray, begun = rows.column("delimiter")[0].as_py(), rows.column("_stray")[0].as_py(), rows.column("n")[0].as_py()
        ids, texts = rows.column("n").to_pylist(), rows.column("line").to_pylist()
        if stray:
            yield out(-1, ids, texts)
            continue
        before, state = _states_before(_numbers(rows, "s"), _numbers(rows, "q"), state)
        begins = np.flatnonzero(before == 0).tolist()
        held += texts[: begins[0] if begins else None]
        if begins:
            if held and not part:
                yield out(0, [begun], [b"\n".join(held)])
            elif held:
                yield out(-1, [begun], [b"\n".join(held)])
            if len(begins) > 1:
                yield out(-1, [ids[a] for a in begins[:-1]], [b"\n".join(texts[a:b]) for a, b in zip(begins, begins[1:], strict=False)])
            part, begun, held = 1, ids[begins[-1]], texts[begins[-1]:]
    if held:
        yield out(part, [begun], [b"\n".join(held)])


def _record_states(marked: DataFrame, record_lines: int) -> DataFrame:
    """``path, block, task, _open, _stray``: whether a split begins inside a record, and whether its file has one of too many lines."""
    spans = marked.select(*SPLIT, "s", "q").mapInArrow(_spans, _SPLIT_SCHEMA + "".join(f", {c}{p} long" for p in (0, 1) for c in ("after", "head", "records", "tail", "most")))
    order = Window.partitionBy("path").orderBy(*SPLIT[1:])
    upto, before = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, -1))
    # The state behind a split, as for lines: that of the last split that fixes it, turned by every swap since.
    swap = ((F.col("after0") == 1) & (F.col("after1") == 0)).cast("int")
    fixed = F.when(F.col("after0") == F.col("after1"), F.struct(F.col("after0").alias("v"), F.col("_swaps").alias("k")))
    states = spans.withColumn("_swaps", F.sum(swap).over(upto)).withColumn("_last", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "_open", ((F.coalesce(F.col("_last.v"), F.lit(0)) + F.col("_swaps") - swap - F.coalesce(F.col("_last.k"), F.lit(0))) % 2).cast("int"))
    mine = [F.when(F.col("_open") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(c) for c in ("head", "records", "tail", "most")]
    states = states.select(*SPLIT, "_open", *mine).withColumn("_run", F.sum(F.when(F.col("records") > 0, 1).otherwise(0)).over(upto))
    # A record over several splits: the last lines of the one it begins in, and all before the next record.
    opened = F.when(F.col("records") > 0, F.col("_run") - 1).otherwise(F.col("_run"))
    pieces = states.select("path", "most", F.explode(F.array(F.struct(opened.alias("run"), F.col("head").alias("n")), F.struct(F.col("_run").alias("run"), F.col("tail").alias("n")))).alias("x"))
    stray = pieces.groupBy("path", "x.run").agg(F.sum("x.n").alias("n"), F.max("most").alias("most")).groupBy("path").agg(
        (F.greatest(F.max("n"), F.max("most")) > record_lines).alias("_stray"))
    return states.join(stray, "path").select(*SPLIT, "_open", "_stray")


def csv_records(lines: DataFrame, delimiters: DataFrame | str, known: Sequence[str] = DELIMITERS, record_lines: int = RECORD_LINES) -> DataFrame:
    """``path, delimiter, line_id, line``: records of CSV files; ``line_id`` is that of the first line.

    ``lines``: ``path, line_id (block, n), line`` with lines of a file in the order of ``line_id``, those of a split together and in order, as a reader
    gives them. ``delimiters``: one for all files, or ``path, delimiter``. Blank lines outside of records are left out.
    """
    rows = _dealt(lines)
    # One small row per file or split, as the reader's own lists have it: lines need not move for these joins.
    rows = rows.withColumn("delimiter", F.lit(delimiters)) if isinstance(delimiters, str) else rows.join(F.broadcast(cut_lineage(delimiters)), "path")
    quoted = F.contains("line", F.lit('"'))
    opens = lambda text: _for_delimiter(F.col("delimiter"), known, lambda d: _stays_open(text, d))
    starts_open = quoted & opens(F.col("line"))
    several = cut_lineage(rows.where(starts_open).select("path").distinct())
    single = rows.join(F.broadcast(several), "path", "left_anti").select(*SPLIT, "n", F.lit(-1).alias("part"), "delimiter", "line")
    marked = rows.join(F.broadcast(several), "path", "left_semi").select(
        *SPLIT, "n", "delimiter", F.col("line").cast("binary").alias("line"), starts_open.cast("int").alias("s"), (~quoted | opens(F.concat(F.lit('"'), F.col("line")))).cast("int").alias("q"))
    states = cut_lineage(_record_states(marked, record_lines))
    long = marked.join(F.broadcast(states), SPLIT).mapInArrow(_joined, f"{_SPLIT_SCHEMA}, n long, part int, delimiter string, line binary")
    kept = stash(single.unionByName(long.withColumn("line", F.col("line").cast("string"))), "records")
    upto = Window.partitionBy("path").orderBy("block", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = kept.where("part >= 0").withColumn("_run", F.sum("part").over(upto))
    joined = over.groupBy("path", "delimiter", "_run").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("_lines")).select(
        "path", "delimiter", F.struct(F.col("_lines")[0]["block"].alias("block"), F.col("_lines")[0]["n"].alias("n")).alias("line_id"),
        F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("line"))
    whole = kept.where("part < 0").select("path", "delimiter", F.struct("block", "n").alias("line_id"), "line")
    return whole.unionByName(joined).where(F.trim("line") != "")


def csv_columns(records: DataFrame, header: bool | None = True, known: Sequence[str] = DELIMITERS) -> tuple[DataFrame, DataFrame]:
    """``path, name, type`` of the columns, and ``path, delimiter, has_header, num_rows`` of the files.

    The first record names the columns; cells beyond it are ignored, and of columns with one name the last stands for it.
    With ``header=None`` it has to look like names: a column whose other cells are all numbers, or all of one length, speaks
    for a header if the first cell is none or has another, else against it; one without other cells speaks for it. A file without a header has no columns.
    """
    cells = records.select("path", "delimiter", F.col("line_id.block").alias("block"), F.col("line_id.n").alias("n"), F.posexplode(
        _for_delimiter(F.col("delimiter"), known, lambda d: csv_cells(F.regexp_replace("line", "\r$", ""), d))).alias("at", "cell"))
    # Classified in a projection of its own, so each cell is looked at once.
    kinds = cells.select("path", "delimiter", "block", "n", "at", infer_text_type(F.col("cell")).alias("kind"), F.length("cell").cast("bigint").alias("size"))
    lengths = [] if header is not None else [
        F.count_if(F.col("size") > 0).alias("_n"), F.sum("size").alias("_sum"), F.sum((F.col("size") * F.col("size")).cast("decimal(20,0)")).alias("_squares")]
    # Numbers alone, so that each task sums up what it reads without sorting texts.
    firsts = cut_lineage(cells.where("at = 0").groupBy("path", "block").agg(F.min("n").alias("n")).groupBy("path").agg(F.min(F.struct("block", "n")).alias("_f")).select("path", "_f.*"))
    tallied = kinds.groupBy("path", "delimiter", "at").agg(F.count("*").alias("_records"), *[F.count_if(F.col("kind") == v).alias(v) for v in VOTES], *lengths)
    names = cells.join(F.broadcast(firsts), ["path", "block", "n"]).select("path", "at", F.col("cell").alias("name"))
    # One row per column of a file: a file's header is its earliest record. The header's own cell is taken off the tally again.
    own = infer_text_type(F.col("name"))
    less = {v: F.col(v) - F.when(own == v, 1).otherwise(0) for v in VOTES}
    named = tallied.join(names, ["path", "at"])
    if header is None:
        size = F.length("name").cast("bigint")
        n, total = F.col("_n") - (size > 0).cast("int"), F.col("_sum") - size
        wide = lambda c: c.cast("decimal(19,0)")
        equal = wide(n) * wide(F.col("_squares") - size * size) == wide(total) * wide(total)
        vote = (
            F.when(n == 0, 1)
            .when(less["string"] == 0, F.when(own.isin("integer", "number"), -1).otherwise(1))
            .when(equal, F.when(size * n == total, -1).otherwise(1))
            .otherwise(0))
        named = named.withColumn("_looks", F.sum(vote).over(Window.partitionBy("path")) > 0)
    else:
        named = named.withColumn("_looks", F.lit(header))
    files = named.groupBy("path", "delimiter").agg(F.bool_or("_looks").alias("has_header"), F.max(F.when(F.col("at") == 0, F.col("_records"))).alias("_all")).select(
        "path", "delimiter", "has_header", (F.col("_all") - F.col("has_header").cast("int")).alias("num_rows"))
    typed = named.where("_looks and name != ''").select("path", "at", "name", render_type(pick_type(*[less[v] for v in VOTES])).alias("type"))
    return typed.groupBy("path", "name").agg(F.max_by("type", "at").alias("type")), files
