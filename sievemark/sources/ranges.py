"""Records that span lines, found in byte ranges read in parallel.

Spark's text source hands out a file in ranges, cut into pieces at a separator (line breaks for CSV, closing braces for
JSON).  Whether a piece stands inside a quoted cell or a string, and how deep it is nested, depends on all that comes before
it; but what a whole range does to each possible state is known from the range alone.  So one scan finds every range's
effect, running sums over the ranges of each file (one row a range) give the state each range begins in, and a second scan
cuts the ranges into records, every range by itself.  A record that reaches over ranges is put together from its parts,
at most two a range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.local import shared_folder, stored

PLACE = "file string, block long"
#: States of at most so many ranges are broadcast.
FEW_RANGES = 500_000
#: Bytes of ranges that a task takes at least, once every core has tasks enough.
BYTES_A_TASK = 128 << 20
TASKS_A_CORE = 4


def dealt(frame: DataFrame) -> DataFrame:
    """A frame whose tasks take several ranges each where ranges are small and many; the ranges stay as they are."""
    spark, ranges = frame.sparkSession, frame.rdd.getNumPartitions()
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower()).groups()
    most = int(number) << 10 * " kmgtp".index(unit or " ")
    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, -(-ranges * most // BYTES_A_TASK))
    return frame.coalesce(tasks) if tasks < ranges else frame


def pieces_of(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, block, line, size, piece): a file's bytes between separators, in the order of (block, line)."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", separator).text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"),
        meta["file_size"].alias("size"), F.col("value").cast("binary").alias("piece"))


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Rows one after the other that are alike in some columns."""
    for batch in batches:
        new = np.zeros(max(batch.num_rows - 1, 0), bool)
        for c in columns:
            new |= pc.not_equal(batch[c][1:], batch[c][:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(start, end - start) for start, end in zip(cuts, cuts[1:]) if end > start)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of rows of one range."""
    for rows in _runs(batches, "file", "block"):
        yield (rows["file"][0].as_py(), rows["block"][0].as_py()), rows


def _packed(*columns: str) -> Column:
    """A range's figures and file as one text: every further column costs Python about as much as the pieces do."""
    return F.concat_ws(" ", *columns, "file").alias("place")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, pa.RecordBatch]]:
    """Runs of rows of one range, packed with its block and another figure."""
    for rows in _runs(batches, "place"):
        block, figure, file = rows["place"][0].as_py().split(" ", 2)
        yield (file, int(block)), int(figure), rows


def _durable(frame: DataFrame) -> DataFrame:
    """One row a range: written to the shared folder, so that every use sees the same."""
    path = shared_folder(frame.sparkSession, "ranges")
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


CUT = f"{PLACE}, line long, begins boolean, first boolean, broken boolean, complete boolean, record binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_(), pa.binary()]
    names = ["file", "block", "line", "begins", "first", "broken", "complete", "record"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _records(pieces: DataFrame, states: DataFrame, cutter, *columns: str) -> DataFrame:
    """(first, broken, record): records inside a range, and those put together from the parts that ranges hold of them.

    The cutter is given ``columns`` only.
    The states are one row a range and broadcast, so every range is cut where it is read and in its order; beyond FEW_RANGES
    Spark chooses the join and the pieces are put in order again.  The ranges are cut once and what is found is kept in
    Parquet, however often the records are read.
    """
    if states.count() <= FEW_RANGES:
        placed = pieces.drop("size").join(F.broadcast(states), ["file", "block"])
    else:
        placed = pieces.drop("size").join(states, ["file", "block"]).sortWithinPartitions("file", "block", "line")
    found = stored(placed.select(*columns).mapInArrow(cutter, CUT))
    order = Window.partitionBy("file").orderBy("block", "line")
    parts = dealt(found).where("NOT complete").withColumn("number", F.sum(F.col("begins").cast("long")).over(order))
    parts = parts.groupBy("file", "number").agg(
        F.bool_or("first").alias("first"), F.first("broken").alias("broken"), F.sort_array(F.collect_list(F.struct("block", "line", "record"))).alias("p"))
    glue = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["record"]))
    parts = stored(parts.select("first", "broken", glue.alias("record")))
    return found.where("complete").select("first", "broken", "record").unionByName(parts)


# ---- CSV --------------------------------------------------------------------------
#: What a line does, begun outside quotes: whole cells, then perhaps a quoted cell that doesn't end.  Quotes count at a cell's start only.
CELLS = rb'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+'
OPEN_CELL = re.compile(CELLS + rb'"[^"]*+(?:""[^"]*+)*+\Z')
#: Begun inside quotes: the rest of the quoted cell and what follows its end up to the next cell.
REST_OF_CELL = re.compile(rb'[^"]*+(?:""[^"]*+)*+"[^,]*+,?')
UNENDED = re.compile(rb'[^"]*+(?:""[^"]*+)*+\Z')


def inside_after(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open at a line's end."""
    if b'"' not in line:
        return inside
    if inside:
        if UNENDED.match(line):
            return True
        end = REST_OF_CELL.match(line).end()
        if end == len(line) and not line.endswith(b","):
            return False
        line = line[end:]
    return OPEN_CELL.match(line) is not None


def _csv_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a stretch: the state after it for both states before, and whether it is UTF-8."""
    for (file, block), rows in _stretches(batches):
        out, inside, broken = False, True, False
        for line in rows["piece"].to_pylist():
            if b'"' in line:
                out, inside = inside_after(line, out), inside_after(line, inside)
            if not broken and not line.isascii():
                try:
                    line.decode()
                except UnicodeDecodeError:
                    broken = True
        yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "line": [rows["line"][0].as_py()], "out": [out], "inside": [inside], "broken": [broken]})


def _csv_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of every range."""
    key, held, whole, inside, at_start, broken, made = None, [], True, False, False, False, []

    def ended(done: bool) -> list[tuple]:
        """What is held; a part keeps the line break at its end."""
        if not held:
            return []
        text = b"\n".join(x for _, x in held)
        if whole and done and not text.strip():
            return []
        return [(*key, held[0][0], whole, whole and at_start, broken, whole and done, text if done else text + b"\n")]

    for place, rows in _stretches(batches):
        if place != key:
            made += ended(False)
            key, held = place, []
            inside, broken = rows["started"][0].as_py(), rows["broken"][0].as_py()
            whole, at_start = not inside, place[1] == 0
        for number, line in zip(rows["line"].to_pylist(), rows["piece"].to_pylist()):
            held.append((number, line))
            inside = inside_after(line, inside)
            if not inside:
                made += ended(True)
                at_start = at_start and not b"".join(x for _, x in held).strip()
                held, whole = [], True
        if len(made) >= 1000:
            yield _sent(made)
            made = []
    made += ended(False)
    if made:
        yield _sent(made)


def csv_records(spark: SparkSession, path: str, quotes: bool = True) -> DataFrame:
    """(first, broken, record): the records of CSV files as bytes, without the line break at their end.

    ``first`` marks each file's first record, ``broken`` files that aren't UTF-8.  Blank records are left out.  Lines end
    at line feeds; a carriage return before one stays in the record, inside a cell as part of it.
    """
    lines = pieces_of(spark, path, "\n")
    found = lines.drop("size").mapInArrow(_csv_effects, f"{PLACE}, line long, out boolean, inside boolean, broken boolean")
    if not quotes:
        found = found.withColumns({"out": F.lit(False), "inside": F.lit(False)})
    # a range's effect: a fixed state after it, or the state before, kept or turned
    fixed = F.col("out") == F.col("inside")
    order = Window.partitionBy("file").orderBy("block", "line")
    turned = F.sum((~fixed & F.col("out")).cast("long")).over(order)
    effects = _durable(found).withColumn("turned", turned)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(fixed, F.struct("out", "turned")), ignorenulls=True).over(before)
    effects = effects.withColumns({"last": last, "so_far": F.lag("turned", 1, 0).over(order)})
    odd = (F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    started = F.coalesce(F.col("last.out"), F.lit(False)) != odd
    states = effects.withColumns({"started": started, "broken": F.max("broken").over(Window.partitionBy("file"))})
    # a range that reached Python in several batches is several stretches: the first tells its state
    states = states.groupBy("file", "block").agg(F.min_by("started", "line").alias("started"), F.first("broken").alias("broken"))
    return _records(lines, _durable(states), _csv_cut, "file", "block", "line", "piece", "started", "broken")


def decoded(record: Column, broken: Column, encoding: str | None, fallback: str) -> Column:
    """Text of a record: by ``encoding``, else UTF-8, else, in files that aren't, ``fallback``."""
    text = F.decode(record, encoding) if encoding else F.when(broken, F.decode(record, fallback)).otherwise(record.cast("string"))
    return F.regexp_replace(text, r"\r$", "")


# ---- JSON -------------------------------------------------------------------------
#: What may stand between the values of a file.
BETWEEN = re.compile(rb"(?:\xef\xbb\xbf)?[\s,\[\]]*+")
QUOTE, BACKSLASH, CLOSED, BREAK, BLANK, MARK = b'"\\}\n \xef'
#: By byte: whether it counts, what it adds to the nesting, whether it may stand between values, what it becomes in a record.
COUNTS = np.isin(np.arange(256), [*b'"\\{}[]'])
ADDS = np.zeros(256, np.int64)
ADDS[[*b"{["]], ADDS[[*b"}]"]] = 1, -1
LOOSE = np.isin(np.arange(256), [*b" \t\n\r\f\v,[]"])
IN_A_LINE = np.arange(256, dtype=np.uint8)
IN_A_LINE[[*b"\r\n"]] = BLANK
#: What a piece is given at its end: the brace that ended it, and room for a line break.
END = b"}\n"
#: Steps over signs between values that all values of a batch take together; bytes of records that a row holds.
STEPS, BYTES_A_ROW = 16, 1 << 20


def _text_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, one after the other, and where each one ends."""
    pieces = rows["piece"]
    _, offsets, data = pieces.buffers()
    wide = np.int64 if pa.types.is_large_binary(pieces.type) else np.int32
    ends = np.frombuffer(offsets, wide)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends[1:] - ends[0]


def _counted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signs, turned, adds): quotes, brackets and braces, whether an odd number of quotes stands before or at each, what it adds.

    Escaped signs are left out whatever the state, so that every other quote turns the state in both cases.  A brace that
    ended a piece always counts.
    """
    at = np.flatnonzero(COUNTS[text])
    signs = text[at]
    slashes = at[signs == BACKSLASH]
    if slashes.size:
        number = np.arange(slashes.size)
        first = np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, number, 0))
        hidden = np.zeros(text.size + 1, bool)
        hidden[slashes[(number - first) % 2 == 0] + 1] = True
        signs = signs[(signs == CLOSED) | ~hidden[at] & (signs != BACKSLASH)]
    return signs, np.cumsum(signs == QUOTE) % 2 == 1, ADDS[signs]


def nested(piece: bytes, inside: bool) -> tuple[bool, int]:
    """Whether a string is open after a piece and the closing brace that ended it, and by how much the nesting grew."""
    _, turned, adds = _counted(np.frombuffer(piece + END, np.uint8))
    return bool(turned[-1] != inside), int(adds[turned == inside].sum())


def _json_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for number, ((file, block), whole, rows) in enumerate(_unpacked(batches)):
        text, ends = _text_of(rows)
        _, turned, adds = _counted(text)
        grown, odd = int(adds[~turned].sum()), bool(turned[-1])
        pieces = (text[start:end - len(END)].tobytes() for start, end in zip(np.append(0, ends), ends))
        filled = next((p.lstrip(b"\xef\xbb\xbf \t\r\n") for p in pieces if p.strip()), b"")
        yield pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([block], pa.int64()), pa.array([number], pa.int64()), pa.array([whole], pa.int64()), pa.array([text.size - ends.size], pa.int64()),
             pa.array([filled.startswith(b"[")]), pa.array([odd]), pa.array([not odd]), pa.array([grown], pa.int64()), pa.array([int(adds.sum()) - grown], pa.int64())],
            names=["file", "block", "line", "size", "bytes", "array", "out", "inside", "grown_out", "grown_inside"])


def _values(text: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where values start that stand at or after ``begins``; the brace that ends a piece is a value too."""
    at, left = begins.copy(), np.arange(begins.size)
    for _ in range(STEPS):
        left = left[LOOSE[text[at[left]]]]
        at[left] += 1
    for k in np.flatnonzero((text[at] == MARK) | LOOSE[text[at]]).tolist():
        at[k] = BETWEEN.match(text, begins[k]).end()
    return at


def _json_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and parts of records of every range; a row holds many records, a line each.

    Of a stretch's two parts at most, the one at its end has the higher number.
    """
    key, held, whole, inside, depth, at, made, size = None, [], True, False, 0, 0, [], 0

    def ended(done: bool) -> list[tuple]:
        return [(*key, at, whole, False, False, whole and done, b"".join(held))] if held else []

    for number, (place, state, rows) in enumerate(_unpacked(batches)):
        if place != key:
            made += ended(False)
            key, held = place, []
            inside, depth = state % 2 == 1, state >> 1
            whole = not inside and depth <= 0
        text, ends = _text_of(rows)
        signs, turned, adds = _counted(text)
        braces, outside = signs == CLOSED, turned == inside
        deep = depth + np.cumsum(np.where(outside, adds, 0))
        closed = np.flatnonzero(outside[braces] & (deep[braces] <= 0))
        inside, depth = bool(turned[-1] != inside), int(deep[-1])
        # stretches of pieces up to each end of a value, and the pieces left over
        stops = ends[closed]
        begins = np.concatenate([[0], stops]) if not closed.size or stops[-1] < ends[-1] else np.concatenate([[0], stops[:-1]])
        starts = _values(text, begins)
        if held or not whole:
            starts[0] = 0
        nothing = starts[:stops.size] == stops - len(END)
        nothing[:1] &= not held and whole
        starts[:stops.size][nothing] = stops[nothing]
        text, keep = IN_A_LINE[text], np.ones(text.size, bool)
        keep[ends - 1] = False
        text[stops - 1], keep[stops - 1] = BREAK, True
        gaps = starts - begins
        keep[np.arange(gaps.sum()) + np.repeat(begins - np.cumsum(gaps) + gaps, gaps)] = False
        done = 0
        if closed.size and (held or not whole):
            at = at if held else 2 * number
            done = int(stops[0])
            held.append(text[:done - 1][keep[:done - 1]].tobytes())
            made += ended(True)
            size, held = size + sum(map(len, held)), []
        if closed.size:
            whole, last = True, int(stops[-1])
            lines = text[done:last][keep[done:last]].tobytes()
            size, start = size + len(lines), 0
            while start < len(lines):
                end = lines.find(b"\n", min(start + BYTES_A_ROW, len(lines) - 1))
                made.append((*key, 0, True, False, False, True, lines[start:end]))
                start = end + 1
            done = last
        if done < text.size:
            at = at if held else 2 * number + 1
            held.append(text[done:][keep[done:]].tobytes())
        if len(made) >= 1000 or size >= 16 * BYTES_A_ROW:
            yield _sent(made)
            made, size = [], 0
    made += ended(False)
    if made:
        yield _sent(made)


def json_records(spark: SparkSession, path: str) -> str:
    """Folder of JSON Lines with the objects of arrays, of single objects and of values one after the other.

    Line breaks between an object's parts become spaces.  A file that ends inside a value is an error.  The files written
    can't be cut into ranges, so that small ranges of the input don't make as many tasks of every later read.
    """
    pieces = dealt(pieces_of(spark, path, "}")).withColumn("piece", F.concat("piece", F.lit(END)))
    effect = f"{PLACE}, line long, size long, bytes long, array boolean, out boolean, inside boolean, grown_out long, grown_inside long"
    effects = _durable(pieces.select("piece", _packed("block", "size")).mapInArrow(_json_effects, effect))
    order = Window.partitionBy("file").orderBy("block", "line")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # quotes turn the state or keep it, whatever it was: a backslash hides the next sign in both
    effects = effects.withColumn("started", F.coalesce(F.sum(F.col("out").cast("long")).over(before), F.lit(0)) % 2 == 1)
    effects = effects.withColumn("grown", F.when(F.col("started"), F.col("grown_inside")).otherwise(F.col("grown_out")))
    effects = effects.withColumn("depth", F.coalesce(F.sum("grown").over(before), F.lit(0)))
    effects = effects.withColumn("base", F.first(F.col("array").cast("long")).over(order))
    file = effects.groupBy("file").agg(F.sum("grown").alias("end"), (F.sum(F.col("out").cast("long")) % 2 == 1).alias("open"), F.sum("bytes").alias("read"), F.first("size").alias("size"))
    # a last piece that no brace ended has been counted as if one had; a byte order mark isn't read, a compressed file's size tells nothing
    extra = F.when((F.col("read") - F.col("size")).isin(1, -2), -1).when((F.col("read") - F.col("size")).isin(0, -3), 0)
    bad = file.where(F.col("open") | F.coalesce(F.col("end") != extra, ~F.col("end").isin(-1, 0))).agg(F.min("file"), F.count(F.lit(1))).first()
    if bad[1]:
        raise ValueError(f"{bad[1]} files end inside a JSON value, {bad[0]} for one")
    state = 2 * (F.col("depth") - F.col("base")) + F.col("started").cast("long")
    states = effects.groupBy("file", "block").agg(F.min_by(state, "line").alias("state"))
    states = _durable(states.select("file", "block", _packed("block", "state")))
    whole = _records(pieces, states, _json_cut, "piece", "place")
    folder = shared_folder(spark, "records")
    dealt(whole.select(F.col("record").cast("string").alias("value"))).write.option("compression", "snappy").text(folder)
    return folder
