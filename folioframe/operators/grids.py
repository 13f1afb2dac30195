"""Tables as grids: spans laid out, and paradigm tables rebuilt from two rows of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators.workflow import answer_run, question_run

#: The header of a paradigm table, and where a run of subjects parts.
PARADIGM_HEADER = r"(?is)\baffirmative\b.*\bnegative\b.*\bquestions?\b.*\bshort answers?\b"
SUBJECT_BOUNDARY = r"(?i)(?<=[a-z'’])\s*(?=(?:you|he|she|it|we|they)(?:\b|['’]))"
FEWEST_COLUMNS, FEWEST_ROWS = 4, 3


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def laid_out(cells: DataFrame, table: str, *, row: str = "row", place: str = "place", text: str = "text", rowspan: str = "rowspan", colspan: str = "colspan") -> DataFrame:
    """(table, y, x, text, origin): every square of each table's grid with the cell that covers it.

    Cells come as (table, row, place in the row, text, rowspan, colspan), rows and places from 0. A row's cells take its free squares from the left, each the first place where all
    its columns are free; squares that cells of earlier rows reach down to are not; a span below 1 or null is 1, and none reaches below the last row. `origin` is true where the cell begins.

    One table is one group: its rows are folded in order with, for each column, the row down to which it is taken. Squares are given by the cells themselves, so the
    state is as wide as the table."""
    span = lambda c: F.greatest(F.lit(1), F.coalesce(F.col(c).cast("int"), F.lit(1)))
    cell = F.struct(F.col(place).alias("p"), F.col(text).alias("t"), span(rowspan).alias("h"), span(colspan).alias("w"))
    by_row = cells.groupBy(table, F.col(row).alias("y")).agg(F.array_sort(F.collect_list(cell)).alias("own"))
    whole = by_row.groupBy(table).agg(F.array_sort(F.collect_list(F.struct("y", "own"))).alias("rows"), F.max("y").alias("last"))
    start = F.struct(F.expr("cast(array() as array<int>)").alias("taken"), F.expr("cast(array() as array<struct<y:int,x:int,t:string,h:int,w:int>>)").alias("out"))

    def put(acc: Column, y: Column, c: Column) -> Column:
        """The cell at the first column that is free in row y; columns below it are taken down to the span's end."""
        taken = acc["taken"]
        free = F.filter(F.sequence(F.lit(0), F.size(taken)), lambda k: F.coalesce(F.get(taken, k), F.lit(-1)) < y)
        # Behind all columns taken so far everything is free.
        fits = F.filter(free, lambda k: F.forall(F.sequence(k, k + c["w"] - 1), lambda j: F.coalesce(F.get(taken, j), F.lit(-1)) < y))

        def at_place(at: Column) -> Column:
            width = F.greatest(F.size(taken), at + c["w"])
            now = F.transform(F.sequence(F.lit(0), width - 1), lambda k: F.when(k.between(at, at + c["w"] - 1), y + c["h"] - 1).otherwise(F.coalesce(F.get(taken, k), F.lit(-1))))
            return F.struct(now.alias("taken"), F.array_append(acc["out"], F.struct(y.alias("y"), at.alias("x"), c["t"].alias("t"), c["h"].alias("h"), c["w"].alias("w"))).alias("out"))

        return bound(F.element_at(fits, 1), at_place)

    placed = F.aggregate("rows", start, lambda acc, r: F.aggregate(r["own"], acc, lambda a, c: put(a, r["y"], c)))["out"]
    each = whole.select(F.col(table).alias("__table"), "last", F.explode(placed).alias("c")).select("__table", "last", "c.*")
    down = each.select("__table", "t", F.col("y").alias("y0"), F.col("x").alias("x0"), F.explode(F.sequence("y", F.least(F.col("y") + F.col("h") - 1, "last"))).alias("y"), "w")
    squares = down.select("__table", "t", "y0", "x0", "y", F.explode(F.sequence(F.col("x0"), F.col("x0") + F.col("w") - 1)).alias("x"))
    return squares.select(F.col("__table").alias(table), "y", "x", F.col("t").alias("text"), ((F.col("y") == F.col("y0")) & (F.col("x") == F.col("x0"))).alias("origin"))


def paradigm_parts(cell: Column) -> Column:
    """The lines of a cell, else its questions, short answers or subjects where it holds several; else the cell by itself."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(X.decode_entities(F.coalesce(cell, F.lit(""))), "\r\n|\r", "\n"), r"[ \t\f\x0B]+", " "), r"^\s+|\s+$", "")
    kept = lambda parts: F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def parts_of(said: Column) -> Column:
        several = F.filter(F.array(kept(F.split(said, "\n")), question_run(said), answer_run(said), kept(F.split(said, SUBJECT_BOUNDARY))), lambda parts: F.size(parts) > 1)
        return F.when(said == "", F.array(F.lit(""))).otherwise(F.coalesce(F.get(several, F.lit(0)), F.array(said)))

    return bound(clean, parts_of)


def paradigm_rows(header: Column, body: Column) -> Column:
    """The rows of a paradigm table that came as two rows: its columns' runs side by side, if the header is a paradigm's, both rows have the same
    FEWEST_COLUMNS cells or more, and all columns have the same FEWEST_ROWS parts or more; else null."""
    head = (F.size(header) == F.size(body)) & (F.size(header) >= FEWEST_COLUMNS) & F.rlike(F.array_join(header, " ", ""), F.lit(PARADIGM_HEADER))

    def side_by_side(parts: Column) -> Column:
        least, most = (f(F.transform(parts, F.size)) for f in (F.array_min, F.array_max))
        return F.when((least == most) & (least >= FEWEST_ROWS), F.transform(F.sequence(F.lit(0), most - 1), lambda k: F.transform(parts, lambda p: F.get(p, k))))

    return F.when(head, bound(F.transform(body, paradigm_parts), side_by_side))


def reflowed(cells: DataFrame, table: str) -> DataFrame:
    """(table, y, x, text): the grid of each table, rebuilt where it is a paradigm of two rows. Cells are as for `laid_out`.

    The squares of a table, which `laid_out` makes in one group, are gathered where they are; nothing is made twice or joined."""
    square = F.struct("y", "x", "text")
    whole = laid_out(cells, table).groupBy(table).agg(F.array_sort(F.collect_list(square)).alias("squares"))
    line = lambda y: F.transform(F.filter("squares", lambda s: s["y"] == y), lambda s: s["text"])
    made = F.when(F.array_max(F.transform("squares", lambda s: s["y"])) == 1, paradigm_rows(F.col("header"), F.col("body")))
    two = whole.select(table, "squares", line(0).alias("header"), line(1).alias("body")).select(table, "squares", "header", made.alias("made"))
    cell = lambda y, x, t: F.struct(y.cast("int").alias("y"), x.cast("int").alias("x"), t.alias("text"))
    grid = F.flatten(F.transform(F.concat(F.array("header"), F.col("made")), lambda row, y: F.transform(row, lambda t, x: cell(y, x, t))))
    own = F.transform("squares", lambda s: cell(s["y"], s["x"], s["text"]))
    return two.select(table, F.explode(F.when(F.col("made").isNull(), own).otherwise(grid)).alias("s")).select(table, "s.y", "s.x", "s.text")


def ragged(squares: DataFrame, table: str) -> DataFrame:
    """(table, height, width, n_squares, n_missing, n_empty): the size of each grid, squares that no cell covers, and those without text."""
    sizes = squares.groupBy(table).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("n_squares"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("n_empty"))
    return sizes.withColumn("n_missing", F.col("height") * F.col("width") - F.col("n_squares")).select(table, "height", "width", "n_squares", "n_missing", "n_empty")
