"""Tables found again in rows of plain text: the window of a page's rows that covers a table's cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEWEST, REACH, SHARE = 6, 18, 0.9
#: Rows of a page in a group.
BLOCK = 1024


def cell_windows(tables: DataFrame, rows: DataFrame, doc: str, table: str, cells: str, page: str, order: str, text: str, box: str, *, fewest: int = FEWEST, reach: int = REACH, share: float = SHARE) -> DataFrame:
    """(doc, table, page, first, last, n_matched, cell_coverage, char_coverage, match_score, box): for each table the best window.

    `tables` has `cells`, an array of texts; `rows` have a page, an order within it, a text, and a box [x0, y0, x1, y1]. A table has `fewest`
    cells or more. A window is up to `reach` rows of one page; each row covers one cell of its text at most, each cell is covered once. Windows
    that cover `share` of the cells and of their characters count; the best has the largest mean of both, less 0.001 for each row and
    1e-8 for each unit of the area around the rows that cover; ties go to the first page, first row and last row. Blank cells and rows,
    rows without page or box, and tables without text are left out; a table id is unique within its document.

    Rows and tables are dealt once, by document, and what follows stays there: `rows` and `tables` that lie so already are not moved again. Rows meet the
    texts of their document's tables; a table of more than reach / share cells can't be covered and is left out. Of the rows that can cover
    something, those that have enough others within `reach` begin a window. Rows of a page go in stretches of BLOCK, with the rows that windows of
    the stretch reach after it, so that no group grows with a page. A best window begins and ends with a row that covers, so no others are needed."""
    n = F.count("*").over(Window.partitionBy(doc, table))
    chars = F.sum(F.length(text)).over(Window.partitionBy(doc, table))
    asked = tables.select(doc, table, F.filter(cells, lambda c: F.trim(c) != "").alias("__cells")).filter((F.size("__cells") >= fewest) & (F.size("__cells") * share - 1e-9 <= reach))
    each = asked.select(doc, table, F.explode("__cells").alias(text)).select(doc, table, text, n.alias("__n"), chars.alias("__chars"))
    limits = each.groupBy(doc, table, "__n", "__chars", text).agg(F.count("*").cast("int").alias("__limit"))
    wanted = limits.groupBy(doc, table, "__n", "__chars").agg(F.map_from_entries(F.collect_list(F.struct(text, "__limit"))).alias("__limits"))
    usable = rows.filter((F.trim(F.col(text)) != "") & F.col(page).isNotNull() & (F.size(box) == 4)).select(doc, page, order, text, box)
    placed = usable.withColumn("__at", F.row_number().over(Window.partitionBy(doc, page).orderBy(order)))
    met = placed.join(wanted, doc).withColumn("__limit", F.col("__limits")[F.col(text)]).filter("__limit IS NOT NULL").drop("__limits")
    # Only pages that have enough rows, and of these the rows that have enough within reach, begin a window.
    least = F.ceil(F.col("__n") * share - 1e-9)
    on_page, ahead = Window.partitionBy(doc, table, page), Window.partitionBy(doc, table, page).orderBy("__at")
    met = met.withColumn("__all", F.count("*").over(on_page)).filter(F.col("__all") >= least)
    met = met.withColumn("__begins", F.col("__all") - F.row_number().over(ahead) + 1 >= least).drop("__all")
    # With a window that begins at or before `__full`, the rows of a text before this one cover all its cells.
    before = F.collect_list("__at").over(Window.partitionBy(doc, table, page, text).orderBy("__at").rowsBetween(1 - reach, -1))
    met = met.withColumn("__same", before).withColumn("__full", F.when(F.size("__same") >= F.col("__limit"), F.element_at("__same", -F.col("__limit")))).drop("__same")
    row = F.struct("__at", F.col(text).alias("t"), "__full", F.col(box).alias("b"), F.col(order).alias("o"), "__begins")
    size = max(BLOCK, reach)
    block, within = F.floor(F.col("__at") / size), F.col("__at") % size
    dealt = met.withColumn("__block", F.explode(F.when((within < reach - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))
    stretch = dealt.groupBy(doc, table, page, "__n", "__chars", "__block").agg(F.sort_array(F.collect_list(row)).alias("__found"))
    starts = F.filter(F.transform("__found", lambda x, i: F.struct(x["__at"].alias("at"), (i + 1).alias("i"), x["__begins"].alias("b"), x["o"].alias("o"))), lambda x: x["b"] & (F.floor(x["at"] / size) == F.col("__block")))
    begun = stretch.withColumn("__start", F.explode(starts)).withColumn("__rows", F.slice("__found", F.col("__start.i"), reach)).drop("__found")
    windows = begun.withColumn("__at", F.col("__start.at")).withColumn(order, F.col("__start.o")).drop("__start", "__block")

    covering = F.filter("__rows", lambda x: (x["__at"] < F.col("__at") + reach) & (x["__full"].isNull() | (x["__full"] < F.col("__at"))))
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.array(*(F.lit(None).cast("double") for _ in range(4))).alias("box"), F.lit(None).cast("struct<score:double,last:long,n:int,chars:int,box:array<double>,end:long>").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        n, chars = acc["n"] + 1, acc["chars"] + F.length(x["t"])
        edge = lambda f, k: f(F.coalesce(acc["box"][k], x["b"][k].cast("double")), x["b"][k].cast("double"))
        around = F.array(edge(F.least, 0), edge(F.least, 1), edge(F.greatest, 2), edge(F.greatest, 3))
        area = F.greatest((edge(F.greatest, 2) - edge(F.least, 0)) * (edge(F.greatest, 3) - edge(F.least, 1)), F.lit(1.0))
        by_cells, by_chars = n / F.col("__n"), chars / F.col("__chars")
        score = F.round((by_cells + by_chars) / 2 - (x["__at"] - F.col("__at") + 1) * 0.001 - area * 1e-8, 9)
        mine = F.struct(score.alias("score"), (-x["__at"]).cast("long").alias("last"), n.alias("n"), chars.alias("chars"), around.alias("box"), x["o"].cast("long").alias("end"))
        good = (by_cells >= share) & (by_chars >= share)
        return F.struct(n.alias("n"), chars.alias("chars"), around.alias("box"), F.when(good & (acc["best"].isNull() | (score > acc["best"]["score"])), mine).otherwise(acc["best"]).alias("best"))

    best = windows.select(doc, table, page, "__at", order, "__n", "__chars", F.aggregate(covering, none, step)["best"].alias("__best")).filter("__best is not null")
    top = best.groupBy(doc, table).agg(F.max_by(F.struct("*"), F.struct("__best.score", (-F.col(page)).alias("p"), (-F.col("__at")).alias("a"))).alias("w"))
    cover, by_chars = F.col("w.__best.n") / F.col("w.__n"), F.col("w.__best.chars") / F.col("w.__chars")
    shown = [F.col(f"w.{page}").alias(page), F.col(f"w.{order}").cast("long").alias("first"), F.col("w.__best.end").alias("last"), F.col("w.__best.n").alias("n_matched"), F.round(cover, 6).alias("cell_coverage"), F.round(by_chars, 6).alias("char_coverage")]
    return top.select(doc, table, *shown, F.round((cover + by_chars) / 2, 4).alias("match_score"), F.col("w.__best.box").alias("box"))
