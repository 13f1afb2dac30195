"""Groups of workbook exercises that a state machine would open, simulated under two policies over the standard block table.

A block either sets a state (the open group, the open question) to a value or to nothing, or leaves it. Such steps compose: of two
ranges of blocks the later one that sets a state wins. So `carried` folds ranges of a document side by side, sums each up by the last
setting in it, and hands that on to the ranges after it; no window holds more than one range, however long the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.sources.sinks import stored

#: Labels and beginnings of lines that open a virtual group, and types that close it.
SECTION_LABELS = ("assessment practice", "do you know how?", "do you understand?", "practice", "practice & problem solving", "leveled practice", "reflect", "act 1", "act 2", "act 3", "sequel")
INSTRUCTION_START = (
    r"(?i)^(?:Choose|Complete|Write|Look|Read|Find|Correct|Fill|Circle|Answer|Ask|Tell|Work|Determine|Classify|Evaluate|Simplify|Solve|Graph|Use|Draw|Estimate|Compare|Order|"
    r"Match|Name|Identify|Explain|Describe|Select|Calculate|Convert|Round|Model|Represent|Make|Copy|Connect|Decide|Show)\b"
)
HARD_RESETS = ("unit_opener", "section", "reading_passage")
COLON_MOST, LONG_PARAGRAPH = 120, 180
RANGE = 100_000


def carried(rows: DataFrame, doc: str, order: str, states: dict[str, Column], *, size: int = RANGE) -> DataFrame:
    """`rows` with each state as the last row at or before it in its document left it; `order` is a whole number that no two rows of a document share.

    A state is struct<v> where a row sets it (v null: to nothing) and null where it leaves it. Ranges are of `size` orders. Rows are
    made once and written to the shared folder, as they are read for the sums and for themselves."""
    keyed = stored(rows.select("*", F.floor(F.col(order) / size).alias("__range"), *(c.alias(f"__set_{n}") for n, c in states.items())))
    within = Window.partitionBy(doc, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = keyed.groupBy(doc, "__range").agg(*(F.max(F.when(F.col(f"__set_{n}").isNotNull(), F.struct(F.col(order).alias("o"), F.col(f"__set_{n}").alias("s")))).alias(f"__sum_{n}") for n in states))
    before = Window.partitionBy(doc).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    handed = sums.select(F.col(doc).alias("__doc"), F.col("__range").alias("__r"), *(F.last(f"__sum_{n}", ignorenulls=True).over(before).getField("s").alias(f"__from_{n}") for n in states))
    own = keyed.select("*", *(F.last(f"__set_{n}", ignorenulls=True).over(within).alias(f"__own_{n}") for n in states))
    out = own.join(handed, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__range") == F.col("__r")))
    return out.select(*rows.columns, *(F.coalesce(f"__own_{n}", f"__from_{n}").getField("v").alias(n) for n in states))


def starter(text: Column) -> Column:
    """What makes a block open a virtual group, null if nothing does."""
    return X.ladder((F.lower(F.trim(text, F.lit("* "))).isin(*SECTION_LABELS), "section_label"), (X.matches(text, INSTRUCTION_START), "instruction_paragraph"), (F.endswith(text, F.lit(":")) & (F.length(text) <= COLON_MOST), "colon_label"), default=None)


def simulate(blocks: DataFrame, doc: str, *, order: str, id_: str, type_: str, markdown: str, gap: str, size: int = RANGE) -> DataFrame:
    """`blocks` with starter, step, and for both policies the open group and question at each block and whether a gap there is covered.

    `gap` tells of blocks that nothing groups yet (a question, or a table that asks). Persistent: a group stays open until a unit, section or passage, or
    the next starter. Guarded: a long paragraph that is no instruction ends it too, and a table needs an open question. `step` is reset, starter, long, or null."""
    text, kind, id_c = X.whitespace(F.coalesce(markdown, F.lit(""))), F.col(type_), F.col(id_)
    rows = blocks.withColumn("starter", F.when(~kind.isin(*HARD_RESETS), starter(text)))
    long = (kind == "paragraph") & (F.length(text) > LONG_PARAGRAPH)  # an instruction is a starter
    rows = rows.withColumn("step", X.ladder((kind.isin(*HARD_RESETS), "reset"), (F.col("starter").isNotNull(), "starter"), (long, "long"), default=None))
    step, none, me = F.col("step"), F.struct(F.lit(None).cast("string").alias("v")), F.struct(id_c.cast("string").alias("v"))

    def states(policy: str, ends: Column) -> dict[str, Column]:
        asks = (kind == "question") & step.isNull()
        return {f"{policy}_group": F.when(ends, none).when(step == "starter", me), f"{policy}_question": F.when(ends | (step == "starter"), none).when(asks, me)}

    rows = carried(rows, doc, order, states("persistent", step.eqNullSafe("reset")) | states("guarded", step.isin("reset", "long") & step.isNotNull()), size=size)
    open_, none_yet = (lambda c: F.col(c).isNotNull()), F.coalesce(F.col(gap), F.lit(False)) & step.isNull()
    question, table = none_yet & (kind == "question"), none_yet & (kind == "table")
    rows = rows.withColumn("persistent_covered", (question & open_("persistent_group")) | (table & (open_("persistent_group") | open_("persistent_question"))))
    return rows.withColumn("guarded_covered", (question & open_("guarded_group")) | (table & open_("guarded_question")))


def policy_counts(rows: DataFrame, keys: list[str], *, type_: str, gap: str) -> DataFrame:
    """The counters of both policies from `simulate`'s rows."""
    is_ = lambda c, v: F.col(c).eqNullSafe(v)
    gaps = {"question": is_(type_, "question") & F.col(gap), "table": is_(type_, "table") & F.col(gap)}
    counts = {"virtual_groups": is_("step", "starter"), **{f"{k}_starters": is_("starter", k) for k in ("section_label", "instruction_paragraph", "colon_label")}, "hard_section_resets": is_("step", "reset"), "long_paragraph_resets": is_("step", "long")}
    for policy in ("persistent", "guarded"):
        for kind, which in gaps.items():
            counts |= {f"{policy}_covered_{kind}s": which & F.col(f"{policy}_covered"), f"{policy}_remaining_{kind}s": which & ~F.col(f"{policy}_covered")}
    counts |= {"tables_in_open_questions": gaps["table"] & F.col("persistent_covered") & F.col("persistent_question").isNotNull(), "tables_in_groups_only": gaps["table"] & F.col("persistent_covered") & F.col("persistent_question").isNull()}
    return rows.groupBy(*keys).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in counts.items()))


#: Patterns of questions that nothing groups, and words of tables that may explain.
NUMBER_DOT, NUMBER_SPACE, MATHS = r"^[0-9]{1,3}\.\s+", r"^[0-9]{1,3}\s+\S+", r"\$.*\$|\\frac|\\begin"
PART_LETTER, LONG_TEXT = "^[A-Z]$", 240
EXPLAINING = ("answer", "definition", "example")


def _labelled(text: Column) -> Column:
    return F.lower(F.trim(text, F.lit("* "))).isin(*SECTION_LABELS)


def question_shape(text: Column) -> Column:
    """What a question's text looks like; the first rule that holds."""
    has = lambda p: X.matches(text, p)
    return X.ladder((has(NUMBER_DOT), "number_dot_question"), (has(NUMBER_SPACE), "number_space_fragment_or_question"), (has(MATHS), "math_text"), (F.contains(text, F.lit("?")), "question_mark_text"), (F.length(text) > LONG_TEXT, "long_text"), default="other_question_like_text")


def run_starter(before: Column, before_type: Column, first: Column) -> Column:
    """Why a run of questions that nothing groups begins where it does: by the block before it ('' and null if there is none) and its first text."""
    has = X.matches
    return X.ladder(
        ((before == "") & has(first, NUMBER_DOT), "missing_front_context"),
        (before == "TOPICS", "front_matter_topic_list_artifact"),
        (_labelled(before), "section_label_should_start_group"),
        (has(before, INSTRUCTION_START), "instruction_paragraph_should_start_group"),
        (before_type.eqNullSafe("question"), "continues_existing_ungrouped_question_run"),
        (has(before, PART_LETTER), "part_letter_should_start_group"),
        (F.endswith(before, F.lit(":")), "colon_label_should_start_group"),
        default="unknown_or_manual_group_boundary",
    )


def table_gap(table: Column, before: Column, before_type: Column, after_type: Column) -> Column:
    """What a table that nothing groups may belong to."""
    beside = F.coalesce(before_type == "question", F.lit(False)) | F.coalesce(after_type == "question", F.lit(False))
    explains = F.exists(F.array(*(F.lit(w) for w in EXPLAINING)), lambda w: F.contains(F.lower(table), w))
    return X.ladder(
        (beside, "table_adjacent_to_question_should_attach"),
        (X.matches(before, INSTRUCTION_START), "table_after_instruction_should_attach"),
        (_labelled(before), "table_after_section_label_should_attach"),
        (explains, "table_may_be_exercise_or_explanation_needs_visual_review"),
        default="table_manual_group_boundary",
    )


def gap_runs(rows: DataFrame, doc: str, *, gap: str = "gap") -> DataFrame:
    """(doc, first_no, last_no, run_length, starter, shapes): runs of neighbouring questions that nothing groups, from rows of `with_relations` with a flag `gap`.

    Within a run the block number less the number of such questions so far is one number. Shapes are shape=count, by name."""
    own = rows.filter((F.col("type") == "question") & F.col(gap))
    text, before = X.whitespace(F.col("markdown")), X.whitespace(F.coalesce("previous_markdown", F.lit("")))
    keyed = own.withColumn("__run", F.col("block_no") - F.row_number().over(Window.partitionBy(doc).orderBy("block_no"))).withColumn("__shape", question_shape(text)).withColumn("__starter", run_starter(before, F.col("previous_type"), text))
    by_shape = keyed.groupBy(doc, "__run", "__shape").agg(F.count("*").alias("n"), F.min(F.struct("block_no", "__starter")).alias("first"), F.max("block_no").alias("last_no"))
    runs = by_shape.groupBy(doc, "__run").agg(F.min("first").alias("first"), F.max("last_no").alias("last_no"), F.sum("n").alias("run_length"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "__shape", F.col("n").cast("string")))), ",").alias("shapes"))
    return runs.select(doc, F.col("first.block_no").alias("first_no"), "last_no", "run_length", F.col("first.__starter").alias("starter"), "shapes")


def gap_tables(rows: DataFrame, doc: str, *, gap: str = "gap") -> DataFrame:
    """(doc, block_no, bucket) of each table that nothing groups."""
    before = X.whitespace(F.coalesce("previous_markdown", F.lit("")))
    return rows.filter((F.col("type") == "table") & F.col(gap)).select(doc, "block_no", table_gap(X.whitespace(F.col("markdown")), before, F.col("previous_type"), F.col("next_type")).alias("bucket"))
