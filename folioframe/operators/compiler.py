"""The standard block table of a markdown document: typed blocks with heading paths, question groups and parents, table
attachments, figure roles and the audit of what has no parent.

All state is carried by windows over the lines of one document, dealt once by `doc`, which must name one document. Rows without
a text, blank lines and lines that are one comment give no block; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions import text as X
from folioframe.operators.blocks import heading_path_positional

#: Labels that stand alone on a line, and the type each gives.
LABELS = {
    "before you read": "before_you_read",
    "reading comprehension": "comprehension_questions",
    "vocabulary practice": "vocabulary_practice",
    "word link": "vocabulary_box",
    "did you know?": "note",
    "explore more": "explore_more",
    "review unit": "review_unit",
}
#: Labels that end a reading passage.
PASSAGE_STOPS = ("reading comprehension", "vocabulary practice", "word link", "did you know?", "explore more", "review unit")
#: Beginnings of lines that mark a place in a passage or an exercise.
MARKER_STARTS = ("fact ", "main idea", "detail", "reference", "vocabulary")
#: Types that end, open and fill a question group.
STRUCTURAL = ("unit_opener", "section", "reading_passage")
GROUPS = ("before_you_read", "comprehension_questions", "vocabulary_practice", "review_unit", "question_group")
CHILDREN = ("captioned_figure", "table", "option", "answer_blank")
RELATIONS = {"question": "contains_question", "option": "contains_option", "answer_blank": "contains_answer_blank", "table": "uses_table", "captioned_figure": "uses_figure"}
#: Patterns of lines.
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
COMMENT = r"^<!--.*?-->$"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
TABLE = r"(?i)^<table[\s>]"
CAPTION = r"^[▲▼▶◀]|[▲▼▶◀]\s"
PART = r"^[A-Z]\.\s+"
QUESTION = r"^[0-9]+\.\s+"
OPTION = r"^(?:[a-h][.)]|\([a-h]\))\s+"
BLANK = r"(\\_){2,}|_{2,}"
#: Patterns of workbook lines.
GROUP_HEADING = r"(?i)^PART\s+[0-9]+\s+(?:Write|Learner's Log)\b"
EXERCISE_HEADING = r"(?i)^\*{0,2}Exercise\s+[0-9]{1,3}\b"
INSTRUCTION = r"(?i)^\*{0,2}[0-9]+\s+(?:Circle|Complete|Write|Choose|Read|Look|Match|Ask|Answer|Listen|Correct|Use|Fill|Tick|Put|Order|Number|Underline|Make|Play|Say|Draw|Find|Change|Rewrite)\b"
UNNUMBERED_INSTRUCTION = r"(?i)^(?:ABOUT YOU\b|COMPREHENSION\b|LISTEN\b.*\b(?:Circle|Write|Complete|Answer)\b|Some\b.*\b(?:Find|Correct)\b.*\bmistakes?\b|(?:Choose|Complete|Write|Look|Read|Find|Correct|Fill|Circle|Answer|Ask|Tell|Work with a partner)\b)"
QUESTION_INSTRUCTION = r"(?i)^\*{0,2}[0-9]{1,2}\s+.+\?\s+(?:Write|Circle|Choose|Match|Complete|Tick|Put|Order|Number|Underline|Make|Draw|Find|Change|Rewrite)\b"
NUMBERED_ITEM = r"^[0-9]{1,2}\s+\S+"
EQUIVALENCE = r"^[0-9]{1,2}\s*=\s+\S+"
NUMBERED_EXPLANATION = r"(?i)^[0-9]+\.\s+(?:We\b|To\b|Use\b|Don't\b|Do not\b|In\b|The\b|After\b|Sometimes\b|Remember\b|Omit\b|You can\b|You sometimes\b|When\b|What kind of\b|How many\b|Who questions\b|Some common\b|There are\b|describe\b|tell\b|classify\b|show\b|Family\b|Have\b|An?\s+\w+\s+can\b)"
NUMBER_RUN = r"^(?:[0-9]+\s+){4,}[0-9]+$"
NUMBER_SEQUENCE = r"^[0-9]+(?:\.\s*[0-9]+\.?)+$"
ALL_DAY = r"(?i)^24 hours a day,\s*7 days a week$"
#: Signals that a figure or a table explains and asks nothing.
FIGURE_SIGNAL = r"(?i)\b(?:we use|regular verbs|irregular verbs|base form|present|past|future|conditional|passive|pronouns|modal verbs|look!)"
TABLE_SIGNALS = (
    r"(?i)\b(?:we use|we form|we make|if-clause|direct speech|reported speech|reported question|fact|wish|past simple|past perfect|present perfect|passive|conditional)\b",
    r"(?is)(?:possessive adjectives?.*possessive pronouns?|possessive pronouns?.*possessive adjectives?|affirmative.*(?:short form|negative)|(?:short form|negative).*affirmative|base form.*past participles?|past participles?.*base form)",
    r"(?is)(?:\bexamples?\b.*\bexplanation\b|\bsubject\b.*\bbe\b|\bsubject pronoun\b.*\bpossessive adjective\b|\blong form\b.*\bcontraction\b|\bstatement\b.*\b(?:yes/no|wh-)\s+question\b|\bquestion word\(s\).*\b(?:be|do|modal|have to|verb)\b|\bwh- questions?\b.*\banswers?\b|\bsubject\b.*\bverb\b|\btime expressions?\b|\bpreposition\b.*\bexamples?\b|\bquantity\b.*\bexamples?\b|\bbase form\b.*-s form\b|\bsimple adjective\b.*\bsuperlative adjective\b|\bthere\b.*\bbe\b.*\bphrase\b|\bverb\b.*-ing form\b.*\brule\b|\bjar of\b.*\bcan of\b|\bin\b.*\bnear\b.*\bnext to\b.*\bon\b.*\bat\b.*\bto\b|\bsingular\b.*\bplural\b|\byes/no question\b.*\bwh- question\b|\bshort answers?\b|\bprepositional phrase\b|\bbase form\b.*\bpast form\b|\bfrequency\b.*\bpresent\b.*\bpast\b.*\bfuture\b)",
)
_EDGES = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


_is = X.matches


def _kind(type_: str, subtype: str = "", *, keep: bool = False, page: bool = False, columns: bool = False, intent: str = "") -> Column:
    fields = {"type": type_, "subtype": subtype, "keep_together": keep, "break_before": "page" if page else "", "layout_hint": "two_column" if columns else "", "profile_intent": intent}
    return F.struct(*(F.lit(v).alias(k) for k, v in fields.items()))


def classify(line: Column, level: Column, inside: Column, *, workbook: bool) -> Column:
    """(type, subtype, layout) of a stripped line: the first rule that holds. `inside` tells that a passage is open."""
    rules: list[tuple[Column, Column]] = []
    group = _kind("question_group", "exercise_instruction", keep=True, intent="exercise_group")
    if workbook:
        rules += [(level.isNotNull() & _is(F.regexp_replace(line, r"^#+\s*", ""), GROUP_HEADING), _kind("question_group", "exercise_section", keep=True, intent="exercise_group"))]
    rules += [(level == 1, _kind("unit_opener", "heading", page=True)), (level == 2, _kind("section", "lesson_heading", page=True))]
    rules += [(level.isNotNull(), _kind("section", "lesson_heading"))] if workbook else [(level == 3, _kind("reading_passage", "passage_heading", columns=True)), (level.isNotNull(), _kind("heading"))]
    rules += [(F.lower(line) == said, _kind(type_, "section_label", keep=type_ in GROUPS)) for said, type_ in LABELS.items()]
    rules += [
        (_is(line, IMAGE), _kind("captioned_figure", keep=True, intent="figure_relation_candidate" if workbook else "")),
        (_is(line, TABLE), _kind("table", "table_question" if workbook else "", keep=True, intent="table_question" if workbook else "")),
        (F.startswith(line, F.lit("$$")) | F.endswith(line, F.lit("$$")), _kind("formula", keep=True)),
        (_is(line, CAPTION), _kind("caption", keep=True)),
    ]
    if workbook:
        rules += [(_is(line, p), group) for p in (EXERCISE_HEADING, INSTRUCTION, UNNUMBERED_INSTRUCTION, QUESTION_INSTRUCTION)]
        rules += [(_is(line, NUMBERED_ITEM) & _is(line, BLANK), _kind("question", "fill_blank", keep=True, intent="fill_blank")), (_is(line, NUMBERED_ITEM), _kind("question", "exercise_item", keep=True, intent="exercise_item"))]
    marker = F.reduce(F.array(*(F.startswith(F.lower(line), F.lit(s)) for s in MARKER_STARTS)), F.lit(False), lambda a, b: a | b)
    rules += [
        (_is(line, PART), _kind("question_group", "exercise_part", keep=True)),
        (_is(line, QUESTION), _kind("question", keep=True)),
        (_is(line, OPTION), _kind("option", keep=True)),
        (_is(line, BLANK), _kind("answer_blank", keep=True)),
        (marker & inside, _kind("reading_passage", "reading_marker", columns=True)),
        (marker, _kind("note", "exercise_marker")),
        (inside, _kind("reading_passage", "paragraph", columns=True)),
        ((F.length(line) <= 80) & F.endswith(line, F.lit(":")), _kind("note", "label", keep=True)),
    ]
    (condition, value), *others = rules
    out = F.when(condition, value)
    for condition, value in others:
        out = out.when(condition, value)
    return out.otherwise(_kind("paragraph"))


def standard_blocks(lines: DataFrame, doc: str, order: str, line: str, *, workbook: bool = False) -> DataFrame:
    """(doc, line_start, line_end, markdown, text, path, block_no, block_id, type, subtype, layout, image_refs), one row a line
    that is neither blank nor a comment."""
    rows = lines.select(doc, F.col(order).alias("line_start"), F.regexp_replace(line, _EDGES, "").alias("markdown")).filter((F.col("markdown") != "") & ~_is(F.col("markdown"), COMMENT))
    level, said = F.col("level"), F.col("markdown")
    rows = rows.withColumn("level", F.nullif(F.length(F.regexp_extract(said, HEADING, 1)), F.lit(0))).withColumn("title", F.when(level.isNotNull(), X.whitespace(F.regexp_extract(said, HEADING, 2))))
    rows = heading_path_positional(rows, doc, "line_start", "level", "title")
    by_line = Window.partitionBy(doc).orderBy("line_start")
    opened = F.when(level.isNotNull(), (level == 3) & F.lit(not workbook)).when(F.lower(said).isin(*PASSAGE_STOPS), F.lit(False))
    rows = rows.withColumn("inside", F.coalesce(F.last(opened, ignorenulls=True).over(by_line.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).withColumn("block_no", F.row_number().over(by_line))
    rows = rows.withColumn("kind", classify(said, level, F.col("inside"), workbook=workbook))
    layout = F.struct(*(F.col(f"kind.{k}") for k in ("keep_together", "break_before", "layout_hint", "profile_intent")))
    return rows.select(doc, "line_start", F.col("line_start").alias("line_end"), "markdown", F.regexp_replace(F.regexp_replace(said, IMAGE, ""), _EDGES, "").alias("text"), "path", "block_no", block_id(F.col("block_no")).alias("block_id"), "kind.type", "kind.subtype", layout.alias("layout"), X.image_refs(said).alias("image_refs"))


def block_id(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("b-%05d", number))


def explains(context: Column) -> Column:
    """Whether the text around a table says that it explains grammar."""
    first, *others = (_is(context, p) for p in TABLE_SIGNALS)
    for other in others:
        first = first | other
    return first


def with_relations(blocks: DataFrame, doc: str, *, order: str = "block_no") -> DataFrame:
    """Blocks with parent_no (the open question, else the open group), relation, the text and type of the neighbours, and
    the subtype of tables without parent that explain."""
    by_block = Window.partitionBy(doc).orderBy(order)
    before, kind = by_block.rowsBetween(Window.unboundedPreceding, -1), F.col("type")
    last = lambda c: F.coalesce(F.last(F.when(c, F.col(order)), ignorenulls=True).over(before), F.lit(0))
    rows = blocks.withColumn("__ended", last(kind.isin(*STRUCTURAL))).withColumn("__group", last(kind.isin(*GROUPS))).withColumn("__question", last(kind == "question"))
    rows = rows.select("*", *(f(c).over(by_block).alias(f"{name}_{c}") for name, f in (("previous", F.lag), ("next", F.lead)) for c in ("markdown", "type")))
    group = F.when(F.col("__group") > F.col("__ended"), F.col("__group"))
    question = F.when(F.col("__question") > F.greatest("__ended", "__group"), F.col("__question"))
    rows = rows.withColumn("parent_no", F.when(kind == "question", group).when(kind.isin(*CHILDREN), F.coalesce(question, group))).drop("__ended", "__group", "__question")
    context = F.concat_ws("\n", "previous_markdown", "markdown", "next_markdown")
    alone = (kind == "table") & (F.col("subtype") == "table_question") & F.isnull("parent_no")
    relation = X.ladder(*((kind == type_, name) for type_, name in RELATIONS.items()), default=None)
    return rows.withColumn("subtype", F.when(alone & explains(context), "explanation_table").otherwise(F.col("subtype"))).withColumn("relation", F.when(F.col("parent_no").isNotNull(), relation))


def relation_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The 17 counters of groups, questions, options, blanks, table questions and figures, all and with or without parent."""
    kind, subtype, has = F.col("type"), F.col("subtype"), F.col("parent_no").isNotNull()
    asks = (kind == "table") & (subtype == "table_question")
    shows = (kind == "captioned_figure") & (F.col("layout.profile_intent") == "figure_relation_candidate")
    counts = {"question_groups": kind.isin(*GROUPS), "questions": kind == "question", "grouped_questions": (kind == "question") & has, "ungrouped_questions": (kind == "question") & ~has, "fill_blank_questions": (kind == "question") & (subtype == "fill_blank")}
    for name, which in (("options", kind == "option"), ("answer_blanks", kind == "answer_blank"), ("table_questions", asks), ("figure_relation_candidates", shows)):
        counts |= {name: which, f"parented_{name}": which & has, f"orphan_{name}": which & ~has}
    return rows.groupBy(*keys).agg(*(F.count_if(c).alias(name) for name, c in counts.items()))


def relation_delta(summary: DataFrame, groups: Column, tables: Column) -> DataFrame:
    """The counters after `groups` new groups took `tables` table questions in; nothing changes without tables."""
    change = {"question_groups": F.col("question_groups") + groups, "parented_table_questions": F.col("parented_table_questions") + tables, "orphan_table_questions": F.greatest(F.lit(0), F.col("orphan_table_questions") - tables)}
    return summary.withColumns({name: F.when(tables > 0, c).otherwise(F.col(name)) for name, c in change.items()})


def table_family(table: Column, before: Column, after: Column, path: Column) -> Column:
    """The reason, as family/reason, why a table that no question holds belongs to what stands around it; null if there is none."""
    plain = lambda c: X.whitespace(F.coalesce(c, F.lit("")))
    own, prior, later = plain(table), plain(before), plain(after)
    has = lambda c, *parts: F.array_min(F.array(*(F.contains(F.lower(c), F.lit(p)) for p in parts)))
    around = F.concat_ws(" ", prior, later)
    review = F.exists(path, lambda p: F.contains(p, F.lit("Topic Review"))) & F.contains(own, F.lit("Vocabulary Term")) & (later == "Use Vocabulary in Writing")
    statistics = has(own, "mean") & (has(own, "mad") | has(own, "absolute deviation")) & (has(prior, "computes the mean") | has(prior, "you can use dot plots") | has(prior, "measures of center and variability"))
    return X.ladder(
        (review, "single_table_vocabulary_review/topic_review_vocabulary_table_before_use_vocabulary_followup"),
        (has(around, "scatter plot") & has(own, "temperature", "tickets sold"), "exercise_scatter_plot_data_table/scatter_plot_prompt_with_temperature_ticket_data_table"),
        (has(around, "scatter plot") & has(own, "distance", "airfare"), "exercise_scatter_plot_data_table/scatter_plot_prompt_with_distance_airfare_data_table"),
        (has(around, "bar diagram"), "example_bar_diagram_table_model/bar_diagram_instruction_with_model_table"),
        (has(around, "frequency table") & has(own, "digital", "print"), "example_frequency_table_explanation/frequency_table_explanation_with_categorical_data_table"),
        (statistics, "example_statistics_summary_table/mean_mad_summary_table_in_statistics_explanation"),
        (has(prior, "look for a pattern") & has(own, "exponent form"), "example_pattern_or_rate_table/pattern_prompt_with_exponent_table"),
        (has(later, "constant of proportionality") & has(own, "distance", "time"), "example_pattern_or_rate_table/rate_table_before_constant_of_proportionality_step"),
        default=None,
    )


def table_attachments(rows: DataFrame, doc: str) -> DataFrame:
    """(doc, block_id, group_id, family, reason, line_start, path) of each table question without parent, no table after it, that has a family."""
    alone = (F.col("type") == "table") & (F.col("subtype") == "table_question") & F.isnull("parent_no") & ~F.col("next_type").eqNullSafe(F.lit("table"))
    found = F.split(table_family(F.col("markdown"), F.col("previous_markdown"), F.col("next_markdown"), F.col("path")), "/")
    rows = rows.filter(alone).withColumn("__found", found).filter(F.col("__found").isNotNull())
    return rows.select(doc, "block_id", F.concat(F.lit("workbook-table-attachment:"), "block_id").alias("group_id"), F.col("__found")[0].alias("family"), F.col("__found")[1].alias("reason"), "line_start", "path")


def figure_role(width: Column, height: Column, context: Column, parent_type: Column, path: Column) -> Column:
    """What a workbook figure is for; unknown dimensions come first."""
    small = (width * height <= 20000) | (F.greatest(width, height) <= 160)
    return X.ladder(
        (width.isNull() | height.isNull(), "needs_dimension_review"),
        (small, "helper_icon"),
        (F.coalesce(parent_type.isin("question", "question_group"), F.lit(False)) | _is(context, BLANK), "exercise_key_figure"),
        (_is(context, FIGURE_SIGNAL) | (F.size(path) > 0), "explanation_key_figure"),
        default="decorative",
    )


def _audited() -> Column:
    """What a row without parent is to the audit, null if nothing."""
    kind = F.col("type")
    figure = (kind == "captioned_figure") & (F.col("layout.profile_intent") == "figure_relation_candidate")
    return F.when(F.isnull("parent_no"), X.ladder((kind == "question", "ungrouped_question"), ((kind == "table") & (F.col("subtype") == "table_question"), "orphan_table_question"), ((kind == "table") & (F.col("subtype") == "explanation_table"), "unparented_explanation_table"), (figure, "orphan_figure_relation_candidate"), default=None))


def audit_finding(role: Column) -> Column:
    """The audit's class/reason of a row of `with_relations`, null where it looks at none; `role` is the figure's."""
    kind, what = F.col("type"), _audited()
    said, prior = X.whitespace(F.col("markdown")), X.whitespace(F.coalesce("previous_markdown", F.lit("")))
    context = F.concat_ws("\n", prior, said, X.whitespace(F.coalesce("next_markdown", F.lit(""))))
    top = F.size("path") == 0
    question = X.ladder(
        (top & (F.upper(prior) == "TOPICS"), "front_matter_artifact/topic_list_misread_as_question"),
        (top & _is(said, NUMBER_RUN), "front_matter_artifact/publication_number_line_misread_as_question"),
        (_is(said, NUMBER_SEQUENCE), "explanation_artifact/number_sequence_artifact_not_exercise_item"),
        (_is(said, ALL_DAY), "explanation_artifact/time_expression_phrase_not_exercise_item"),
        (F.exists("path", lambda p: F.contains(F.lower(p), F.lit("editing advice"))), "explanation_artifact/numbered_editing_advice_not_exercise_item"),
        (_is(said, NUMBERED_EXPLANATION), "explanation_artifact/numbered_grammar_explanation_not_exercise_item"),
        (_is(said, EQUIVALENCE), "explanation_artifact/numbered_grammar_equivalence_not_exercise_item"),
        (_is(said, QUESTION_INSTRUCTION), "real_profile_gap/numbered_instruction_should_start_question_group"),
        default="real_profile_gap/question_without_exercise_group",
    )
    table = F.when((F.col("subtype") == "explanation_table") | explains(context), "explanation_artifact/grammar_explanation_table_not_exercise_table").otherwise("real_profile_gap/table_question_without_exercise_group")
    beside = F.coalesce(F.col("previous_type").isin("unit_opener", "section", "captioned_figure"), F.lit(False)) | F.coalesce(F.col("next_type").isin("section", "paragraph"), F.lit(False))
    shown = X.ladder(
        (role == "helper_icon", "helper_icon_artifact/small_helper_icon_should_use_compact_nearby_rendering"),
        (role == "explanation_key_figure", "explanation_artifact/explanation_figure_without_exercise_parent"),
        ((role == "exercise_key_figure") & beside, "explanation_artifact/unit_or_explanation_figure_requires_visual_review_not_exercise_parent"),
        (role == "exercise_key_figure", "real_profile_gap/content_figure_without_exercise_or_explanation_parent"),
        default="needs_review/unclassified_orphan_figure",
    )
    return F.when(what == "ungrouped_question", question).when(what.isNotNull() & (kind == "table"), table).when(what.isNotNull(), shown)


def relation_audit(rows: DataFrame, role: Column) -> DataFrame:
    """Questions, table questions and figures without parent, with `finding` as class/reason; `role` is the figure's."""
    return rows.withColumn("kind", _audited()).filter(F.col("kind").isNotNull()).withColumn("finding", audit_finding(role))
