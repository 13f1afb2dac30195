"""Evidence of clean text in its source: windows, units, tables, images, and the rules that read them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.text import blockers, context_key, context_text, ladder, numbers, numbers_differ, signature, whitespace, words
from folioframe.operators import matching, similar
from folioframe.sources.sinks import stored

#: How a caption can begin.
CAPTION_MARKS = ("▲", "△", "Fig.", "Figure", "Photo", "Image")
#: Words of exercises and of content visuals near an image.
EXERCISE_WORDS = ("before you read", "skim", "circle", "complete", "answer", "question")
VISUAL_WORDS = ("chart", "graph", "table", "diagram", "map", "timeline")
#: Chinese digits.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
#: Statuses of marker files, longer ones first where one ends another.
MARKERS = (
    "mineru_submitted", "mineru_running", "mineru_done_frozen", "mineru_done", "popo_submitted", "popo_running", "popo_done_frozen", "popo_done", "mineru_error", "popo_error",
    "mineru_freeze_error", "popo_freeze_error", "mineru_asset_invalid", "done", "error", "processing", "submitted", "collecting", "collected",
)
#: Statuses that end a batch, and those that say a document succeeded.
BATCH_ENDED = ("succeeded", "success", "partial", "failed", "error", "canceled", "cancelled", "timeout")
DOC_SUCCEEDED = ("succeeded", "success", "completed", "done")
#: Stages whose progress is taken as it is.
RESET_STAGES = ("queued", "completed", "failed")
#: Issue type -> (stage, label, target, confidence); the two of `BY_RAW` depend on the raw manifest.
ROOT_CAUSES = {
    "formula_broken": ("standard_rendering", "math_rendering", "standard", 0.72),
    "option_answer_blank": ("standard_rendering", "answer_blank_rendering", "standard", 0.70),
    "print_layout": ("standard_layout", "html_layout", "standard", 0.70),
    "question_grouping": ("standard_grouping", "block_assignment", "standard", 0.62),
    "image_wrong_parent": ("standard_grouping", "block_assignment", "standard", 0.62),
    "extra_noise": ("clean_overclean", "upstream_noise_absorption", "clean", 0.52),
    "image_missing": ("clean_underrepair", "candidate_extraction", "clean", 0.50),
    "image_should_keep": ("clean_underrepair", "candidate_extraction", "clean", 0.50),
    "image_should_drop": ("clean_underrepair", "candidate_extraction", "clean", 0.50),
    "table_broken": ("standard_layout", "html_layout", "standard", 0.56),
}
#: Issue type -> ((stage, label) with a raw manifest, (stage, label) without, target, confidence).
BY_RAW = {
    "wrong_order": (("raw_outline", "anchor_application"), ("unknown_needs_review", "qa_gate_gap"), "raw", 0.58),
    "heading_hierarchy": (("raw_outline", "anchor_application"), ("unknown_needs_review", "qa_gate_gap"), "raw", 0.58),
    "missing_content": (("clean_underrepair", "upstream_noise_absorption"), ("mineru_ocr_layout", "upstream_noise_absorption"), "clean", 0.52),
    "ocr_text_error": (("clean_underrepair", "upstream_noise_absorption"), ("mineru_ocr_layout", "upstream_noise_absorption"), "clean", 0.52),
}
#: Keywords of free notes in the order they are tried, and what they say.
NOTE_CAUSES = (
    (("公式", "latex", "katex", "math", "sqrt", "frac"), ("standard_rendering", "math_rendering", "standard", 0.66)),
    (("填空", "空格", "____", "blank", "t/f", "true or false", "对错判断", "判断题", "选项"), ("standard_rendering", "answer_blank_rendering", "standard", 0.62)),
    (("不是正文", "非正文", "目录页", "extra", "noise", "噪音"), ("clean_overclean", "upstream_noise_absorption", "clean", 0.54)),
    (("main idea", "detail", "reference", "vocabulary", "题目的分类", "题组", "关联关系", "题干"), ("standard_grouping", "block_assignment", "standard", 0.62)),
    (("分栏", "布局", "排版", "过大", "不协调", "左对齐", "右对齐", "打印"), ("standard_layout", "html_layout", "standard", 0.60)),
    (("不需要", "目录"), ("clean_overclean", "upstream_noise_absorption", "clean", 0.48)),
)
#: Keywords of order, which count where a raw manifest is there.
ORDER_WORDS = ("顺序", "目录层级", "标题层级", "章节")
_UNKNOWN = ("unknown_needs_review", "qa_gate_gap", "review", 0.35)


def _any_in(text: Column, parts: Sequence[str]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))


def page_windows(rows: DataFrame, keys: Sequence[str], order: str, text: str, most: int) -> DataFrame:
    """Runs of 1 to `most` neighbouring rows of a page, texts joined by a space, cut tails and blank ones left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, most - 1)
    held = rows.withColumn("__t", F.collect_list(F.coalesce(F.col(text), F.lit(""))).over(w)).select(*keys, F.col(order).alias("first"), "__t", F.explode(F.sequence(F.lit(1), F.size("__t"))).alias("n_rows"))
    return held.select(*keys, "first", "n_rows", F.array_join(F.slice("__t", 1, F.col("n_rows")), " ").alias("window")).filter(whitespace(F.col("window")) != "")


def context_tokens(text: Column) -> Column:
    """Distinct words of two characters or more of the context text."""
    return F.array_distinct(F.filter(words(context_text(text)), lambda w: F.length(w) > 1))


def fuzzy_windows(clean: DataFrame, rows: DataFrame, unit: Sequence[str], page: str, order: str, *, id_: str, text: str, raw: str, most: int = 6, top: int = 5, least: float = 0.82, block: int = 1024) -> DataFrame:
    """The `top` windows of each clean text within its unit, by the larger of sequence ratio and token overlap, from `least` on.

    Only rows and clean texts are moved, both to the task of their unit; windows are made there, meet the texts of the unit row by row and are
    never written. Lengths and common tokens leave out most pairs, the subsequence bound of `similar` most of the others, and none is lost.
    The pages of a unit of more than `block` rows are dealt to blocks, each with all clean texts of the unit. Ids of clean texts are unique."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: little text, much work
    counts = rows.groupBy(*unit).agg(F.count("*").alias("__rows")).filter(F.col("__rows") > block)
    blocks = stored(counts.select(*unit, F.ceil(F.col("__rows") / block).cast("int").alias("__blocks")))
    dealt = lambda side, at: side.join(matching.small(blocks, [*unit, "__blocks"]), [*unit], "left").withColumn("__block", at(F.coalesce("__blocks", F.lit(1)))).drop("__blocks").repartition(parts, *unit, "__block")
    wanted = dealt(clean.filter(F.col(id_).isNotNull()).select(id_, *unit, F.col(text).alias("__text")), lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    wanted = wanted.select(id_, *unit, "__block", context_key(F.col("__text")).alias("__key"), context_tokens(F.col("__text")).alias("__want")).filter("__key IS NOT NULL")
    placed = dealt(rows.select(*unit, page, order, raw), lambda n: F.pmod(F.xxhash64(page), n).cast("int"))
    windows = page_windows(placed, [*unit, "__block", page], order, raw, most).withColumn("__said", context_text(F.col("window")))
    held = windows.select(*unit, "__block", page, "first", "n_rows", F.replace("__said", F.lit(" "), F.lit("")).alias("__wkey"), F.array_distinct(F.filter(words(F.col("__said")), lambda w: F.length(w) > 1)).alias("__tokens"))
    a, b, n = F.length("__key"), F.length("__wkey"), F.size("__want")
    near = F.least(a, b) >= F.ceil(least * (a + b) / 2 - 1e-9)
    enough = F.ceil(least * n - 1e-9)
    covered = (n > 0) & (F.size("__tokens") >= enough) & (F.size(F.array_intersect("__want", "__tokens")) >= enough)
    pairs = held.join(wanted.hint("merge"), [*unit, "__block"]).filter(near | covered)
    overlap = F.when(n > 0, F.round(F.size(F.array_intersect("__want", "__tokens")) / n, 6)).otherwise(0.0)
    texts = pairs.select(id_, page, "first", "n_rows", "__key", "__wkey", overlap.alias("token_overlap"))
    scored = texts.withColumn("__r", similar.ratio_from(least)("__key", "__wkey")).filter((F.col("token_overlap") >= least) | F.col("__r").isNotNull())
    ratio = F.coalesce("__r", matching.sequence_ratio(F.when(F.col("__r").isNull(), F.col("__key")), F.col("__wkey")))
    scored = scored.withColumn("sequence_ratio", F.round(ratio, 6)).withColumn("score", F.greatest("sequence_ratio", "token_overlap")).drop("__key", "__wkey", "__r")
    rank = Window.partitionBy(id_).orderBy(F.desc("score"), F.desc("token_overlap"), "n_rows", page, "first")
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select(id_, page, "first", "n_rows", "sequence_ratio", "token_overlap", "score", "rank")


def window_bucket(score: Column, ratio: Column, overlap: Column, second: Column) -> Column:
    """How far the best window can be trusted; all null where there is none."""
    margin = score - F.coalesce(second, F.lit(0.0))
    high = ((ratio >= 0.98) | ((overlap >= 0.98) & (ratio >= 0.8))) & (margin >= 0.03)
    return ladder((score.isNull(), "no_context_candidate"), (high, "context_window_candidate_high_confidence"), ((score >= 0.92) & (margin >= 0.05), "context_window_candidate_review"), (score >= 0.82, "context_window_candidate_weak"), default="no_context_candidate")


def stop_reason(bucket: Column, clean: Column, source: Column, ratio: Column, overlap: Column, score: Column, short_formula: Column) -> Column:
    """Why a candidate of a bucket isn't taken."""
    differ = (F.size(numbers(clean)) > 0) & (F.size(numbers(source)) > 0) & numbers_differ(clean, source)
    none, weak = bucket == "no_context_candidate", bucket == "context_window_candidate_weak"
    return ladder(
        (none & (score >= 0.75) & differ, "no_candidate_near_mismatch_different_numbers"),
        (none, "no_candidate_requires_manual_or_source_reconstruction"),
        (bucket == "context_window_candidate_review", "review_candidate_token_overlap_only"),
        (weak & (ratio >= 0.98) & (overlap > 0) & (overlap < 0.98), "weak_formula_spacing_or_tokenization_review"),
        (weak & differ, "weak_false_positive_different_numbers"),
        (weak & (ratio >= 0.95), "weak_near_text_ocr_or_minor_text_review"),
        (weak & short_formula, "weak_short_formula_not_safe"),
        (weak, "weak_false_positive_or_context_gap"),
        default="unclassified",
    )


def short_matches(clean: DataFrame, rows: DataFrame, doc: str, page: str, order: str, *, id_: str, text: str, raw: str, most: int = 3) -> DataFrame:
    """Clean texts whose key has 8 to 23 characters with the only window of that key in the document; others are left out."""
    wanted = clean.select(doc, id_, context_key(F.col(text)).alias("__k")).filter(F.length("__k").between(8, 23))
    found = page_windows(rows, [doc, page], order, raw, most).withColumn("__k", context_key(F.col("window")))
    only = found.groupBy(doc, "__k").agg(F.count("*").alias("__n"), F.min(page).alias(page), F.min("first").alias("first"), F.min("n_rows").alias("n_rows")).filter("__n = 1")
    return wanted.join(only, [doc, "__k"]).select(doc, id_, page, "first", "n_rows")


def table_matches(clean: DataFrame, raw: DataFrame, doc: str, id_: str, key: str, raw_index: str, raw_key: str) -> DataFrame:
    """The raw table of each clean one: equal keys score 1, a raw key within a clean one of 20 characters or more
    its share of it, from 0.85 on; ties go to the smallest index."""
    score = F.when(F.col(raw_key) == F.col(key), 1.0).when((F.length(key) >= 20) & (F.length(raw_key) > 0) & F.contains(key, raw_key), F.length(raw_key) / F.length(key))
    found = clean.filter(F.length(key) > 0).join(raw, doc).withColumn("__s", score).filter("__s >= 0.85")
    best = found.groupBy(doc, id_).agg(F.max(F.struct(F.round("__s", 4).alias("s"), (-F.col(raw_index)).alias("i"))).alias("__b"), F.count("*").alias("n_candidates"))
    return best.select(doc, id_, (-F.col("__b.i")).alias("match_index"), F.col("__b.s").alias("score"), F.when(F.col("__b.s") == 1, "exact").otherwise("contained").alias("rule"), "n_candidates")


def unit_matches(raw: DataFrame, clean: DataFrame, doc: str, index: str, path: str, title: str) -> DataFrame:
    """Each raw unit with the clean unit of its path (the last one), else with the only one of its title."""
    by_path = clean.filter(F.col(path) != "").groupBy(doc, path).agg(F.max(index).alias("__p"))
    by_title = clean.filter(F.col(title) != "").groupBy(doc, title).agg(F.min(index).alias("__t"), F.count("*").alias("__n")).filter("__n = 1").drop("__n")
    out = raw.join(by_path, [doc, path], "left").join(by_title, [doc, title], "left").join(clean.select(doc).distinct().withColumn("__some", F.lit(True)), doc, "left")
    match = F.coalesce("__p", "__t")
    return out.select(*raw.columns, match.alias("clean_index"), ladder((match.isNotNull(), "matched"), (F.col("__some").isNull(), "pending"), default="missing").alias("clean_status"))


def image_paths(items: DataFrame, images: DataFrame, doc: str, id_: str, text: str, ordinal: str, image_index: str, image_text: str, path: str) -> DataFrame:
    """The path of each item's image: that of the longest text that holds the item's or is held by it (the first
    of equals), else the one at the item's ordinal. Signatures are compared within one document."""
    left = items.withColumn("__a", signature(F.col(text)))
    right = images.select(doc, F.col(image_index).alias("__i"), signature(F.col(image_text)).alias("__b"), F.col(path).alias("__path"))
    held = left.join(right, doc).filter("__a <> '' and __b <> '' and (contains(__a, __b) or contains(__b, __a))")
    best = held.groupBy(doc, id_).agg(F.max_by("__path", F.struct(F.least(F.length("__a"), F.length("__b")), -F.col("__i"))).alias("__best"))
    at = right.select(doc, F.col("__i").alias(ordinal), F.col("__path").alias("__at"))
    return items.join(best, [doc, id_], "left").join(at, [doc, ordinal], "left").select(*items.columns, F.coalesce("__best", "__at").alias("image_path"))


def caption(own: Column, before: Column, after: Column) -> Column:
    """A row's own text, else the first of the last two texts before and the first two after that looks like a caption."""
    near = F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - 1), F.lit(2)), F.slice(after, 1, 2))
    clean = F.transform(near, whitespace)
    fits = F.filter(clean, lambda t: (t != "") & (reduce(Column.__or__, (t.startswith(m) for m in CAPTION_MARKS)) | (F.length(t) <= 120)))
    mine = whitespace(F.coalesce(own, F.lit("")))
    return F.substring(F.when(mine != "", mine).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(""))), 1, 240)


def image_role(said: Column, context: Column, box: Column) -> Column:
    text = F.lower(F.concat_ws(" ", said, context))
    width, height = (F.abs(F.get(box, F.lit(k + 2)) - F.get(box, F.lit(k))) for k in (0, 1))
    return ladder((_any_in(text, EXERCISE_WORDS), "exercise_related"), (_any_in(text, VISUAL_WORDS), "content_visual"), (said != "", "captioned_image"), ((F.size(box) == 4) & (F.least(width, height) < 80), "small_decoration_or_icon"), default="uncaptioned_image")


def near_flag(rows: DataFrame, keys: Sequence[str], order: str, condition: Column, before: int = 18, after: int = 2) -> DataFrame:
    """Whether any row from `before` rows back to `after` rows on fulfils the condition."""
    return rows.withColumn("near", F.max(F.coalesce(condition, F.lit(False))).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)))


def nearby_page(lines: DataFrame, doc: str, order: str, text: str, ahead: int = 6) -> DataFrame:
    """Headings with the page of the last page comment before, else that of a comment within `ahead` lines and before the next heading. Page 0 counts as none."""
    number = F.regexp_extract(text, r"(?i)<!--\s*page_(?:idx|index)\s*:\s*([0-9]+)\s*-->", 1)
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumn("__page", F.nullif(number.try_cast("int"), F.lit(0))).withColumn("__h", F.rlike(text, F.lit(r"^#{1,6}\s+\S")))
    rows = rows.withColumn("__before", F.last("__page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    soon = w.rowsBetween(1, ahead)
    rows = rows.withColumn("__next", F.first(F.when(F.col("__page").isNotNull(), F.struct(F.col(order).alias("at"), F.col("__page").alias("p"))), ignorenulls=True).over(soon)).withColumn("__stop", F.first(F.when(F.col("__h"), F.col(order)), ignorenulls=True).over(soon))
    page = F.coalesce("__before", F.when(F.col("__stop").isNull() | (F.col("__next.at") < F.col("__stop")), F.col("__next.p")))
    return rows.filter("__h").select(*lines.columns, page.alias("page"))


def fold_lines(lines: DataFrame, doc: str, order: str, text: str, *, opens: Column, closes: Column, toggles: bool = False) -> DataFrame:
    """Lines from one that opens to the next that closes become one row (its first order, its texts joined by line
    ends). With `toggles`, each line that opens also closes what is open; else a line that opens within is text."""
    w = Window.partitionBy(doc).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if toggles:
        state = F.sum(opens.cast("int")).over(so_far) % 2
    else:
        state = F.coalesce(F.last(F.when(closes, 0).when(opens, 1), ignorenulls=True).over(so_far), F.lit(0))
    rows = lines.withColumn("__in", state).withColumn("__was", F.coalesce(F.lag("__in").over(w), F.lit(0)))
    rows = rows.withColumn("__block", F.sum((F.col("__was") == 0).cast("int")).over(so_far))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(doc, "__block").agg(F.min(order).alias(order), F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias(text)).drop("__block")


def keyword_windows(text: Column, keywords: Sequence[str], *, width: int = 900, apart: int = 240, most: int = 6) -> Column:
    """Texts around hits of the keywords, keyword by keyword; a hit whose window begins within `apart` of a kept one's is left out."""
    low = F.lower(text)

    def hits(word: str) -> Column:
        parts = F.split(low, "\\Q" + word + "\\E", -1)
        start = F.struct(F.lit(0).alias("end"), F.expr("cast(array() as array<int>)").alias("at"))
        walked = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, lambda acc, p: F.struct((acc["end"] + F.length(p) + len(word)).alias("end"), F.array_append(acc["at"], acc["end"] + F.length(p)).alias("at")))
        return F.when(F.size(parts) > 1, walked["at"]).otherwise(start["at"])

    lefts = F.transform(F.concat(*(hits(k.lower()) for k in keywords)), lambda at: F.greatest(F.lit(0), at - width // 2))
    pairs = F.zip_with(lefts, F.concat(*(hits(k.lower()) for k in keywords)), lambda left, at: F.struct(left.alias("left"), at.alias("at")))
    none = F.expr("cast(array() as array<struct<left:int,at:int>>)")
    kept = F.aggregate(pairs, none, lambda acc, x: F.when((F.size(acc) < most) & ~F.exists(acc, lambda y: F.abs(y["left"] - x["left"]) < apart), F.array_append(acc, x)).otherwise(acc))
    return F.transform(kept, lambda x: F.substring(text, x["left"] + 1, x["at"] + width // 2 - x["left"]))


def chinese_number(text: Column) -> Column:
    """0 to 99 as Chinese numerals; null where the text is none."""
    table = F.create_map(*(F.lit(x) for kv in CHINESE_DIGITS.items() for x in kv))
    left = F.substring_index(text, "十", 1)
    right = F.substring(text, F.instr(text, "十") + 1, F.length(text))
    tens = F.when(left == "", 1).otherwise(F.try_element_at(table, left))
    ones = F.when(right == "", 0).otherwise(F.try_element_at(table, right))
    return F.coalesce(F.try_element_at(table, text), F.when(F.contains(text, F.lit("十")), tens * 10 + ones))


def monotone_progress(events: DataFrame, key: str, order: str, stage: str, percent: str) -> DataFrame:
    """The progress after each event: never falls, but for stages that reset it; an event without a number changes nothing."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    clamped = F.greatest(F.lit(0), F.least(F.lit(100), F.col(percent).cast("int")))
    rows = events.withColumn("__v", F.when(F.col(percent).isNotNull(), clamped))
    rows = rows.withColumn("__run", F.sum((F.col(stage).isin(*RESET_STAGES) & F.col("__v").isNotNull()).cast("int")).over(w))
    return rows.withColumn("progress", F.max("__v").over(Window.partitionBy(key, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("__v", "__run")


def marker_status(key: Column) -> Column:
    return ladder(*((key.endswith(f".{m}.json"), m) for m in MARKERS), default="other")


def stage_complete(stage: Column, files: Column) -> Column:
    """Whether a job has the files of its stage."""
    has = lambda *names: F.arrays_overlap(files, F.array(*(F.lit(n) for n in names)))
    wants = F.when(stage == "mineru", has("content_list_v2.json", "content_list.json")).when(stage == "minerupopo", has("document_tree.json", "popo_raw.json")).when(stage.isin("raw", "clean"), has("clean.md"))
    return has("manifest.json") & F.coalesce(wants, F.lit(False))


def asset_usable(files: Column, official: Column) -> Column:
    return F.arrays_overlap(files, F.array(F.lit("content_list_v2.json"), F.lit("content_list.json"))) | (F.coalesce(official, F.lit(0)) > 0)


def review_stage(*told: Column) -> Column:
    """`clean` or `raw`, from the first value that holds either; else `parse`."""
    rules = [(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word)), word) for c in told for word in ("clean", "raw")]
    return ladder(*rules, default="parse")


def doc_succeeded(stage: Column, status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return s.isin(*DOC_SUCCEEDED) | reduce(Column.__or__, (s == F.concat(stage, F.lit(f"_{end}")) for end in ("succeeded", "completed", "done", "done_frozen")))


def batch_ended(status: Column) -> Column:
    return F.lower(F.coalesce(status, F.lit(""))).isin(*BATCH_ENDED)


def decision_status(decision: Column) -> Column:
    return ladder((decision == "accept", "project_accepted"), (decision.isin("rerun_raw", "rerun_clean", "rerun_standard", "upstream_limited"), "fix_proposed"), (decision == "reject", "project_rejected"), default="rejected")


def root_cause(issue: Column, note: Column, raw_available: Column) -> Column:
    """struct(stage, label, target, confidence) of an issue; notes are read for `needs_ai_check`."""
    def cause(stage, label, target, confidence) -> Column:
        return F.struct(F.lit(stage).alias("stage"), F.lit(label).alias("label"), F.lit(target).alias("target"), F.lit(confidence).alias("confidence"))

    text = F.lower(F.coalesce(note, F.lit("")))
    said = reduce(lambda chain, rule: chain.when(_any_in(text, rule[0]), cause(*rule[1])), NOTE_CAUSES[1:], F.when(_any_in(text, NOTE_CAUSES[0][0]), cause(*NOTE_CAUSES[0][1])))
    said = said.when(_any_in(text, ORDER_WORDS) & raw_available, cause("raw_outline", "anchor_application", "raw", 0.56)).otherwise(cause(*_UNKNOWN))
    out = F.when(issue == "needs_ai_check", said)
    for name, fixed in ROOT_CAUSES.items():
        out = out.when(issue == name, cause(*fixed))
    for name, (with_raw, without, target, confidence) in BY_RAW.items():
        out = out.when((issue == name) & raw_available, cause(*with_raw, target, confidence)).when(issue == name, cause(*without, target, confidence))
    return out.otherwise(cause(*_UNKNOWN))


def disposition(issue: Column, category: Column, action: Column, visual_check: Column, closed: Column) -> Column:
    """What becomes of an image issue; `category` is null without a relation, `closed` says its outcome was accepted by rule and blocks nothing."""
    key = category.isin("exercise_key_figure", "explanation_key_figure") & visual_check
    return ladder(
        ((issue != "missing_raw_image_semantics") | category.isNull(), "needs_review"),
        ((category == "helper_icon") & (action == "compress_keep_near") & ~visual_check, "helper_icon_compact_rendering"),
        (key & closed, "covered_by_visual_outcome"), (key, "real_context_gap"), (category == "explanation_key_figure", "explanation_artifact"), default="needs_review",
    )


def promotion_failures(acceptance: Column, score: Column, open_: Column, unresolved: Column, missing: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return blockers((~acceptance.eqNullSafe("pass"), "acceptance_not_pass"), (zero(score) < 90, "quality_below_90"), (zero(open_) != 0, "open_blocking_review_outcomes"), (zero(unresolved) != 0, "unresolved_blocking_issue_candidates"), (zero(missing) != 0, "missing_images"))


def best_markdown(files: DataFrame, archive: str, name: str, stem: Column) -> DataFrame:
    """The markdown file of each archive: one named like it first, then the least deep, the shortest, the first by
    name; files that end in _pages.md only where there is no other."""
    base = F.regexp_replace(F.substring_index(name, "/", -1), r"\.md$", "")
    pages = F.col(name).endswith("_pages.md")
    depth = F.length(name) - F.length(F.replace(F.col(name), F.lit("/"), F.lit("")))
    rank = F.when(pages, F.struct(pages.alias("p"), F.lit(False).alias("s"), F.lit(0).alias("d"), F.lit(0).alias("l"), F.col(name).alias("n"))).otherwise(F.struct(pages.alias("p"), (base != stem).alias("s"), depth.alias("d"), F.length(name).alias("l"), F.col(name).alias("n")))
    return files.filter(F.col(name).endswith(".md")).groupBy(archive).agg(F.min_by(name, rank).alias("markdown"))


def packet_order(priority: str, page: str, block: str) -> list[Column]:
    """By priority, page, block. Page 0 counts as missing and sorts last with the pages not known, as in the source."""
    return [F.col(priority).asc(), F.coalesce(F.nullif(F.col(page), F.lit(0)), F.lit(10**9)).asc(), F.col(block).asc()]
