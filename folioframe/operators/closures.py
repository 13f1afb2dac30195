"""Closures of open review outcomes by rule, with a reason for each outcome that a rule looks at, and the report after them.

Outcomes are (doc, outcome_id, block_id, packet_type, status, decision, blocking, crop, crop_status); `verdicts` of the three rules are
(doc, outcome_id, rule, reason, closes, evidence). Ids are unique in a document. Null texts count as empty, null flags as false.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as X

#: Packet types, states of a source crop that is there, and what an image-only formula's becomes.
FORMULA, IMAGE = "formula_visual_review", "image_source_visual_confirmation"
READY = ("created", "reused")
RECLASSIFIED = "not_required_image_only_formula_reclassified"
#: Buckets that close, raw types of an exact match, and rules of a semantic one.
EXACT_BUCKET, SEMANTIC_BUCKET = "deterministic_closure_candidate_exact_match", "deterministic_formula_semantic_equivalent"
EXACT_RAW_TYPES = ("text", "equation", "table")
SEMANTIC_RULES = (
    "raw_content_list.formula_semantic_key_match",
    "raw_content_list.math_normalized_unique_same_unit_for_manual_review",
    "raw_content_list.math_normalized_duplicate_same_unit_ordinal_for_manual_review",
    "raw_context_window.compact_exact_same_unit_for_manual_review",
    "raw_context_window.high_confidence_for_manual_review",
    "raw_context_window.short_option_formula_exact_same_unit_for_manual_review",
)
_MARKDOWN_IMAGE, _HTML_IMAGE = r"!\[[^\]]*\]\([^)]+\)", r"(?i)<img\b[^>]*>"


def _said(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def image_only(markdown: Column) -> Column:
    """Whether a text is one or more images and nothing else."""
    bare = F.regexp_replace(F.regexp_replace(markdown, _MARKDOWN_IMAGE, ""), _HTML_IMAGE, "")
    return (F.size(X.image_refs(markdown)) > 0) & (F.regexp_replace(bare, r"\s+", "") == "")


def image_only_formulas(outcomes: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """Open blocking formula outcomes of blocks (doc, block_id, markdown, text) that are images only: closed if the block has no text and an image outcome of
    it is closed by rule with its crop; the first of these, by id, is the evidence."""
    done = (F.col("packet_type") == IMAGE) & (F.col("status") == "closed") & (F.col("decision") == "accepted_by_rule") & F.col("crop_status").isin(*READY) & (_said("crop") != "")
    covered = outcomes.filter(done).groupBy(doc, "block_id").agg(F.min("outcome_id").alias("evidence"))
    asked = outcomes.filter((F.col("packet_type") == FORMULA) & (F.col("status") == "open") & F.coalesce("blocking", F.lit(False)))
    rows = asked.join(blocks.select(doc, "block_id", _said("markdown").alias("__md"), F.trim(_said("text")).alias("__text")), [doc, "block_id"]).filter(image_only(F.col("__md"))).join(covered, [doc, "block_id"], "left")
    reason = X.ladder((F.col("__text") != "", "block_text_not_empty"), (F.col("evidence").isNull(), "closed_image_outcome_missing"), default="image_only_formula_covered_by_image")
    return _verdicts(rows.withColumn("reason", reason), doc, "image_only_formula", "image_only_formula_covered_by_image")


def exact_matches(outcomes: DataFrame, audits: DataFrame, packets: DataFrame, doc: str) -> DataFrame:
    """Outcomes whose audit (doc, outcome_id, bucket, crop, crop_status, page_number, bbox) found the same content in the raw source, as it came
    (packets: doc, outcome_id, match_rule, raw_type, packet_crop_status): closed if no rule had to match it, its raw type is one of EXACT_RAW_TYPES, and page, box and crop are there."""
    audit = audits.filter(F.col("bucket") == EXACT_BUCKET).select(doc, "outcome_id", F.col("crop").alias("__crop"), F.col("crop_status").alias("__status"), "page_number", "bbox")
    rows = outcomes.select(doc, "outcome_id").join(audit, [doc, "outcome_id"]).join(packets.select(doc, "outcome_id", "match_rule", "raw_type", "packet_crop_status"), [doc, "outcome_id"], "left")
    status = F.coalesce(F.nullif("__status", F.lit("")), F.col("packet_crop_status"), F.lit(""))
    reason = X.ladder(
        (_said("match_rule") != "", "source_match_rule_not_native_raw_content"),
        (~_said("raw_type").isin(*EXACT_RAW_TYPES), "source_raw_type_not_allowed"),
        (~status.isin(*READY), "source_crop_not_ready"),
        ((F.coalesce("page_number", F.lit(0)) == 0) | (F.coalesce(F.size("bbox"), F.lit(0)) <= 0), "source_page_bbox_missing"),
        (_said("__crop") == "", "source_crop_missing"),
        default="native_raw_content_exact_match_with_crop",
    )
    return _verdicts(rows.withColumn("reason", reason).withColumn("evidence", F.col("__crop")), doc, "native_exact", "native_raw_content_exact_match_with_crop")


def semantic_matches(outcomes: DataFrame, audits: DataFrame, doc: str, rules: Sequence[str] = SEMANTIC_RULES) -> DataFrame:
    """Outcomes whose formula audit (as above, with semantic_key_equal and match_rule) says that the same formula stands in the source: closed if the keys are equal, one of `rules` matched it,
    and page, box and crop are there."""
    audit = audits.filter(F.col("bucket") == SEMANTIC_BUCKET).withColumnsRenamed({"crop": "__crop", "crop_status": "__status"})
    rows = outcomes.select(doc, "outcome_id").join(audit, [doc, "outcome_id"])
    whole = F.coalesce("semantic_key_equal", F.lit(False)) & _said("match_rule").isin(*rules) & (F.coalesce("page_number", F.lit(0)) != 0) & (F.coalesce(F.size("bbox"), F.lit(0)) > 0) & (_said("__crop") != "") & _said("__status").isin(*READY)
    return _verdicts(rows.withColumn("reason", F.when(whole, "formula_semantic_key_equal").otherwise("evidence_incomplete")).withColumn("evidence", F.col("__crop")), doc, "semantic_equivalent", "formula_semantic_key_equal")


def _verdicts(rows: DataFrame, doc: str, rule: str, closes: str) -> DataFrame:
    good = F.col("reason") == closes
    return rows.select(doc, "outcome_id", F.lit(rule).alias("rule"), "reason", good.alias("closes"), F.when(good, F.coalesce("evidence", F.lit(""))).alias("evidence"))


def closed_by_rule(outcomes: DataFrame, verdicts: DataFrame, doc: str) -> DataFrame:
    """Outcomes with those closed that a verdict closes (of several the first by rule name), and `closing`: newly_closed, already_closed, or null.

    An outcome that was closed by rule before stays as it is. An image-only formula becomes non_blocking, others accepted_by_rule."""
    first = verdicts.filter("closes").groupBy(doc, "outcome_id").agg(F.min("rule").alias("__rule"))
    rows = outcomes.join(first, [doc, "outcome_id"], "left")
    told, image = F.col("__rule").isNotNull(), F.col("__rule") == "image_only_formula"
    already = told & (F.col("status") == "closed") & F.col("decision").isin("accepted_by_rule", "non_blocking")
    now = told & ~F.coalesce(already, F.lit(False))
    rows = rows.withColumn("closing", F.when(now, "newly_closed").when(already, "already_closed"))
    new = F.col("closing").eqNullSafe("newly_closed")
    changes = {"status": F.when(new, "closed").otherwise(F.col("status")), "decision": F.when(new & image, "non_blocking").when(new, "accepted_by_rule").otherwise(F.col("decision")), "blocking": F.when(new, False).otherwise(F.col("blocking")), "crop_status": F.when(new & image, RECLASSIFIED).otherwise(F.col("crop_status"))}
    return rows.withColumns(changes).select(*outcomes.columns, "closing")


def closure_report(outcomes: DataFrame, verdicts: DataFrame, doc: str) -> DataFrame:
    """(doc, n_outcomes, closed_count, open_blocking_count, newly_closed, already_closed, decisions, skipped) of each document after `closed_by_rule`:
    decisions are decision=count, skipped are rule/reason=count of the verdicts that close nothing, both by name."""
    counts = lambda rows, name: rows.groupBy(doc, "__k").agg(F.count("*").alias("n")).groupBy(doc).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "__k", F.col("n").cast("string")))), ",").alias(name))
    total = outcomes.groupBy(doc).agg(F.count("*").alias("n_outcomes"), F.count_if(F.col("status") == "closed").alias("closed_count"), F.count_if((F.col("status") == "open") & F.col("blocking")).alias("open_blocking_count"), F.count_if(F.col("closing") == "newly_closed").alias("newly_closed"), F.count_if(F.col("closing") == "already_closed").alias("already_closed"))
    decisions = counts(outcomes.withColumn("__k", _said("decision")), "decisions")
    skipped = counts(verdicts.filter(~F.col("closes")).withColumn("__k", F.concat_ws("/", "rule", "reason")), "skipped")
    return total.join(decisions, doc, "left").join(skipped, doc, "left").withColumn("skipped", F.coalesce("skipped", F.lit("")))
