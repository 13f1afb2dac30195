"""Review algebra: outcomes, closure, gates, scores, corpus rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import blockers, ladder


def outcome_id(kind: Column, block: Column) -> Column:
    return F.concat(F.lit("visual:"), kind, F.lit(":"), block)


def outcome_bucket(has_box: Column, has_crop: Column, same: Column, same_compact: Column, compact_size: Column, has_content: Column) -> Column:
    """What a table or formula packet still lacks, in order."""
    return ladder((~has_box, "missing_bbox"), (~has_crop, "missing_crop"), (~has_content, "no_source_content"), (same, "exact"), (same_compact & (compact_size >= 40), "compact"), default="mismatch")


def closure(status: Column, bucket: Column, rule: Column) -> Column:
    """The next status: closed rows stay; rules that end in `for manual review` never close."""
    manual = rule.endswith("for manual review")
    return ladder((status != "open", "unchanged"), (bucket == "missing_bbox", "needs_source_bbox"), (bucket == "missing_crop", "needs_source_crop"), (bucket.isin("exact", "compact") & ~manual, "accepted"), default="needs_layout_review")


def image_outcome(key_image: Column, has_image: Column, has_crop: Column, has_box: Column, width: Column, height: Column, delta: Column) -> Column:
    """The nine-step decision for images."""
    area, side = width * height, F.least(width, height)
    return ladder((~key_image, "not_required"), (~has_image, "image_missing"), (~has_crop, "crop_missing"), (~has_box, "bbox_missing"), (width.isNull() | height.isNull(), "size_unreadable"), (delta > 0.10, "aspect_differs"), (area < 25000, "area_small"), (side < 120, "side_small"), default="accepted")


def quality_score(*, changed: Column, corrections: Column, evidence: Column, open_: Column, outline_ok: Column, unknown_ratio: Column, n_types: Column, unresolved: Column, needs_review: Column, media_ok: Column, print_ok: Column) -> Column:
    """Sections of 25, 20, 20, 15, 15 and 5 points with deductions; halves round to even, divisions cut."""
    off = lambda c, n: F.when(c, n).otherwise(0)
    fidelity = F.greatest(F.lit(0), F.lit(25) - off(changed, 8) - off((corrections > 0) & evidence, 6) - off((corrections > 0) & ~evidence, 5) - off(open_ > 0, 2))
    structure = F.lit(20) - off(~outline_ok, 6) - F.least(F.lit(5), F.bround(unknown_ratio * 20).cast("int")) - off(n_types == 0, 4)
    context = F.lit(20) - off(unresolved > 0, 1) * F.least(F.lit(8), F.greatest(F.lit(2), F.floor(unresolved / 4).cast("int"))) - F.least(F.lit(4), F.floor(needs_review / 10).cast("int"))
    media = F.lit(15) - off(~media_ok, 7) - off(open_ > 0, 1) * F.least(F.lit(4), F.greatest(F.lit(1), F.floor(open_ / 10).cast("int")))
    printed = F.lit(15) - off(~print_ok, 8)
    return (fidelity + structure + context + media + printed + 5).cast("int")


def score_status(score: Column, any_fail: Column, nothing_open: Column) -> Column:
    return ladder((any_fail | (score < 75), "fail"), ((score >= 90) & nothing_open, "pass"), default="review")


def acceptance(gates: DataFrame, key: str, status: str) -> DataFrame:
    """Any fail fails, any review reviews, else it passes; a mergeable maximum of severities."""
    severity = F.when(F.col(status) == "fail", 2).when(F.col(status) == "review", 1).otherwise(0)
    return gates.groupBy(key).agg(F.max(severity).alias("__s"), F.count_if(severity == 2).alias("n_fail"), F.count_if(severity == 1).alias("n_review")).withColumn("acceptance", F.element_at(F.array(F.lit("pass"), F.lit("review"), F.lit("fail")), F.col("__s") + 1)).drop("__s")


def product_layer(accepted: Column, certified: Column) -> Column:
    return ladder((accepted == "fail", "blocked"), ((accepted == "pass") & certified, "certified"), default="draft")


def corpus_issues(cases: DataFrame, runs: DataFrame, candidates: DataFrame, golden: DataFrame, policy: DataFrame) -> DataFrame:
    """Each case with what its status expects and does not find, or finds and does not expect."""
    flag = lambda rows, name: rows.select("material_id").distinct().withColumn(name, F.lit(True))
    out = cases.join(flag(runs, "has_run"), "material_id", "left").join(flag(candidates, "has_candidate"), "material_id", "left").join(flag(golden, "has_golden"), "material_id", "left").join(policy, "status", "left").fillna(False, ["has_run", "has_candidate", "has_golden"])
    found = blockers((F.col("expects_run").isNull(), "unknown_status"), (F.col("expects_run") & ~F.col("has_run"), "missing_run"), (F.col("expects_candidate") & ~F.col("has_candidate"), "missing_candidate"), (F.col("expects_golden") & ~F.col("has_golden"), "missing_golden"), (~F.col("expects_golden") & F.col("has_golden"), "unexpected_golden"))
    return out.withColumn("issues", found)


#: Confidence of a root cause by issue type.
ROOT_CAUSE = {"formula": 0.72, "blank": 0.70, "layout": 0.70, "grouping": 0.62, "order": 0.58, "table": 0.56, "missing": 0.52, "noise": 0.52, "ocr": 0.52, "image": 0.50}


def root_cause_confidence(kind: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in ROOT_CAUSE.items())), lambda x: x["k"] == kind), F.lit(0))["v"], F.lit(0.35))


def media_role(width: Column, height: Column, captioned: Column, exercise: Column) -> Column:
    return ladder((exercise, "exercise"), (F.least(width, height) < 80, "small"), (captioned, "captioned"), default="uncaptioned")


def attach_flags(rows: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """Membership of each row's key in the other tables, as booleans."""
    for name, other in others.items():
        rows = rows.join(other.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return rows
