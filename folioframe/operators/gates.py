"""Acceptance gates of documents from their review outcomes, and their refresh after closures: only what changed is aggregated anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import ladder

TABLE_FORMULA = ("table", "formula")
CERTIFIED = 90
GATES = ("outcome_count", "closed_count", "open_blocking_count", "table_formula_open_blocking_count", "correction_count", "corrections_without_evidence", "review_outcomes", "formula_table_integrity", "correction_evidence", "acceptance", "quality_status", "decision_counts")


def gates(outcomes: DataFrame, quality: DataFrame, doc: str) -> DataFrame:
    """One row a document of `quality` (doc, score, quality_status, table_status): its counters, gates and acceptance.

    `outcomes` are (doc, packet, decision, open, blocking, evidence): packet table, formula, image or correction. Open blocking ones set their gates
    to review; table and formula packets decide the gate that `table_status` had before, which stays where a document has none of them; corrections
    without evidence fail. A document whose gates all pass and whose score is CERTIFIED or more passes in quality too. Null flags count as false, null decisions are named ''."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    corrects, of_table = F.col("packet") == "correction", F.col("packet").isin(*TABLE_FORMULA)
    counted = outcomes.withColumn("decision", F.coalesce("decision", F.lit(""))).groupBy(doc, "decision").agg(
        F.count_if(~corrects).alias("outcomes"), F.count_if(~corrects & ~flag("open")).alias("closed"), F.count_if(~corrects & flag("open") & flag("blocking")).alias("blocking"), F.count_if(of_table).alias("tables"),
        F.count_if(of_table & flag("open") & flag("blocking")).alias("table_blocking"), F.count_if(corrects).alias("corrections"), F.count_if(corrects & ~flag("evidence")).alias("bare"),
    )
    named = F.when(F.col("outcomes") > 0, F.concat_ws("=", "decision", F.col("outcomes").cast("string")))
    total = counted.groupBy(doc).agg(*(F.sum(c).alias(c) for c in ("outcomes", "closed", "blocking", "tables", "table_blocking", "corrections", "bare")), F.array_join(F.array_sort(F.collect_list(named)), ",").alias("decision_counts"))
    rows = quality.join(total, doc, "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    review = lambda c: F.when(n(c) > 0, "review").otherwise("pass")
    rows = rows.withColumn("review_outcomes", review("blocking")).withColumn("formula_table_integrity", F.when(n("tables") > 0, review("table_blocking")).otherwise(F.col("table_status"))).withColumn("correction_evidence", F.when(n("bare") > 0, "fail").otherwise("pass"))
    of_gates = F.array("review_outcomes", "formula_table_integrity", "correction_evidence")
    rows = rows.withColumn("acceptance", ladder((F.array_contains(of_gates, "fail"), "fail"), (F.array_contains(of_gates, "review"), "review"), default="pass"))
    rows = rows.withColumn("quality_status", F.when((F.col("acceptance") == "pass") & (F.coalesce("score", F.lit(0)) >= CERTIFIED), "pass").otherwise(F.col("quality_status")))
    counts = {"outcome_count": "outcomes", "closed_count": "closed", "open_blocking_count": "blocking", "table_formula_open_blocking_count": "table_blocking", "correction_count": "corrections", "corrections_without_evidence": "bare"}
    return rows.select(doc, *(n(c).alias(name) for name, c in counts.items()), "review_outcomes", "formula_table_integrity", "correction_evidence", "acceptance", "quality_status", F.coalesce("decision_counts", F.lit("")).alias("decision_counts"))


def state_of(outcomes: DataFrame, doc: str) -> DataFrame:
    """(doc, state): a digest of a document's outcomes that does not depend on their order."""
    row = F.xxhash64("packet", "decision", "open", "blocking", "evidence").cast("decimal(38,0)")
    return outcomes.groupBy(doc).agg(F.struct(F.count("*").alias("n"), F.sum(row).alias("s"), F.sum(F.pmod(row, F.lit(1_000_003)) * F.pmod(row, F.lit(999_983))).alias("m")).alias("state"))


def changed_documents(before: DataFrame, outcomes: DataFrame, doc: str) -> DataFrame:
    """The documents whose outcomes are not those of `before` (doc, state): some changed, were added, or all went."""
    now = state_of(outcomes, doc).select(F.col(doc).alias("__doc"), F.col("state").alias("__now"))
    both = before.join(now, F.col(doc).eqNullSafe(F.col("__doc")), "full")
    return both.filter(~F.col("state").eqNullSafe(F.col("__now"))).select(F.coalesce(doc, "__doc").alias(doc)).distinct()


def refresh(kept: DataFrame, changed: DataFrame, outcomes: DataFrame, quality: DataFrame, doc: str) -> DataFrame:
    """`kept`, the gates as they were, with those of the `changed` documents aggregated anew; `refreshed` tells which.

    The rows of other documents are filtered out of `outcomes` before anything is grouped; a changed document that `kept` lacks is added."""
    own = changed.select(doc)
    anew = gates(outcomes.join(own, doc, "left_semi"), quality.join(own, doc, "left_semi"), doc).withColumn("refreshed", F.lit(True))
    return kept.join(own, doc, "left_anti").select(doc, *GATES).withColumn("refreshed", F.lit(False)).unionByName(anew)


def closed(outcomes: DataFrame, accept: Column) -> DataFrame:
    """Outcomes with those that `accept` holds for closed as accepted; closed ones stay."""
    closes = F.coalesce(accept, F.lit(False)) & F.coalesce(F.col("open"), F.lit(False))
    return outcomes.withColumn("decision", F.when(closes, "accepted").otherwise(F.col("decision"))).withColumn("open", F.when(closes, False).otherwise(F.col("open")))
