"""Runs, jobs, write-backs and small classifiers of the review workflow, as DataFrame operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import blockers, ladder

#: Old names of parser back ends and their present ones.
BACKENDS = {
    "PIPELINE": "pipeline", "VLM": "vlm", "HYBRID": "hybrid", "VLM_TRANSFORMERS": "vlm-engine", "VLM_SGLANG_ENGINE": "vlm-engine", "VLM_SGLANG_CLIENT": "vlm-http-client", "VLM_AUTO_ENGINE": "vlm-engine", "vlm-auto-engine": "vlm-engine",
    "VLM_HTTP_CLIENT": "vlm-http-client", "HYBRID_AUTO_ENGINE": "hybrid-engine", "hybrid-auto-engine": "hybrid-engine", "HYBRID_HTTP_CLIENT": "hybrid-http-client",
}
REDACTED = "<redacted-presigned-url>"


def contains_if(column: Column, wanted: str | None) -> Column:
    """Whether the column has the wanted part; no wish holds for all."""
    return F.contains(column, F.lit(wanted)) if wanted else F.lit(True)


def between_if(column: Column, low: float | None, high: float | None) -> Column:
    """Whether the column lies within the limits given; with a limit a null does not."""
    limits = [column >= low] * (low is not None) + [column <= high] * (high is not None)
    return reduce(Column.__and__, limits, F.lit(True))


def metadata_status(rows: DataFrame, id_: str, status: str, wanted: str) -> DataFrame:
    """Rows of an outer join by the status of their metadata; `missing` also takes those without any."""
    return rows.filter(F.isnull(id_) | (F.col(status) == "missing") if wanted == "missing" else F.col(status) == wanted)


def target_values(values: Sequence[str]) -> list[str]:
    """Trimmed, each once, in order, no empty ones."""
    return list(dict.fromkeys(v.strip() for v in values if v and v.strip()))


def targets(rows: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that are in every list of wanted values; an empty list takes all."""
    return reduce(lambda r, w: r.filter(F.coalesce(F.col(w[0]).cast("string"), F.lit("")).isin(w[1])) if w[1] else r, [(c, target_values(v)) for c, v in wanted.items()], rows)


def depth_manifest(key: Column, prefix: str, levels: int = 4) -> Column:
    """Whether a key is a manifest exactly `levels` below the prefix."""
    parts = F.filter(F.split(key, "/"), lambda p: p != "")
    depth = len([p for p in prefix.split("/") if p])
    return (F.size(parts) == depth + levels) & F.startswith(F.array_join(parts, "/"), F.lit(prefix.strip("/") + "/")) & (F.element_at(parts, -1) == "manifest.json")


def origin(manifest: Column, key: Column) -> Column:
    """Which tool wrote an output, by what its manifest says or where it lies; the first that fits."""
    text, where = F.lower(manifest), F.lower(key)
    said = lambda *parts: reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in parts))
    return ladder((said("legacy_selfloop") | F.startswith(where, F.lit("latex/")), "legacy_selfloop"), (said("codex_skill") | F.startswith(where, F.lit("codex-elegantbook/")), "codex_skill"), (said("refine-elegantbook-latex", "latex_polish_report", "editorial_decisions"), "codex_refined"), default="codex_elegantbook")


def placeholder(name: Column) -> Column:
    """Whether a name is a generated one: it begins with pdf- and its last part has no dot."""
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return F.startswith(trimmed, F.lit("pdf-")) & ~F.contains(F.substring_index(trimmed, "/", -1), F.lit("."))


def display_name(title: Column, filename: Column, key: Column) -> Column:
    """File name, else title, unless empty or generated; else the last part of the key; else whatever there is."""
    real = lambda c: F.when((F.trim(c) != "") & ~placeholder(c), F.trim(c))
    full = lambda c: F.when(c != "", c)
    return F.coalesce(real(filename), real(title), full(F.substring_index(key, "/", -1)), full(filename), title)


def redact_urls(text: Column) -> Column:
    """Presigned addresses out of a text or a JSON document: every quoted string that holds one, or the whole text."""
    quoted = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*X-Amz-(?:[^"\\]|\\.)*"|(?<="(?:source_)?url": {0,4})"(?:[^"\\]|\\.)*Signature=(?:[^"\\]|\\.)*"', f'"{REDACTED}"')
    return F.when(F.rlike(text, F.lit(r"^\s*[\[{]")), quoted).when(F.contains(text, F.lit("X-Amz-")), REDACTED).otherwise(text)


def backend(value: Column, default: str = "hybrid-engine") -> Column:
    """The present name of a back end; an unknown one stays, null is the default."""
    names = F.create_map(*(F.lit(x) for pair in BACKENDS.items() for x in pair))
    return F.coalesce(names[value], value, F.lit(default))


def backend_supported(value: Column) -> Column:
    name = backend(value, "")
    return (name == "pipeline") | F.startswith(name, F.lit("vlm-")) | F.startswith(name, F.lit("hybrid-"))


def byte_range(header: Column, size: Column) -> Column:
    """(start, end, ok) of a Range header, both inclusive; null without a single proper range; ok is false where it can't be served."""
    spec = F.trim(F.regexp_extract(header, r"(?i)^bytes=(.*)$", 1))
    low, high = F.trim(F.substring_index(spec, "-", 1)).try_cast("long"), F.trim(F.regexp_extract(spec, "^[^-]*-(.*)$", 1))
    proper = F.rlike(spec, F.lit(r"^\s*(?:\d+\s*-\s*\d*|-\s*\d+)\s*$"))
    suffix = F.startswith(spec, F.lit("-"))
    start = F.when(suffix, F.greatest(F.lit(0), size - high.try_cast("long"))).otherwise(low)
    end = F.when(suffix | (high == ""), size - 1).otherwise(high.try_cast("long"))
    zero = suffix & (high.try_cast("long") <= 0)
    return F.when(proper & ~zero, F.struct(start.alias("start"), F.least(end, size - 1).alias("end"), ((start < size) & (end >= start)).alias("ok")))


def run_stamp(value: Column) -> Column:
    """The first stamp of 14 digits that begins with 20, else empty."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"(20[0-9]{12})", 1)


def source_text(parts: Column) -> Column:
    """Parts without tags, white space collapsed, each once, joined by spaces."""
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", " "), r"\s+", " "), "^ | $", ""))
    return F.array_join(F.array_distinct(F.filter(clean, lambda p: p != "")), " ")


def question_run(text: Column) -> Column:
    """The questions of a text that consists of several and nothing else; else an empty array."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^?]+\?"), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return F.when((F.size(parts) > 1) & (bare(F.array_join(parts, "")) == bare(text)), parts).otherwise(F.array().cast("array<string>"))


def answer_run(text: Column) -> Column:
    """The short answers of a text that begins with Yes or No, if there are several; else an empty array."""
    parts = F.filter(F.transform(F.split(text, r"(?<=\.)\s*(?=(?:Yes|No),)"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.rlike(text, F.lit("^(?i:yes|no),")) & (F.size(parts) > 1), parts).otherwise(F.array().cast("array<string>"))


def absolute_images(markdown: Column, base: str, root: str) -> Column:
    """Markdown images with relative targets made absolute below root and base."""
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\((?!https?://|data:)/*([^)]+)\)", f"![$1]({root}/{base}/$2)")


def text_shapes(text: Column) -> Column:
    """All shapes that a block's text has; formula_or_text where it has none."""
    bare = F.trim(text)
    found = blockers((F.contains(text, F.lit("![")), "markdown_image"), (F.contains(F.lower(text), F.lit("<table")), "html_table"), (F.rlike(bare, F.lit(r"^[A-H][\s\-.()]")), "option_line"), (F.rlike(bare, F.lit("^[①-⑳]")), "circled_item"), (F.rlike(text, F.lit("STEP|Step")), "procedure_text"), (F.length(text) < 20, "short_formula"), (F.length(text) > 180, "long_text_with_formula"))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("formula_or_text")))


def recommended_action(bucket: Column, shapes: Column, packet: Column) -> Column:
    """What a reviewer does next about a packet without a place."""
    #: The action of each bucket.
    by_bucket = {"ambiguous_math_normalized_match": "manual_select_source_candidate_or_add_disambiguation_rule", "ambiguous_short_global_match_needs_manual": "manual_review_short_global_candidate", "too_short_for_location_rule": "manual_source_crop_or_context_window_locator_required", "no_math_normalized_raw_match": "raw_text_sequence_or_context_window_locator_required"}
    return ladder((packet == "table_visual_review", "table_source_locator_or_manual_crop_review"), (F.array_contains(shapes, "markdown_image"), "reclassify_formula_packet_or_route_to_image_relation_review"), *((bucket == k, v) for k, v in by_bucket.items()), default="manual_review_required")


def mismatch_bucket(has_box: Column, has_crop: Column, clean_key: Column, source_key: Column, ratio: Column) -> Column:
    """How far a formula agrees with its source, and what is missing to tell."""
    return ladder((~has_box, "needs_page_bbox"), (~has_crop, "needs_source_crop"), ((clean_key != "") & (clean_key == source_key), "deterministic_formula_semantic_equivalent"), (ratio >= 0.98, "near_equivalent_needs_manual_review"), default="semantic_mismatch_needs_manual_review")


def surface_risk(clean: Column, digit_spacing: Column, same_compact: Column, same_words: Column) -> Column:
    """How safe it is to take a formula's source for its clean text."""
    surface = same_compact | same_words
    return ladder((digit_spacing, "digit_spacing_review"), (~surface, "surface_diff_review"), ((F.length(clean) > 180) & ~same_compact, "long_mixed_review"), (F.rlike(F.trim(clean), F.lit(r"^\([A-DＡ-Ｄ]\)")), "short_option_surface_safe"), (same_compact, "compact_surface_safe"), default="punctuation_spacing_safe")


def same_box(a: Sequence[Column], b: Sequence[Column], within: float = 1.0) -> Column:
    return reduce(Column.__and__, (F.abs(x - y) <= within for x, y in zip(a, b, strict=True)))


def cross_checked(raw: DataFrame, assigned: DataFrame, doc: str, index: str, order: str, check: Column, take: Sequence[str]) -> DataFrame:
    """Raw rows with the assignment of the place after theirs (columns a.*), taken only where the check holds: matched, mismatched or none."""
    r, a = raw.alias("r"), assigned.alias("a")
    joined = r.join(a, (F.col(f"r.{doc}") == F.col(f"a.{doc}")) & (F.col(f"r.{index}") + 1 == F.col(f"a.{order}")), "left")
    good = F.coalesce(check, F.lit(False))
    verdict = F.when(F.isnull(f"a.{order}"), "none").when(good, "matched").otherwise("mismatched")
    return joined.select("r.*", *(F.when(good, F.col(f"a.{c}")).alias(f"assigned_{c}") for c in take), verdict.alias("verdict"))


def last_unpublished(runs: DataFrame, key: str, time: str, unique: str, published: Column) -> DataFrame:
    """For each key its newest unpublished run after the newest published one. Two mergeable maxima: no window, whatever the key's size."""
    newest = runs.groupBy(key).agg(F.max(F.when(published, F.col(time))).alias("published_at"), F.max(F.when(~published, F.struct(time, unique))).alias("u"))
    after = F.isnull("published_at") | (F.col(f"u.{time}") > F.col("published_at"))
    return newest.filter(F.col("u").isNotNull() & after).select(key, F.col(f"u.{unique}").alias(unique), F.col(f"u.{time}").alias(time))


def stale(status: Column, started: Column, now: Column, alive: Column, seconds: int = 300) -> Column:
    """Whether a queued or running run without a live worker is older than the limit."""
    return F.coalesce(status.isin("queued", "running") & (F.unix_timestamp(now) - F.unix_timestamp(started) >= seconds) & ~alive, F.lit(False))


def enqueue(wanted: DataFrame, jobs: DataFrame, key: Sequence[str], status: str, active: Sequence[str] = ("queued", "running", "dry_run_succeeded", "succeeded")) -> DataFrame:
    """Wanted jobs, each once, that no active or finished job of the same key stands against."""
    return wanted.dropDuplicates(list(key)).join(jobs.filter(F.col(status).isin(*active)).select(*key).distinct(), list(key), "left_anti")


def job_transition(action: Column, status: Column, attempts: Column) -> Column:
    """(status, attempts, ok) after a cancel or retry; what the present status does not allow changes nothing."""
    cancel = (action == "cancel") & status.isin("queued", "running", "dry_run_succeeded")
    retry = (action == "retry") & status.isin("failed", "cancelled")
    return F.struct(F.when(cancel, "cancelled").when(retry, "queued").otherwise(status).alias("status"), (F.coalesce(attempts, F.lit(0)) + retry.cast("int")).alias("attempts"), (cancel | retry).alias("ok"))


def after_invalidation(clean: Column, raw: Column, popo: Column, mineru: Column, stage: Column) -> Column:
    """The stage of a material whose clean version is void; without one its stage stays."""
    return F.when(F.isnull(clean), stage).otherwise(ladder((raw.isNotNull(), "clean_stale"), (popo.isNotNull(), "popo_done"), (mineru.isNotNull(), "mineru_done"), default="input"))


def write_back(rows: DataFrame, evidence: DataFrame, key: Sequence[str], bucket: str, allowed: Sequence[str], take: Sequence[str], missing: Column) -> DataFrame:
    """Rows that miss a place take it from the one piece of evidence in an allowed bucket; two pieces or more decide nothing.
    The change says filled, ambiguous, kept or open."""
    fit = evidence.filter(F.col(bucket).isin(*allowed)).groupBy(*key).agg(F.count("*").alias("__n"), *(F.min(c).alias(f"__{c}") for c in take))
    joined = rows.join(fit, list(key), "left")
    fills = missing & (F.coalesce("__n", F.lit(0)) == 1)
    change = F.when(~missing, "kept").when(fills, "filled").when(F.col("__n") > 1, "ambiguous").otherwise("open")
    return joined.select(*(F.when(fills, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in take else F.col(c) for c in rows.columns), change.alias("change"))


def batches(items: DataFrame, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
    """For each batch its size and, for every counted column, `value:count` pairs, sorted. Two mergeable aggregates."""
    long = items.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in counted))).alias("p"))
    counts = long.groupBy(*keys, "p.field", "p.value").agg(F.count("*").alias("n"))
    said = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.concat_ws(":", "value", "n")))), ",").alias(f"{c}_counts")
    total = F.sum(F.when(F.col("field") == counted[0], F.col("n"))).alias("n_items")
    return counts.groupBy(*keys).agg(total, *map(said, counted))
