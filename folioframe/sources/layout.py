"""Layout JSON as VARIANT values, walked level by level in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.sources.sinks import stored

#: Keys under which a node holds others.
BELOW = ("para_blocks", "layout_dets", "blocks")
#: Levels that are walked before the rows are written.
AT_ONCE = 3
_KEYS = (*BELOW, "text", "lines", "bbox", "poly", "type", "category_type")
_NUMBERS = "^ARRAY<(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"
_LINES = "trim(array_join(transform(flatten(transform(try_variant_get(o.lines, '$', 'array<struct<spans:array<struct<content:string>>>>'), l -> coalesce(l.spans, array()))), s -> coalesce(s.content, '')), ' '))"
_LIST = "try_variant_get({0}, '$', 'array<variant>')"


def _level(nodes: DataFrame) -> DataFrame:
    """Each open node of (id, page_idx, path, v, whole, type, text, bbox) as found, or the nodes below it; found ones as they are."""
    fields = ", ".join(f"{k}: variant" for k in _KEYS)
    # One look for all keys of an object (null where v is none); what only some nodes have is read only there.
    seen = nodes.withColumn("o", F.expr(f"try_variant_get(v, '$', 'struct<{fields}>')"))
    seen = seen.withColumn("said", F.expr(f"CASE WHEN o.text IS NOT NULL AND schema_of_variant(o.text) = 'STRING' THEN try_variant_get(o.text, '$', 'string') WHEN o.lines IS NOT NULL THEN {_LINES} END"))
    seen = seen.withColumn("raw", F.expr(f"CASE WHEN said <> '' THEN if(o.bbox IS NOT NULL AND size({_LIST.format('o.bbox')}) > 0, o.bbox, o.poly) END"))
    seen = seen.withColumn("n", F.expr(f"CASE WHEN raw IS NOT NULL AND schema_of_variant(raw) RLIKE '{_NUMBERS}' THEN try_variant_get(raw, '$', 'array<double>') END"))
    at = lambda k: F.filter("n", lambda _, i: i % 2 == k)
    filled = F.when(F.size("n") == 4, F.col("n")[0].isNotNull() & F.col("n")[1].isNotNull() & F.col("n")[2].isNotNull() & F.col("n")[3].isNotNull()).otherwise(~F.exists("n", lambda x: x.isNull()))
    box = F.when(F.size("n") == 4, F.col("n")).when((F.size("n") >= 8) & (F.size("n") % 2 == 0), F.array(F.array_min(at(0)), F.array_min(at(1)), F.array_max(at(0)), F.array_max(at(1))))
    seen = seen.withColumn("box", F.when(filled, box)).withColumn("here", F.col("box").isNotNull())
    # Elements of lists and what is no list, key after key; a list that is a node itself comes alone.
    seen = seen.select("*", *(F.expr(f"CASE WHEN NOT here AND o.{k} IS NOT NULL THEN {_LIST.format(f'o.{k}')} END").alias(f"l{i}") for i, k in enumerate(BELOW)), F.expr(f"CASE WHEN o IS NULL AND v IS NOT NULL THEN {_LIST.format('v')} END").alias("own"))
    each = [F.expr(f"CASE WHEN l{i} IS NOT NULL THEN l{i} WHEN NOT here AND o.{k} IS NOT NULL THEN array(o.{k}) ELSE CAST(array() AS array<variant>) END") for i, k in enumerate(BELOW)]
    seen = seen.select("*", *(e.alias(f"e{i}") for i, e in enumerate(each)))
    below = F.expr("CASE WHEN whole OR here THEN array(CAST(NULL AS variant)) WHEN own IS NOT NULL THEN own WHEN o IS NOT NULL THEN concat(e0, e1, e2) END")
    kind = F.expr("CASE WHEN here THEN coalesce(try_variant_get(o.type, '$', 'string'), try_variant_get(o.category_type, '$', 'string')) ELSE type END")
    kept = [kind.alias("type"), F.expr("CASE WHEN here THEN said ELSE text END").alias("text"), F.expr("CASE WHEN here THEN box ELSE bbox END").alias("bbox")]
    sizes = [F.size(f"e{i}").alias(f"n{i}") for i in range(len(BELOW))]
    told = seen.select("id", "page_idx", "path", (F.col("whole") | F.col("here")).alias("whole"), *kept, F.col("own").isNotNull().alias("listed"), *(F.col(f"l{i}").isNotNull().alias(f"l{i}") for i in range(len(BELOW))), *sizes, F.posexplode_outer(below).alias("at", "v"))
    step, first = F.when(F.col("whole"), F.lit("")).when(F.col("listed"), F.concat(F.lit("["), "at", F.lit("]"))), F.lit(0)
    for i, k in enumerate(BELOW):
        step = step.when(F.col("at") < first + F.col(f"n{i}"), F.when(F.col(f"l{i}"), F.concat(F.lit(f".{k}["), F.col("at") - first, F.lit("]"))).otherwise(F.lit(f".{k}")))
        first = first + F.col(f"n{i}")
    return told.filter("whole OR v IS NOT NULL").select("id", "page_idx", F.concat("path", step).alias("path"), "v", "whole", "type", "text", "bbox")


def layout_nodes(docs: DataFrame, id_: str, json: str) -> DataFrame:
    """(id_, page_idx, path, type, text, bbox) of all nodes of pdf_info that have a box and a text; the walk does not go below them.

    A box is bbox or poly: four numbers, or eight and more of which the outer edges count; anything else in it makes it none. A text is a string, or the
    contents of lines and spans. A page without page_idx has its place. Nodes are objects below the keys of BELOW or in lists below these, however deep: AT_ONCE levels are one
    step for all documents at once, written to the shared folder, until no document has an open node. JSON that does not parse has no nodes. Ids are kept as they are, rows that repeat too."""
    spark = docs.sparkSession
    open_ = spark.sql(f"SELECT `{id_}` AS id, coalesce(try_variant_get(p.value, '$.page_idx', 'int'), p.pos) AS page_idx, concat('[', p.pos, ']') AS path, p.value AS v, false AS whole, CAST(NULL AS STRING) AS type, CAST(NULL AS STRING) AS text, CAST(NULL AS array<double>) AS bbox FROM {{t}}, LATERAL variant_explode(try_variant_get(try_parse_json(`{json}`), '$.pdf_info', 'variant')) AS p", t=docs)
    found = None
    while True:
        for _ in range(AT_ONCE):
            open_ = _level(open_)
        done = stored(open_)
        own = done.filter("whole").select("id", "page_idx", "path", "type", "text", "bbox")
        found = own if found is None else found.unionByName(own)
        open_ = done.filter("NOT whole")
        if open_.isEmpty():
            return found.withColumnRenamed("id", id_)
