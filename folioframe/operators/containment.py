"""Many needles in many texts, word by word, with the places of every occurrence: a multi-pattern automaton in bounded blocks.

Needles and texts are compared as words with one space between. Needles come in blocks of about BLOCK_BYTES; a block is broadcast,
each Python worker builds its automaton once, and one pass over the texts finds all its needles at once, so that time does not grow with
the number of needles in a block. Only occurrences leave the pass, never texts.

`located` takes pages of documents and finds occurrences that run over page ends too: prefix sums over the lengths of the pages
give each place its page.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are what stands between these characters.
SPACES = r"[ \t\n\r\f\x0B]+"
_WORD = re.compile(r"[^ \t\n\r\f\x0B]+")
BLOCK_BYTES = 4 << 20


@lru_cache(maxsize=1)
def _automaton(name: str, needles) -> ahocorasick.Automaton:
    """The automaton of a broadcast list of (id, spaced words); equal words are one pattern with several ids."""
    made, places = ahocorasick.Automaton(), {}
    for id_, words in needles.value:
        places.setdefault(words, []).append(id_)
    for words, ids in places.items():
        made.add_word(words, (len(words), ids))
    made.make_automaton()
    return made


class _Named:
    """A broadcast variable that is hashed by a name of its own, so that a worker builds its automaton once."""

    def __init__(self, broadcast) -> None:
        self.name, self.broadcast = uuid.uuid4().hex, broadcast

    def __hash__(self) -> int:
        return hash(self.name)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Named) and self.name == other.name

    @property
    def value(self):
        return self.broadcast.value


def _find(needles: _Named, kind: T.DataType):
    of_id = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(needles.name, needles)
        for batch in batches:
            docs, found, starts, ends = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                hits = [(end, *hit) for end, hit in machine.iter(f" {' '.join(_WORD.findall(text))} ")] if len(machine) else []
                if not hits:
                    continue
                # In the spaced text the word that begins at p is the one after its space; places of words go back to the text.
                spans = [m.span() for m in _WORD.finditer(text)]
                begin, place = {}, 1
                for w, (a, z) in enumerate(spans):
                    begin[place] = w
                    place += z - a + 1
                last = {p + spans[w][1] - spans[w][0] - 1: w for p, w in begin.items()}
                for end, size, ids in hits:
                    a, z = spans[begin[end - size + 2]][0], spans[last[end - 1]][1]
                    for id_ in ids:
                        docs.append(k)
                        found.append(id_)
                        starts.append(a)
                        ends.append(z)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(found, of_id), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["doc", "id", "start", "end"])

    return run


def occurrences(docs: DataFrame, needles: DataFrame, doc_id: str, text: str, needle_id: str, needle: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, needle_id, start, end): every occurrence of each needle's words in a row in a text, as code points of the text, end exclusive.

    A null or blank needle occurs nowhere; overlapping occurrences all count; rows of `docs` that repeat give their occurrences as often, rows of `needles` once."""
    spark = docs.sparkSession
    wanted = needles.select(F.col(needle_id).alias("id"), F.trim(F.regexp_replace(F.col(needle), SPACES, " ")).alias("words")).filter("words <> ''").distinct()
    blocks = max(1, -(-(wanted.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes))
    kinds = [rows.schema[c].dataType.simpleString() for rows, c in ((docs, doc_id), (needles, needle_id))]
    out = None
    for b in range(blocks):
        block = [(r.id, f" {r.words} ") for r in wanted.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).collect()]  # about block_bytes
        hits = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("body")).mapInArrow(_find(_Named(spark.sparkContext.broadcast(block)), wanted.schema["id"].dataType), f"doc {kinds[0]}, id {kinds[1]}, start long, end long")
        out = hits if out is None else out.unionByName(hits)
    return out.select(F.col("doc").alias(doc_id), F.col("id").alias(needle_id), "start", "end")


def located(pages: DataFrame, needles: DataFrame, doc: str, page: str, text: str, needle_id: str, needle: str, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc, needle_id, start, end, first_page, last_page): occurrences in the texts of a document's pages, joined by line ends in the order of `page`.

    Places are code points of the joined text; a null page text is an empty one."""
    joined = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("__pages"))
    starts = F.aggregate("__pages", F.expr("array(0L)"), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + F.length(x["t"]) + 1))
    whole = joined.select(F.struct(F.col(doc).alias("doc"), F.transform("__pages", lambda x: x["p"]).alias("pages"), starts.alias("starts")).alias("key"), F.array_join(F.transform("__pages", lambda x: x["t"]), "\n").alias("body"))
    hits = occurrences(whole, needles, "key", "body", needle_id, needle, block_bytes=block_bytes)
    at = lambda place: F.element_at("key.pages", F.size(F.filter("key.starts", lambda s: s <= place)).cast("int"))
    return hits.select(F.col("key.doc").alias(doc), needle_id, "start", "end", at(F.col("start")).alias("first_page"), at(F.col("end") - 1).alias("last_page"))
