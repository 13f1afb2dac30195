"""Byte-level BPE over Arrow batches with the tokenizers library, and its exact reverse.

Each match of the splitting pattern is encoded separately. A batch looks up its distinct matches
first, so the library sees each of them once; ids, offsets and bytes of the texts are then gathered
from flat tables. Decoding takes ids only: it reverses the byte-to-character table of the
vocabulary, joins bytes before it decodes UTF-8, and so handles characters that tokens split.

Nulls and edges: a null or empty text has no tokens and decodes to nothing; special tokens are never
made, their strings are ordinary text; decoding an unknown id raises; repeated rows give repeated
rows; an empty table gives none. Other columns are kept by `encode` and never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, models

from .rows import ragged

#: Distinct matches that a worker remembers between batches.
MEMORY = 200_000
#: Below this code point texts are split by the plain regular expressions of `latin_pattern`, twice as fast.
LATIN = 0x250


def byte_to_character() -> list[str]:
    """The public table of byte-level BPE: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    out, extra = [], 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern with its Unicode classes spelled out for the characters below LATIN; None if it
    holds other escapes than these classes."""
    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        found = regex.compile(name)
        spelled[name] = "".join(re.escape(chr(c)) for c in range(LATIN) if found.match(chr(c)))
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((n for n in spelled if pattern.startswith(n, at)), None)
        if name:
            out.append(spelled[name] if inside else f"[{spelled[name]}]")
        elif pattern.startswith(r"\S", at) and not inside:
            name = r"\S"
            out.append(f"[^{spelled[chr(92) + 's']}]")
        elif pattern[at] == "\\":
            return None
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
        at += len(name) if name else 1
    return re.compile("".join(out))


class ByteBPE:
    """One vocabulary file of ranks, as a tokenizers model with the byte table around it."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.any_split = regex.compile(pattern).findall
        latin = latin_pattern(pattern)
        self.latin_split = latin.findall if latin else None
        self.is_latin = re.compile(f"[\\x00-{chr(LATIN - 1)}]*").fullmatch
        self.table = byte_to_character()
        self.byte_of = {c: b for b, c in enumerate(self.table)}
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        mapped = {token: "".join(self.table[b] for b in token) for token in ranks}
        merges = [pair for token, rank in sorted(ranks.items(), key=lambda x: x[1]) if len(token) > 1 and (pair := self._parts(token, rank, ranks))]
        self.model = Tokenizer(models.BPE(vocab={mapped[t]: r for t, r in ranks.items()}, merges=[(mapped[a], mapped[b]) for a, b in merges], ignore_merges=True))
        size = max(ranks.values()) + 1
        self.token_bytes: list[bytes | None] = [None] * size
        for character_form, rank in ((m, ranks[t]) for t, m in mapped.items()):
            self.token_bytes[rank] = bytes(self.byte_of[c] for c in character_form)
        self.lengths = np.array([-1 if t is None else len(t) for t in self.token_bytes], np.int64)
        self.starts = np.cumsum(np.maximum(self.lengths, 0)) - np.maximum(self.lengths, 0)
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.token_bytes), np.uint8)
        decimals = [f"{i} ".encode() for i in range(size)]
        self.decimal_sizes = np.array([len(x) for x in decimals], np.int64)
        self.decimal_starts = np.cumsum(self.decimal_sizes) - self.decimal_sizes
        self.decimals = np.frombuffer(b"".join(decimals), np.uint8)
        self.pieces: dict[str, int] = {}
        self._forget()

    @staticmethod
    def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
        """The two tokens that merge into `token`: what merging its bytes by lower ranks leaves."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)), default=(rank, 0))
            if best[0] >= rank:
                return None
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def split(self, text: str) -> list[str]:
        return self.latin_split(text) if self.latin_split and self.is_latin(text) else self.any_split(text)

    def _forget(self) -> None:
        self.pieces.clear()
        self._ids, self._starts, self._sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Encodes matches not seen so far, as the words of one input."""
        table = self.table
        encoded = self.model.encode(["".join([table[b] for b in x.encode()]) for x in new], is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(new))
        self.pieces.update(zip(new, range(len(self.pieces), len(self.pieces) + len(new)), strict=True))
        self._starts = np.concatenate([self._starts, len(self._ids) + np.cumsum(sizes) - sizes])
        self._sizes = np.concatenate([self._sizes, sizes])
        self._ids = np.concatenate([self._ids, np.array(encoded.ids, np.int32)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the n + 1 positions where the texts begin in them."""
        if len(self.pieces) > MEMORY:
            self._forget()
        matches = [self.split(t) if t else [] for t in texts]
        counts = np.array([len(m) for m in matches], np.int64)
        piece = np.fromiter(map(self.pieces.get, chain.from_iterable(matches), repeat(-1)), np.int64, int(counts.sum()))
        if len(missing := np.flatnonzero(piece < 0)):
            flat = list(chain.from_iterable(matches))
            unknown = [flat[k] for k in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            piece[missing] = [self.pieces[x] for x in unknown]
        sizes = self._sizes[piece]
        ids = self._ids[ragged(self._starts[piece], sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, before[np.concatenate([[0], np.cumsum(counts)])]

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, joined."""
        if len(ids) and (int(ids.min()) < 0 or int(ids.max()) >= len(self.lengths) or (self.lengths[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        return self.flat[ragged(self.starts[ids], self.lengths[ids])]

    def decode(self, ids: np.ndarray, errors: str = "replace") -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes().decode(errors=errors)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the first character and the one after its last; tokens that share a split
        character overlap in it."""
        owner = np.repeat(np.arange(len(text)), [len(c.encode()) for c in text])
        ends = np.cumsum(self.lengths[ids])
        return owner[ends - self.lengths[ids]], owner[ends - 1] + 1

    def decimals_of(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a space."""
        return self.decimals[ragged(self.decimal_starts[ids], self.decimal_sizes[ids])].tobytes()


@lru_cache(maxsize=2)
def bpe(ranks_path: str, pattern: str) -> ByteBPE:
    return ByteBPE(ranks_path, pattern)


def vocabulary() -> tuple[str, str]:
    """The ranks and the pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _groups(column: pa.Array, characters: int = 1 << 18) -> Iterator[tuple[int, list[str | None]]]:
    own, size, at = [], 0, 0
    for k, value in enumerate(column):
        own.append(text := value.as_py())
        size += len(text or "")
        if size >= characters:
            yield at, own
            own, size, at = [], 0, k + 1
    if own:
        yield at, own


def encode(docs: DataFrame, *, text: str = "text", ranks_path: str | None = None, pattern: str | None = None, ids: str = "token_ids", starts: str = "token_starts", ends: str = "token_ends", exact: str = "round_trip", with_offsets: bool = True) -> DataFrame:
    """`docs` with the token ids of `text`, each token's character offsets (if wanted), and whether the ids decode to the text."""
    path, split = vocabulary() if ranks_path is None else (ranks_path, pattern)
    lists = [ids, *([starts, ends] if with_offsets else [])]
    if clash := {*lists, exact} & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, split)
        for batch in batches:
            for low, texts in _groups(batch.column(at)):
                flat, edges = coder.encode(texts)
                plain = coder.decode_bytes(flat).tobytes()
                cuts = np.concatenate([[0], np.cumsum(coder.lengths[flat])])[edges].tolist()
                same = [plain[a:z] == (t or "").encode() for t, a, z in zip(texts, cuts, cuts[1:], strict=False)]
                values = [flat]
                if with_offsets:
                    spans = [coder.offsets(t or "", flat[a:z]) for t, a, z in zip(texts, edges, edges[1:], strict=False)]
                    values += [np.concatenate([s[k] for s in spans]) for k in (0, 1)]
                cut, own = pa.array(edges.astype(np.int32)), batch.slice(low, len(texts))
                found = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in values]
                yield pa.RecordBatch.from_arrays([*own.columns, *found, pa.array(same)], [*own.schema.names, *lists, exact])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in lists), T.StructField(exact, T.BooleanType())])
    return docs.mapInArrow(run, schema)


def round_trip(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of what they decode to."""
    path, split = vocabulary() if ranks_path is None else (ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, split)
        for batch in batches:
            counts, of_ids, decoded = [], [], []
            for _, texts in _groups(batch.column(1)):
                flat, edges = coder.encode(texts)
                counts.extend(np.diff(edges).tolist())
                decimals, at = coder.decimals_of(flat), np.concatenate([[0], np.cumsum(coder.decimal_sizes[flat])])[edges]
                of_ids.extend(hashlib.sha256(decimals[a : max(a, z - 1)]).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False))
                plain, at = coder.decode_bytes(flat), np.concatenate([[0], np.cumsum(coder.lengths[flat])])[edges]
                decoded.extend(hashlib.sha256(plain[a:z]).hexdigest() for a, z in zip(at.tolist(), at[1:].tolist(), strict=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(decoded, pa.string())], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").alias("body")).mapInArrow(run, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc", doc_id)


def op8_rows(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
