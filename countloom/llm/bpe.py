"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts each text into chunks whose borders depend on the nearby bytes alone, so passages that
documents share give equal chunks. A worker encodes each distinct chunk once and keeps it in a bounded table, from
which the chunks that were not met lately leave. A chunk's tokens near its ends can differ from those of the whole text,
so joins are repaired: the text from the last but one *safe point* before a join to the second one after it is encoded
anew, and must agree with both chunks between their two safe points; where it does not, or a chunk has too few, the
region grows by whole chunks until it does. A safe point is a blank between two ASCII letters: the tokenizer's pattern
always starts a piece there, whatever stands around it, so agreement there is exact.

The vocabulary is a parameter: a file of the tokenizers library that holds byte-level BPE with the usual pieces, ids in the
order of merges; what the file asks for beyond (normalizers, other pre-tokenizers, added tokens that are not special)
raises. Its special tokens are recognised in a text as that library does by default. No special tokens are added. Null
and empty texts give no tokens and decode to the empty text; rows that repeat are treated each for itself; an empty table
gives no rows. Other columns pass through, but for columns named ``ids`` or ``decoded``, which are replaced. A text is
held whole by one worker; the chunk table by ``TABLE_BYTES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, types as T

from countloom.llm.common import byte_column

#: The piece pattern of this family of vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks are cut where this many bits of the rolling hash are zero, but no sooner than MIN_CHUNK bytes.
CHUNK_BITS, MIN_CHUNK, TABLE_BYTES = 9, 128, 32 << 20


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check(spec: dict) -> None:
    """Raises if a vocabulary file asks for what this codec does not do."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = {"dropout": (None, 0, 0.0), "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (None, False), "ignore_merges": (None, False)}
    wrong = [k for k, v in plain.items() if model.get(k) not in v]
    wrong += ["model.type"] * (model.get("type", "BPE") != "BPE") + ["normalizer"] * (spec.get("normalizer") is not None)
    wrong += ["pre_tokenizer"] * (pre.get("type") != "ByteLevel" or bool(pre.get("add_prefix_space")) or not pre.get("use_regex", True))
    wrong += ["added_tokens"] * any(not x.get("special") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    wrong += ["merges"] * (None in merged or any(a >= b for a, b in zip(merged, merged[1:])))
    if wrong:
        raise ValueError(f"unsupported in this vocabulary file: {', '.join(wrong)}")


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", []) if x.get("special")}
        self.special = list(special)
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes_of = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in special.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, t in self.bytes_of.items():
            self.length[i] = len(t)
        self.gear = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)
        self.chunks: dict[bytes, tuple] = {}  # lately met ones, and those before them
        self.older: dict[bytes, tuple] = {}
        self.held = 0
        self.seen_bytes = self.reused_bytes = self.grown = 0

    def plain(self, data: bytes) -> np.ndarray:
        text = data.decode()
        ids = self.encoding.encode(text, allowed_special="all", disallowed_special=()) if any(s in text for s in self.special) else self.encoding.encode_ordinary(text)
        return np.array(ids, np.int32)

    def cuts(self, data: bytes) -> list[int]:
        """Content-defined borders: a hash of the last 16 bytes, by doubling."""
        b = np.frombuffer(data, np.uint8)
        h = self.gear[b]
        for step in (1, 2, 4, 8):
            shifted = h[:-step] << np.uint64(step)
            h = h.copy()
            h[step:] += shifted
        ok = (h[15:-1] >> np.uint64(64 - CHUNK_BITS - 1) & np.uint64((1 << CHUNK_BITS) - 1)) == 0
        at = np.flatnonzero(ok & ((b[16:] & 0xC0) != 0x80)) + 16  # a border is between characters
        out, last = [], 0
        for x in at.tolist():
            if x - last >= MIN_CHUNK:
                out.append(x)
                last = x
        return [*out, len(data)]

    def chunk(self, data: bytes) -> tuple:
        """Tokens of a chunk, its first and last two safe points (bytes), and how many tokens stand before each."""
        self.seen_bytes += len(data)
        if (found := self.chunks.get(data)) is not None:
            self.reused_bytes += len(data)
            return found
        if (found := self.older.get(data)) is not None:
            self.reused_bytes += len(data)
        else:
            ids = self.plain(data)
            b = np.frombuffer(data, np.uint8)
            letter = ((b | 32) >= 97) & ((b | 32) <= 122)
            safe = np.flatnonzero(letter[:-2] & (b[1:-1] == 32) & letter[2:]) + 1
            found = (ids, None, None)
            if len(safe) > 2:
                at = safe[[0, 1, -2, -1]]
                found = (ids, at.tolist(), (np.searchsorted(np.cumsum(self.length[ids]), at) + 1).tolist())
        if self.held > TABLE_BYTES // 2:
            self.older, self.chunks, self.held = self.chunks, {}, 0
        self.chunks[data] = found
        self.held += len(data) + 4 * len(found[0]) + 500
        return found

    def encode(self, data: bytes | None) -> np.ndarray:
        """Chunk by chunk; ``pending`` is text whose tokens are still open, from a safe point on, of which ``agreed`` are known."""
        if not data:
            return np.empty(0, np.int32)
        out, pending, agreed, start = [], b"", None, 0
        for end in self.cuts(data):
            part = data[start:end]
            ids, at, n = self.chunk(part)
            if at is None:  # too few safe points: the region grows by the whole chunk
                pending += part
            else:
                if start:
                    region = self.plain(pending + part[: at[1]])
                    tail = ids[n[0] : n[1]]
                    if (agreed is None or region[: len(agreed)].tolist() == agreed) and region[len(region) - len(tail) :].tolist() == tail.tolist():
                        out += [region, ids[n[1] : n[2]]]
                        pending, agreed = part[at[2] :], ids[n[2] : n[3]].tolist()
                    else:
                        self.grown += 1
                        pending += part
                else:
                    out.append(ids[: n[2]])
                    pending, agreed = part[at[2] :], ids[n[2] : n[3]].tolist()
            start = end
        out.append(self.plain(pending))
        return np.concatenate(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _mapped(df: DataFrame, made: dict[str, T.DataType], work) -> DataFrame:
    base = df.drop(*made)
    schema = T.StructType([*base.schema.fields, *(T.StructField(k, v) for k, v in made.items())])
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 2000):
                part = batch.slice(at, 2000)
                new = work(part)
                old = {c: part.column(i) for i, c in enumerate(cols) if c not in made}
                yield pa.RecordBatch.from_pydict(old | new)
        pa.default_memory_pool().release_unused()  # workers live on between tasks

    return df.mapInArrow(run, schema)


def _id_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int); with ``decoded`` also the text that these ids decode to, from the same pass."""
    made = {"ids": T.ArrayType(T.IntegerType(), True)} | ({"decoded": T.StringType()} if decoded else {})

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        ids = [c.encode(x) for x in byte_column(batch, text_col)]
        return {"ids": _id_array(ids)} | ({"decoded": pa.array([c.decode(x.tolist()) for x in ids], pa.string())} if decoded else {})

    return _mapped(docs, made, work)


def decode(tokens: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids; null ids give the empty text."""

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
        return {"decoded": pa.array([c.decode(x or []) for x in ids], pa.string())}

    return _mapped(tokens, {"decoded": T.StringType()}, work)


def ids_text(ids: str = "ids"):
    """Decimal ids joined by commas, as a Column."""
    return F.replace(F.expr(f"trim(BOTH '[]' FROM cast({ids} AS string))"), F.lit(", "), F.lit(","))
