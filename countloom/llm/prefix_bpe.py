"""Byte-level BPE by dynamic programming over byte prefixes: encode, decode, append and edit.

A prefix of a piece has exactly one last token with which a valid encoding of that prefix ends: the token t that ends
there such that t and the last token of the prefix before it are a pair that merging would leave apart. So a piece
is encoded from left to right in one pass, by an automaton of all tokens and a check of token pairs, and the table of last
tokens (one for each byte) holds the encodings of *all* its prefixes. With the table kept beside the text, text can be
appended without looking at what stands before, and after an edit only the bytes near it are encoded anew, until the
table agrees with the old one over as many bytes as the longest token has. Both are exact.

The vocabulary is a parameter: a file of ranks (base64 token, rank). It must hold all 256 bytes, and merging
the bytes of each token by lower ranks must end in the two tokens it is made of; other files raise. The pattern that
splits texts into pieces is the public one of this family; letters and numbers are those that the tiktoken library
knows, as its tables of Unicode may be of another version than those of the regex library. No special tokens.

Null and empty texts give no tokens and decode to no bytes; rows that repeat are treated each for itself; an empty
table gives no rows; ids and other columns pass through, but for those named like the columns that a function makes (``ids``,
``decoded``, ``prefix_tokens``, ``piece_starts``), which are replaced. Time is linear in a text's length, also where it is
one single piece. A text is held whole by one worker; the table of pieces is bounded (``PIECES``).
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

from countloom.llm.bpe import PATTERN, _id_array, _mapped
from countloom.llm.common import byte_column

#: Pieces and pairs that a worker remembers (the lately met ones, twice), and characters of a text that are split at once.
PIECES, PAIRS, SLICE = 200_000, 500_000, 1 << 20


class Recent(dict):
    """key -> ``make(key)``; what was not met lately leaves, so at most twice ``limit`` entries are held."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


@lru_cache(maxsize=1)
def odd_characters() -> dict[int, str]:
    """Characters that tiktoken and regex put into different classes -> a stand-in of tiktoken's class.

    Only characters that Python's own tables do not know can differ between versions of Unicode.
    """
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    new = "".join(x for x in map(chr, range(0x110000)) if unicodedata.category(x) == "Cn")
    seen = regex.findall(r"[\p{L}\p{N}]", new)
    ranks = {bytes([b]): b for b in range(256)}
    for c in seen:
        for before in "a1":
            ranks.setdefault((before + c).encode(), len(ranks))
    probe = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {}
    for c in seen:
        theirs = next((before for before in "a1" if len(probe.encode_ordinary(before + c)) == 1), "")
        if theirs != ("a" if letter.match(c) else "1"):
            out[ord(c)] = theirs
    return out


def _ranges(points: list[int]) -> str:
    """Code points as the inside of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs)


class Splitter:
    """The pieces of a text. Texts within Unicode's first plane take a pattern with spelled out classes, others stand-ins."""

    def __init__(self):
        self.pattern = regex.compile(PATTERN)
        self.odd = odd_characters()
        plane = "".join(map(chr, range(0x10000)))
        kinds = {k: [ord(x) for x in regex.findall(k, plane)] for k in (r"\p{L}", r"\p{N}", r"\s")}
        for c, kind in self.odd.items():
            if c < 0x10000:
                for k, stand_in in ((r"\p{L}", "a"), (r"\p{N}", "1")):
                    kinds[k] = [x for x in kinds[k] if x != c] + [c] * (kind == stand_in)
        letters, numbers, blanks = (_ranges(sorted(x)) for x in kinds.values())
        self.first_plane = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{letters}{numbers}{blanks}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")
        self.beyond = re.compile("[\U00010000-\U0010ffff]")

    def ends(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """(start, end) of the pieces from a piece's start on; a slice at a time, whose last pieces may be cut and are split again."""
        view, pattern = (text.translate(self.odd), self.pattern) if self.beyond.search(text) else (text, self.first_plane)
        size = SLICE
        while start < len(view):
            stop = min(len(view), start + size)
            found = [m.span() for m in pattern.finditer(view, start, stop)]
            if stop < len(view):
                found = found[:-3]
            if not found:
                size *= 2
                continue
            yield from found
            start, size = found[-1][1], SLICE

    def pieces(self, text: str) -> list[str]:
        if len(text) <= SLICE and not self.beyond.search(text):
            return self.first_plane.findall(text)
        return [text[a:b] for a, b in self.ends(text)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixCodec:
    def __init__(self, path: str):
        self.rank = read_ranks(path)
        if len(set(self.rank.values())) < len(self.rank) or any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("a vocabulary must hold every byte, and every rank once")
        self.token = {r: t for t, r in self.rank.items()}
        self.size = {r: len(t) for r, t in self.token.items()}
        self.longest = max(self.size.values())
        self.made = 0  # prefixes encoded so far
        self.apart = Recent(self._apart, PAIRS)
        self.pieces: dict[str, bytes] = {}  # lately met ones and their ids, and those before them
        self.older: dict[str, bytes] = {}

    @cached_property
    def halves(self) -> dict[int, tuple[int, int]]:
        return {r: self._made_of(t, r) for r, t in self.token.items() if len(t) > 1}

    @cached_property
    def joined(self) -> dict[int, int]:
        """Two tokens, side by side -> the token that they make."""
        splits = ((t[:i], t[i:], r) for t, r in self.rank.items() for i in range(1, len(t)))
        return {self.rank[x] << 32 | self.rank[y]: r for x, y, r in splits if x in self.rank and y in self.rank}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for t, r in self.rank.items():
            out.add_word(t.decode("latin-1"), (r, len(t)))
        out.make_automaton()
        return out

    @cached_property
    def splitter(self) -> Splitter:
        return Splitter()

    def _made_of(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that the last merge of ``token`` joins."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= rank:
                raise ValueError(f"merges of lower rank do not lead to the token {token!r}")
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.rank[parts[0]], self.rank[parts[1]]

    def _apart(self, pair: int) -> bool:
        """Whether merging the bytes of two tokens leaves both: no merge across their border comes before its neighbours' own.

        Time runs backwards: of the two parts that touch the border the younger one is taken apart, and a part may be
        merged across the border only before it goes into the one it came from (on the left, at equal rank that comes first).
        """
        a, b = pair >> 32, pair & 0xFFFFFFFF
        a_until = b_until = 1 << 62
        joined, halves = self.joined.get, self.halves.get
        while True:
            at = joined(a << 32 | b)
            if at is not None and at < a_until and at <= b_until:
                return False
            a_in, b_in = halves(a), halves(b)
            if b_in is None:
                if a_in is None:
                    return True
                a_until, a = a, a_in[1]
            elif a_in is not None and a > b:
                a_until, a = a, a_in[1]
            else:
                b_until, b = b, b_in[0]

    def last_tokens(self, data: bytes, known: list[int] | None = None, old: list[int] | None = None, since: int = 0) -> list[int]:
        """For each prefix of a piece the last token of its encoding.

        ``known``: what is known of the first prefixes. ``old``: the last tokens of a text with the same bytes from
        ``since`` on, by the same places; once the table agrees with it over the longest token's bytes, the rest is taken from it.
        """
        last = list(known or ())
        agreed, n, apart = 0, len(last), self.apart
        for end, (token, size) in self.automaton.iter(data.decode("latin-1"), max(0, n - self.longest + 1)):
            if end == n and (size > end or apart[last[end - size] << 32 | token]):
                last.append(token)
                n += 1
                if old is not None and end >= since:
                    agreed = agreed + 1 if end < len(old) and old[end] == token else 0
                    if agreed >= self.longest:
                        self.made += n - len(known or ())
                        last += old[n : len(data)]
                        return last if len(last) == len(data) else self.last_tokens(data, last)  # the old piece ended sooner
        if n != len(data):
            raise ValueError("this vocabulary has no unique last tokens")
        self.made += n - len(known or ())
        return last

    def walk(self, last: list[int]) -> list[int]:
        """Token ids from the last tokens of all prefixes, of a piece or of a whole text."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= self.size[token]
        out.reverse()
        return out

    def _learn(self, pieces: set[str]) -> None:
        """Encodes pieces in order, so that each goes on from the prefix it shares with the one before."""
        data = sorted(x.encode() for x in pieces)
        heads = np.array(data, "S24").view(np.uint8).reshape(-1, 24)
        shared = np.concatenate(([0], (heads[1:] != heads[:-1]).argmax(1))).tolist()
        last: list[int] = []
        for piece, n in zip(data, shared):
            last = self.last_tokens(piece, last[: min(n, len(last), len(piece))])
            self.pieces[piece.decode()] = array("i", self.walk(last)).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; the texts' pieces are held at once."""
        split = [self.splitter.pieces(x) if x else [] for x in texts]
        new = set().union(*split) - self.pieces.keys()
        again = new & self.older.keys()
        self.pieces.update((x, self.older[x]) for x in again)
        if new := new - again:
            self._learn(new)
        out = [b"".join(map(self.pieces.__getitem__, x)) for x in split]
        if len(self.pieces) > PIECES:
            self.older, self.pieces = self.pieces, {}
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def state(self, text: str | None) -> tuple[list[int], list[int]]:
        """(last token of each prefix within its piece, where pieces start in characters)."""
        last, starts = [], []
        for a, b in self.splitter.ends(text or ""):
            last += self.last_tokens(text[a:b].encode())
            starts.append(a)
        return last, starts

    def edit(self, text: str, last: list[int], starts: list[int], a: int, b: int, new: str) -> tuple[str, list[int], list[int], int]:
        """Characters a to b become ``new``: (text, last tokens, piece starts, prefixes encoded anew).

        A piece is told by its own characters and at most two behind it, so pieces that end two characters before the
        edit stay; behind it pieces stay from the first that starts where an old one did.
        """
        out = text[:a] + new + text[b:]
        kept = 0
        while kept < len(starts) and (starts[kept + 1] if kept + 1 < len(starts) else len(text)) + 2 <= a:
            kept += 1
        at = starts[kept] if kept < len(starts) else len(text)
        begin = len(text[:at].encode())
        shift, size_a = len(out) - len(text), len(text[:a].encode())
        byte_shift = len(new.encode()) - len(text[a:b].encode())
        old_starts, new_last, new_starts, before = set(starts), last[:begin], starts[:kept], self.made
        for x, y in self.splitter.ends(out, at):
            if x >= a + len(new) and x - shift in old_starts:  # from here on all pieces are old ones
                new_last += last[len(new_last) - byte_shift :]
                new_starts += [s + shift for s in starts if s >= x - shift]
                break
            data, first = out[x:y].encode(), len(new_last)
            known, old, since = [], None, 0
            if x <= a and x in old_starts:  # the same start: its prefixes before the edit are known
                known = last[first : min(size_a, first + len(data))]
                known = known[: self._whole(starts, x, text) - first] if known else known
            settled = size_a + len(new.encode())
            if first + len(data) > settled:
                j = max(settled, first) - byte_shift  # where the bytes behind the edit stood
                stop = self._whole(starts, x - shift if x >= a + len(new) else b, text, inside=True)
                since = max(settled - first, 0)
                old = [-1] * since + last[j:stop]
            new_last += self.last_tokens(data, known, old, since)
            new_starts.append(x)
        return out, new_last, new_starts, self.made - before

    def _whole(self, starts: list[int], x: int, text: str, inside: bool = False) -> int:
        """The byte where the piece ends that starts at (or, ``inside``, holds) character ``x``."""
        i = int(np.searchsorted(starts, x, "right"))
        return len(text[: starts[i] if i < len(starts) else len(text)].encode())


@lru_cache(maxsize=2)
def codec(path: str) -> PrefixCodec:
    return PrefixCodec(path)


_INTS = T.ArrayType(T.IntegerType(), True)


def _texts(batch: pa.RecordBatch, col: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(col)).to_pylist()


def _some(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about SLICE characters."""
    run, size = [], 0
    for x in texts:
        run.append(x)
        size += len(x or "")
        if size >= SLICE:
            yield run
            run, size = [], 0
    yield run


def encode(docs: DataFrame, vocabulary: str, *, text_col: str = "text", packed: bool = False) -> DataFrame:
    """``docs`` with ``ids``: an array of int, or, ``packed``, the same as little-endian 32-bit numbers in a binary column."""

    def work(batch: pa.RecordBatch) -> dict:
        c, ids = codec(vocabulary), []
        for some in _some(_texts(batch, text_col)):
            ids += c.encode(some)
        return {"ids": pa.array(ids, pa.binary()) if packed else _id_array([np.frombuffer(x, "<i4") for x in ids])}

    return _mapped(docs, {"ids": T.BinaryType() if packed else _INTS}, work)


def decode(tokens: DataFrame, vocabulary: str, *, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the bytes of the ids (an array or packed); null ids give no bytes; unknown ones raise."""
    packed = isinstance(tokens.schema[ids_col].dataType, T.BinaryType)

    def work(batch: pa.RecordBatch) -> dict:
        c = codec(vocabulary)
        ids = _texts(batch, ids_col)
        return {"decoded": pa.array([c.decode((np.frombuffer(x, "<i4").tolist() if packed else x) if x else []) for x in ids], pa.binary())}

    return _mapped(tokens, {"decoded": T.BinaryType()}, work)


def prefixes(docs: DataFrame, vocabulary: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with the table that ``edit`` goes on from: ``prefix_tokens`` (a token for each byte) and ``piece_starts``."""

    def work(batch: pa.RecordBatch) -> dict:
        made = [codec(vocabulary).state(x) for x in _texts(batch, text_col)]
        return {"prefix_tokens": pa.array([x[0] for x in made], pa.list_(pa.int32())), "piece_starts": pa.array([x[1] for x in made], pa.list_(pa.int32()))}

    return _mapped(docs, {"prefix_tokens": _INTS, "piece_starts": _INTS}, work)


def edit(held: DataFrame, vocabulary: str, *, new_col: str, start_col: str | None = None, end_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Characters ``start_col`` to ``end_col`` of each text become ``new_col``; without these columns it is appended.

    ``held`` has the columns of ``prefixes``. Returns it with the text, table and ``ids`` after the edit, and ``encoded_bytes``: how many prefixes
    were encoded anew. Null text or addition is empty; null places are the text's end; places outside the text are moved to its ends.
    """
    made = {text_col: T.StringType(), "prefix_tokens": _INTS, "piece_starts": _INTS, "ids": _INTS, "encoded_bytes": T.LongType()}

    def work(batch: pa.RecordBatch) -> dict:
        c, rows = codec(vocabulary), []
        nothing = [None] * batch.num_rows
        cols = [_texts(batch, x) if x else nothing for x in (text_col, "prefix_tokens", "piece_starts", start_col, end_col, new_col)]
        for text, last, starts, a, b, new in zip(*cols):
            text = text or ""
            a = len(text) if a is None else min(max(a, 0), len(text))
            b = max(a, len(text) if b is None else min(b, len(text)))
            rows.append(c.edit(text, last or [], starts or [], a, b, new or ""))
        ints = pa.list_(pa.int32())
        return {
            text_col: pa.array([r[0] for r in rows], pa.string()), "prefix_tokens": pa.array([r[1] for r in rows], ints), "piece_starts": pa.array([r[2] for r in rows], ints),
            "ids": pa.array([c.walk(r[1]) for r in rows], ints), "encoded_bytes": pa.array([r[3] for r in rows], pa.int64()),
        }

    return _mapped(held, made, work)
