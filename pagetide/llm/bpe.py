"""Byte-level BPE, exact and in linear time.

Bytes are read as Latin-1, so an Aho-Corasick automaton over strings finds the longest
vocabulary entry at every place where one is asked for. The encoder takes the longest entry, keeps it if it
may stand beside the one before (the merges would not have joined across or broken either), else
tries its next shorter prefix, else takes the previous entry back and marks the place as dead.
Places die once, so the work is linear in the piece. Whether two entries may stand side by side
depends on these two alone and is remembered.

Cases: a null or empty text has no tokens; very long texts and unbroken runs are one piece each
and stay linear; repeated rows are encoded again; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HELD, frames

# Pieces and pairs that a task remembers; the tables start anew when full.
REMEMBERED_PIECES = 200_000
REMEMBERED_PAIRS = 400_000
# Fixed end of patterns whose words take one space before them.
SPACED = r""" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Longer pieces are not remembered.
REMEMBERED_CHARS = 64


def read_ranks(text: bytes) -> list[tuple[bytes, int]]:
    return [(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in text.splitlines() if line)]


class Vocabulary:
    """Entries, and how each is made: the last merge that gives it."""

    def __init__(self, ranks: Sequence[tuple[bytes, int]]):
        self.bytes_of = {rank: token for token, rank in ranks}
        self.rank_of = dict(ranks)
        self.last_merge: dict[int, tuple[int, int]] = {}
        self.by_pair: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks, key=lambda r: r[1]):
            if len(token) == 1:
                self.last_merge[rank] = (rank, rank)
                continue
            parts = self._merged(token, rank)
            if len(parts) == 2:
                self.last_merge[rank] = tuple(parts)
                self.by_pair[tuple(parts)] = rank
        # An entry that merging its own bytes does not give can never come out of merging.
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        for rank in self.last_merge:
            token = self.bytes_of[rank]
            self.automaton.add_word(token.decode("latin-1"), rank)
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1)
                                       if (r := self.rank_of.get(token[:n])) in self.last_merge), None)
        self.automaton.make_automaton()
        # An entry is whole only if merging gives it; a piece equal to one is that entry.
        self.known = {self.bytes_of[rank].decode("latin-1"): rank for rank in self.last_merge}
        self.size = {rank: len(self.bytes_of[rank]) for rank in self.last_merge}
        self.reach = max(self.size.values())
        # All entries one after another, for decoding.
        entries = [self.bytes_of.get(r, b"") for r in range(max(self.bytes_of) + 1)]
        self.joined = np.frombuffer(b"".join(entries), dtype=np.uint8)
        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        if len([t for t in self.known if len(t) == 1]) < 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _merged(self, token: bytes, below: int) -> list[int]:
        """Entries of ``token`` after all merges of a rank under ``below``."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.rank_of.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank_of[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts that stand at one edge of ``token`` (1: right, 0: left) while its merges are
        done, first the byte, at last the whole, each with the rank of the merge that ends it."""
        parts, end = [], float("inf")
        while True:
            parts.append((token, end))
            inner = self.last_merge[token][side]
            if inner == token:  # a byte
                return parts[::-1]
            token, end = inner, token

    def fits(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two.

        Merges are done by rank, so the part at the inner edge of either side changes at known
        ranks. They fit unless two parts that meet at the border would merge before either is taken
        up by its own side; of two merges of one rank the one further left comes first.
        """
        ours, theirs, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        fine = True
        while fine:
            (a, a_ends), (b, b_ends) = ours[i], theirs[j]
            border = self.by_pair.get((a, b))
            if border is not None and border < a_ends and border <= b_ends:
                fine = False
            elif a_ends <= b_ends:
                i += 1
                if i == len(ours):
                    break
            else:
                j += 1
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[left << 20 | right] = fine
        return fine

    def longest(self, piece: str, at: int) -> int:
        """The longest entry that starts at ``at``: walk down the automaton's trie, then back to
        where an entry ends. Entries have a fixed greatest length, so this is constant work."""
        ahead = piece[at:at + self.reach]
        n = self.automaton.longest_prefix(ahead)
        known = self.known
        while (rank := known.get(ahead[:n])) is None:
            n -= 1
        return rank

    def encode_piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        whole = self.known.get(text)
        if whole is not None:
            return [whole]
        n, size, pairs = len(text), self.size, self.pairs
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, before = 0, -1
        token = self.longest(text, 0)
        while at < n:
            end = at + size[token]
            if alive[end]:
                if before < 0:
                    fine = True
                elif (fine := pairs.get(before << 20 | token)) is None:
                    fine = self.fits(before, token)
                if fine:
                    out.append(token)
                    at, before = end, token
                    if at < n:
                        token = self.longest(text, at)
                    continue
            less = self.shorter[token]
            if less is not None:
                token = less
            else:
                alive[at] = 0
                token = out.pop()
                at -= size[token]
                before = out[-1] if out else -1
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = np.array(self.encode_piece(piece.encode("utf-8")), dtype="<u4").tobytes()
            if len(piece) <= REMEMBERED_CHARS:
                if len(self.pieces) >= REMEMBERED_PIECES:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode(self, text: str, split: Split) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not split.at_spaces(text):
            return b"".join(map(self._piece, split.pieces(text)))
        first, *words = text.split(" ")
        out = list(map(self.words.get, words))
        at = -1
        for _ in range(out.count(None)):
            at = out.index(None, at + 1)
            word = words[at]
            out[at] = b"".join(map(self._piece, split.pieces(" " + word)))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.words) >= REMEMBERED_PIECES:
                    self.words.clear()
                self.words[word] = out[at]
        return b"".join([*map(self._piece, split.pieces(first)), *out])

    def forget(self) -> None:
        """Empty the tables; the worker lives on after its task."""
        self.pieces.clear()
        self.words.clear()
        self.pairs.clear()

    def decode(self, ids: bytes) -> bytes:
        ranks = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[ranks]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.places[ranks] - (ends - sizes), sizes)
        return self.joined[shift + np.arange(len(shift))].tobytes()


@functools.lru_cache(maxsize=2)
def _vocabulary(ranks: bytes) -> Vocabulary:
    HELD["bpe"] = lambda: _vocabulary.cache_clear()
    return Vocabulary(read_ranks(ranks))


class Split:
    """The pattern as the rank files' own library reads it: white space by its Unicode property,
    which leaves out the four separators U+001C to U+001F.

    If every part of the pattern that takes a visible character takes one space before it too, a
    single space between visible characters always begins a piece. Such texts are cut there, and
    ids are remembered for words with all that is attached to them.
    """

    def __init__(self, pattern: str):
        space = r"\p{White_Space}"
        self.pieces = regex.compile(pattern.replace(r"[^\s", "[^" + space).replace(r"\S", r"\P{White_Space}")
                                    .replace(r"\s", space)).findall
        self.free = pattern.endswith(SPACED)
        self.crowded = regex.compile(r"\s |(?<= )\s").search

    def at_spaces(self, text: str) -> bool:
        return self.free and not self.crowded(text)


@functools.lru_cache(maxsize=4)
def split_pattern(pattern: str) -> Split:
    return Split(pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``column`` as packed binary in ``ids``.

    The rank file is a fixed input of under a megabyte; it is read on the driver and sent to the
    workers, which build the automaton once each.
    """
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def encoded(texts: pd.Series) -> pd.Series:
        vocabulary, split = _vocabulary(shared.value), split_pattern(pattern)
        return pd.Series([b"" if t is None else vocabulary.encode(t, split) for t in texts], dtype=object)

    return docs.withColumn(ids, encoded(F.col(column)))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``df`` with the bytes that ``ids`` stand for in ``column``."""
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("binary")
    def decoded(packed: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(shared.value)
        return pd.Series([None if p is None else vocabulary.decode(p) for p in packed], dtype=object)

    return df.withColumn(column, decoded(F.col(ids)))


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the encoding and its decoding, hashed."""
    with open(ranks_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        vocabulary, split = _vocabulary(shared.value), split_pattern(pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                packed = vocabulary.encode(text or "", split)
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                             hashlib.sha256(vocabulary.decode(packed)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(
                doc_id=batch["doc_id"])
        vocabulary.forget()

    return frames(docs.select("doc_id", "text"), run,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", owner="bpe")
