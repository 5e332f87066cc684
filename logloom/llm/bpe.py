"""Encoding of a corpus with a public byte-level BPE vocabulary, exactly as its merges do.

Bytes are mapped to Latin-1 characters for an Aho-Corasick automaton of the vocabulary. For a piece of text the
longest token at each position comes from one pass of the automaton; the encoder goes from longest matches and
backtracks to the next shorter one where two neighbours are not compatible, that is where the merges would not
leave them side by side. Compatibility of a pair is a property of the two tokens alone and is memoised; a bit
for each position keeps dead ends from being tried again, so the work is linear in the text.

An empty or null text has an empty list of ids. Special tokens are never produced; their strings are ordinary
text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how the public vocabulary splits a text into pieces that merges do not cross.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, and the longest piece that is remembered.
REMEMBERED, REMEMBERED_CHARS = 500_000, 48


def default_vocabulary() -> str:
    """The installed public vocabulary; any other is given by its path."""
    from public_tokenizers import path

    return str(path("byte_bpe_50k.tiktoken"))


class Encoder:
    """ranks: token bytes -> id, ids being the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens: dict[int, str] = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.find = regex.compile(PIECES).findall

    # what a token is made of

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a single byte."""
        if token not in self.pairs:
            text = self.tokens[token]
            self.pairs[token] = None if len(text) == 1 else self._halves(text, token)
        return self.pairs[token]

    def _halves(self, text: str, token: int) -> tuple[int, int] | None:
        """Merge the token's own bytes by rank until two parts are left."""
        parts = list(text)
        while len(parts) > 2:
            best = min(
                (self.ranks.get(parts[i] + parts[i + 1], token), i) for i in range(len(parts) - 1)
            )
            if best[0] >= token:
                return None
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if any(p not in self.ranks for p in parts):
            return None
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, -1 if there is none."""
        found = self.shorter.get(token)
        if found is None:
            text, found = self.tokens[token], -1
            for size in range(len(text) - 1, 0, -1):
                if (found := self.ranks.get(text[:size], -1)) >= 0:
                    break
            self.shorter[token] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right as neighbours."""
        key = (left, right)
        found = self.compatible.get(key)
        if found is None:
            if len(self.compatible) > 4_000_000:
                self.compatible.clear()
            found = self.compatible[key] = self._fits(left, right)
        return found

    def _fits(self, left: int, right: int) -> bool:
        """Undo merges in the reverse of their order, the later one first: a merge across the border that comes
        before the later of the two would have been made."""
        ranks, tokens = self.ranks, self.tokens
        limit = 1 << 60
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < limit:
                return False
            if left > right:
                limit = left
                halves = self.halves(left)
                if halves is None:
                    limit = right + 1
                    halves = self.halves(right)
                    if halves is None:
                        return True
                    right = halves[0]
                else:
                    left = halves[1]
            else:
                limit = right + 1
                halves = self.halves(right)
                if halves is None:
                    limit = left
                    halves = self.halves(left)
                    if halves is None:
                        return True
                    left = halves[1]
                else:
                    right = halves[0]

    # texts

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [-1] * n
        for end, (size, rank) in self.automaton.iter(text):
            longest[end - size + 1] = rank  # ends ascend, so the last one written is the longest
        tokens, fits = self.tokens, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else -1
            while True:
                end = at + len(tokens[token])
                if open_[end] and (last < 0 or fits(last, token)):
                    ids.append(token)
                    at = end
                    if at < n:
                        token = longest[at]
                    break
                token = self.next_shorter(token)
                if token < 0:
                    open_[at] = 0
                    if not ids:
                        raise ValueError("the vocabulary lacks a byte of the text")
                    token = ids.pop()  # its end is closed now, so the next look takes a shorter one
                    at -= len(tokens[token])
                    break
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, ids = self.known, []
        for piece in self.find(text):
            got = known.get(piece)
            if got is None:
                got = self.piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a rank file (base64 token and rank on each line), built once in each worker."""
    lines = Path(path).read_bytes().splitlines()
    return Encoder({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())})


_sent: set[tuple[str, str]] = set()


def _send(spark: SparkSession, path: str) -> None:
    """Hand the vocabulary to executors on machines that do not have it."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _sent:
        spark.sparkContext.addFile(path)
        _sent.add(key)


def _here(path: str) -> str:
    """The vocabulary on this machine: at its own path, or as it was sent."""
    return path if Path(path).exists() else SparkFiles.get(Path(path).name)


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """key, ids: the whole corpus as token ids. No shuffle; the vocabulary goes to the executors as a file."""
    path = vocabulary or default_vocabulary()
    _send(documents.sparkSession, path)
    chosen = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(_here(path)).encode
        for b in batches:
            texts = b.column("text")
            for at in range(0, max(1, b.num_rows), 1024):
                part = texts.slice(at, 1024)
                ids = pa.array([encode(t) for t in part.to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, 1024), ids], ["doc_id", "ids"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def with_token_counts(rows: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """The rows with n_tokens in place of the text column."""
    path = vocabulary or default_vocabulary()
    _send(rows.sparkSession, path)
    kept = [c for c in rows.columns if c != text]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(_here(path)).encode
        for b in batches:
            counts = [len(encode(t)) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", n_tokens bigint")
