"""Byte-level BPE in linear time, exactly as merging by rank would do it.

The vocabulary's byte strings are read as Latin-1 and put into an Aho-Corasick
automaton, which gives the longest token starting anywhere.  A text piece is
then covered from left to right: take the longest token, and keep it if it is
compatible with the token before; otherwise try the next shorter one, and if
there is none, give up the token before.  Two tokens are compatible if merging
their joined bytes by rank gives back just these two.  That test looks at the
two tokens only and is remembered, and a place that was once given up is never
tried again, so the work grows with the length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and token pairs a Python worker remembers, and how long such a piece may be.
CACHED_PIECES, CACHED_PAIRS, CACHED_CHARS = 500_000, 1_000_000, 64

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Encoder and decoder over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        # The next shorter token that starts a token, and the two a merge made it from.
        self.shorter = {i: self._prefix(token) for token, i in ranks.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def _prefix(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if token[:end] in self.ranks:
                return self.ranks[token[:end]]
        return None

    def split_token(self, i: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token ``i``; None for single bytes.

        They are what is left when merging its bytes by rank stops one short.
        """
        if i not in self.halves:
            token = self.tokens[i]
            parts = self.merged([self.ranks[token[k:k + 1]] for k in range(len(token))], i)
            self.halves[i] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self.halves[i]

    def merged(self, parts: list[int], below: int) -> list[int]:
        """Merge neighbours, lowest rank first, using ranks under ``below`` only."""
        names = [self.tokens[i] for i in parts]
        while len(names) > 1:
            ranks = [self.ranks.get(a + b, below) for a, b in zip(names, names[1:], strict=False)]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            names[at:at + 2] = [names[at] + names[at + 1]]
        return [self.ranks[x] for x in names]

    def compatible(self, left: int, right: int) -> bool:
        """True if the bytes of both tokens together merge into just these tokens.

        Undo merges from the border outwards, the later one first: had any pair
        across the border a lower rank than the merges that closed over it, it
        would have been merged first.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit, a, b = len(self.ranks) + 1, left, right
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < limit:
                return False
            # Take apart the half made last; on a tie in rank the left one was made first.
            if a > b:
                limit, halves = a, self.split_token(a)
                if halves is None:
                    return True
                a = halves[1]
            else:
                limit, halves = b + 1, self.split_token(b)
                if halves is None:
                    halves = self.split_token(a)
                    if halves is None:
                        return True
                    limit, a = a, halves[1]
                else:
                    b = halves[0]

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        longest = [-1] * len(data)
        # All tokens come out, by where they end: the last one of a start is its longest.
        for end, (i, size) in self.automaton.iter(data.decode("latin-1")):
            longest[end + 1 - size] = i
        found: list[int] = []
        at, token = 0, longest[0]
        dead = bytearray(len(data) + 1)  # places from which nothing leads to the end
        while True:
            end = at + len(self.tokens[token])
            if not dead[end] and (not found or self.compatible(found[-1], token)):
                found.append(token)
                at = end
                if at == len(data):
                    return found
                token = longest[at]
                continue
            shorter = self.shorter[token]
            while shorter is None:
                dead[at] = 1
                token = found.pop()
                at -= len(self.tokens[token])
                shorter = self.shorter[token]
            token = shorter

    def encode(self, text: str) -> list[int]:
        pieces, known = self.split(text), self.pieces
        if len(known) > CACHED_PIECES:
            known.clear()
        new = set(pieces).difference(known)
        for p in new:
            known[p] = tuple(self.piece(p.encode("utf-8")))
        ids = list(chain.from_iterable(map(known.__getitem__, pieces)))
        for p in new:
            if len(p) > CACHED_CHARS:
                del known[p]
        return ids

    def listed(self, ids: list[int]) -> str:
        """Decimal ids with a space between."""
        return " ".join(map(self.names.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def _coder(path: str, pattern: str) -> Bpe:
    return Bpe.from_file(path, pattern)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id`` and the ids of each text; of a null or empty text, none."""
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                ids = [coder.encode(t.as_py() or "") for t in batch.column(1)[lo:lo + 64]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:lo + 64], pa.array(ids, pa.list_(pa.int32()))],
                    names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and the bytes of each list of ids."""
    path, pattern = path or ranks_path(), split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            data = [coder.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())],
                                             names=["doc_id", "data"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def coded_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode, decode what came out, and give a digest of either; one pass over the texts.

    Every row gives a row, also if it is repeated or has no id.
    """
    path, pattern = path or ranks_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            counts, digests, texts = [], [], []
            for t in batch.column(1):
                ids = coder.encode(t.as_py() or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(coder.listed(ids).encode()).hexdigest())
                texts.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CODED)
