"""Byte-level BPE encoding and decoding in linear time, exact to the merges.

A pre-token's UTF-8 bytes become Latin-1 characters, so a pyahocorasick automaton over the vocabulary
finds every token that occurs in it. The encoder goes left to right and takes the longest token at its
place that may stand after the token before it; where none may, it takes the previous token back and
goes on with that one's next shorter match. Places once left are marked, so each is entered once.

Two adjacent tokens may stand side by side when undoing their merges, latest first, meets no pair of
neighbours over the border that the merges would have joined earlier; the answer is memoised.
A pre-token's encoding is kept as well, in a table that is emptied at a fixed size.

Defined cases: null and empty texts have no tokens; any length of text or pre-token is encoded whole;
strings of special tokens are ordinary text; decoding gives back the exact bytes of the text.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship, table

#: Entries of the table of encoded pre-tokens in a worker; it is emptied when full.
CACHE_ENTRIES = 400_000


class Vocabulary:
    """Tokens by id, with the split of each token into the two that its last merge joined."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int]] = {}
        for t, i in sorted(ranks.items(), key=lambda x: x[1]):
            halves = self._last_merge(t, i)
            self.split[i] = halves or (i, i)
            if halves:
                self.pairs[halves] = i
        self.fits = lru_cache(maxsize=1 << 18)(self._fits)

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens left when all merges before ``rank`` are applied to ``token``; None for a single byte."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] >= rank:
                return None  # no order of merges makes it
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges leave the border between ``left`` and ``right`` open."""
        bound = 1 << 62  # rank at which the younger side was made; a merge over the border must come before it to win
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < bound:
                return False
            if left > right:  # the left one is younger: undo it
                inner = self.split[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                bound = right + 1
                if self.split[right][0] == right:
                    return True
                right = self.split[right][0]
            else:
                inner = self.split[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                bound = left
                if self.split[left][1] == left:
                    return True
                left = self.split[left][1]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        at: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, hit in self.automaton.iter(piece.decode("latin-1")):
            at[end - hit[0] + 1].append(hit)  # shorter ones come first
        open_, out, pos = bytearray(b"\x01") * (n + 1), [], 0  # out: (id, length, index in at)
        k = len(at[0]) - 1
        fits = self.fits
        while pos < n:
            here, last = at[pos], out[-1][0] if out else -1
            while k >= 0:
                size, token = here[k]
                if open_[pos + size] and (last < 0 or fits(last, token)):
                    break
                k -= 1
            if k >= 0:
                out.append((token, size, k))
                pos += size
                k = len(at[pos]) - 1 if pos < n else -1
            else:
                open_[pos] = 0
                _, size, k = out.pop()
                pos -= size
                k -= 1
        return [x[0] for x in out]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file: lines of base64 token and rank. Made once in a worker."""
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Texts to ids and back with one table of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary, self.find, self.known = vocabulary(path), regex.compile(pattern).findall, {}

    def pieces(self, text: str) -> list[tuple[int, ...]]:
        known, out = self.known, []
        for p in self.find(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= CACHE_ENTRIES:
                    known.clear()
                known[p] = ids = tuple(self.vocabulary.encode_piece(p.encode()))
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.pieces(text) for i in ids]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _path_and_pattern(path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array<int>) of each text. path: the rank file, at the same place on every executor."""
    ship(docs.sparkSession)
    path, pattern = _path_and_pattern(path, pattern)

    def run(batches):
        e = Encoder(path, pattern)
        for b in batches:
            ids = [e.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``data`` (binary) from doc_id and ids; null ids have no bytes."""
    ship(encoded.sparkSession)
    path, _ = _path_and_pattern(path, "")

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            data = [v.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 in one pass: the ids never leave the task."""
    ship(docs.sparkSession)
    path, pattern = _path_and_pattern(path, pattern)

    def run(batches):
        e = Encoder(path, pattern)
        numbers = [str(i).encode() for i in range(max(e.vocabulary.tokens) + 1)]
        for b in batches:
            n, ids_sha, back_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids = e.encode(t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b" ".join([numbers[i] for i in ids])).hexdigest())
                back_sha.append(hashlib.sha256(e.vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
