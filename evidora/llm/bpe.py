"""Byte-level BPE by prefix dynamic programming.

A byte-pair encoding is valid exactly when each pair of neighbouring tokens is: merging the
bytes of the two gives the same two back. From that follows that every byte prefix has one
valid last token. ``PrefixTable`` stores it for every prefix of a piece, so that appending
bytes only extends the table, and an edit only redoes the part behind it until the old
boundaries fit again.

Defined cases: a null text is the empty text; an empty text has no tokens, whose digests are
those of the empty string; pieces are cut by the pattern first and encoded separately; a piece
that is itself in the vocabulary is that one token; long runs without a cut are handled by the
same table in linear time; null ids stay null, repeated rows are
encoded each, an empty table gives no rows. Extra columns pass through ``encode_documents`` only if asked for.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices

RESULT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: Entries a worker keeps of pieces, prefixes and token pairs before it starts anew; results don't depend on it.
PIECES_KEPT, PREFIXES_KEPT, PAIRS_KEPT = 500_000, 700_000, 600_000
#: Pieces up to so many bytes share one table of prefixes; longer ones get a table of their own.
SHARED_BYTES = 48


class Vocabulary:
    """Ranks of a byte-level BPE and the test which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._prefixes: dict[bytes, int] = {}

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, piece: bytes) -> list[int]:
        """The textbook merge loop: lowest rank first, leftmost of equals. Used on two tokens only."""
        ranks, cuts = self.ranks, list(range(len(piece) + 1))
        while len(cuts) > 2:
            best, at = None, -1
            for i in range(len(cuts) - 2):
                r = ranks.get(piece[cuts[i] : cuts[i + 2]])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            del cuts[at + 1]
        return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]

    def stands_alone(self, token: int) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.token_bytes[token]) == [token]
        return known

    def neighbours(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self.merge(self.token_bytes[left] + self.token_bytes[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Tokens of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        return self._shared_tokens(piece) if len(piece) <= SHARED_BYTES else PrefixTable(self, piece).tokens()

    def _shared_tokens(self, piece: bytes) -> list[int]:
        """Tokens by the table of prefixes that all short pieces share: only unseen prefixes are worked out."""
        table, get, pairs = self._prefixes, self.ranks.get, self._pairs.get
        if len(table) >= PREFIXES_KEPT:
            table.clear()
        n = known = len(piece)
        while known and piece[:known] not in table:
            known -= 1
        for end in range(known + 1, n + 1):
            token = get(piece[:end])
            if token is not None and self.stands_alone(token):
                table[piece[:end]] = token
                continue
            for begin in range(max(1, end - self.longest), end):
                token = get(piece[begin:end])
                if token is not None:
                    left = table[piece[:begin]]
                    fits = pairs(left << 20 | token)
                    if fits or fits is None and self.neighbours(left, token):
                        table[piece[:end]] = token
                        break
            else:
                raise ValueError("the vocabulary lacks a single byte")
        out = []
        while n:
            token = table[piece[:n]]
            out.append(token)
            n -= len(self.token_bytes[token])
        return out[::-1]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])


class PrefixTable:
    """For every byte prefix of one piece, its one valid last token."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; what the table holds of the shorter prefixes stays as it is."""
        start = len(self.piece)
        self.piece += more
        self._extend(start, len(self.piece))

    def _extend(self, start: int, stop: int) -> None:
        piece, last, v = self.piece, self.last, self.vocabulary
        get, longest = v.ranks.get, v.longest
        for end in range(start + 1, stop + 1):
            last.append(self._token_at(piece, last, v, get, longest, end))

    @staticmethod
    def _token_at(piece, last, v, get, longest, end) -> int:
        for begin in range(max(0, end - longest), end):
            token = get(piece[begin:end])
            if token is not None and (v.neighbours(last[begin], token) if begin else v.stands_alone(token)):
                return token
        raise ValueError("the vocabulary lacks a single byte")

    def replace(self, begin: int, end: int, by: bytes) -> int:
        """Replace bytes and bring the table up to date; returns how many prefixes were redone.

        Prefixes before the edit keep their tokens. Behind it the old tokens fit again from the
        first stretch on, as long as the longest token, in which all new tokens equal the old ones.
        """
        old_last, old_len = self.last, len(self.piece)
        self.piece = self.piece[:begin] + by + self.piece[end:]
        self.last = old_last[: begin + 1]
        v, shift, same, done = self.vocabulary, len(by) - (end - begin), 0, 0
        for stop in range(begin + 1, len(self.piece) + 1):
            token = self._token_at(self.piece, self.last, v, v.ranks.get, v.longest, stop)
            self.last.append(token)
            done += 1
            old = stop - shift
            same = same + 1 if old > end and old_last[old] == token else 0
            if same >= v.longest and old < old_len:
                self.last.extend(old_last[old + 1 :])
                break
        return done

    def tokens(self) -> list[int]:
        out, at = [], len(self.piece)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.token_bytes[self.last[at]])
        return out[::-1]


class _Pieces(dict):
    """Piece to (ids in decimal, decoded bytes); what is missing is encoded, and a full table starts anew."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.vocabulary.encode_piece(piece.encode())
        if len(self) >= PIECES_KEPT:
            self.clear()
        got = self[piece] = (" ".join(map(str, ids)), self.vocabulary.decode(ids))
        return got


class TextEncoder:
    """Whole texts: cut by a pattern, encode the pieces, remember those met before."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.cut = vocabulary, regex.compile(pattern).findall
        self._pieces = _Pieces(vocabulary)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.cut(text) for i in self.vocabulary.encode_piece(piece.encode())]

    def digest(self, text: str, with_ids: bool = False) -> tuple:
        """Number of tokens, SHA-256 of the ids in decimal, SHA-256 of the decoded bytes; the ids too if asked for."""
        pieces = self.cut(text)
        ids, decoded = zip(*map(self._pieces.__getitem__, pieces)) if pieces else ((), ())
        ids = " ".join(ids)
        n = ids.count(" ") + 1 if ids else 0
        found = n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()
        return (*found, np.fromstring(ids, np.int32, sep=" ")) if with_ids else found


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker and vocabulary."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = TextEncoder(Vocabulary.from_file(path), pattern)
    return _ENCODERS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, keep: bool = False, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text of (doc_id, text, ...).

    Map-only. ``path`` is the rank file, which every executor finds at the same place. ``keep``
    adds the columns of the input, ``with_ids`` the token ids as ``token_ids``.
    """
    kept = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")] if keep else ["doc_id"]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    fields = [f"`{c}` {source.schema[c].dataType.simpleString()}" for c in kept]
    schema = ", ".join(fields + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["token_ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in text_slices(batches):
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [own.digest(t, with_ids) for t in texts]
            columns = [b.column(i) for i in range(len(kept))]
            columns += [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            if with_ids:
                ids = [x[3] for x in found]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids])

    return map_texts(source, run, schema)
