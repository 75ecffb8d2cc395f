"""Token counts of a unigram tokenizer without building the tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each place; dynamic
programming carries the best score and, along the same path, the number of tokens. Ties are
resolved as the tokenizer does: a later candidate for the same end wins only with a strictly
better score, and candidates come in order of their start, so the longest piece wins. A character
without a piece of its own costs ten less than the worst score and, with byte fallback, counts
one token for each of its bytes. Scores are added as doubles.

Pieces never hold a space mark behind another character (checked when the vocabulary is loaded),
so a text falls apart at its space marks without changing the best path; parts are remembered.

Defined cases: a null or empty text has no tokens and score 0; spaces become space marks and one
is put in front of a text that isn't empty; control, unknown and byte entries of the vocabulary
never match text; null ids stay null, repeated rows are counted each, an empty table gives no rows; a very long
text is counted part by part; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts of texts a worker keeps before it starts anew; results don't depend on it.
PARTS_KEPT = 400_000


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.byte_fallback = byte_fallback
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        inner = regex.compile(f"[^{MARK}]{MARK}")
        self.parts_of = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if not any(inner.search(p) for p, _ in pieces) else lambda text: [text] if text else []
        self._parts: dict[str, tuple[int, float]] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> UnigramCounter:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in ids], any(model.is_byte(i) for i in range(model.get_piece_size())))

    def best(self, part: str) -> tuple[int, float]:
        """(tokens, score) of the best path over one part."""
        n = len(part)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(part):
            ends[end + 1].append(match)
        score, count, open_unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at in range(1, n + 1):
            best = None
            for length, value in sorted(ends[at], reverse=True):  # earliest start first
                candidate = score[at - length] + value
                if best is None or candidate > best:
                    best, tokens, is_open = candidate, count[at - length] + 1, False
            letter = part[at - 1]
            if letter not in self.single:
                candidate = score[at - 1] + self.unknown
                if best is None or candidate > best:
                    best, is_open = candidate, True
                    tokens = count[at - 1] + (len(letter.encode()) if self.byte_fallback else not open_unknown[at - 1])
            score[at], count[at], open_unknown[at] = best, tokens, is_open
        return count[n], score[n]

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        known, tokens, score = self._parts, 0, 0.0
        for part in self.parts_of(MARK + text.replace(" ", MARK)):
            got = known.get(part)
            if got is None:
                if len(known) >= PARTS_KEPT:
                    known.clear()
                got = known[part] = self.best(part)
            tokens += got[0]
            score += got[1]
        return tokens, score


_COUNTERS: dict[str, UnigramCounter] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, best_score) of every text; map-only, nothing is truncated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = UnigramCounter.from_sentencepiece(path)
        count = _COUNTERS[path].count
        for b in text_slices(batches):
            found = [count(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "n_tokens", "best_score"])

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_texts(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, best_score double")
