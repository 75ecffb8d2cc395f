"""Language identification by compression.

Every language has a dictionary of raw text. A text is folded (lower case, every run without letters one blank, so that neither shouting
nor tables of digits look like another language), cut into blocks, and each block is compressed with zstandard once for
every language, the dictionary given as preceding content. The language whose sizes sum to the least is chosen: what
the dictionary holds need not be spelled out. Blocks keep the dictionary as near at the end of a long text as at its start.

Sizes are code lengths, so ``2 ** -size`` is a likelihood; tempered by ``SHARP`` it gives each language a share, and the
winner's share is the score. A narrow margin (under ``NARROW`` of the size, or under ``NARROW_BYTES``) marks the choice as ``rejected``:
a caller who needs a certain language drops those, the best guess stays in ``lang_pred``.

The dictionaries are made of at most ``ROWS`` training rows a language (the first by a hash of the id), each of which gives one
piece of at most ``PIECE`` code points from a place by that hash; nothing else is learned. The model is that
large for each language that occurs, and a text is compressed once for each.

Defined cases: a null or letter-free text is ``und`` with score 0, as is every text if nothing could be learned; null languages, and ids that are null, train
nothing; equal sizes go to the language with more training rows, then to the smaller one; one language alone has score 1; repeated rows are judged each; an empty table gives no rows; a long
text is read to its end; other columns are never read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_slices

#: Training rows of a language and code points of each; bytes of a block; level of the compressor.
ROWS, PIECE, BLOCK, LEVEL = 128, 1024, 4096, 6
#: Part of a bit that a saved bit counts; margins that are narrow, as a part of the size and in bytes.
SHARP, NARROW, NARROW_BYTES = 0.25, 0.01, 2
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_REST = regex.compile(r"[^\p{L}\p{M}]+")


def fold(text: str) -> bytes:
    """What is compressed of a text: its letters in lower case, one blank for all else between them."""
    return _REST.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def held_out():
    """Column: rows that must not be learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def training_pieces(docs: DataFrame, rows: int = ROWS, piece: int = PIECE) -> dict[str, bytes]:
    """The dictionary of each language, that of most rows first. Counts find a hash threshold for each, so that only few rows are sorted."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select("lang", "text", F.xxhash64("doc_id", F.lit(13)).alias("h"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.element_at(F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 8 * rows / n)))]), F.col("lang"))
    drawn = known.where(F.pmod("h", F.lit(1 << 30)) < rate * (1 << 30)).where(F.col("text").rlike(r"\p{L}"))
    start = F.pmod(F.col("h"), F.greatest(F.char_length("text") - piece, F.lit(0)) + 1).cast("int") + 1
    pieces = drawn.select("lang", "h", F.substring("text", start, F.lit(piece)).alias("piece")).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    ranked = pieces.withColumn("at", F.expr("row_number() OVER (PARTITION BY lang ORDER BY h)")).where(F.col("at") <= rows)
    chosen = defaultdict(list)
    for r in sorted(ranked.collect(), key=lambda r: (-counts[r["lang"]], r["lang"], r["h"])):
        chosen[r["lang"]].append(r["piece"])
    return {lang: fold(" ".join(found)) for lang, found in chosen.items()}


class Languages:
    """Compressors of all languages, of which the first wins ties; they are built where they are used."""

    def __init__(self, content: dict[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.content, self.level, self.block = content, level, block
        self._ready = None

    def __getstate__(self):
        return (self.content, self.level, self.block)

    def __setstate__(self, state):
        self.__init__(*state)

    def _compressors(self):
        if self._ready is None:
            self._ready = []
            for content in self.content.values():
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                how = zstandard.ZstdCompressionParameters.from_level(self.level, source_size=self.block, dict_size=len(content), write_content_size=False, write_dict_id=False)
                known.precompute_compress(compression_params=how)
                self._ready.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        return self._ready

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole folded text with each language's dictionary."""
        data = memoryview(fold(text))
        return [sum(len(c.compress(data[at : at + self.block])) for at in range(0, len(data), self.block)) for c in self._compressors()]

    def predict(self, text: str | None) -> tuple[str, float, int | None, bool]:
        """(language, score, bytes to the second language, whether that is narrow)."""
        if text is None or not self.content or not _LETTER.search(text):
            return UNKNOWN, 0.0, None, True
        sizes = self.sizes(text)
        best = min(sizes)
        shares = [2.0 ** (-8 * SHARP * min(s - best, 500)) for s in sizes]
        margin = sorted(sizes)[1] - best if len(sizes) > 1 else None
        narrow = margin is not None and (margin < NARROW_BYTES or margin < NARROW * best)
        return list(self.content)[sizes.index(best)], 1.0 / sum(shares), margin, narrow


def train(docs: DataFrame, rows: int = ROWS, piece: int = PIECE) -> Languages:
    return Languages(training_pieces(docs, rows, piece))


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, margin, rejected) of every whole text; map-only."""
    source = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            found = [model.predict(t.as_py()) for t in b.column(2)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])

    return map_texts(source, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin long, rejected boolean")
