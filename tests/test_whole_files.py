"""Files that are longer than a block of pages: one file a source, whatever its length."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evidora.operators import along as A
from evidora.operators import documents
from tests.oracle import oracle_rows, rows_of

#: Documents of pages 491 to 511, across the 500 pages at which files were once cut.
FIRST, LAST = 9800, 10219


@pytest.fixture(scope="module")
def long_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("long")
    d = spark.range(FIRST, LAST + 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, "es").otherwise("en").alias("lang"), F.concat(F.lit("src"), (F.col("id") % 20).cast("string")).alias("source"), F.lit(10).cast("bigint").alias("n_chars"))
    return _stored(d, folder)


def _stored(d, folder) -> str:
    (folder / "duck").mkdir()
    d.toPandas().to_parquet(folder / "duck" / "documents.parquet")
    d.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _rows(spark, folder, name):
    got = rows_of(spark, name, folder, entry)
    assert got == oracle_rows(name, f"{folder}/duck", entry)
    return got[0], [tuple(map(eval, r)) for r in got[1]]


def _of(columns, rows, **wanted):
    return [dict(zip(columns, r)) for r in rows if all(r[columns.index(c)] == v for c, v in wanted.items())]


def test_heading_ffill(spark, long_files):
    r = _of(*_rows(spark, long_files, "heading_ffill"), source_file="src7", pdf_page_number=501)
    assert [(x["h1"], x["h2"]) for x in r] == [("Part 41", "Topic 166")]  # page 493 has the part, page 499 the topic


def test_snippet_prev_next(spark, long_files):
    r = _of(*_rows(spark, long_files, "snippet_prev_next"), source_file="src7")
    seen = {x["pdf_page_number"]: (x["preceding_text"], x["following_text"]) for x in r}
    assert seen[499] == ("text 9947", "text 10007") and seen[501] == ("text 9967", "text 10027")  # page 500 is a table
    assert seen[491] == ("", "text 9827") and seen[511] == ("text 10167", "")


def test_sequence_ids(spark, long_files):
    r = _of(*_rows(spark, long_files, "sequence_ids"), source_file="src7")
    assert sorted(x["sequence_id"] for x in r) == sorted(x["island"] for x in r) == list(range(1, 15))


def test_asset_counts_pivot(spark, long_files):
    columns, rows = _rows(spark, long_files, "asset_counts_pivot")
    assert len(rows) == 20 and [(x["n_table"], x["pages"]) for x in _of(columns, rows, source_file="src7")] == [(4, 511)]


def test_seq_neighbours_pm3(spark, long_files):
    r = _of(*_rows(spark, long_files, "seq_neighbours_pm3"), source_file="src7")
    assert sorted(x["sequence_id"] for x in r) == [497, 498, 499, 501, 502, 503]


def test_context_union(spark, long_files):
    r = _of(*_rows(spark, long_files, "context_union"), source_file="src7")
    assert sorted((x["sequence_id"], x["is_extra"]) for x in r) == [(i, i != 500) for i in range(497, 504)]


def test_heading_levels(spark, long_files):
    r = _of(*_rows(spark, long_files, "heading_levels"), source_file="src7", pdf_page_number=501)
    assert [(x["parent_path"], x["section_title"]) for x in r] == [("Part 41 > Topic 166 > Step 500", "Step 500")]


@pytest.mark.parametrize("name", ["seq_neighbours_pm3", "context_union"])
def test_places_that_many_chunks_share_come_once(spark, tmp_path, name):
    d = spark.range(300, 500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    assert len(_rows(spark, _stored(d, tmp_path), name)[1]) == (7 if name == "context_union" else 6)


ROWS = "source_file string, page int, ord int, element_type string, content string, h1_here string, h2_here string, h3_here string"


def _random_rows(seed: int) -> list[tuple]:
    dice = random.Random(seed)
    some = lambda share, text: text if dice.random() < share else None
    return [(f, page, n, dice.choice(["TEXT", "TEXT", "TABLE"]), some(0.8, f" {f}{page}.{n} "), some(0.1, f"a{page}"), some(0.2, f"b{page}"), some(0.3, dice.choice(["", f"c{page}"]))) for f in ("x", "y", None) for page in sorted(dice.sample(range(1, 60), 30)) for n in range(dice.choice([1, 1, 3]))]


def _plain(rows: list[tuple]) -> dict:
    """(file, page, ord) to h1, h2, h3 of heading_levels, h2 of heading_fill, texts before and after, island and sequence id, row by row."""
    out = {}
    for f in dict.fromkeys(r[0] for r in rows):
        mine = sorted((r for r in rows if r[0] == f), key=lambda r: r[1:3])
        heads, island, last, number, kinds = [None] * 3, 0, None, {}, {}
        texts = [r[4].strip() if r[3] == "TEXT" and r[4] is not None else None for r in mine]
        for i, r in enumerate(mine):
            for level in range(3):
                if r[5 + level] is not None:
                    heads[level:] = [r[5 + level]] + [None] * (2 - level)
            section = heads[1] or heads[0] or ""
            island += not (r[3] == "TEXT" and last == ("TEXT", section) and section != "")
            last = (r[3], section)
            kinds[island] = r[3]
            near = [next((t for t in found if t is not None), "") for found in (texts[:i][::-1], texts[i + 1 :])]
            out[r[:3]] = [*heads, heads[1], *near, island]
        number = {k: n for n, k in enumerate(sorted(kinds, key=lambda k: (kinds[k] != "TEXT", k)), 1)}
        for r in mine:
            out[r[:3]].append(number[out[r[:3]][-1]])
    return out


@pytest.mark.parametrize("block", [0, 1, 3, 500])
def test_blocks_meet_like_whole_files(spark, monkeypatch, block):
    monkeypatch.setattr(A, "BLOCK", block or 500)
    monkeypatch.setattr(documents, "BLOCK", block or 500)
    rows, order, blocks = _random_rows(block), ["page", "ord"], block > 0
    e, wanted = spark.createDataFrame(rows, ROWS).repartition(5), _plain(rows)
    of = lambda df, *names: {(r["source_file"], r["page"], r["ord"]): [r[n] for n in names] for r in df.collect()}
    assert of(documents.heading_levels(e, order), "h1", "h2", "h3") == {k: v[:3] for k, v in wanted.items()}
    filled = documents.heading_fill(e, order, blocks)
    assert of(filled, "h1", "h2") == {k: [v[0], v[3]] for k, v in wanted.items()}
    assert of(documents.snippets(e, order), "preceding_text", "following_text") == {k: v[4:6] for k, v in wanted.items()}
    sections = documents.sequence_ids(documents.merge_sections(filled, order, blocks), ["island"], blocks).collect()
    assert {(r["source_file"], r["island"], r["sequence_id"]) for r in sections} == {(k[0], v[6], v[7]) for k, v in wanted.items()}
    texts = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), *r[1:3])):
        texts.setdefault((r[0], wanted[r[:3]][6]), []).append(r[4])
    assert {(r["source_file"], r["island"]): r["content"] for r in sections} == {k: "\n\n".join(t for t in v if t is not None) for k, v in texts.items()}
