"""Operators 11 to 13 against plain loops, on small tables with the cases that go wrong."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

import __spark_entry__ as entry
from evidora.llm import divergence, interaction, langid
from tests import oracle


@pytest.mark.parametrize("name", ["op11_divergence", "op12_interaction"])
def test_whole_table_equals_sql(spark, small, name):
    oracle.check(spark, name, small, entry)


# --- divergence


def plain_divergence(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans(divergence.UPPER, divergence.LOWER)
    docs = [tuple(x or "" for x in r) for r in rows]
    df, n, groups = defaultdict(Counter), defaultdict(Counter), {(a, b) for a, b, _ in docs}
    for lang, source, text in docs:
        words = [w.translate(low) for w in term.findall(text)]
        df[lang].update(set(words))
        n[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [t for t, d in df[lang].items() if d >= least]
        peers = sorted(s for a, s in groups if a == lang)
        size = {s: sum(n[lang, s][t] for t in kept) for s in peers}
        p = lambda s, t: 1 + (10**9 * (n[lang, s][t] + 2)) // (size[s] + 2 * len(kept))
        q = {t: 1 + (10**9 * (sum(n[lang, s][t] for s in peers) + 2)) // (sum(size.values()) + 2 * len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        pair = [(sum(gap(p(source, t), p(o, t)) for t in kept), o) for o in peers if o != source]
        terms = [(gap(p(source, t), q[t]), t) for t in kept if n[lang, source][t] and p(source, t) > q[t]]
        for part, found, most in (("pair", pair, None), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out |= {(lang, source, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def hard_rows(seed):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "été", "ÉTÉ", "日本語", "x", "beta1gamma", "long" * 9 + "a", "long" * 9 + "b", "long" * 9, "\U00010400z", "ﬁ"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s1", "s2", None]), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(120)]
    return rows + [("xx", "only", None), ("xx", "only", ""), ("yy", "a", "12 3"), ("yy", "b", None), ("en", "s0", "alpha " * 4000)] + rows[:9]


@pytest.mark.parametrize("seed,least,top", [(1, 3, 3), (2, 1, 2), (3, 200, 10), (4, 2, 10)])
def test_divergence_equals_loops(spark, seed, least, top):
    rows = hard_rows(seed)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "'t' AS term", "'i' AS item", "2 AS value").repartition(5)
    found = divergence.audit(docs, least, top).collect()
    assert len(found) == len({tuple(r) for r in found})
    assert {tuple(r) for r in found} == plain_divergence(rows, least, top)


def test_divergence_of_an_empty_table(spark):
    got = divergence.audit(spark.createDataFrame([], "lang string, source string, text string"))
    assert got.collect() == [] and got.columns == ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("seed", range(3))
def test_radix_selection(spark, seed):
    rng = random.Random(seed)
    stem = "äbc" * 5
    rows = [(g, v, item) for g in "abc" for item in {stem[: rng.randint(0, 15)] + "xy"[rng.randint(0, 1)] * rng.randint(0, 9) + str(i % 7) for i in range(150)} for v in [rng.choice([0, 5, 5, 5, 70000, 2**31 + 3])]]
    rows += [("few", 9, "b"), ("few", 9, "a")]
    got = divergence.radix_top(spark.createDataFrame(rows, "g string, v long, item string"), ["g"], "v", "item", 7)
    want = {(g, v, i, n) for g in {r[0] for r in rows} for n, (_, v, i) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:7], 1)}
    assert {tuple(r) for r in got.collect()} == want


# --- interaction


def plain_interaction(rows, labels):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    bits = []
    for i, source, text in rows:
        text = text or ""
        words = split.findall(text)
        copy = i is not None and any(j is not None and j < i and (other or "") == text for j, _, other in rows)
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), copy]
        bits.append((source or "", fails, i in good, i in toxic))
    out = []
    for part in {b[0] for b in bits}:
        total, mine = Counter(), []
        for order in permutations(range(5)):
            left = [b for b in bits if b[0] == part]
            for step, f in enumerate(order, 1):
                gone = [b for b in left if b[1][f]]
                left = [b for b in left if not b[1][f]]
                fails = [b for b in bits if b[0] == part and b[1][f]]
                total[f] += len(gone)
                mine.append((part, "".join("ABCDE"[x] for x in order), step, len(left), len(gone), len(fails) - len(gone), sum(sum(b[1]) == 1 for b in fails), sum(b[2] for b in gone), sum(b[3] for b in gone), f))
        out += [(*m[:9], total[m[9]]) for m in mine]
    return sorted(out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "7 AS mask", "'x' AS part", "1 AS n", "'y' AS same").repartition(4)
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'z' AS source", "3 AS q")
    return sorted(tuple(r) for r in interaction.audit(docs, flags).collect())


@pytest.mark.parametrize("seed", range(3))
def test_interaction_equals_loops(spark, seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["a", "B#", "word%d" % rng.randint(0, 99), "CAPS", "x y", "é"]) for _ in range(rng.choice([3, 49, 50, 120]))) for _ in range(12)]
    texts = [*base, None, "", " \t ", "word " * 5000]
    rows = [(rng.choice([None, *range(60)]), rng.choice(["s", "t", None, ""]), rng.choice(texts)) for _ in range(150)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(80)]
    assert audited(spark, rows, labels) == plain_interaction(rows, labels)


def test_interaction_of_few_rows(spark):
    assert audited(spark, [], []) == []
    assert audited(spark, [(None, None, None)], []) == plain_interaction([(None, None, None)], [])


def test_polynomial_is_the_definition():
    rng = random.Random(5)
    counts = [rng.randint(0, 50) for _ in range(32)]
    curve = interaction.polynomial(counts)
    for chosen in range(32):
        assert interaction.corner(curve, chosen) == sum(n for m, n in enumerate(counts) if m & chosen)
    total = Counter()
    for order in permutations(range(5)):
        before = 0
        for i in order:
            total[i] += interaction.corner(curve, before | 1 << i) - interaction.corner(curve, before)
            before |= 1 << i
    assert [interaction.diagonal(curve, i) * 120 for i in range(5)] == [total[i] for i in range(5)]


# --- language


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in entry.queries()["op13_language"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert {i for i, r in found.items() if r["held_out"]} == {r["doc_id"] for r in held}
    assert sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    sure = [r for r in held if not found[r["doc_id"]]["rejected"]]
    assert len(sure) >= 0.95 * len(held) and all(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in sure)
    assert all(0 <= r["score"] <= 1 for r in found.values())


def plain_size(model, text):
    """Sizes by plain one-shot compression of each block."""
    import zstandard

    data, out = langid.fold(text), []
    for content in model.content.values():
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(model.level, source_size=model.block, dict_size=len(content), write_content_size=False, write_dict_id=False)
        out.append(sum(len(zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress(data[a : a + model.block])) for a in range(0, len(data), model.block)))
    return out


def test_language_edges(spark):
    english, french = "the cat and the dog are in the house with the others ", "le chat et le chien sont dans la maison avec les autres "
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, (english if i % 2 else french) * 5, "en" if i % 2 else "fr") for i in ids[:30]] + [(None, "nur ein Satz", "de"), (ids[31], "nobody told", None), (ids[32], None, "nl"), (ids[33], "12 34", "nl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert set(model.content) == {"en", "fr"} and all(len(c) <= langid.ROWS * (langid.PIECE * 4 + 1) for c in model.content.values())
    asked = [(1, None), (2, ""), (3, "123 -- 45"), (4, "THE HOUSE, THE DOG"), (5, "les chiens dans la maison"), (5, "les chiens dans la maison"), (None, "the dog"), (6, french * 20000), (7, "क्")]
    frame = spark.createDataFrame([(i, t, "?", 0.5, True) for i, t in asked], "doc_id long, text string, lang_pred string, score double, held_out boolean")
    got = langid.identify(frame, model).collect()
    assert len(got) == len(asked)
    by = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0)
    assert by[4][0] == "en" and by[5][0] == "fr" and by[6][0] == "fr" and by[7][0] in ("en", "fr") and by[6][1] > 0.99
    for text in ("the dog", french * 700, "x"):
        assert model.sizes(text) == plain_size(model, text)
    assert langid.identify(frame.limit(0), model).collect() == []
    nothing = langid.train(docs.where("lang IS NULL"))
    assert {r["lang_pred"] for r in langid.identify(frame, nothing).collect()} == {"und"}
    alone = langid.train(docs.where("lang = 'en'"))
    assert alone.predict("mot") == ("en", 1.0, None, False)
