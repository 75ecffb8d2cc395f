"""Fingerprints, repeats, mixing, near copies, search and the pipeline against plain versions, and their defined cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evidora.llm import components, mixing, queries, repeats, simhash, stages, topk, winnowing
from tests.oracle import check

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string"


def corpus(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], SCHEMA)


WORDS = [f"w{i}x{i * 7 % 13}" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- 2 -----------------------------------------------------------------------------------------------
def plain_chosen(text, k=winnowing.K, w=winnowing.W):
    """(rank, place, hash) chosen by the definition, in order of place."""
    raw = text.encode("utf-32-be")
    runs = [raw[4 * i : 4 * (i + k)] for i in range(len(text) - k + 1)] or [raw] * bool(text)
    hashed = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    ranked = [((h >> 32) & 0x7FFFFFFF, -i, h) for i, h in enumerate(hashed)]
    found = {min(ranked[a : a + w]) for a in range(max(1, len(ranked) - w + 1))} if ranked else set()
    return sorted(((r, -i, h - (h >> 63 << 64)) for r, i, h in found), key=lambda x: x[1])


def plain_print_of(text):
    chosen = plain_chosen(text)
    return hashlib.sha256(("[" + ",".join(str((r << 32) - (4 * i + 1)) for r, i, _ in chosen) + "]").encode()).hexdigest(), {h for _, _, h in chosen}


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_comparison(texts):
    """Rows of the query but for doc_id, for texts in order."""
    out = []
    for i, t in enumerate(texts):
        n, q = texts[(i + 1) % len(texts)], len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        (own, a), (changed, b), (_, c) = plain_print_of(t), plain_print_of(edited), plain_print_of(n)
        out.append((len(t), hashlib.sha256(edited.encode()).hexdigest(), own, changed, plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_winnowing_against_its_definition(spark):
    texts = ["", "a", "abc def", "elevenchars", "twelve chars", prose(1, 50), "same " * 60, "é中\U0001F600 x" * 20, "nospace" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: list(zip(r["hashes"], r["positions"])) for r in winnowing.fingerprint_documents(df).collect()}
    assert got == {i: [(h, p) for _, p, h in plain_chosen(t)] for i, t in enumerate(texts)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab中\U0001F600"), max_size=90), min_size=1, max_size=12))
def test_winnowing_columns_of_any_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in winnowing.compare_documents(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_comparison(texts)


def test_winnowing_guarantee_without_blanks(spark):
    """Runs of w + k - 1 code points in two texts share a chosen gram at the same place of the run."""
    r, least = random.Random(4), winnowing.W + winnowing.K - 1
    pool = "abcdefghijklmnopqrstuvwxyz中\U0001F600"
    some = lambda n: "".join(r.choice(pool) for _ in range(n))
    pairs = []
    for n in (least, least + 1, 60, 216, 400):
        for before in (0, 1, 2, 3, 7):
            run = some(n)
            pairs.append((run, "x" * before + run, 0, before, n))
            pairs.append((some(5) + run + some(9), some(before) + run + some(3), 5, before, n))
    df = spark.createDataFrame([(2 * i + j, p[j]) for i, p in enumerate(pairs) for j in (0, 1)], "doc_id bigint, text string")
    got = {x["doc_id"]: set(zip(x["hashes"], x["positions"])) for x in winnowing.fingerprint_documents(df).collect()}
    for i, (_, _, a, b, n) in enumerate(pairs):
        inside = lambda found, at: {(h, p - at) for h, p in found if at <= p <= at + n - winnowing.K}  # noqa: B023, E731
        shared = inside(got[2 * i], a) & inside(got[2 * i + 1], b)
        places = sorted(p for _, p in shared)
        assert places and all(z - y <= winnowing.W for y, z in zip(places, places[1:]))


def test_winnowing_documents(spark):
    rows = [(5, prose(2, 80)), (2, None), (9, ""), (7, "one"), (5, prose(2, 80)), (None, prose(3, 30)), (40, prose(4, 3000)), (41, "z" * 700), (42, "short"), (43, prose(5, 90))]
    got = winnowing.compare_documents(corpus(spark, rows)).collect()
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))
    want = plain_comparison([t or "" for _, t in order])
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, (i, *w))) for (i, _), w in zip(order, want))
    one = winnowing.compare_documents(corpus(spark, [(1, "abcdefgh")])).collect()
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert winnowing.compare_documents(corpus(spark, [])).count() == 0


def test_winnowing_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.op2_winnowing(spark, small).collect()}
    assert [got[r["doc_id"]] for r in docs] == plain_comparison([r["text"] or "" for r in docs])


def test_winnowing_is_native(spark, small):
    plan = queries.op2_winnowing(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_winnowing_tells_edited_from_next(spark, small):
    r = queries.op2_winnowing(spark, small).agg(F.median("near_edited").alias("e"), F.median("near_next").alias("n")).first()
    assert r["e"] > 0.5 > 0.1 > r["n"]


# --- 4 -----------------------------------------------------------------------------------------------
def plain_repeats(texts):
    seen = Counter(t[p : p + 400] for t in texts for p in range(len(t) - 399))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                gone[p : p + 400] = b"\1" * 400
        out.append((len(t), sum(gone), sum(1 for a, b in zip(b"\0" + bytes(gone), gone) if b and not a), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def repeat_rows():
    passage, line = prose(11, 120), prose(12, 30)
    rows = [(i, prose(100 + i, 60) + (" " + passage if i % 2 else "") + prose(200 + i, 30)) for i in range(8)]
    rows += [(20, "z" * 1500), (21, "ab" * 500), (22, prose(7, 90)), (22, prose(7, 90)), (23, None), (24, ""), (None, passage[:450]), (25, passage[:399]), (26, passage[3:403]), (27, line * 6), (28, "é中" * 300 + "x"), (29, prose(31, 20) + "é中" * 300)]
    return rows


def test_repeats_against_brute_force(spark):
    rows = repeat_rows()
    want = sorted(plain_repeats([(t or "").encode() for _, t in rows]))
    found = repeats.remove_repeats(corpus(spark, rows)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
    assert all(r["n_kept"] == r["n_bytes"] - r["n_removed"] for r in found)


def test_repeats_of_equal_ids(spark):
    """Texts that share an id, or have none, keep their own spans."""
    passage = prose(77, 90)
    rows = [(i % 2 or None, prose(3000 + i, 70) + (passage if i % 3 == 0 else "") + prose(4000 + i, 20)) for i in range(24)] * 2
    rows += [(1, prose(5000 + i, 130)) for i in range(12)]
    want = sorted(plain_repeats([t.encode() for _, t in rows]))
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(corpus(spark, rows)).collect()) == want


def test_repeats_with_hot_core_over_many_partitions(spark):
    """One passage in most of many short rows, dealt over many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        passage = prose(78, 110)
        rows = [(i, (passage[i % 7 :] if i % 5 else "") + prose(6000 + i, 12)) for i in range(300)]
        want = sorted(plain_repeats([t.encode() for _, t in rows]))
        got = repeats.remove_repeats(corpus(spark, rows).repartition(37)).collect()
        assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeats_in_parts(monkeypatch):
    """Long texts are ranked in parts: the blocks are the same."""
    texts = [prose(1, 3000).encode(), ("z" * 2000).encode(), prose(2, 40).encode()]
    whole = repeats.blocks_of(texts, None, 128)
    monkeypatch.setattr(repeats, "AT_ONCE", 3001)
    parts = repeats.blocks_of(texts, None, 128)
    assert all((whole[k] == parts[k]).all() for k in ("text", "s", "n", "d", "core", "fits"))
    assert (whole["hull"] == parts["hull"])[whole["fits"]].all()


def test_repeats_empty(spark):
    assert repeats.remove_repeats(corpus(spark, [])).count() == 0


def test_repeats_query(spark, small):
    rows = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(zip([r["doc_id"] for r in rows], plain_repeats([r["text"].encode() for r in rows])))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op4_repeats(spark, small).collect()}
    assert got == want


# --- 5 -----------------------------------------------------------------------------------------------
def test_mixing_sql(spark, small):
    check(spark, "op5_mixing", small, entry)


def test_raking_meets_targets():
    cells = {("a", "x", "t"): 900.0, ("a", "y", "t"): 50.0, ("b", "x", "u"): 30.0, ("b", "y", "t"): 20.0, ("a", "x", "u"): 10.0}
    targets = [{"a": 0.5, "b": 0.5}, {"x": 0.6, "y": 0.4}, {"t": 0.7, "u": 0.3}]
    got = mixing.rake(cells, targets, 400)
    for i, t in enumerate(targets):
        for v, share in t.items():
            assert abs(sum(w for c, w in got.items() if c[i] == v) / sum(got.values()) - share) < 1e-6


def test_raking_converges_or_warns():
    cells = {(a, x, t): float(1 + (a * 7 + x * 3 + t) % 11) for a in range(20) for x in range(4) for t in range(5)}
    targets = [mixing.default_targets(dict(Counter({v: sum(w for c, w in cells.items() if c[i] == v) for v in {c[i] for c in cells}})), p) for i, p in enumerate((0.7, 0.8, 0.9))]
    got = mixing.rake(cells, targets)
    off = max(abs(sum(w for c, w in got.items() if c[i] == v) / sum(got.values()) - share) for i, t in enumerate(targets) for v, share in t.items())
    assert off < 1e-9
    with pytest.warns(UserWarning, match="off its targets"):
        mixing.rake({("a", "x"): 1.0, ("b", "y"): 1.0}, [{"a": 0.9, "b": 0.1}, {"x": 0.1, "y": 0.9}])


def test_mixing_rows(spark):
    rows = [(1, "a b c", "en", "s", 1, "x"), (1, "a b c", "en", "s", 1, "x"), (2, None, None, None, 1, "x"), (3, "", "de", "s", 0, "y"), (None, "w " * 70, "fr", "t", 1, "z")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and {r["kept"] for r in got} <= {0, 1} and len({r["kept"] for r in got if r["row"]["doc_id"] == 1}) == 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forms():
    forms = {"": "empty", "a line with 1 number in it": "figures", "a plain line, without any": "short", "| a || b || c |": "marked", "w " * 60: "prose", "w " * 1000: "book"}
    import duckdb

    form = mixing.ORACLE_SQL[: mixing.ORACLE_SQL.index("), c AS (")]
    for text, want in forms.items():
        rows = duckdb.sql(f"WITH documents AS (SELECT 1 AS doc_id, '{text}' AS text, 'en' AS lang, 's' AS source){form[form.index('WITH d AS') - 1 :].replace('WITH d', ', d', 1)}) SELECT topic FROM t").fetchall()
        assert rows == [(want,)], (text, rows)


def test_mixing_own_topics(spark):
    rows = [(i, "a b c d e f", "en", "s", 11, "rare" if i % 10 == 0 else "hot") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), {"topic": {"rare": 0.5, "hot": 0.5}}, F.col("score")).where("kept = 1")
    kept = {r["topic"]: r["n"] for r in got.groupBy("topic").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(kept["rare"] / sum(kept.values()) - 0.5) < 0.06


def test_mixing_clashing_names(spark):
    names = ["row", "topic", "factor", "probability", "kept", "n_tokens", "key", "k", "t", "component_id", "node", "fp", "a.b"]
    df = spark.createDataFrame([(i, prose(i, 30), "en", "s", 9, "x", *range(len(names))) for i in range(40)], SCHEMA + "".join(f", `{n}` int" for n in names))
    for stage in (stages.sample_mixture, stages.drop_near_copies):
        got = stage(df)
        assert got.columns == df.columns and 0 < got.count() <= 40


def test_mixing_far_way_agrees(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    near, bounded = mixing.factors(d)
    far, not_bounded = mixing.factors(d, bound=1)
    key = lambda df: {(r["source"], r["lang"], r["topic"]): round(r["factor"], 6) for r in df.collect()}
    assert bounded and not not_bounded and key(near) == key(far)


def test_mixing_explicit_targets(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix(d, {"lang": {"en": 0.5, "de": 0.5}})
    shares = {r["lang"]: r["w"] for r in got.groupBy("row.lang").agg(F.sum(F.col("factor") * F.col("n_tokens")).alias("w")).collect()}
    assert abs(shares["en"] / shares["de"] - 1) < 1e-6


def test_mixing_marginals(spark, small):
    """Weighted by their probabilities, the tokens meet every target."""
    got = mixing.mix(spark.read.parquet(f"{small}/documents.parquet")).select("row.source", "row.lang", "topic", "n_tokens", "probability")
    rows = got.collect()
    assert all(0 < r["probability"] <= 1 for r in rows)
    for dim in mixing.DIMENSIONS:
        own, kept = Counter(), Counter()
        for r in rows:
            own[r[dim]] += r["n_tokens"]
            kept[r[dim]] += r["n_tokens"] * r["probability"]
        for v, share in mixing.default_targets(own, mixing.POWERS[dim]).items():
            assert abs(kept[v] / sum(kept.values()) - share) < 1e-6


def test_kept_tokens_meet_targets(spark):
    rows = [(i, "a b c d e f", "en", "rare" if i % 10 == 0 else "hot", 11, "x") for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), {"source": {"hot": 0.5, "rare": 0.5}}).where("kept = 1")
    kept = {r["source"]: r["n"] for r in got.groupBy("row.source").agg(F.sum("n_tokens").alias("n")).collect()}
    assert abs(kept["rare"] / sum(kept.values()) - 0.5) < 0.05


# --- 9 -----------------------------------------------------------------------------------------------
def plain_print(text, words=4):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids[:a]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def test_simhash_against_brute_force(spark):
    base = prose(5, 150).split()
    rows = [(i, " ".join([*base[: 150 - i], f"N{i}", *base[150 - i :]])) for i in range(1, 25)]
    rows += [(30 + i, prose(60 + i, 40)) for i in range(10)] + [(50, None), (51, ""), (52, "one two"), (53, "ONE two"), (53, "ONE two"), (54, "\x1c a")]
    got = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_components(corpus(spark, rows), 4, 4).collect())
    prints = [plain_print(t) for _, t in rows]
    root = plain_components(prints, 4)
    assert got == sorted((i, p, min(rows[j][0] for j in range(len(rows)) if root[j] == r)) for (i, _), p, r in zip(rows, prints, root))
    assert simhash.near_components(corpus(spark, []), 4, 4).count() == 0


@pytest.mark.parametrize("tiles", [(3, 5), (256, 2048)])
def test_tiles_find_every_link(monkeypatch, tiles):
    monkeypatch.setattr(simhash, "TILE_ROWS", tiles[0])
    monkeypatch.setattr(simhash, "TILE_COLUMNS", tiles[1])
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints for _ in range(2)]
    prints = list(dict.fromkeys(prints))
    half = len(prints) // 2
    left, right = np.array(prints[:half], np.uint64), np.array(prints[half:], np.uint64)
    links = [simhash.tiled_links(left, None, 4), simhash.tiled_links(right, None, 4), simhash.tiled_links(left, right, 4)]
    pairs = [(int(a), int(b)) for x, y in links for a, b in zip(x, y)]
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
    place = {p: i for i, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == plain_components(prints, 4)


def test_one_of_each(spark):
    base = prose(8, 200)
    rows = [(1, base), (1, base), (2, base + " end"), (3, prose(9, 200)), (4, None), (5, ""), (None, prose(10, 100)), (6, base.replace(WORDS[3], "changed", 1))]
    got = stages.drop_near_copies(corpus(spark, rows))
    assert got.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(x or 0 for x in kept) in ([0, 1, 3, 4], [0, 1, 3, 5])


def jaccard(a, b, words=5):
    x, y = (set(simhash.shingle_hashes(t, words, 42)) for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("block", [8 << 20, 4000])
def test_near_copies_are_checked_exactly(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "SET_BYTES", block)
    r, rows = random.Random(12), []
    for g in range(30):
        base = prose(500 + g, 300).split()
        for c in range(4):
            copy = base[:]
            for at in r.sample(range(300), 1 + 3 * c):
                copy[at] = f"c{g}x{c}x{at}"
            rows.append((10 * g + c, " ".join(copy)))
    prints = [plain_print(t, 5) for _, t in rows]
    marks = simhash.sketches([simhash.shingle_hashes(t, 5, 42) for _, t in rows])
    root, wrong = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 12 and simhash.alike(marks[a : a + 1], marks[b : b + 1])[0] >= 0.8 - simhash.SLACK:
                if jaccard(rows[a][1], rows[b][1]) >= 0.8:
                    root[max(find(a), find(b))] = min(find(a), find(b))
                else:
                    wrong += 1
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_components(corpus(spark, rows), 5, 12, 42, 0.8).collect()}
    assert wrong and len(set(got.values())) < len(rows)
    assert got == {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("block", [16_384, 40])
def test_near_copies_recall(spark, monkeypatch, block):
    """Pairs of likeness 0.8 or more that the stage misses, and pairs below it that it joins, against all pairs."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    r, rows = random.Random(21), []
    for g in range(120):
        base = prose(900 + g, r.randint(60, 400)).split()
        copy = base[:]
        for at in r.sample(range(len(base)), max(1, int(len(base) * r.uniform(0.005, 0.03)))):
            copy[at] = f"c{g}x{at}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_components(corpus(spark, rows), 5, 18, 42, 0.8).collect()}
    near = [jaccard(rows[2 * g][1], rows[2 * g + 1][1]) >= 0.8 for g in range(120)]
    joined = [got[2 * g] == got[2 * g + 1] for g in range(120)]
    assert 40 < sum(near) < 110 and not any(j and not n for j, n in zip(joined, near))
    assert sum(n and j for n, j in zip(near, joined)) >= 0.97 * sum(near)


def test_equal_fingerprints_of_different_texts(spark):
    line = "this very line stands on every page of it "
    rows = [(i, line * 400 + " ".join(f"own{i}n{j}" for j in range(300))) for i in range(3)]
    rows += [(10, rows[0][1]), (11, rows[1][1].replace("own1n299", "changed"))]
    assert len({plain_print(t, 5) for _, t in rows}) == 1 and jaccard(rows[0][1], rows[1][1]) < 0.05
    assert sorted(r["doc_id"] for r in stages.drop_near_copies(corpus(spark, rows)).collect()) == [0, 1, 2]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (100, 101)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(50)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------
def test_topk_sql(spark, small):
    check(spark, "op10_topk", small, entry)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 20), st.integers(0, 10_000))
def test_topk_block(n, d, seed):
    r = np.random.default_rng(seed)
    rows, ids = r.integers(-3, 4, (n, d)).astype(float), r.permutation(n)
    asked = slice(0, min(n, 7))
    got = topk.top_of_block(ids[asked], rows[asked], ids, rows, 5)
    want = [(q, c, int(s)) for q, v in zip(ids[asked], rows[asked]) for s, c in sorted(((v @ x, i) for i, x in zip(ids, rows) if i != q), key=lambda t: (-t[0], t[1]))[:5]]
    assert list(zip(*map(list, got))) == want


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 1.0]), (6, [1.0]), (7, []), (8, [1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int"))
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == [(0, 1, 50), (0, 2, 5), (0, 3, 8), (50, 1, 0), (50, 2, 5), (50, 3, 8)]
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_topk_blocks_agree(spark, small, monkeypatch):
    want = sorted(map(tuple, queries.op10_topk(spark, small).collect()))
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 100)
    assert sorted(map(tuple, queries.op10_topk(spark, small).collect())) == want


# --- pipeline ------------------------------------------------------------------------------------------
def test_pipeline(spark, small, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "bpe_encoding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        ids = [r["doc_id"] for r in rows]
        assert ids and set(ids) <= set(before) and len(set(ids)) == len(ids)
        if name != "bpe_encoding":
            assert docs.columns == columns
        if name in ("toxicity", "simhash_near_dedup"):
            assert all(before[r["doc_id"]] == r["text"] for r in rows)
        if name == "secret_scan":
            assert len(ids) == len(last) and all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not any("AKIA" in r["text"] for r in rows)
        if name == "mixing":
            kept = {r["row"]["doc_id"]: r["kept"] for r in mixing.mix(spark.read.parquet(str(tmp_path / "2"))).collect()}
            assert set(ids) == {k for k, v in kept.items() if v}
        last = ids
    assert corpus_pipeline.run(spark, small).count() == len(last)


def plain_dedup(rows, model_radius=18):
    """One row of each group linked by radius, estimate and exact likeness, and of each text, by comparing all pairs."""
    texts = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        texts.setdefault(r["text"], r)
    rows = list(texts.values())
    hashes = [simhash.shingle_hashes(r["text"], 5, 42) for r in rows]
    prints, sets = [plain_print(r["text"], 5) for r in rows], [set(h) for h in hashes]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= model_radius and (both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [r for i, r in enumerate(rows) if find(i) == i]


def plain_mix(rows):
    import re

    def form(text, n):
        marks, numbers = len(re.findall(r"[!-/:-@\[-`{-~]{2,}", text)), len(re.findall("[0-9]+", text))
        return "empty" if not n else "marked" if 12 * marks >= n else "figures" if 12 * numbers >= n else "short" if n < 50 else "prose" if n < 1000 else "book"

    counts = [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in rows]
    cell_of = [(r["source"], r["lang"], form(r["text"], n)) for r, n in zip(rows, counts)]
    cells = Counter()
    for c, n in zip(cell_of, counts):
        cells[c] += n
    sums = [Counter() for _ in range(3)]
    for c, n in cells.items():
        for i in range(3):
            sums[i][c[i]] += n
    targets = [mixing.default_targets(s, p) for s, p in zip(sums, mixing.POWERS.values())]
    weight = mixing.rake({c: float(n) for c, n in cells.items()}, targets)
    factor = {c: weight[c] / n if n else 1.0 for c, n in cells.items()}
    most = max(factor.values())
    drawn = lambda i: int(hashlib.md5(f"{mixing.SALT}{i}".encode()).hexdigest()[:8], 16) / 2**32
    return [r for r, c in zip(rows, cell_of) if drawn(r["doc_id"]) < factor[c] / most]


def test_pipeline_against_a_plain_version(spark, small):
    """The whole result, by loops over the rows: the model's score, all pairs, masks, counted cells and the public encoder."""
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from evidora.llm import secrets, toxicity

    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model, field = toxicity.fit(docs, labels), secrets.train()
    rows = [r.asDict() for r in docs.collect() if model.score(r["text"] or "") < 0.5]
    rows = plain_dedup(rows)
    for r in rows:
        found = sorted((a, z) for a, _, z in secrets.all_spans(r["text"], field)[1])
        for a, z in reversed(found):
            r["text"] = r["text"][:a] + "[SECRET]" + r["text"][z:]
    rows = plain_mix(rows)
    ranks = load_tiktoken_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for r in rows:
        ids = encoder.encode(r["text"], disallowed_special=())
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and len(got) > 20


def test_very_long_text_in_near_copies(spark):
    """One text of over 65,536 shingles, whose bits are counted in pieces, and a near copy of it."""
    long = " ".join(f"w{i * 7919 % 70001}" for i in range(70_000))
    rows = [(1, long), (2, long + " end"), (3, "short one"), (4, long.replace("w", "v"))]
    got = {r["doc_id"]: (r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_components(corpus(spark, rows), 4, 4).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: plain_print(t) for i, t in rows}
    assert got[2][1] == 1 and got[4][1] == 4 and [r["doc_id"] for r in stages.drop_near_copies(corpus(spark, rows)).orderBy("doc_id").collect()] == [1, 3, 4]
