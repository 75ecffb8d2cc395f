"""Providers of embeddings, vectors kept by content, clustered search, and the table functions."""

import glob
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.functions import table_functions
from evidora.operators import clusters, providers, vectors


def rows(df):
    return sorted(map(tuple, df.collect()))


class Remote:
    """Fails at every third call of a process; writes down each call, as workers share no memory."""

    def __init__(self, folder):
        self.folder, self.calls = folder, 0

    def embed(self, texts):
        self.calls += 1
        with open(f"{self.folder}/call-{os.getpid()}-{time.time_ns()}-{self.calls}", "w") as f:
            f.write(str(len(texts)))
        if self.calls % 3 == 0:
            raise ConnectionError("lost")
        return vectors.HashedWords().embed(texts)


def test_a_chain_goes_on_to_the_next_provider(tmp_path):
    chain = providers.Chain(Remote(str(tmp_path)), vectors.HashedWords(), batch=2)
    texts = [f"word{i} other{i % 3}" for i in range(11)]
    assert np.array_equal(chain.embed(texts), vectors.HashedWords().embed(texts))
    sizes = [open(f).read() for f in glob.glob(f"{tmp_path}/call-*")]
    assert len(sizes) == 6 and sorted(sizes) == ["1", "2", "2", "2", "2", "2"]
    with pytest.raises(ConnectionError):
        providers.Chain(Remote(str(tmp_path)), batch=2).embed(texts)
    assert providers.Chain().embed([]).shape[0] == 0


def test_a_provider_of_another_width_is_passed_over():
    class Narrow:
        def embed(self, texts):
            return np.ones((len(texts), 3 if len(texts) > 1 else 2))

    class Wide:
        def embed(self, texts):
            return np.zeros((len(texts), 3))

    assert providers.Chain(Narrow(), Wide(), batch=2).embed(["a", "b", "c"]).tolist() == [[1] * 3, [1] * 3, [0] * 3]


def test_the_rate_is_kept():
    now, waited = [0.0], []

    def sleep(s):
        waited.append(s)
        now[0] += s

    class Quick:
        def embed(self, texts):
            return np.zeros((len(texts), 2))

    providers.Chain(Quick(), batch=1, per_minute=20, clock=lambda: now[0], sleep=sleep).embed(["a"] * 4)
    assert waited == [3.0, 3.0, 3.0]


def test_only_new_texts_are_embedded(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    chain = providers.Chain(Remote(str(tmp_path / "calls")), vectors.HashedWords())
    kept = providers.EmbeddedTexts(spark, str(tmp_path / "v"), chain)
    first = spark.createDataFrame([(i, f"text {i % 5}") for i in range(30)] + [(90, None), (91, " ")], "id int, text string")
    plain = lambda d: rows(d.select("id", vectors.embed(F.col("text")).alias("vec")))
    assert rows(kept.add(first, "text").select("id", "vec")) == plain(first)
    embedded = lambda: sum(int(open(f).read()) for f in glob.glob(f"{tmp_path}/calls/*"))
    assert embedded() == 6 and kept.table.count() == 6
    again = spark.createDataFrame([(1, "text 1"), (2, "something new"), (3, "")], "id int, text string")
    assert rows(kept.add(again, "text").select("id", "vec")) == plain(again)
    assert embedded() == 7 and kept.table.count() == 7


# --- clusters ----------------------------------------------------------------------------------------
def spread(spark, n=3000, groups=20, near=0.05, seed=3):
    rng = np.random.default_rng(seed)
    seeds = rng.normal(size=(groups, 8)) * 3
    vecs = seeds[rng.integers(0, groups, n)] + rng.normal(size=(n, 8)) * near
    items = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)] + [(n + i, vecs[0].tolist()) for i in range(300)] + [(n + 900, None)]
    return spark.createDataFrame(items, "item int, vec array<double>")


@pytest.mark.parametrize("skip", [False, True])
def test_clustered_search_equals_the_full_one(spark, skip, monkeypatch):
    items = spread(spark)
    asked = items.where("item % 50 = 0").select(F.col("item").alias("qid"), F.col("vec").alias("qvec")).unionByName(spark.createDataFrame([(-1, [0.0] * 8), (-2, None)], "qid int, qvec array<double>"))
    found = clusters.ClusteredVectors(items, clusters=24, sample=500)
    assert found.sizes.sum() == 3300
    want = rows(vectors.top_k(asked, items, 7, skip_equal=skip).select("qid", "item", "score", "rank"))
    assert rows(found.search(asked, 7, skip_equal=skip).select("qid", "item", "score", "rank")) == want
    assert 0 < found.scored(asked.where("qid >= 0"), 7, skip_equal=skip) < 0.5
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 40)  # clusters in several blocks
    assert rows(found.search(asked, 7, skip_equal=skip).select("qid", "item", "score", "rank")) == want


def test_clusters_of_few_vectors(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item int, vec array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.5])], "qid int, qvec array<double>")
    assert rows(clusters.ClusteredVectors(items).search(asked, 5).select("item", "rank")) == [(1, 1), (2, 2), (3, 3)]
    none = clusters.ClusteredVectors(items.limit(0))
    assert none.search(asked, 5).count() == 0 and none.scored(asked, 5) == 0


# --- table functions ---------------------------------------------------------------------------------
def test_table_functions_take_odd_input(spark):
    table_functions.register(spark)
    spark.createDataFrame([("f", 2, "b\n| x |\n| y |\nc"), ("f", 1, None), ("f", 3, ""), ("g", 1, "| only one line |")], "source_file string, page bigint, markdown string").createOrReplaceTempView("pp")
    got = rows(spark.sql("SELECT source_file, page, ord, element_type, content FROM document_elements(TABLE(pp) PARTITION BY source_file ORDER BY page)"))
    assert got == [("f", 2, 0, "TEXT", "b"), ("f", 2, 1, "TABLE", "| x |\n| y |"), ("f", 2, 2, "TEXT", "c"), ("g", 1, 0, "TEXT", "| only one line |")]
    said = spark.sql("SELECT * FROM VALUES (1, '# A b\nx\n## Other\ny\n#### deep\nz', array('other', 'none')), (2, NULL, array('a')), (3, '# A', NULL) AS t(id, a, w)")
    said.createOrReplaceTempView("aa")
    assert rows(spark.sql("SELECT id, place, title, section FROM aa, LATERAL answer_sections(a, w)")) == [(1, 1, "Other", "## Other\ny\n#### deep\nz")]
