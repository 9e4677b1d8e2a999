import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import mixing
from riskloom.llm.store import ship

from . import edge

SF001 = "/root/testdata/sf0.001"


def plain_targets(sizes, weights):
    out, left, open_ = [0.0] * len(sizes), sum(sizes), set(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > 3 * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = 3.0 * sizes[i]
        left -= sum(3 * sizes[i] for i in full)
        open_ -= full
    return out


def test_targets(spark):
    def got(sizes, weights):
        frame = spark.createDataFrame(list(enumerate(zip(sizes, weights))), "i int, v struct<size:long,weight:int>").select("i", "v.*")
        return [r.target for r in mixing.targets(frame).orderBy("i").collect()]

    assert got([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    some = got([10, 500, 490], [5, 2, 1])                     # the first stops at 30; 970 goes to the others 2 : 1
    assert some[0] == 30 and np.allclose(some[1:], [970 * 2 / 3, 970 / 3])
    assert got([], []) == [] and got([0, 7], [5, 2]) == [0, 7]
    sizes = [2**k for k in range(20)]
    assert np.allclose(got(sizes, [5, 2, 1] * 6 + [5, 2]), plain_targets(sizes, [5, 2, 1] * 6 + [5, 2]), rtol=1e-12)


def test_small_and_many_sources_come_near_their_targets(spark, monkeypatch):
    ship(spark)
    monkeypatch.setattr(mixing, "RANGE", 7)                   # counts are drawn for several ranges of sources
    rows = [(f"s{s:03d}{d}", f"s{s:03d}", " ".join(f"w{i}" for i in range(size))) for s, sizes in enumerate([[1], [2], [3, 0], [5], [10, 3], [40], [100, 90], [9] * 12, [200], [7, 1]] * 3) for d, size in enumerate(sizes)]
    docs = spark.createDataFrame([(i, t, s) for i, (_, s, t) in enumerate(rows)] + [(-1, "a b c d e", None), (-2, None, "empty")], "doc_id long, text string, source string")
    out = mixing.taken(docs).toPandas()
    per = out.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"))
    assert (abs(per.taken - per.target) <= np.maximum(0.05 * per.target, 1)).all()
    names = sorted((x for x in per.index if isinstance(x, str))) + [None]
    sizes = [int(per.loc[x, "size"]) if x else 5 for x in names]
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert np.allclose([per.loc[x, "target"] if x else per[per.index.isna()].target.iloc[0] for x in names], want)
    assert (out.taken <= 3 * out["size"]).all()
    three = spark.createDataFrame([(k, " ".join(f"{k}{i}" for i in range(100)), f"s{k}") for k in range(3)], "doc_id long, text string, source string")
    assert all(abs(r.taken - r.target) <= max(1, 0.05 * r.target) for r in mixing.taken(three).collect())


def test_taken_words_follow_from_slots_and_words(spark):
    """Word by word: a slot takes the words of its block, wherever its documents begin."""
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    mixture, _ = mixing.mix(docs, 64, 4)
    length = {r.sid: r.length for r in mixture.sources.collect()}
    uses = {s: {} for s in length}
    for r in mixture.slots.collect():
        for word in range(r.block * length[r.sid], (r.block + 1) * length[r.sid]):
            uses[r.sid][word] = uses[r.sid].get(word, 0) + 1
    want = {r.doc_id: sum(uses[r.sid].get(w, 0) for w in range(r.begin, r.begin + r.size)) for r in mixture.sized.collect()}
    assert {r.doc_id: r.taken for r in mixing.taken(docs, 64, 4).collect()} == want
    begins = {}
    for r in mixture.sized.collect():
        begins.setdefault(r.sid, []).append((r.begin, r.size))
    for own in begins.values():                               # documents fill their source without gaps
        at = 0
        for begin, size in sorted(own):
            assert begin == at
            at += size


@pytest.mark.parametrize("size", [1, 2, 5, 64, 1000, 12345])
def test_permutations_of_blocks(size):
    one = np.ones(size, np.int64)
    for key in (1, 2):
        assert sorted(mixing.permuted(np.arange(size), one * size, one * key).tolist()) == list(range(size))


def test_draws_sum_to_the_quotas():
    quotas = np.array([7, 0, 1000, 33])
    counts = mixing.draw(quotas, 6, 1)
    assert counts.sum(0).tolist() == quotas.tolist() and np.ptp(counts.sum(1)) <= 1 and (counts >= 0).all()


def test_slots_take_every_block_of_an_epoch_once(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    mixture, _ = mixing.mix(docs, 64, 4)
    slots = mixture.slots.toPandas()
    for s in mixture.sources.collect():
        own = slots[slots.sid == s["sid"]]
        assert len(own) == s["quota"] and not own.duplicated(["epoch", "block"]).any() and own.epoch.max() <= 2
        for epoch in range(s["quota"] // s["blocks"]):
            assert sorted(own[own.epoch == epoch].block) == list(range(s["blocks"]))
    for _, own in slots.groupby("shard"):
        assert sorted(own.position) == list(range(len(own)))


def test_taken_words(spark):
    ship(spark)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 10 < 7, F.lit("src0")).otherwise(F.col("source")))      # a hot source
    one, two = (mixing.taken(d, 32).toPandas().sort_values("doc_id") for d in (docs, docs.repartition(7)))
    assert one.drop(columns="source").values.tolist() == two.drop(columns="source").values.tolist()
    assert (one.taken <= 3 * one["size"]).all() and one["size"].sum() == pytest.approx(one.groupby("source").target.first().sum())
    per = one.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("source_size", "first"), own=("size", "sum"))
    assert (abs(per.taken - per.target) <= 0.02 * per.target + 32).all() and (per["size"] == per.own).all()


def test_mix_of_odd_rows(spark):
    ship(spark)
    docs = edge.frame(spark)
    out = mixing.taken(docs, 16).collect()
    assert len(out) == len(edge.rows()) and all(0 <= r.taken <= 3 * r.size for r in out)
    assert mixing.taken(docs.limit(0)).count() == 0
    pieces = mixing.mixed_documents(docs, 16)
    assert pieces.columns == docs.columns
    texts = {}
    for r in edge.rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    rows = pieces.collect()
    assert rows and all(any(r.text in t for t in texts[r.doc_id]) and r.n_chars == len(r.text) for r in rows)
    assert sum(len(r.text.split()) for r in rows if r.doc_id == 10) == sum(r.taken for r in out if r.doc_id == 10)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "src0", None), (10_002, "12 34 !!", "en", "src0", 8), (10_003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "pii", "mix_sources", "byte_bpe"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, SF001).cache()
    gone = {r.doc_id for r in docs.join(one, "doc_id", "left_anti").collect()}
    assert {10_001, 10_002, 10_003} <= gone and len(gone) <= 5
    two = stage["ngram_jaccard_join"](spark, one, SF001).cache()
    ids = {r.doc_id for r in two.collect()}
    from riskloom.llm.ngram_join import jaccard_components
    assert ids == {r.doc_id for r in jaccard_components(one).where("doc_id = component_id").collect()}
    three = stage["pii"](spark, two, SF001).cache()
    assert three.count() == two.count() and three.where("n_chars <> length(text)").count() == 0
    assert three.where(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    four = stage["mix_sources"](spark, three, SF001).cache()
    assert all(d.columns == docs.columns for d in (one, two, three, four)) and {r.doc_id for r in four.collect()} <= ids
    five = stage["byte_bpe"](spark, four, SF001)
    assert five.count() == four.count()
    none = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        none = f(spark, none, SF001)
        assert none.count() == 0, name


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF001).where("n_tokens IS NULL").count() == 0


def test_targets_of_sources_that_are_larger_together_than_an_int(spark):
    sources = spark.createDataFrame([(0, 900_000_000, 5), (1, 500_000_000, 2), (2, 40_000_000, 1)], "sid int, size long, weight int")
    got = {r["sid"]: r["target"] for r in mixing.targets(sources).collect()}
    assert got[2] == 3 * 40_000_000
    assert np.allclose([got[0], got[1]], [1_320_000_000 * 5 / 7, 1_320_000_000 * 2 / 7], rtol=1e-12)
