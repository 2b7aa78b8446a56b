"""Whitening, collocations and sharding against plain versions, on whole tables and odd ones."""

import math
import re
import struct
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_queries import rows

from granulon.llm import collocations, sharding, whitening

# Whitening


def plain_whitening(vectors, most=16):
    """(id, component) -> values, from exact fractions' means and an SVD of the centred rows."""
    grid = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in grid})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    rows_ = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    _, singular, axes = np.linalg.svd(rows_, full_matrices=False)
    variance = singular**2 / n
    found = {}
    for i, x in grid:
        c = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k in range(min(most, len(variance))):
            if variance[k] > 1e-9:
                found.setdefault((i, k + 1), []).append((n, deviation, abs(float(c @ axes[k])) / math.sqrt(variance[k]), variance[k] / variance.sum()))
    return found


def same_whitening(got, expected):
    found = {}
    for r in got:
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, abs(r.whitened), r.explained))
    assert found.keys() == expected.keys()
    for key, values in found.items():
        for a, b in zip(sorted(values), sorted(expected[key]), strict=True):
            assert a[:2] == b[:2]
            assert abs(a[2] - b[2]) < 1e-6 and abs(a[3] - b[3]) < 1e-9


def test_op11(spark, sf_dir):
    vectors = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = rows(spark, sf_dir, "op11_whitening")
    same_whitening(got, plain_whitening(vectors))
    assert {r.identity_error for r in got} and all(r.identity_error < 1e-10 for r in got)
    # The same signs for all rows: whitened columns have the variance 1 over different vectors.
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.deviation, r.whitened] = r.whitened
    assert len(by) == 16


def vectors_frame(spark, rows_):
    return spark.createDataFrame([(i, v, 1, 2.0, "x", "r") for i, v in rows_], "vec_id bigint, embedding array<float>, component int, n double, _id string, x string")


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [
        (None, [0.5, 0.25, 3.0]), (1, None), (2, [1.0, None, 2.0]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 1.0]), (5, [-inf, 0.0, 1.0]), (6, [0.5, 0.25, 3.0]), (6, [0.5, 0.25, 3.0]),
        (7, [-1.0, 2.0, 0.1]), (8, [0.3, -2.0, 0.7]), (9, [4.0, 4.0, -4.0]), (10, [-0.001, 0.0, 0.001]),
    ]
    same_whitening(whitening.whiten(vectors_frame(spark, rows_)).collect(), plain_whitening(rows_))


def test_whitening_without_variance(spark):
    for rows_ in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        got = whitening.whiten(vectors_frame(spark, rows_))
        assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 0
    line = [(i, [i / 10, i / 5, 7.0]) for i in range(40)]  # nearly one component, and a dimension without any
    got = whitening.whiten(vectors_frame(spark, line)).collect()
    same_whitening(got, plain_whitening(line))
    assert {r.component for r in got} <= {1, 2}


def test_whitening_of_mixed_lengths_is_an_error(spark):
    with pytest.raises(Exception, match="another length"):
        whitening.whiten(vectors_frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_squares_beyond_a_machine_word():
    model = whitening.Model(10**9, (10**15, 3 * 10**14), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_001, 300_000], [999_999, 300_002]])
    assert model.deviation(model.centred(x)).tolist() == [10**18, 5 * 10**18]
    with pytest.raises(OverflowError):
        model.deviation(model.centred(np.array([[1_000_100, 300_000]])))
    wide = whitening.Model(2**40, (2**70, 0), np.eye(2), np.ones(2), 2.0)
    assert wide.centred(np.array([[2**30 + 1, 5]])).tolist() == [[2**40, 5 * 2**40]]


# Collocations


def plain_phrases(docs, least=30, share=80, most=2000):
    """The contract, phrase by phrase, with dictionaries and whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            own = counts.setdefault(lang, Counter())
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        inside = {}
        for p, a in f.items():
            if len(p) > 2 and a >= least:
                for n in range(2, len(p)):
                    for s in range(len(p) - n + 1):
                        inside[p[s : s + n]] = max(inside.get(p[s : s + n], 0), a)
        kept = []
        for p, a in f.items():
            if len(p) < 2 or a < least or 100 * inside.get(p, 0) >= share * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts_frame(spark, docs):
    return spark.createDataFrame([(t, lang, "x", 1, "y", 2.0) for lang, t in docs], "text string, lang string, phrase string, n int, _part string, score double")


def test_op12_equals_the_plain_version(spark, sf_dir):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, rows(spark, sf_dir, "op12_collocations"))) == plain_phrases(docs)


@pytest.mark.parametrize("least", [2, 300])
def test_counts_of_buckets(spark, least):
    """Sums over rows of blocks, whose counts are held to the least that matters."""
    rng = np.random.default_rng(1)
    hits = [np.sort(np.concatenate([rng.integers(0, 300_000, 5000), np.repeat([7, 65_535, 65_536, 299_999], 200 * least // 300 + 1)])) for _ in range(3)]
    rows_ = [r for h in hits for r in collocations._blocks(h, least).to_pylist()]
    df = spark.createDataFrame([tuple(r.values()) for r in rows_], collocations.ROWS)
    got = {(r.b * 65_536 + i) for r in collocations._likely(df, least).collect() for i in np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")).tolist()}
    values, counts = np.unique(np.concatenate(hits), return_counts=True)
    assert got == set(values[counts >= least].tolist()) != set()


@pytest.mark.parametrize("together", [50, 2_000_000])
def test_phrases_of_odd_texts(spark, monkeypatch, together):
    monkeypatch.setattr(collocations, "TOGETHER", together)
    docs = [(None, None), ("en", ""), ("en", " \t\n.,"), ("en", "New York, new YORK; new york city! ÉCOLE École x\xa0y x\xa0y"), ("de", "neu neu neu neu neu"), ("", "a b a b a b"), ("en", "o" * 5000 + " z"), ("en", "ab c\x00d 日本 語 日本 語")] * 3
    docs += [("und", "a b c d a b c d"), (None, "a b c d"), ("en", "x y z w " * 50), ("en", "p q. q p\x0bp q\x0cp q\rp q\x85p")]
    got = collocations.mine(texts_frame(spark, docs), least=2, most=7)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, least=2, most=7)
    assert collocations.mine(texts_frame(spark, docs).limit(0)).collect() == []


def test_crowded_buckets_change_nothing(spark, monkeypatch, sf_dir):
    """All hashes in few buckets: bitmaps hold nearly nothing back, and the counts stay exact."""
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    monkeypatch.setattr(collocations, "LEAST_BITS", 65_536)
    monkeypatch.setattr(collocations, "MOST_BITS", 65_536)
    got = collocations.mine(texts_frame(spark, docs), least=4)
    assert sorted(map(tuple, got.collect())) == plain_phrases(docs, least=4)


def test_bitmaps_hold_phrases_back(spark, sf_dir):
    """Most phrases that aren't frequent are never counted exactly."""
    part = collocations.Slice("en")
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50).collect():
        part.add(r.text or "")
    none = np.zeros(collocations.LEAST_BITS // 8, np.uint8)
    every = np.full(collocations.LEAST_BITS // 8, 255, np.uint8)
    exact = lambda a, b: sum(x.num_rows for x in collocations.count_slice(part, 2, collocations.LEAST_BITS, 30, a, b) if x.column(0).null_count == 0)
    assert exact(none, every) == exact(every, none) == 0 < exact(every, every)


def test_scores_past_64_bits(spark):
    a, l, r = 9_000_000_000_000, 9_000_000_000_001, 9_300_000_000_007
    got = spark.createDataFrame([(a, l + r)], "a bigint, p bigint").select(collocations.score(F.col("a"), F.col("p"))).first()[0]
    assert got == 2_000_000 * a // (l + r)


# Sharding


def plain_shard(key, weights):
    """The highest of -w / ln(u), with Spark's XXH64 of the key and then of the shard's number."""
    seed = xxhash.xxh64_intdigest(str(key).encode(), 42)
    drawn = []
    for k, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(struct.pack("<i", k), seed)
        drawn.append((-w / math.log(((h >> 11) + 0.5) / 2**53), k))
    return max(drawn)[1]


def test_op13(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = rows(spark, sf_dir, "op13_rendezvous")
    assert {(r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got} == {
        (i, len(t.encode()) + 8, zlib.crc32(t.encode()), "key", plain_shard(i, [1.0] * 24), plain_shard(i, [1.0] * 25)) for i, t in docs.items()
    }
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, odd):
    got = sharding.shards(odd, [1.0, 2.0, 0.5], [1.0, 2.0, 0.5, 1.0]).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 8) for r in odd.select("doc_id", "text").collect())
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shards(odd.limit(0), [1.0]).collect() == []
    nameless = spark.createDataFrame([(None, f"text {k}") for k in range(200)], "doc_id bigint, text string")
    assert len({r.shard for r in sharding.shards(nameless, [1.0] * 8).collect()}) == 8


def test_weights_and_moves(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    share = {r[0]: r[1] / 20_000 for r in sharding.shards(docs, [1.0, 2.0, 1.0]).groupBy("shard").count().collect()}
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    # A heavier shard only takes, a lighter or last one dropped only gives; about the share of the weight moves.
    for before, after, ok in (([1.0] * 4, [1.0, 1.5, 1.0, 1.0], lambda a, b: b == 1), ([1.0] * 4, [1.0, 1.0, 0.5, 1.0], lambda a, b: a == 2), ([1.0] * 4, [1.0] * 3, lambda a, b: a == 3)):
        moved = sharding.moves(docs, before, after).collect()
        assert moved and all(ok(r.shard, r.grown_shard) for r in moved)
        assert all(r.bytes == 3 * r.n for r in moved)
    assert abs(sum(r.n for r in sharding.moves(docs, [1.0] * 24, [1.0] * 25).collect()) / 20_000 - 1 / 25) < 0.01
    with pytest.raises(ValueError):
        sharding.shards(docs, [1.0, 0.0])


def test_written_shards_hold_every_record(spark, odd, tmp_path):
    folder = f"{tmp_path}/shards"
    sharding.write(odd, folder, [1.0, 2.0, 1.0], rows_in_file=2)
    back = spark.read.parquet(folder)
    assert back.drop("_shard").count() == odd.count() and back.drop("_shard").exceptAll(odd).count() == 0
    again = back.select("_shard", sharding.shard_of(sharding.record_key("doc_id", "text"), [1.0, 2.0, 1.0]).alias("s"))
    assert again.where("_shard <> s").count() == 0
    with pytest.raises(ValueError):
        sharding.write(odd.withColumn("_SHARD", F.lit(1)), f"{tmp_path}/other", [1.0])


# Joins of hot keys


def test_hot_keys_are_dealt_by_the_rows_themselves(spark):
    """Whole results with a key of most rows and null keys; a row's place doesn't hang on the order in which rows come."""
    from granulon.llm.common import join_hot

    df = spark.range(5000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 9 > 0, F.col("id")).alias("k"))
    each = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = join_hot(df, each, "k")
    assert "monotonically_increasing_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    expected = sorted((r.i, r.k, None if r.k is None or r.k >= 3000 else 2 * r.k) for r in df.collect())
    assert sorted((r.i, r.k, r.v) for r in got.collect()) == expected
