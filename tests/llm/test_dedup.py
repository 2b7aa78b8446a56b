"""SimHash, components and SpotSigs against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from granulon.llm import components, simhash, spotsigs


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] if len(found) >= 4 else [" ".join(found)] if found else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_roots(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in linked:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {k: top(k) for k in keys}


@pytest.mark.parametrize("text", ["", " \n", "one", "One two THREE", "a b c d", "É é a\x0bb c d e f g", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_index_keys_are_in_any_choice():
    from itertools import combinations

    for shared in range(1, 9):
        for width in range(1, shared + 1):
            keys = [set(k) for k in simhash.index_keys(width, shared)]
            assert all(any(k <= set(choice) for k in keys) for choice in combinations(range(8), shared)), (width, shared)


@pytest.mark.parametrize("short,block", [(64, 4096), (2, 8)])
@pytest.mark.parametrize("length", [0.01, 256])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, short, block, length):
    """Chains of near fingerprints, in lists that are short, long, and cut into blocks, at each width of the index."""
    monkeypatch.setattr(simhash, "SHORT", short)
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LIST_LENGTH", length)
    rng = random.Random(5)
    prints = {0}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 4
    expected = plain_roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if near(a, b)])
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp bigint")).collect()]
    assert all(near(a, b) for a, b in got)
    assert plain_roots(prints, got) == expected
    assert {r.node: r.root for r in components.connected(spark.createDataFrame(got, "a bigint, b bigint")).collect()} == {k: v for k, v in expected.items() if list(expected.values()).count(v) > 1}


def test_components_of_paths_stars_and_nothing(spark):
    n = 200
    path = list(range(n))
    random.Random(1).shuffle(path)
    pairs = list(zip(path, path[1:])) + [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000), (None, 3)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert found == {**{k: 0 for k in range(n)}, **{1000 + k: 1000 for k in range(50)}}
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates(spark, odd, none):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 500)}" for _ in range(400)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base).upper(), "other words", "", None, " ".join(f"v{k}" for k in range(90))]
    df = spark.createDataFrame([(10 - i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    prints = {i: plain_fingerprint(t) for i, t in ((10 - i, t) for i, t in enumerate(texts))}
    expected = plain_roots(list(prints), [(a, b) for a in prints for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 4])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == expected
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by_text = {r.text_hash: r.component_id for r in got}
    assert len({by_text[r.text_hash] for r in got if r.doc_id in (3, 4)}) == 1
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert {r._key for r in rows} == {"mine"}  # a column of that name stays what it was
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and 3 in ids and 4 not in ids and 1 in ids and 2 not in ids and None in ids
    assert simhash.keep_one(none).count() == 0


def plain_signatures(text):
    found = re.sub(r"[^\w]+|_", " ", (text or "").lower()).split()
    content, starts, after = [], [], False
    for w in found:
        if w in set(spotsigs.ANCHORS):
            after = True
        else:
            content.append(w)
            starts.append(after)
            after = False
    chains = {tuple(content[i : i + 3]) for i in range(len(content) - 2) if starts[i]}
    return chains or ({tuple(found)} if found else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = ["The cat of my aunt sat on the red mat by a door", "", None, "the of and", "no anchors whatsoever here today", "la casa de mi amigo es muy grande para todos", "The cat of my aunt sat on the red mat by a door", "x"]


def test_compare_with_edits(spark):
    df = spark.createDataFrame([(7 * i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in spotsigs.compare_with_edits(df).collect()}
    for k, text in enumerate(TEXTS):
        text, after = text or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[7 * k]
        assert r.n_chars == len(text)
        assert abs(r.near_edited - jaccard(plain_signatures(text), plain_signatures(edited))) < 1e-9
        assert abs(r.near_next - jaccard(plain_signatures(text), plain_signatures(after))) < 1e-9
        assert len(r.fingerprint) == 16 * len(plain_signatures(text))
    assert got[0].fingerprint == got[42].fingerprint != got[28].fingerprint
    # The fingerprint holds the whole set: the likeness is that of the strings' parts.
    parts = lambda f: {f[i : i + 16] for i in range(0, len(f), 16)}
    for k in range(len(TEXTS)):
        assert abs(got[7 * k].near_edited - jaccard(parts(got[7 * k].fingerprint), parts(got[7 * k].edited_fingerprint))) < 1e-9


def test_next_across_far_stretches(spark):
    rng = random.Random(3)
    ids = sorted([-(2**63), -(10**12), -5, 0, 255, 256, 70_000, 10**9, 10**15, 2**63 - 1, *(rng.getrandbits(63) for _ in range(300))])
    df = spark.createDataFrame([(i, f"word{k} " * 2) for k, i in enumerate(ids)], "doc_id bigint, text string")
    import hashlib

    got = {r.doc_id: r.edited_sha256 for r in spotsigs.compare_with_edits(df).collect()}
    for k, i in enumerate(ids):
        text, after = f"word{k} " * 2, f"word{(k + 1) % len(ids)} " * 2
        assert len(got) == len(ids) and got[i] == hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()


def test_spotsigs_odd_tables(odd, none):
    assert len(spotsigs.compare_with_edits(odd).collect()) == odd.count()
    assert spotsigs.compare_with_edits(none).count() == 0
    assert spotsigs.near_duplicates(none).count() == 0
    found = spotsigs.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    assert {r.class_id for r in found if r.doc_id in (3, 4)} == {3}


@pytest.mark.parametrize("block", [spotsigs.BLOCK, 3])
def test_similar_sets_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spotsigs, "BLOCK", block)
    rng = random.Random(7)
    sets = {}
    for i in range(120):
        base = sets.get(rng.choice(list(sets)), set()) if sets and rng.random() < 0.6 else set()
        s = {x for x in base if rng.random() < 0.93} | {rng.randint(0, 400) for _ in range(rng.randint(0, 4))}
        sets[i] = s
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, sig array<bigint>")
    for least in (0.5, 0.8, 1.0):
        expected = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= least - 1e-12}
        assert {(r.a, r.b) for r in spotsigs.similar_sets(df, least).collect()} == expected


def test_bits_of_a_forest():
    prints = np.array([0, 1, 3, 7, 15, 31, 2**40], np.uint64)
    a, b = simhash._forest(prints, None, 4, 4)
    assert len(a) == len(prints) - 1
