"""The registered queries over the smallest tables, whole, against SQL or plain versions."""

import decimal
import hashlib
import hmac
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import jaccard, plain_fingerprint, plain_roots, plain_signatures
from test_text import luhn, plain_feistel
from test_tokens import library, plain_best_fit, theirs

from granulon.llm import ordinal, queries, rules
from granulon.session import TABLES


PII_KEY = "the key of the tests"  # conftest.py sets it


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def rows(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    value = lambda x: f"{float(x):.9g}" if isinstance(x, (float, decimal.Decimal)) else str(x)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(value, r)) for r in df.select(*names).collect()) == sorted(tuple(map(value, r)) for r in result.fetchall())


def test_op1(spark, sf_dir, docs):
    expected = set()
    for i, text in docs:
        ids = theirs.encode_ordinary(text)
        expected.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {tuple(r) for r in rows(spark, sf_dir, "op1_byte_bpe")} == expected


def test_op2(spark, sf_dir, docs):
    prints = {i: plain_fingerprint(t) for i, t in docs}
    near = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    roots = plain_roots(list(prints), near)
    assert {tuple(r) for r in rows(spark, sf_dir, "op2_simhash")} == {(i, f"{prints[i]:016x}", roots[i]) for i in prints}


def test_op3(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op3_spotsigs")}
    sets = [plain_signatures(t) for _, t in docs]
    for k, (i, text) in enumerate(docs):
        after, half = docs[(k + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (len(r.fingerprint), len(r.edited_fingerprint)) == (16 * len(sets[k]), 16 * len(plain_signatures(edited)))
        assert abs(r.near_edited - jaccard(sets[k], plain_signatures(edited))) < 1e-9
        assert abs(r.near_next - jaccard(sets[k], sets[(k + 1) % len(docs)])) < 1e-9


def test_op4(spark, sf_dir, docs):
    expected, lengths = set(), []
    for i, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = ids[at : at + 2048]
            lengths.append(len(piece))
            expected.add((i, k, at, len(piece), zlib.crc32(piece.tobytes())))
    got = rows(spark, sf_dir, "op4_best_fit")
    assert {tuple(r)[:5] for r in got} == expected and len(got) == len(expected)
    assert len({r.sequence_id for r in got}) == plain_best_fit(lengths, 2048)


# What these documents hold, by patterns of the tests' own.
KINDS = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<token>\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b)|(?P<ipv4>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d))"
    r"|(?P<phone>\+1 \(\d{3}\) \d{3}-\d{4}(?!\d))|(?P<card>(?<![\w.,-])\d{13,19}(?!\w))"
)


def plain_pseudonyms(text, key):
    """The kinds that these documents have."""
    key = "gk:" + hmac.new(key.encode(), b"granulon pseudonyms", "sha256").hexdigest()[:32]
    sha = lambda *x: hashlib.sha256("|".join((key, *x)).encode()).hexdigest()

    def new(m):
        kind, m = m.lastgroup, m[0]
        if kind == "email":
            name, domain = m.lower().split("@")
            return f"{sha('email', m.lower())[: min(64, max(24, len(name)))]}@{sha('domain', domain)[:16]}.{domain.split('.')[-1]}"
        if kind == "token":
            if m.isdigit() or m.isalpha():
                return m
            h = sha("token", m.lower())[: len(m)]
            return h.upper() if m == m.upper() else h
        if kind == "ipv4":
            o = list(map(int, m.split(".")))
            if max(o) > 255:
                return m
            a, b = plain_feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
            return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
        if kind == "phone":
            area, exchange, line = int(m[4:7]), int(m[9:12]), int(m[13:])
            floor, width = (lambda x: 200 * (x >= 200)), (lambda x: 800 if x >= 200 else 200)
            a, b = plain_feistel(key, "phone1", area - floor(area), (exchange - floor(exchange)) * 10000 + line, width(area), width(exchange) * 10000)
            return f"+1 ({a + floor(area):03d}) {b // 10000 + floor(exchange):03d}-{b % 10000:04d}"
        if not luhn(m):
            return m
        d = m[:-1]
        k = len(d) // 2
        a, b = plain_feistel(key, "card", int(d[:k]), int(d[k:]), 10**k, 10 ** (len(d) - k))
        p = f"{a:0{k}d}{b:0{len(d) - k}d}"
        return next(p + c for c in "0123456789" if luhn(p + c))

    return KINDS.sub(new, text)


def test_op5(spark, sf_dir, docs):
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op5_feistel_pii")}
    changed = 0
    for i, text in docs:
        assert got[i].text == plain_pseudonyms(text, PII_KEY)
        changed += got[i].text != text
    assert changed and set(" ".join(r.kinds for r in got.values()).split()) >= {"email", "ipv4", "card"}


def test_op6(spark, sf_dir, docs):
    start, expected = 0, set()
    for i, text in docs:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert {tuple(r) for r in rows(spark, sf_dir, "op6_bit_packed")} == expected


def test_op8(spark, sf_dir, docs):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    forest, threshold = rules.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op8_isolation_rules")}
    assert len(got) == len(docs)
    for i, text in docs:
        base, stats = rules.counts(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        score = forest.score(np.array([stats]))[0]
        assert [got[i][b] for b in rules.BASE] == base
        assert (got[i].base_failed, got[i].kept) == (failed, bool(not failed and score < threshold))


def test_op9(spark, sf_dir):
    assert len(rows(spark, sf_dir, "op9_block_rules")) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()  # texts: test_text.py


def test_op10(spark, sf_dir, docs):
    """The model fitted on these rows one by one, and its scores from all weights of a text's features."""
    texts = dict(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.expr(queries.GRADE).alias("g")).collect()
    found = sorted((r.doc_id, ordinal.features(texts[r.doc_id]), r.g) for r in labels)
    model = ordinal.fit_arrays([f for _, f, _ in found], np.array([g for *_, g in found]), queries.TOP_GRADE)
    got = {r.doc_id: r for r in rows(spark, sf_dir, "op10_ordinal_quality")}
    assert len(got) == len(docs)
    for i, text in docs:
        assert abs(got[i].score - model.weights[ordinal.features(text)].astype(float).sum()) < 1e-4
        assert got[i].selected == (got[i].tail >= ordinal.LEAST_TAIL)


def test_pipeline(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "pipeline")
    assert {r.doc_id for r in got} <= {i for i, _ in docs} and got
