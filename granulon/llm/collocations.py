"""Phrases that occur more often than their parts explain, by hashed counting in passes.

The pass for phrases of k words counts two things at once. It counts candidates of k words exactly: those
that pass a bitmap of the buckets with enough occurrences, made by the pass before, and whose two parts of
k - 1 words are frequent (Apriori, by a bitmap of the frequent parts' buckets). And it counts the phrases of
k + 1 words, both of whose parts are candidates, by buckets of their hashes. A bitmap lets some phrases
through that aren't frequent, which the exact counts drop, and holds none back that is.

A task counts slices of its texts by numpy and gives a row for each different phrase of a slice, and one for
each block of buckets, as offsets and counts. Bitmaps are all that is broadcast: at most MOST_BITS / 8 bytes each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.llm.common import drop_folder, join_hot, partitions, shared_folder, slices, text_of

LONGEST = 4
#: Occurrences of words that a task counts together.
TOGETHER = 2_000_000
#: Buckets of hashes: so many for each document, within these bounds; their number changes speed only.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 20, 1 << 29
#: Buckets of a block: of bitmap_construct_agg, and of counts on their way (offsets of 16 bits).
BLOCK, COUNTED = 1 << 15, 1 << 16
SCORE = 2_000_000
NAMES = ["lang", "phrase", "bucket", "n", "counts"]
#: Lower case and the ends of pieces. 0xFF is in no UTF-8 text.
END = b"\xff"
_FROM = bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r"
TABLE = bytes.maketrans(_FROM, bytes(range(97, 123)) + END * 10)
#: n words of a language (bucket -1), a phrase with its bucket, or a block of buckets (language and phrase null) with its counts.
ROWS = "lang string, phrase string, bucket bigint, n bigint, counts binary"


class Words(dict):
    """Numbers of words by their order of appearance; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


class Slice:
    """The words of texts of one language, one after the other with ends of pieces between them."""

    def __init__(self, lang: str):
        self.lang, self.words, self.held, self.n = lang, Words({END: 0}), [], 0

    def add(self, text: str) -> None:
        tokens = text.encode().translate(TABLE).replace(END, b" \xff ").split()
        tokens.append(END)
        self.held.append(np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens)))
        self.n += len(tokens)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of words in order, hashes of words by number, words by number."""
        seed = xxhash.xxh64_intdigest(self.lang)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))
        return np.concatenate(self.held), hashes, pa.array([b"", *list(self.words)[1:]], pa.binary()).cast(pa.string())


def _bits(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1 == 1


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their counts, and where each occurs first."""
    codes, different = pd.factorize(keys)
    first = np.empty(len(different), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return different, np.bincount(codes, minlength=len(different)), first


def count_slice(part: Slice, k: int, buckets: int, least: int, frequent: np.ndarray | None, likely: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of ROWS: the number of words (k = 1), candidates of k words, buckets of k + 1 words."""
    ids, hashes, words = part.arrays()
    at = ids != 0
    bucket_of = lambda h: (_mixed(h) & np.uint64(buckets - 1)).astype(np.int64)
    # hashed[j]: the hash of the j + 1 words from each place on; whole[j]: whether they are in one piece.
    hashed, whole = [hashes[ids]], [at]
    for j in range(1, min(k + 1, LONGEST)):
        hashed.append(hashed[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[0][j:])
        whole.append(whole[-1][:-1] & at[j:])
    if k == 1:
        yield _rows(part.lang, None, np.array([-1]), np.array([at.sum()]))
        chosen = at
    else:
        chosen = whole[k - 1].copy()
        places = np.flatnonzero(chosen)
        known = _bits(frequent, bucket_of(hashed[k - 2]))
        places = places[known[places] & known[places + 1]]
        places = places[_bits(likely, bucket_of(hashed[k - 1][places]))]
        chosen[:] = False
        chosen[places] = True
    places = np.flatnonzero(chosen)
    if len(places):
        # Numbers of the phrases, exact: pairs of the number of the first words and that of the last one.
        key = ids[places].astype(np.int64)
        for j in range(1, k):
            key = pd.factorize(key)[0].astype(np.int64) * len(words) + ids[places + j]
        _, counts, first = _counted(key)
        first = places[first]
        text = [words.take(pa.array(ids[first + j])) for j in range(k)]
        yield _rows(part.lang, pc.binary_join_element_wise(*text, " ") if k > 1 else text[0], bucket_of(hashed[k - 1][first]), counts)
    if k < LONGEST:
        longer = whole[k] & chosen[: len(whole[k])] & chosen[1 : len(whole[k]) + 1]
        hit = np.sort(bucket_of(hashed[k][longer]))
        if len(hit):
            yield _blocks(hit, least)


def _rows(lang: str, phrase: pa.Array | None, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    size = len(n)
    phrase = pa.nulls(size, pa.string()) if phrase is None else phrase
    return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), phrase, pa.array(bucket, pa.int64()), pa.array(n, pa.int64()), pa.nulls(size, pa.binary())], names=NAMES)


def _blocks(hit: np.ndarray, least: int) -> pa.RecordBatch:
    """Sorted buckets as a row for each block: 16-bit offsets, then counts, which are held to `least`: more changes nothing."""
    starts = np.flatnonzero(np.diff(hit, prepend=-1))
    buckets, counts = hit[starts], np.minimum(np.diff(starts, append=len(hit)), least).astype(np.min_scalar_type(least))
    offsets, block = (buckets % COUNTED).astype("<u2"), buckets // COUNTED
    edges = [*np.flatnonzero(np.diff(block, prepend=-1)).tolist(), len(block)]
    data = [offsets[a:b].tobytes() + counts[a:b].tobytes() for a, b in zip(edges, edges[1:])]
    none = pa.nulls(len(data), pa.string())
    return pa.RecordBatch.from_arrays([none, none, pa.array(block[edges[:-1]], pa.int64()), pa.array(np.diff(edges), pa.int64()), pa.array(data, pa.binary())], names=NAMES)


def _pass(texts: DataFrame, k: int, buckets: int, least: int, frequent, likely) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Slice] = {}
        maps = [None if b is None else np.frombuffer(b.value, np.uint8) for b in (frequent, likely)]
        n = 0
        for batch in batches:
            for part in slices([batch]):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in held:
                        held[lang] = Slice(lang)
                    own = held[lang]
                    n -= own.n
                    own.add(text)
                    n += own.n
                    if n >= TOGETHER:
                        for one in held.values():
                            yield from count_slice(one, k, buckets, least, *maps)
                        held, n = {}, 0
        for one in held.values():
            yield from count_slice(one, k, buckets, least, *maps)

    return texts.mapInArrow(run, ROWS)


def _likely(rows: DataFrame, least: int) -> DataFrame:
    """(b, bits): bitmaps of the blocks' buckets with `least` occurrences or more. Blocks come in order, so a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(COUNTED, np.int64)
        out = lambda: pa.RecordBatch.from_pydict({"b": pa.array([now], pa.int64()), "bits": [np.packbits(total >= least, bitorder="little").tobytes()]})
        for batch in batches:
            for block, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    if now is not None:
                        yield out()
                    now, total = block, np.zeros(COUNTED, np.int64)
                total[np.frombuffer(data, "<u2", n)] += np.frombuffer(data, np.min_scalar_type(least), n, 2 * n)
        if now is not None:
            yield out()

    blocks = rows.where("counts IS NOT NULL").select("bucket", "n", "counts")
    return blocks.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "b bigint, bits binary")


def _bitmap(blocks: DataFrame, size: int, buckets: int):
    """Bitmaps of blocks of `size` buckets as one broadcast array of buckets / 8 bytes."""
    whole = bytearray(buckets // 8)
    for b, bits in blocks.toLocalIterator():  # buckets / 8 bytes in all
        whole[b * size // 8 : (b + 1) * size // 8] = bits
    return blocks.sparkSession.sparkContext.broadcast(bytes(whole))


def frequent_phrases(df: DataFrame, least: int, lang_col: str, text_col: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to 4 words with f >= least, and (lang, n) of all words; stored in `folder`."""
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), text_of(f"`{text_col}`").alias("text"))
    buckets = LEAST_BITS
    wanted = min(MOST_BITS, BITS_EACH * df.count())  # files know their rows, so no text is read
    while buckets < wanted:
        buckets *= 2
    frequent = likely = None
    for k in range(1, LONGEST + 1):
        _pass(texts, k, buckets, least, frequent, likely).write.parquet(f"{folder}/raw{k}")
        raw = spark.read.parquet(f"{folder}/raw{k}")
        # Rare phrases go before anything is stored.
        counted = raw.where("counts IS NULL").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n"))
        counted.where((F.col("n") >= least) | (F.col("bucket") < 0)).write.parquet(f"{folder}/{k}")
        for old in (frequent, likely):
            if old is not None:
                old.destroy()
        if k < LONGEST:
            found = spark.read.parquet(f"{folder}/{k}").where("phrase IS NOT NULL")
            bits = found.groupBy(F.floor(F.col("bucket") / BLOCK).alias("b")).agg(F.bitmap_construct_agg(F.col("bucket") % BLOCK).alias("bits"))
            frequent, likely = _bitmap(bits, BLOCK, buckets), _bitmap(_likely(raw, least), COUNTED, buckets)
        drop_folder(spark, f"{folder}/raw{k}")
    every = [spark.read.parquet(f"{folder}/{k}").where("phrase IS NOT NULL").select("lang", "phrase", F.lit(k).alias("k"), F.col("n").alias("f")) for k in range(1, LONGEST + 1)]
    phrases = every[0]
    for more in every[1:]:
        phrases = phrases.unionByName(more)
    return phrases, spark.read.parquet(f"{folder}/1").where("phrase IS NULL AND bucket < 0").select("lang", "n")


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 * a / parts), exact where the product passes 64 bits."""
    return F.call_function("div", F.lit(SCORE).cast("decimal(7,0)") * a.cast("decimal(20,0)"), parts.cast("decimal(20,0)"))


def _key(phrase: Column) -> Column:
    """Language and phrase as one value: a phrase holds no line end."""
    return F.concat(phrase, F.lit("\n"), F.col("lang"))


def scored(phrases: DataFrame, folder: str) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words and more, at the cut that scores least, the first of equal ones."""
    spark = phrases.sparkSession
    words = F.split("phrase", " ")
    cuts = phrases.where("k > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    join = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "j", _key(join(F.lit(1), F.col("j"))).alias("first"), _key(join(F.col("j") + 1, F.col("k") - F.col("j"))).alias("last"))
    cuts.write.parquet(f"{folder}/cuts")
    parts = phrases.where(F.col("k") < LONGEST).select(_key(F.col("phrase")).alias("part"), "f")
    both = join_hot(spark.read.parquet(f"{folder}/cuts"), parts.withColumnsRenamed({"part": "first", "f": "l"}), "first")
    both.drop("first").write.parquet(f"{folder}/half")
    both = join_hot(spark.read.parquet(f"{folder}/half"), parts.withColumnsRenamed({"part": "last", "f": "r"}), "last")
    least = F.min(F.struct(score(F.col("a"), F.col("l") + F.col("r")).alias("score"), "j", "l", "r")).alias("c")
    return both.groupBy("lang", "phrase", "a").agg(least).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def contained(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, inside): the most occurrences of a longer phrase that holds this one's words."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda s: F.array_join(F.slice(words, s, n), " "))))
    return phrases.where("k > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("inside"))


def top(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of each language; parts of a language are cut first, so no task sorts a whole one."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("phrase"), partitions(rows.sparkSession)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= most)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most).drop("_part")


def mine(df: DataFrame, least: int = 30, share: int = 80, most: int = 2000, lang_col: str = "lang", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best-scoring phrases of 2 to 4 words of each language.

    A phrase inside a longer one with at least `share` hundredths of its occurrences is dropped. Null texts count as
    empty, a null language as und; repeated rows count each; equal scores go by occurrences, then by the phrase's
    bytes; a table without words gives no rows; other columns are left out. Counts are stored in `folder`, or a new one
    beneath the shared one.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/phrases-{uuid.uuid4().hex}"
    phrases, totals = frequent_phrases(df, least, lang_col, text_col, folder)
    kept = scored(phrases, folder).join(contained(phrases), ["lang", "phrase"], "left")
    kept = kept.where(F.col("inside").isNull() | (F.col("inside").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    best = top(kept.drop("inside"), most).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *[F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")])


def oracle_sql(least: int = 30, share: int = 80, most: int = 2000) -> str:
    """DuckDB SQL of the same rows over documents."""
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, LONGEST + 1))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
    WITH texts AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{upper}', '{lower}') AS t FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
    grams AS ({grams}),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {least}),
    cuts AS (SELECT c.*, j FROM c, range(1, 4) AS t(j) WHERE j < k),
    scores AS (
      SELECT cuts.lang, cuts.phrase, a, j, x.f AS l, y.f AS r, ({SCORE}::HUGEINT * a) // (x.f + y.f) AS score FROM cuts
      JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:j], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[j + 1:], ' ')
    ),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    spans AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda n: list_transform(range(1, k - n + 2), lambda s: array_to_string(w[s:s + n - 1], ' '))))) AS phrase FROM c WHERE k > 2),
    inside AS (SELECT lang, phrase, max(a) AS m FROM spans GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE m IS NULL OR 100::HUGEINT * m < {share}::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= {most}"""
