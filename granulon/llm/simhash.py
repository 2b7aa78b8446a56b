"""SimHash near-duplicates through an inverted index of fingerprint bytes by position.

Two 64-bit fingerprints within d differing bits share at least 8 - d of their 8 positional bytes.
The index holds, for chosen pairs of positions, the fingerprints with the same two bytes there; the
pairs of positions are such that any 8 - d positions contain one of them. Within a posting list the
shared positional bytes of each pair are tallied, pairs that reach 8 - d are retained, and these are
verified by their differing bits. Equal fingerprints are one entry from the start, and a list gives a
spanning forest of its links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.llm.common import cut, fresh, join_hot, map_rows, partitions, text_of
from granulon.llm.components import connected

POSITIONS = 8
SEED = 42
#: Entries of a posting list that one block holds; longer lists are compared block against block.
BLOCK = 4096
#: Long posting lists whose sizes are sent to all tasks at most (a few megabytes); more are joined.
MOST_LONG = 100_000
#: Entries for each posting list that the choice of the index's width aims at.
LIST_LENGTH = 256


def fingerprint(text: str, size: int = 4) -> int:
    """A bit is set if more than half of the shingles' XXH64 have it; no words: zero."""
    words = text.encode().lower().split()  # bytes: lower() takes A-Z only, split() the six ASCII spaces
    if not words:
        return 0
    data = memoryview(b" ".join(words))
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    if len(words) < size:
        return digest(data, SEED)
    hashes = np.array([digest(data[s:e], SEED) for s, e in zip(starts, ends[size - 1 :])], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp bigint): the 64 bits as a signed number. Null text counts as empty, with fingerprint zero."""

    def make():
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return lambda c: [c["id"], c["hash"], [signed(fingerprint(t, size)) for t in c["text"]]]

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("hash"), text_of(text_col).alias("text"))
    return map_rows(rows, make, f"{id_col} {kind}, text_hash bigint, fp bigint")


@lru_cache(maxsize=None)
def index_keys(width: int, shared: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any `shared` positions contain one of them whole."""
    width = min(width, shared)
    if width == 1:
        return [(p,) for p in range(POSITIONS - shared + 1)]
    # Positions dealt into groups: by the pigeonhole principle some group holds enough of any choice.
    groups = max(1, (shared - 1) // (width - 1))
    dealt = [key for g in range(groups) for key in combinations(range(g, POSITIONS, groups), width)]
    # Or what is contained in the most choices left, one after the other.
    left, greedy = set(combinations(range(POSITIONS), shared)), []
    while left:
        best = max(combinations(range(POSITIONS), width), key=lambda k: sum(set(k) <= set(c) for c in left))
        greedy.append(best)
        left = {c for c in left if not set(best) <= set(c)}
    return min(dealt, greedy, key=len)


def index_width(entries: int, shared: int) -> int:
    """Positions in a key; any width finds every pair, a wider one makes shorter lists of more keys."""
    width = 1
    while width < shared and entries / 256**width > LIST_LENGTH:
        width += 1
    return width


def _bytes_at(positions: tuple[int, ...]):
    """The bytes of fp at these positions, side by side."""
    key = F.lit(0).cast("bigint")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)))
    return key


def _forest(left: np.ndarray, right: np.ndarray | None, shared: int, bits: int) -> tuple[list, list]:
    """Links within one block, or between two, that connect what all its links connect."""
    every = left if right is None else np.concatenate([left, right])
    root = np.arange(len(every))
    a_out: list[np.ndarray] = []
    b_out: list[np.ndarray] = []

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Unite a[i] and b[i], and keep the links that united something."""
        nonlocal root
        a_kept, b_kept = [], []
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = x, y
            while root[rx] != rx:
                root[rx] = rx = root[root[rx]]
            while root[ry] != ry:
                root[ry] = ry = root[root[ry]]
            if rx != ry:
                root[max(rx, ry)] = min(rx, ry)
                a_kept.append(x)
                b_kept.append(y)
        if a_kept:
            a_out.append(every[a_kept])
            b_out.append(every[b_kept])
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up

    if len(every) > 64 and bits >= 4:
        # Entries equal but for one half byte differ in at most 4 bits: chains of them are links without a search.
        for shift in range(0, 64, 4):
            masked = every & np.uint64(~(0xF << shift) & (2**64 - 1))
            order = np.argsort(masked, kind="stable")
            at = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            at = at[root[order[at]] != root[order[at + 1]]]
            join(order[at], order[at + 1])
    n = len(left)
    for i in range(n):
        rest = slice(i + 1, None) if right is None else slice(n, None)
        open_ = np.flatnonzero(root[rest] != root[i]) + rest.start
        if not len(open_):
            continue
        differ = every[open_] ^ every[i]
        tally = (differ[:, None].view(np.uint8) == 0).sum(axis=1)
        open_, differ = open_[tally >= shared], differ[tally >= shared]
        near = open_[np.bitwise_count(differ) <= bits]
        if len(near):
            join(np.full(len(near), i), near)
    return [x for p in a_out for x in p.view(np.int64).tolist()], [x for p in b_out for x in p.view(np.int64).tolist()]


def _pairs(fp: np.ndarray, run: np.ndarray, shared: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All verified pairs of entries in the same short run, by tallying shared positional bytes."""
    a_out, b_out, at = [], [], np.arange(len(fp))
    shift = 1
    while len(at):
        at = at[at + shift < len(fp)]
        at = at[run[at] == run[at + shift]]
        differ = fp[at] ^ fp[at + shift]
        near = (differ[:, None].view(np.uint8) == 0).sum(axis=1) >= shared
        near &= np.bitwise_count(differ) <= bits
        a_out.append(fp[at[near]])
        b_out.append(fp[at[near] + shift])
        shift += 1
    if not a_out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(a_out), np.concatenate(b_out)


#: Lists up to this length give their links pair by pair; longer ones a spanning forest.
SHORT = 64


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b) of fingerprints that connect everything that links at `bits` or fewer differing bits connect.

    distinct: (fp bigint), each once.
    """
    shared = POSITIONS - bits
    if not 0 < shared <= POSITIONS:
        raise ValueError("bits: 0 to 7")
    spark = distinct.sparkSession
    keys = index_keys(index_width(distinct.count(), shared), shared)
    entries = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("k"), _bytes_at(p).alias("at")) for i, p in enumerate(keys)])).alias("e")).select("fp", "e.k", "e.at")
    # Long lists are cut into blocks by hash; each pair of blocks is a cell of its own. Lists are counted
    # before they are dealt out, and the long ones are so few (entries * keys / BLOCK) that few of them meet in a task.
    long = cut(entries.groupBy("k", "at").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("k", "at", F.expr(f"cast(ceil(c / {BLOCK}) as int)").alias("n")))
    some = long.limit(MOST_LONG + 1).collect()
    if len(some) > MOST_LONG:
        entries = entries.join(long, ["k", "at"], "left")
    elif some:
        entries = entries.join(F.broadcast(long), ["k", "at"], "left")
    else:
        entries = entries.withColumn("n", F.lit(1))
    blocks = entries.withColumn("n", F.coalesce("n", F.lit(1)))
    blocks = blocks.withColumn("own", F.expr("cast(pmod(xxhash64(fp), n) as int)"))
    cells = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cells = cells.select("fp", "k", "at", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = cells.repartition(partitions(spark), "k", "at", "i", "j").sortWithinPartitions("k", "at", "i", "j", "own", "fp")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            fp, k, at, own, i, j = cols
            fp = fp.view(np.uint64)
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (at[1:] != at[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            run = np.cumsum(new)
            starts = np.append(np.flatnonzero(new), len(fp))
            long = np.flatnonzero(np.diff(starts) > SHORT)
            a_out, b_out = [], []
            short = ~np.isin(run - 1, long)
            a, b = _pairs(fp[short], run[short], shared, bits)
            a_out += a.view(np.int64).tolist()
            b_out += b.view(np.int64).tolist()
            for r in long.tolist():
                s, e = starts[r], starts[r + 1]
                if i[s] == j[s]:
                    a, b = _forest(fp[s:e], None, shared, bits)
                else:
                    split = s + int((own[s:e] == i[s]).sum())
                    a, b = _forest(fp[s:split], fp[split:e], shared, bits)
                a_out += a
                b_out += b
            return pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], schema=schema)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            # The last cell may go on in the next batch.
            same = np.ones(len(cols[0]), bool)
            for c in (cols[1], cols[2], cols[4], cols[5]):
                same &= c == c[-1]
            cutoff = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cutoff:
                yield work([c[:cutoff] for c in cols])
            held = [c[cutoff:] for c in cols]
        if held and len(held[0]):
            yield work(held)

    return dealt.mapInArrow(search, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row; rows with the same root are one group.

    component_id is the smallest id that chains of links reach, itself included. Empty and null texts have
    fingerprint zero and link like others; repeated rows stay repeated; a null id is kept and counts as no
    id; an empty table gives an empty table; other columns are left out.
    """
    prints = cut(fingerprints(df, id_col, text_col, size))
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = connected(links(classes.select("fp"), bits))
    named = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # A group may have a third of all fingerprints, and a fingerprint a third of all rows: these are dealt to many places.
    labelled = join_hot(named.select("fp", "root"), smallest, "root", "inner").select("fp", "root", "component_id")
    return join_hot(prints, labelled, "fp", "inner").select(id_col, "text_hash", "fp", "root", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """One row of each group of near_duplicates(), with all its columns: the one with the smallest id.

    Rows without an id stay only where no row of their group has one; of rows with the same id, the one
    with the smallest text hash stays, and of equal ones one.
    """
    found = near_duplicates(df, id_col, text_col, size, bits)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "text_hash")).alias("c"))
    key = lambda i, h: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("-")), h.cast("string"))
    name, place = fresh(df, "_key"), fresh(df, "_first")
    keys = chosen.select(key(F.col("c.id"), F.col("c.text_hash")).alias(name)).distinct()
    rows = df.withColumn(name, key(F.col(id_col), F.xxhash64(text_of(text_col)))).join(keys.hint("shuffle_hash"), name, "left_semi")
    plain = [f.name for f in df.schema if f.dataType.typeName() in ("long", "integer", "short", "string", "double", "boolean", "date", "timestamp")]
    first = F.row_number().over(Window.partitionBy(name).orderBy(*[F.col(f"`{c}`") for c in plain if c != text_col] or [name]))
    return rows.withColumn(place, first).where(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
