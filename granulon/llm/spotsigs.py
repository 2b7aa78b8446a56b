"""SpotSigs fingerprints; DataFrame expressions only.

A signature is a chain of CHAIN content words that starts right behind a common word (an anchor);
other anchors within the chain are passed over. A text's fingerprint is the set of its signatures'
hashes. Anchors hold prose together and are rare in menus and lists, so the set follows the prose.

Near-duplicates: sets are dealt to partitions by their size. Two sets of Jaccard similarity t or more
differ in size by a factor 1 / t at most, so with partition bounds that grow by that factor a set meets
only its own and the next partition. Within these, sets meet by the signatures that a common rarest-first
prefix must hold, are pruned by their sizes, and compared in full.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granulon.llm.common import cut, partitions
from granulon.llm.components import connected

#: Content words in a chain.
CHAIN = 3
#: Ranges of ids that a shuffle partition gets, about; and ranges at most. A window orders a range.
RANGES, MOST_RANGES = 16, 100_000
#: Sets that a signature's list in a partition of the join holds whole; longer lists are cut into blocks of about this size.
BLOCK = 4096

# Anchors, frequent words of English, French, German and Spanish.
ANCHORS = (
    "the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which one "
    "de la le les et des en un une du dans que qui pour est par sur pas au avec "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine "
    "el los las del se por con una su al es lo como más para"
).split()


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted different 64-bit hashes of the text's spot signatures.

    A text with words but without a signature has one hash of all its words, so equal texts still have
    equal fingerprints; a text without words, or null, has none.
    """
    # Words in lower case, a space before each and one at the end; what isn't a letter or digit separates.
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    anchors = "|".join(dict.fromkeys(ANCHORS))
    # Each anchor gives way to a mark on the next content word. (One at a time: Java's stack grows with a repeated group.)
    marked = F.regexp_replace(plain, rf"(?<= )(?:{anchors}) ", "\x01")
    chains = F.regexp_extract_all(marked, F.lit(r"\x01(?=([^ \x01]+ " + r"\x01*[^ \x01]+ " * (chain - 1) + "))"), F.lit(1))

    def of(found: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.xxhash64(F.translate(s, "\x01", "")))))

    return _let(F.struct(chains.alias("c"), plain.alias("p")), lambda x: F.when(F.size(x["c"]) > 0, of(x["c"])).when(F.length(x["p"]) > 2, F.array(F.xxhash64(x["p"]))).otherwise(F.array().cast("array<bigint>")))


def fingerprint(hashes: Column) -> Column:
    """The set as a string, 16 hexadecimal digits for each signature; the empty set is the empty string."""
    return F.lower(F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets of hashes; 0 at once where the sizes alone keep it under least. Two empty sets: 1."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return F.when(large == 0, 1.0).when((small == 0) | (small < F.lit(least) * large), 0.0).otherwise(common / (small + large - common))


def _range_of(docs: DataFrame) -> Column:
    """The number of the range that holds _id, ascending; ranges have about as many rows each, null ids are below all others.

    The bounds are approximate quantiles: no more than MOST_RANGES numbers, and looked up in two steps.
    """
    n = min(RANGES * partitions(docs.sparkSession), MOST_RANGES)
    bounds = sorted(set(docs.agg(F.percentile_approx("_id", [k / n for k in range(1, n)], 10 * n)).first()[0] or [])) if n > 1 else []
    if not bounds:
        return F.when(F.col("_id").isNull(), -1).otherwise(0)
    width = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    table = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    below = lambda found: F.size(F.filter(found, lambda x: x <= F.col("_id")))
    own = _let(below(F.from_json(F.lit(json.dumps([c[0] for c in chunks])), "array<bigint>")), lambda k: F.when(k == 0, 0).otherwise(k * width + below(F.element_at(table, F.greatest(k, F.lit(1))))))
    return F.when(F.col("_id").isNull(), -1).otherwise(own)


def compare_with_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The edited
    text has the first code points of the next document, by ascending id, in place of the last half.
    Null texts count as empty; two empty fingerprints are alike (1). Of rows with the same id the order is
    by text; the row behind the last one is the first. A single row is its own next document. Rows with
    a null id come first. An empty table gives an empty table; other columns are left out.

    Texts are shuffled once, by ranges of ids with about as many rows each, whatever the ids look like; the
    first document of a range goes to the range before it besides. The driver sees the bounds of the
    ranges and their first ids.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    docs = docs.withColumn("_range", _range_of(docs))
    own = Window.partitionBy("_range").orderBy("_id", "_text")
    # Dealt out by hand, so that texts are shuffled without their signatures.
    dealt = docs.repartition("_range").withColumn("_sig", signatures(F.col("_text")))
    ordered = dealt.withColumn("_after", F.lead(F.struct("_text", "_sig")).over(own))
    firsts = sorted(docs.groupBy("_range").agg(F.min("_id")).collect())  # a row for each range
    behind = [(k, firsts[(i + 1) % len(firsts)][1], firsts[(i + 1) % len(firsts)][0]) for i, (k, _) in enumerate(firsts)]
    behind = F.broadcast(df.sparkSession.createDataFrame(behind, "_s int, _first bigint, _next int"))
    heads = docs.join(behind, (F.col("_range") == F.col("_next")) & F.col("_id").eqNullSafe(F.col("_first")))
    heads = heads.withColumn("_rank", F.row_number().over(Window.partitionBy("_s").orderBy("_text"))).where("_rank = 1")
    heads = heads.select("_s", F.struct("_text", signatures(F.col("_text")).alias("_sig")).alias("_head"))
    joined = ordered.join(heads, (F.col("_range") == F.col("_s")) & F.col("_after").isNull(), "left")
    joined = joined.select("_id", "_text", "_sig", F.length("_text").alias("_n"), F.coalesce("_after", "_head").alias("_after"))
    half = F.floor(F.col("_n") / 2).cast("int")
    edited = F.concat(F.col("_text").substr(F.lit(1), F.col("_n") - half), F.col("_after._text").substr(F.lit(1), half))

    def found(text: Column) -> Column:
        of = lambda sig: F.struct(fingerprint(sig).alias("f"), likeness(F.col("_sig"), sig).alias("l"))
        return F.struct(F.sha2(text, 256).alias("h"), _let(signatures(text), of).alias("s"))

    out = joined.withColumn("_e", _let(edited, found))
    return out.select(
        F.col("_id").alias(id_col), F.col("_n").cast("bigint").alias("n_chars"), F.col("_e.h").alias("edited_sha256"), fingerprint(F.col("_sig")).alias("fingerprint"),
        F.col("_e.s.f").alias("edited_fingerprint"), F.col("_e.s.l").alias("near_edited"), likeness(F.col("_sig"), F.col("_after._sig")).alias("near_next"),
    )


def similar_sets(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, likeness) with a < b of all pairs of different sets (id, sig) with a likeness of at least `least`.

    ids must be unique; empty sets have no pairs. A signature that very many sets have in their prefix is
    dealt out: its list is cut into blocks by hash, and each pair of blocks is joined in a place of its own.
    """
    if not 0 < least <= 1:
        raise ValueError("least: above 0 and at most 1")
    sets = sets.where(F.size("sig") > 0).select("id", "sig", F.size("sig").alias("n"))
    part = F.floor(F.log(F.col("n")) / F.lit(-math.log(least) if least < 1 else 1.0) + F.lit(1e-9)).cast("int")
    parts = sets.withColumn("part", part if least < 1 else F.col("n"))
    words = parts.select("id", "n", "part", F.explode("sig").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    # Sets that are alike enough share one of the first n - ceil(least * n) + 1 of their signatures, rarest first.
    prefix = cut(words.join(often, "w").where("df > 1").withColumn("r", rarest).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).select("id", "n", "part", "w"))
    probe = prefix.select(F.col("id").alias("x"), F.col("n").alias("xn"), "w", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    hot = probe.groupBy("w", "part").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK).select("w", "part", F.ceil(F.col("c") / BLOCK).cast("int").alias("k"))

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        """rows in their own block, once for each block of the other side."""
        k = F.coalesce("k", F.lit(1))
        return rows.join(hot, ["w", "part"], "left").withColumn(own, F.pmod(F.xxhash64(key), k).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), k - 1))).drop("k")

    larger = (F.col("n") > F.col("xn")) | ((F.col("n") == F.col("xn")) & (F.col("id") > F.col("x")))
    met = dealt(probe, "x", "i", "j").join(dealt(prefix, "id", "j", "i"), ["w", "part", "i", "j"])
    pairs = met.where(larger & (F.col("xn") >= F.col("n") * F.lit(least) - 1e-9)).select("x", F.col("id").alias("y")).distinct()
    full = pairs.join(sets.select(F.col("id").alias("x"), F.col("sig").alias("xs")), "x").join(sets.select(F.col("id").alias("y"), F.col("sig").alias("ys")), "y")
    full = full.select("x", "y", likeness(F.col("xs"), F.col("ys"), least).alias("likeness")).where(F.col("likeness") >= least)
    return full.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def near_duplicates(df: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, component_id) of each row: texts with equal fingerprints are one class, named by its
    smallest id; classes are compared once each, and component_id is the smallest id that links reach.

    Null texts count as empty; texts without words are one class without links; repeated rows stay
    repeated; an empty table gives an empty table; other columns are left out.
    """
    prints = cut(df.select(F.col(id_col).alias("_id"), signatures(F.col(text_col)).alias("sig")).withColumn("key", F.sha2(fingerprint(F.col("sig")), 256)))
    classes = cut(prints.groupBy("key").agg(F.min("_id").alias("id"), F.first("sig").alias("sig")))
    roots = connected(similar_sets(classes.select("id", "sig"), least))
    named = classes.select("key", "id").join(roots, F.col("id") == F.col("node"), "left").select("key", F.col("id").alias("class_id"), F.coalesce("root", "id").alias("component_id"))
    return prints.select("_id", "key").join(named, "key").select(F.col("_id").alias(id_col), "class_id", "component_id")
