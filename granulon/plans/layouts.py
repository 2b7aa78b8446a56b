"""Collections of images and masks laid out in folders, settings in files, and rules on names: made from rows, read back through the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.functions import scalars
from granulon.operators import annotations, audit, dedup, manifest, recipe, sampling
from granulon.plans.files import _folder
from granulon.plans.registry import Query, adder
from granulon.session import table
from granulon.sources import adapters, readers, sinks

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col


def _key() -> Column:
    return c("s_suppkey")


def _id() -> Column:
    return F.concat(F.lit("s"), _key().cast("string"))


def _laid_out(spark: SparkSession, sf_dir: str, root: str, folder: str, name: Column, where: str, suffix: str = ".png") -> None:
    """A file of a byte or some for each supplier that `where` keeps, in a folder below root."""
    rows = table(spark, sf_dir, "supplier").where(where)
    sinks.files(rows.select(name.alias("image_id"), F.encode("s_name", "UTF-8").alias("content")), f"{root}/{folder}", suffix)


_STATUS = "CASE WHEN s_suppkey % 3 = 0 THEN 'missing' WHEN s_suppkey % 5 = 0 THEN 'orphan' ELSE 'paired' END"
_KEPT = "WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 5 = 0)"
#: Every third image has no mask, every fifth mask no image.
_IMAGES, _MASKS = "s_suppkey % 5 <> 0 OR (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0)", "s_suppkey % 3 <> 0"


@query(f"SELECT concat('s', s_suppkey) AS key, {_STATUS} AS status FROM supplier {_KEPT}")
def adapter_same_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and maps of the same name in two folders."""
    root = _folder(spark)
    _laid_out(spark, sf_dir, root, "images", _id(), _IMAGES)
    _laid_out(spark, sf_dir, root, "segmaps", _id(), _MASKS)
    return adapters.pair_report(adapters.ADAPTERS["emps"](spark, root))


@query(f"SELECT concat('s', s_suppkey) AS key, {_STATUS} AS status FROM supplier {_KEPT}")
def adapter_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second of three folder layouts, masks with a suffix."""
    root = _folder(spark)
    _laid_out(spark, sf_dir, root, "img", _id(), _IMAGES)
    _laid_out(spark, sf_dir, root, "mask", F.concat(_id(), F.lit("_mask")), _MASKS)
    return adapters.pair_report(adapters.ADAPTERS["tio2"](spark, root))


@query(f"SELECT concat('s', s_suppkey) AS key, {_STATUS} AS status FROM supplier {_KEPT}")
def adapter_beside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label maps beside their images."""
    root = _folder(spark)
    _laid_out(spark, sf_dir, root, "", _id(), _IMAGES)
    _laid_out(spark, sf_dir, root, "", F.concat(_id(), F.lit("_labels")), _MASKS)
    return adapters.pair_report(adapters.ADAPTERS["generic"](spark, root))


@query(f"SELECT concat('part', s_suppkey % 4, '/s', s_suppkey) AS key, {_STATUS} AS status FROM supplier {_KEPT}")
def adapter_subfolders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sub-folders, half of them with image and target, half with img and gt."""
    root = _folder(spark)
    for k in range(4):
        image, mask = ("image", "target") if k % 2 else ("img", "gt")
        _laid_out(spark, sf_dir, root, f"part{k}/{image}", _id(), f"({_IMAGES}) AND s_suppkey % 4 = {k}")
        _laid_out(spark, sf_dir, root, f"part{k}/{mask}", _id() if k % 2 else F.concat(_id(), F.lit("_gt")), f"({_MASKS}) AND s_suppkey % 4 = {k}")
    return adapters.pair_report(adapters.ADAPTERS["nnp"](spark, root))


@query(
    """SELECT concat('img_', s_suppkey, '_', s_suppkey % 50, '_', 1 + s_suppkey % 9) AS key, CAST(s_suppkey % 3 AS VARCHAR) AS set_id, s_suppkey % 3 < 2 AS has_mask FROM supplier WHERE s_suppkey % 50 <= 34 AND 1 + s_suppkey % 9 > 6"""
)
def adapter_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of images that share one mask each; too much noise or too little contrast in the name leaves an image out."""
    root = _folder(spark)
    name = F.concat_ws("_", F.lit("img"), _key().cast("string"), (_key() % 50).cast("string"), (1 + _key() % 9).cast("string"))
    for k in range(3):
        _laid_out(spark, sf_dir, root, f"intensity_sets/set{k}", name, f"s_suppkey % 3 = {k}")
        if k < 2:
            sinks.files(spark.range(1).select(F.lit(f"set{k}").alias("image_id"), F.encode(F.lit("m"), "UTF-8").alias("content")), f"{root}/masks", ".png")
    found = adapters.ADAPTERS["nist"](spark, root)
    return found.select("key", "set_id", c("mask_path").isNotNull().alias("has_mask"))


@query(
    """SELECT concat('s', s_suppkey) AS name, CASE WHEN s_suppkey % 4 = 0 THEN '$.tile_size' END AS missing, CASE WHEN s_suppkey % 4 = 0 THEN 1024 ELSE CAST(512 + s_suppkey AS INTEGER) END AS tile_size, CASE WHEN s_suppkey % 3 = 0 THEN 'exclude' ELSE 'include' END AS policy FROM supplier"""
)
def settings_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference settings in a file for each supplier: required members, and values over the defaults."""
    body = F.to_json(F.struct(F.when(_key() % 4 != 0, (512 + _key()).cast("int")).alias("tile_size"), F.struct(F.when(_key() % 3 == 0, "exclude").alias("policy")).alias("runtime")))
    root = _folder(spark)
    sinks.files(table(spark, sf_dir, "supplier").select(_id().alias("image_id"), F.encode(body, "UTF-8").alias("content")), root, ".json")
    docs = readers.document(spark, root).withColumn("tile_size", F.lit(1024)).withColumn("policy", F.lit("include"))
    set_ = recipe.overrides(c("doc"), {"tile_size": ("$.tile_size", "int"), "policy": ("$.runtime.policy", "string")})
    lacks = F.nullif(F.array_join(recipe.required(c("doc"), ["$.tile_size", "$.runtime"]), ","), F.lit(""))
    return docs.select(scalars.stem(c("path")).alias("name"), lacks.alias("missing"), *[v.alias(k) for k, v in set_.items()])


@query("SELECT CAST(s_suppkey AS DOUBLE) AS min_size, CASE WHEN s_suppkey % 2 = 0 THEN 0.4 ELSE s_suppkey / 1000 END AS flow_threshold FROM supplier")
def tuning_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tuning results, half of them bare, half under best_params and without a threshold: the default holds."""
    bare = F.to_json(F.struct(_key().alias("min_size"), (_key() / 1000).alias("flow_threshold")))
    nested = F.to_json(F.struct(F.struct(_key().alias("min_size")).alias("best_params")))
    root = _folder(spark)
    sinks.files(table(spark, sf_dir, "supplier").select(_id().alias("image_id"), F.encode(F.when(_key() % 2 == 0, nested).otherwise(bare), "UTF-8").alias("content")), root, ".json")
    return readers.tuned(spark, root, {"min_size": 1, "flow_threshold": 0.4})


@query("SELECT concat('s', s_suppkey) AS image_id, CAST(12 * (s_suppkey % 7) + 66 AS DOUBLE) AS total FROM supplier")
def raw_plane_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw 32-bit planes of 3 x 4, through files without a header."""
    number = lambda i: F.unhex(F.element_at(F.array(*[F.lit(_HEX[k]) for k in range(len(_HEX))]), (i + _key() % 7 + 1).cast("int")))
    content = F.transform(F.sequence(F.lit(0), F.lit(11)), number)
    root = _folder(spark)
    whole = F.aggregate(content, F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    sinks.files(table(spark, sf_dir, "supplier").select(_id().alias("image_id"), whole.alias("content")), root, ".bin")
    found = readers.raw_planes(spark, root, 3, 4)
    return found.select("image_id", F.aggregate("plane", F.lit(0.0), lambda s, x: s + x).alias("total"))


def _hex(x: int) -> str:
    import struct

    return struct.pack("<f", x).hex()


#: 0 to 18 as little-endian 32-bit floats.
_HEX = [_hex(k) for k in range(19)]


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 1 AND o_orderkey % 12 <> 5")
def auto_split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be dealt to splits: neither held out by split nor by tile role; nulls are no reason."""
    key = c("o_orderkey")
    split, role = F.when(key % 10 == 1, "holdout").when(key % 10 == 2, None).otherwise("train"), F.when(key % 12 == 5, "holdout_full_image").when(key % 12 == 6, None).otherwise("")
    return table(spark, sf_dir, "orders").where(sampling.auto_split_candidate(split, role)).select("o_orderkey")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat('img/', p_partkey) WHEN 1 THEN concat('/other/', p_partkey) ELSE concat('a/b/', p_partkey) END AS path FROM part")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths below a base, elsewhere, and with backward slashes."""
    key = c("p_partkey").cast("string")
    path = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("/data/img/"), key)).when(c("p_partkey") % 3 == 1, F.concat(F.lit("/other/"), key)).otherwise(F.concat(F.lit("\\data\\a\\b\\"), key))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.relative_path(path, "/data").alias("path"))


@query(
    """SELECT record_id, source, label_status FROM (SELECT CASE WHEN c_custkey % 4 = 0 THEN concat('c', c_custkey) ELSE concat('r', c_custkey) END AS record_id, CASE WHEN c_custkey % 3 = 0 THEN 'prepared_2024-01-31' ELSE 'lab' END AS source, CASE WHEN c_custkey % 5 = 0 THEN 'prelabelled' ELSE 'reviewed' END AS label_status FROM customer)"""
)
def draft_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft rows with an id from the file's name, the day's source tag, and a label status where they have none."""
    key = c("c_custkey")
    text = key.cast("string")
    draft = table(spark, sf_dir, "customer").select(
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("r"), text)).alias("record_id"), F.concat(F.lit("c"), text, F.lit(".png")).alias("file_name"),
        F.when(key % 3 == 0, "").otherwise("lab").alias("source"), F.when(key % 5 == 0, "").otherwise("reviewed").alias("label_status"),
    )
    return manifest.with_defaults(manifest.normalise(draft), "prepared_2024-01-31").select("record_id", "source", "label_status")


@query("SELECT md5(concat(floor(l_quantity / 10), 'x', l_linenumber, 'x', text)) AS h, count(*) AS n FROM lineitem, (SELECT 'pixels' AS text) GROUP BY 1")
def shaped_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels in another shape are another content."""
    rows = table(spark, sf_dir, "lineitem").select(F.encode(F.lit("pixels"), "UTF-8").alias("p"), F.floor(c("l_quantity") / 10).cast("double").alias("h"), c("l_linenumber").alias("w"))
    return rows.groupBy(dedup.content_hash(c("p"), c("h"), c("w")).alias("h")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL OR c_mktsegment = '' THEN 'unknown' ELSE c_mktsegment END AS stratum FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def stratum_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata looked up in the manifest, unknown where it has none."""
    base = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(c("c_custkey").alias("k"), c("c_mktsegment").alias("stratum"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("k"), F.lit("").alias("stratum"))
    return manifest.enrich(rows, base, "k", ["stratum"], c("stratum")).select("o_orderkey", scalars.or_default(c("stratum")).alias("stratum"))


@query("SELECT p_partkey AS requested FROM part WHERE p_partkey % 4 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def requested_not_there(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names asked for that aren't available."""
    wanted = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(c("p_partkey").alias("requested"))
    return audit.orphans(wanted, table(spark, sf_dir, "lineitem").where("l_quantity > 48"), "requested", "l_partkey")


@query("SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def strict_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with a balance, each of which must have its customer: one without is an error."""
    customers = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), "c_nationkey", "c_acctbal")
    orders = audit.kept_with(table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("k")), customers.where("c_acctbal > 0"), "k", "k")
    return audit.strict_pairs(orders, customers.drop("c_acctbal"), "k").select("o_orderkey", "c_nationkey")


@query("SELECT o_orderkey AS image_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 GROUP BY 1")
def images_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose file is there and isn't a mask, with their annotations."""
    key = c("o_orderkey")
    name = F.concat(F.lit("o"), key.cast("string"), F.when(key % 5 == 0, "_mask.png").otherwise(".png"))
    images = table(spark, sf_dir, "orders").select(key.alias("id"), name.alias("file_name"))
    notes = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("image_id"))
    kept, own = annotations.on_disk(images, notes, images.where("id % 3 <> 0").select("file_name"))
    counts = own.groupBy("image_id").agg(F.count("*").alias("n"))
    return kept.select(c("id").alias("image_id")).join(counts, "image_id", "left").select("image_id", F.coalesce("n", F.lit(0)).alias("n"))
