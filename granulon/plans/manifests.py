"""Manifest, audit, dedup, sampling and recipe queries over documents, events, orders and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.functions import scalars
from granulon.operators import audit, dedup, manifest, recipe, sampling
from granulon.plans.registry import Query, adder
from granulon.session import table
from granulon.streaming import ingest

QUERIES: dict[str, tuple[Query, str | None]] = {}
query = adder(QUERIES)
c = F.col

SEED, VAL_RATIO = 42, 0.1
#: Documents as a manifest: a source is seven documents of a source tag, its stratum their language.
SOURCE = "concat(source, '/', cast(floor(doc_id / 140) as bigint))"
DUCK_SOURCE = "concat(source, '/', CAST(floor(doc_id / 140) AS BIGINT))"
SPLIT = "CASE WHEN doc_id % 10 = 0 THEN 'val' WHEN doc_id % 10 = 1 THEN 'holdout' ELSE 'train' END"


@query(
    r"""
    WITH n AS (SELECT page_id, concat(CASE page_id % 6 WHEN 0 THEN 'TiO2_TSEM_' WHEN 1 THEN 'nist_set1_' WHEN 2 THEN 'emps_' WHEN 3 THEN 'cryo_' WHEN 4 THEN 'nnp_' ELSE 'misc_' END,
                 page_id, CASE WHEN page_id % 3 = 0 THEN '_tile_0_768' ELSE '' END, '.png') AS f,
                 lower(trim(CASE page_id % 5 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'y' WHEN 2 THEN 'no' WHEN 3 THEN '0' ELSE 'maybe' END)) AS b FROM pages),
         m AS (SELECT *, regexp_replace(lower(f), '_tile_\d+_\d+(\.[^.]+)?$', '\1') AS k FROM n)
    SELECT page_id, f AS file_name,
      CASE WHEN k LIKE 'tio2\_tsem\_%' ESCAPE '\' THEN 'TSEM' WHEN k LIKE '%emps%' OR k LIKE 'nist\_%' ESCAPE '\' OR k LIKE 'tio2\_sem\_%' ESCAPE '\' THEN 'SEM' WHEN k LIKE '%cryo%' THEN 'CryoEM'
           WHEN k LIKE '%nnp%' OR k LIKE '%tem%' THEN 'TEM' ELSE 'unknown' END AS microscope_type,
      CASE WHEN k LIKE 'nist\_%' ESCAPE '\' THEN 'NIST' WHEN k LIKE '%emps%' THEN 'SEM' WHEN k LIKE 'tio2\_tsem\_%' ESCAPE '\' THEN 'TSEM' WHEN k LIKE '%cryo%' THEN 'CryoEM' WHEN k LIKE '%nnp%' THEN 'TEM' ELSE 'Other' END AS collection,
      CASE WHEN k LIKE 'nist_set1\_%' ESCAPE '\' THEN 'nist_set1' ELSE f END AS split_group, regexp_replace(f, '\.[^.]*$', '') AS stem,
      CASE WHEN b IN ('1','true','yes','y') THEN 'true' WHEN b IN ('0','false','no','n') THEN 'false' ELSE b END AS is_large_image
    FROM m
    """
)
def manifest_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.element_at(F.array(*map(F.lit, ("TiO2_TSEM_", "nist_set1_", "emps_", "cryo_", "nnp_", "misc_"))), (c("page_id") % 6 + 1).cast("int"))
    flag = F.element_at(F.array(*map(F.lit, (" TRUE ", "y", "no", "0", "maybe"))), (c("page_id") % 5 + 1).cast("int"))
    name = F.concat(prefix, c("page_id").cast("string"), F.when(c("page_id") % 3 == 0, "_tile_0_768").otherwise(""), F.lit(".png"))
    raw = table(spark, sf_dir, "pages").select(c("page_id").alias("row_no"), name.alias("file_name"), flag.alias("is_large_image"))
    f = c("file_name")
    return manifest.normalise(raw).select(
        c("row_no").alias("page_id"), f, scalars.microscope_of_file(f).alias("microscope_type"), scalars.microscope_of_collection(f).alias("collection"),
        F.when(scalars.split_group(f) == f, f).otherwise(scalars.split_group(f)).alias("split_group"), scalars.stem(f).alias("stem"), "is_large_image",
    )


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def field_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.field_summary(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT md5(text) AS \"key\", count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.duplicate_keys(table(spark, sf_dir, "documents"), F.md5("text"))


@query("SELECT event_id, 'event_type' AS field, event_type AS value FROM events WHERE event_type NOT IN ('click', 'view') UNION ALL SELECT event_id, 'flag', 'maybe' FROM events WHERE event_id % 4 = 3")
def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("flag", F.when(c("event_id") % 4 == 3, "maybe").otherwise("true"))
    return manifest.enum_violations(rows, ["event_id"], {"event_type": ("click", "view"), "flag": ("true", "false")})


@query(
    """
    WITH r AS (SELECT doc_id, source AS image_path, CASE WHEN doc_id % 11 = 0 THEN '' ELSE lang END AS file_name FROM documents),
         d AS (SELECT image_path FROM r GROUP BY 1 HAVING count(*) > 1)
    SELECT 'missing_file_name' AS rule, CAST(doc_id AS VARCHAR) AS record_id, 'file_name' AS detail FROM r WHERE file_name = ''
    UNION ALL SELECT 'duplicate_image_path', NULL, image_path FROM d
    UNION ALL SELECT 'flow_required', CAST(doc_id AS VARCHAR), 'train' FROM r
    UNION ALL SELECT 'reviewed_required', CAST(doc_id AS VARCHAR), 'prelabelled' FROM r WHERE doc_id % 2 = 0
    UNION ALL SELECT 'enum', CAST(doc_id AS VARCHAR), 'density_level=crowded' FROM r WHERE doc_id % 5 = 0
    UNION ALL SELECT 'unknown_values', NULL, concat(f, '=', (SELECT count(*) FROM r)) FROM (VALUES ('microscope_type'), ('particle_morphology'), ('size_distribution'), ('quality_level'), ('adhesion_level')) t(f)
    UNION ALL SELECT 'unknown_values', NULL, concat('density_level=', count(*)) FROM r WHERE doc_id % 5 <> 0
    UNION ALL SELECT 'not_found_image_path', CAST(doc_id AS VARCHAR), image_path FROM r WHERE image_path = 'src0'
    UNION ALL SELECT 'forbidden_column', NULL, 'Pixel_Size'
    """
)
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole rule table over documents dressed as a manifest."""
    u = F.lit("unknown")
    rows = table(spark, sf_dir, "documents").select(
        c("doc_id").alias("row_no"), c("doc_id").cast("string").alias("record_id"), c("source").alias("image_path"), F.when(c("doc_id") % 11 == 0, "").otherwise(c("lang")).alias("file_name"), F.lit("train").alias("split"),
        u.alias("microscope_type"), u.alias("polarity"), u.alias("particle_morphology"), F.when(c("doc_id") % 5 == 0, "crowded").otherwise("unknown").alias("density_level"), u.alias("size_distribution"),
        u.alias("quality_level"), u.alias("adhesion_level"), F.when(c("doc_id") % 2 == 0, "prelabelled").otherwise("reviewed").alias("label_status"), F.lit("no").alias("is_large_image"), F.lit("no").alias("is_tile"),
    )
    rules = manifest.validate(manifest.normalise(rows), rows.select(c("image_path").alias("path")).where("path <> 'src0'").distinct(), ("train", "val"), (), ("train",), ["Pixel_Size"])
    return rules.select("rule", "record_id", "detail")


@query(
    """
    SELECT event_id, 'missing' AS rule, '$.missing' AS path FROM events
    UNION ALL SELECT event_id, 'range', '$.k' FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50
    UNION ALL SELECT event_id, 'unknown', 'k' FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL
    """
)
def recipe_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = c("props")
    checks = {"missing": recipe.required(doc, ["$.missing"]), "range": recipe.ranges(doc, {"$.k": (None, 50)}), "unknown": recipe.unknown_members(doc, ["j"])}
    return recipe.rule_table(table(spark, sf_dir, "events"), "event_id", checks)


@query("SELECT event_id, COALESCE(CAST(json_extract_string(props, '$.k') AS INTEGER), 7) AS tile_size, event_type AS policy FROM events")
def recipe_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("tile_size", F.lit(7)).withColumn("policy", c("event_type"))
    return rows.select("event_id", *[v.alias(k) for k, v in recipe.overrides(c("props"), {"tile_size": ("$.k", "int"), "policy": ("$.p", "string")}).items()])


@query(
    f"""
    WITH d AS (SELECT {SPLIT} AS s, n_chars > 3000 AS big, source FROM documents)
    SELECT rule, actual, CAST(minimum AS BIGINT) AS minimum, actual >= minimum AS ok FROM (
      SELECT 'train' AS rule, count(*) FILTER (s = 'train') AS actual, 200 AS minimum FROM d
      UNION ALL SELECT 'val', count(*) FILTER (s = 'val'), 30 FROM d
      UNION ALL SELECT 'holdout', count(*) FILTER (s = 'holdout'), 10 FROM d
      UNION ALL SELECT 'large_sources', count(DISTINCT source) FILTER (big), 5 FROM d
      UNION ALL SELECT 'holdout_large_sources', count(DISTINCT source) FILTER (big AND s = 'holdout'), 3 FROM d)
    """
)
def v1_minimums(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return manifest.minimums(docs, F.expr(SPLIT), c("n_chars") > 3000, c("source"))


@query(
    """
    SELECT 'short' AS rule, min(doc_id) AS first_key FROM documents WHERE n_chars < 200 HAVING count(*) > 0
    UNION ALL SELECT 'not_english', min(doc_id) FROM documents WHERE lang <> 'en' HAVING count(*) > 0
    UNION ALL SELECT 'never', min(doc_id) FROM documents WHERE n_chars < 0 HAVING count(*) > 0
    """
)
def first_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.first_violations(table(spark, sf_dir, "documents"), c("doc_id"), c("doc_id"), {"short": c("n_chars") < 200, "not_english": c("lang") != "en", "never": c("n_chars") < 0})


@query("SELECT COALESCE(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'orphan' WHEN l.doc_id IS NULL THEN 'missing' ELSE 'paired' END AS status FROM documents d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.pair_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'paired' END AS status, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_counts(pair_audit(spark, sf_dir))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def orphan_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return audit.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), kept, "l_orderkey", "o_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def kept_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images on disk first, then their annotations."""
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return audit.kept_with(table(spark, sf_dir, "lineitem"), kept, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(
    f"""
    WITH d AS (SELECT {SPLIT} AS s, md5(text) AS h, doc_id FROM documents)
    SELECT h AS content_hash, count(*) FILTER (s = 'train') AS n_train, count(*) FILTER (s = 'val') AS n_val, min(doc_id) FILTER (s = 'train') AS first_train, min(doc_id) FILTER (s = 'val') AS first_val
    FROM d WHERE s IN ('train', 'val') GROUP BY h HAVING count(*) FILTER (s = 'train') > 0 AND count(*) FILTER (s = 'val') > 0
    """
)
def content_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.content_leaks(table(spark, sf_dir, "documents"), F.expr(SPLIT), dedup.content_hash(c("text")), c("doc_id"))


#: A split that doesn't keep sources together.
CARELESS_SPLIT = "CASE WHEN floor(doc_id / 20) % 3 = 0 THEN 'val' ELSE 'train' END"


@query(f"SELECT {DUCK_SOURCE} AS source_unit, count(DISTINCT {CARELESS_SPLIT}) AS n_splits FROM documents GROUP BY 1 HAVING count(DISTINCT {CARELESS_SPLIT}) > 1")
def source_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.source_leaks(table(spark, sf_dir, "documents"), F.expr(SOURCE), F.expr(CARELESS_SPLIT))


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT DISTINCT l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("k"), "l_returnflag")
    return audit.common_keys(items.where("l_returnflag = 'R'"), items.where("l_returnflag = 'N'"), "k")


@query("SELECT COALESCE(a.lang, b.lang) AS lang, CASE WHEN b.lang IS NULL THEN 'not_in_json' ELSE 'not_on_disk' END AS status FROM (SELECT DISTINCT lang FROM documents) a FULL OUTER JOIN (VALUES ('en'), ('xx')) b(lang) ON a.lang = b.lang WHERE a.lang IS NULL OR b.lang IS NULL")
def name_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(F.lit("en"), F.lit("xx"))).alias("lang"))
    return audit.name_differences(table(spark, sf_dir, "documents"), listed, "lang", "not_in_json", "not_on_disk")


@query("SELECT substr(p_name, 1, 3) AS \"key\", count(*) AS n, array_to_string(list_sort(list_distinct(list(p_brand)))[1:5], ',') AS names FROM part GROUP BY 1 HAVING count(*) > 1")
def mask_key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit.key_collisions(table(spark, sf_dir, "part"), F.substring("p_name", 1, 3), c("p_brand"))
    return found.withColumn("names", F.array_join("names", ","))


@query("SELECT doc_id, CASE WHEN k = 0 THEN f ELSE concat(source, '_', k, '.png') END AS new_name FROM (SELECT doc_id, source, concat(source, '.png') AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)")
def collision_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of a source want its name."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".png")).alias("name"))
    return audit.renamed(rows, "name", ["doc_id"]).select("doc_id", "new_name")


@query(
    """
    WITH b AS (SELECT o_custkey, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
    SELECT c_custkey, COALESCE(nullif(nullif(b.p, ''), 'unknown'), c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN b ON c_custkey = o_custkey
    """
)
def base_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "orders").select(c("o_custkey").alias("c_custkey"), c("o_orderpriority").alias("c_mktsegment"), "o_orderkey")
    return manifest.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), base, "c_custkey", ["c_mktsegment"], c("o_orderkey"))


@query(
    """
    WITH e AS (SELECT md5(text) AS h, min(doc_id) AS old_name FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), i AS (SELECT md5(text) AS h, min(doc_id) AS new_name FROM documents WHERE doc_id % 3 > 0 GROUP BY 1)
    SELECT COALESCE(e.h, i.h) AS h, CASE WHEN new_name IS NULL THEN 'keep' WHEN old_name IS NULL THEN 'insert' ELSE 'replace' END AS action, COALESCE(old_name, new_name) AS name, old_name FROM e FULL OUTER JOIN i ON e.h = i.h
    """
)
def hash_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents is there, the others come in."""
    docs = table(spark, sf_dir, "documents").select(F.md5("text").alias("h"), c("doc_id").alias("name"))
    return dedup.upsert_plan(docs.where("name % 3 = 0"), docs.where("name % 3 > 0"), "h", "name")


@query(
    """
    WITH b AS (SELECT * FROM events WHERE event_id % 2 = 1), n AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id % 2 = 0 AND e.user_id = b.user_id AND e.event_type = b.event_type))
    SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM n) WHERE r = 1
    """
)
def append_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events are there, odd ones are a batch."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return dedup.append_new(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query(
    """
    WITH u AS (SELECT 0 AS s, c_mktsegment AS name, c_custkey AS id FROM customer UNION ALL SELECT 1, o_orderpriority, o_orderkey FROM orders)
    SELECT name, id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY s, id) AS r FROM u) WHERE r = 1
    """
)
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(c("c_mktsegment").alias("name"), c("c_custkey").alias("id"))
    b = table(spark, sf_dir, "orders").select(c("o_orderpriority").alias("name"), c("o_orderkey").alias("id"))
    return dedup.union_first([a, b], "name", "id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS new_id FROM orders")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.renumbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "new_id")


_UNITS = f"u AS (SELECT {DUCK_SOURCE} AS unit, min_by(lang, doc_id) AS stratum, count(*) AS n_rows FROM documents GROUP BY 1)"
_RANKED = f"r AS (SELECT *, md5(concat('{SEED}|', unit)) AS h, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('{SEED}|', unit)), unit) AS k FROM u)"
_QUOTA = f"least(n, greatest(CAST(round_even(n * {VAL_RATIO}, 0) AS INTEGER), CASE WHEN n >= 4 THEN 1 ELSE 0 END))"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.source_units(table(spark, sf_dir, "documents"), F.expr(SOURCE), c("lang"), c("doc_id"))


@query(f"WITH {_UNITS}, {_RANKED} SELECT unit, stratum, n_rows, CASE WHEN k <= {_QUOTA} THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_units(spark, sf_dir), VAL_RATIO, SEED)


@query(
    f"""
    WITH {_UNITS}, {_RANKED}, q AS (SELECT *, k <= {_QUOTA} AS v FROM r), have AS (SELECT COALESCE(sum(n_rows) FILTER (v), 0) AS x FROM q),
         s AS (SELECT unit, sum(n_rows) OVER (ORDER BY n <= 3, h, unit ROWS UNBOUNDED PRECEDING) - n_rows AS before FROM q WHERE NOT v)
    SELECT q.unit, stratum, n_rows, CASE WHEN v OR (before IS NOT NULL AND before < 400 - x) THEN 'val' ELSE 'train' END AS split FROM q CROSS JOIN have LEFT JOIN s ON q.unit = s.unit
    """
)
def split_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_split(_units(spark, sf_dir), VAL_RATIO, SEED, min_val_rows=400)


@query(
    f"""
    WITH u AS (SELECT s_suppkey AS unit, s_nationkey AS stratum, md5(concat('{SEED}|', s_suppkey)) AS h FROM supplier),
         r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY h, unit) AS k FROM u)
    SELECT unit, stratum, CASE WHEN k <= CASE WHEN n > 1 THEN least(greatest(CAST(round_even(n * 0.8, 0) AS INTEGER), 1), n - 1) ELSE n END THEN 'train' ELSE 'val' END AS split FROM r
    """
)
def group_quota_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("unit"), c("s_nationkey").alias("stratum"))
    return sampling.group_split(units, 0.8, SEED)


@query(
    f"""
    WITH u AS (SELECT s_suppkey AS unit, s_nationkey AS stratum FROM supplier), r AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('{SEED}|', unit)), unit) AS k FROM u)
    SELECT stratum, count(*) AS n_units FROM r GROUP BY 1 HAVING count(*) FILTER (k > least(n, greatest(CAST(round_even(n * 0.9, 0) AS INTEGER), 1))) = 0
    """
)
def val_only_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("unit"), c("s_nationkey").alias("stratum"), F.lit(1).alias("n_rows"))
    return sampling.val_only_strata(sampling.stratified_split(units, 0.9, SEED, policy="always"))


@query("SELECT doc_id, CASE WHEN CAST(concat('0x', substr(md5(text), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.1 THEN 'val' ELSE 'train' END AS split FROM documents")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sampling.hash_split(F.md5("text"), 0.1).alias("split"))


@query(
    """
    WITH r AS (SELECT doc_id, lang AS group_key, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS pick_round FROM documents)
    SELECT doc_id, group_key, CAST(pick_round AS INTEGER) AS pick_round FROM r ORDER BY pick_round, group_key LIMIT 40
    """
)
def round_robin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), c("lang"), c("n_chars"), "doc_id", 40).select("doc_id", "group_key", "pick_round")


@query(
    """
    WITH t AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part), q AS (SELECT greatest(1, 60 // count(DISTINCT p_brand)) + 1 AS k FROM part),
         f AS (SELECT t.* FROM t, q WHERE r <= k ORDER BY p_brand, r LIMIT 60), g AS (SELECT * FROM t WHERE p_partkey NOT IN (SELECT p_partkey FROM f) ORDER BY p_retailprice DESC, r, p_partkey LIMIT 60)
    SELECT p_partkey, p_brand FROM (SELECT *, 0 AS p FROM f UNION ALL SELECT *, 1 FROM g) ORDER BY p, CASE WHEN p = 1 THEN -p_retailprice END, CASE WHEN p = 0 THEN p_brand END, r, p_partkey LIMIT 60
    """
)
def quota_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quota_then_fill(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey", 60).select("p_partkey", "p_brand")


@query(
    """
    WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents), p AS (SELECT lang FROM r ORDER BY k, lang LIMIT 40)
    SELECT lang, count(*) AS n_candidates, (SELECT count(*) FROM p WHERE p.lang = d.lang) AS n_selected FROM documents d GROUP BY lang
    """
)
def stratum_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return sampling.group_coverage(docs, sampling.round_robin(docs, c("lang"), c("n_chars"), "doc_id", 40), "lang")


@query(
    """
    WITH b AS (SELECT event_id, value, greatest(-1.0, COALESCE(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)) AS best_before FROM events)
    SELECT event_id, round(best_before, 6) AS best_before, value > best_before AS is_best FROM b
    """
)
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.running_best(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value")
    return rows.select("event_id", F.round("best_before", 6).alias("best_before"), "is_best")


@query(
    """
    SELECT doc_id, CAST(CASE WHEN d IN ('sparse', 'dense') THEN 1.0 ELSE 0.0 END + CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END + CASE WHEN lang = 'de' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
    FROM (SELECT doc_id, lang, CASE WHEN n_chars < 300 THEN 'sparse' WHEN n_chars < 3000 THEN 'medium' ELSE 'dense' END AS d FROM documents)
    """
)
def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    density = F.when(c("n_chars") < 300, "sparse").when(c("n_chars") < 3000, "medium").otherwise("dense")
    score = scalars.sample_score(density, F.when(c("lang") == "fr", "wide"), F.lit("clear"), F.lit("none"), F.when(c("lang") == "de", "porous"))
    return table(spark, sf_dir, "documents").select("doc_id", score.cast("double").alias("score"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")


@query("SELECT doc_id FROM documents WHERE CAST(concat('0x', substr(md5(concat('42|', doc_id)), 1, 12)) AS BIGINT) / 281474976710656.0 < 0.2")
def background_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling of background tiles: a fifth, by hash."""
    return sampling.keep_share(table(spark, sf_dir, "documents").select("doc_id"), c("doc_id"), 0.2)


@query("SELECT o_orderkey FROM orders WHERE COALESCE(TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER) <= 3, FALSE) AND o_orderkey % 10 > 6")
def filename_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise and contrast in a file name: the priority's number and the key's last digit."""
    stem = F.concat_ws("_", F.lit("img"), F.split("o_orderpriority", "-")[0], (c("o_orderkey") % 10).cast("string"))
    return table(spark, sf_dir, "orders").where(scalars.noise_contrast_kept(stem, 3, 6)).select("o_orderkey")
