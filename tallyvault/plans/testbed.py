"""An inventory derived from the driver's tables, and the same one as DuckDB common table expressions.

Documents stand for files of four scans (a fifth repeats the first), conversations for
archive results with turns as members, suppliers for disk images with their line items
as guest files.  Files are hashed where their size repeats in their scan or occurs in
another of the four.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyvault.inventory import Inventory

_CACHE: dict[tuple[str, str], Inventory] = {}
# fixed values: how documents become files
EXTENSIONS = ["txt", "md", "zip", "part1.rar", "qcow2", "img", "LOG"]
ROOTS = ["/data/a", "C:/Data/b", "//srv/share/c", "/data/a", "/data/a"]
FORMATS = ["qcow2", "vmdk", "raw", "vpc", "vdi"]
LANGS = ["de", "en", "es", "fr"]


def _pick(column: F.Column, values: list[str]) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (column + 1).cast("int"))


def _uuid(prefix: str, column: F.Column) -> F.Column:
    return F.concat(F.lit(f"{prefix}-0000-0000-0000-"), F.lpad(column.cast("string"), 12, "0"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.octet_length("text").cast("long").alias("size"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    k = F.expr("doc_id div 4")
    name = F.concat(F.lit("doc-"), k.cast("string"), F.lit("."), _pick(k % 7, EXTENSIONS))
    return docs.select(
        "doc_id", (F.col("doc_id") % 4 + 1).alias("scan_id"), (k + 1000).alias("entry_id"), (F.array_position(F.array(*map(F.lit, LANGS)), F.col("lang")) + 1).alias("parent_id"),
        F.concat("lang", F.lit("/"), name).alias("relative_path"), name.alias("filename"), F.lit("FILE").alias("kind"), "size",
        (1_700_000_000 + F.col("doc_id") * 7919 % 100_000).alias("modified_sec"), (F.col("doc_id") * 104_729 % 1_000_000_000).cast("int").alias("modified_nano"), "digest",
    )


def inventory(spark: SparkSession, sf_dir: str) -> Inventory:
    """The derived inventory, hashed once and kept for the session; texts are dropped before anything else."""
    cached = (spark.sparkContext.applicationId, sf_dir)
    if cached in _CACHE:
        return _CACHE[cached]
    files = _files(spark, sf_dir)
    in_scan = Window.partitionBy("size", "scan_id")
    across = Window.partitionBy("size")
    files = (
        files.withColumn("_n", F.count("*").over(in_scan)).withColumn("_least", F.min("scan_id").over(across)).withColumn("_most", F.max("scan_id").over(across))
        .withColumn("hashed", (F.col("_n") > 1) | (F.col("_least") < F.col("_most"))).drop("_n", "_least", "_most")
    )
    again = files.filter("scan_id = 1").withColumn("scan_id", F.lit(5).cast("long"))
    files = files.unionByName(again).persist()
    columns = ["scan_id", "entry_id", "parent_id", "relative_path", "filename", "kind", "size", "modified_sec", "modified_nano"]
    every = [(s, e, p, r, r, "DIRECTORY", 0, 0, 0) for s in range(1, 6) for e, p, r in [(1, 0, ""), *((i + 2, 1, x) for i, x in enumerate(LANGS))]]
    dirs = spark.createDataFrame(every, "scan_id long, entry_id long, parent_id long, relative_path string, filename string, kind string, size long, modified_sec long, modified_nano int")
    entries = files.select(*columns).unionByName(dirs)
    top = files.groupBy("scan_id").agg((F.max("entry_id") + 1).alias("next_entry_id"))
    names = spark.createDataFrame([(i, f"scan-{i}", ROOTS[i - 1]) for i in range(1, 6)], "scan_id long, name string, root string")
    when = F.timestamp_seconds(F.lit(1_700_000_000))
    scans = names.join(F.broadcast(top), "scan_id", "left").select(
        "scan_id", "name", "root", F.lit("COMPLETE").alias("phase"), F.lit("SHA-256").alias("algorithm"), F.lit(None).cast("long").alias("active_dir"),
        F.coalesce("next_entry_id", F.lit(6)).alias("next_entry_id"), when.alias("created_at"), when.alias("updated_at"),
    )
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select("doc_id")
    errors = files.join(toxic, "doc_id", "left_semi").select("scan_id", F.lit("HASHING").alias("phase"), "relative_path", F.lit("READ_ERROR").alias("message"), (1_700_000_000_000 + F.col("doc_id")).alias("recorded_at_ms"))
    tables = {
        "scans": scans, "entries": entries, "hashes": files.filter("hashed").select("scan_id", "entry_id", F.col("digest").alias("sha256")), "scan_errors": errors,
        "directories": dirs.select("scan_id", "entry_id", "parent_id", "relative_path", F.lit(True).alias("completed")),
        "signatures": files.filter("doc_id % 10 = 0").select("size", F.col("digest").alias("sha256")).distinct().select(
            F.concat(F.lit("sig-"), F.substring("sha256", 1, 12)).alias("id"), F.lit("SHA-256").alias("algorithm"), "size", "sha256", F.substring("sha256", 1, 2).alias("tag"), F.lit("").alias("memo"),
            when.alias("created_at"), when.alias("updated_at")),
    }
    _CACHE[cached] = Inventory(spark, tables | _archives(spark, sf_dir) | _images(spark, sf_dir))
    return _CACHE[cached]


def _archives(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    turns = turns.persist()
    ids = turns.select("conv_id").distinct()
    state = F.when(F.col("conv_id") % 7 == 3, "PARTIAL").when(F.col("conv_id") % 11 == 5, "SKIPPED").otherwise("COMPLETE")
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") % 5)
    results = ids.select(
        _uuid("00000001", F.col("conv_id")).alias("result_id"), F.lit(1).cast("long").alias("scan_id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source_label"),
        F.concat(F.lit("print-"), (F.col("conv_id") % 20).cast("string")).alias("fingerprint"), F.lit("policy-1").alias("policy"), F.lit("provider-1").alias("provider"), state.alias("state"),
        (state == "PARTIAL").alias("retryable"), (state == "COMPLETE").alias("reusable"), (65 - F.length(F.bin(F.col("conv_id") + 1))).cast("int").alias("height"),
        F.lit(None).cast("string").alias("summary_json"), when.alias("started_at"), when.alias("completed_at"),
    )
    bad = (F.col("conv_id") + F.col("turn")) % 13 == 0
    members = turns.filter(state != "SKIPPED").select(
        _uuid("00000001", F.col("conv_id")).alias("result_id"), (F.col("turn") + 1).alias("ordinal"), F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".txt")).alias("relative_path"),
        F.concat(F.lit("turn-"), F.col("turn").cast("string"), F.lit(".txt")).alias("filename"), F.lit("FILE").alias("kind"), F.col("bytes").alias("declared_size"), F.col("bytes").alias("actual_size"),
        F.lit(None).cast("long").alias("modified_sec"), F.lit(None).cast("int").alias("modified_nano"), F.when(~bad, F.col("digest")).alias("sha256"),
        F.when(bad, F.col("digest")).alias("recovered_sha256"), F.when(bad, "DAMAGED").otherwise("READ_OK").alias("integrity"), F.lit(False).alias("encrypted"),
        F.lit(None).cast("string").alias("raw_path_base64"), F.lit(None).cast("string").alias("diagnostic"), F.lit(None).cast("string").alias("group_key"),
        F.lit(None).cast("string").alias("flavor"), F.lit(None).cast("int").alias("volume_slot"),
    )
    child = F.explode(F.array(2 * F.col("conv_id") + 1, 2 * F.col("conv_id") + 2, 2 * F.col("conv_id") + 3))
    edges = ids.select("conv_id", child.alias("child")).join(ids.select(F.col("conv_id").alias("child")), "child", "left_semi")
    nested = edges.select(
        _uuid("00000001", F.col("conv_id")).alias("parent_result_id"), F.concat(F.lit("single:to-"), F.col("child").cast("string")).alias("group_key"), F.lit(1).cast("long").alias("source_ordinal"),
        _uuid("00000001", F.col("child")).alias("child_result_id"), (F.col("child") % 2 == 1).alias("duplicate"),
    )
    pending = F.col("conv_id") % 48 == 21
    jobs = ids.filter("conv_id % 16 = 5").select(
        F.lit(1).cast("long").alias("scan_id"), F.concat(F.lit("single:conv-"), F.col("conv_id").cast("string")).alias("group_key"), (F.col("conv_id") + 1000).alias("first_entry"), F.lit("single").alias("flavor"),
        F.when(pending, "PENDING").otherwise(state).alias("status"), F.when(~pending, _uuid("00000001", F.col("conv_id"))).alias("result_id"), ((F.col("conv_id") % 32 == 5) & ~pending).alias("duplicate"),
        (state == "PARTIAL").alias("retryable"), F.when(pending, F.concat(F.lit("unreadable "), F.col("conv_id").cast("string"))).alias("diagnostic"),
    )
    errors = ids.filter(state == "PARTIAL").select(
        _uuid("00000001", F.col("conv_id")).alias("result_id"), F.lit(1).cast("long").alias("ordinal"), _pick(F.col("conv_id") % 3, ["CONTENT", "OPERATIONAL", "LIMIT"]).alias("category"),
        F.lit("READ").alias("code"), F.concat(F.lit("error "), F.col("conv_id").cast("string")).alias("message"),
    )
    runs = spark.createDataFrame([(1, "COMPLETE_WITH_ERRORS")], "scan_id long, phase string")
    return {"archive_results": results, "archive_members": members, "archive_nested": nested, "archive_jobs": jobs, "archive_errors": errors, "archive_runs": runs}


def _images(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("k"), "s_name", F.col("s_nationkey").cast("long").alias("nation"))
    m = F.col("k") % 9
    state = F.when(m == 4, "PARTIAL").when(m == 5, "PENDING").when(m == 6, "COMPONENT").otherwise("COMPLETE")
    done = ~m.isin(5, 6)
    rid = _uuid("00000002", F.col("k"))
    jobs = s.select(
        (F.col("k") % 4 + 1).alias("scan_id"), F.col("k").alias("source_id"), F.concat(F.lit("img/"), "s_name").alias("relative_path"), _pick(F.col("k") % 5, FORMATS).alias("format"),
        (F.col("k") % 7 * 1000).alias("size"), F.col("k").alias("modified_sec"), F.lit(0).cast("long").alias("modified_nano"), state.alias("state"), F.when(done, rid).alias("result_id"),
        ((F.col("k") % 10 == 0) & done).alias("duplicate"), (m == 4).alias("retryable"), F.when(m == 6, F.col("k") - 4).alias("component_of"), F.when((m == 4) & (F.col("k") % 2 == 0), "failed").alias("diagnostic"),
    )
    when = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k") % 5)
    results = s.filter(done).select(
        rid.alias("result_id"), (F.col("k") % 4 + 1).alias("scan_id"), F.col("k").alias("source_id"), state.alias("state"), F.concat(F.lit("print-"), (F.col("k") % 20).cast("string")).alias("fingerprint"),
        F.lit(None).cast("string").alias("signature"), F.lit("provider-1").alias("provider"), F.lit("policy-1").alias("policy"), (F.col("k") * 4096).alias("virtual_size"), (state == "COMPLETE").alias("reusable"),
        (state == "PARTIAL").alias("retryable"), F.lit(None).cast("string").alias("summary_json"), when.alias("started_at"), when.alias("completed_at"),
    )
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").cast("long").alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    path = F.concat(F.lit("orders/"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    read = F.col("l_returnflag") != "R"
    entries = lines.join(F.broadcast(s.filter(done)), "k").select(
        rid.alias("result_id"), (F.col("nation") + 1).alias("filesystem_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry_id"), path.alias("relative_path"), path.alias("filename"), F.lit("FILE").alias("kind"),
        F.col("q").alias("size"), F.when(read, F.col("q")).alias("actual_size"), F.lit(None).cast("long").alias("modified_sec"), F.lit(None).cast("long").alias("modified_nano"),
        F.when(read, F.sha2(path.cast("binary"), 256)).alias("sha256"), F.when(read, "READ_OK").otherwise("UNREADABLE").alias("integrity"),
    )
    systems = s.filter(done).select(rid.alias("result_id"), (F.col("nation") + 1).alias("filesystem_id"), F.lit("/dev/sda1").alias("device"), F.lit("ext4").alias("type"), F.lit(None).cast("string").alias("uuid"), F.lit(None).cast("string").alias("label"), (F.col("k") * 4096).alias("size_bytes"), F.lit("COMPLETE").alias("state"))
    errors = s.filter(m == 4).select(rid.alias("result_id"), (F.col("nation") + 1).alias("filesystem_id"), F.lit(None).cast("long").alias("entry_id"), F.lit("FILESYSTEM").alias("category"), F.lit("MOUNT").alias("code"), F.col("s_name").alias("message"))
    parts = s.filter(done)
    root = parts.select(rid.alias("result_id"), F.lit(0).cast("long").alias("ordinal"), F.lit(-1).cast("long").alias("parent_ordinal"), F.lit("PRIMARY").alias("role"), "k")
    backing = parts.filter("k % 3 = 0").select(rid.alias("result_id"), F.lit(1).cast("long").alias("ordinal"), F.lit(0).cast("long").alias("parent_ordinal"), F.lit("BACKING").alias("role"), "k")
    extent = parts.filter("k % 6 = 0").select(rid.alias("result_id"), F.lit(2).cast("long").alias("ordinal"), F.lit(1).cast("long").alias("parent_ordinal"), F.lit("EXTENT").alias("role"), "k")
    components = root.unionByName(backing).unionByName(extent).select(
        "result_id", "ordinal", "parent_ordinal", "role", _pick(F.col("k") % 5, FORMATS).alias("format"), F.col("k").alias("source_id"), F.concat(F.lit("img/"), F.col("k").cast("string")).alias("relative_path"), (F.col("k") % 7 * 1000).alias("size"),
        F.col("k").alias("modified_sec"), F.lit(0).cast("long").alias("modified_nano"), F.lit(None).cast("string").alias("sha256"),
    )
    runs = spark.createDataFrame([(i, "COMPLETE") for i in range(1, 4)], "scan_id long, phase string")
    return {"image_jobs": jobs, "image_results": results, "image_entries": entries, "image_filesystems": systems, "image_errors": errors, "image_components": components, "image_runs": runs}


def _values(column: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({column} + 1)::BIGINT)"


#: The same tables for DuckDB; a query's own text follows.
SQL = f"""WITH RECURSIVE placed AS (
  SELECT doc_id, doc_id % 4 + 1 AS scan_id, doc_id // 4 + 1000 AS entry_id, coalesce(list_position({LANGS}, lang), 0)::BIGINT + 1 AS parent_id, lang,
    'doc-' || (doc_id // 4)::VARCHAR || '.' || {_values("(doc_id // 4) % 7", EXTENSIONS)} AS filename, 'FILE' AS kind, strlen(text)::BIGINT AS size,
    1700000000 + doc_id * 7919 % 100000 AS modified_sec, (doc_id * 104729 % 1000000000)::INTEGER AS modified_nano, sha256(text) AS digest FROM documents),
four AS (SELECT * EXCLUDE (lang), lang || '/' || filename AS relative_path, count(*) OVER (PARTITION BY size, scan_id) > 1
    OR min(scan_id) OVER (PARTITION BY size) < max(scan_id) OVER (PARTITION BY size) AS hashed FROM placed),
files AS (SELECT * FROM four UNION ALL SELECT * REPLACE (5 AS scan_id) FROM four WHERE scan_id = 1),
dirs AS (SELECT s::BIGINT AS scan_id, d.* FROM range(1, 6) r(s), (VALUES (1::BIGINT, 0::BIGINT, ''), (2, 1, 'de'), (3, 1, 'en'), (4, 1, 'es'), (5, 1, 'fr')) d(entry_id, parent_id, relative_path)),
entries AS (SELECT scan_id, entry_id, parent_id, relative_path, filename, kind, size, modified_sec, modified_nano FROM files
    UNION ALL SELECT scan_id, entry_id, parent_id, relative_path, relative_path, 'DIRECTORY', 0, 0, 0 FROM dirs),
hashes AS (SELECT scan_id, entry_id, digest AS sha256 FROM files WHERE hashed),
scans AS (SELECT v.*, 'COMPLETE' AS phase FROM (VALUES (1::BIGINT, 'scan-1', '/data/a'), (2, 'scan-2', 'C:/Data/b'), (3, 'scan-3', '//srv/share/c'), (4, 'scan-4', '/data/a'), (5, 'scan-5', '/data/a')) v(scan_id, name, root)),
scan_errors AS (SELECT scan_id, 'HASHING' AS phase, relative_path, 'READ_ERROR' AS message, 1700000000000 + doc_id AS recorded_at_ms FROM files
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
signatures AS (SELECT DISTINCT 'sig-' || substr(digest, 1, 12) AS id, size, digest AS sha256, substr(digest, 1, 2) AS tag FROM files WHERE doc_id % 10 = 0),
convs AS (SELECT DISTINCT conv_id AS c, CASE WHEN conv_id % 7 = 3 THEN 'PARTIAL' WHEN conv_id % 11 = 5 THEN 'SKIPPED' ELSE 'COMPLETE' END AS state FROM conversations),
archive_results AS (SELECT '00000001-0000-0000-0000-' || lpad(c::VARCHAR, 12, '0') AS result_id, 'print-' || (c % 20)::VARCHAR AS fingerprint, 'policy-1' AS policy, 'provider-1' AS provider, state,
    state = 'PARTIAL' AS retryable, state = 'COMPLETE' AS reusable, (65 - length(bin(c + 1)))::INTEGER AS height, 1700000000 + c % 5 AS completed FROM convs),
archive_members AS (SELECT '00000001-0000-0000-0000-' || lpad(conv_id::VARCHAR, 12, '0') AS result_id, turn + 1 AS ordinal, 'turn-' || turn::VARCHAR || '.txt' AS relative_path, strlen(text)::BIGINT AS actual_size,
    CASE WHEN (conv_id + turn) % 13 <> 0 THEN sha256(text) END AS sha256, CASE WHEN (conv_id + turn) % 13 = 0 THEN 'DAMAGED' ELSE 'READ_OK' END AS integrity FROM conversations JOIN convs ON c = conv_id WHERE state <> 'SKIPPED'),
archive_nested AS (SELECT '00000001-0000-0000-0000-' || lpad(a.c::VARCHAR, 12, '0') AS parent_result_id, 'single:to-' || b.c::VARCHAR AS group_key, '00000001-0000-0000-0000-' || lpad(b.c::VARCHAR, 12, '0') AS child_result_id, b.c % 2 = 1 AS duplicate
    FROM convs a JOIN convs b ON b.c IN (2 * a.c + 1, 2 * a.c + 2, 2 * a.c + 3)),
archive_jobs AS (SELECT 1::BIGINT AS scan_id, 'single:conv-' || c::VARCHAR AS group_key, CASE WHEN c % 48 = 21 THEN 'PENDING' ELSE state END AS status,
    CASE WHEN c % 48 <> 21 THEN '00000001-0000-0000-0000-' || lpad(c::VARCHAR, 12, '0') END AS result_id, c % 32 = 5 AND c % 48 <> 21 AS duplicate, state = 'PARTIAL' AS retryable,
    CASE WHEN c % 48 = 21 THEN 'unreadable ' || c::VARCHAR END AS diagnostic FROM convs WHERE c % 16 = 5),
archive_errors AS (SELECT '00000001-0000-0000-0000-' || lpad(c::VARCHAR, 12, '0') AS result_id, 1::BIGINT AS ordinal, {_values("c % 3", ["CONTENT", "OPERATIONAL", "LIMIT"])} AS category, 'READ' AS code, 'error ' || c::VARCHAR AS message FROM convs WHERE state = 'PARTIAL'),
reachable AS (SELECT result_id FROM archive_jobs WHERE result_id IS NOT NULL UNION SELECT child_result_id FROM archive_nested JOIN reachable ON parent_result_id = result_id),
disks AS (SELECT s_suppkey AS k, s_name, s_nationkey::BIGINT AS nation, s_suppkey % 9 AS m FROM supplier),
image_jobs AS (SELECT (k % 4 + 1)::BIGINT AS scan_id, k::BIGINT AS source_id, 'img/' || s_name AS relative_path, {_values("k % 5", FORMATS)} AS format, (k % 7 * 1000)::BIGINT AS size,
    CASE m WHEN 4 THEN 'PARTIAL' WHEN 5 THEN 'PENDING' WHEN 6 THEN 'COMPONENT' ELSE 'COMPLETE' END AS state, CASE WHEN m NOT IN (5, 6) THEN '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') END AS result_id,
    k % 10 = 0 AND m NOT IN (5, 6) AS duplicate, CASE WHEN m = 4 AND k % 2 = 0 THEN 'failed' END AS diagnostic FROM disks),
image_results AS (SELECT '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') AS result_id, CASE m WHEN 4 THEN 'PARTIAL' ELSE 'COMPLETE' END AS state, 'print-' || (k % 20)::VARCHAR AS fingerprint,
    (k * 4096)::BIGINT AS virtual_size, 'provider-1' AS provider, 'policy-1' AS policy, m <> 4 AS reusable, m = 4 AS retryable, 1700000000 + k % 5 AS completed FROM disks WHERE m NOT IN (5, 6)),
image_entries AS (SELECT '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') AS result_id, nation + 1 AS filesystem_id, l_orderkey * 8 + l_linenumber AS entry_id, l_quantity::BIGINT AS size,
    CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END AS actual_size, CASE WHEN l_returnflag <> 'R' THEN sha256('orders/' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR) END AS sha256
    FROM lineitem JOIN disks ON l_suppkey = k WHERE m NOT IN (5, 6)),
image_errors AS (SELECT '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') AS result_id, nation + 1 AS filesystem_id, NULL::BIGINT AS entry_id, 'FILESYSTEM' AS category, 'MOUNT' AS code, s_name AS message FROM disks WHERE m = 4),
image_components AS (SELECT '00000002-0000-0000-0000-' || lpad(k::VARCHAR, 12, '0') AS result_id, o::BIGINT AS ordinal, (o - 1)::BIGINT AS parent_ordinal, {_values("o", ["PRIMARY", "BACKING", "EXTENT"])} AS role
    FROM disks, range(0, 3) r(o) WHERE m NOT IN (5, 6) AND (o = 0 OR (o = 1 AND k % 3 = 0) OR (o = 2 AND k % 6 = 0)))
"""
