"""Inventory, incremental loads, error log and streaming pickup (IN-*, EL-*, ST-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidycell import schemas
from tidycell.operators import errors as E
from tidycell.operators import inventory as I
from tidycell.plans import ingest as P
from tidycell.session import scratch
from tidycell.sources import files, tables
from tidycell.streaming import landing
from workloads import views as V
from workloads.registry import query, view


@query("in01_register", """
SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS dataset_name, 'generic' AS domain, '' AS organization, TRUE AS no_survey_date,
       CAST(c_nationkey AS BIGINT) AS total_records, 'pending' AS ingestion_status, 'generic_data' AS table_name, TRUE AS no_error
FROM customer WHERE c_mktsegment <> 'FURNITURE'""")
def in01(spark, sf):
    offered = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("dataset_id"), F.when(F.col("c_mktsegment") != "FURNITURE", F.col("c_name")).alias("dataset_name"),
        F.lit("generic").alias("domain"), F.lit("pending").alias("ingestion_status"), F.lit(V.STAMP).alias("ingestion_timestamp"),
        F.lit("generic_data").alias("table_name"), F.col("c_nationkey").alias("total_records"))
    rows = I.register(offered, V.STAMP)
    return rows.select("dataset_id", "dataset_name", "domain", "organization", F.col("survey_date").isNull().alias("no_survey_date"), "total_records",
                       "ingestion_status", "table_name", F.col("error_message").isNull().alias("no_error"))


@query("in02_status_log", """
SELECT dataset_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ts DESC, event_id DESC) AS rn FROM status_log WHERE status <> 'pending') WHERE rn = 1""")
def in02(spark, sf):
    path = scratch(spark, "in02")
    log = V.status_log(spark, sf)
    # Two appends, one of them with states that are not accepted.
    unknown = log.filter("status = 'pending'").withColumn("status", F.lit("waiting"))
    for part in (log.filter("status <> 'pending'"), unknown):
        I.status_events(part).write.mode("append").parquet(path)
    return I.latest(spark.read.parquet(path), "dataset_id", [F.desc("ts"), F.desc("event_id")]).select("dataset_id", "status", "event_id")


@query("in02_refused_events", "SELECT dataset_id, 'unknown status waiting' AS reason, count(*) AS n FROM status_log WHERE status = 'pending' GROUP BY dataset_id")
def in02_refused(spark, sf):
    log = V.status_log(spark, sf)
    events = log.withColumn("status", F.when(F.col("status") == "pending", "waiting").otherwise(F.col("status")))
    return I.refused_events(events).groupBy("dataset_id", "reason").agg(F.count("*").alias("n"))


@query("in03_list_datasets", "SELECT id, name, priority FROM inventory WHERE status = 'pending' AND domain = 'construction'")
def in03(spark, sf):
    return I.listed(V.inventory(spark, sf), "pending", "construction").select("id", "name", "priority")


@query("in04_table_mapping", "SELECT id AS dataset_id, domain || '_data' AS table_name FROM inventory")
def in04(spark, sf):
    inv = V.inventory(spark, sf).select(F.col("id").alias("dataset_id"), F.concat("domain", F.lit("_data")).alias("table_name"))
    return I.table_mapping(inv)


@query("in05_next_dataset", "SELECT id, priority FROM inventory WHERE status = 'pending' ORDER BY priority DESC, added_pos LIMIT 1")
def in05(spark, sf):
    return I.next_batch(V.inventory(spark, sf)).select("id", "priority")


@query("in06_batch_selection", "SELECT id, domain, priority FROM inventory WHERE status = 'pending' AND priority >= 7 ORDER BY priority DESC, added_pos LIMIT 25")
def in06(spark, sf):
    return I.next_batch(V.inventory(spark, sf), 25, 7).select("id", "domain", "priority")


view("offered", """
SELECT CAST(o_custkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'order ' || o_orderkey END AS name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'trade' WHEN '2-HIGH' THEN 'health' ELSE 'weather' END AS domain, CAST(o_orderkey % 14 AS INTEGER) AS priority, o_orderkey AS added_pos FROM orders""")


@query("in07_additions", """
SELECT id, CASE WHEN name = '' THEN 'Dataset ' || id ELSE name END AS name, CASE WHEN domain IN ('trade', 'health') THEN domain ELSE 'generic' END AS domain,
       CASE WHEN priority BETWEEN 1 AND 10 THEN priority ELSE 5 END AS priority, 'pending' AS status, added_pos FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY added_pos) AS rn FROM offered WHERE id NOT IN (SELECT id FROM inventory WHERE status = 'completed')) WHERE rn = 1""")
def in07(spark, sf):
    o = V.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("order "), "o_orderkey")).alias("name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "trade").when(F.col("o_orderpriority") == "2-HIGH", "health").otherwise("weather").alias("domain"),
        (F.col("o_orderkey") % 14).cast("int").alias("priority"), F.col("o_orderkey").alias("added_pos"))
    known = I.listed(V.inventory(spark, sf), "completed")
    return I.additions(o, known).select("id", "name", "domain", "priority", "status", "added_pos")


@query("in08_remove", "SELECT id, status FROM inventory WHERE status <> 'failed'")
def in08(spark, sf):
    inv = V.inventory(spark, sf)
    return I.without(inv, I.listed(inv, "failed")).select("id", "status")


@query("in09_counts", "SELECT 'status' AS dimension, status AS label, count(*) AS datasets FROM inventory GROUP BY ALL UNION ALL SELECT 'domain', domain, count(*) FROM inventory GROUP BY ALL")
def in09(spark, sf):
    return I.counts(V.inventory(spark, sf))


@query("in09_summary", """
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing,
       count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM inventory""")
def in09_summary(spark, sf):
    return I.summary(V.inventory(spark, sf))


@query("in10_load_log", "SELECT event_id, dataset_id, k AS record_count, k / NULLIF(value, 0) AS records_per_second FROM status_log")
def in10(spark, sf):
    log = V.status_log(spark, sf).withColumnsRenamed({"k": "record_count", "value": "duration_seconds"})
    return I.throughput(log).select("event_id", "dataset_id", "record_count", "records_per_second")


@query("in10_storage_bytes", "SELECT stats_data_id, count(*) AS record_count, TRUE AS has_bytes FROM economy GROUP BY 1")
def in10_bytes(spark, sf):
    path = scratch(spark, "in10")
    V.economy(spark, sf).write.partitionBy("stats_data_id").parquet(path)
    inv = files.file_inventory(spark.read.parquet(path))
    dataset = F.regexp_extract("file_path", "stats_data_id=([^/]*)/", 1)
    return inv.groupBy(dataset.alias("stats_data_id")).agg(F.sum("record_count").alias("record_count"), (F.sum("file_size") > 0).alias("has_bytes"))


@query("in11_changes", """
SELECT o_orderkey, value, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'changed' END AS change FROM (
  SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice + 1 ELSE o_totalprice END AS value, o_totalprice AS before FROM orders)
WHERE o_orderstatus = 'P' OR value <> before""")
def in11(spark, sf):
    o = V.table(spark, sf, "orders")
    old = o.filter("o_orderstatus <> 'P'").select("o_orderkey", F.col("o_totalprice").alias("value"))
    new = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("value"))
    return I.changes(new, old, ["o_orderkey"]).select("o_orderkey", "value", "change")


_ING = ", ".join(c for c in schemas.column_names("generic") if c != "updated_at")


@query("in12_end_to_end", f"""
SELECT {_ING}, 'table' AS place FROM (SELECT 'I1' AS dataset_id, * EXCLUDE (dataset_id, seq) FROM sales WHERE value IS NOT NULL)
UNION ALL SELECT {_ING.replace('dataset_id', "'I1' AS dataset_id", 1)}, 'quarantine' FROM sales WHERE value IS NULL""")
def in12(spark, sf):
    root = scratch(spark, "in12")
    for _ in range(2):  # the second ingest of the same cells changes nothing
        report = P.ingest(spark, V.cells_orders(spark, sf), "generic", "I1", root, updated_at=V.STAMP)
    cols = [c for c in schemas.column_names("generic") if c != "updated_at"]
    good = tables.read_domain(spark, report.table_path, "generic").select(*cols, F.lit("table").alias("place"))
    bad = spark.read.parquet(report.quarantine_path).select(*cols, F.lit("quarantine").alias("place"))
    return good.unionByName(bad)


@query("in12_step_report", """
SELECT 'I2' AS dataset_id, 'generic' AS domain, count(*) AS rows, count(value) AS loaded, 0::BIGINT AS revised, 0::BIGINT AS present, 0::BIGINT AS copies,
       count(*) - count(value) AS quarantined, count(*) = count(value) AS valid FROM sales""")
def in12_report(spark, sf):
    report = P.ingest(spark, V.cells_orders(spark, sf), "generic", "I2", scratch(spark, "in12r"), updated_at=V.STAMP)
    return report.as_row(spark)


@query("in10_written_bytes", "SELECT 'I3' AS dataset_id, count(value) AS record_count, TRUE AS has_bytes, TRUE AS rerun_writes_none FROM sales")
def in10_written(spark, sf):
    root, log = scratch(spark, "in10w"), scratch(spark, "in10w-log")
    for _ in range(2):  # the second ingest finds all its cells there
        report = P.ingest(spark, V.cells_orders(spark, sf), "generic", "I3", root, updated_at=V.STAMP)
        P.log_load(spark, report, log, V.STAMP)
    kept = files.file_inventory(tables.read_domain(spark, report.table_path, "generic")).agg(F.sum("file_size").alias("n")).scalar()
    logged = spark.read.schema(P.LOAD_LOG).parquet(log)
    return logged.groupBy("dataset_id").agg(
        F.sum("record_count").alias("record_count"), (F.max("storage_bytes") == kept).alias("has_bytes"), (F.min("storage_bytes") == 0).alias("rerun_writes_none"))


@query("in06_batch_ingest", "SELECT c_mktsegment AS dataset_id, 'completed' AS status, count(*) AS loaded FROM customer GROUP BY c_mktsegment")
def in06_ingest(spark, sf):
    """An inventory with a dataset per segment, which together hold all customer cells, ingested whole, and what the load log says of them."""
    root, cells = scratch(spark, "in06"), V.cells_customer(spark, sf)
    datasets = V.inventory(spark, sf).groupBy(F.col("c_mktsegment").alias("id")).agg(F.min("added_pos").alias("added_pos"), F.max("priority").alias("priority")).withColumns(
        {"domain": F.lit("generic"), "status": F.lit("pending")})
    outcome = P.ingest_batch(
        spark, datasets, lambda dataset: cells.filter(F.col("`@cat01`") == dataset), root, n=datasets.count(), updated_at=V.STAMP)
    log = spark.read.schema(P.LOAD_LOG).parquet(f"{root}/logs/loads")
    return outcome.join(log.select("dataset_id", F.col("record_count").alias("loaded")), "dataset_id", "left").select("dataset_id", "status", "loaded")


@query("in12_rejected_documents", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'status 100: quota' WHEN '2-HIGH' THEN 'damaged rows' ELSE 'unreadable' END AS reason
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def in12_rejected(spark, sf):
    """Documents of an ingest that report an error, break off within their rows, or are no JSON."""
    cell = F.to_json(F.array(F.struct(F.col("o_orderkey").cast("string").alias("@cat01"), F.lit("2020").alias("@time"), F.col("o_totalprice").cast("string").alias("$"))))
    value = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit('{"GET_STATS_DATA": {"RESULT": {"STATUS": 100, "ERROR_MSG": "quota"}}}'))
             .when(F.col("o_orderpriority") == "2-HIGH", F.expr("substring(c, 1, length(c) - 4)")).when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("<html>")).otherwise(F.col("c")))
    docs = V.table(spark, sf, "orders").withColumn("c", cell).select("o_orderkey", value.alias("value"))
    root = scratch(spark, "in12d")
    P.ingest_documents(spark, docs, "generic", "I4", root, updated_at=V.STAMP)
    return spark.read.parquet(f"{root}/rejected/generic").select("o_orderkey", "reason")


@query("in13_missing_chunks", """
SELECT o_orderkey // 20 AS chunk_num FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') = 0""")
def in13(spark, sf):
    o = V.table(spark, sf, "orders").withColumn("chunk_num", F.floor(F.col("o_orderkey") / 20).cast("bigint"))
    landed = o.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("chunk_num").distinct()
    return I.missing_chunks(o.select("chunk_num").distinct(), landed, ["chunk_num"])


@query("in14_early_stop", """
SELECT dataset_id, year, records, fetched_before FROM (
  SELECT stats_data_id AS dataset_id, year, n AS records, CAST(COALESCE(sum(n) OVER (PARTITION BY stats_data_id ORDER BY year DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS fetched_before,
         CAST(sum(n) OVER (PARTITION BY stats_data_id) AS BIGINT) AS expected FROM (SELECT stats_data_id, year, count(*) AS n FROM sales GROUP BY ALL))
WHERE fetched_before < expected * 0.6""")
def in14(spark, sf):
    s = V.sales(spark, sf).withColumn("dataset_id", F.col("stats_data_id"))
    periods = s.groupBy("dataset_id", "year").agg(F.count(F.lit(1)).alias("records"))
    expected = periods.groupBy("dataset_id").agg(F.sum("records").alias("expected"))
    return I.early_stop(periods, expected, 0.6).select("dataset_id", "year", "records", "fetched_before")


# --- error log -----------------------------------------------------------------------------

_MESSAGES = (
    "Request TIMEOUT after 30 s", "Connection refused by host", "API quota exceeded", "invalid JSON at line 3", "validation failed for year",
    "S3 put failed", "disk is full", "bucket not found while connection reset", "no such table", "value parse failure",
)
_MESSAGE = "CASE k % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"
_CLASS = "CASE event_type WHEN 'error' THEN 'ReadTimeoutError' WHEN 'click' THEN 'ApiException' WHEN 'view' THEN 'ValidationError' ELSE 'ValueError' END"
view("error_log", f"""
SELECT *, CASE WHEN contains(m, 'timeout') OR contains(c, 'timeout') THEN 'timeout_error' WHEN regexp_matches(m, 'connection|network|unreachable') THEN 'network_error'
  WHEN contains(m, 'api') OR contains(c, 'api') THEN 'api_error' WHEN regexp_matches(m, 'json|parse|format|invalid') THEN 'data_error'
  WHEN contains(m, 'validation') OR contains(c, 'validation') THEN 'validation_error' WHEN regexp_matches(m, 's3|storage|bucket') THEN 'storage_error' ELSE 'unknown_error' END AS error_type
FROM (SELECT event_id, ts, dataset_id, lower({_MESSAGE} || ' [' || event_id || ']') AS m, lower({_CLASS}) AS c FROM status_log)""")


def _errors(spark, sf):
    message = F.concat(F.expr(_MESSAGE), F.lit(" ["), F.col("event_id"), F.lit("]"))
    return V.status_log(spark, sf).withColumn("error_type", E.error_type(message, F.expr(_CLASS)))


@query("el01_error_type", "SELECT event_id, error_type FROM error_log")
def el01(spark, sf):
    return _errors(spark, sf).select("event_id", "error_type")


@query("el02_retryable", "SELECT event_id, error_type IN ('api_error', 'network_error', 'timeout_error', 'storage_error') AS retryable FROM error_log")
def el02(spark, sf):
    return _errors(spark, sf).select("event_id", E.is_retryable(F.col("error_type")).alias("retryable"))


@query("el03_errors_by_type", "SELECT error_type, count(*) AS errors, max(ts) AS last_seen FROM error_log GROUP BY 1")
def el03(spark, sf):
    return E.by_type(_errors(spark, sf))


@query("el03_recent_errors", "SELECT event_id, ts, error_type FROM error_log ORDER BY ts DESC, event_id DESC LIMIT 10")
def el03_recent(spark, sf):
    return E.recent(_errors(spark, sf)).select("event_id", "ts", "error_type")


# --- streaming -----------------------------------------------------------------------------

_ONCE = f"""
SELECT {_ING} FROM (SELECT 'ST' AS dataset_id, 'CUS' AS stats_data_id, year, region_code, category, value, unit FROM population)"""


def _land(spark, df, path, name):
    """Customer cells as landed JSON lists, one per line."""
    cell = F.struct(*(F.col(f"`{c}`") for c in ("@id", "@tab", "@cat01", "@area", "@time", "@unit", "$")))
    df.select(F.to_json(F.array(cell)).alias("value")).write.text(f"{path}/{name}")


def _pickup(spark, landed, work):
    stream = landing.documents(spark, landed, whole=False)
    landing.run(stream, f"{work}/checkpoint", "generic", "ST", f"{work}/table", f"{work}/bad", V.STAMP).awaitTermination()
    return V.bare(tables.read_domain(spark, f"{work}/table", "generic"))


@query("st01_continuous_pickup", _ONCE)
def st01(spark, sf):
    work = scratch(spark, "st01")
    landed, cells = f"{work}/landed", V.cells_customer(spark, sf)
    _land(spark, cells.filter("`@cat01` = 'BUILDING'"), landed, "chunk_0")
    _pickup(spark, landed, work)
    _land(spark, cells.filter("`@cat01` <> 'BUILDING'"), landed, "chunk_1")  # arrives later
    return _pickup(spark, landed, work)


@query("st02_repeated_files", _ONCE)
def st02(spark, sf):
    work = scratch(spark, "st02")
    landed, cells = f"{work}/landed", V.cells_customer(spark, sf)
    for segment in ("BUILDING", "MACHINERY"):
        _land(spark, cells.filter(F.col("`@cat01`") == segment), landed, f"chunk_{segment}")
    _pickup(spark, landed, work)
    _land(spark, cells, landed, "complete")  # the combined file repeats the chunks
    _land(spark, cells.filter("`@cat01` = 'BUILDING'"), landed, "chunk_again")
    return _pickup(spark, landed, work)
