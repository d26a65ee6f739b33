"""The six telemetry views over the driver's tables, in SQL that Spark and DuckDB both read.

A view's text names base tables as {orders}; Spark reads them as Parquet files, DuckDB as its registered views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "jobs_v": """
SELECT o_orderkey AS job_id,
  concat(c_mktsegment, '/', n_name, '/c', CAST(o_custkey AS STRING)) AS signature,
  c_mktsegment AS project,
  CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
       WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN substr(o_orderpriority,1,1) IN ('1','2') THEN 'high'
       WHEN substr(o_orderpriority,1,1) = '5' THEN 'low' ELSE 'normal' END AS priority,
  n_name AS node, o_orderkey % 2 AS gpu_idx, CAST(o_orderdate AS TIMESTAMP) AS submitted_at,
  600 + (o_orderkey * 7919) % 90000 AS dur_s,
  CAST(floor(o_totalprice / 50) AS BIGINT) AS peak_vram_mb,
  CAST(floor(o_totalprice / 20) AS BIGINT) AS peak_ram_mb,
  1 + o_orderkey % 16 AS cpu_cores,
  concat('/ckpt/', CAST(o_custkey % 400 AS STRING)) AS ckpt_dir,
  concat('python train.py --seed ', CAST(o_orderkey % 5 AS STRING), ' --max_iters ', CAST(100 + (o_custkey % 10) * 100 AS STRING)) AS cmd,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - 1 END AS parent_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey""",
    "samples_v": """
SELECT l_orderkey AS job_id, n_name AS node, l_linenumber % 2 AS gpu_idx, CAST(l_shipdate AS TIMESTAMP) AS ts,
  CAST(floor(l_quantity * 200) AS BIGINT) AS vram_mb,
  CAST(floor(l_extendedprice / 10) AS BIGINT) AS ram_mb, CAST(floor(l_discount * 1000) AS BIGINT) AS pcpu
FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "gpus_v": """
SELECT n_name AS node, g.idx AS gpu_idx, 8 + (n_nationkey % 5) * 8 AS total_cpu, n_nationkey % 9 AS free_cpu,
  65536 AS total_ram_mb, (n_nationkey * 5003) % 65536 AS free_ram_mb, 12000 AS total_mb,
  (n_nationkey * 977 + g.idx * 3989) % 12000 AS used_mb, (n_nationkey * 13 + g.idx * 41) % 101 AS util_pct,
  n_nationkey % 12 <> 11 AS alive
FROM {nation} CROSS JOIN (SELECT 0 AS idx UNION ALL SELECT 1 AS idx) g""",
    "job_events_v": """
SELECT event_id, user_id AS job_id, CAST(ts AS TIMESTAMP) AS ts, value,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'launching' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status
FROM {events}""",
    "log_v": """
SELECT user_id AS job_id, event_id AS seq,
  CASE event_id % 11
    WHEN 0 THEN concat(' 47%|#### | ', CAST(event_id % 97 AS STRING), '/97 [', lpad(CAST(event_id % 60 AS STRING),2,'0'), ':42<', lpad(CAST(event_id % 59 AS STRING),2,'0'), ':21, 12.34it/s]')
    WHEN 1 THEN concat(CAST(event_id % 97 AS STRING), '/97 [1:14:32<5:', lpad(CAST(event_id % 60 AS STRING),2,'0'), ':11, 1.50s/it]')
    WHEN 2 THEN '3/97 [02:00<?, ?it/s]'
    WHEN 3 THEN concat('[Epoch ', CAST(event_id % 250 AS STRING), '/200] loss=1.2')
    WHEN 4 THEN concat('Epoch: ', CAST(event_id % 50 AS STRING), '/50')
    WHEN 5 THEN concat('Step ', CAST(event_id % 1000 AS STRING), ' of 1000')
    WHEN 6 THEN concat('[16/103] OK (874.7m, ETA ', CAST(event_id % 5000 AS STRING), '.5m)')
    WHEN 7 THEN concat('Iter ', CAST(event_id % 900 AS STRING), ' | Reward 4739.1')
    WHEN 8 THEN 'RuntimeError: CUDA out of memory'
    WHEN 9 THEN 'task killed mid-training'
    ELSE 'Training complete' END AS line
FROM {events}""",
    "files_v": """
SELECT concat('/ckpt/', CAST(p_partkey % 400 AS STRING)) AS dir,
  concat('/ckpt/', CAST(p_partkey % 400 AS STRING), '/p', CAST(p_partkey AS STRING),
         CASE p_partkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.pt' WHEN 2 THEN '.safetensors' ELSE '.npz' END) AS path,
  CAST(p_size % 7 AS BIGINT) * 1000 AS size, p_partkey * 31 % 1009 AS mtime, p_partkey % 11 = 0 AS is_dir
FROM {part}""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]))


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views that it names in front."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
    sql = sql.strip()
    if sql.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {sql[15:]}"
    return f"WITH {ctes}, {sql[5:]}" if sql[:5].upper() == "WITH " else f"WITH {ctes} {sql}"
