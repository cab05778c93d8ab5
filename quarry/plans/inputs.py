"""Inputs that queries derive from the tables.

The snippets are valid in Spark SQL and in the oracle's SQL alike, so that both
sides read the same rows; each is a table expression over the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Narrow tables and their keys. A few MB on disk, which are one or two tasks, hold the rows of which snippets make whole texts.
NARROW = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a narrow one is dealt out by its key first, so that what is made of its rows is made in many tasks, and
    what is grouped by the key needs no other exchange."""
    df = table(spark, sf_dir, name)
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), NARROW[name]) if name in NARROW else df


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a snippet over the tables of a folder."""
    found = sorted({m for m in re.findall(r"\b(?:FROM|JOIN)\s+([a-z]+)\b", sql) if m in TABLES})
    sql = sql.replace("{", "{{").replace("}", "}}")
    named = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(found) + r")\b", r"\1 {\2}", sql) if found else sql
    return spark.sql(named, **{t: dealt(spark, sf_dir, t) for t in found})


#: One semantic document per customer.
MARKDOWN = """
SELECT c_custkey AS doc_id, 'docs/' || lower(c_mktsegment) || '/' || c_name || '.semantic.md' AS path,
  'Lead line' || chr(10) || '# ' || c_name || chr(10) || 'dropped' || chr(10)
  || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '## System' || chr(10) || 'System of ' || c_name || chr(10) END
  || '## Interfaces' || chr(10) || '- api: `GET /customers/' || CAST(c_nationkey AS STRING) || '` - list of customers' || chr(10)
  || '- event: ' || lower(c_mktsegment) || '.changed' || chr(10) || 'POST /orders/' || CAST(c_custkey % 5 AS STRING) || '/ - new order' || chr(10)
  || '### Login Service' || chr(10) || 'The PaymentGateway calls the OrderService and OrderService.' || chr(10)
  || '## Data  Flows' || chr(10) || '1. ' || c_mktsegment || ' orders' || chr(10) || '2. store the order' || chr(10)
  || '## Rules' || chr(10) || '- must ship ' || lower(c_mktsegment) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '- must not ship ' || lower(c_mktsegment) || chr(10) ELSE '' END
  || '## Security' || chr(10) || CASE WHEN c_custkey % 4 = 0 THEN 'Login by token auth.' ELSE 'Protected pages.' END || chr(10)
  || '## Dependencies' || chr(10) || '- Postgres database' || chr(10) || '- ' || c_mktsegment || ' registry' || chr(10)
  || CASE WHEN c_custkey % 5 = 0 THEN '## Intent' || chr(10) ELSE '## Intent' || chr(10) || 'Keep customers.' || chr(10) || chr(10) || 'Sell to nation ' || CAST(c_nationkey AS STRING) || '.' || chr(10) END
  || '## Payment processing' || chr(10) || 'table: payments' || chr(10) || '| a | b |' || chr(10) AS text
FROM customer"""

#: One source file per part.
SOURCES = """
SELECT 'src/' || lower(replace(p_brand, '#', '')) || '/' || CASE WHEN p_size % 3 = 0 THEN 'service' ELSE 'web' END || '/Part' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 3 = 0 THEN 'Service' ELSE 'Controller' END || '.java' AS file,
  p_partkey, 'package com.shop.' || lower(replace(p_brand, '#', '')) || CASE WHEN p_size % 3 = 0 THEN '.service' ELSE '.web' END || ';' || chr(10)
  || 'import java.util.List;' || chr(10) || 'import com.shop.common.Money;' || chr(10)
  || CASE WHEN p_size % 3 = 0 THEN '@Service' ELSE '@RestController' END || chr(10)
  || 'public class Part' || CAST(p_partkey AS STRING) || CASE WHEN p_size % 3 = 0 THEN 'Service' ELSE 'Controller' END || ' {' || chr(10)
  || '  private final OrderRepository orders;' || chr(10) || chr(10)
  || '  @Column(name = "p_' || lower(substr(p_brand, 1, 5)) || '", nullable = false)' || chr(10) || '  private String title;' || chr(10)
  || CASE WHEN p_size % 2 = 0 THEN '  @GetMapping("/parts/' || CAST(p_size AS STRING) || '")' || chr(10) ELSE '  @PreAuthorize("hasRole")' || chr(10) || '  @PostMapping(value = "/api/parts")' || chr(10) END
  || '  public String load' || CAST(p_size AS STRING) || '(String id) {' || chr(10) || '    orders.save(id); publishEvent(id);' || chr(10) || '  }' || chr(10)
  || CASE WHEN p_size % 5 = 0 THEN '  @KafkaListener(topics = "parts")' || chr(10) || '  public void onPart(String id) {' || chr(10) ELSE '' END || '}' || chr(10) AS text
FROM part"""

#: The foreign-key graph without orders.
NODES = """
SELECT 'r' || CAST(r_regionkey AS STRING) AS id, 'Region' AS label, r_name AS name FROM region
UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'Nation', n_name FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'Customer', c_name FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'Supplier', s_name FROM supplier"""
EDGES = """
SELECT 'n' || CAST(n_nationkey AS STRING) AS src, 'r' || CAST(n_regionkey AS STRING) AS dst, 'IN_REGION' AS type FROM nation
UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), 'IN_NATION' FROM customer
UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), 'n' || CAST(s_nationkey AS STRING), 'IN_NATION' FROM supplier"""

#: Types (nation.customer) that depend on types (nation.supplier) by a line item. Names are unique by key, so pairs are
#: made distinct as numbers, before names are joined.
TYPE_DEPS = """
SELECT cn.n_name || '.' || c_name AS from_type, sn.n_name || '.' || s_name AS to_type
FROM (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey) pairs
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey"""

#: Events as steps of a trace per user and day.
STEPS = """
SELECT user_id, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS trace_id, event_id, event_type AS node, ts,
  CASE event_type WHEN 'purchase' THEN 'service' WHEN 'error' THEN 'helper' ELSE 'controller' END AS role,
  row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS step_ord
FROM events"""
STEP_EDGES = """SELECT DISTINCT node AS src, nxt AS dst FROM (SELECT event_type AS node, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, event_id FROM events) x WHERE nxt IS NOT NULL AND node <= nxt"""

#: Events as issues of documents.
ISSUES = """
SELECT user_id AS doc_id, event_id, CASE event_type WHEN 'error' THEN 'violation' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'gap' WHEN 'click' THEN 'conflict' ELSE 'info' END AS severity, event_type AS code
FROM events"""

#: Endpoints of pages.
ENDPOINTS = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' ELSE 'PUT' END AS method,
  CASE WHEN page_id % 4 = 0 THEN '/api/v1' ELSE '' END || '/' || split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1) || '/' || CAST(page_id % 10 AS STRING) || '?x=1' AS path
FROM pages"""
