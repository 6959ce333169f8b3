"""Stand-ins: the operators' inputs derived from the benchmark tables.

Each stand-in is one portable SELECT, run by Spark here and by the oracle there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POSTINGS = """
SELECT doc_id AS id, 'x' || CAST(doc_id % 900 AS STRING) AS external_id,
  CAST(substr(source, 4) AS INT) AS source_id, CAST(substr(source, 4) AS INT) % 5 AS company_id,
  CASE CAST(substr(source, 4) AS INT) % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'mail_alert' END AS adapter,
  CASE doc_id % 8 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Staff Engineer - Remote' WHEN 2 THEN 'Regional Sales Manager' WHEN 3 THEN 'SDE II (Contract)'
    WHEN 4 THEN 'Data Center Technician' WHEN 5 THEN 'Junior Analyst' WHEN 6 THEN 'ML Engineer II' ELSE 'Account Executive' END AS title,
  coalesce(text, '') || ' Requires ' || CAST(doc_id % 9 + 1 AS STRING) || '+ years of experience'
    || CASE WHEN doc_id % 6 = 0 THEN ' with quota and salesforce.' WHEN doc_id % 10 = 1 THEN ' plus upsell.' ELSE '.' END AS description_text,
  coalesce(text, '') AS body,
  CASE doc_id % 3 WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'Berlin' END AS location_city,
  CASE lang WHEN 'en' THEN 'IN' WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'FR' END AS location_country,
  doc_id % 4 = 0 AS is_remote,
  CASE doc_id % 7 WHEN 0 THEN 'intern' WHEN 1 THEN 'Staff' WHEN 2 THEN 'senior' END AS seniority_guess,
  CASE WHEN doc_id % 29 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' END AS closed_at,
  doc_id % 11 = 0 AS filtered_out,
  CASE WHEN doc_id % 33 = 0 THEN 'superseded_by:' || CAST(doc_id + 1 AS STRING) WHEN doc_id % 11 = 0 THEN 'location' END AS filter_reason,
  doc_id % 13 = 0 AS needs_description, CAST(doc_id % 3 AS INT) AS missed_runs,
  doc_id % 50 AS first_seen_day, doc_id % 5 AS last_seen_day
FROM documents
"""

COMPANIES = """
SELECT c_custkey AS id, c_name AS name, lower(replace(c_name, '#', '-')) AS slug,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'dream' WHEN 'MACHINERY' THEN 'strong' ELSE 'volume' END AS tier,
  CASE WHEN c_custkey % 5 = 2 THEN 'blacklisted' ELSE 'tracking' END AS status, c_acctbal AS balance
FROM customer
"""

#: An application per user, its events by type.
EVENTS = """
SELECT event_id AS id, user_id AS application_id, ts AS occurred_at,
  CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'acknowledged' WHEN 'signup' THEN 'screening' WHEN 'purchase' THEN 'offer' ELSE 'rejected' END AS status
FROM events
"""
APPLICATIONS = """
SELECT user_id AS id, user_id AS posting_id, user_id % 6 AS variant_id, user_id % 3 + 1 AS company_id,
  CASE WHEN user_id % 4 = 0 THEN 'referral' ELSE 'direct' END AS source_channel, min(ts) AS submitted_at,
  CASE user_id % 7 WHEN 0 THEN 'submitted' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'screening' WHEN 3 THEN 'interview' WHEN 4 THEN 'offer' WHEN 5 THEN 'withdrawn' ELSE 'rejected' END AS status
FROM events GROUP BY user_id
"""
TIERS = """
SELECT r_regionkey + 1 AS id, CASE r_regionkey WHEN 0 THEN 'dream' WHEN 1 THEN 'strong' ELSE 'volume' END AS tier, r_name AS name FROM region
"""

#: One source result per event: a run is a day, a source a user.
RESULTS = """
SELECT CAST(ts AS DATE) AS day, user_id % 40 AS source_id, 'source ' || CAST(user_id % 40 AS STRING) AS describe,
  CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'empty' WHEN 'signup' THEN 'timeout' WHEN 'purchase' THEN 'disabled' ELSE 'http_error' END AS status,
  event_id % 7 AS fetched, event_id % 3 AS new, event_id % 2 AS updated, event_id % 5 AS unchanged, CAST(1 AS BIGINT) AS requests, event_id % 4 AS retries, event_id % 11 AS rate_limit_wait_ms
FROM events
"""

#: Requirements of orders: kind by return flag, skill by brand; ordinals made unique.
REQUIREMENTS = """
SELECT l_orderkey AS posting_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
  CASE l_returnflag WHEN 'R' THEN 'hard' WHEN 'A' THEN 'nice' ELSE 'tool' END AS kind,
  CASE WHEN l_partkey % 10 = 0 THEN NULL WHEN l_partkey % 10 = 1 THEN 'pack' || substr(p_brand, 7, 1) ELSE p_brand END AS normalised_skill,
  CAST(0.25 + CAST(abs(l_discount) * 100 AS INT) % 4 * 0.25 AS DECIMAL(3,2)) AS weight, 'wants ' || p_brand AS text
FROM lineitem JOIN part ON l_partkey = p_partkey
"""
SKILLS = """
SELECT DISTINCT p_brand AS token, 'Skill ' || p_brand AS label, 'family' || substr(p_brand, 7, 1) AS family FROM part
"""
#: Variants: the regions, with the eight brands that their suppliers shipped most of.
VARIANT_SKILLS = """
SELECT variant_id, token, place FROM (
  SELECT n_regionkey AS variant_id, p_brand AS token, row_number() OVER (PARTITION BY n_regionkey ORDER BY sum(l_quantity) DESC, p_brand) AS place
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, p_brand) ranked
WHERE place <= 8
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A SELECT over the benchmark tables that it names, without registering views."""
    used = [t for t in TABLES if f" {t}" in sql.replace("\n", " ")]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = sql
    for t in used:
        text = __import__("re").sub(rf"(?<=[ \n])((?:FROM|JOIN) ){t}\b", rf"\1{{{t}}}", text)
    return spark.sql(text, **frames)
