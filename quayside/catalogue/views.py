"""Messy exports as views over the driver's tables; the same SQL runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MESSY_ORGANIZATIONS = """
SELECT c_custkey AS row_idx,
  CASE WHEN c_custkey % 97 = 0 THEN '' WHEN c_custkey % 101 = 0 THEN CAST(c_custkey - 1 AS STRING) ELSE CAST(c_custkey AS STRING) END AS acct_num,
  CASE c_custkey % 7 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN upper(c_name) WHEN 2 THEN 'Customer  ' || CAST(c_custkey % 50 AS STRING) ELSE c_name END AS company_name,
  CASE c_custkey % 11 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'On Hold' WHEN 2 THEN 'Closed' WHEN 3 THEN 'Actve' WHEN 4 THEN '' WHEN 5 THEN 'Inactive' WHEN 6 THEN 'Prospect' ELSE 'Active' END AS company_status,
  CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN '31' ELSE c_mktsegment END AS industry_code,
  CASE c_custkey % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'Texas' WHEN 2 THEN '' ELSE 'Narnia' END AS hq_state,
  CASE c_custkey % 6 WHEN 0 THEN 'CA' WHEN 1 THEN 'USA' WHEN 2 THEN 'United States' WHEN 3 THEN 'Canada' WHEN 4 THEN 'us' ELSE 'Freedonia' END AS country,
  CASE c_custkey % 5 WHEN 0 THEN 'https://www.c' || CAST(c_custkey AS STRING) || '.com' WHEN 1 THEN 'www.c' || CAST(c_custkey AS STRING) || '.com' WHEN 2 THEN 'N/A' WHEN 3 THEN 'no website' ELSE '' END AS website,
  CASE c_custkey % 8 WHEN 0 THEN '$7,' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || ',000' WHEN 1 THEN '12.35M' WHEN 2 THEN 'n/a' WHEN 3 THEN '' WHEN 4 THEN '-100' WHEN 5 THEN '2B' WHEN 6 THEN 'USD ' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey * 50000 AS STRING) END AS annual_revenue,
  CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS STRING) || '.0' WHEN 1 THEN 'unknown' WHEN 2 THEN '' WHEN 3 THEN '1,200' WHEN 4 THEN '1200.7' ELSE ' ' || CAST(c_custkey AS STRING) || ' ' END AS employee_count,
  CASE c_custkey % 4 WHEN 0 THEN 'REGIONAL' WHEN 1 THEN 'Strategic' WHEN 2 THEN 'Gold' ELSE '' END AS customer_tier,
  CASE c_custkey % 9 WHEN 0 THEN upper('owner' || CAST(c_custkey AS STRING) || '@example.com') WHEN 1 THEN 'owner at example.com' WHEN 2 THEN '' WHEN 3 THEN 'owner' || CAST(c_custkey AS STRING) || '@' ELSE 'p' || CAST(c_custkey AS STRING) || '.0@example.com' END AS primary_contact_email,
  CASE c_custkey % 7 WHEN 0 THEN y || '-' || mm || '-' || dd WHEN 1 THEN mm || '/' || dd || '/' || y WHEN 2 THEN dd || '-' || mon || '-' || y WHEN 3 THEN y || '/' || mm || '/' || dd WHEN 4 THEN mm || '/' || dd || '/' || substr(y, 3, 2) WHEN 5 THEN '' ELSE '26th of August' END AS created_on,
  CASE WHEN c_custkey % 3 = 0 THEN '1999-01-' || dd2 ELSE '2001-12-' || dd2 END AS last_activity_date
FROM (SELECT *, CAST(1996 + c_custkey % 5 AS STRING) AS y, lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') AS mm, lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dd, lpad(CAST(1 + c_custkey % 31 AS STRING), 2, '0') AS dd2, substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(1 + 3 * (c_custkey % 12) AS INT), 3) AS mon FROM customer) t
"""

MESSY_CONTACTS = """
SELECT c_custkey * 2 + j AS row_idx,
  'CT-' || lpad(CAST(c_custkey * 2 + j AS STRING), 6, '0') AS contact_ref,
  CASE WHEN c_custkey % 50 = 7 THEN '70' || lpad(CAST(c_custkey AS STRING), 5, '0') WHEN c_custkey % 50 = 9 THEN '' ELSE CAST(c_custkey AS STRING) END AS acct_num,
  CASE (c_custkey + j) % 6 WHEN 0 THEN 'COLLINS, JILLIAN' WHEN 1 THEN 'Mrs. Dana Munoz MD' WHEN 2 THEN 'Cher' WHEN 3 THEN ' Brandon  Gonzales ' WHEN 4 THEN 'DeLuca, Gina' ELSE 'ann marie reyes-bradley' END AS full_name,
  CASE WHEN c_custkey % 13 = 0 THEN 'SAME' || CAST(c_custkey AS STRING) || '@Example.com' WHEN (c_custkey + j) % 17 = 0 THEN 'x at example.com' ELSE 'p' || CAST(c_custkey AS STRING) || '.' || CAST(j AS STRING) || '@example.com' END AS contact_mail,
  CASE (c_custkey + j) % 7 WHEN 0 THEN '(699) 445-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') WHEN 1 THEN '757-2046' WHEN 2 THEN '+1 415 555 2671' WHEN 3 THEN '' WHEN 4 THEN '6994456029' WHEN 5 THEN 'n/a' ELSE '502.555.0113' END AS phone_number,
  CASE (c_custkey + j) % 6 WHEN 0 THEN 'AP' WHEN 1 THEN 'CTO' WHEN 2 THEN 'Ops Manager' WHEN 3 THEN '' WHEN 4 THEN 'billing contact' ELSE 'Owner' END AS contact_role,
  CASE WHEN c_custkey % 10 = 0 THEN 'N' WHEN c_custkey % 10 = 1 THEN 'yes' WHEN j = 0 THEN 'Y' WHEN c_custkey % 10 = 5 THEN 'maybe' ELSE 'FALSE' END AS is_primary
FROM customer CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 AS j) jj
"""

MESSY_SUBSCRIPTIONS = """
SELECT o_orderkey AS row_idx,
  'SUB-' || lpad(CAST(CASE WHEN o_orderkey % 103 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING), 7, '0') AS sub_id,
  CASE WHEN o_orderkey % 67 = 5 THEN '80' || CAST(o_orderkey AS STRING) ELSE CAST(o_custkey AS STRING) END AS acct_num,
  CASE o_orderkey % 8 WHEN 0 THEN 'Pro' WHEN 1 THEN 'Enterprise v2' WHEN 2 THEN 'Legacy Gold' WHEN 3 THEN 'Basic' WHEN 4 THEN 'Trial' WHEN 5 THEN 'ENT' WHEN 6 THEN 'starter' ELSE 'Professional Plus' END AS subscription_level,
  CASE o_orderkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN 'annual' WHEN 2 THEN 'Q' WHEN 3 THEN 'yearly' WHEN 4 THEN 'monthly' ELSE 'weekly' END AS billing_freq,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'expired' ELSE 'trialing' END AS sub_status,
  CASE o_orderkey % 5 WHEN 0 THEN '5' WHEN 1 THEN '12' WHEN 2 THEN '' WHEN 3 THEN '40.0' ELSE '0' END AS seat_count,
  CASE o_orderkey % 3 WHEN 0 THEN y || '-' || mm || '-' || dd WHEN 1 THEN mm || '/' || dd || '/' || y ELSE y || '/' || mm || '/' || dd END AS start_dt,
  CASE WHEN o_orderkey % 41 = 0 THEN '1990-01-01' ELSE CAST(CAST(y AS INT) + 1 AS STRING) || '-' || mm || '-' || dd END AS renew_dt,
  CASE o_orderkey % 4 WHEN 0 THEN '$' || amt WHEN 1 THEN amt WHEN 2 THEN 'USD ' || amt ELSE ' ' || amt || ' ' END AS monthly_amount,
  CASE WHEN o_orderkey % 9 = 0 THEN 'CAD' ELSE 'USD' END AS currency
FROM (SELECT *, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS STRING) AS amt FROM orders) t
"""

MESSY_ACTIVITY = """
SELECT event_id AS row_idx,
  'ACT-' || lpad(CAST(event_id AS STRING), 7, '0') AS activity_id,
  CAST(user_id AS STRING) AS acct_num,
  CASE event_type WHEN 'click' THEN 'Ticket' WHEN 'view' THEN 'Login' WHEN 'purchase' THEN 'INVOICE' WHEN 'signup' THEN 'Note' ELSE 'Call' END AS activity_type,
  CASE event_id % 4 WHEN 0 THEN y || '-' || mm || '-' || dd || 'T' || hh || ':' || mi || ':' || ss || 'Z' WHEN 1 THEN mm || '/' || dd || '/' || y || ' ' || hh || ':' || mi WHEN 2 THEN y || '-' || mm || '-' || dd || ' ' || hh || ':' || mi || ':' || ss || '-05:00' ELSE y || '-' || mm || '-' || dd || ' ' || hh || ':' || mi || ':' || ss END AS occurred_at,
  CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN '' WHEN 2 THEN '1,475.00' ELSE CAST(CAST(value AS DECIMAL(15,2)) AS STRING) END AS amount,
  CASE WHEN event_id % 3 = 0 THEN 'monthly invoice' ELSE '' END AS description
FROM (SELECT *, CAST(year(ts) AS STRING) AS y, lpad(CAST(month(ts) AS STRING), 2, '0') AS mm, lpad(CAST(day(ts) AS STRING), 2, '0') AS dd, lpad(CAST(hour(ts) AS STRING), 2, '0') AS hh, lpad(CAST(minute(ts) AS STRING), 2, '0') AS mi, lpad(CAST(CAST(floor(second(ts)) AS INT) AS STRING), 2, '0') AS ss FROM events) t
"""

VIEWS = {"messy_organizations": MESSY_ORGANIZATIONS, "messy_contacts": MESSY_CONTACTS, "messy_subscriptions": MESSY_SUBSCRIPTIONS, "messy_activity": MESSY_ACTIVITY}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations", "benchmark")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A messy view or a plain table."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, tables = VIEWS[name], {}
    for t in ("customer", "orders", "events"):
        if re.search(rf"FROM {t}\b", sql):
            tables[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            sql = re.sub(rf"FROM {t}\b", f"FROM {{{t}}}", sql)
    return spark.sql(sql, **tables)


def with_view(*names: str) -> str:
    """The start of an oracle's WITH list."""
    return ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
