"""A seeded export with counted defects. The same seed gives the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIRST = ["North", "Blue", "Granite", "Harbor", "Summit", "Cedar"]
_SECOND = ["Works", "Supply", "Freight", "Energy", "Tools", "Care"]
#: Every how many rows each defect is planted.
DEFECTS = {"missing_id": 97, "repeated_id": 89, "placeholder_site": 11, "upper_name": 13}
CHILD_DEFECTS = {
    "contacts": {"missing_id": 101, "orphan": 53, "malformed_mail": 31, "short_phone": 17},
    "subscriptions": {"missing_id": 103, "orphan": 59, "unknown_plan": 37, "dates_swapped": 29},
    "activities": {"missing_id": 107, "orphan": 61, "future": 41},
}
PER_ORGANIZATION = {"contacts": 2, "subscriptions": 1, "activities": 4}


def organizations(spark: SparkSession, rows: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows, manifest): the manifest counts each planted defect."""
    i = F.col("row_idx")
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(n)).cast("int")
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), draw(salt, len(words)) + 1)
    every = {k: (i % n == n - 1) for k, n in DEFECTS.items()}
    name = F.concat_ws(" ", pick("first", _FIRST), pick("second", _SECOND))
    df = spark.range(rows).withColumnRenamed("id", "row_idx").select(
        "row_idx",
        F.when(every["missing_id"], "").when(every["repeated_id"], (i - 1 + 10000).cast("string")).otherwise((i + 10000).cast("string")).alias("acct_num"),
        F.when(every["upper_name"], F.upper(name)).otherwise(name).alias("company_name"),
        F.when(every["placeholder_site"], "n/a").otherwise(F.concat(F.lit("https://www.c"), i.cast("string"), F.lit(".com"))).alias("website"),
        pick("status", ["Active", "Inactive", "Prospect", "On Hold"]).alias("company_status"),
    )
    return df, {k: rows // n for k, n in DEFECTS.items()}


def exports(spark: SparkSession, n_organizations: int, seed: int) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """Four related exports, organizations, contacts, subscriptions and activities, and a manifest of the defects of each.

    A child's account is that of the organization whose turn it is; orphans name one that does not exist. Where two
    defects fall on one row both are there and both count.
    """
    frame, planted = organizations(spark, n_organizations, seed)
    out, manifest = {"organizations": frame}, {"organizations": planted}
    i = F.col("row_idx")
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), i), F.lit(n)).cast("int")
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), draw(salt, len(words)) + 1)
    for name, per in PER_ORGANIZATION.items():
        rows = n_organizations * per
        every = {k: (i % n == n - 1) for k, n in CHILD_DEFECTS[name].items()}
        account = F.when(every["orphan"], F.concat(F.lit("gone-"), i.cast("string"))).otherwise(((i % n_organizations) + 10000).cast("string")).alias("acct_num")
        own_id = lambda prefix, every=every: F.when(every["missing_id"], "").otherwise(F.concat(F.lit(prefix), i.cast("string")))
        day = F.date_add(F.lit("2023-01-01").cast("date"), draw(f"{name}-day", 700))
        if name == "contacts":
            mail = F.when(every["malformed_mail"], F.concat(F.lit("mail"), i.cast("string"), F.lit(" at example.com"))).otherwise(F.concat(F.lit("mail"), i.cast("string"), F.lit("@example.com")))
            phone = F.when(every["short_phone"], "555-0100").otherwise(F.concat(F.lit("(415) 555-"), F.lpad((i % 10000).cast("string"), 4, "0")))
            columns = [own_id("C-").alias("contact_ref"), account, F.concat_ws(" ", pick("given", ["Ana", "Ben", "Cleo", "Dan"]), pick("family", ["Lee", "Moore", "Nash", "Ortiz"])).alias("full_name"), mail.alias("contact_mail"), phone.alias("phone_number"), pick("role", ["billing", "technical", "other"]).alias("contact_role"), F.when(i < n_organizations, "yes").otherwise("no").alias("is_primary")]
        elif name == "subscriptions":
            begin, end = F.when(every["dates_swapped"], F.date_add(day, 365)).otherwise(day), F.when(every["dates_swapped"], day).otherwise(F.date_add(day, 365))
            plan = F.when(every["unknown_plan"], "Legacy Bronze").otherwise(pick("plan", ["Starter", "Professional", "Enterprise"]))
            columns = [own_id("S-").alias("sub_id"), account, plan.alias("subscription_level"), pick("cycle", ["monthly", "annual"]).alias("billing_freq"), pick("state", ["active", "cancelled"]).alias("sub_status"), (draw("seats", 200) + 1).cast("string").alias("seat_count"), begin.cast("string").alias("start_dt"), end.cast("string").alias("renew_dt"), F.format_string("$%d.00", draw("money", 900) + 50).alias("monthly_amount")]
        else:
            at = F.when(every["future"], F.lit("2099-01-01T00:00:00Z")).otherwise(F.concat(day.cast("string"), F.lit("T09:30:00Z")))
            columns = [own_id("A-").alias("activity_id"), account, pick("kind", ["invoice", "payment", "login", "note"]).alias("activity_type"), at.alias("occurred_at"), F.format_string("%d.50", draw("amount", 500)).alias("amount"), F.lit("as exported").alias("description")]
        out[name] = spark.range(rows).withColumnRenamed("id", "row_idx").select("row_idx", *columns)
        manifest[name] = {k: rows // n for k, n in CHILD_DEFECTS[name].items()}
    return out, manifest
