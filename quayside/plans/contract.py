"""The target contract: four entities, their fields and limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Field:
    kind: str  # identifier, string, enum, email, url, integer, decimal, boolean, date, datetime or list
    required: bool = False
    enum: tuple[str, ...] = ()
    default: str | None = None
    minimum: int | None = None
    max_length: int | None = None
    min_length: int | None = None
    pattern: str | None = None


def _enum(*words: str, required: bool = True, default: str | None = None) -> Field:
    return Field("enum", required and default is None, words, default)


_ID = Field("identifier", True, max_length=64, min_length=1, pattern=r"^[A-Za-z0-9][A-Za-z0-9_.-]*$")
_NAME = Field("string", True, max_length=100, min_length=1)

# The fields in their order.
CONTRACT: dict[str, Field] = {
    "organization.organization_id": _ID,
    "organization.name": Field("string", True, max_length=200, min_length=1),
    "organization.lifecycle_status": _enum("prospect", "active", "inactive", "churned"),
    "organization.industry": _enum("manufacturing", "construction", "energy", "logistics", "healthcare", "technology", "professional_services", "other", default="other"),
    "organization.account_priority": _enum("standard", "priority", "strategic", default="standard"),
    "organization.billing_country": Field("string", True, pattern=r"^[A-Z]{2}$"),
    "organization.billing_region": Field("string", max_length=10),
    "organization.website": Field("url"),
    "organization.annual_revenue_usd": Field("decimal", minimum=0),
    "organization.employee_count": Field("integer", minimum=0),
    "organization.customer_since": Field("date"),
    "organization.tags": Field("list", default="", max_length=10),
    "contact.contact_id": _ID,
    "contact.organization_id": _ID,
    "contact.email": Field("email", True),
    "contact.first_name": _NAME,
    "contact.last_name": _NAME,
    "contact.phone": Field("string", pattern=r"^\+[1-9]\d{6,14}$"),
    "contact.role": _enum("primary", "billing", "technical", "executive", "other", default="other"),
    "contact.is_primary": Field("boolean", default="false"),
    "subscription.subscription_id": _ID,
    "subscription.organization_id": _ID,
    "subscription.plan": _enum("starter", "professional", "enterprise"),
    "subscription.billing_cycle": _enum("monthly", "annual"),
    "subscription.status": _enum("trial", "active", "past_due", "cancelled"),
    "subscription.seats": Field("integer", True, minimum=1),
    "subscription.start_date": Field("date", True),
    "subscription.renewal_date": Field("date", True),
    "subscription.mrr_usd": Field("decimal", True, minimum=0),
    "activity.activity_id": _ID,
    "activity.organization_id": _ID,
    "activity.kind": _enum("invoice", "payment", "support_ticket", "login", "note"),
    "activity.occurred_at": Field("datetime", True),
    "activity.amount_usd": Field("decimal", minimum=0),
    "activity.description": Field("string", max_length=1000),
}

ENTITIES = ("organization", "contact", "subscription", "activity")  # in the order in which they are written


def id_field(entity: str) -> str:
    return f"{entity}_id"


def entity_fields(entity: str) -> dict[str, Field]:
    return {k.split(".", 1)[1]: f for k, f in CONTRACT.items() if k.startswith(f"{entity}.")}


def catalog(spark: SparkSession) -> DataFrame:
    """One row per field with its limits; the frame's size is that of the contract."""
    rows = [(k, *k.split(".", 1), f.kind, f.required, i, list(f.enum), f.pattern, None if f.minimum is None else float(f.minimum), f.max_length) for i, (k, f) in enumerate(CONTRACT.items())]
    return spark.createDataFrame(rows, "target string, entity string, field string, kind string, required boolean, position int, enum array<string>, pattern string, minimum double, max_length int")
