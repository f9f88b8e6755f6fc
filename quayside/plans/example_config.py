"""The configuration that the queries and tests use."""

from __future__ import annotations

from quayside.plans.config import Config, ValueMap

# Names of states and provinces, and the words of the example exports.
_STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO", "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL",
    "georgia": "GA", "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME",
    "maryland": "MD", "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA", "rhode island": "RI",
    "south carolina": "SC", "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA", "west virginia": "WV", "wisconsin": "WI",
    "wyoming": "WY", "alberta": "AB", "british columbia": "BC", "manitoba": "MB", "new brunswick": "NB", "newfoundland and labrador": "NL", "nova scotia": "NS", "ontario": "ON", "prince edward island": "PE", "quebec": "QC", "saskatchewan": "SK",
}

VALUE_MAPS = {
    "organization.lifecycle_status": ValueMap({"active": "active", "inactive": "inactive", "prospect": "prospect", "churned": "churned", "on hold": "active", "closed": "churned"}, "error", 6),
    "organization.industry": ValueMap({"automobile": "manufacturing", "building": "construction", "furniture": "other", "household": "other", "machinery": "manufacturing"}, "default"),
    "organization.billing_country": ValueMap({"us": "US", "usa": "US", "u.s.": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "ca": "CA", "can": "CA", "canada": "CA", "mx": "MX", "mex": "MX", "mexico": "MX"}, "error", 5),
    "organization.billing_region": ValueMap(_STATES, "null"),
    "contact.role": ValueMap({"primary": "primary", "ceo": "primary", "owner": "primary", "billing": "billing", "billing contact": "billing", "ap": "billing", "accounts payable": "billing", "technical": "technical", "cto": "technical", "it": "technical", "executive": "executive"}, "default", 13),
    "subscription.plan": ValueMap({"starter": "starter", "basic": "starter", "pro": "professional", "professional": "professional", "professional plus": "professional", "enterprise": "enterprise", "enterprise v2": "enterprise", "ent": "enterprise", "legacy gold": "enterprise"}, "error", 8),
    "subscription.billing_cycle": ValueMap({"m": "monthly", "monthly": "monthly", "a": "annual", "annual": "annual", "yearly": "annual", "q": "monthly"}, "error", 9),
    "subscription.status": ValueMap({"active": "active", "trialing": "trial", "trial": "trial", "past due": "past_due", "past_due": "past_due", "cancelled": "cancelled", "canceled": "cancelled", "paused": "past_due", "expired": "cancelled"}, "error", 10),
    "activity.kind": ValueMap({"invoice": "invoice", "payment": "payment", "login": "login", "ticket": "support_ticket", "support ticket": "support_ticket", "note": "note"}, "error"),
}

EXAMPLE = Config(
    as_of="2001-06-01",
    date_formats=("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%m/%d/%y", "%d-%b-%Y", "%B %d, %Y"),
    datetime_formats=("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%d %H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y %H:%M", "%d-%b-%Y %I:%M %p"),
    placeholders=("-", "--", "n/a", "na", "n.a.", "none", "null", "unknown", "tbd", "?"),
    value_maps=VALUE_MAPS,
    overrides={"contact.first_name": ("person_name_split",), "contact.phone": ("phone_e164",), "organization.billing_country": ("country_code",), "organization.billing_region": ("region_code",)},
)
