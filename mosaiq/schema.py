"""Types of the entities: sources, leads and group records."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, A = T.StringType(), T.BooleanType(), T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SOURCE = struct(id=S, name=S, owner=S, url=S, access=S, terms=S, attribution=S, lead_only=B, refresh=S, harvester=S, notes=S)

#: `extra` holds strings and booleans, so its values are JSON texts of scalars, read back with from_json or cast.
LEAD = struct(
    lead_id=S, source=S, source_url=S, native_id=S, name=S, aka=A, kind_hint=S, website=S, city=S, tags_hint=A,
    extra=T.MapType(S, S), description=S, school=S, open_to_public_hint=B, seen_at=T.ArrayType(struct(date=S, note=S)))

LOCATION = struct(label=S, address=S, neighborhood=S, planning_district=S, zip=S, lat=T.DoubleType(), lng=T.DoubleType(), in_city=B, transit=S)
PROVENANCE = struct(url=S, seen=S, fields=A)

#: Dates may be partial (2026, 2026-10), and EIN and ZIP have leading zeros: all of them stay strings.
GROUP = struct(
    id=S, name=S, aka=A, leads=A, ein=S, summary=S, what_you_do=S, kind=S, categories=A, interests=A, motives=A, formats=A, roles=A, crowd=A, bridging=S,
    audience=struct(open_to=S, school=S, min_age=T.IntegerType(), max_age=T.IntegerType(), community=A, faith=S, partisan=B, support_group=B),
    schedule=struct(text=S, days=A, times=A, recurring=B, season=S),
    locations=T.ArrayType(LOCATION), online_ok=B, cost=struct(level=S, text=S), commitment=S, group_size=S,
    access=struct(wheelchair=S, languages=A, notes=S),
    requirements=struct(act153_clearances=S, background_check=S, court_ordered_ok=S, service_hours_letter=S, kids_ok=S, gear=S),
    first_step=struct(how=S, drop_in=S, sign_up_needed=S, newcomer_friendliness=T.IntegerType(), basis=S, what_to_expect=S, first_visit_tips=A),
    contacts=struct(website=S, email=S, phone=S, contact_name=S, social=A, calendar_feed=S),
    status=S, last_sign_of_life=S, sign_of_life_url=S, sources=T.ArrayType(PROVENANCE), research_tier=T.IntegerType(), confidence=S, last_checked=S, hidden=B, hidden_reason=S)


def overlay(base: dict, over: dict) -> dict:
    """base with over's values; structs are merged field by field, anything else is replaced."""
    return base | {k: overlay(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def group_row(**over) -> tuple:
    """A made-up group for tests: a few values over a plain default."""
    base = {
        "id": "some-group", "name": "Some Group", "kind": "club", "categories": ["outdoors"], "audience": {"open_to": "public"},
        "locations": [{"neighborhood": "old-town", "planning_district": "river-wards", "in_city": True}], "access": {"wheelchair": "unknown"}, "status": "active", "hidden": False}

    def fit(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.StructType):
            return tuple(fit(value.get(f.name), f.dataType) for f in kind.fields)
        return [fit(v, kind.elementType) for v in value] if isinstance(kind, T.ArrayType) else value

    return fit(overlay(base, over), GROUP)
