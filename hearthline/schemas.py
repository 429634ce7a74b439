"""Declared schemas of the tables the jobs read and write."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(columns: str) -> T.StructType:
    """Schema of 'name type, name type'; needs no session, unlike a DDL string."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


POSTS_IN = _struct("url string, group_url string, text string, post_date_text string, ord bigint")

RECORD = _struct(
    "rooms double, price bigint, arnona string, vaad string, shelter boolean, parking string, entry_date string,"
    " floor string, elevator boolean, is_agent boolean, address string"
)

POSTS = _struct(
    "url string, group_url string, raw_text string, parsed_json string, verdict string, attempts int,"
    " first_seen timestamp_ntz, last_processed timestamp_ntz, price_val double, rooms_val double, address string,"
    " address_confidence string, distance_text string, distance_meters int, post_date string, reject_reason string,"
    " model_used string"
)

# The state is stored without its payload, which is a table of its own.
PAYLOAD_COLUMNS = ("raw_text", "parsed_json")
CHANGES = T.StructType([f for f in POSTS.fields if f.name not in PAYLOAD_COLUMNS]).add("batch_id", T.LongType()).add("bucket", T.IntegerType())
PAYLOAD = _struct("url string, raw_text string, parsed_json string, batch_id bigint")

ADDRESS_CACHE = _struct(
    "address_key string, original_address string, canonical_address string, city string, confidence string,"
    " warning string, distance_text string, distance_meters int, distance_source string, geocode_status string,"
    " updated_at timestamp_ntz"
)

_COMPONENT = _struct("long_name string").add("types", T.ArrayType(T.StringType()))
_RESULT = (
    T.StructType()
    .add("types", T.ArrayType(T.StringType()))
    .add("formatted_address", T.StringType())
    .add("address_components", T.ArrayType(_COMPONENT))
)
GEOCODES = _struct("address_key string, failed boolean").add("results", T.ArrayType(_RESULT))

ROUTES = _struct("address_key string, status string, meters int")

CALL_LOG = _struct("ts timestamp_ntz, call_id bigint, kind string")

API_USAGE = _struct("month string, calls bigint")

LISTINGS = _struct(
    "url string, price int, rooms double, distance_km double, entry_date string, floor int, elevator boolean,"
    " parking string, arnona bigint, vaad bigint, shelter boolean, is_agent boolean, post_date date, address string,"
    " scanned_at timestamp_ntz"
)
