"""Predicates over text columns: keys, digests, timestamps, identifiers, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolith.functions.spatial import col

# The formats of keys, and the characters that count as white space.
SLUG = "[a-z0-9]+(-[a-z0-9]+)*"
SHA256 = "[0-9a-f]{64}"
BUILDING_KEY = "kcb-[0-9a-f]{64}"
OBJECT_ID = "0|[1-9][0-9]*"
TIMESTAMP = "[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\\.[0-9]{3}Z"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def matches(value: str | Column, pattern: str) -> Column:
    """Whether the whole value has the form, to its last character; null has not."""
    return F.coalesce(col(value).rlike(f"\\A(?:{pattern})\\z"), F.lit(False))


def stripped(value: str | Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.trim(col(value), F.lit(SPACES))


def is_timestamp(value: str | Column) -> Column:
    """The form, and a date that exists."""
    value = col(value)
    return matches(value, TIMESTAMP) & F.coalesce(F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).isNotNull(), F.lit(False))


def object_id(value: str | Column) -> Column:
    """The identifier as a number, or null unless the trimmed text is a canonical one."""
    trimmed = stripped(value)
    return F.when(matches(trimmed, OBJECT_ID), F.try_to_number(trimmed, F.lit("9999999999999999999")).cast("long"))


def is_identity(value: str | Column) -> Column:
    return F.coalesce(stripped(value) != "", F.lit(False))


def is_position(x: str | Column, y: str | Column) -> Column:
    """Finite longitude and latitude in range."""
    return F.coalesce(col(x).between(-180.0, 180.0) & col(y).between(-90.0, 90.0), F.lit(False))


def project_key(algorithm: str, release_key: str | Column, source_feature_id: str | Column) -> Column:
    """kcb- and the digest of the canonical JSON of the three values (text without control characters or quotes)."""
    body = F.concat(F.lit(f'{{"algorithm":"{algorithm}","release_key":"'), col(release_key), F.lit('","source_feature_id":"'), col(source_feature_id).cast("string"), F.lit('"}'))
    return F.concat(F.lit("kcb-"), F.sha2(body, 256))


def release_key(stem: str, day: str | Column, content_sha256: str | Column) -> Column:
    """<stem>-candidate-<yyyymmdd or undated>-<first 12 hex digits>."""
    return F.concat_ws("-", F.lit(stem), F.lit("candidate"), F.coalesce(F.regexp_replace(col(day), "-", ""), F.lit("undated")), F.substring(col(content_sha256), 1, 12))


def first_field(field: str, *documents: str | Column) -> Column:
    """The field of the first JSON document that has it."""
    return F.coalesce(*[F.get_json_object(col(d), f"$.{field}") for d in documents])


def epoch_ms(iso: str | Column) -> Column:
    """Milliseconds since 1970 of an ISO timestamp with a zone; null without one or if it does not exist."""
    value = F.trim(col(iso))
    zoned = value.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")
    return F.when(zoned, F.unix_millis(F.try_to_timestamp(value)))


def naive_epoch_ms(iso: str | Column) -> Column:
    """The same, where a timestamp without a zone is in UTC."""
    value = F.trim(col(iso))
    return epoch_ms(F.when(value.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$"), value).otherwise(F.concat(value, F.lit("Z"))))


def iso_of(ms: str | Column) -> Column:
    """UTC with milliseconds and Z, in a session whose time zone is UTC."""
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utc_seconds(iso: str | Column) -> Column:
    """A timestamp with a zone as UTC seconds with Z."""
    return F.date_format(F.timestamp_millis(epoch_ms(iso)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def key_faults(document: str | Column, expected: list[str]) -> Column:
    """Names of the keys that a JSON object lacks or has beside the expected ones, sorted; null if it is no object."""
    keys = F.json_object_keys(col(document))
    want = F.array(*[F.lit(k) for k in expected])
    return F.array_sort(F.array_union(F.array_except(want, keys), F.array_except(keys, want)))


def text_fault(value: str | Column) -> Column:
    """'null', 'blank' or 'untrimmed', or null for sound text."""
    value = col(value)
    return F.when(value.isNull(), "null").when(stripped(value) == "", "blank").when(stripped(value) != value, "untrimmed")


def array_fault(values: str | Column) -> Column:
    """The first fault of the items of an array of texts, or 'duplicate'."""
    values = col(values)
    first = F.try_element_at(F.filter(F.transform(values, text_fault), lambda x: x.isNotNull()), F.lit(1))
    return F.when(values.isNull(), "null").otherwise(F.coalesce(first, F.when(F.size(F.array_distinct(values)) < F.size(values), "duplicate")))


def layer_faults(document: str | Column, geometry_type: str, id_field: str, fields: list[str]) -> Column:
    """What is wrong with the JSON description of a source's layer: its geometry type, object-id field, requested fields that it lacks, a maximum count that is not positive."""
    d = F.from_json(col(document), "struct<geometryType:string,objectIdField:string,fields:array<struct<name:string>>,maxRecordCount:string>")
    names = F.transform(d["fields"], lambda f: f["name"])
    lacking = F.array_except(F.array(*map(F.lit, fields)), F.coalesce(names, F.array().cast("array<string>")))
    rules = [
        F.when(~d["geometryType"].eqNullSafe(F.lit(geometry_type)), "geometry_type"), F.when(~d["objectIdField"].eqNullSafe(F.lit(id_field)), "object_id_field"),
        F.when(F.size(lacking) > 0, F.concat(F.lit("fields "), F.array_join(F.array_sort(lacking), " "))), F.when(~F.coalesce(object_id(d["maxRecordCount"]) > 0, F.lit(False)), "max_count"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


# The colours of the classes.
COLOURS = {"Unclassified": "gray", "Other": "red", "Condominium": "green", "Apartments": "yellow"}


def colour(classification: str | Column) -> Column:
    """The colour of a class; that of unclassified for others."""
    known = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, col(classification)), F.lit(COLOURS["Unclassified"]))
