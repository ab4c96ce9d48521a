"""LoRaWAN uplink messages, versions 2 and 3: one JSON text a row becomes typed, nested columns.

A message is parsed against two schemas of the same shape: one has the types of the columns, the other small variants, which tell a key
that is absent from a JSON null and a value of a wrong kind. So a value is one field of a parsed struct, and nothing is looked
up by path. All of it is native, and batches and streams go through the same code. A message that is no JSON object, or lacks a
mandatory key, or has a value of the wrong kind for one, is dropped. A JSON null counts as 0 for a number and as null for
a string; whole numbers widen to doubles.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of value kinds in an attribute's type tag.
INT_MIN, INT_MAX = -(2**31), 2**31 - 1
#: The keys of messages. `payload` is an object of any keys.
GATEWAY_V2 = "struct<gtw_id string, time string, timestamp bigint, channel int, rssi int, snr double, rf_chain int, latitude double, longitude double, altitude double>"
METADATA_V2 = f"struct<airtime bigint, time string, frequency double, modulation string, data_rate string, bit_rate double, coding_rate string, latitude double, longitude double, altitude double, gateways array<{GATEWAY_V2}>>"
MESSAGE_V2 = f"app_id string, dev_id string, hardware_serial string, payload_raw string, is_retry boolean, confirmed boolean, counter int, port int, payload_fields payload, metadata {METADATA_V2}"
IDS_V3 = "struct<device_id string, dev_eui string, join_eui string, dev_addr string, application_ids struct<application_id string>>"
PLACE_V3 = "struct<latitude double, longitude double, altitude double>"
GATEWAY_V3 = f"struct<gateway_ids struct<gateway_id string, eui string>, time string, timestamp bigint, rssi int, channel_rssi int, snr double, uplink_token string, channel_index int, location {PLACE_V3}>"
SETTINGS_V3 = "struct<data_rate map<string, struct<bandwidth bigint, spreading_factor int>>, coding_rate string, data_rate_index int, frequency string>"
UPLINK_V3 = f"struct<received_at string, consumed_airtime string, locations struct<user {PLACE_V3}>, session_key_id string, frm_payload string, f_cnt int, f_port int, decoded_payload payload, rx_metadata array<{GATEWAY_V3}>, settings {SETTINGS_V3}>"
MESSAGE_V3 = f"end_device_ids {IDS_V3}, received_at string, correlation_ids array<string>, uplink_message {UPLINK_V3}"


def typed(schema: str) -> str:
    return re.sub(r" payload(?=[,>]|$)", " string", schema)


def loose(schema: str) -> str:
    """The same shape with a variant for each value, and for each value of a payload."""
    values = re.sub(r"(?<=[ <])(string|boolean|int|bigint|double)(?=[,>]|$)(?!, struct)", "variant", schema)
    return re.sub(r" payload(?=[,>]|$)", " map<string, variant>", values)


def _number_kind(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")


def _fits(value: Column, variant: Column, what: str, mandatory: bool) -> Column:
    """Whether a value has the right kind or is a JSON null, or is absent where it may be. Numbers and booleans that don't fit
    have no typed value; any scalar has a text, and a few texts are taken for doubles, so for these the kind is asked."""
    if what == "string":
        good = F.schema_of_variant(variant) == "STRING"
    elif what == "double":
        good = value.isNotNull() & _number_kind(F.schema_of_variant(variant))
    else:
        good = value.isNotNull()
    return F.when(variant.isNull(), F.lit(not mandatory)).otherwise(F.is_variant_null(variant) | good)


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _or(value: Column, variant: Column, zero, default=None) -> Column:
    """A value; the default where the key is absent, and zero for a JSON null."""
    absent = default if isinstance(default, Column) else F.lit(default)
    return F.when(variant.isNull(), absent).when(F.is_variant_null(variant), F.lit(zero)).otherwise(value)


def attributes(texts: Column, variants: Column) -> Column:
    """array<struct<attr_name, attr_type, attr_value>> of an object: value texts are JSON, so strings keep their quotes.

    texts: the object's values as JSON texts (map<string,string>), for numbers as they were written, and for the order of its keys;
    variants: its values as variants, for their kinds.
    """

    def one(key: Column, as_text: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        tag = (
            F.when(kind == "BIGINT", F.when(F.try_variant_get(value, "$", "bigint").between(INT_MIN, INT_MAX), "Int").otherwise("Long"))
            .when(kind == "STRING", "String")
            .when(kind == "BOOLEAN", "Boolean")
            .when(kind.startswith("ARRAY"), "List")
            .when(kind.startswith("OBJECT"), "Map")
            .when(_number_kind(kind) & ~_oversized(kind), "Double")
        )
        as_json = F.when(kind == "STRING", F.to_json(value)).otherwise(as_text)
        return F.struct(key.alias("attr_name"), tag.alias("attr_type"), as_json.alias("attr_value"))

    return F.map_values(F.map_zip_with(texts, variants, one))


def _oversized(kind: Column) -> Column:
    """Whole numbers beyond 64 bits are read as decimals of 19 or more digits without a fraction."""
    return F.coalesce(F.regexp_like(kind, F.lit(r"^DECIMAL\((19|[23]\d),0\)$")), F.lit(False))


def _attributes_fit(column: str) -> Column:
    return F.coalesce(F.forall(column, lambda a: a["attr_type"].isNotNull()), F.lit(True))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a computed column. The generator makes one row of each; it is there because the optimiser doesn't move expressions
    over it, so the value is computed once, not once for each expression that it is used in."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _parsed(messages: DataFrame, value: str, schema: str) -> DataFrame:
    """Messages that are JSON with _t, their typed values, and _s, the same as variants."""
    both = F.struct(F.from_json(value, typed(schema)).alias("t"), F.from_json(value, loose(schema)).alias("s"), F.try_parse_json(value).isNotNull().alias("json"), F.json_object_keys(value).alias("keys"))
    # what has no keys is no JSON object, and isn't parsed: its mandatory keys would be missing
    rows = _once(messages.where(F.json_object_keys(value).isNotNull()), "_x", both).where("_x.json")
    return rows.select(*messages.columns, F.col("_x.t").alias("_t"), F.col("_x.s").alias("_s"), F.col("_x.keys").alias("_keys"))


def _texts(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>")


def _gateway_v2(t: Column, s: Column) -> Column:
    stamp = F.when(t["timestamp"].isNull(), F.lit(0).cast("bigint")).when(t["timestamp"].between(INT_MIN, INT_MAX), t["timestamp"] * 1000).otherwise(t["timestamp"])
    return F.struct(
        *[_or(t[c], s[c], None, "").alias(c) for c in ("gtw_id", "time")],
        stamp.alias("timestamp"),
        *[_or(t[c], s[c], zero, default).alias(c) for c, zero, default in (("channel", 0, -1), ("rssi", 0, -1), ("snr", 0.0, 0.0), ("rf_chain", 0, -1))],
        *[_or(t[c], s[c], 0.0, 0.0).alias(f"gateway_{c}") for c in ("latitude", "longitude")],
        _or(t["altitude"], s["altitude"], 0.0, 0.0).cast("string").alias("gateway_altitude"),
    )


def parse_v2(messages: DataFrame, value: str = "value") -> DataFrame:
    """The ten columns of a version 2 message; other columns of the table stay in front. The default of an absent
    metadata.airtime is the current time in milliseconds."""
    t, s = F.col("_t"), F.col("_s")
    strings, flags, numbers = ("app_id", "dev_id", "hardware_serial", "payload_raw"), ("is_retry", "confirmed"), ("counter", "port")
    rows = _parsed(messages, value, MESSAGE_V2)
    rows = rows.where(_all([_fits(t[k], s[k], kind, must) for names, kind, must in ((strings, "string", True), (flags, "boolean", True), (numbers, "int", False)) for k in names]))
    rows = rows.where(_all([t[k].isNotNull() | ~F.array_contains("_keys", k) for k in ("metadata",)] + [s["payload_fields"].isNotNull() | ~F.array_contains("_keys", "payload_fields")]))
    mt, ms = t["metadata"], s["metadata"]
    metadata = F.struct(
        _or(mt["airtime"], ms["airtime"], 0, F.unix_millis(F.current_timestamp())).alias("airtime"),
        *[_or(mt[c], ms[c], zero, default).alias(c) for c, zero, default in (("time", None, ""), ("frequency", 0.0, 0.0), ("modulation", None, ""), ("data_rate", None, ""), ("bit_rate", 0.0, 0.0), ("coding_rate", None, ""))],
        *[_or(mt[c], ms[c], 0.0, 0.0).alias(f"device_{c}") for c in ("latitude", "longitude")],
        _or(mt["altitude"], ms["altitude"], 0.0, 0.0).cast("string").alias("device_altitude"),
        F.coalesce(F.zip_with(mt["gateways"], ms["gateways"], _gateway_v2), F.array()).alias("gateways"),
    )
    rows = _once(rows, "_a", attributes(_texts(t["payload_fields"]), s["payload_fields"])).where(_attributes_fit("_a"))
    return rows.select(
        *[c for c in messages.columns if c != value],
        *[t[k].alias(k) for k in strings[:3]],
        *[_or(t[k], s[k], 0, -1).alias(k) for k in numbers],
        *[F.coalesce(t[k], F.lit(False)).alias(k) for k in flags],
        t["payload_raw"].alias("payload_raw"),
        F.col("_a").alias("attributes"),
        F.when(mt.isNotNull(), metadata).alias("metadata"),
    )


def _gateway_v3(t: Column, s: Column) -> Column:
    place, seen = t["location"], s["location"]
    return F.struct(
        *[t["gateway_ids"][c].alias(c) for c in ("gateway_id", "eui")],
        t["time"].alias("time"),
        *[_or(t[c], s[c], 0).alias(c) for c in ("timestamp", "rssi", "channel_rssi")],
        _or(t["snr"], s["snr"], 0.0).alias("snr"),
        t["uplink_token"].alias("uplink_token"),
        _or(t["channel_index"], s["channel_index"], 0).alias("channel_index"),
        *[_or(place[c], seen[c], 0.0, 0.0).alias(f"gateway_{c}") for c in ("latitude", "longitude")],
        _or(place["altitude"], seen["altitude"], 0.0, 0.0).cast("string").alias("gateway_altitude"),
    )


def parse_v3(messages: DataFrame, value: str = "value") -> DataFrame:
    """The nineteen columns of a version 3 message; other columns of the table stay in front. Gateways and transmission
    are null where their part of the message is absent; a modulation without a spreading factor has null there."""
    t, s = F.col("_t"), F.col("_s")
    ids, ut, us = ("device_id", "dev_eui", "join_eui", "dev_addr"), t["uplink_message"], s["uplink_message"]
    user, seen = ut["locations"]["user"], us["locations"]["user"]
    strings = {k: (t["end_device_ids"][k], s["end_device_ids"][k]) for k in ids} | {"application_id": tuple(x["end_device_ids"]["application_ids"]["application_id"] for x in (t, s))}
    later = {"received_at_application": (t["received_at"], s["received_at"]), "received_at_network": (ut["received_at"], us["received_at"]), "consumed_airtime": (ut["consumed_airtime"], us["consumed_airtime"])}
    rest = {k: (ut[k], us[k]) for k in ("session_key_id", "frm_payload")}
    rows = _parsed(messages, value, MESSAGE_V3)
    rows = rows.where(_all([_fits(*x, "string", True) for x in (*strings.values(), *later.values(), *rest.values())]))
    rows = rows.where(_all([_fits(user[k], seen[k], "double", True) for k in ("latitude", "longitude", "altitude")] + [_fits(ut[k], us[k], "int", False) for k in ("f_cnt", "f_port")]))
    rows = rows.where(us["decoded_payload"].isNotNull() & (t["correlation_ids"].isNotNull() | ~F.array_contains("_keys", "correlation_ids")))
    settings, rate = ut["settings"], ut["settings"]["data_rate"]
    name = F.get(F.map_keys(rate), F.lit(0))
    seen_rate = us["settings"]["data_rate"]
    transmission = F.struct(
        settings["coding_rate"].alias("coding_rate"),
        name.alias("modulation"),
        *[_or(F.element_at(rate, name)[k], F.element_at(seen_rate, name)[k], 0).alias(k) for k in ("bandwidth", "spreading_factor")],
        _or(settings["data_rate_index"], us["settings"]["data_rate_index"], 0).alias("data_rate_index"),
        settings["frequency"].alias("frequency"),
    )
    rows = _once(rows, "_a", attributes(_texts(ut["decoded_payload"]), us["decoded_payload"])).where(_attributes_fit("_a"))
    return rows.select(
        *[c for c in messages.columns if c != value],
        *[x.alias(k) for k, (x, _) in strings.items()],
        F.coalesce(t["correlation_ids"], F.array().cast("array<string>")).alias("correlation_ids"),
        *[x.alias(k) for k, (x, _) in later.items()],
        *[_or(user[k], seen[k], 0.0).alias(f"device_{k}") for k in ("latitude", "longitude")],
        _or(user["altitude"], seen["altitude"], 0.0).cast("string").alias("device_altitude"),
        ut["session_key_id"].alias("session_key_id"),
        *[_or(ut[k], us[k], 0, 0).alias(k) for k in ("f_cnt", "f_port")],
        ut["frm_payload"].alias("frm_payload"),
        F.col("_a").alias("attributes"),
        F.zip_with(ut["rx_metadata"], us["rx_metadata"], _gateway_v3).alias("gateways"),
        F.when(name.isNotNull(), transmission).alias("transmission"),
    )
