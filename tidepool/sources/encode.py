"""Encoders: frames, JSON and XML messages, device and gateway batches
(S1 inverse, S10-S12).  All text is assembled with built-in string functions
so the output is byte-exact and stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.schema import TIME_FIELD, XML_DECLARATION, XML_READING_ROOT, XML_REQUEST_ROOT, REQUEST_ACTION_FIELD, REQUEST_TYPE_FIELD, ID_FIELD, TYPE_FIELD, VALUE_FIELD, DATA_FIELD, GATEWAY_FIELD

from tidepool.functions.scalar import plain_number_text

XML_NEWLINE = "\n"
XML_INDENT = "  "


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_string(c: str | Column) -> Column:
    """A JSON string literal (quoted and escaped) of a text column."""
    return F.regexp_extract(F.to_json(F.array(_c(c))), r"^\[([\s\S]*)\]$", 1)


def encode_frame(code: str | Column, payload: str | Column) -> Column:
    """S1 inverse: 4-byte little-endian code followed by the UTF-8 payload."""
    h = F.lpad(F.hex(F.pmod(_c(code).cast("long"), F.lit(2 ** 32))), 8, "0")
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.concat(F.unhex(le), F.encode(_c(payload), "UTF-8"))


def reading_json(data_type: str | Column, value: str | Column, device: str | Column) -> Column:
    """The reading as compact JSON: type, value, device id, in that order."""
    return F.to_json(F.struct(_c(data_type).alias(TYPE_FIELD), _c(value).alias(VALUE_FIELD),
                              _c(device).alias(ID_FIELD)))


def xml_escape(c: str | Column, attribute: bool = False) -> Column:
    c = F.regexp_replace(_c(c), "&", "&amp;")
    c = F.regexp_replace(c, "<", "&lt;")
    c = F.regexp_replace(c, ">", "&gt;")
    if attribute:
        c = F.regexp_replace(c, '"', "&quot;")
    return c


def reading_xml(data_type: str | Column, value_text: str | Column, device: str | Column,
                root: str = XML_READING_ROOT, id_attr: str = ID_FIELD) -> Column:
    """An indented XML document with the device id as attribute of the
    root and the other fields as child elements."""
    nl, ind = F.lit(XML_NEWLINE), F.lit(XML_INDENT)
    return F.concat(
        F.lit(XML_DECLARATION), nl,
        F.lit(f'<{root} {id_attr}="'), xml_escape(device, attribute=True), F.lit('">'), nl,
        ind, F.lit("<DataType>"), xml_escape(data_type), F.lit("</DataType>"), nl,
        ind, F.lit("<Value>"), xml_escape(value_text), F.lit("</Value>"), nl,
        F.lit(f"</{root}>"))


def request_xml(action: str | Column, data_type: str | Column) -> Column:
    """S11 request form: ``<Request><action/><dataType/></Request>``."""
    nl, ind = F.lit(XML_NEWLINE), F.lit(XML_INDENT)
    r, a, t = XML_REQUEST_ROOT, REQUEST_ACTION_FIELD, REQUEST_TYPE_FIELD
    return F.concat(F.lit(XML_DECLARATION), nl, F.lit(f"<{r}>"), nl,
                    ind, F.lit(f"<{a}>"), xml_escape(action), F.lit(f"</{a}>"), nl,
                    ind, F.lit(f"<{t}>"), xml_escape(data_type), F.lit(f"</{t}>"), nl,
                    F.lit(f"</{r}>"))


def number_text(c: str | Column) -> Column:
    """Shortest text of a number (integral doubles without ``.0``)."""
    return plain_number_text(_c(c).cast("double"))


def tag_message(fmt: str | Column, payload: str | Column) -> Column:
    """S12/S6 inverse: ``XML:`` or ``JSON:`` in front of the payload."""
    return F.concat(_c(fmt), F.lit(":"), _c(payload))


def device_batches(df: DataFrame, batch_cols, device: str = "device_id",
                   type_col: str = "data_type", value: str = "value",
                   order: str = "seq") -> DataFrame:
    """One device batch per (batch, device):
    device id and a list of (type, value) items; items ordered by
    ``order``.  A batch holds one device's readings of one interval."""
    item = F.struct(F.col(order).alias("_o"), F.col(type_col).alias(TYPE_FIELD),
                    F.col(value).alias(VALUE_FIELD))
    g = df.groupBy(*batch_cols, device).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    data = F.transform("_items", lambda x: F.struct(x[TYPE_FIELD].alias(TYPE_FIELD), x[VALUE_FIELD].alias(VALUE_FIELD)))
    return g.select(*batch_cols, device,
                    F.to_json(F.struct(F.col(device).alias(ID_FIELD), data.alias(DATA_FIELD))).alias("payload"))


def gateway_batches(df: DataFrame, batch_cols, gateway: str = "gateway_id",
                    type_col: str = "data_type", value: str = "value", device: str = "device_id",
                    time_col: str = "ts", order: str = "seq", text_items: Column | None = None) -> DataFrame:
    """Gateway envelopes per (gateway, batch):
    gateway id, ISO time, and per type a list of (value, device id) items.

    ``Timestamp`` is the batch's first reading time in ISO-8601.  When
    ``text_items`` (a boolean column) is true for an item, that item is sent as
    the JSON text of its object; a group of one item is sent as the JSON text
    of that item instead of an array -- both shapes occur on the wire."""
    flag = text_items if text_items is not None else F.lit(False)
    obj = F.to_json(F.struct(F.col(value).cast("double").alias(VALUE_FIELD), F.col(device).alias(ID_FIELD)))
    elem = F.when(flag, json_string(obj)).otherwise(obj)
    per_type = (df.groupBy(gateway, *batch_cols, type_col)
                  .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), elem.alias("e"),
                                                            obj.alias("o")))).alias("_items"),
                       F.min(time_col).alias("_t0")))
    inner = F.when(F.size("_items") == 1, json_string(F.col("_items")[0]["o"])).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("_items", lambda x: x["e"]), ","), F.lit("]")))
    group = F.concat(F.lit(f'{{"{TYPE_FIELD}":'), json_string(type_col), F.lit(f',"{DATA_FIELD}":'),
                     inner, F.lit("}"))
    per_type = per_type.select(gateway, *batch_cols, type_col, "_t0", group.alias("_grp"))
    env = per_type.groupBy(gateway, *batch_cols).agg(
        F.array_sort(F.collect_list(F.struct(F.col(type_col).alias("_k"), F.col("_grp").alias("g")))).alias("_gs"),
        F.min("_t0").alias("batch_time"))
    iso = F.date_format(F.col("batch_time").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    payload = F.concat(F.lit(f'{{"{GATEWAY_FIELD}":'), json_string(F.col(gateway).cast("string")),
                       F.lit(f',"{TIME_FIELD}":'), json_string(iso),
                       F.lit(f',"{DATA_FIELD}":['), F.array_join(F.transform("_gs", lambda x: x["g"]), ","),
                       F.lit("]}"))
    return env.select(gateway, *batch_cols, "batch_time", payload.alias("payload"))
