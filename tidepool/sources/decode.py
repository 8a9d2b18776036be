"""Decoders: frames, routing, tagged JSON/XML messages and the three batch
shapes (S1-S9, P1-P3, P5, F1, F2).

JSON is parsed once into ``VARIANT`` (``try_parse_json``) and every decision
that depends on a JSON *type* (text id vs number id, number vs numeric text,
array vs string-encoded inner data) is taken with ``schema_of_variant`` --
never by running two parsers over the same text.  Everything but XML of unknown
fields is a built-in expression; rows that cannot be decoded get a ``reject_reason`` instead of
being silently dropped, and ``split_rejects`` turns that into a dead-letter
table (S9).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.scalar import evaluated_once
from tidepool.schema import ID_FIELD, ID_FIELD_ALT, TYPE_FIELD, VALUE_FIELD, VALUE_FIELD_ALT, DATA_FIELD, GATEWAY_FIELD, TIME_FIELD, MESSAGE_CODES, UNKNOWN_ID

NUMERIC_TEXT = r"^\s*[+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?\s*$"
SPECIAL_TEXT = r"(?i)^\s*[+-]?(nan|infinity)\s*$"


# --------------------------------------------------------------------------
# Frames, routing, dead letters
# --------------------------------------------------------------------------

def decode_frames(df: DataFrame, col: str = "frame") -> DataFrame:
    """4-byte little-endian signed code + UTF-8 payload.  Frames shorter
    than 4 bytes get ``reject_reason = 'malformed frame'``."""
    b = F.col(col)
    ok = b.isNotNull() & (F.length(b) >= 4)
    h = F.hex(F.substring(b, 1, 4))
    le = F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    u = F.conv(le, 16, 10).cast("long")
    code = F.when(u >= F.lit(2 ** 31), u - F.lit(2 ** 32)).otherwise(u).cast("int")
    payload = F.make_valid_utf8(F.substr(b, F.lit(5)).cast("string"))   # U+FFFD for invalid bytes
    return (df.withColumn("code", F.when(ok, code))
              .withColumn("payload", F.when(ok, payload))
              .withColumn("reject_reason", F.when(~ok, F.lit("malformed frame"))))


def route_messages(df: DataFrame, code_col: str = "code") -> DataFrame:
    """Message kind by code (a fixed table inlined as a map literal);
    unknown codes are rejected with a reason."""
    table = F.create_map(*[x for c, k in MESSAGE_CODES for x in (F.lit(c), F.lit(k))])
    kind = table[F.col(code_col)]
    reason = F.col("reject_reason") if "reject_reason" in df.columns else F.lit(None).cast("string")
    return (df.withColumn("kind", kind)
              .withColumn("reject_reason",
                          F.coalesce(reason, F.when(kind.isNull(), F.lit("unknown code")))))


def split_rejects(df: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters with their reason)."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


# --------------------------------------------------------------------------
# Tagged messages
# --------------------------------------------------------------------------

def detect_format(df: DataFrame, col: str = "message") -> DataFrame:
    """``XML:``/``JSON:`` prefix (case-sensitive) -> ``format`` and
    ``content``; no prefix means JSON."""
    m = F.col(col)
    xml = m.startswith("XML:")
    js = m.startswith("JSON:")
    return (df.withColumn("format", F.when(xml, F.lit("XML")).otherwise(F.lit("JSON")))
              .withColumn("content", F.when(xml, F.substr(m, F.lit(5)))
                                      .when(js, F.substr(m, F.lit(6))).otherwise(m)))


def json_to_map(col: str | Column) -> Column:
    """A flat JSON object as ``map<string,string>`` (numbers keep their
    text; of a name that is repeated the last value counts); malformed text -> NULL (the caller
    decides: empty or dead letter)."""
    c = F.col(col) if isinstance(col, str) else col
    entries = F.map_entries(F.from_json(c, "map<string,string>"))     # holds every occurrence
    names = F.transform(entries, lambda e: e["key"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["key"]))
    return F.map_from_entries(last)


def _xml_reader():
    """XML documents to their fields, in Arrow batches.  Made inside a function, so that it goes to the workers by value."""

    def fields(text: str | None) -> dict[str, str] | None:
        from xml.parsers import expat

        out: dict[str, str] = {}
        depth, name, parts, run, literal = 0, "", [], [], False

        def end_of_run() -> None:
            # white space between tags is no text, unless in a CDATA section
            if literal or "".join(run).strip(" \t\r\n"):
                parts.extend(run)
            run.clear()

        def start(tag: str, attributes: dict[str, str]) -> None:
            nonlocal depth, name
            end_of_run()
            depth += 1
            if depth == 1:
                out.update(attributes)
            elif depth == 2:
                name = tag
                parts.clear()

        def end(tag: str) -> None:
            nonlocal depth
            end_of_run()
            if depth == 2:
                out[name] = "".join(parts)
            depth -= 1

        def section(begins: bool):
            def at_edge() -> None:
                nonlocal literal
                end_of_run()
                literal = begins
            return at_edge

        def refuse(*_) -> None:
            raise ValueError("document types are not read")

        if text is None:
            return None
        parser = expat.ParserCreate("utf-8")
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, run.append
        parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = section(True), section(False)
        parser.StartDoctypeDeclHandler = refuse
        try:
            parser.Parse(text.encode(), True)
        except (expat.ExpatError, ValueError):
            return None
        return out

    def run_batch(texts: pd.Series) -> pd.Series:
        return texts.map(fields, na_action=None)

    return F.pandas_udf(run_batch, "map<string,string>")


def xml_to_map(col: str | Column) -> Column:
    """An XML document -> ``map<string,string>`` of the root element's
    attributes and its child elements, each with all the text inside it (of nested elements
    too, in document order), character references resolved, CDATA sections
    taken literally, names as written (with their prefix); later entries overwrite earlier ones of the same
    name.  An empty root gives an empty map; a text that is no well-formed document, or declares a
    document type, NULL."""
    return _xml_reader()(F.col(col) if isinstance(col, str) else col)


# Fields of a sensor reading document: (name, is_attribute).
SENSOR_XML_FIELDS = ((ID_FIELD, True), (TYPE_FIELD, False), (VALUE_FIELD, False))


def xml_fields_struct(col: str | Column, fields=SENSOR_XML_FIELDS) -> Column:
    """S7 with a known field list: Spark's XML reader (``from_xml``) with a
    flat schema, attributes as ``_name``."""
    c = F.col(col) if isinstance(col, str) else col
    schema = ", ".join(f"`{'_' if attr else ''}{name}` string" for name, attr in fields)
    return F.from_xml(c, schema, {"mode": "PERMISSIVE"})


def xml_struct_to_map(s: Column, fields=SENSOR_XML_FIELDS) -> Column:
    """The fields present in a parsed document as a key/value map; NULL when
    no field could be read (undecodable text)."""
    m = F.map_filter(F.create_map(*[x for name, attr in fields
                                    for x in (F.lit(name), s.getField(("_" if attr else "") + name))]),
                     lambda k, v: v.isNotNull())
    return F.when(F.size(m) > 0, m)


def decode_tagged(df: DataFrame, col: str = "message", xml_fields=SENSOR_XML_FIELDS) -> DataFrame:
    """S6 + S7 + S8: format detection then the flat decoder of that format;
    ``fields`` is the key/value map, NULL (with a reject reason) when the
    content does not parse.  XML documents are read with Spark's XML reader
    for the given field list, or with the schema-less ``xml_to_map`` when
    ``xml_fields`` is None (slower: a parser in Python workers)."""
    d = detect_format(df, col)
    if xml_fields is None:
        xml = xml_to_map("content")
    else:
        # parse once per row into a struct column, then read its fields
        d = d.withColumn("_xml", F.when(F.col("format") == "XML", xml_fields_struct("content", xml_fields)))
        xml = xml_struct_to_map(F.col("_xml"), xml_fields)
    fields = F.when(F.col("format") == "XML", xml).otherwise(json_to_map("content"))
    d = evaluated_once(d, {"fields": fields}).drop("_xml")
    return d.withColumn("reject_reason", F.when(F.col("fields").isNull(), F.lit("undecodable message")))


def reading_from_fields(df: DataFrame, fields: str = "fields", compat: bool = False) -> DataFrame:
    """P7 over a decoded message: ``device_id`` (missing/NULL -> "Unknown"),
    ``data_type``, lenient ``value`` (P3).  With ``compat=True`` an undecodable
    message becomes an empty reading ("Unknown", NULL type, 0.0) as the
    original gateway does; otherwise it keeps its reject reason."""
    m = F.col(fields)
    if compat:
        m = F.coalesce(m, F.create_map().cast("map<string,string>"))
        df = df.withColumn("reject_reason", F.lit(None).cast("string"))
    dev = F.coalesce(m.getItem(ID_FIELD), F.lit(UNKNOWN_ID))
    return (df.withColumn("device_id", dev)
              .withColumn("data_type", m.getItem(TYPE_FIELD))
              .withColumn("value", lenient_number_text(m.getItem(VALUE_FIELD))))


# --------------------------------------------------------------------------
# Id and value extraction
# --------------------------------------------------------------------------

def _vtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is_number_type(t: Column) -> Column:
    return t.isin("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE") | t.startswith("DECIMAL")


def strict_number_text(c: Column) -> Column:
    """Invariant-culture double parse of a text: sign, digits, optional point
    and exponent, surrounding blanks, or NaN/Infinity; NULL otherwise.  (A
    bare cast would also accept ``1d``/``1f``.)"""
    ok = c.rlike(NUMERIC_TEXT) | c.rlike(SPECIAL_TEXT)
    return F.when(ok, F.trim(c).try_cast("double"))


def lenient_number_text(c: Column) -> Column:
    """P3 on a text value: parsed when numeric, else 0.0 (missing too)."""
    return F.coalesce(strict_number_text(c), F.lit(0.0))


def device_id_of(item: Column) -> Column:
    """``WavyId`` if it is a JSON string, else ``wavyId`` if it is a
    string; empty or missing -> "Unknown"."""
    a = F.try_variant_get(item, f"$.{ID_FIELD}", "string")
    b = F.try_variant_get(item, f"$.{ID_FIELD_ALT}", "string")
    pick = (F.when(_vtype(item, f"$.{ID_FIELD}") == "STRING", a)
             .when(_vtype(item, f"$.{ID_FIELD_ALT}") == "STRING", b))
    return F.when((pick.isNull()) | (pick == ""), F.lit(UNKNOWN_ID)).otherwise(pick)


def _number_of(item: Column, path: str) -> Column:
    t = _vtype(item, path)
    return (F.when(_is_number_type(t), F.try_variant_get(item, path, "double"))
             .when(t == "STRING", strict_number_text(F.try_variant_get(item, path, "string"))))


def strict_value_of(item: Column) -> Column:
    """``Value`` if present (only it), else ``value``; a JSON number or a
    numeric text; anything else -> NULL (the item is rejected)."""
    has_upper = F.try_variant_get(item, f"$.{VALUE_FIELD}", "variant").isNotNull()
    has_lower = F.try_variant_get(item, f"$.{VALUE_FIELD_ALT}", "variant").isNotNull()
    return (F.when(has_upper, _number_of(item, f"$.{VALUE_FIELD}"))
             .when(has_lower, _number_of(item, f"$.{VALUE_FIELD_ALT}")))


def lenient_value_of(item: Column) -> Column:
    """``Value`` as a number or numeric text, else 0.0."""
    return F.coalesce(_number_of(item, f"$.{VALUE_FIELD}"), F.lit(0.0))


def lenient_device_of(item: Column) -> Column:
    """P3 companion: ``WavyId`` text as is (empty kept), missing/null ->
    "Unknown"; a non-text id makes the item unreadable (NULL)."""
    t = _vtype(item, f"$.{ID_FIELD}")
    return (F.when(t.isNull() | (t == "NULL_TYPE") | (t == "VOID"), F.lit(UNKNOWN_ID))
             .when(t == "STRING", F.try_variant_get(item, f"$.{ID_FIELD}", "string")))


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


# --------------------------------------------------------------------------
# Batch parsers
# --------------------------------------------------------------------------

def _last_of_repeated_names(df: DataFrame) -> None:
    """Lets the JSON parser take the last value of a repeated name, where it would reject the text."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _batch_items(df: DataFrame, col: str, id_required: bool) -> DataFrame:
    """One row per item of a batch (``_v`` batch, ``_it`` item, ``item_index``), and one
    per batch that is rejected as a whole; ``reject_reason`` says why (F1, F2, S9)."""
    _last_of_repeated_names(df)
    d = evaluated_once(df, {"_v": F.try_parse_json(F.col(col))})
    v = F.col("_v")
    id_kind = _vtype(v, f"$.{ID_FIELD}")
    data = F.try_variant_get(v, f"$.{DATA_FIELD}", "array<variant>")
    id_ok = F.coalesce(id_kind == "STRING", F.lit(not id_required))
    reason = (F.when(v.isNull(), F.lit("malformed json"))
               .when(~id_ok | data.isNull(), F.lit(f"missing {ID_FIELD} or {DATA_FIELD}")))
    d = evaluated_once(d, {"reject_reason": reason, "_data": F.when(reason.isNull(), data),
                           "_id": F.when(id_kind == "STRING", F.try_variant_get(v, f"$.{ID_FIELD}", "string"))})
    items = (d.select("*", F.posexplode_outer("_data").alias("item_index", "_it"))
              .filter(F.col("reject_reason").isNotNull() | F.col("item_index").isNotNull()))
    it = F.col("_it")
    type_kind, value_kind = _vtype(it, f"$.{TYPE_FIELD}"), _vtype(it, f"$.{VALUE_FIELD}")
    # a value is checked where the item is rebuilt with the batch's id; as is, it is not looked at
    bad_value = F.col("_id").isNotNull() & value_kind.isNotNull() & ~_is_number_type(value_kind)
    return (items.withColumn("reject_reason", F.coalesce(
                "reject_reason",
                F.when(type_kind.isNull(), F.lit(f"missing {TYPE_FIELD}"))
                 .when(type_kind != "STRING", F.lit(f"{TYPE_FIELD} is not text"))
                 .when(bad_value, F.lit(f"{VALUE_FIELD} is not a number"))))
                 .withColumn("data_type", F.when(type_kind == "STRING", F.try_variant_get(it, f"$.{TYPE_FIELD}", "string")))
                 .drop("_data"))


def parse_device_batch(df: DataFrame, col: str = "payload") -> DataFrame:
    """S3 + F1 + F2: a device batch (text device id, list of type/value items).
    One row per item: ``device_id, data_type, value, item_index, reject_reason``.
    An item without ``Value`` is kept with a NULL value; rejected batches and
    items come out as rows with their reason (``split_rejects``)."""
    items = _batch_items(df, col, id_required=True)
    number = F.when(_is_number_type(_vtype(F.col("_it"), f"$.{VALUE_FIELD}")),
                    F.try_variant_get("_it", f"$.{VALUE_FIELD}", "double"))
    return items.withColumn("device_id", F.col("_id")).withColumn("value", number).drop("_v", "_it", "_id")


def parse_optional_batch(df: DataFrame, col: str = "payload") -> DataFrame:
    """S4 + P5: like S3 but the id may be absent.  Every accepted item is kept as
    its full property map ``item``; a batch id replaces the item's own, without
    one the item stays as it is.  Rejects as in S3."""
    items = _batch_items(df, col, id_required=False)
    props = F.try_variant_get("_it", "$", "map<string,string>")
    with_id = F.map_concat(F.map_filter(props, lambda k, _: k != F.lit(ID_FIELD)),
                           F.create_map(F.lit(ID_FIELD), F.col("_id")))
    item = F.when(F.col("reject_reason").isNull(), F.when(F.col("_id").isNull(), props).otherwise(with_id))
    return items.withColumn("item", item).drop("_v", "_it", "_id")


def parse_gateway_batch(df: DataFrame, col: str = "payload") -> DataFrame:
    """S5 + P1 + P2: a gateway batch (gateway id, ISO time, groups of type and
    inner data).  The inner data may be an array of items
    (each an object or the JSON text of one) or the JSON text of a single item.
    Returns one row per accepted measurement (``aggregator_id, batch_time,
    data_type, device_id, value``) and, with ``reject_reason`` set, one row per
    rejected group or item."""
    _last_of_repeated_names(df)
    head = evaluated_once(df, {"_v": F.try_parse_json(F.col(col))})
    groups = head.select("*", F.posexplode_outer(F.try_variant_get("_v", f"$.{DATA_FIELD}", "array<variant>"))
                         .alias("group_index", "_g"))
    g = F.col("_g")
    kind = _vtype(g, f"$.{DATA_FIELD}")
    inner = F.try_variant_get(g, f"$.{DATA_FIELD}", "variant")
    as_list = (F.when(kind.startswith("ARRAY"), F.try_variant_get(inner, "$", "array<variant>"))
                .when(kind == "STRING", F.array(F.try_parse_json(F.try_variant_get(inner, "$", "string")))))
    groups = evaluated_once(groups, {
        "aggregator_id": F.try_variant_get("_v", f"$.{GATEWAY_FIELD}", "string"),
        "batch_time": F.try_to_timestamp(F.try_variant_get("_v", f"$.{TIME_FIELD}", "string")),
        "_time": F.try_variant_get("_v", f"$.{TIME_FIELD}", "string"),
        "data_type": F.try_variant_get(g, f"$.{TYPE_FIELD}", "string"),
        "_kind": kind,
        "_glist": as_list})
    kind = F.col("_kind")
    groups = (groups.withColumn("reject_reason",
                                F.when(F.col("_v").isNull(), F.lit("malformed json"))
                                 .when(F.col("_time").isNotNull() & F.col("batch_time").isNull(), F.lit(f"bad {TIME_FIELD}"))
                                 .when(g.isNull(), F.lit("no data groups"))
                                 .when(kind.isNull(), F.lit("missing Data"))
                                 .when(F.col("_glist").isNull(), F.lit("unreadable Data"))))
    bad_groups = groups.filter(F.col("reject_reason").isNotNull())
    items = (groups.filter(F.col("reject_reason").isNull())
                   .select("*", F.posexplode(F.col("_glist")).alias("item_index", "_i0")))
    i0 = F.col("_i0")
    # an item given as JSON text is parsed once more
    item = F.when(F.schema_of_variant(i0) == "STRING",
                  F.try_parse_json(F.try_variant_get(i0, "$", "string"))).otherwise(i0)
    items = evaluated_once(items, {"_it": item})
    it = F.col("_it")
    items = evaluated_once(items, {"device_id": device_id_of(it), "value": strict_value_of(it),
                                   "_obj": _is_object(it)})
    items = items.withColumn("reject_reason",
                             F.when(it.isNull(), F.lit("unparsable item"))
                              .when(~F.col("_obj"), F.lit("item is not an object"))
                              .when(F.col("value").isNull(), F.lit("no valid value")))
    keep = ["aggregator_id", "batch_time", "data_type", "device_id", "value", "group_index",
            "item_index", "reject_reason"]
    base_cols = [c for c in df.columns]
    out_items = items.select(*base_cols, *keep)
    out_bad = (bad_groups.withColumn("device_id", F.lit(None).cast("string"))
                         .withColumn("value", F.lit(None).cast("double"))
                         .withColumn("item_index", F.lit(None).cast("int"))
                         .select(*base_cols, *keep))
    return out_items.unionByName(out_bad)
