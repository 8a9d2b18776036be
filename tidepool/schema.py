"""Schemas and fixed values.

The values under "Fixed values" must equal the system being reproduced for
results to match; they are stated plainly here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Range rules per data type: (data_type, min, max).  Types not listed are
# unbounded (never clamped).
DEFAULT_RULES = [
    ("Temperature", -10.0, 50.0),
    ("Frequency", 10.0, 1000.0),
    ("WindSpeed", 0.0, 150.0),
    ("Decibels", 0.0, 200.0),
]

# Message codes of the framed protocol: (code, kind).
MESSAGE_CODES = [
    (101, "connect"),
    (102, "connect"),
    (200, "device_data"),
    (201, "device_data"),
    (202, "device_data_resend"),
    (301, "gateway_data"),
    (302, "gateway_data_resend"),
    (401, "ack"),
    (402, "ack"),
    (501, "disconnect"),
    (502, "disconnect"),
]

# Validation message texts ("{}" takes the bound, printed without a trailing ".0").
MSG_VALID = "Valid data"
MSG_BELOW = "Value below minimum ({}), set to minimum"
MSG_ABOVE = "Value above maximum ({}), set to maximum"
MSG_NONFINITE = "Invalid value (NaN or Infinity), replaced with average"
MSG_ANOMALY = ("Possible anomaly: value deviates significantly from history "
               "(mean: {}, stddev: {})")

# Batch status: (name, code, message).
STATUS_OK = ("OK", 0, "All data valid")
STATUS_INVALID = ("INVALID", 1, "Invalid data detected")
STATUS_PARTIAL = ("PARTIALLY_VALID", 2, "Some data items required correction")

# Wire-format names of the messages (JSON properties, XML elements).
ID_FIELD = "WavyId"                 # device id
ID_FIELD_ALT = "wavyId"             # device id, second spelling accepted by the server
TYPE_FIELD = "DataType"
VALUE_FIELD = "Value"
VALUE_FIELD_ALT = "value"           # value, second spelling accepted by the server
DATA_FIELD = "Data"
GATEWAY_FIELD = "AggregatorId"
TIME_FIELD = "Timestamp"
XML_READING_ROOT = "SensorData"
XML_REQUEST_ROOT = "Request"
REQUEST_ACTION_FIELD = "action"
REQUEST_TYPE_FIELD = "dataType"
XML_DECLARATION = '<?xml version="1.0" encoding="utf-16"?>'

# Default subscription set of a gateway.
DEFAULT_SUBSCRIPTIONS = ["Temperature", "Frequency"]

# History lengths and thresholds.
HISTORY_SIZE = 100          # values kept per (device, type)
MIN_ANOMALY_HISTORY = 5     # values needed before the 3-sigma check
ANOMALY_SIGMAS = 3.0
INACTIVITY_HOURS = 1
GATEWAY_FLUSH = "30 seconds"
DEVICE_INTERVAL = "7 seconds"
UNKNOWN_ID = "Unknown"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

READING = T.StructType([
    T.StructField("device_id", T.StringType()),
    T.StructField("data_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

RULES = T.StructType([
    T.StructField("data_type", T.StringType()),
    T.StructField("min_value", T.DoubleType()),
    T.StructField("max_value", T.DoubleType()),
])
