"""Request ingest (S1) and tenant extraction.

Raw requests are JSON bodies plus a header map. Bodies are parsed JVM-side to
VARIANT, so every field's JSON type is known before it is read: a field of the
wrong type makes the row invalid instead of turning into text or null. Numbers
and flags are read leniently, as the service does: ``"5"`` and ``5.0`` are
integers, ``"yes"`` is a flag. Absent fields take the request defaults. Rows that
lack a required field (``messages``, or ``role`` in any message), hold a wrong
type, or give an explicit null for a non-optional field (``model``, ``stream``)
are routed to a quarantine output instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger import constants as K
from tokenledger.functions.messages import MESSAGES_TYPE

_INTEGER_TEXT = r"^[+-]?[0-9]+(\.0*)?$"
#: FIXED VALUES: texts read as flags, in lower case
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")


def tenant_from_headers(headers) -> Column:
    """The X-Tenant-ID header, or 'default' only when the header is absent
    (an empty value stays empty). Header names are matched case-insensitively."""
    h = F.col(headers) if isinstance(headers, str) else headers
    # filter instead of re-keying the map: names differing only in case would
    # be duplicate keys; the first matching entry wins
    hits = F.filter(F.map_entries(h), lambda e: F.lower(e["key"]) == F.lit(K.TENANT_HEADER.lower()))
    return F.coalesce(F.get(hits, 0)["value"], F.lit(K.DEFAULT_TENANT))


def _kind(v: Column) -> Column:
    """JSON type of a VARIANT: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, ARRAY, OBJECT, VOID (JSON null); '' when absent."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit(""))


def _as(v: Column, sql_type: str) -> Column:
    return F.try_variant_get(v, "$", sql_type)


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", _as(v, "string"))


def _integer(v: Column) -> Column:
    kind, number = _kind(v), _as(v, "double")
    text = F.trim(_text(v))
    return (F.when(kind == "BIGINT", _as(v, "bigint"))
            .when(kind.isin("DECIMAL", "DOUBLE") & (number == F.floor(number)) & (F.abs(number) < 2.0**53),
                  number.cast("bigint"))
            .when(kind == "BOOLEAN", _as(v, "boolean").cast("bigint"))
            .when((kind == "STRING") & text.rlike(_INTEGER_TEXT),
                  F.regexp_extract(text, r"^[+-]?[0-9]+", 0).try_cast("bigint")))


def _number(v: Column) -> Column:
    kind = _kind(v)
    return (F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), _as(v, "double"))
            .when(kind == "STRING", F.trim(_text(v)).try_cast("double")))


def _flag(v: Column) -> Column:
    kind, number, text = _kind(v), _as(v, "double"), F.lower(_text(v))
    return (F.when(kind == "BOOLEAN", _as(v, "boolean"))
            .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE") & number.isin(0.0, 1.0), number == 1.0)
            .when(text.isin(*TRUE_TEXTS), F.lit(True)).when(text.isin(*FALSE_TEXTS), F.lit(False)))


def _optional(v: Column, read: Column) -> Column:
    """Absent, null, or of a readable type."""
    return _kind(v).isin("", "VOID") | read.isNotNull()


def ingest_requests(raw: DataFrame, body_col: str = "body", headers_col: str | None = "headers",
                    keep: tuple[str, ...] = ("request_id", "ts")) -> DataFrame:
    """Parse JSON bodies into the canonical request record.

    Adds ``valid`` (required fields present, all types right). A field of a wrong
    type reads as null (``model``, ``stream``: the default) in the quarantined
    row. Integers beyond 64 bits are invalid. Use :func:`split_valid` to separate
    the quarantine rows.
    """
    keep_cols = [c for c in keep if c in raw.columns]
    tenant = tenant_from_headers(headers_col) if headers_col else F.lit(K.DEFAULT_TENANT)
    parsed = raw.select(*keep_cols, tenant.alias("tenant_id"), F.try_parse_json(F.col(body_col)).alias("_v"),
                        F.col(body_col).alias("_body"))

    def field(name: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{name}", "variant")

    def part(m: Column, name: str) -> Column:
        return F.try_variant_get(m, f"$.{name}", "variant")

    fields = parsed.select("*", *[field(n).alias(f"_{n}") for n in
                                  ("model", "messages", "stream", "temperature", "max_tokens", "tools", "tool_choice")])
    items = F.when(_kind(F.col("_messages")) == "ARRAY", _as(F.col("_messages"), "array<variant>"))
    tools = F.when(_kind(F.col("_tools")) == "ARRAY", _as(F.col("_tools"), "array<variant>"))
    typed = fields.withColumns({"_items": items, "_tool_items": tools})
    messages = F.transform("_items", lambda m: F.struct(
        _text(part(m, "role")).alias("role"), _text(part(m, "content")).alias("content"),
        _text(part(m, "name")).alias("name"))).cast(MESSAGES_TYPE)
    message_ok = F.forall("_items", lambda m: (
        _text(part(m, "role")).isNotNull() & _optional(part(m, "content"), _text(part(m, "content")))
        & _optional(part(m, "name"), _text(part(m, "name")))))
    model, stream = F.col("_model"), F.col("_stream")
    choice = _kind(F.col("_tool_choice"))
    valid = ((_kind(F.col("_v")) == "OBJECT") & F.col("_items").isNotNull() & message_ok
             & ((_kind(model) == "") | _text(model).isNotNull()) & ((_kind(stream) == "") | _flag(stream).isNotNull())
             & _optional(F.col("_temperature"), _number(F.col("_temperature")))
             & _optional(F.col("_max_tokens"), _integer(F.col("_max_tokens")))
             & (_kind(F.col("_tools")).isin("", "VOID")
                | F.coalesce(F.forall("_tool_items", lambda t: _kind(t) == "OBJECT"), F.lit(False)))
             & choice.isin("", "VOID", "STRING", "OBJECT"))

    def json_or_text(v: Column) -> Column:
        return F.when(_kind(v) == "STRING", _as(v, "string")).when(~_kind(v).isin("", "VOID"), F.to_json(v))

    return typed.select(
        *keep_cols, "tenant_id",
        F.coalesce(_text(model), F.lit(K.DEFAULT_MODEL)).alias("model"),
        messages.alias("messages"),
        F.coalesce(_flag(stream), F.lit(False)).alias("stream"),
        _number(F.col("_temperature")).alias("temperature"),
        _integer(F.col("_max_tokens")).alias("max_tokens"),
        json_or_text(F.col("_tools")).alias("tools"),
        json_or_text(F.col("_tool_choice")).alias("tool_choice"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.col("_body").alias("raw_body"),
    )


def split_valid(ingested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) -- the same scan, two filters."""
    return ingested.filter("valid").drop("raw_body"), ingested.filter(~F.col("valid"))


# ------------------------------------------------------------------ request files
def _file_columns(lines: DataFrame, envelope: str) -> DataFrame:
    """One row per line of JSON text: ``envelope`` columns and the body as text."""
    line = F.from_json("value", envelope, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = lines.select("value", line.alias("_r"))
    return rows.select("_r.*", F.col("value").alias("raw_line"))


#: a request line: an id, the arrival time, the headers, and the body as the client sent it
REQUEST_LINE = "request_id string, ts timestamp, headers map<string,string>, body string"


def read_request_files(spark: SparkSession, path: str, envelope: str = REQUEST_LINE) -> DataFrame:
    """S1 as a source: requests in text files, a JSON object a line. A line that is no such object becomes a request
    without a body, which the type rules quarantine; its text is kept in ``raw_line``."""
    return _file_columns(spark.read.text(path), envelope)


def stream_request_files(spark: SparkSession, path: str, envelope: str = REQUEST_LINE, files_per_trigger: int = 1000
                         ) -> DataFrame:
    """``read_request_files`` as a stream of the files that arrive in the folder."""
    return _file_columns(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), envelope)


def _sorted_out(raw: DataFrame) -> DataFrame:
    keep = ("request_id", "ts", "raw_line")
    r = ingest_requests(raw, keep=keep)
    return r.withColumn("raw_body", F.when(~F.col("valid"), F.coalesce("raw_body", "raw_line"))).drop("raw_line")


def write_requests(raw: DataFrame, path: str) -> None:
    """Parse requests and write them in one pass: ``valid=true`` holds the accepted, ``valid=false`` the quarantine
    with the text of each request."""
    _sorted_out(raw).write.mode("append").partitionBy("valid").parquet(path)


def stream_requests_sink(raw: DataFrame, path: str, checkpoint: str):
    """``write_requests`` for a stream: a file sink, exactly once through its checkpoint."""
    return (_sorted_out(raw).writeStream.format("parquet").outputMode("append").partitionBy("valid")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) of what ``write_requests`` or its stream wrote."""
    rows = spark.read.parquet(path)                       # a folder's name is text
    quarantine = rows.filter("valid = 'false'").withColumn("valid", F.lit(False))
    return rows.filter("valid = 'true'").drop("valid", "raw_body"), quarantine
