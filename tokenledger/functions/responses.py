"""Provider response parsing (P14 provider-B normalisation, P15 provider-A usage).

Responses arrive as JSON text; ``from_json`` with a fixed schema parses them
JVM-side, and the normalised record is a struct column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

B_SCHEMA = ("struct<id:string,model:string,"
            "content:array<struct<type:string,text:string>>,"
            "usage:struct<input_tokens:bigint,output_tokens:bigint>>")
A_SCHEMA = ("struct<id:string,object:string,model:string,"
            "choices:array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>,"
            "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_b(raw) -> Column:
    return F.from_json(_col(raw), B_SCHEMA)


def parse_a(raw) -> Column:
    return F.from_json(_col(raw), A_SCHEMA)


def normalize_b(raw) -> Column:
    """Provider-B response -> provider-A shape.

    Text blocks are concatenated with no separator; usage input/output become
    prompt/completion/total, 0 when absent; created=0, finish_reason='stop'.
    """
    r = parse_b(raw)
    text = F.array_join(F.transform(
        F.filter(F.coalesce(r["content"], F.array().cast("array<struct<type:string,text:string>>")),
                 lambda b: F.coalesce(b["type"], F.lit("")) == "text"),
        lambda b: F.coalesce(b["text"], F.lit(""))), "")
    pt = F.when(r["usage"].isNull(), F.lit(0)).otherwise(F.coalesce(r["usage"]["input_tokens"], F.lit(0))).cast("bigint")
    ct = F.when(r["usage"].isNull(), F.lit(0)).otherwise(F.coalesce(r["usage"]["output_tokens"], F.lit(0))).cast("bigint")
    return F.struct(
        F.coalesce(r["id"], F.lit("")).alias("id"),
        F.lit("chat.completion").alias("object"),
        F.lit(0).cast("bigint").alias("created"),
        F.coalesce(r["model"], F.lit("")).alias("model"),
        F.array(F.struct(F.lit(0).alias("index"),
                         F.struct(F.lit("assistant").alias("role"), text.alias("content")).alias("message"),
                         F.lit("stop").alias("finish_reason"))).alias("choices"),
        F.struct(pt.alias("prompt_tokens"), ct.alias("completion_tokens"),
                 (pt + ct).alias("total_tokens")).alias("usage"),
    )


def native_record(raw) -> Column:
    """Provider-A response as stored and returned.

    A missing response becomes {id:'', object:'chat.completion', choices:[],
    usage:null}; absent fields read the same way; a usage of null stays null.
    """
    r = parse_a(raw)
    none = F.array().cast("array<struct<index:int,message:struct<role:string,content:string>,finish_reason:string>>")
    return F.struct(
        F.coalesce(r["id"], F.lit("")).alias("id"),
        F.coalesce(r["object"], F.lit("chat.completion")).alias("object"),
        F.coalesce(r["model"], F.lit("")).alias("model"),
        F.coalesce(r["choices"], none).alias("choices"),
        r["usage"].alias("usage"),
    )


def native_usage(raw) -> Column:
    """The record, with prompt/completion tokens that read 0 when usage is absent."""
    r = native_record(raw)
    return r.withField("n_choices", F.size(r["choices"])) \
            .withField("prompt_tokens", F.coalesce(r["usage"]["prompt_tokens"], F.lit(0)).cast("bigint")) \
            .withField("completion_tokens", F.coalesce(r["usage"]["completion_tokens"], F.lit(0)).cast("bigint"))
