"""JSON payloads and event streams: input segments, output segments, assembled text.

Payloads are parsed once into VARIANT and walked with ``variant_explode``-free
higher-order functions over the two shapes that occur: a string, and a list of
messages whose content is a string or a list of parts. Deeper nesting of
``content`` isn't followed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardframe.operators.requests import normalized_role

_PART = "struct<type:string,text:string>"
_ITEM = "struct<role:string,text:string,content:string>"


def _kind(json: Column, path: str = "$") -> Column:
    """The type of a JSON value: its schema's head in capitals, null if it is missing."""
    return F.regexp_extract(F.schema_of_variant(F.variant_get(F.try_parse_json(json), path, "variant")), r"^[A-Z]+", 0)


def _single(json: Column) -> Column:
    """Whether a text is exactly one JSON value; the parser alone would ignore what follows it."""
    listed = F.try_parse_json(F.concat(F.lit("["), json, F.lit("]")))
    return listed.isNotNull() & F.variant_get(listed, "$[1]", "variant").isNull()


def input_segments(payload: Column) -> Column:
    """Array of (role, text) of a request body's ``input`` (or ``messages``), in walking order."""
    raw = F.coalesce(F.get_json_object(payload, "$.input"), F.get_json_object(payload, "$.messages"))
    is_text = _kind(payload, "$.input") == "STRING"
    user = F.lit("user")
    segment = lambda role, text: F.struct(role.alias("role"), text.alias("text"))

    def of_item(item: Column) -> Column:
        role = normalized_role(item["role"])
        parts = F.from_json(item["content"], f"array<{_PART}>")
        own = F.filter(F.array(F.when(item["text"].isNotNull(), segment(role, item["text"]))), lambda s: s.isNotNull())
        listed = F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: segment(role, p["text"]))
        below = F.when(item["content"].isNull(), F.slice(own, 1, 0)).when(item["content"].startswith("["), F.coalesce(listed, F.slice(own, 1, 0))).otherwise(F.array(segment(role, item["content"])))
        return F.concat(own, below)

    items = F.from_json(raw, f"array<{_ITEM}>")
    none = F.filter(F.array(segment(user, F.lit(""))), lambda s: F.lit(False))
    return F.when(is_text, F.array(segment(user, raw))).otherwise(F.coalesce(F.flatten(F.transform(items, of_item)), none))


OUTPUT_KINDS = ("output_text", "summary_text", "refusal", "text")


def output_segments(body: Column, checking: bool = True) -> Column:
    """Texts of a response's ``output[].content[]``; when checking, a blank type counts as
    text, and a top-level ``output_text`` is used if there is nothing else."""
    items = F.from_json(F.get_json_object(body, "$.output"), f"array<struct<content:array<{_PART}>>>")
    parts = F.flatten(F.transform(items, lambda i: F.coalesce(i["content"], F.array().cast(f"array<{_PART}>"))))
    blank = F.lit(checking)
    kept = F.filter(parts, lambda p: p["text"].isNotNull() & (F.coalesce(p["type"], F.lit("")).isin(*OUTPUT_KINDS) | (blank & (F.trim(F.coalesce(p["type"], F.lit(""))) == ""))))
    texts = F.coalesce(F.transform(kept, lambda p: p["text"]), F.array().cast("array<string>"))
    if not checking:
        return texts
    top = F.get_json_object(body, "$.output_text")
    return F.when((F.size(texts) == 0) & top.isNotNull(), F.array(top)).otherwise(texts)


def until_block(segments: DataFrame, key: str, order: str, blocked: str) -> DataFrame:
    """Segments up to and with the first that blocks; later ones are never looked at.

    One shuffle by request; a request's segments are few and meet in its window.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("__seen", F.coalesce(F.max(F.col(blocked).cast("int")).over(before), F.lit(0))).where("__seen = 0").drop("__seen")


def merged_segments(segments: DataFrame, key: str = "request_id", order: str = "segment") -> DataFrame:
    """Per request over its segments: ``decisions`` (the first action of each category),
    ``scores`` (the greatest of each name) and the summed latency. Input: (key, order,
    category, action, score, latency_ms), a row for each hit, its score under the category's name.

    Each category is reduced first, so a request's row holds one entry a category.
    """
    per_category = segments.groupBy(key, "category").agg(F.min_by("action", order).alias("action"), F.max("score").alias("score"), F.sum("latency_ms").alias("latency_ms"))
    entry = lambda value: F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("category", value))))
    return per_category.groupBy(key).agg(F.map_from_entries(entry("action")).alias("decisions"), F.map_from_entries(entry("score")).alias("scores"), F.sum("latency_ms").alias("latency_ms"))


def merged_entities(entities: DataFrame, key: str = "request_id", order: str = "segment") -> DataFrame:
    """The union of a request's entities: one row for each (type, start, end, source), with the first segment that has it."""
    return entities.groupBy(key, "entity_type", "start_byte", "end_byte", "source").agg(F.min(order).alias(order))


def merged_flags(flags: DataFrame, key: str = "request_id", order: str = "segment") -> DataFrame:
    """Per request the distinct ``flags`` (input: a row for each flag, column ``flag``), in the order in which they first occur."""
    first = flags.groupBy(key, "flag").agg(F.min(order).alias("__first"))
    return first.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__first", "flag"))), lambda x: x["flag"]).alias("flags"))


def post_checked(checks: DataFrame, key: str = "request_id", order: str = "seq") -> DataFrame:
    """Per request over the checks of its outputs: ``scores`` (the last of each name), whether any
    check redacted, the decision, and the summed latency. Input: (key, order, name, score, redacted, latency_ms)."""
    per_name = checks.groupBy(key, "name").agg(F.max_by("score", order).alias("score"), F.bool_or("redacted").alias("redacted"), F.sum("latency_ms").alias("latency_ms"))
    scores = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("name", "score")))))
    found = per_name.groupBy(key).agg(scores.alias("scores"), F.coalesce(F.bool_or("redacted"), F.lit(False)).alias("redacted"), F.sum("latency_ms").alias("latency_ms"))
    return found.withColumn("decision", F.when(F.col("redacted"), "redacted").otherwise("allow"))


def captured_text(stream: Column, most_bytes: int) -> Column:
    """The text of a stream that a post-check looks at; null if the stream was longer than what is
    captured, which is then let through unchecked."""
    return F.when(captured(stream, most_bytes), sse_text(stream))


def sse_data(chunk: Column) -> Column:
    """The data of one event: its ``data:`` lines, trimmed and joined."""
    lines = F.filter(F.split(chunk, "\n"), lambda x: x.startswith("data:"))
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(F.substring(x, 6, 1 << 30), r"^\s+|\s+$", "")), "\n")


def sse_pieces(stream: Column) -> Column:
    """Array of (text, is_delta) of a stream's events. Events end at a bare blank line."""
    data = F.filter(F.transform(F.split(stream, "\n\n"), sse_data), lambda d: (F.trim(d) != "") & (d != "[DONE]") & _single(d))
    string_at = lambda d, key: F.when(_kind(d, f"$.{key}") == "STRING", F.get_json_object(d, f"$.{key}"))

    def piece(d: Column) -> Column:
        kind = string_at(d, "type")
        completed = F.array_join(output_segments(F.get_json_object(d, "$.response"), checking=False), "")
        out = F.when((kind == "response.output_text.delta") & string_at(d, "delta").isNotNull(), F.struct(string_at(d, "delta").alias("text"), F.lit(True).alias("delta")))
        out = out.when((kind == "response.output_text.done") & string_at(d, "text").isNotNull(), F.struct(string_at(d, "text").alias("text"), F.lit(False).alias("delta")))
        out = out.when((kind == "response.completed") & (_kind(d, "$.response") == "OBJECT"), F.struct(completed.alias("text"), F.lit(False).alias("delta")))
        nested = F.when((_kind(d, "$.delta") == "OBJECT") & (_kind(d, "$.delta.text") == "STRING"), F.get_json_object(d, "$.delta.text"))
        out = out.when(nested.isNotNull(), F.struct(nested.alias("text"), F.lit(True).alias("delta")))
        whole = F.coalesce(string_at(d, "output_text"), string_at(d, "text"), F.lit(""))
        return out.otherwise(F.struct(whole.alias("text"), F.lit(False).alias("delta")))

    return F.filter(F.transform(data, piece), lambda p: p["text"] != "")


def sse_text(stream: Column) -> Column:
    """The assembled text: all deltas, or the first full text if there is no delta."""
    pieces = sse_pieces(stream)
    deltas = F.transform(F.filter(pieces, lambda p: p["delta"]), lambda p: p["text"])
    return F.when(F.size(deltas) > 0, F.array_join(deltas, "")).otherwise(F.coalesce(F.try_element_at(pieces, F.lit(1))["text"], F.lit("")))


def captured(stream: Column, most_bytes: int) -> Column:
    """Whether a stream was captured whole; a longer one is not checked at all."""
    return F.octet_length(stream) <= most_bytes
