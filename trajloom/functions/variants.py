"""JSON values as VARIANT, inside the JVM: text of contents, objects without a key, JSON as it is written elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import json_udf

#: Lists within lists of blocks that flat_text() opens by itself; json_udf.block_text() opens those that go deeper.
DEPTH = 4


def kind(v: Column) -> Column:
    """The value's type: VOID for JSON null, STRING, ARRAY<...>, OBJECT<...>, BIGINT and so on; null for no value."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def field(v: Column, name: str, type_: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", type_)


def spaced(json: Column) -> Column:
    """Compact JSON with a blank after each comma and colon that isn't in a string."""
    return F.regexp_replace(json, r'\G((?:[^",:]++|"(?:[^"\\]++|\\.)*+")*+)([,:])', "$1$2 ")


def sorted_json(v: Column) -> Column:
    """JSON with sorted keys and a blank after commas and colons."""
    return spaced(F.to_json(v))


def detail(v: Column) -> Column:
    """A detail as text: a string as it is, '' for null, else its sorted JSON."""
    return F.when(v.isNull() | (kind(v) == "VOID"), "").when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(sorted_json(v))


def without_keys(v: Column, *names: str) -> Column:
    """JSON text of an object without some of its keys."""
    return F.to_json(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin(*names)))


def _scalar(v: Column) -> Column:
    """A string as it is; null, true and false as None, True and False; numbers as JSON has them."""
    return F.when(kind(v) == "VOID", "None").when(kind(v) == "BOOLEAN", F.initcap(F.to_json(v))).when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(sorted_json(v))


def flat_text(v: Column, write=sorted_json, depth: int = DEPTH) -> Column:
    """Text of a content value: '' for null, strings as they are, objects as JSON; of a list a line for each item.

    An item is a block of type text, which gives its text, or an object with a content, which gives
    that one's text; any other item, strings among them, gives its JSON, as `write` writes it. For values of any depth see content_text().
    """

    def item(x: Column) -> Column:
        said = F.when(field(x, "text", "variant").isNull(), F.lit("")).otherwise(_scalar(field(x, "text", "variant")))
        inner = field(x, "content", "variant")
        nested = flat_text(inner, write, depth - 1) if depth > 1 else write(inner)
        return F.when(is_object(x) & (field(x, "type") == "text"), said).when(is_object(x) & inner.isNotNull(), nested).otherwise(write(x))

    items = F.try_variant_get(v, "$", "array<variant>")
    joined = F.array_join(F.transform(items, item), "\n")
    return F.when(v.isNull() | (kind(v) == "VOID"), "").when(kind(v).startswith("ARRAY"), joined).when(is_object(v), write(v)).otherwise(_scalar(v))


def content_text(v: Column, compact: bool = False) -> Column:
    """As flat_text(), for lists within lists of any depth: values with more than DEPTH of them go to one exact function outside the JVM. compact: JSON without blanks."""
    json = F.when(~kind(v).isin("STRING", "VOID"), F.to_json(v))  # most values are plain texts
    deep = F.coalesce(F.regexp_count(json, F.lit(r'"content":\[')) >= DEPTH, F.lit(False))  # in strings too, which costs time only
    return F.when(deep, json_udf.block_text(F.when(deep, json), compact)).otherwise(flat_text(v, F.to_json if compact else sorted_json))


def blocks(content: Column) -> Column:
    """array<variant> of a message's content: a string is one text block, null none, and what isn't an object is a block of type unknown."""
    odd = lambda x: F.parse_json(F.concat(F.lit('{"type":"unknown","value":'), F.to_json(x), F.lit("}")))
    said = F.parse_json(F.concat(F.lit('{"type":"text","text":'), F.to_json(content), F.lit("}")))
    items = F.transform(F.try_variant_get(content, "$", "array<variant>"), lambda x: F.when(is_object(x), x).otherwise(odd(x)))
    none = F.array().cast("array<variant>")
    return F.when(content.isNull() | (kind(content) == "VOID"), none).when(kind(content).startswith("ARRAY"), items).when(kind(content) == "STRING", F.array(said)).otherwise(F.array(odd(content)))
