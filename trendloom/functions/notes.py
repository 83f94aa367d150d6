"""Values of review-site notes, whose content has values in several shapes; as column expressions.

Content is a VARIANT: its JSON is parsed once, as the note is read, and each
value is then looked up in the binary form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trendloom.functions.text import strip

#: A note as the site's interface gives it.
CONTENT = "variant"
CORE = f"id:string,forum:string,number:string,tcdate:bigint,invitation:string,content:{CONTENT}"
NOTE = f"{CORE},details:struct<directReplies:array<struct<invitation:string,content:{CONTENT}>>,original:struct<{CORE}>>"


def note_value(content: Column, key: str) -> Column:
    """A value of a note's JSON content that may be bare or wrapped as {"value": ...}."""
    bare = F.get_json_object(content, f"$.{key}")
    return F.coalesce(F.get_json_object(content, f"$.{key}.value"), bare)


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _raw(content: Column, key: str) -> Column:
    """The value under the key, out of its wrapper if it has one."""
    return unwrapped(_at(content, f"$['{key}']"))


def unwrapped(v: Column) -> Column:
    """The value in {"value": ...}; a text or list as it is; null for other objects."""
    return F.when(_is_object(v), _at(v, "$.value")).otherwise(v)


def _items(v: Column) -> Column:
    """The strings of a list; null for anything else."""
    return _at(v, "$", "array<string>")


def _text(v: Column) -> Column:
    return _at(v, "$", "string")


def text_of(content: Column, key: str) -> Column:
    """A text, a list joined by "; ", or empty."""
    v = _raw(content, key)
    return F.coalesce(F.array_join(_items(v), "; "), _text(v), F.lit(""))


def list_of(content: Column, key: str) -> Column:
    """The strings of a list; a text that is not blank as a list of one."""
    v = _raw(content, key)
    return F.coalesce(_items(v), F.when(strip(_text(v)) != "", F.array(_text(v))), F.array().cast("array<string>"))


def first_text(content: Column, *keys: str) -> Column:
    """The text under the first of the keys that has one."""
    return F.coalesce(*[F.nullif(text_of(content, k), F.lit("")) for k in keys], F.lit(""))


def first_list(content: Column, *keys: str) -> Column:
    out = F.lit("")
    for k in reversed(keys):
        own = list_of(content, k)
        out = F.when(F.size(own) > 0, F.array_join(own, "; ")).otherwise(out)
    return out


def file_of(content: Column, key: str = "pdf") -> Column:
    """The address of a file: in "value" or "url" of an object, or the value itself."""
    v = _at(content, f"$['{key}']")
    inside = F.coalesce(F.nullif(_at(v, "$.value", "string"), F.lit("")), _at(v, "$.url", "string"))
    return F.coalesce(F.when(_is_object(v), inside).otherwise(_text(v)), F.lit(""))


def _fields(content: Column) -> Column:
    return _at(content, "$", "map<string,variant>")


def is_accept(content: Column) -> Column:
    """Whether any field whose name speaks of a decision or recommendation says Accept."""
    says = lambda e: F.lower(e["key"]).rlike("decision|recommend") & F.coalesce(F.contains(_text(unwrapped(e["value"])), F.lit("Accept")), F.lit(False))
    return F.coalesce(F.exists(F.map_entries(_fields(content)), says), F.lit(False))


def is_decision(reply: Column) -> Column:
    """Whether a reply is a decision by its invitation: a Decision, or a Meta_Review with a recommendation."""
    by = F.coalesce(reply["invitation"], F.lit(""))
    recommends = F.coalesce(F.arrays_overlap(F.map_keys(_fields(reply["content"])), F.array(F.lit("recommendation"), F.lit("Recommendation"))), F.lit(False))
    return by.contains("Decision") | by.contains("decision") | (by.contains("Meta_Review") & recommends)
