"""Card payloads as variants: reading any of the three layouts into one schema, and patching them without loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.plans.bindings import FIELDS

# What separates greetings in their text form, and the names of layouts.
GREETING_SEPARATOR = "\n\n---\n\n"
SPEC_NESTED, SPEC_FLAT = "chara_card_v2", "chara_card_v1"
NOTE = "character_note"
GREETINGS = "alternate_greetings"
PLAIN = [f for f in FIELDS if f not in (NOTE, GREETINGS)]
MAP = "map<string,variant>"


def json_value(text: Column) -> Column:
    """The JSON value that a text is as a whole; null where it is none, or where anything follows the value."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type's name; null for a value that is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def is_object(value: Column) -> Column:
    return F.coalesce(kind(value) == "OBJECT", F.lit(False))


def truthy_text(value: Column) -> Column:
    """A value as text; absent, null, false, zero and the empty text are all empty."""
    as_text, k = F.try_variant_get(value, "$", "string"), kind(value)
    number = F.try_variant_get(value, "$", "double")
    nothing = value.isNull() | (k == "VOID") | ((k == "BOOLEAN") & (as_text == "false")) | (~k.isin("STRING", "BOOLEAN", "OBJECT", "ARRAY") & (number == 0))
    return F.when(~F.coalesce(nothing, F.lit(True)), F.coalesce(as_text, F.lit(""))).otherwise("")


def part(value: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def greetings_join(parts: Column) -> Column:
    """Greetings as one text; empty ones are left out."""
    return F.array_join(F.filter(parts, lambda x: x != ""), GREETING_SEPARATOR)


def greetings_split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n*---\n*"), T.strip), lambda x: x != "")


def normalize_cards(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, spec, name, creator, tags, f1 to f9, flat, note_depth and the payload itself (raw) of payloads (id, payload).

    Fields lie under ``data`` if that is an object, else at the root. What is absent, null, false or zero is empty; the
    note is the text of the depth prompt; greetings are joined; tags count only as an array. A payload that is no JSON
    object has a null spec and empty fields. Columns to ``keep`` are passed on.
    """
    rows = once(raw.select("id", F.col("payload").alias("raw"), *keep), v=json_value(F.col("raw")))
    rows = once(rows.withColumn("v", F.when(is_object(F.col("v")), F.col("v"))), data=part(F.col("v"), "$.data"))
    rows = once(rows, nested=is_object(F.col("data")), d=F.when(is_object(F.col("data")), F.col("data")).otherwise(F.col("v")))
    v, d = F.col("v"), F.col("d")
    data = part(v, "$.data")
    wraps = truthy_text(data) != ""
    spec = F.coalesce(F.nullif(truthy_text(part(v, "$.spec")), F.lit("")), F.when(F.col("nested") | wraps, SPEC_NESTED).otherwise(SPEC_FLAT))
    name = F.coalesce(*[F.nullif(truthy_text(part(x, "$.name")), F.lit("")) for x in (d, v)], F.lit("(unnamed)"))
    note = part(d, "$.extensions.depth_prompt.prompt")
    cells = {f: truthy_text(part(d, f"$.{f}")) for f in PLAIN}
    cells[NOTE] = F.when(kind(note) == "STRING", part(note, "$", "string")).otherwise("")
    greetings = part(d, f"$.{GREETINGS}", "array<variant>")
    cells[GREETINGS] = F.when(greetings.isNotNull(), greetings_join(F.transform(greetings, truthy_text))).otherwise("")
    tags = F.transform(part(d, "$.tags", "array<variant>"), lambda x: part(x, "$", "string"))
    depth = F.coalesce(part(d, "$.extensions.depth_prompt.depth", "double"), F.lit(4.0)).cast("int")
    return rows.select(
        "id", F.when(v.isNotNull(), spec).alias("spec"), name.alias("name"), truthy_text(part(d, "$.creator")).alias("creator"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"), *[F.coalesce(cells[f], F.lit("")).alias(f"f{k}") for k, f in enumerate(FIELDS, 1)],
        (v.isNotNull() & ~F.col("nested")).alias("flat"), depth.alias("note_depth"), "raw", *keep,
    )


def ingest_json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, quarantine) of JSON files (name, content): payloads as (id, payload), unreadable files with a reason."""
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    rows = files.where(F.col("name").rlike(r"(?i)\.json$")).select(F.col("name").alias("id"), text.alias("payload"))
    rows = once(rows, v=json_value(F.col("payload")))
    reason = F.when(F.col("v").isNull(), "not valid JSON").when(~is_object(F.col("v")), "no usable card object")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").select("id", "payload"), rows.where("reason IS NOT NULL").select("id", "reason")


def put(target: Column, new: Column) -> Column:
    """``target`` with the entries of ``new`` (maps from names to variants) in place of its own."""
    return F.map_concat(F.map_filter(target, lambda k, _: ~F.map_contains_key(new, k)), new)


def entries(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", MAP), F.expr(f"cast(map() as {MAP})"))


def variant(value: Column) -> Column:
    return value.cast("variant")


def field_patch(raw: DataFrame, patches: DataFrame) -> DataFrame:
    """(id, payload, error) of payloads (id, payload) with ``patches`` (id, fields: a map from field to text, name) in place.

    Only given fields change; every other key stays as it was. Greetings become an array; the note is put into the depth
    prompt, whose depth and role stay (4 and system where there is none); a blank name changes nothing. A nested card's
    flat copy at the root follows. A flat card has no place for a note: an error, and the payload stays.
    """
    rows = once(raw.join(patches, "id"), v=json_value(F.col("payload")))
    rows = once(rows, top=entries(F.col("v")), nested=is_object(part(F.col("v"), "$.data")))
    rows = once(rows, own=F.when(F.col("nested"), entries(part(F.col("v"), "$.data"))).otherwise(F.col("top")))
    wanted = lambda f: F.col("fields")[f]
    new_name = T.strip(F.coalesce("name", F.lit("")))
    none = F.expr(f"cast(map() as {MAP})")
    changes = F.map_concat(
        F.transform_values(F.map_filter("fields", lambda k, x: k.isin(*PLAIN) & x.isNotNull()), lambda _, x: variant(x)),
        F.when(wanted(GREETINGS).isNotNull(), F.create_map(F.lit(GREETINGS), variant(greetings_split(wanted(GREETINGS))))).otherwise(none),
        F.when(new_name != "", F.create_map(F.lit("name"), variant(new_name))).otherwise(none),
    )
    # What a lambda refers to is computed anew for each entry: every map is a column before it is put into another.
    rows = once(rows, changes=changes, extensions=entries(F.col("own")["extensions"]))
    given = F.col("extensions")["depth_prompt"]
    prompt = F.when(is_object(given), entries(given)).otherwise(F.create_map(F.lit("depth"), variant(F.lit(4)), F.lit("role"), variant(F.lit("system"))))
    rows = once(rows, prompt=prompt, words=F.create_map(F.lit("prompt"), variant(wanted(NOTE))))
    rows = once(rows, depth=F.create_map(F.lit("depth_prompt"), F.to_variant_object(put(F.col("prompt"), F.col("words")))))
    notes = F.when(wanted(NOTE).isNotNull(), F.create_map(F.lit("extensions"), F.to_variant_object(put(F.col("extensions"), F.col("depth"))))).otherwise(none)
    rows = once(rows, inner=F.map_concat("changes", notes))
    # The root's copy: texts where it has texts, greetings where it has an array, the name where it has one.
    there = lambda k: F.col("top")[k]
    copied = F.map_filter("changes", lambda k, _: F.coalesce(F.when(k == GREETINGS, kind(there(k)) == "ARRAY").when(k == "name", there(k).isNotNull()).otherwise(kind(there(k)) == "STRING"), F.lit(False)))
    rows = once(rows, outer=F.map_concat(copied, F.create_map(F.lit("data"), F.to_variant_object(put(F.col("own"), F.col("inner"))))))
    error = F.when(~is_object(F.col("v")), "not a card").when(~F.col("nested") & wanted(NOTE).isNotNull(), "a flat card has no character note")
    rows = rows.withColumn("error", error)
    made = F.when(F.col("error").isNotNull(), F.col("payload")).when(F.col("nested"), F.to_json(put(F.col("top"), F.col("outer")))).otherwise(F.to_json(put(F.col("own"), F.col("changes"))))
    return rows.select("id", made.alias("payload"), "error")
