"""Card tables: long fields, request texts, work sets and views."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.plans.bindings import FIELDS, FILLABLE, WEIGHTS

from .replies import weight_of


def blank(c: Column) -> Column:
    return T.strip(c) == ""


def fields_long(cards: DataFrame, include_fillable: bool = True, *more: str) -> DataFrame:
    """One row per non-blank field in canonical order, and per blank one worth filling: id, ord, field, weight, text, empty."""
    cells = F.array(
        *[F.struct(F.lit(k).alias("ord"), F.lit(f).alias("field"), F.lit(WEIGHTS[f]).alias("weight"), F.col(f"f{k}").alias("text"), F.lit(f in FILLABLE).alias("fillable")) for k, f in enumerate(FIELDS, 1)]
    )
    long = cards.select("id", *more, F.explode(cells).alias("c")).select("id", *more, "c.*").withColumn("empty", blank(F.col("text")))
    return long.where(~F.col("empty") | (F.col("fillable") & F.lit(include_fillable))).drop("fillable")


def missing_fields(cards: DataFrame) -> DataFrame:
    """id and the blank fields worth filling, in canonical order, joined by commas."""
    gone = [F.when(blank(F.col(f"f{k}")), F.lit(f)) for k, f in enumerate(FIELDS, 1) if f in FILLABLE]
    return cards.select("id", F.concat_ws(",", *gone).alias("missing"))


#: What each field is for, told to the scorer beside it.
ROLES = {
    "description": "who the character is; part of every prompt",
    "personality": "a summary of the character; part of every prompt",
    "scenario": "where the story begins",
    "first_mes": "the opening message, written as the character",
    "mes_example": "example dialogue; <START> begins a new example",
    "system_prompt": "stands in for the system prompt that the user has; {{original}} brings that one back in",
    "post_history_instructions": "instructions after the chat history; they weigh most",
    "alternate_greetings": "other ways to open the chat; a line of --- ends each but the last",
}
MACROS = "Macros: {{char}} and {{user}} stand for the names, {{original}} for the user's own prompt. They are no mistakes."


def edit_targets(cards: DataFrame) -> DataFrame:
    """id, ord, field, label, text, empty of the parts that an edit can point at: filled fields, and empty ones worth filling.

    A flat card (``flat``, where the column is there) has no place for a note.
    """
    long = fields_long(cards, True, *(["flat"] if "flat" in cards.columns else []))
    if "flat" in long.columns:
        long = long.where((F.col("field") != "character_note") | ~F.col("flat")).drop("flat")
    label = F.when(F.col("field") == "character_note", "character's note").otherwise(F.replace("field", F.lit("_"), F.lit(" ")))
    return long.select("id", "ord", "field", F.concat(label, F.when(F.col("empty"), " (new)").otherwise("")).alias("label"), F.when(F.col("empty"), "").otherwise(F.col("text")).alias("text"), "empty")


def note_role(depth: Column) -> Column:
    return F.concat(F.lit("an instruction put into the chat "), depth.cast("string"), F.when(depth == 1, " message").otherwise(" messages"), F.lit(" from its end"))


def heading(field: str, depth: Column, suffix: Column | str = "") -> Column:
    """A field's heading with its role; a note's names how deep it is put in."""
    role = note_role(depth) if field == "character_note" else F.lit(ROLES[field])
    return F.concat(F.lit(f"### {field} — "), role, F.lit(suffix) if isinstance(suffix, str) else suffix)


def note_depth(cards: DataFrame) -> Column:
    return F.coalesce(F.col("note_depth"), F.lit(4)) if "note_depth" in cards.columns else F.lit(4)


def build_requests(cards: DataFrame, detail: str = "full", weights: Mapping[str, float] | Column | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """id and the scorer's request: name, a note on macros, heading and text of each field that counts, in full mode the blank ones.

    ``fast`` leaves out fields without weight unless nothing else is filled; ``weights`` is a mapping or a map column of ``cards``, the
    usual ones if none are given. A card without text has a null request and a reason. With ``prompts`` (kind, instructions, fallback, form;
    one row a kind) there are also the system text for ``detail``, its instructions or else the fallback before the fixed form, and its
    hash (prompt).

    Texts are stripped once and put together once, whatever is asked of the requests: a filter on them isn't computed from the texts again.
    """
    depth = note_depth(cards)
    cards = once(cards, stripped=F.struct(*[T.strip(F.col(f"f{k}")).alias(f) for k, f in enumerate(FIELDS, 1)]))
    text = lambda f: F.col("stripped")[f]
    parts = [(f, F.concat(F.lit("\n\n"), heading(f, depth), F.lit("\n"), text(f))) for f in FIELDS]
    every = F.concat_ws("", *[F.when(text(f) != "", p) for f, p in parts])
    weighted = F.concat_ws("", *[F.when((text(f) != "") & (weight_of(weights, f) != 0), p) for f, p in parts])
    body = F.when(weighted == "", every).otherwise(weighted) if detail == "fast" else every
    flat = F.col("flat") if "flat" in cards.columns else F.lit(False)
    gone = F.concat_ws(", ", *[F.when((text(f) == "") & (F.lit(f != "character_note") | ~flat), F.lit(f)) for f in FIELDS if f in FILLABLE])
    tail = F.when(gone != "", F.concat(F.lit("\n\nEmpty fields: "), gone, F.lit("."))).otherwise("") if detail == "full" else F.lit("")
    filled = reduce(lambda a, b: a | b, [text(f) != "" for f in FIELDS])
    request = F.when(filled, F.concat(F.lit("Character name: "), F.col("name"), F.lit("\n\n" + MACROS), body, tail))
    made = once(cards, request=request, rejected=F.when(~filled, "Card has no non-empty scorable fields")).select("id", "request", "rejected")
    if prompts is None:
        return made
    said = F.when(blank(F.coalesce("instructions", F.lit(""))), F.col("fallback")).otherwise(F.col("instructions"))
    system = F.concat_ws("\n\n", said, "form")
    told = prompts.select("kind", system.alias("system"), F.substring(F.sha1(system), 1, 10).alias("prompt"))
    return made.withColumn("kind", F.lit(detail)).join(told, "kind", "left").drop("kind")


def work_set(cards: DataFrame, ledger: DataFrame, rescore: bool = False, limit: int | None = None) -> DataFrame:
    """Cards (id, hash, tokens) that are new, changed or failed, all of them with ``rescore``; the first ``limit`` by id."""
    known = ledger.select("id", F.col("hash").alias("old"), F.col("error").isNotNull().alias("failed"), F.lit(True).alias("known"))
    todo = F.lit(rescore) | F.col("known").isNull() | ~F.col("hash").eqNullSafe(F.col("old")) | F.col("failed")
    found = cards.join(known, "id", "left").where(todo).select("id", "hash", "tokens")
    return found if limit is None else found.orderBy("id").limit(limit)


def scope(cards: DataFrame, ledger: DataFrame, name: str, ids: DataFrame | None = None, rescore: bool = True, current: str = "now", limit: int | None = None) -> DataFrame:
    """Ids that a batch run takes up: selected, unscored, uncritiqued, stale or all; the first ``limit`` by id."""
    entry = ledger.select("id", "score", "error", "brief", "prompt_hash", F.lit(True).alias("known"))
    rows = cards.select("id") if ids is None else cards.select("id").join(ids, "id", "left_semi")
    rows = rows.join(entry, "id", "left")
    missing = F.col("known").isNull() | F.col("error").isNotNull()
    stale = F.col("score").isNotNull() & (F.col("prompt_hash") != current)
    test = {"selected": F.lit(True), "all": F.lit(True), "unscored": missing, "uncritiqued": F.col("score").isNull() | F.col("brief"), "stale": stale}[name]
    if not rescore and name not in ("uncritiqued", "stale"):
        test = test & missing
    found = rows.where(test).select("id", F.when(F.col("brief"), "fast").otherwise("full").alias("detail"))
    return found if limit is None else found.orderBy("id").limit(limit)


def card_summary(cards: DataFrame, ledger: DataFrame, current: str = "now") -> DataFrame:
    """One row per card with what its ledger entry says; a fast score is hidden behind a brief result."""
    some = lambda c: F.col(c) if c in ledger.columns else F.lit(None).cast("string" if c in ("provider", "improved_from") else "double").alias(c)
    entry = ledger.select(
        "id", "score", "error", "brief", "scored_at", "fast_score", "prompt_hash", F.col("fast_stale").alias("f_stale"), F.lit(True).alias("known"), *map(some, ("provider", "previous_score", "improved_from"))
    )
    e = cards.join(entry, "id", "left")
    return e.select(
        "id", "library_id", F.coalesce("name", "id").alias("name"), F.coalesce("known", F.lit(False)).alias("known"), "score", "error", F.coalesce("brief", F.lit(False)).alias("brief"), "scored_at",
        F.when(~F.col("brief"), F.col("fast_score")).alias("fast_score"),
        (F.col("score").isNotNull() & (F.col("prompt_hash") != current)).alias("stale"),
        (F.col("fast_score").isNotNull() & F.col("f_stale")).alias("fast_stale"),
        "tokens", "provider", "previous_score", "improved_from", F.col("id").rlike(r"(?i)\.png$").alias("is_image"),
    ).withColumns({"known": F.coalesce("known", F.lit(False)), "stale": F.coalesce("stale", F.lit(False)), "fast_stale": F.coalesce("fast_stale", F.lit(False))})


def prompt_stale(ledger: DataFrame, prompts: DataFrame) -> DataFrame:
    """id, stale of entries with a result: whether another prompt than the current one made it.

    ``prompts``: kind (fast or full), current and fallback hash; an entry without a hash was made with the fallback. An imported
    (``partial``) result has no prompt.
    """
    partial = F.coalesce(F.col("partial"), F.lit(False)) if "partial" in ledger.columns else F.lit(False)
    rows = ledger.withColumn("kind", F.when(F.col("brief"), "fast").otherwise("full")).join(prompts, "kind")
    return rows.select("id", (~partial & (F.coalesce("prompt_hash", "fallback") != F.col("current"))).alias("stale"))


def gap_of(summary_score: Column, fast: Column, brief: Column, fast_stale: Column) -> Column:
    """A full score less the fast one kept beside it; null unless both are there and comparable."""
    return F.when(~brief & ~fast_stale, T.half_up(summary_score - fast))


def fast_gap(summary: DataFrame) -> DataFrame:
    """How far a full score lies from the fast one kept beside it."""
    gap = gap_of(F.col("score"), F.col("fast_score"), F.col("brief"), F.col("fast_stale"))
    return summary.select("id", gap.alias("gap")).where("gap IS NOT NULL")


def fields_moved(results: DataFrame) -> DataFrame:
    """id and the fields whose full score differs from the kept fast one, as ``field: fast -> full`` in canonical order.

    ``results``: id, fields and fast_fields, both maps from field to score.
    """
    moved = [F.when(F.col("fast_fields")[f] != F.col("fields")[f], F.concat(F.lit(f + ": "), F.col("fast_fields")[f].cast("string"), F.lit(" -> "), F.col("fields")[f].cast("string"))) for f in FIELDS]
    return results.select("id", F.concat_ws(", ", *moved).alias("moved")).where("moved <> ''")


def score_band(score: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(score.isNull(), "unscored").when(score >= 8, "great").when(score >= 6, "good").when(score >= 4, "mediocre").otherwise("weak")


VIEWS = ("all", "unscored", "below4", "below6", "scored", "fast", "gap", "stale", "duplicates")


def view_test(view: str) -> Column:
    """Whether a card of a summary (with ``root``, the label of its duplicate group) shows in a result view."""
    score = F.col("score")
    gap = F.abs(gap_of(score, F.col("fast_score"), F.col("brief"), F.col("fast_stale"))) > 1
    tests = {
        "all": F.lit(True), "unscored": score.isNull() | F.col("error").isNotNull(), "below4": score < 4, "below6": score < 6, "scored": score.isNotNull(),
        "fast": F.col("brief"), "gap": gap, "stale": F.col("stale"), "duplicates": F.col("root").isNotNull(),
    }
    return F.coalesce(tests[view], F.lit(False))


def apply_view(summary: DataFrame, groups: DataFrame, view: str = "all", bucket: int | None = None, focus: str | None = None) -> DataFrame:
    """The rows that show: of one duplicate group in ``focus``, else of one score bucket (1 to 10), else of a view. Adds ``root``.

    ``groups``: id, root of the cards in duplicate groups.
    """
    rows = summary.join(groups.select("id", "root"), "id", "left")
    if focus is not None:
        return rows.where(F.col("root") == focus)
    if bucket is not None:
        return rows.where(F.least(F.lit(10), F.greatest(F.lit(1), F.floor("score"))) == bucket)
    return rows.where(view_test(view))


def view_counts(summary: DataFrame, groups: DataFrame) -> DataFrame:
    """How many cards each view shows."""
    rows = summary.join(groups.select("id", "root"), "id", "left")
    one = rows.agg(*[F.count_if(view_test(v)).alias(v) for v in VIEWS])
    return one.unpivot([], list(VIEWS), "view", "cards")
