"""Ledger maintenance: merging, upserts, imports, culls, copies. Every operator returns a new table; nothing is changed in place."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.failures import failure_scope
from tallyloom.functions.text import half_up

NAME_PARTS = r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$"


def standing() -> Column:
    """What makes an entry better: a result before none, then a newer time; the greater standing wins."""
    return F.struct(F.col("score").isNotNull().alias("has"), F.col("scored_at").isNotNull().alias("dated"), F.col("scored_at").alias("at"))


def merge_ledgers(*ledgers: DataFrame) -> DataFrame:
    """The best entry of each card over all ledgers (id, score, scored_at, source_ord); the earlier source on ties."""
    every = ledgers[0]
    for x in ledgers[1:]:
        every = every.unionByName(x, allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy("id").orderBy(standing().desc(), "source_ord"))
    return every.withColumn("rank", best).where("rank = 1").drop("rank")


def prune(ledger: DataFrame, cards: DataFrame | None) -> DataFrame:
    """Entries whose card still exists; all of them where the cards can't be listed (None)."""
    return ledger if cards is None else ledger.join(cards.select("id"), "id", "left_semi")


def merge_report(into: DataFrame, *others: DataFrame) -> DataFrame:
    """Per source: entries, cards it added, and how many of its entries beat the best one before it."""
    every = into.select("id", "score", "scored_at", "source_ord")
    for x in others:
        every = every.unionAll(x.select("id", "score", "scored_at", "source_ord"))
    before = Window.partitionBy("id").orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    rows = every.withColumn("own", standing()).withColumn("best", F.max("own").over(before))
    return rows.groupBy("source_ord").agg(F.count("*").alias("entries"), F.count_if(F.col("best").isNull()).alias("added"), F.count_if(F.col("own") > F.col("best")).alias("upgraded"))


def merge_totals(into: DataFrame, cards: DataFrame | None, *others: DataFrame) -> DataFrame:
    """One row: entries before and after a merge and prune, how many were pruned (-1 if the cards can't be listed), scored, failed."""
    merged = merge_ledgers(into, *others)
    there = merged.withColumn("here", F.lit(True)) if cards is None else merged.join(cards.select("id", F.lit(True).alias("here")), "id", "left")
    kept = F.coalesce("here", F.lit(False))
    pruned = F.lit(-1).cast("long") if cards is None else F.count_if(~kept)
    one = there.agg(F.count_if(kept).alias("after"), pruned.alias("pruned"), F.count_if(kept & F.col("score").isNotNull()).alias("scored"), F.count_if(kept & F.col("score").isNull()).alias("failed"))
    return into.agg(F.count("*").alias("before")).crossJoin(one)


def upsert_success(ledger: DataFrame, results: DataFrame, current: str = "now") -> DataFrame:
    """``results`` (id, hash, score, brief) replace entries, and the entry's other columns stay.

    A full score over a fast one of the same text keeps the fast score, stale if it was made with another prompt than
    ``current``; a fast score that is kept already stays, its staleness for good; a text that changed, or a fast score, keeps none.
    """
    new = results.select("id", F.col("hash").alias("n_hash"), F.col("score").alias("n_score"), F.col("brief").alias("n_brief"))
    both = ledger.join(new, "id", "full")
    hit, same = F.col("n_score").isNotNull(), F.col("hash").eqNullSafe(F.col("n_hash"))
    outdated = F.coalesce(F.col("prompt_hash") != current, F.lit(False))
    keeps = same & ~F.col("n_brief")
    was_fast = F.col("brief") & F.col("score").isNotNull()
    fast = F.when(~hit, F.col("fast_score")).when(keeps & was_fast, F.col("score")).when(keeps, F.col("fast_score"))
    stale = F.when(~hit, F.col("fast_stale")).when(keeps & was_fast, outdated).when(keeps, F.col("fast_stale") | outdated)
    done = {"id", "hash", "score", "error", "brief", "fast_score", "fast_stale", "prompt_hash"}
    return both.select(
        "id", F.when(hit, F.col("n_hash")).otherwise(F.col("hash")).alias("hash"), F.when(hit, F.col("n_score")).otherwise(F.col("score")).alias("score"),
        F.when(~hit, F.col("error")).alias("error"), F.when(hit, F.col("n_brief")).otherwise(F.col("brief")).alias("brief"),
        F.when(hit, F.lit(current)).otherwise(F.col("prompt_hash")).alias("prompt_hash"), fast.alias("fast_score"), F.when(fast.isNotNull(), F.coalesce(stale, F.lit(False))).alias("fast_stale"),
        *[c for c in ledger.columns if c not in done],
    )


#: What a failure without a result to keep takes from an entry: all that says how its last result was made.
RESULT = ("score", "brief", "prompt_hash", "fast_score", "fast_stale", "detail", "result", "partial")


def upsert_failure(ledger: DataFrame, failures: DataFrame, at: Column | None = None) -> DataFrame:
    """``failures`` (id, hash, status, message): one of the whole run writes nothing; a result of the same text stays and notes the error.

    An entry whose result stays keeps all its columns, and ``last_error`` and ``last_error_at`` say what failed and when (``at``). Without one,
    the entry has the error, and ``at`` as its time if the ledger has ``scored_at``; what belonged to an earlier result goes, the
    other columns (name, tokens, lineage) stay. A failure without a hash is of a card that couldn't be read: any result stays.
    """
    item = failures.where(failure_scope(F.col("status"), F.col("message")) == "item")
    new = item.select("id", F.col("hash").alias("n_hash"), F.col("message").alias("n_error"))
    both = ledger.join(new, "id", "full")
    when_ = F.lit(None).cast("timestamp") if at is None else at
    hit = F.col("n_error").isNotNull()
    same = F.col("n_hash").isNull() | F.col("hash").eqNullSafe(F.col("n_hash"))
    keep = ~hit | (F.col("score").isNotNull() & same)
    old = lambda c, kind: F.col(c) if c in ledger.columns else F.lit(None).cast(kind)
    made = {"hash": F.when(keep, F.col("hash")).otherwise(F.coalesce("n_hash", "hash")), "error": F.when(keep, F.col("error")).otherwise(F.col("n_error"))}
    made |= {c: F.when(keep, F.col(c)) for c in RESULT if c in ledger.columns}
    if "scored_at" in ledger.columns:
        made["scored_at"] = F.when(keep, F.col("scored_at")).otherwise(when_)
    noted = hit & keep
    made |= {"last_error": F.when(noted, F.col("n_error")).when(keep, old("last_error", "string")), "last_error_at": F.when(noted, when_).when(keep, old("last_error_at", "timestamp"))}
    every = [*ledger.columns, *[c for c in ("last_error", "last_error_at") if c not in ledger.columns]]
    return both.select(*[(made[c] if c in made else F.col(c)).alias(c) for c in every])


def retire_on_edit(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """The ledger after ``edits`` (id, saved_as, hash, at): an edited card has no score yet, but remembers the one before.

    Saved under its own name, a card's entry loses its result; saved as another card, it gets an entry of its own that names
    its parent. Returns id, hash, score, error, previous_score, improved_from, edited_at.
    """
    rows = ledger.select("id", "hash", "score", "error", *[F.lit(None).cast(t).alias(c) for c, t in (("previous_score", "double"), ("improved_from", "string"), ("edited_at", "timestamp"))])
    parents = edits.join(ledger.select("id", F.col("score").alias("was")), "id", "left")
    fresh = parents.select(
        F.col("saved_as").alias("id"), "hash", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("error"), F.col("was").alias("previous_score"),
        F.when(F.col("saved_as") != F.col("id"), F.col("id")).alias("improved_from"), F.col("at").alias("edited_at"),
    )
    return rows.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def lineage(ledger: DataFrame) -> DataFrame:
    """Cards that were derived from another one (improved_from), with both scores."""
    parent = ledger.select(F.col("id").alias("parent"), F.col("score").alias("parent_score"))
    return ledger.where("improved_from IS NOT NULL").join(parent, F.col("improved_from") == F.col("parent"), "left").select("id", F.col("improved_from").alias("parent"), "score", "previous_score", "parent_score")


def uplift(ledger: DataFrame) -> DataFrame:
    """id, improved_from, previous_score, score, gain, direction of the cards that were edited after they had a score.

    The gain is rounded to one decimal, halves up; direction is up, down or same, and unscored while the edited card has no score.
    """
    gain = half_up(F.col("score") - F.col("previous_score"))
    direction = F.when(F.col("gain").isNull(), "unscored").when(F.col("gain") > 0, "up").when(F.col("gain") < 0, "down").otherwise("same")
    rows = ledger.where("previous_score IS NOT NULL").withColumn("gain", gain)
    return rows.select("id", "improved_from", "previous_score", "score", "gain", direction.alias("direction"))


def cull(ledger: DataFrame, ids: DataFrame, trash: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(ledger without ``ids``, trash with them): trash rows are trash_name, id, deleted_at.

    A card keeps its name in the trash unless that name is taken there; then the time stands before it.
    """
    gone = ids.select("id").distinct().withColumn("deleted_at", at)
    taken = trash.select(F.col("trash_name").alias("taken")).distinct()
    named = gone.join(taken, F.col("id") == F.col("taken"), "left")
    stamped = F.concat(F.unix_millis("deleted_at").cast("string"), F.lit("-"), F.col("id"))
    rows = named.select(F.when(F.col("taken").isNull(), F.col("id")).otherwise(stamped).alias("trash_name"), "id", "deleted_at")
    return ledger.join(ids, "id", "left_anti"), trash.unionByName(rows)


def restore(trash: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards that come back: trash_name, id under the name without a time before it; trash without them). Scores don't come back."""
    back = trash.join(names.select("trash_name"), "trash_name", "left_semi")
    return back.select("trash_name", F.regexp_replace("trash_name", r"^\d+-", "").alias("id")), trash.join(names.select("trash_name"), "trash_name", "left_anti")


def purge(trash: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the empty trash, one row: how many were deleted)."""
    return trash.where(F.lit(False)), trash.agg(F.count("*").alias("deleted"))


def import_scores(rows: DataFrame, cards: DataFrame, ledger: DataFrame, overwrite: bool = False) -> DataFrame:
    """Outcome per imported row: matched by id, else by name if some row has no id; the last row of a card wins; full results stay.

    ``rows``: row_ord, id, name, score. A row without a score is skipped. Imported results (``partial``) may be replaced.
    """
    by_name = cards.groupBy("name").agg(F.min("id").alias("named"))
    need = rows.agg(F.max(F.col("id").isNull()).alias("by_name"))
    found = rows.crossJoin(F.broadcast(need)).join(cards.select(F.col("id").alias("own")), F.col("id") == F.col("own"), "left").join(by_name, "name", "left")
    target = F.coalesce("own", F.when(F.col("by_name"), F.col("named")))
    partial = F.col("partial") if "partial" in ledger.columns else F.lit(False)
    e = ledger.select(F.col("id").alias("target"), (F.col("score").isNotNull() & ~F.coalesce(partial, F.lit(False))).alias("full"))
    rows = found.withColumn("target", target).join(e, "target", "left")
    kept = F.coalesce("full", F.lit(False)) & F.lit(not overwrite)
    usable = F.col("target").isNotNull() & F.col("score").isNotNull() & ~kept
    last = rows.where(usable).groupBy("target").agg(F.max("row_ord").alias("last"))
    outcome = (
        F.when(F.col("target").isNull(), "not found").when(F.col("score").isNull(), "no score").when(kept, "kept").when(F.col("row_ord") < F.col("last"), "superseded").otherwise("imported")
    )
    return rows.join(last, "target", "left").select("row_ord", F.coalesce("name", "id").alias("label"), "target", "score", outcome.alias("outcome"))


def imported_ledger(outcomes: DataFrame, cards: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger (id, hash, tokens, score, error, partial, provider) with the imported scores in it.

    An imported entry has the hash of the card as it is (``cards``: id, hash, tokens), so that it isn't scored again.
    """
    new = outcomes.where("outcome = 'imported'").select(F.col("target").alias("id"), half_up(F.col("score")).alias("n_score")).join(cards.select("id", F.col("hash").alias("n_hash"), F.col("tokens").alias("n_tokens")), "id")
    had = ledger.select("id", "hash", "tokens", "score", "error", F.coalesce(F.col("provider") if "provider" in ledger.columns else F.lit(None).cast("string"), F.lit(None)).alias("provider"))
    both, hit = had.join(new, "id", "full"), F.col("n_score").isNotNull()
    pick = lambda c: F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select("id", pick("hash"), pick("tokens"), pick("score"), F.when(~hit, F.col("error")).alias("error"), hit.alias("partial"), F.when(hit, F.coalesce("provider", F.lit("recovered"))).otherwise(F.col("provider")).alias("provider"))


def import_report(outcomes: DataFrame, names: int = 10) -> DataFrame:
    """One row: imported, kept, not found, and the first missing names in the file's order."""
    missing = outcomes.where("outcome = 'not found'").orderBy("row_ord").limit(names).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", F.coalesce("label", F.lit("(unnamed)")).alias("label")))), lambda x: x["label"]), ", ").alias("missing"))
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o.replace(" ", "_"))
    return outcomes.agg(n("imported"), n("superseded"), n("kept"), n("no score"), n("not found")).crossJoin(missing)


def publish_keepers(cards: DataFrame, there: DataFrame, ledger: DataFrame, target_ledger: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    """Copying cards (id, hash) to a library that holds ``there`` (id, hash): id, copied_to, action, score_travels.

    ``source`` and ``target`` name the two libraries' folders: a library isn't copied onto itself (ValueError).

    A name that is free is copied; the same content is skipped; other content gets the smallest number from 2 on that no file
    there and no card of the batch has. A score travels unless the target's ledger has an entry under the new name.
    """
    if source is not None and target is not None and posixpath.normpath(source.rstrip("/") or "/") == posixpath.normpath(target.rstrip("/") or "/"):
        raise ValueError(f"{target} is the library that the cards come from")
    part = lambda c, n: F.regexp_extract(c, NAME_PARTS, n)
    held = there.select("id", F.col("hash").alias("t_hash"))
    used = there.select("id").unionAll(cards.select("id")).select(part("id", 1).alias("base"), part("id", 3).alias("ext"), part("id", 2).try_cast("long").alias("n")).where("n >= 2")
    used = used.groupBy("base", "ext").agg(F.collect_set("n").alias("used"))
    rows = cards.select("id", "hash").join(held, "id", "left")
    # A card's own name, whatever number it ends in, is the stem that numbers are added to.
    stem = F.regexp_replace("id", r"\.[^.]*$", "")
    rows = rows.withColumns({"stem": stem, "dot": F.regexp_extract("id", r"(\.[^.]*)$", 1)})
    rows = rows.join(used, (F.col("stem") == F.col("base")) & (F.col("dot") == F.col("ext")), "left")
    taken = F.coalesce("used", F.array().cast("array<bigint>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(2).cast("long"), F.size(taken) + 2), taken))
    action = F.when(F.col("t_hash").isNull(), "copied").when(F.col("t_hash") == F.col("hash"), "skipped").otherwise("renamed")
    name = F.when(action == "renamed", F.concat("stem", F.lit(" ("), free.cast("string"), F.lit(")"), "dot")).otherwise(F.col("id"))
    rows = rows.select("id", name.alias("name"), action.alias("action"))
    scored, has = ledger.select("id", F.lit(True).alias("scored")), target_ledger.select(F.col("id").alias("name"), F.lit(True).alias("has"))
    travels = F.col("scored").isNotNull() & F.col("has").isNull()
    return rows.join(scored, "id", "left").join(has, "name", "left").select("id", F.when(F.col("action") != "skipped", F.col("name")).alias("copied_to"), "action", travels.alias("score_travels"))
