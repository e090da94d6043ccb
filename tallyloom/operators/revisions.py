"""Differences between two versions of a text by sentence and by word, and texts composed from choices."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.plans import bindings as B
from tallyloom.sources.store import written

from .alignment import Likeness, common, pairing

#: Sentences less alike than this are about different things.
ALIKE = 0.2
#: Bytes of text that Python takes up at once.
SLICE = 1 << 20
WORD = re.compile(r"(?:[^\W\d_]|\d|')+")


def numbered(*sides: list[str]) -> list[np.ndarray]:
    """Equal texts get equal numbers."""
    number: dict[str, int] = {}
    return [np.array([number.setdefault(u, len(number)) for u in side], np.int64) for side in sides]


def bags(*sides: list[str]) -> list[list[np.ndarray]]:
    """The words of each unit as numbers."""
    number: dict[str, int] = {}
    return [[np.array([number.setdefault(w, len(number)) for w in WORD.findall(u.lower())], np.int64) for u in side] for side in sides]


def gaps(pairs: list[tuple[int, int]], n: int, m: int) -> Iterator[tuple[range, range, tuple[int, int] | None]]:
    """What lies before each pair on both sides, and the pair; at last what lies after all."""
    i = j = 0
    for a, b in pairs:
        yield range(i, a), range(j, b), (a, b)
        i, j = a + 1, b + 1
    yield range(i, n), range(j, m), None


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``SLICE`` bytes and of one row at least: Python's copy of the words takes many times their size."""
    for b in batches:
        n = max(1, int(b.num_rows * SLICE / max(b.nbytes, 1)))
        for k in range(0, b.num_rows, n):
            part = [b.slice(k, n)]
            # Where long rows lie together, halve until a part fits.
            while part:
                p = part.pop()
                if p.nbytes <= 2 * SLICE or p.num_rows < 2:
                    yield p
                else:
                    half = p.num_rows // 2
                    part += [p.slice(half), p.slice(0, half)]


def paired(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Which of ``old`` became which of ``new``; units that share no word with the other side became nothing."""
    if len(old) == len(new) == 1:
        x, y = (WORD.findall(u.lower()) for u in (old[0], new[0]))
        return [(0, 0)] if (Counter(x) & Counter(y)).total() / max(len(x), len(y), 1) >= ALIKE else []
    left, right = bags(old, new)
    if not set().union(*(b.tolist() for b in left)) & set().union(*(b.tolist() for b in right)):
        return []
    return pairing(Likeness(left, right), len(old), len(new), ALIKE)


def unit_diff(before: list[str], after: list[str]) -> list[tuple[str, str, str]]:
    """(kind, old, new) rows of two lists of units: keep, change, add or remove. Old joins to the one, new to the other.

    Units that are the same but for blanks at their ends are kept; neighbours among them make one row. Between them each changed unit
    stands beside the one that it became, by the pairing in order of the greatest likeness in all.
    """
    out: list[tuple[str, str, str]] = []
    kept = common(*numbered([u.strip() for u in before], [u.strip() for u in after]))
    for gone, come, pair in gaps(kept, len(before), len(after)):
        old, new = [before[i] for i in gone], [after[j] for j in come]
        became = paired(old, new) if old and new else []
        for left, right, both in gaps(became, len(old), len(new)):
            out += [("remove", old[i], "") for i in left] + [("add", "", new[j]) for j in right]
            out += [("change", old[both[0]], new[both[1]])] if both else []
        if pair:
            u, v = before[pair[0]], after[pair[1]]
            if out and out[-1][0] == "keep":
                u, v = out[-1][1] + u, out.pop()[2] + v
            out.append(("keep", u, v))
    return out


def diff_versions(pairs: DataFrame) -> DataFrame:
    """id, ord, kind, old, new: what differs between ``before`` and ``after``, sentence by sentence; equal pairs never reach Python."""
    id_type = pairs.schema["id"].dataType.simpleString()
    changed = pairs.where(F.xxhash64("before") != F.xxhash64("after")).select("id", T.sentences(F.col("before")).alias("a"), T.sentences(F.col("after")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [unit_diff(x, y) for x, y in zip(b["a"].to_pylist(), b["b"].to_pylist(), strict=True)]
            kind, old, new = ([r[k] for f in found for r in f] for k in range(3))
            whose = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            ord_ = pa.array([n for f in found for n in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([b["id"].take(whose), ord_, *[pa.array(c, pa.string()) for c in (kind, old, new)]], ["id", "ord", "kind", "old", "new"])

    return changed.mapInArrow(run, f"id {id_type}, ord int, kind string, old string, new string")


def compose(diff: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """id and the text that the rows of a diff spell under ``choices`` (id, ord, side: old or new); new where nothing is chosen."""
    rows = diff if choices is None else diff.join(choices.select("id", "ord", "side"), ["id", "ord"], "left")
    side = F.lit("new") if choices is None else F.coalesce("side", F.lit("new"))
    told = rows.select("id", "ord", F.when(side == "old", F.col("old")).otherwise(F.col("new")).alias("said"))
    lists = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "said"))).alias("r"))
    return lists.select("id", F.array_join(F.transform("r", lambda x: x["said"]), "").alias("text"))


def word_diff(changes: DataFrame) -> DataFrame:
    """id, ord, old_marks, new_marks: the two sides of each change as runs of words and blanks, each with whether it differs.

    A run of blanks is never marked.
    """

    def marks(old: str, new: str) -> list[tuple[list[str], list[bool]]]:
        sides = [re.findall(r"\s+|\S+", t) for t in (old, new)]
        if not all(sides):
            return [(side, [not u.isspace() for u in side]) for side in sides]
        kept = common(*numbered(*sides))
        same = [{p[k] for p in kept} for k in (0, 1)]
        return [(side, [n not in same[k] and not u.isspace() for n, u in enumerate(side)]) for k, side in enumerate(sides)]

    def column(found: list[tuple[list[str], list[bool]]]) -> pa.Array:
        ends = np.cumsum([0, *[len(units) for units, _ in found]], dtype=np.int32)
        text, changed = (pa.array([u for f in found for u in f[k]], kind) for k, kind in ((0, pa.string()), (1, pa.bool_())))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([text, changed], ["text", "changed"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [marks(x, y) for x, y in zip(b["old"].to_pylist(), b["new"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["id"], b["ord"], *[column([f[k] for f in found]) for k in (0, 1)]], ["id", "ord", "old_marks", "new_marks"])

    id_type = changes.schema["id"].dataType.simpleString()
    side = "array<struct<text:string,changed:boolean>>"
    return changes.where("kind <> 'keep'").select("id", "ord", "old", "new").mapInArrow(run, f"id {id_type}, ord int, old_marks {side}, new_marks {side}")


def word_overlap(pairs: DataFrame) -> DataFrame:
    """id, similarity: words that both texts share, as bags, over the larger bag; no row where both have no words."""
    long = pairs.select("id", F.explode(T.word_tokens(F.col("before"))).alias("word"), F.lit(1).alias("x"), F.lit(0).alias("y"))
    long = long.unionAll(pairs.select("id", F.explode(T.word_tokens(F.col("after"))).alias("word"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    bags = long.groupBy("id", "word").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    return bags.groupBy("id").agg((F.sum(F.least("x", "y")) / F.greatest(F.sum("x"), F.sum("y"))).alias("similarity"))


def versions(s, d: str) -> DataFrame:
    """Documents before and after an edit: the second line goes, the third gets an ending, a line is added; macros come and go."""
    i = F.col("doc_id")
    macros = F.concat(F.when(i % 3 == 0, " {{Char}} waves.").otherwise(""), F.when(i % 5 == 0, " {{user}} nods.").otherwise(""))
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    new = F.flatten(F.transform(lines, lambda x, n: F.when(n == 1, F.array().cast("array<string>")).when(n == 2, F.array(F.concat(x, F.lit(" indeed.")))).otherwise(F.array(x))))
    tail = F.when(i % 2 == 0, " Added {{user}} line with {{CHAR}}.").otherwise(" Added line.")
    after = F.when(i % 7 == 0, " ").otherwise(F.concat(F.array_join(new, "\n"), tail))
    docs = B.table(s, d, "documents").withColumn("id", i)
    return once(docs, before=F.concat(text, macros), after=after).select("id", "before", "after")


#: Words of a unit of a planted version.
UNIT = 12


def planted(s, d: str) -> DataFrame:
    """Documents cut into numbered sentences, and what an editor made of them: of five in a row the second went, the fourth got an ending,
    after the fifth another one came in. What differs is known beforehand, whatever a document's length."""
    words = F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[.!?…\s\x0B]+", " "), " "), lambda x: x != "")
    docs = once(B.table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), w=words).where(F.size("w") > 0)
    said = lambda k: F.concat(F.lit("Part "), k.cast("string"), F.lit(" "), F.array_join(F.slice("w", k * UNIT + 1, F.lit(UNIT)), " "))
    units = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / UNIT).cast("int") - 1), lambda k: F.struct(k.alias("k"), said(k).alias("u")))
    end, nth = F.lit(".\n"), lambda x: x["k"] % 5
    after = lambda x: F.when(nth(x) == 1, "").when(nth(x) == 3, F.concat(x["u"], F.lit(" zzindeed"), end)).when(nth(x) == 4, F.concat(x["u"], end, F.lit("Added "), x["k"].cast("string"), F.lit(" here"), end)).otherwise(F.concat(x["u"], end))
    rows = once(docs.select("id", "w"), units=units)
    return once(rows, before=F.array_join(F.transform("units", lambda x: F.concat(x["u"], end)), ""), after=F.array_join(F.transform("units", after), "")).select("id", "before", "after")


PLANTED = r"""+ cut AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(coalesce(text, ''), '[.!?…\s\x0B]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
    parts AS (SELECT id, w, unnest(range(0, CAST(ceil(len(w) / 12.0) AS BIGINT))) AS k FROM cut WHERE len(w) > 12),
    units AS (SELECT id, k, 'Part ' || k || ' ' || array_to_string(w[12 * k + 1:12 * k + 12], ' ') AS u, w[least(12 * k + 12, len(w))] AS tail FROM parts),
    told AS (SELECT id, CAST(k + k // 5 AS INTEGER) AS ord, CASE k % 5 WHEN 1 THEN 'remove' WHEN 3 THEN 'change' ELSE 'keep' END AS kind, u || '.' || chr(10) AS old,
        CASE k % 5 WHEN 1 THEN '' WHEN 3 THEN u || ' zzindeed.' || chr(10) ELSE u || '.' || chr(10) END AS new, u, tail FROM units
        UNION ALL SELECT id, CAST(k + k // 5 + 1 AS INTEGER), 'add', '', 'Added ' || k || ' here.' || chr(10), NULL, NULL FROM units WHERE k % 5 = 4) """


def shown(marks: DataFrame) -> DataFrame:
    """id, ord, old, new: the marked runs of each side between angle brackets."""
    side = lambda c: F.array_join(F.transform(c, lambda m: F.when(m["changed"], F.concat(F.lit("<"), m["text"], F.lit(">"))).otherwise(m["text"])), "")
    return marks.select("id", "ord", side("old_marks").alias("old"), side("new_marks").alias("new"))


VERSIONS = r"""+ split AS (SELECT doc_id AS id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS u FROM documents), versions AS (SELECT id,
    t || CASE WHEN id % 3 = 0 THEN ' {{Char}} waves.' ELSE '' END || CASE WHEN id % 5 = 0 THEN ' {{user}} nods.' ELSE '' END AS before,
    CASE WHEN id % 7 = 0 THEN ' ' ELSE array_to_string(list_concat(u[1:1], list_transform(u[3:3], lambda x: x || ' indeed.'), u[4:]), chr(10)) || CASE WHEN id % 2 = 0 THEN ' Added {{user}} line with {{CHAR}}.' ELSE ' Added line.' END END AS after FROM split) """


def register(query) -> None:
    from .edits import lost_details, lost_quotes, macro_audit, terms_sql

    query("macro_audit", VERSIONS + r"SELECT id, regexp_matches(before, '(?i)\{\{user\}\}') AND NOT regexp_matches(after, '(?i)\{\{user\}\}') AS lost_user, regexp_matches(before, '(?i)\{\{char\}\}') AND NOT regexp_matches(after, '(?i)\{\{char\}\}') AS lost_char, regexp_matches(before, '\S') AND NOT regexp_matches(after, '\S') AS emptied FROM versions")(
        lambda s, d: macro_audit(versions(s, d))
    )
    spaces = lambda c: f"regexp_replace({c}, '[\\s\\x0B ]+', ' ', 'g')"
    query("lost_quotes", VERSIONS + f"SELECT v.id, u[2] AS quote FROM versions v JOIN split s ON s.id = v.id WHERE length(u[2]) >= 3 AND contains({spaces('before')}, {spaces('u[2]')}) AND NOT contains({spaces('after')}, {spaces('u[2]')})")(
        lambda s, d: lost_quotes(versions(s, d), B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.get(F.split("text", "\n"), F.lit(1)).alias("quote")).where("length(quote) >= 3"))
    )
    # A detail of the whole text that the new one lacks lies in a unit that the new one lacks: SQL needs no units.
    query("lost_details", VERSIONS + f"SELECT id, array_to_string(x, ',') AS lost FROM (SELECT id, list_filter({terms_sql('before')}, lambda t: NOT list_contains(have, t)) AS x FROM (SELECT *, {terms_sql('after')} AS have FROM versions)) WHERE len(x) > 0")(
        lambda s, d: lost_details(versions(s, d))
    )
    query("sentence_split", "SELECT doc_id AS id, sha256(text) AS joined, regexp_matches(text, '\\S') AS some FROM documents")(
        lambda s, d: B.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.array_join(T.sentences(F.col("text")), ""), 256).alias("joined"), F.exists(T.sentences(F.col("text")), lambda u: u.rlike(r"(?U)\S")).alias("some"))
    )
    query("sentence_similarity", VERSIONS + r""", long AS (SELECT id, unnest(regexp_extract_all(lower(before), '[\p{L}\p{N}'']+')) AS w, 1 AS x, 0 AS y FROM versions UNION ALL SELECT id, unnest(regexp_extract_all(lower(after), '[\p{L}\p{N}'']+')), 0, 1 FROM versions),
        bags AS (SELECT id, w, sum(x) AS x, sum(y) AS y FROM long GROUP BY 1, 2) SELECT id, CAST(sum(least(x, y)) AS DOUBLE) / greatest(sum(x), sum(y)) AS similarity FROM bags GROUP BY 1""")(
        lambda s, d: word_overlap(versions(s, d))
    )
    query("diff_versions")(lambda s, d: diff_versions(versions(s, d)))

    def chosen(s, d):
        """Documents with an even id keep every old side, others take every new one: both come back to the letter."""
        diff = written(diff_versions(versions(s, d)))  # read twice
        return compose(diff, diff.where("id % 2 = 0").select("id", "ord", F.lit("old").alias("side")))

    query("compose_versions", VERSIONS + "SELECT id, CASE WHEN id % 2 = 0 THEN before ELSE after END AS text FROM versions WHERE before <> after")(chosen)
    query("word_diff")(lambda s, d: word_diff(diff_versions(versions(s, d))))
    query("diff_planted", PLANTED + "SELECT id, ord, kind, old, new FROM told")(lambda s, d: diff_versions(planted(s, d)))
    every = r"regexp_replace({}, '(\S+)', '<\1>', 'g')"
    query("word_diff_planted", PLANTED + f"""SELECT id, ord, CASE WHEN kind = 'change' THEN substr(u, 1, length(u) - length(tail)) || '<' || tail || '.>' || chr(10) ELSE {every.format('old')} END AS old,
        CASE WHEN kind = 'change' THEN substr(u, 1, length(u) - length(tail)) || '<' || tail || '> <zzindeed.>' || chr(10) ELSE {every.format('new')} END AS new FROM told WHERE kind <> 'keep'""")(
        lambda s, d: shown(word_diff(diff_versions(planted(s, d))))
    )
