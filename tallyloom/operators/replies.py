"""Scorer replies: finding the answer in them, and scores out of the answer. The common shapes are read natively."""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.plans import bindings as B
from tallyloom.sources.payloads import is_object, json_value, kind, part

TOKEN = re.compile(r'["{}]')
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
FENCE = r"(?is)```(?:json)?\s*(.*?)```"
IMPROVEMENTS = 3


def span_ends(reply: str) -> dict[int, int]:
    """End of the balanced span of each opening brace that has one, if reading starts there; braces in strings don't count.

    Braces are taken from the last to the first. A later brace's span is known when an earlier one reaches it, so nothing is
    read twice.
    """
    tokens = [m.start() for m in TOKEN.finditer(reply)]
    ends: dict[int, int] = {}
    strings: dict[int, int] = {}
    for n in range(len(tokens) - 1, -1, -1):
        if reply[tokens[n]] != "{":
            continue
        i = n + 1
        while i < len(tokens):
            at = tokens[i]
            if reply[at] == "}":
                ends[tokens[n]] = at + 1
                break
            if reply[at] == "{":
                to = ends.get(at, -1)
            else:
                if at not in strings:
                    m = STRING.match(reply, at)
                    strings[at] = m.end() if m else -1
                to = strings[at]
            if to < 0:
                break
            i = bisect.bisect_left(tokens, to, i)
    return ends


def newest_object(reply: str, key: str) -> str | None:
    """The balanced object with ``key`` that starts last in a reply."""
    named = [m.start() for m in re.finditer(re.escape(json.dumps(key)), reply)]
    for start, end in span_ends(reply).items():  # the last brace comes first
        k = bisect.bisect_right(named, start)
        if k < len(named) and named[k] < end:
            try:
                value = json.loads(reply[start:end])
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict) and key in value:
                return reply[start:end]
    return None


def extract_json(replies: DataFrame, key: str = "fields") -> DataFrame:
    """id and the answer object (null if there is none), and all further columns but ``content``.

    Reasoning goes first. The answer is the whole reply, else the first fenced block, else the newest balanced span that is
    an object with ``key``. Only replies that the first two don't serve reach Python.
    """
    plain = T.strip(T.strip_reasoning(F.coalesce("content", F.lit(""))))
    holds = lambda t: is_object(json_value(t)) & F.coalesce(F.map_contains_key(F.try_variant_get(json_value(t), "$", "map<string,variant>"), F.lit(key)), F.lit(False))
    fenced = F.get(F.filter(F.transform(F.regexp_extract_all("plain", F.lit(FENCE), F.lit(1)), T.strip), holds), F.lit(0))

    @F.pandas_udf("string")
    def recover(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else newest_object(t, key))

    rest = [c for c in replies.columns if c not in ("id", "content")]
    rows = once(replies.select("id", *rest, "content"), plain=plain).drop("content")
    rows = once(rows, ready=F.when(holds(F.col("plain")), F.col("plain")).otherwise(fenced))
    missed = recover(F.when(F.col("ready").isNull(), F.col("plain")))  # null where the answer is known
    return rows.select("id", *rest, F.coalesce("ready", missed).alias("answer"))


def as_number(value: Column) -> Column:
    """A JSON value as a number: numbers, numeric texts, true and false, null and the empty text as zero; else null."""
    k, text = kind(value), F.trim(part(value, "$", "string"))
    typed = F.when(text == "", 0.0).otherwise(text.try_cast("double"))
    number = F.when(k == "VOID", 0.0).when(k == "STRING", typed).when(k == "BOOLEAN", (text == "true").cast("double")).when(~k.isin("OBJECT", "ARRAY"), part(value, "$", "double"))
    return F.when(~F.isnan(number), number)


def clamped(number: Column) -> Column:
    return F.least(F.lit(10.0), F.greatest(F.lit(1.0), number))


def field_score(entry: Column) -> Column:
    """The score of a field's entry, an object or a bare value: rounded, halves up, within 1 to 10; null if there is none."""
    raw = F.when(is_object(entry), part(entry, "$.score")).when(kind(entry) != "VOID", entry)
    number = as_number(raw)
    return F.when(number.isNotNull(), F.floor(clamped(number) + 0.5)).cast("int")


def weight_of(weights: Mapping[str, float] | Column | None, field: str) -> Column:
    """A field's weight: of a mapping or a map column, a field that it lacks weighs nothing; without one, the usual weight."""
    if isinstance(weights, Column):
        return F.coalesce(weights[field].cast("double"), F.lit(0.0))
    return F.lit(float((B.WEIGHTS if weights is None else weights).get(field, 0.0)))


def weighted_overall(scores: dict[str, Column], weights: Mapping[str, float] | Column | None = None) -> Column:
    """Weighted mean of the present scores, summed in canonical order, one decimal; the plain mean if no weight is left."""
    total = weight = plain = n = F.lit(0.0)
    for f in B.FIELDS:
        if f in scores:
            s, there, w = scores[f].cast("double"), scores[f].isNotNull(), weight_of(weights, f)
            total = total + F.when(there, s * w).otherwise(0.0)
            weight = weight + F.when(there, w).otherwise(0.0)
            plain, n = plain + F.coalesce(s, F.lit(0.0)), n + there.cast("double")
    return F.when(weight > 0, T.half_up(total / weight)).when(n > 0, T.half_up(plain / n))


def weight_maps(weights: DataFrame) -> DataFrame:
    """run, weights (a map from field to weight): one row a run of a table of weights (run, field, weight); of repeats the largest counts."""
    one = weights.where(F.col("field").isin(*B.FIELDS)).groupBy("run", "field").agg(F.max("weight").alias("weight"))
    return one.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("weight").cast("double")))).alias("weights"))


def overalls(results: DataFrame, weights: DataFrame) -> DataFrame:
    """run, id, overall of ``results`` (run, id, fields: a map from field to score) under the weights of their run (run, field, weight).

    A run without weights takes the plain mean.
    """
    rows = results.join(weight_maps(weights), "run", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))
    return rows.select("run", "id", weighted_overall({f: F.col("fields")[f] for f in B.FIELDS}, F.col("weights")).alias("overall"))


def parse_scores(answers: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """One row per usable answer (id, answer): id, fields (a map from field to score and three texts), overall, improvements, summary.

    Unknown fields count only where no known one is named. The overall is the weighted mean of the scores; a reply without
    a usable score keeps its own overall, if that is a number; with neither it is left out. ``weights`` are the usual ones if none are given.
    """
    rest = [c for c in answers.columns if c not in ("id", "answer")]
    rows = once(answers, v=json_value(F.col("answer")))
    rows = once(rows, m=F.try_variant_get("v", "$.fields", "map<string,variant>")).where(F.col("m").isNotNull())
    known = F.exists(F.map_keys("m"), lambda k: k.isin(*B.FIELDS))
    used = F.map_filter("m", lambda k, x: (~known | k.isin(*B.FIELDS)) & (kind(x) != "VOID"))
    said = lambda x, key: F.when(is_object(x), F.coalesce(part(x, f"$.{key}", "string"), F.lit(""))).otherwise("")
    entry = lambda _, x: F.struct(field_score(x).alias("score"), *[said(x, k).alias(k) for k in ("strengths", "weaknesses", "suggestions")])
    rows = once(rows, fields=F.transform_values(used, entry))
    others = F.filter(F.transform(F.map_values(F.map_filter("fields", lambda k, _: ~k.isin(*B.FIELDS))), lambda x: x["score"]), lambda x: x.isNotNull())
    strange = F.when(F.size(others) > 0, T.half_up(F.aggregate(others, F.lit(0.0), lambda a, x: a + x) / F.size(others)))
    own = part(F.col("v"), "$.overall_score")
    stated = F.when(~kind(own).isin("STRING", "BOOLEAN", "OBJECT", "ARRAY", "VOID"), T.half_up(clamped(part(own, "$", "double"))))
    overall = F.coalesce(weighted_overall({f: F.col("scores")[f] for f in B.FIELDS}, weights), strange, stated)
    improvements = F.slice(F.transform(part(F.col("v"), "$.top_priority_improvements", "array<variant>"), lambda x: part(x, "$", "string")), 1, IMPROVEMENTS)
    rows = once(rows, scores=F.struct(*[F.col("fields")[f]["score"].alias(f) for f in B.FIELDS]))
    made = once(rows, overall=overall).select("id", *rest, "fields", "overall", F.coalesce(improvements, F.array().cast("array<string>")).alias("improvements"), F.coalesce(part(F.col("v"), "$.summary", "string"), F.lit("")).alias("summary"))
    return made.where("overall IS NOT NULL")


def flat_scores(parsed: DataFrame) -> DataFrame:
    """One column a field for its score, and the rest of what a reply says as text."""
    cells = [F.col("fields")[f]["score"].alias(f) for f in B.FIELDS]
    texts = F.concat_ws("|", F.col("fields")["description"]["strengths"], F.col("fields")["description"]["weaknesses"], F.col("fields")["description"]["suggestions"])
    return parsed.select("id", *cells, texts.alias("said"), "overall", F.array_join("improvements", "|").alias("improvements"), "summary")


def register(query) -> None:
    fresh = """SELECT id, v, n, CASE WHEN v IN (0, 1, 2, 3, 4) THEN 'full' WHEN v = 5 THEN 'own' END AS form, text FROM replies"""
    s = lambda k: f"1 + (n * 7 + {k}) % 10"
    weights = [B.WEIGHTS[f] for f in ("description", "personality", "scenario", "mes_example")]
    total = " + ".join(["0.0::DOUBLE", *[f"({s(k)}) * {w}::DOUBLE" for k, w in zip((1, 2, 3), weights, strict=False)], f"10 * {weights[3]}::DOUBLE"])
    scored = f"floor(({total}) / ({' + '.join(['0.0::DOUBLE', *[f'{w}::DOUBLE' for w in weights]])}) * 10 + 0.5) / 10.0"
    query(
        "parse_scores",
        f"""SELECT id, CASE WHEN form = 'full' THEN CAST({s(1)} AS INTEGER) END AS description, CASE WHEN form = 'full' THEN CAST({s(2)} AS INTEGER) END AS personality,
        CASE WHEN form = 'full' THEN CAST({s(3)} AS INTEGER) END AS scenario, CAST(NULL AS INTEGER) AS first_mes, CASE WHEN form = 'full' THEN 10 END AS mes_example, CAST(NULL AS INTEGER) AS system_prompt,
        CAST(NULL AS INTEGER) AS post_history_instructions, CAST(NULL AS INTEGER) AS character_note, CAST(NULL AS INTEGER) AS alternate_greetings,
        CASE WHEN form = 'full' THEN text || '||more' ELSE '||' END AS said, CASE WHEN form = 'full' THEN {scored} ELSE 7.3 END AS overall,
        CASE WHEN form = 'full' THEN 'a|' || text || '|3' ELSE '' END AS improvements, CASE WHEN form = 'full' THEN text ELSE '' END AS summary FROM ({fresh}) WHERE form IS NOT NULL""",
        "replies",
    )(lambda x, d: flat_scores(parse_scores(extract_json(B.replies(x, d)))))
    query("extract_json", f"SELECT id, form, CASE WHEN form = 'full' THEN text END AS summary FROM ({fresh})", "replies")(
        lambda x, d: extract_json(B.replies(x, d)).select(
            "id", F.when(F.get_json_object("answer", "$.overall_score") == "7.26", "own").when(F.col("answer").isNotNull(), "full").alias("form"), F.get_json_object("answer", "$.summary").alias("summary")
        )
    )
    query(
        "strip_reasoning",
        """SELECT id, regexp_replace(text, '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS answer FROM replies""", "replies",
    )(lambda x, d: B.thoughtful(x, d).select("id", T.strip(T.strip_reasoning(F.col("content"))).alias("answer")))
    query("weighted_overall", "SELECT id, floor((0.0::DOUBLE + a * 0.3::DOUBLE + b * 0.1::DOUBLE) / (0.3::DOUBLE + 0.1::DOUBLE) * 10 + 0.5) / 10.0 AS overall FROM (SELECT id, 1 + length(f1) % 10 AS a, 1 + length(f2) % 10 AS b FROM cards)", "cards")(
        lambda x, d: B.cards(x, d).select("id", weighted_overall({"description": 1 + F.length("f1") % 10, "personality": 1 + F.length("f2") % 10}).alias("overall"))
    )

    def two_runs(x, d):
        """Every card's scores under two sets of weights, and under none."""
        fields = F.create_map(*[y for k, f in enumerate(("description", "first_mes", "alternate_greetings"), 1) for y in (F.lit(f), (1 + F.length(f"f{k}") % 10).cast("int"))])
        rows = B.cards(x, d).select(F.explode(F.array(*map(F.lit, ("usual", "greeting", "none")))).alias("run"), "id", fields.alias("fields"))
        return overalls(rows, x.createDataFrame(run_weights(), "run string, field string, weight double"))

    def run_weights():
        return [("usual", f, w) for f, w in B.WEIGHTS.items()] + [("greeting", "alternate_greetings", 0.7), ("greeting", "first_mes", 0.2)]

    def run_sql(run: str) -> str:
        w = {f: x for r, f, x in run_weights() if r == run}
        part = [(k, w.get(f, 0.0)) for k, f in enumerate(("description", "first_mes", "alternate_greetings"), 1)]
        part = [part[0], part[1], part[2]]
        score = lambda k: f"(1 + length(f{k}) % 10)"
        if not any(x for _, x in part):
            return f"SELECT '{run}' AS run, id, floor((0.0::DOUBLE + {' + '.join(score(k) for k, _ in part)}) / 3 * 10 + 0.5) / 10.0 AS overall FROM cards"
        total = " + ".join(f"{score(k)} * {x}::DOUBLE" for k, x in part)
        return f"SELECT '{run}' AS run, id, floor((0.0::DOUBLE + {total}) / (0.0::DOUBLE + {' + '.join(f'{x}::DOUBLE' for _, x in part)}) * 10 + 0.5) / 10.0 AS overall FROM cards"

    query("overalls_by_weights", " UNION ALL ".join(map(run_sql, ("usual", "greeting", "none"))), "cards")(two_runs)
