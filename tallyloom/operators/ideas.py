"""Ideas for improving cards: requests for them, checks of what comes back, and requests for the edits that carry them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.plans import bindings as B
from tallyloom.sources.payloads import is_object, json_value, kind, part
from tallyloom.sources.store import written

from .cards import MACROS, blank, edit_targets, heading, note_depth
from .edits import bare_quote

KINDS = ("fix", "combine", "extend", "trim")
IMPACTS = ("high", "medium", "low")
# What a fact can be about.
ASPECTS = ("look", "personality", "voice", "goals", "relationships", "powers", "setting", "format")
#: Most ideas, quotes of an idea, facts, facts of a plain list.
MOST_IDEAS, MOST_QUOTES, MOST_FACTS, MOST_KEPT = 12, 6, 24, 12


def clean(value: Column, most: int) -> Column:
    """White space collapsed, none at the ends, cut after ``most`` characters."""
    return F.substring(T.strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " ")), 1, most)


def said(value: Column, key: str) -> Column:
    return F.coalesce(part(value, f"$.{key}", "string"), F.lit(""))


def listed(value: Column, key: str) -> Column:
    return F.coalesce(part(value, f"$.{key}", "array<variant>"), F.array().cast("array<variant>"))


def grounded(quote: Column, whole: Column) -> Column:
    """A quote as it stands in the card's normalised text ``whole``, without its marks; null if it isn't there."""
    q = bare_quote(quote)
    norm = T.normalize_text(q)
    return F.when((F.length(q) >= 3) & (norm != "") & F.contains(whole, norm), q)


def with_text(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """``replies`` (id, answer) as values ``v``, with their card's parts (a map from field to label) and whole normalised text."""
    cells = F.array_sort(F.collect_list(F.struct("ord", "field", "label", "text")))
    cards = once(targets.groupBy("id").agg(cells.alias("c")), c=F.col("c"))
    whole = T.normalize_text(F.array_join(F.transform("c", lambda x: x["text"]), "\n"))
    labels = F.map_from_entries(F.transform("c", lambda x: F.struct(x["field"], x["label"])))
    rows = once(replies.select("id", "answer"), v=json_value(F.col("answer"))).drop("answer").where(is_object(F.col("v")))
    return rows.join(once(cards, whole=whole, labels=labels).drop("c"), "id")


def validate_ideas(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """The ideas of replies (id, answer) that hold: id, number, kind, field, label, title, change, why, impact, risk, quotes.

    An idea needs a change, a known kind (one that names none, and isn't about a lorebook, extends) and a part of the card
    (``targets``: id, ord, field, label, text). Impact is medium by default; the risk "none" is none. Quotes that aren't in
    the card go. The first ideas and quotes stay; numbers are given afterwards.
    """
    rows = with_text(replies, targets).select("id", "whole", "labels", F.posexplode(listed(F.col("v"), "ideas")).alias("ord", "i"))
    i = F.col("i")
    named = F.lower(said(i, "kind"))
    other = part(i, "$.lorebook")
    lore = F.coalesce(other.isNotNull() & ~kind(other).isin("VOID") & ~F.coalesce(part(other, "$", "string"), F.lit("")).isin("false", "0", ""), F.lit(False))
    found = F.when(named.isin(*KINDS), named).when((named == "") & ~lore, "extend")
    quotes = F.filter(F.transform(listed(i, "quotes"), lambda q: grounded(part(q, "$", "string"), F.col("whole"))), lambda q: q.isNotNull())
    # A card's text is done with before its ideas are put in order: a copy of it for each of them would be sorted along.
    rows = once(rows.where(is_object(i)), kind=found, field=T.strip(said(i, "field")), change=clean(said(i, "change"), 2000), quotes=F.slice(quotes, 1, MOST_QUOTES)).drop("whole")
    rows = rows.where((F.col("change") != "") & F.col("kind").isNotNull() & F.map_contains_key(F.col("labels"), F.col("field")))
    number = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    impact, risk, title = F.lower(said(i, "impact")), clean(said(i, "risk"), 400), clean(said(i, "title"), 120)
    return rows.withColumn("number", number).where(F.col("number") <= MOST_IDEAS).select(
        "id", "number", "kind", "field", F.col("labels")[F.col("field")].alias("label"), F.when(title == "", clean(said(i, "change"), 60)).otherwise(title).alias("title"), "change",
        clean(said(i, "why"), 600).alias("why"), F.when(impact.isin(*IMPACTS), impact).otherwise("medium").alias("impact"),
        F.when(risk.rlike(r"(?i)^none\.?$"), "").otherwise(risk).alias("risk"), "quotes",
    )


def validate_canon(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """The facts of replies (id, answer) to keep: id, number, aspect, fact, quote. A quote that isn't in the card is blanked.

    Where a reply has no fact, its plain list ``keep`` and the lines ``keep_quotes`` serve instead.
    """
    rows = with_text(replies, targets)
    v, whole = F.col("v"), F.col("whole")
    fact = lambda aspect, text, quote: F.struct(aspect.alias("aspect"), text.alias("fact"), F.coalesce(quote, F.lit("")).alias("quote"))
    aspect = lambda c: F.when(F.lower(said(c, "aspect")).isin(*ASPECTS), F.lower(said(c, "aspect"))).otherwise("other")
    facts = F.filter(F.transform(listed(v, "canon"), lambda c: fact(aspect(c), clean(said(c, "fact"), 300), grounded(said(c, "quote"), whole))), lambda c: c["fact"] != "")
    text = lambda x: F.coalesce(part(x, "$", "string"), F.lit(""))
    kept = F.slice(F.filter(F.transform(listed(v, "keep"), lambda k: fact(F.lit("other"), clean(text(k), 300), F.lit(""))), lambda c: c["fact"] != ""), 1, MOST_KEPT)
    lines = F.filter(F.transform(listed(v, "keep_quotes"), lambda q: fact(F.lit("other"), F.lit("Exact line"), grounded(text(q), whole))), lambda c: c["quote"] != "")
    legacy = F.when(part(v, "$.keep", "array<variant>").isNotNull(), F.concat(kept, lines)).otherwise(F.array().cast("array<struct<aspect:string,fact:string,quote:string>>"))
    canon = F.when(F.size(facts) > 0, F.slice(facts, 1, MOST_FACTS)).otherwise(legacy)
    return rows.select("id", F.posexplode(canon).alias("n", "c")).select("id", (F.col("n") + 1).alias("number"), "c.aspect", "c.fact", "c.quote")


def default_ideas(ideas: DataFrame) -> DataFrame:
    """The ideas that are chosen before anybody chooses: without risk, of more than low impact, and no mere trims."""
    return ideas.where(F.col("kind").isin("fix", "combine", "extend") & (F.col("risk") == "") & (F.col("impact") != "low"))


def allowed_fields(ideas: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, field) that chosen ideas (id, kind, field, quotes) may change: their own, and for a fix every part that holds a quote.

    The description is the reference for the rest: it may change only if an idea is about it.
    """
    ideas = written(ideas.select("id", "kind", "field", "quotes"))
    parts = once(targets.select("id", "field", "text"), norm=T.normalize_text(F.col("text"))).drop("text")
    own = ideas.select("id", "field").join(targets.select("id", "field"), ["id", "field"], "left_semi")
    quoted = once(ideas.where("kind = 'fix'").select("id", F.explode("quotes").alias("quote")), q=T.normalize_text(F.col("quote"))).select("id", "q").where("q <> ''")
    holds = parts.join(quoted, "id").where(F.contains("norm", "q")).select("id", "field")
    every = own.unionAll(holds).distinct()
    about = ideas.where("field = 'description'").select("id").distinct()
    return every.where("field <> 'description'").unionAll(every.where("field = 'description'").join(about, "id", "left_semi"))


def critique(entry: Column) -> Column:
    """One line on a field's rating (score, strengths, weaknesses, suggestions); null where nothing is said."""
    told = [F.when(F.coalesce(entry[k], F.lit("")) != "", F.concat(F.lit(f"{k}: "), entry[k])) for k in ("strengths", "weaknesses", "suggestions")]
    return F.nullif(F.concat_ws("; ", F.when(entry["score"].isNotNull(), F.concat(F.lit("scored "), entry["score"].cast("string"), F.lit("/10"))), *told), F.lit(""))


def rating_lines(overall: bool = True) -> Column:
    """What a rating (summary, overall, improvements) says about a whole card; null where it says nothing."""
    return F.nullif(F.concat_ws(
        "\n\n",
        F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("Rating summary: "), F.col("summary"))),
        F.when(F.col("overall").isNotNull() & F.lit(overall), F.concat(F.lit("Overall score: "), F.format_string("%.1f", "overall"), F.lit("/10"))),
        F.when(F.size("improvements") > 0, F.concat(F.lit("Top priority improvements:\n- "), F.array_join("improvements", "\n- "))),
    ), F.lit(""))


def build_idea_requests(cards: DataFrame, results: DataFrame) -> DataFrame:
    """(id, request): name, the rating's summary, each filled field with its rating and text, and what may be changed or filled.

    ``results``: id, fields (a map from field to score and texts), overall, improvements, summary; a card without one is asked
    about without a rating. Cards without text are left out.
    """
    rows = cards.join(results.select("id", "fields", "overall", "improvements", "summary"), "id", "left")
    depth = note_depth(cards)
    flat = F.col("flat") if "flat" in cards.columns else F.lit(False)
    no_note = lambda f: F.lit(f == "character_note") & flat
    parts, editable, fillable = [], [], []
    for k, f in enumerate(B.FIELDS, 1):
        text = F.col(f"f{k}")
        here = ~blank(text) & ~no_note(f)
        rated = critique(F.col("fields")[f])
        parts.append(F.when(here, F.concat(heading(f, depth), F.when(rated.isNotNull(), F.concat(F.lit("\nRating of this field: "), rated)).otherwise(""), F.lit("\n"), T.strip(text))))
        editable.append(F.when(here, F.lit(f)))
        if f in B.FILLABLE:
            fillable.append(F.when(blank(text) & ~no_note(f), F.lit(f)))
    may, fill = F.concat_ws(", ", *editable), F.concat_ws(", ", *fillable)
    request = F.concat_ws(
        "\n\n", F.concat(F.lit("Character name: "), F.col("name")), F.lit(MACROS), rating_lines(), *parts, F.concat(F.lit("Fields to suggest changes to: "), may, F.lit(".")),
        F.when(fill != "", F.concat(F.lit("Empty fields to suggest filling: "), fill, F.lit("."))),
    )
    return rows.where(may != "").select("id", request.alias("request"))


def build_edit_requests(cards: DataFrame, ideas: DataFrame, canon: DataFrame, allowed: DataFrame) -> DataFrame:
    """(id, request): the chosen ideas, numbered, with their quotes; the canon; lines that must survive; the parts that may change.

    The description goes along as a reference where it may not change. Cards without an allowed part are left out.
    """
    quotes = F.when(F.size("quotes") > 0, F.concat(F.lit("\n   About: "), F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("“"), q, F.lit("”"))), " / "))).otherwise("")
    line = F.concat(F.col("number").cast("string"), F.lit(". ["), F.col("kind"), F.lit(" · "), F.col("field"), F.lit("] "), F.col("title"), F.lit(" — "), F.col("change"), F.when(F.col("why") != "", F.concat(F.lit(" (Why: "), F.col("why"), F.lit(")"))).otherwise(""), quotes)
    order = F.row_number().over(Window.partitionBy("id").orderBy("number"))
    numbered = ideas.withColumn("number", order).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("ideas"))
    fact = F.concat(F.lit("- "), F.when(F.col("aspect") != "other", F.concat(F.col("aspect"), F.lit(": "))).otherwise(""), F.col("fact"), F.when(F.col("quote") != "", F.concat(F.lit(" (“"), F.col("quote"), F.lit("”)"))).otherwise(""))
    facts = canon.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("number", fact.alias("line"), "quote"))).alias("facts"))
    fields = allowed.groupBy("id").agg(F.collect_set("field").alias("may"))
    rows = cards.join(numbered, "id").join(fields, "id").join(facts, "id", "left")
    depth = note_depth(cards)
    lines = lambda c, part: F.array_join(F.transform(c, lambda x: x[part]), "\n")
    kept = F.array_distinct(F.filter(F.transform("facts", lambda x: x["quote"]), lambda q: q != ""))
    parts = []
    for k, f in enumerate(B.FIELDS, 1):
        text, may = F.col(f"f{k}"), F.array_contains("may", f)
        shown = F.when(may & blank(text), heading(f, depth, " (EMPTY — fill it with one write)")).when(may, F.concat(heading(f, depth), F.lit("\n"), text))
        if f == "description":
            shown = F.coalesce(shown, F.when(~blank(text), F.concat(F.lit("### description (for reference, not to be edited)\n"), T.strip(text))))
        parts.append(shown)
    order_of = F.array(*[F.when(F.array_contains("may", f), F.lit(f)) for f in B.FIELDS])
    request = F.concat_ws(
        "\n\n", F.concat(F.lit("Character name: "), F.col("name")), F.lit(MACROS), F.concat(F.lit("Chosen changes, and no others:\n"), lines("ideas", "line")),
        F.when(F.size("facts") > 0, F.concat(F.lit("Canon, to be left intact:\n"), lines("facts", "line"))),
        F.when(F.size(kept) > 0, F.concat(F.lit('To survive word for word:\n- "'), F.array_join(kept, '"\n- "'), F.lit('"'))),
        *parts, F.concat(F.lit("Edit only: "), F.array_join(F.filter(order_of, lambda x: x.isNotNull()), ", "), F.lit(".")),
    )
    return rows.select("id", request.alias("request"))


# Samples over the given tables ---------------------------------------------------------------------------------------


def sample_replies(cards: DataFrame) -> DataFrame:
    """One reply a card: six ideas of which two hold, facts, and for every fourth card the plain lists instead."""
    q = F.substring("f1", 1, 20)
    none = F.lit(None).cast("string")
    idea = lambda kind, field, title, change, why, quotes, impact, risk, lorebook=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(field).alias("field"), F.lit(title).alias("title"), F.lit(change).alias("change"), F.lit(why).alias("why"), quotes.alias("quotes"), F.lit(impact).alias("impact"),
        F.lit(risk).alias("risk"), (none if lorebook is None else F.lit(lorebook)).alias("lorebook"),
    )
    no_quotes = F.array().cast("array<string>")
    ideas = F.array(
        idea("Fix", "description", " ", " do\n it ", "because  so", F.array(F.concat(F.lit("“"), q, F.lit("”")), F.lit("never said"), F.lit("ab")), "LOW", "None."),
        idea("", " scenario ", "A title", "extend it", "", no_quotes, "huge", ""), idea("odd", "scenario", "", "x", "", no_quotes, "low", ""), idea("trim", "nowhere", "", "x", "", no_quotes, "low", ""),
        idea("fix", "description", "t", " \n ", "", no_quotes, "low", ""), idea("", "scenario", "", "x", "", no_quotes, "low", "", "yes"),
    )
    fact = lambda aspect, text, quote: F.struct(F.lit(aspect).alias("aspect"), F.lit(text).alias("fact"), quote.alias("quote"))
    canon = F.array(fact("Look", "  is   tall ", q), fact("odd", "sings", F.lit("never said")), fact("voice", " ", q))
    full, legacy = F.to_json(F.struct(ideas.alias("ideas"), canon.alias("canon"))), F.to_json(F.struct(ideas.alias("ideas"), F.array(F.lit("k 1"), F.lit(" ")).alias("keep"), F.array(q, F.lit("never said")).alias("keep_quotes")))
    return cards.select("id", F.when(F.col("doc_id") % 4 == 0, legacy).otherwise(full).alias("answer"))


def sample_results(cards: DataFrame) -> DataFrame:
    """A rating of two cards in three."""
    entry = F.struct((1 + F.length("f1") % 10).alias("score"), F.lit("warm").alias("strengths"), F.lit("").alias("weaknesses"), F.lit("trim it").alias("suggestions"))
    return cards.where("doc_id % 3 <> 0").select("id", F.create_map(F.lit("description"), entry).alias("fields"), ((F.col("doc_id") % 91) / 10.0).alias("overall"), F.array(F.lit("one"), F.lit("two")).alias("improvements"), F.lit("Fine.").alias("summary"))


def register(query) -> None:
    from tallyloom.plans.sql_parts import heading_sql, trimmed

    cards = B.cards
    targets = lambda s, d: edit_targets(cards(s, d))
    ideas = lambda s, d: validate_ideas(sample_replies(cards(s, d)), targets(s, d))
    canon = lambda s, d: validate_canon(sample_replies(cards(s, d)), targets(s, d))

    def requested_sample(s, d: str) -> DataFrame:
        """The ideas are judged once, for the requests and for what they may change."""
        chosen = written(ideas(s, d))
        return build_edit_requests(cards(s, d), chosen, canon(s, d), allowed_fields(chosen, targets(s, d)))

    bare = f"regexp_replace(regexp_replace({trimmed('substr(f1, 1, 20)')}, '^[\"“]', ''), '[\"”]$', '')"
    quoted = f"regexp_replace(regexp_replace({trimmed("'“' || substr(f1, 1, 20) || '”'")}, '^[\"“]', ''), '[\"”]$', '')"
    held = lambda q: f"length({q}) >= 3 AND {trimmed(q)} <> ''"
    good = f"""good AS (SELECT id, 1 AS number, 'fix' AS kind, 'description' AS field, 'description' AS label, 'do it' AS title, 'do it' AS change, 'because so' AS why, 'low' AS impact, '' AS risk, CASE WHEN {held(quoted)} THEN {quoted} ELSE '' END AS quotes FROM cards WHERE trim(f1) <> ''
        UNION ALL SELECT id, CASE WHEN trim(f1) <> '' THEN 2 ELSE 1 END, 'extend', 'scenario', CASE WHEN trim(f3) = '' THEN 'scenario (new)' ELSE 'scenario' END, 'A title', 'extend it', '', 'medium', '', '' FROM cards)"""
    facts = f"""facts AS (SELECT id, 1 AS number, 'look' AS aspect, 'is tall' AS fact, CASE WHEN {held(bare)} THEN {bare} ELSE '' END AS quote FROM cards WHERE doc_id % 4 <> 0 UNION ALL SELECT id, 2, 'other', 'sings', '' FROM cards WHERE doc_id % 4 <> 0
        UNION ALL SELECT id, 1, 'other', 'k 1', '' FROM cards WHERE doc_id % 4 = 0 UNION ALL SELECT id, 2, 'other', 'Exact line', {bare} FROM cards WHERE doc_id % 4 = 0 AND {held(bare)})"""
    query("ideas_validated", f"+ {good} SELECT * FROM good", "cards")(lambda s, d: ideas(s, d).withColumn("quotes", F.array_join("quotes", "|")))
    query("canon_validated", f"+ {facts} SELECT * FROM facts", "cards")(canon)
    query("default_ideas", f"+ {good} SELECT id, count(*) AS n FROM good WHERE kind <> 'trim' AND risk = '' AND impact <> 'low' GROUP BY 1", "cards")(lambda s, d: default_ideas(ideas(s, d)).groupBy("id").agg(F.count("*").alias("n")))
    norm = lambda c: f"trim(regexp_replace(replace(translate({c}, '‘’ʼ“”', '''''''\"\"'), '…', '...'), '[\\s\\x0B ]+', ' ', 'g'))"
    long = "long AS (" + " UNION ALL ".join(f"SELECT id, {k} AS ord, '{f}' AS field, f{k} AS text FROM cards WHERE trim(f{k}) <> ''" + (" OR true" if f in B.FILLABLE else "") for k, f in enumerate(B.FIELDS, 1)) + ")"
    may = f"""{long}, may AS (SELECT DISTINCT id, field FROM (SELECT l.id, l.field FROM long l JOIN good g ON l.id = g.id AND g.field = l.field UNION ALL SELECT l.id, l.field FROM long l JOIN good g ON l.id = g.id WHERE g.kind = 'fix' AND g.quotes <> '' AND contains({norm('l.text')}, {norm('g.quotes')}))
        WHERE field <> 'description' OR id IN (SELECT id FROM good WHERE field = 'description'))"""
    query("allowed_fields", f"+ {good}, {may} SELECT * FROM may", "cards")(lambda s, d: allowed_fields(ideas(s, d), targets(s, d)))
    show = lambda k, f, extra="''": f"'{heading_sql(f)}' || {extra} || chr(10) || {trimmed(f'f{k}')}"
    rated = "'scored ' || (1 + length(f1) % 10) || '/10; strengths: warm; suggestions: trim it'"
    gap = "chr(10) || chr(10)"
    head = f"'Character name: ' || name, '{MACROS.replace(chr(39), chr(39) * 2)}'"
    body = ", ".join(f"CASE WHEN trim(f{k}) <> '' THEN {show(k, f, f'CASE WHEN doc_id % 3 <> 0 THEN chr(10) || {chr(39)}Rating of this field: {chr(39)} || {rated} ELSE {chr(39)}{chr(39)} END' if k == 1 else chr(39) * 2)} END" for k, f in enumerate(B.FIELDS, 1))
    full = ", ".join(f"CASE WHEN trim(f{k}) <> '' THEN '{f}' END" for k, f in enumerate(B.FIELDS, 1))
    fill = ", ".join(f"CASE WHEN trim(f{k}) = '' THEN '{f}' END" for k, f in enumerate(B.FIELDS, 1) if f in B.FILLABLE)
    rating = "CASE WHEN doc_id % 3 <> 0 THEN 'Rating summary: Fine.' || chr(10) || chr(10) || 'Overall score: ' || printf('%.1f', (doc_id % 91) / 10.0::DOUBLE) || '/10' || chr(10) || chr(10) || 'Top priority improvements:' || chr(10) || '- one' || chr(10) || '- two' END"
    query("idea_requests", f"SELECT id, concat_ws({gap}, {head}, {rating}, {body}, 'Fields to suggest changes to: ' || concat_ws(', ', {full}) || '.', CASE WHEN concat_ws(', ', {fill}) <> '' THEN 'Empty fields to suggest filling: ' || concat_ws(', ', {fill}) || '.' END) AS request FROM cards WHERE concat_ws(', ', {full}) <> ''", "cards")(
        lambda s, d: build_idea_requests(cards(s, d), sample_results(cards(s, d)))
    )
    listed_ideas = "SELECT id, string_agg(number || '. [' || kind || ' · ' || field || '] ' || title || ' — ' || change || CASE WHEN why <> '' THEN ' (Why: ' || why || ')' ELSE '' END || CASE WHEN quotes <> '' THEN chr(10) || '   About: “' || quotes || '”' ELSE '' END, chr(10) ORDER BY number) AS said FROM good GROUP BY 1"
    listed_facts = "SELECT id, string_agg('- ' || CASE WHEN aspect <> 'other' THEN aspect || ': ' ELSE '' END || fact || CASE WHEN quote <> '' THEN ' (“' || quote || '”)' ELSE '' END, chr(10) ORDER BY number) AS said, string_agg(CASE WHEN quote <> '' THEN '- \"' || quote || '\"' END, chr(10) ORDER BY number) AS kept FROM facts GROUP BY 1"
    allowed = lambda f: f"list_contains(m.may, '{f}')"
    shown = lambda k, f: f"CASE WHEN {allowed(f)} AND trim(f{k}) = '' THEN '{heading_sql(f)} (EMPTY — fill it with one write)' WHEN {allowed(f)} THEN '{heading_sql(f)}' || chr(10) || f{k}" + (f" WHEN trim(f1) <> '' THEN '### description (for reference, not to be edited)' || chr(10) || {trimmed('f1')}" if k == 1 else "") + " END"
    query("edit_requests", f"""+ {good}, {facts}, {may}, i AS ({listed_ideas}), f AS ({listed_facts}), m AS (SELECT id, list(field) AS may FROM may GROUP BY 1)
        SELECT c.id, concat_ws({gap}, {head}, 'Chosen changes, and no others:' || chr(10) || i.said, CASE WHEN f.said IS NOT NULL THEN 'Canon, to be left intact:' || chr(10) || f.said END, CASE WHEN f.kept IS NOT NULL THEN 'To survive word for word:' || chr(10) || f.kept END,
        {", ".join(shown(k, f) for k, f in enumerate(B.FIELDS, 1))}, 'Edit only: ' || concat_ws(', ', {", ".join(f"CASE WHEN {allowed(f)} THEN '{f}' END" for f in B.FIELDS)}) || '.') AS request
        FROM cards c JOIN i ON i.id = c.id JOIN m ON m.id = c.id LEFT JOIN f ON f.id = c.id""", "cards")(
        requested_sample
    )
