"""Queries over files, payloads, snapshots, copies and orders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import sql as user_sql
from tallyloom.functions.plan import once
from tallyloom.operators import cards as C
from tallyloom.operators import ledger as L
from tallyloom.operators import order
from tallyloom.operators.revisions import slices
from tallyloom.sources import files as S
from tallyloom.sources import payloads as P
from tallyloom.sources import snapshots as V
from tallyloom.streaming import jobs

from . import bindings as B
from .sql_parts import trimmed


def image_files(s: SparkSession, d: str) -> DataFrame:
    """Payloads put into images; every tenth image is broken."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([S.png_of(p.encode()) for p in b["payload"].to_pylist()], pa.binary())], ["id", "content"])

    made = S.raw_cards(B.cards(s, d)).mapInArrow(drawn, "id string, content binary")
    broken = F.substring("id", 12, 1) == "0"
    return made.select(F.replace("id", F.lit(".json"), F.lit(".png")).alias("name"), F.when(broken, F.lit(b"junk")).otherwise(F.col("content")).alias("content"))


def png_cards(s: SparkSession, d: str) -> DataFrame:
    """Images read into cards, and the quarantined ones with their reason."""
    good, bad = S.ingest_png(image_files(s, d))
    cards = P.normalize_cards(good).select("id", "name", *[f"f{k}" for k in range(1, 10)], F.lit(None).cast("string").alias("reason"))
    return cards.unionByName(bad.select("id", "reason"), allowMissingColumns=True)


def json_cards(s: SparkSession, d: str) -> DataFrame:
    """JSON files read into cards, among images; every seventh file is cut short and every eleventh holds a list."""
    k = F.col("doc_id")
    rows = S.raw_cards(B.cards(s, d)).join(B.cards(s, d).select("id", "doc_id"), "id")
    text = F.when(k % 7 == 0, F.expr("substr(payload, 1, length(payload) - 1)")).when(k % 11 == 0, F.concat(F.lit("["), F.col("payload"), F.lit("]"))).otherwise(F.col("payload"))
    files = rows.select(F.col("id").alias("name"), text.cast("binary").alias("content")).unionAll(rows.select(F.lit("picture.png").alias("name"), F.lit(b"junk").alias("content")))
    good, bad = P.ingest_json(files)
    cards = P.normalize_cards(good).select("id", "spec", "name", "f1", "f9", F.lit(None).cast("string").alias("reason"))
    return cards.unionByName(bad.select("id", "reason"), allowMissingColumns=True)


def card_listing(s: SparkSession, d: str) -> DataFrame:
    """The card files of each library's folder, among files of other kinds: how their names end. Contents aren't read."""
    root = f"{jobs.folder(s)}/cards"
    rows = B.table(s, d, "documents").select(B.doc_key(F.col("doc_id")).alias("id"), "source")
    rows.write.partitionBy("source").json(root)
    rows.limit(1).write.partitionBy("source").mode("append").csv(root)
    files = S.card_files(s, root)
    return files.select("source", F.regexp_extract(F.lower("name"), r"\.([a-z]+)$", 1).alias("kind")).distinct()


def patched(s: SparkSession, d: str) -> DataFrame:
    """Even cards get a new description, greetings and name, every fourth one a note too."""
    k = F.col("doc_id")
    fields = F.create_map(F.lit("description"), F.lit("patched"), F.lit("alternate_greetings"), F.lit("one\n\n---\n\n two \n---\n"))
    noted = F.map_concat(fields, F.create_map(F.lit("character_note"), F.lit("new note")))
    patches = B.cards(s, d).where(k % 2 == 0).select("id", F.when(k % 4 == 0, noted).otherwise(fields).alias("fields"), F.when(k % 10 == 0, " ").otherwise(" New name ").alias("name"))
    return P.field_patch(S.raw_cards(B.cards(s, d)), patches)


def patch_report(s: SparkSession, d: str) -> DataFrame:
    """What patched payloads hold, the unmodelled keys, the flat copy and the note's depth included."""
    rows = P.normalize_cards(patched(s, d), ("error",)).select("id", "name", "f1", "f2", "f8", "f9", "note_depth", F.array_join("tags", ",").alias("tags"), "error", "raw")
    rows = once(rows, v=P.json_value(F.col("raw")))
    at = lambda path: P.part(F.col("v"), path, "string")
    return rows.select(
        *rows.columns[:-2], at("$.other.number").alias("other"), F.coalesce(at("$.data.character_book.entries[0].content"), F.lit("")).alias("book"), at("$.description").alias("root_description"), at("$.name").alias("root_name"),
        at("$.data.extensions.depth_prompt.role").alias("role"),
    )


def card_file_cycle(s: SparkSession, d: str) -> DataFrame:
    """Patched payloads written as text files and read again."""
    root = jobs.folder(s)
    patched(s, d).select("payload").write.text(f"{root}/cards")
    read = s.read.text(f"{root}/cards").select(F.xxhash64("value").cast("string").alias("id"), F.col("value").alias("payload"))
    return P.normalize_cards(read).select("name", "f1", "f2", "f9", F.get_json_object("raw", "$.other.number").alias("other"), "flat")


def publish_cycle(s: SparkSession, d: str) -> DataFrame:
    """Two generations, then one that was written but never entered: the newest entered one is read."""
    root = jobs.folder(s)
    S.publish(B.ledger(s, d).select("id", "score").limit(0), root)
    S.publish(B.ledger(s, d).select("id", "score").where("score > 5"), root)
    B.ledger(s, d).select("id", "score").write.parquet(f"{root}/gen=half-written")
    return S.published(s, root)


def snapshots(s: SparkSession, d: str) -> DataFrame:
    """Forty snapshots of the ledger: the name carries library, time and reason; later ones hold fewer cards."""
    n = F.explode(F.sequence(F.lit(0).cast("long"), F.col("doc_id") % 40)).alias("n")
    rows = B.ledger(s, d).select("score", n)
    name = F.concat(F.lit("cache-lib"), (F.col("n") % 2).cast("string"), F.lit("--2024-01-"), F.lpad((F.col("n") + 1).cast("string"), 2, "0"), F.lit("--"), F.when(F.col("n") % 3 == 0, "startup").otherwise("before-import"))
    return rows.select(name.alias("snapshot"), "score")


_SNAP = """+ snaps AS (SELECT 'cache-lib' || (n % 2) || '--2024-01-' || lpad(CAST(n + 1 AS VARCHAR), 2, '0') || '--' || CASE WHEN n % 3 = 0 THEN 'startup' ELSE 'before-import' END AS snapshot, score
    FROM ledger JOIN (SELECT range AS n FROM range(40)) ON doc_id % 40 >= n),
    inv AS (SELECT snapshot, split_part(snapshot, '--', 1) AS library, split_part(snapshot, '--', 2) AS taken, split_part(snapshot, '--', 3) AS reason, count(*) AS cards, count(score) AS scored FROM snaps GROUP BY 1) """


def snapshot_cycle(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the ledger, the inventory) after a snapshot, a rewrite that loses scores, and a restore. An empty ledger is never kept."""
    root = jobs.folder(s)
    live = B.ledger(s, d).select("id", "score")
    S.publish(live, root)
    first = V.take(S.published(s, root), root, "lib", "2024-01-01", "before-rescore")
    S.publish(live.where("score > 5"), root)
    V.take(live.limit(0), root, "lib", "2024-01-02", "startup")
    after = V.restore(s, root, first, "lib", "2024-01-03")
    names = [r.snapshot for r in V.listed(s, root).collect()]  # as many as snapshots were taken
    rows = [s.read.parquet(f"{root}/snapshots/{n}").select(F.lit(n).alias("snapshot"), "score") for n in names]
    return after, V.inventory(rows[0].unionAll(rows[1]))


def keepers(s: SparkSession, d: str) -> DataFrame:
    """Copying all cards to a library that has some of the names, with the same or other content, and some numbered copies."""
    k = F.col("doc_id")
    rows = B.cards(s, d).withColumn("hash", B.card_hash())
    numbered = lambda n: F.replace("id", F.lit(".json"), F.lit(f" ({n}).json"))
    there = rows.where(k % 3 == 0).select("id", F.when(k % 2 == 0, F.col("hash")).otherwise("other").alias("hash"))
    there = there.unionAll(rows.where(k % 9 == 0).select(numbered(2).alias("id"), F.lit("other").alias("hash"))).unionAll(rows.where(k % 27 == 0).select(numbered(3).alias("id"), F.lit("other").alias("hash")))
    has = rows.where(k % 5 == 0).select("id").unionAll(rows.where(k % 6 == 3).select(numbered(2).alias("id")))
    return L.publish_keepers(rows, there, B.ledger(s, d), has)


def sort_modes(s: SparkSession, d: str) -> DataFrame:
    """Each card's place in every order."""
    rows = C.card_summary(B.cards(s, d).withColumn("tokens", B.token_total()), B.ledger(s, d)).select("id", "name", "score", "tokens")
    out = rows
    for mode in ("score_asc", "score_desc", "tokens_asc", "tokens_desc", "name"):
        out = order.placed(out, order.order_of(mode), f"by_{mode}")
    return out.drop("name", "score", "tokens")


def sql_functions(s: SparkSession, d: str) -> DataFrame:
    """The functions as SQL calls them."""
    user_sql.register(s)
    B.ledger(s, d).createOrReplaceTempView("tallyloom_ledger")
    return s.sql("""SELECT id, error_kind(error) AS kind, dedupe_key(concat(name, ' (old) v2 Copy')) AS key, token_estimate(name) AS tokens, array_join(detail_terms(concat('Mira, 3 feet tall; ', name)), '|') AS terms,
        weighted_overall(map('description', CAST(1 + doc_id % 10 AS INT), 'first_mes', CAST(1 + doc_id % 9 AS INT))) AS overall FROM tallyloom_ledger""")


def register(query) -> None:
    from .registry import KIND

    sep = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    greetings = f"coalesce(array_to_string(list_filter(string_split(f9, chr(10)), lambda x: x <> ''), {sep}), '')"
    spec = "CASE WHEN doc_id % 3 = 0 THEN 'chara_card_v1' ELSE 'chara_card_v3' END"
    note = "CASE WHEN doc_id % 3 = 0 THEN '' ELSE f8 END"
    lines = ", ".join(f"f{k}" for k in range(1, 8))
    depth = "CASE WHEN doc_id % 3 = 0 THEN 4 ELSE CAST(doc_id % 5 AS INTEGER) END"
    query("normalize_cards", f"SELECT id, {spec} AS spec, name, 'someone' AS creator, library_id || ',tag' AS tags, {lines}, {note} AS f8, {greetings} AS f9, doc_id % 3 = 0 AS flat, {depth} AS note_depth FROM cards", "cards")(
        lambda s, d: P.normalize_cards(S.raw_cards(B.cards(s, d))).drop("raw").withColumn("tags", F.array_join("tags", ","))
    )
    broken = "substr(id, 12, 1) = '0'"
    cell = lambda c, name: f"CASE WHEN NOT {broken} THEN {c} END AS {name}"
    cells = ", ".join([cell(f"f{k}", f"f{k}") for k in range(1, 8)] + [cell(note, "f8"), cell(greetings, "f9")])
    query("ingest_png_roundtrip", f"SELECT replace(id, '.json', '.png') AS id, {cell('name', 'name')}, {cells}, CASE WHEN {broken} THEN 'not a PNG file' END AS reason FROM cards", "cards")(png_cards)
    bad = "doc_id % 7 = 0 OR doc_id % 11 = 0"
    query("ingest_json", f"SELECT id, CASE WHEN NOT ({bad}) THEN {spec} END AS spec, CASE WHEN NOT ({bad}) THEN name END AS name, CASE WHEN NOT ({bad}) THEN f1 END AS f1, CASE WHEN NOT ({bad}) THEN {greetings} END AS f9, CASE WHEN doc_id % 7 = 0 THEN 'not valid JSON' WHEN doc_id % 11 = 0 THEN 'no usable card object' END AS reason FROM cards", "cards")(json_cards)
    query("src_card_files", "SELECT DISTINCT source, 'json' AS kind FROM documents")(card_listing)
    split = f"list_filter(list_transform(regexp_split_to_array(array_to_string(list_filter(u, lambda x: x <> ''), {sep}), '\\n*---\\n*'), lambda x: {trimmed('x')}), lambda x: x <> '')"
    query("greetings_roundtrip", f"SELECT id, array_to_string({split}, '|') AS parts FROM (SELECT id, [f1, f2, '', f3] AS u FROM cards)", "cards")(
        lambda s, d: B.cards(s, d).select("id", F.array_join(P.greetings_split(P.greetings_join(F.array("f1", "f2", F.lit(""), "f3"))), "|").alias("parts"))
    )
    query("ledger_explode", "SELECT library_id, id, name, score, error FROM ledger", "ledger")(lambda s, d: S.read_ledger(S.ledger_files(B.ledger(s, d), 50)))
    query("import_shapes", "SELECT (doc_id % 4) || '-' || (doc_id // 200) AS source, id, CASE WHEN doc_id % 4 <> 3 THEN name END AS name, score FROM ledger WHERE score IS NOT NULL", "ledger")(
        lambda s, d: S.read_scores(S.score_files(B.ledger(s, d).where("score IS NOT NULL"))).drop("row_ord")
    )
    query("import_unusable", "SELECT id AS source, 'no scores found; keys seen: ' || CASE WHEN doc_id % 2 = 0 THEN 'a, b' ELSE 'none' END AS reason FROM cards WHERE doc_id % 3 > 0", "cards")(
        lambda s, d: S.unusable_scores(B.cards(s, d).select(F.col("id").alias("source"), F.when(F.col("doc_id") % 3 == 0, '{"x.png":7}').when(F.col("doc_id") % 2 == 0, '{"b":[],"a":"x"}').otherwise("[]").alias("content")))
    )
    query("ledger_publish", "SELECT id, score FROM ledger WHERE score > 5", "ledger")(publish_cycle)
    query("export_scores", "SELECT id, name, score AS \"overallScore\", tokens AS \"tokenEstimate\" FROM ledger WHERE score IS NOT NULL", "ledger")(lambda s, d: S.export_scores(B.ledger(s, d)))
    flat, fails = "doc_id % 3 = 0", "(doc_id % 3 = 0 AND doc_id % 4 = 0)"
    new = lambda then, other: f"CASE WHEN {fails} THEN {other} ELSE {then} END"
    renamed = f"CASE WHEN {fails} OR doc_id % 10 = 0 THEN name ELSE 'New name' END"
    two = f"'one' || {sep} || 'two'"
    query("field_patch", f"""SELECT id, {renamed} AS name, {new("'patched'", 'f1')} AS f1, f2, CASE WHEN {flat} THEN '' WHEN doc_id % 4 = 0 THEN 'new note' ELSE f8 END AS f8, {new(two, greetings)} AS f9, {depth} AS note_depth, library_id || ',tag' AS tags,
        CASE WHEN {fails} THEN 'a flat card has no character note' END AS error, CAST(doc_id AS VARCHAR) AS other, CASE WHEN {flat} THEN '' ELSE f1 END AS book, {new("'patched'", 'f1')} AS root_description, {renamed} AS root_name, CASE WHEN NOT {flat} THEN 'user' END AS role
        FROM cards WHERE doc_id % 2 = 0""", "cards")(patch_report)  # fmt: skip
    query("card_json_export", f"SELECT {renamed} AS name, {new(chr(39) + 'patched' + chr(39), 'f1')} AS f1, f2, {new(two, greetings)} AS f9, CAST(doc_id AS VARCHAR) AS other, {flat} AS flat FROM cards WHERE doc_id % 2 = 0", "cards")(card_file_cycle)
    query("snapshot_inventory", _SNAP + "SELECT * FROM inv", "ledger")(lambda s, d: V.inventory(snapshots(s, d)))
    query("snapshot_retention", _SNAP + f"SELECT snapshot FROM inv QUALIFY row_number() OVER (PARTITION BY library ORDER BY taken DESC, snapshot DESC) > {V.KEEP}", "ledger")(lambda s, d: V.expired(V.inventory(snapshots(s, d))))
    query("snapshot_cycle", "SELECT id, score FROM ledger", "ledger")(lambda s, d: snapshot_cycle(s, d)[0])
    kept = "SELECT 'cache-lib--{}--{}' AS snapshot, 'cache-lib' AS library, '{}' AS taken, '{}' AS reason, count(*) AS cards, count(score) AS scored FROM ledger"
    made = lambda stamp, reason: kept.format(stamp, reason, stamp, reason)
    query("snapshot_log", made("2024-01-01", "before-rescore") + " UNION ALL " + made("2024-01-03", "before-restore") + " WHERE score > 5", "ledger")(lambda s, d: snapshot_cycle(s, d)[1])
    state = "CASE WHEN doc_id % 3 <> 0 THEN 'copied' WHEN doc_id % 2 = 0 THEN 'skipped' ELSE 'renamed' END"
    number = "CASE WHEN doc_id % 27 = 0 THEN 4 WHEN doc_id % 9 = 0 THEN 3 ELSE 2 END"
    query("publish_keepers", f"""SELECT id, CASE state WHEN 'copied' THEN id WHEN 'renamed' THEN replace(id, '.json', ' (' || n || ').json') END AS copied_to, state AS action,
        known AND NOT CASE WHEN state = 'renamed' THEN n = 2 AND doc_id % 6 = 3 ELSE doc_id % 5 = 0 END AS score_travels FROM (SELECT *, {state} AS state, {number} AS n, id IN (SELECT id FROM ledger) AS known FROM cards)""", "cards", "ledger")(keepers)  # fmt: skip
    tokens = "CAST(" + " + ".join(f"ceil(length(c.f{k})/4.0)" for k in range(1, 10)) + " AS BIGINT)"
    place = lambda by: f"row_number() OVER (ORDER BY {by}, id)"
    query("sort_modes", f"SELECT id, {place('s')} AS by_score_asc, {place('s DESC')} AS by_score_desc, {place('t')} AS by_tokens_asc, {place('t DESC')} AS by_tokens_desc, {place('name')} AS by_name FROM (SELECT c.id, c.name, coalesce(l.score, -1) AS s, {tokens} AS t FROM cards c LEFT JOIN ledger l ON c.id = l.id)", "cards", "ledger")(sort_modes)
    d, m = "(1 + doc_id % 10)", "(1 + doc_id % 9)"
    query("sql_functions", f"""SELECT id, {KIND} AS kind, 'doc' AS key, CAST(ceil(length(name) / 4.0) AS BIGINT) AS tokens, array_to_string(list_sort(list_distinct(['3 feet', CAST(doc_id AS VARCHAR), 'mira', 'feet', 'tall'])), '|') AS terms,
        floor((0.0::DOUBLE + {d} * 0.3::DOUBLE + {m} * 0.25::DOUBLE) / (0.0::DOUBLE + 0.3::DOUBLE + 0.25::DOUBLE) * 10 + 0.5) / 10.0 AS overall FROM ledger""", "ledger")(sql_functions)  # fmt: skip
