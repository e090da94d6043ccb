"""Card files, raw payloads, ledgers and score files as tables, and tables back as files."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.revisions import slices
from tallyloom.plans.bindings import FIELDS

from . import commits
from .payloads import PLAIN

LEDGER_FILE = "struct<version:int,cards:map<string,struct<name:string,score:double,error:string>>>"


def card_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, modificationTime, length and content of the PNG and JSON files of a folder, by name."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).withColumn("name", name)
    return files.where(F.col("name").rlike(r"(?i)\.(png|json)$")).orderBy("name")


def png_payload(data: bytes) -> str:
    """The card in a PNG's text chunks, the newer keyword first; raises ValueError where there is none."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    found, at = {}, 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind in (b"tEXt", b"zTXt"):
            key, _, rest = body.partition(b"\0")
            try:
                found.setdefault(key.decode("latin-1"), zlib.decompress(rest[1:]) if kind == b"zTXt" else rest)
            except zlib.error:
                continue
        if kind == b"IEND":
            break
    for key in ("ccv3", "chara"):  # the newer keyword first; one that can't be read gives way to the other
        for read in (lambda b: base64.b64decode(b, validate=True).decode(), lambda b: b.decode()):
            try:
                text = read(found[key])
                if isinstance(json.loads(text), dict):
                    return text
            except (KeyError, ValueError):
                continue
    raise ValueError("the card data can't be read" if found.keys() & {"ccv3", "chara"} else "no card data in the image")


def ingest_png(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, quarantine) of files (name, content): an unreadable file goes to quarantine with its reason."""

    shape = pa.schema([(c, pa.string()) for c in ("id", "payload", "reason")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for name, data in zip(b["name"].to_pylist(), b["content"].to_pylist(), strict=True):
                try:
                    out.append({"id": name, "payload": png_payload(data)})
                except ValueError as e:
                    out.append({"id": name, "reason": str(e)})
            yield pa.RecordBatch.from_pylist(out, shape)

    read = files.select("name", "content").mapInArrow(run, "id string, payload string, reason string")
    return read.where("reason IS NULL").drop("reason"), read.where("reason IS NOT NULL").drop("payload")


def png_of(payload: bytes) -> bytes:
    """The smallest image that carries a payload; for tests and the round-trip query."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"tEXt", b"chara\0" + base64.b64encode(payload)) + chunk(b"IDAT", zlib.compress(b"\0\0\0\0")) + chunk(b"IEND", b"")


def raw_cards(cards: DataFrame) -> DataFrame:
    """id and a JSON payload of each card, with arrays, a depth prompt and keys that the engine doesn't model.

    Every third one is flat, without a note; of the nested ones every second has a flat copy at the root.
    """
    plain = [F.col(f"f{k}").alias(f) for k, f in enumerate(FIELDS, 1) if f in PLAIN]
    shared = [F.col("name"), F.lit("someone").alias("creator"), *plain, F.split("f9", "\n").alias("alternate_greetings"), F.array("library_id", F.lit("tag")).alias("tags")]
    note = F.struct(F.struct((F.col("doc_id") % 5).alias("depth"), F.col("f8").alias("prompt"), F.lit("user").alias("role")).alias("depth_prompt"), F.lit(0.5).alias("talkativeness"))
    book = F.struct(F.lit("book").alias("name"), F.array(F.struct(F.array(F.lit("key")).alias("keys"), F.col("f1").alias("content"))).alias("entries"))
    data = F.struct(*shared, note.alias("extensions"), book.alias("character_book"), F.lit("noted").alias("creator_notes")).alias("data")
    spec, other = F.lit("chara_card_v3").alias("spec"), F.struct(F.lit("kept").alias("by"), F.col("doc_id").alias("number")).alias("other")
    nested, copied = F.to_json(F.struct(spec, data, other)), F.to_json(F.struct(spec, data, *shared, other))
    flat = F.to_json(F.struct(*shared, other))
    return cards.select("id", F.when(F.col("doc_id") % 3 == 0, flat).when(F.col("doc_id") % 2 == 0, copied).otherwise(nested).alias("payload"))


def read_ledger(files: DataFrame) -> DataFrame:
    """Rows of ledger files (library_id, content): one per card; a corrupt file reads as empty."""
    cards = F.from_json("content", LEDGER_FILE)["cards"]
    return files.select("library_id", F.explode(cards).alias("id", "e")).select("library_id", "id", "e.*")


def ledger_files(ledger: DataFrame, entries: int = 5_000) -> DataFrame:
    """JSON file contents (library_id, content) of about ``entries`` entries each: several a library, by a hash of the card."""
    sizes = ledger.groupBy("library_id").agg(F.ceil(F.count("*") / entries).alias("files"))
    dealt = ledger.join(F.broadcast(sizes) if sizes.limit(10_001).count() <= 10_000 else sizes, "library_id").withColumn("file", F.pmod(F.xxhash64("id"), "files"))
    rows = F.map_from_entries(F.collect_list(F.struct("id", F.struct("name", "score", "error"))))
    return dealt.groupBy("library_id", "file").agg(F.to_json(F.struct(F.lit(1).alias("version"), rows.alias("cards"))).alias("content")).drop("file")


def read_scores(files: DataFrame) -> DataFrame:
    """source, row_ord, id, name, score of score files (source, content) in any of their four shapes.

    A bare array, an array under ``scores`` or ``cards``, or a map from file to a number or an object; a score is
    called overallScore, overall_score or score. Files that hold none are listed by ``unusable_scores``.
    """
    v = F.try_parse_json("content")
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.scores", "array<variant>"), F.try_variant_get(v, "$.cards", "array<variant>"))
    score = lambda c: F.coalesce(*[F.try_variant_get(c, f"$.{k}", "double") for k in ("overallScore", "overall_score", "score")], F.try_variant_get(c, "$", "double"))
    rows = files.select("source", listed.alias("listed"), F.when(listed.isNull(), F.try_variant_get(v, "$", "map<string,variant>")).alias("mapped"))
    a = rows.select("source", F.posexplode("listed").alias("row_ord", "c")).select(
        "source", "row_ord", F.try_variant_get("c", "$.id", "string").alias("id"), F.try_variant_get("c", "$.name", "string").alias("name"), score(F.col("c")).alias("score")
    )
    b = rows.select("source", F.posexplode("mapped").alias("row_ord", "id", "c")).select("source", "row_ord", "id", F.lit(None).cast("string").alias("name"), score(F.col("c")).alias("score")).where("score IS NOT NULL")
    return a.unionAll(b)


def unusable_scores(files: DataFrame) -> DataFrame:
    """source and reason of the score files (source, content) without a single row: the reason names the keys seen."""
    some = read_scores(files).select("source").distinct()
    keys = F.map_keys(F.try_variant_get(F.try_parse_json("content"), "$", "map<string,variant>"))
    seen = F.when(F.size(keys) > 0, F.array_join(F.slice(F.array_sort(keys), 1, 10), ", ")).otherwise("none")
    return files.join(some, "source", "left_anti").select("source", F.concat(F.lit("no scores found; keys seen: "), F.coalesce(seen, F.lit("none"))).alias("reason"))


def score_files(cards: DataFrame) -> DataFrame:
    """Score files of all four shapes over ``cards`` (doc_id, id, name, score), one for each fiftieth card and shape."""
    shape = F.col("doc_id") % 4
    row = lambda key: F.struct("id", "name", F.col("score").alias(key))
    g = cards.groupBy(shape.alias("shape"), F.floor(F.col("doc_id") / 200).alias("part")).agg(
        F.collect_list(row("overallScore")).alias("a"), F.collect_list(row("overall_score")).alias("b"), F.map_from_entries(F.collect_list(F.struct("id", "score"))).alias("m")
    )
    content = F.when(F.col("shape") == 0, F.to_json("a")).when(F.col("shape") == 1, F.to_json(F.struct(F.col("b").alias("scores")))).when(F.col("shape") == 2, F.to_json(F.struct(F.col("a").alias("cards")))).otherwise(F.to_json("m"))
    return g.select(F.concat_ws("-", F.col("shape").cast("string"), F.col("part").cast("string")).alias("source"), content.alias("content"))


def publish(df: DataFrame, root: str, generation: str | None = None, base: int | None = None) -> str:
    """Write a generation beside the others and commit it; readers follow the commits, so that none sees half a write.

    ``base`` is the number of the commit that ``df`` was made from, the newest one if none is named. If another writer has committed since,
    ``commits.Conflict`` is raised and nothing has changed for readers.
    """
    spark = df.sparkSession
    if base is None:
        base = max(commits.numbers(spark, root), default=0)
    name = generation or uuid.uuid4().hex
    path = f"{root.rstrip('/')}/gen={name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    commits.commit(spark, root, base + 1, {"generation": name, "path": path})
    return path


def version(spark: SparkSession, root: str) -> int:
    """The number of the newest commit, 0 before the first."""
    return max(commits.numbers(spark, root), default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """number, generation, path of the generations; None before the first."""
    return commits.listed(spark, root)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole generation."""
    return spark.read.parquet(commits.newest(spark, root)["path"])


def export_scores(ledger: DataFrame) -> DataFrame:
    return ledger.where("score IS NOT NULL").select("id", "name", F.col("score").alias("overallScore"), F.col("tokens").alias("tokenEstimate"))
