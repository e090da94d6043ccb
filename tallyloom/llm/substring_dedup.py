"""Substring de-duplication on a compacted De Bruijn graph of the corpus.

Edges of the graph are token k-mers: windows of ``window`` consecutive words. A window is removed from a
document if a document with a smaller id has the same window. Listing every window would move many times
the text, so paths are moved instead:

1. Each window names its anchor, its smallest hashed ``seed``-word k-mer. The choice depends on the words
   alone, so equal windows name equal anchors. Consecutive windows of a document with one anchor form a
   path, stored as one row: anchor, 128-bit content, document and hash of its text, first word, number of windows.
2. Anchors that only one document has are dropped by a join with a grouped table. All windows equal to
   a remaining one lie on paths of the same anchor.
3. If an anchor has a single content, its path doesn't branch anywhere in the corpus: it is compacted to one
   edge whose source is its smallest document. If it branches, one copy of each distinct path is read again
   at its source coordinates and its windows are grouped singly.
4. Each occurrence compares its id with the source of each of its windows. Windows in a row that have their source in a row
   too are compacted to one long span with its source coordinates.
5. Spans are verified: documents are read at both coordinates, and the SHA-256 of the words there must agree. A span
   that doesn't (two contents with one 128-bit hash) stays in its text. Documents are then read again, and words in
   verified spans are dropped.

The anchor table grows with the text (about 1/22 row a word); hot anchors meet only grouped aggregates with
map-side combining and joins against one row a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, sized_broadcast

WINDOW = 50
SEED_WORDS = 8
#: Longs (list elements, and four a row) of a table that is broadcast instead of shuffled with the texts: 16 MB.
BROADCAST_LONGS = 2_000_000
CACHE = 300_000
#: Most windows of a path.
LONGEST = 4096
#: Multipliers of the two polynomial hashes.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PATHS = "doc long, row long, anchor long, c1 long, c2 long, start int, windows int"


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_words = WordHashes()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if multiplier not in _powers or len(_powers[multiplier][0]) < n:
        size = max(4096, 2 * n)
        both = []
        for m in (multiplier, pow(multiplier, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[multiplier] = (both[0], both[1])
    return _powers[multiplier]


class Sums:
    """Hashes of any run of words of one document in constant time."""

    def __init__(self, words: list[bytes]):
        look = _words
        h = np.array([look[w] for w in words], np.uint64)
        self.sides = []
        for m in MULTIPLIERS:
            up, down = powers(m, len(h))
            self.sides.append((np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)]), down))

    def runs(self, side: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        total, down = self.sides[side]
        x = (total[starts + lengths] - total[starts]) * down[starts]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value (its upper 42 bits; the first on ties) in each run of ``width`` values."""
    mask = np.uint64((1 << 22) - 1)
    out = []
    for s in range(0, len(values) - width + 1, 1 << 21):
        part = values[s : s + (1 << 21) + width - 1]
        low = (part & ~mask) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n = len(part) - width + 1
        low = np.minimum(low[:n], low[width - size : width - size + n])
        out.append((low & mask).astype(np.int64) + s)
    return np.concatenate(out)


def paths(words: list[bytes], window: int = WINDOW, seed: int = SEED_WORDS) -> tuple[np.ndarray, ...] | None:
    """anchor, c1, c2, start, windows of each path of a document; None if it has no window."""
    n = len(words)
    if n < window:
        return None
    sums = Sums(words)
    small = sums.runs(0, np.arange(n - seed + 1), seed)
    lowest = leftmost_smallest(small, window - seed + 1)
    # A path ends where the anchor's value changes, not its place: text that repeats itself keeps one path, up to LONGEST windows.
    first = np.concatenate([[True], np.diff(small[lowest]) != 0])
    place = np.arange(len(first)) - np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    start = np.flatnonzero(place % LONGEST == 0)
    count = np.diff(np.append(start, n - window + 1))
    length = count + window - 1
    return small[lowest[start]].view(np.int64), sums.runs(0, start, length).view(np.int64), sums.runs(1, start, length).view(np.int64), start, count


def all_paths(docs: DataFrame, window: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("anchor", "c1", "c2", "start", "windows")
        for b in batches:
            ids, rows, found = [], [], []
            for doc, row, text in zip(b["doc"].tolist(), b["row"].tolist(), b["text"], strict=True):
                if (x := paths(text.encode().split(), window, seed)) is not None:
                    found.append(x)
                    ids.append(np.full(len(x[0]), doc, np.int64))
                    rows.append(np.full(len(x[0]), row, np.int64))
            if found:
                yield pd.DataFrame({"doc": np.concatenate(ids), "row": np.concatenate(rows)} | {c: np.concatenate([x[i] for x in found]) for i, c in enumerate(names)})

    return docs.mapInPandas(run, PATHS)


def branch_windows(docs: DataFrame, sources: DataFrame, window: int) -> DataFrame:
    """w1, w2, src, src_row, start, at, more: each distinct window of the paths in ``sources`` (src, src_row, start, windows), read there.

    (src, src_row, start) names the path, ``at`` is the window's first place in it and ``more`` its other places, null if none:
    a path of text that repeats itself gives one row for each window of its period.
    """
    plan = sources.groupBy("src", "src_row").agg(F.collect_list(F.col("start").cast("long") * (2 * LONGEST) + F.col("windows")).alias("plan"))
    plan = small_enough(materialize(plan), "plan")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("w1", "w2", "src", "src_row", "start", "at")
        for b in batches:
            out, more = [], []
            for doc, row, text, plan in zip(b["doc"].tolist(), b["row"].tolist(), b["text"], b["plan"], strict=True):
                sums = Sums(text.encode().split())
                first, count = np.divmod(np.asarray(plan, np.int64), 2 * LONGEST)
                path = np.repeat(np.arange(len(first)), count)
                place = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
                w1, w2 = (sums.runs(side, first[path] + place, window).view(np.int64) for side in (0, 1))
                order = np.lexsort((place, w2, w1, path))
                same = (np.diff(path[order]) == 0) & (np.diff(w1[order]) == 0) & (np.diff(w2[order]) == 0)
                heads = np.flatnonzero(np.concatenate([[True], ~same]))
                keep = order[heads]
                sizes = np.diff(np.append(heads, len(order)))
                more += [place[order[h + 1 : h + n]].tolist() if n > 1 else None for h, n in zip(heads.tolist(), sizes.tolist(), strict=True)]
                out.append((w1[keep], w2[keep], np.full(len(keep), doc), np.full(len(keep), row), first[path[keep]], place[keep]))
            if out:
                yield pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, zip(*out, strict=True), strict=True)} | {"more": pd.Series(more, dtype=object)})

    same = (F.col("doc") == F.col("src")) & (F.col("row") == F.col("src_row"))
    return docs.join(plan, same).mapInPandas(run, "w1 long, w2 long, src long, src_row long, start int, at int, more array<int>")


def small_enough(df: DataFrame, lists: str) -> DataFrame:
    """``df`` with a broadcast hint if its rows and the elements of its ``lists`` are few; else it is shuffled with the texts."""
    n = df.agg(F.coalesce(F.sum(F.size(lists).cast("long") + 4), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_LONGS else df


SPAN = "a:int,b:int,src:bigint,src_row:bigint,sa:int"
SPANS = f"array<struct<{SPAN}>>"


def compacted(lists: pd.Series) -> pd.Series:
    """Windows with their sources as long spans: what continues another in the text and in the source is one span with it."""
    out = []
    for ranges in lists:
        found: list[dict] = []
        for r in sorted(ranges, key=lambda r: (r["src"], r["src_row"], r["sa"] - r["a"], r["a"], r["b"])):
            last = found[-1] if found else None
            if last and (last["src"], last["src_row"], last["sa"] - last["a"]) == (r["src"], r["src_row"], r["sa"] - r["a"]) and r["a"] <= last["b"]:
                last["b"] = max(last["b"], r["b"])
            else:
                found.append({k: r[k] for k in ("a", "b", "src", "src_row", "sa")})
        out.append(found)
    return pd.Series(out)


def read_at_coordinates(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """src, src_row, sa, n, doc, row, a, digest: the SHA-256 of the words of each span, at its source (doc is null) and in each text.

    ``spans``: doc, row, ranges. A source reads each of its spans once, however many documents repeat it.
    """
    one = spans.select("doc", "row", F.explode("ranges").alias("r")).select("doc", "row", "r.*")
    sources = one.groupBy("src", "src_row", "sa", (F.col("b") - F.col("a")).alias("n")).agg(F.lit(1).alias("one"))
    asked = sources.groupBy(F.col("src").alias("doc"), F.col("src_row").alias("row")).agg(F.collect_list(F.struct("sa", "n")).alias("asked"))
    plan = spans.join(asked, ["doc", "row"], "full").select(F.col("doc").alias("p_doc"), F.col("row").alias("p_row"), F.coalesce("ranges", F.array().cast(SPANS)).alias("own"), F.coalesce("asked", F.array().cast("array<struct<sa:int,n:int>>")).alias("asked"))
    # The plan grows with the repeated text: it is shuffled with the documents at every size.
    plan = materialize(plan)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["src", "src_row", "sa", "n", "doc", "row", "a", "digest"]
        for b in batches:
            out = []
            for doc, row, text, own, asked in zip(b["doc"].tolist(), b["row"].tolist(), b["text"], b["own"], b["asked"], strict=True):
                words = text.encode().split()
                known: dict[tuple[int, int], bytes] = {}

                def digest(at: int, n: int, words=words, known=known) -> bytes:
                    if (at, n) not in known:
                        known[at, n] = hashlib.sha256(b" ".join(words[at : at + n])).digest()
                    return known[at, n]

                out += [(doc, row, r["sa"], r["n"], None, None, None, digest(r["sa"], r["n"])) for r in asked]
                out += [(r["src"], r["src_row"], r["sa"], r["b"] - r["a"], doc, row, r["a"], digest(r["a"], r["b"] - r["a"])) for r in own]
            yield pd.DataFrame(out, columns=names).astype({"doc": "Int64", "row": "Int64", "a": "Int32"})

    same = (F.col("doc") == F.col("p_doc")) & (F.col("row") == F.col("p_row"))
    read = docs.join(plan, same).select("doc", "row", "text", "own", "asked")
    return read.mapInPandas(run, "src long, src_row long, sa int, n int, doc long, row long, a int, digest binary")


def verified(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``spans`` (doc, row, ranges) without those whose words aren't the words at their source."""
    read = materialize(read_at_coordinates(docs, spans))
    key = ["src", "src_row", "sa", "n"]
    groups = read.groupBy(*key).agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.min(F.when(F.col("doc").isNull(), F.col("digest"))).alias("right"))
    odd = materialize(groups.where("right IS NULL OR low <> high").select(*key, "right"))
    if odd.isEmpty():
        return spans
    wrong = read.where("doc IS NOT NULL").join(odd, key).where("right IS NULL OR digest <> right")
    at = F.struct("a", (F.col("a") + F.col("n")).cast("int").alias("b"), "src", "src_row", "sa")
    wrong = wrong.groupBy("doc", "row").agg(F.collect_set(at).alias("wrong"))
    kept = F.array_except("ranges", F.coalesce("wrong", F.array().cast(SPANS)))
    return materialize(spans.join(wrong, ["doc", "row"], "left").select("doc", "row", kept.alias("ranges")))


def removed_ranges(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """doc, row, ranges (verified spans a to b with their source coordinates, which may touch or overlap) of ``docs`` (doc, row, text; no nulls)."""
    everything = materialize(all_paths(docs, window, seed))
    shared = (
        everything.groupBy("anchor")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), (F.min("c1") == F.max("c1")).alias("single1"), (F.min("c2") == F.max("c2")).alias("single2"))
        .where("low < high")
        .select("anchor", (F.col("single1") & F.col("single2")).alias("single"))
    )
    found = materialize(everything.join(shared, "anchor"))
    edges = materialize(
        found.groupBy("single", "c1", "c2", "windows").agg(F.min(F.struct("doc", "row", "start")).alias("first")).select("single", "c1", "c2", "windows", "first.*")
    ).withColumnsRenamed({"doc": "src", "row": "src_row"})
    singles = materialize(branch_windows(docs, edges.where("NOT single").select("src", "src_row", "start", "windows"), window))
    # Windows that one source alone has keep that source; only the others are joined.
    several = singles.groupBy("w1", "w2").agg(F.min("src").alias("low"), F.max("src").alias("high"), F.min(F.struct("src", "src_row", (F.col("start") + F.col("at")).alias("sa"))).alias("source"))
    several = several.where("low < high").select("w1", "w2", "low", "source")
    earlier = (
        singles.join(several, ["w1", "w2"])
        .where("low < src")
        .groupBy("src", "src_row", "start")
        .agg(F.collect_list(F.struct(F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<int>"))).alias("ats"), "source")).alias("earlier"))
    )
    # Of each path of more than one document or with earlier windows: its source, and where windows have an earlier one.
    known = edges.join(earlier, ["src", "src_row", "start"], "left").select("c1", "c2", "src", "src_row", F.col("start").alias("src_start"), "earlier")
    held = found.join(known, ["c1", "c2"]).where((F.col("src") < F.col("doc")) | F.col("earlier").isNotNull())
    span = lambda a, n, src, row, sa: F.struct(a.cast("int").alias("a"), (a + n).cast("int").alias("b"), src.alias("src"), row.alias("src_row"), sa.cast("int").alias("sa"))
    whole = F.array(span(F.col("start"), F.col("windows") + (window - 1), F.col("src"), F.col("src_row"), F.col("src_start")))
    before = F.filter("earlier", lambda e: e["source"]["src"] < F.col("doc"))
    part = F.flatten(F.transform(before, lambda e: F.transform(e["ats"], lambda at: span(F.col("start") + at, F.lit(window), e["source"]["src"], e["source"]["src_row"], e["source"]["sa"]))))
    lost = held.select("doc", "row", F.when(F.col("src") < F.col("doc"), whole).otherwise(part).alias("r"))
    spans = lost.groupBy("doc", "row").agg(F.flatten(F.collect_list("r")).alias("ranges")).select("doc", "row", F.pandas_udf(compacted, SPANS)("ranges").alias("ranges"))
    return verified(docs, materialize(spans))


def removed_mask(n: int, ranges: list) -> np.ndarray:
    """Which of ``n`` words lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    if ranges is not None and len(ranges):
        np.add.at(edge, [r["a"] for r in ranges], 1)
        np.add.at(edge, [r["b"] for r in ranges], -1)
    return np.cumsum(edge)[:n] > 0


def one_each(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, row, text) with one row for each doc and row, however often they repeat; texts are shuffled only where they do."""
    repeated = docs.groupBy("doc", "row").agg(F.count("*").alias("n")).where("n > 1").select("doc", "row")
    keys, _ = sized_broadcast(materialize(repeated), BROADCAST_LONGS // 4)
    if keys.isEmpty():
        return docs
    some = docs.join(keys, ["doc", "row"], "left_semi").dropDuplicates(["doc", "row"])
    return materialize(docs.join(keys, ["doc", "row"], "left_anti").unionAll(some))


def with_ranges(df: DataFrame, id_col: str, text_col: str, window: int, seed: int) -> tuple[DataFrame, str]:
    """``df`` and a column of the word ranges to remove (null: none)."""
    docs = df.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    ranges = removed_ranges(one_each(docs), window, seed).withColumn("ranges", F.transform("ranges", lambda r: F.struct(r["a"].alias("a"), r["b"].alias("b"))))
    ranges = small_enough(ranges, "ranges")
    mine, row, name = (free_name(df.columns, c) for c in ("doc", "row", "ranges"))
    same = (F.col(id_col) == F.col(mine)) & (F.xxhash64(text_col) == F.col(row))
    joined = df.join(ranges.select(F.col("doc").alias(mine), F.col("row").alias(row), F.col("ranges").alias(name)), same, "left").drop(mine, row)
    return joined, name


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_words, n_removed, kept_sha256.

    Removes each word covered by a ``window``-word window that a document with a smaller id has too. A null
    text has no words; a row with a null id loses nothing and is no source. Rows that repeat an id are one
    document with several texts: they don't remove each other's words.
    """
    joined, ranges = with_ranges(df.select(id_col, text_col), id_col, text_col, window, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total, gone, sha = [], [], []
            for text, found in zip(b["text"], b["ranges"], strict=True):
                words = (text or "").encode().split()
                mask = removed_mask(len(words), found) if found is not None else None
                kept = words if mask is None else [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                total.append(len(words))
                gone.append(len(words) - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_words": total, "n_removed": gone, "kept_sha256": sha})

    rows = joined.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(ranges).alias("ranges"))
    return rows.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("doc_id", id_col)


def kept_text(text: str, ranges: list) -> str:
    """``text`` without the words in ``ranges``; every kept word keeps the white space before it."""
    import re

    tokens = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    mask = removed_mask(len(tokens), ranges).tolist()
    parts, last = [], 0
    for t, m in zip(tokens, mask, strict=True):
        if not m:
            parts.append(text[last : t.end()])
        last = t.end()
    return "".join(parts).lstrip(" \t\n\x0b\x0c\r") if tokens and mask[0] else "".join(parts) + text[last:]


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """``df`` with repeated passages cut from ``text_col``; other texts and columns are unchanged.

    A text of which all words go becomes empty. Null texts and rows with a null id stay as they are; rows that repeat an id
    and a text are cut alike; an empty table gives an empty result.
    """
    joined, ranges = with_ranges(df, id_col, text_col, window, seed)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if r is None or t is None else kept_text(t, r) for t, r in zip(texts, found, strict=True)])

    new = F.when(F.col(ranges).isNull(), F.col(text_col)).otherwise(kept(F.col(text_col), F.col(ranges)))
    return joined.withColumn(text_col, new).select(*df.columns)
