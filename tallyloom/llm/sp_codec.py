"""Sampled SentencePiece segmentation by forward filtering and backward sampling, and its inverse.

The lattice is over UTF-8 bytes: every piece of the vocabulary is an edge (its word mark is a blank), and every
byte has its byte piece, so each text has a path and decoding gives back each byte. Edges weigh
1 / (1 + rank of the piece), ``sharpness`` times over; byte pieces weigh as the rarest. No piece has a blank after
another character, so a document's lattice falls apart, without loss, before each run of blanks: forward sums are
made once for each distinct unit (blanks and word) of a slice, all units together, and all occurrences are then
sampled backwards together, a step at a time, with numpy. Forward sums of long units are kept as logarithms, so
that a text without blanks is one unit whatever its length.

The random number of a step depends on the row key, the unit's place and the step alone: the same key and text
give the same ids on any cluster, in any batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SHARPNESS = 2.0
#: Characters whose units are sampled together.
SLICE = 3_000_000
#: From so many bytes on, a unit's forward sums are kept as logarithms: products of more weights leave the range of doubles.
LONG = 30
#: Multiplier of the hash that the trie is kept by.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
RUNS = re.compile(rb"(?<! )(?= )")


class Codec:
    def __init__(self, model: str, sharpness: float = SHARPNESS):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
        self.bytes_of: list[bytes] = [b""] * sp.get_piece_size()
        self.weight: dict[bytes, tuple[int, float]] = {}
        ranked = 0
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[int(piece[3:5], 16)] = i
            else:
                self.bytes_of[i] = piece.replace("▁", " ").encode()
                self.weight[self.bytes_of[i]] = (i, (1 + ranked) ** -sharpness)
                ranked += 1
        if any(b" " in p.lstrip(b" ") for p in self.weight):
            raise ValueError("a piece joins words: texts can't be cut at blanks")
        self.rare = (1 + ranked) ** -sharpness
        # A trie as sorted hashes: for each length, every prefix of a piece, with the piece that it is (or -1).
        self.trie: list[tuple[np.ndarray, np.ndarray]] = []
        prefixes: dict[int, dict[int, int]] = {}
        for piece, (i, _) in self.weight.items():
            h = 0
            for n, byte in enumerate(piece, 1):
                h = (h * BASE + byte + 1) & MASK
                level = prefixes.setdefault(n, {})
                if level.setdefault(h, -1) < 0 and n == len(piece):
                    level[h] = i
        for n in range(1, max(prefixes, default=0) + 1):
            keys = np.array(sorted(prefixes[n]), np.uint64)
            self.trie.append((keys, np.array([prefixes[n][int(k)] for k in keys], np.int64)))
        self.weights = np.full(len(self.bytes_of), self.rare)
        for i, x in self.weight.values():
            self.weights[i] = x
        self.byte_ids = np.array(self.byte_id, np.int64)

    def edges(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """First node and size of each unit; starts, ends and ids of the edges, sorted by end. A unit of n bytes has n + 1 nodes."""
        data = np.frombuffer(b"".join(units), np.uint8).astype(np.int64)
        size = np.fromiter(map(len, units), np.int64, len(units))
        base = np.cumsum(size + 1) - size - 1
        unit = np.repeat(np.arange(len(units)), size)
        place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
        node = base[unit] + place  # where an edge from this byte starts
        left = size[unit] - place
        starts, ends, ids = [node], [node + 1], [self.byte_ids[data]]
        at, h = np.arange(len(data)), np.zeros(len(data), np.uint64)
        for n, (keys, piece) in enumerate(self.trie, 1):
            h = h * np.uint64(BASE) + (data[at + n - 1] + 1).astype(np.uint64)
            found = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[found] == h
            at, h, found = at[hit], h[hit], piece[found[hit]]
            whole = found >= 0
            starts.append(node[at[whole]])
            ends.append(node[at[whole]] + n)
            ids.append(found[whole])
            more = left[at] > n
            at, h = at[more], h[more]
            if not len(at):
                break
        starts, ends, ids = np.concatenate(starts), np.concatenate(ends), np.concatenate(ids)
        order = np.argsort(ends, kind="stable")
        return base, size, starts[order], ends[order], ids[order]

    def lattices(self, units: list[bytes]) -> tuple[np.ndarray, ...]:
        """First and last node of each unit; cumulative shares, starts and ids of the edges, by the node that they end at.

        The cumulative share of an edge is its end node's number plus its place between 0 and 1, so that one sorted
        array serves every node.
        """
        base, size, starts, ends, ids = self.edges(units)
        owner = np.repeat(np.arange(len(units)), size + 1)
        unit = owner[ends]
        depth = ends - base[unit]
        weight = self.weights[ids]
        share = np.empty(len(ends))
        for long in (False, True):
            mine = np.flatnonzero((size[unit] >= LONG) == long)
            if len(mine):
                forward = log_sums if long else sums
                share[mine] = forward(starts[mine], ends[mine], depth[mine], weight[mine], base, int(size.sum()) + len(units))
        total = np.cumsum(share)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(ends) != 0]))
        before = np.concatenate([[0.0], total])[heads]
        cumulative = ends + np.clip(total - np.repeat(before, np.diff(np.append(heads, len(ends)))), 0.0, 1.0)
        cumulative[np.append(heads[1:], len(ends)) - 1] = ends[heads] + 1.0
        return base, base + size, cumulative, starts, ids

    def encode(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Sampled ids of each text; the same key and text give the same ids."""
        number = Numbers()
        units, place, owner = [], [], []
        for d, text in enumerate(texts):
            mine = list(map(number.__getitem__, cuts(text.encode())))
            units.append(np.array(mine, np.int64))
            place.append(np.arange(len(mine), dtype=np.uint64))
            owner.append(np.full(len(mine), d, np.int64))
        if not number:
            return [np.empty(0, np.int64) for _ in texts]
        unit, place, owner = np.concatenate(units), np.concatenate(place), np.concatenate(owner)
        base, last, cumulative, starts, ids = self.lattices(list(number))
        seed = np.array(keys, np.int64).view(np.uint64)[owner]
        at, begin = last[unit], base[unit]
        live = np.argsort(unit, kind="stable")  # so that look-ups go through the lattices in order
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            u = uniform(seed[live], place[live], len(steps))
            edge = np.searchsorted(cumulative, at[live] + u, side="right")
            steps.append((live, ids[edge]))
            at[live] = starts[edge]
            live = live[at[live] != begin[live]]
        occurrence = np.concatenate([x for x, _ in steps])
        step = np.repeat(np.arange(len(steps)), [len(x) for x, _ in steps])
        order = np.lexsort((-step, occurrence))
        sampled = np.concatenate([x for _, x in steps])[order]
        counts = np.bincount(owner[occurrence], minlength=len(texts))
        return np.split(sampled, np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids.tolist()]).decode()


class Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def levels(ends: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (positions) by the depth of their end, and where each end node's edges start among them."""
    by_depth = np.argsort(depth, kind="stable")
    for e in np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1):
        yield e, np.flatnonzero(np.concatenate([[True], np.diff(ends[e]) != 0]))


def sums(starts, ends, depth, weight, base, nodes) -> np.ndarray:
    """Each edge's share in the forward sum of its end node."""
    alpha = np.zeros(nodes)
    alpha[base] = 1.0
    for e, heads in levels(ends, depth):
        alpha[ends[e[heads]]] = np.add.reduceat(alpha[starts[e]] * weight[e], heads)
    return alpha[starts] * weight / alpha[ends]


def log_sums(starts, ends, depth, weight, base, nodes) -> np.ndarray:
    """The same with logarithms, for units whose sums leave the range of doubles."""
    alpha = np.full(nodes, -np.inf)
    alpha[base] = 0.0
    weight = np.log(weight)
    for e, heads in levels(ends, depth):
        x = alpha[starts[e]] + weight[e]
        most = np.maximum.reduceat(x, heads)
        many = np.diff(np.append(heads, len(x)))
        alpha[ends[e[heads]]] = most + np.log(np.add.reduceat(np.exp(x - np.repeat(most, many)), heads))
    return np.exp(alpha[starts] + weight - alpha[ends])


def cuts(data: bytes) -> list[bytes]:
    """Units of a text: cut before each run of blanks. Joined they are the text."""
    if b"  " in data or data[:1] == b" ":
        return [x for x in RUNS.split(data) if x]
    first, *rest = data.split(b" ")
    units = [b" " + x for x in rest]
    return [first, *units] if first else units


def uniform(seed: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on the three values only (the splitmix64 finalizer)."""
    x = seed + place * np.uint64(0x9E3779B97F4A7C15) + np.uint64((step + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


_codecs: dict[tuple[str, float], Codec] = {}


def worker_codec(model: str, sharpness: float) -> Codec:
    if (model, sharpness) not in _codecs:
        _codecs[model, sharpness] = Codec(model, sharpness)
    return _codecs[model, sharpness]


def slices(texts: list[str]) -> Iterator[slice]:
    """Consecutive texts of about SLICE characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """``id_col`` and ids (array of int) of each text, sampled with the hash of the id as key.

    A null text has no ids, as an empty one; a null id is a key of its own; repeated rows get equal ids; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(model, sharpness)
        for b in batches:
            texts, keys = b["text"].tolist(), b["key"].tolist()
            for part in slices(texts):
                yield pd.DataFrame({"id": b["id"].iloc[part].astype("Int64").to_numpy(), "ids": codec.encode(texts[part], keys[part])}).astype({"id": "Int64"})

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def decoded(df: DataFrame, ids_col: str = "ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with ``text_col``: the text that ``ids_col`` spells; null for null ids."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        codec = worker_codec(model, SHARPNESS)
        return pd.Series([None if x is None else codec.decode(np.asarray(x)) for x in ids])

    return df.withColumn(text_col, text(F.col(ids_col)))


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n_pieces, ids_crc32 (little-endian 32-bit ids), text_sha256 of the decoded text, lossless."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_codec(model, sharpness)
        for b in batches:
            texts, keys = b["text"].tolist(), b["key"].tolist()
            rows = []
            for part in slices(texts):
                for text, ids in zip(texts[part], codec.encode(texts[part], keys[part]), strict=True):
                    back = codec.decode(ids)
                    rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text))
            out = pd.DataFrame(rows, columns=["n_pieces", "ids_crc32", "text_sha256", "lossless"])
            out.insert(0, "id", b["id"].astype("Int64"))
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, "id long, n_pieces long, ids_crc32 long, text_sha256 string, lossless boolean").withColumnRenamed("id", id_col)
