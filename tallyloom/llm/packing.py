"""Cost-balanced packing of documents into training sequences.

Map side: each document becomes token ids plus one separator id. Full sequences of a longer document stand alone;
what is left, or the whole of a shorter one, is its body, which goes on with its ids: less than a sequence each.

Group side: bodies are dealt at random into groups of about ``GROUP_BODIES``. A group opens as many sequences as its
tokens fill. In descending length, each body goes whole to the sequence with the lowest cost so far (linear plus
quadratic attention cost) among those with room for it; a tree over the room left finds it exactly. Bodies that
fit nowhere whole come last and are cut to fill the gaps, the widest first. So a group pads one sequence, and only
documents over ``CAPACITY`` and those that the gaps need are cut.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
#: Cost of a piece of n tokens: n + n * n / QUADRATIC.
QUADRATIC = 1024
GROUP_BODIES = 10_000
#: Groups of a task: about 64 MB of ids, whatever the number of documents.
TASK_GROUPS = 4
#: Entries of a worker's cache of encoded words.
CACHE = 200_000
#: Takes in more than the pre-tokenizer's white space.
TWO_SPACES = re.compile(r"\s\s")
#: A blank that is no word's own, but for those at the ends.
LOOSE = re.compile(r" \s")
NOT_LATIN = re.compile("[^\0-\u024f]")
#: A word that is not Latin, with the blank before it.
WIDE = re.compile("((?:^| )[^ ]*[^\0-\u024f][^ ]*)")
#: A text has few words that are not Latin if it has so many words for each of their characters.
FEW = 8
SEPARATOR = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
BODIES = PIECES + ", sequence_id long, slot long, ids binary"
#: Sequence ids of full sequences of one document start here; a task's number and a running number follow.
ALONE = 1 << 62


class WordEncoder:
    """Token ids of a text as little-endian 32-bit bytes, equal to what ``tokenizers`` gives for the vocabulary file.

    The rank file of the same vocabulary encodes plain Latin texts, whole. The pre-tokenizer never joins text across a
    single blank between two other characters, so other texts are split at their blanks: all words come from a bounded
    cache or, where few are not Latin, these alone, and the rest goes by the rank file in runs. New words that are not
    Latin, and a text that spells a special token, go through ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        added = {t.content: i for i, t in self.full.get_added_tokens_decoder().items()}
        self.special = list(added)
        by_pattern = lambda p: tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=table, special_tokens=added)._core_bpe
        self.plain = by_pattern(public_tokenizers.PATTERN)
        #: The pattern's lookahead tells where a run of white space ends. Without such runs it decides nothing and costs most of the time.
        self.no_runs = by_pattern(public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""))
        self.two_bytes = self.full.get_vocab_size() <= 1 << 16
        self.cache: dict[str, bytes] = {}

    def by_ranks(self, text: str) -> bytes:
        encoding = self.plain if TWO_SPACES.search(text) else self.no_runs
        return bytes(encoding.encode_to_tiktoken_buffer(text, set()))

    def by_library(self, text: str) -> bytes:
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        return self.by_ranks(text) if latin(text) else self.by_library(text)

    def word(self, word: str) -> bytes:
        """A blank and a word, from a bounded cache."""
        found = self.cache.get(word)
        if found is None:
            found = self.part(" " + word)
            if len(self.cache) >= CACHE:
                self.cache.clear()
            if len(word) < 40:
                self.cache[word] = found
        return found

    def narrow(self, ids: bytes) -> bytes:
        """32-bit ids in two bytes each, where the vocabulary allows it."""
        return np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.two_bytes else ids

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.by_library(text)
        if latin(text):
            return self.by_ranks(text)
        parts = text.split(" ")
        # A run of blanks, one at an end or before other white space: cut only where both neighbours are not blank.
        if text[0] == " " or text[-1] == " " or LOOSE.search(text):
            return self.by_library(text)
        if FEW * (len(text) - len(text.encode("latin-1", "ignore"))) > len(parts):
            known = self.cache.get
            return self.part(parts[0]) + b"".join([known(p) or self.word(p) for p in parts[1:]])
        return b"".join(self.word(p[1:]) if k % 2 and p[0] == " " else self.part(p) for k, p in enumerate(WIDE.split(text)) if p)


def latin(text: str) -> bool:
    return text.isascii() or not NOT_LATIN.search(text)


class Rooms:
    """Open sequences by the room that they have left; the lowest cost among those with room enough is found in a tree of minima."""

    NONE = (float("inf"), -1)

    def __init__(self, sequences: int, capacity: int):
        self.capacity = capacity
        self.size = 1 << (capacity - 1).bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity)]
        self.tree = [self.NONE] * (2 * self.size)
        self.room: list[int] = []
        for _ in range(sequences):
            self.open()

    def open(self) -> None:
        self.room.append(self.capacity)
        self.put((0.0, len(self.room) - 1))

    def put(self, entry: tuple[float, int]) -> None:
        leaf = self.room[entry[1]] - 1
        heapq.heappush(self.heaps[leaf], entry)
        self.mend(leaf)

    def mend(self, leaf: int) -> None:
        tree, i = self.tree, self.size + leaf
        heap = self.heaps[leaf]
        tree[i] = heap[0] if heap else self.NONE
        while i > 1:
            i //= 2
            least = min(tree[2 * i], tree[2 * i + 1])
            if tree[i] == least:
                return
            tree[i] = least

    def cheapest(self, tokens: int) -> int:
        """The lowest-cost sequence with room for so many tokens, or -1."""
        tree, i = self.tree, self.size + tokens - 1
        best = tree[i]
        while i > 1:
            if not i & 1 and tree[i + 1] < best:
                best = tree[i + 1]
            i //= 2
        return best[1]

    def widest(self) -> int:
        """The sequence with the most room (of these the lowest cost), or -1."""
        tree, i = self.tree, 1
        while i < self.size:
            i = 2 * i + (tree[2 * i + 1] is not self.NONE)
        return tree[i][1]

    def take(self, sequence: int, tokens: int) -> int:
        """Put so many tokens into a sequence that ``cheapest`` or ``widest`` has named; their offset in it."""
        room = self.room[sequence]
        cost, _ = heapq.heappop(self.heaps[room - 1])
        self.mend(room - 1)
        self.room[sequence] = room - tokens
        if room > tokens:
            self.put((cost + tokens + tokens * tokens / QUADRATIC, sequence))
        return self.capacity - room


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int, int]]]:
    """(start, length, sequence, offset) of the pieces of each body; most bodies are one piece."""
    if max(lengths, default=0) > capacity:
        raise ValueError("a body is longer than a sequence")
    rooms = Rooms(sum(lengths) // capacity, capacity)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    late = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.cheapest(lengths[i])
        if found < 0:
            late.append(i)
        else:
            pieces[i].append((0, lengths[i], found, rooms.take(found, lengths[i])))
    for i in late:
        start = 0
        while start < lengths[i]:
            rest = lengths[i] - start
            found = rooms.cheapest(rest)
            if found < 0 and (found := rooms.widest()) < 0:
                rooms.open()
                found = len(rooms.room) - 1
            n = min(rest, rooms.room[found])
            pieces[i].append((start, n, found, rooms.take(found, n)))
            start += n
    return pieces


def document_bodies(df: DataFrame, id_col: str, text_col: str, vocabulary: str, ranks: str) -> DataFrame:
    """One row for each full sequence of a document (with its sequence_id) and one for its body (with its ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = worker_encoder(vocabulary, ranks)
        tail = SEPARATOR.to_bytes(4, "little")
        task, number = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                data = encode(text) + tail
                n = len(data) // 4
                body = n // CAPACITY * CAPACITY
                for start in range(0, body, CAPACITY):
                    rows.append((doc, start, CAPACITY, zlib.crc32(data[4 * start : 4 * (start + CAPACITY)]), n, ALONE + (task << 36) + number, None, None))
                    number += 1
                if body < n:
                    ids = data[4 * body :] if body else data
                    rows.append((doc, body, n - body, zlib.crc32(ids), n, None, (task << 36) + number, encode.narrow(ids)))
                    number += 1
            names = [c.split()[0] for c in BODIES.split(", ")]
            # Columns with nulls are built as nullable longs: floats would round their large numbers.
            columns = zip(names, zip(*rows, strict=True) if rows else [()] * len(names), strict=True)
            yield pd.DataFrame({c: pd.array(x, "Int64") if c in ("doc_id", "sequence_id", "slot") else list(x) for c, x in columns})

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(run, BODIES)


_encoders: dict[tuple[str, str], WordEncoder] = {}


def worker_encoder(vocabulary: str, ranks: str) -> WordEncoder:
    """One encoder for each Python worker."""
    key = (vocabulary, ranks)
    if key not in _encoders:
        _encoders[key] = WordEncoder(vocabulary, ranks)
    return _encoders[key]


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and gives one piece, the separator. A null id stays null. Rows that repeat an id, or an id and
    a text, are packed each on their own. Every id of a document lies in exactly one piece; the pieces of a sequence lie
    end to end from offset 0. An empty table gives an empty result; further columns are left out.

    Which group a body is packed in follows its place in the input: another layout of the same files gives another packing, as good a one.
    """
    rows = materialize(document_bodies(df, id_col, text_col, vocabulary, ranks))
    bodies = rows.where("sequence_id IS NULL")
    groups = max(1, -(-bodies.count() // GROUP_BODIES))

    def group_pack(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "doc_id", "start", "ids_crc32", "slot"], ascending=[False, True, True, True, True]).reset_index(drop=True)
        lengths, sums, ids = b["length"].tolist(), b["ids_crc32"].tolist(), b["ids"].tolist()
        at, out = [], []
        for i, pieces in enumerate(pack(lengths)):
            for start, n, sequence, offset in pieces:
                crc = sums[i] if n == lengths[i] else zlib.crc32(wide(ids[i], lengths[i], start, n))
                at.append(i)
                out.append((start, n, crc, (int(key[0]) << 32) + sequence, offset))
        made = b[["doc_id", "start", "doc_tokens"]].iloc[at].reset_index(drop=True)
        for k, name in enumerate(("start", "length", "ids_crc32", "sequence_id", "offset")):
            value = [x[k] for x in out]
            made[name] = made["start"] + value if name == "start" else value
        return made[[c.split()[0] for c in PACKED.split(", ")]].astype({"doc_id": "Int64"})

    dealt = bodies.drop("sequence_id").withColumn("bin", F.pmod(F.xxhash64("slot"), F.lit(groups)))
    packed = dealt.repartition(-(-groups // TASK_GROUPS), "bin").groupBy("bin").applyInPandas(group_pack, PACKED)
    alone = rows.where("sequence_id IS NOT NULL").drop("slot", "ids").withColumn("offset", F.lit(0).cast("long"))
    return alone.unionByName(packed)


def wide(ids: bytes, tokens: int, start: int, n: int) -> bytes:
    """Little-endian 32-bit form of ``n`` of a body's ids, which are stored in two or four bytes each."""
    size = len(ids) // tokens
    return np.frombuffer(ids, f"<u{size}")[start : start + n].astype("<u4").tobytes()
