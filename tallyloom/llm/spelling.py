"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector holds how many of its letters fall into each of ``GROUPS`` letter groups. Arranged by one count after another, the words
are the leaves of a trie. One inserted letter adds one to one count, a deleted one takes one away, a replaced one does both or neither.
So a search descends with a budget of one surplus and one deficit, and follows at each node the child of its own count, that of
one more while it has the surplus, that of one fewer while it has the deficit. Two words find each other from one side only: the
one whose first differing count is smaller searches, so that the surplus is spent before the deficit. Words at the leaves that a search
reaches are verified exactly.

The upper part of the trie is a Spark table: nodes of more than ``CELL`` words are split by the next count, so that cells hold a bounded
number of words each; words are routed down it, level by level, by joins. The lower part of each cell is a trie in a task, searched
depth-first by all words that come there, as one array. Words with equal vectors that are more than a cell are cut into slices, and so are the words that search in a cell.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RUN = re.compile("[a-zÀ-ÿ]{6,}")
LETTERS = 6
COUNT = 5
#: A form is at least so many times as common as its variant.
FACTOR = 5
#: One run in so many loses a letter.
DAMAGE = 199
GROUPS = 16
#: The level at which the trie is first looked at for splitting.
START = 4
#: Most words of a cell, and of a batch that searches in one.
CELL = 16_000
#: Words times searching words at a node that are compared at once, count by count, instead of descending further.
AT_ONCE = 50_000
#: Longest words that are verified as rows of a table of letters; longer ones singly.
WIDTH = 48
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000


def damaged(doc_id: str, run: str) -> str:
    """``run``, or the run without one of its letters if the checksum of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def vectors(words: list[str]) -> np.ndarray:
    """One row a word: how many of its letters fall into each group. All letters are below 0x100, one byte each."""
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    counts = np.bincount(row * GROUPS + letters % GROUPS, minlength=GROUPS * len(words))
    return np.minimum(counts, 0x7FFF).astype(np.int16).reshape(-1, GROUPS)


def vocabulary(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word, n, vec: the words of all texts that are long and common enough; written."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()

        def told() -> pd.DataFrame:
            out = pd.DataFrame({"word": pd.Series(list(found), dtype=object), "n": pd.Series(list(found.values()), dtype="int64")})
            found.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b["id"], b["text"], strict=True):
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items() if text else ():
                    word = damaged(doc_id, run)
                    if len(word) >= LETTERS:
                        found[word] += n
                if len(found) > COUNTED:
                    yield told()
        yield told()

    @F.pandas_udf("array<smallint>")
    def vec(words: pd.Series) -> pd.Series:
        return pd.Series(list(vectors(words.tolist())), dtype=object)

    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    words = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)
    return materialize(words.select("word", "n", vec("word").alias("vec")))


def trie(words: DataFrame) -> DataFrame:
    """prefix, cell: the nodes of the upper trie from level ``START`` on; a node that is a cell isn't split. Written."""
    nodes, left = None, words.select("vec")
    for level in range(START, GROUPS + 1):
        counts = left.groupBy(F.slice("vec", 1, level).alias("prefix")).agg(F.count("*").alias("n"))
        found = materialize(counts.select("prefix", "n", ((F.col("n") <= CELL) | F.lit(level == GROUPS)).alias("cell")))
        nodes = found if nodes is None else nodes.unionAll(found)
        large = found.where(~F.col("cell")).select("prefix")
        if large.isEmpty():
            break
        left = left.join(large, F.slice("vec", 1, level) == F.col("prefix"), "left_semi")
    return materialize(nodes)


def descended(at: DataFrame, level: int) -> DataFrame:
    """``at`` (word, n, vec, prefix, spent), each row once for each child that its budget reaches; spent: 0 nothing, 1 the surplus, 2 both."""
    own = F.col("vec")[level]
    way = lambda count, spent: F.struct(count.cast("smallint").alias("count"), spent.cast("tinyint").alias("spent"))
    ways = F.array(
        way(own, F.col("spent")),
        F.when(F.col("spent") == 0, way(own + 1, F.lit(1))),
        F.when((F.col("spent") == 1) & (own > 0), way(own - 1, F.lit(2))),
    )
    stepped = at.select("word", "n", "vec", "prefix", F.explode(F.array_compact(ways)).alias("way"))
    return stepped.select("word", "n", "vec", F.concat("prefix", F.array("way.count")).alias("prefix"), "way.spent")


def routed(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell, word, n, spent: every cell that a word's budget reaches, and what of the budget is spent there."""
    at = words.select("word", "n", "vec", F.array().cast("array<smallint>").alias("prefix"), F.lit(0).cast("tinyint").alias("spent"))
    for level in range(START - 1):
        at = descended(at, level)
    found = None
    deepest = nodes.agg(F.max(F.size("prefix"))).first()[0] or START
    for level in range(START - 1, deepest):
        met = descended(at, level).join(nodes.where(F.size("prefix") == level + 1).select("prefix", "cell"), "prefix")
        if level + 1 < deepest:
            met = materialize(met)
        here = met.where("cell").select(F.col("prefix").alias("cell"), "word", "n", "spent")
        found = here if found is None else found.unionAll(here)
        at = met.where(~F.col("cell")).drop("cell")
    return materialize(found)


def one_edit(a: str, b: str) -> bool:
    """True where one inserted, deleted or replaced code point makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Letters:
    """Words as rows of letters, to verify many pairs at once."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.array([len(w) for w in words], np.int64)
        # One blank column at the end at least, so that a word ends before its row does.
        self.rows = np.array([w.encode("latin-1")[:WIDTH] for w in words], f"S{WIDTH + 2}").view(np.uint8).reshape(len(words), -1)


def verified(a: Letters, i: np.ndarray, b: Letters, j: np.ndarray) -> np.ndarray:
    """Which pairs (word ``i`` of a, word ``j`` of b) are one edit apart."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), 20_000):
        m, n = i[s : s + 20_000], j[s : s + 20_000]
        more = a.sizes[m] - b.sizes[n]
        x, y = a.rows[m], b.rows[n]
        differ = x != y
        yes = (more == 0) & (differ.sum(axis=1) == 1)
        for sign, longer, shorter in ((1, x, y), (-1, y, x)):
            at = np.flatnonzero(more == sign)
            if len(at):
                # After the first letter that differs the longer word goes on as the shorter one does.
                first = differ[at].argmax(axis=1)
                follows = longer[at][:, 1:] == shorter[at][:, :-1]
                yes[at] = (follows | (np.arange(follows.shape[1]) < first[:, None])).all(axis=1)
        out[s : s + 20_000] = yes
    for k in np.flatnonzero(np.maximum(a.sizes[i], b.sizes[j]) > WIDTH).tolist():
        out[k] = one_edit(a.words[i[k]], b.words[j[k]])
    return out


def reached(held: np.ndarray, asking: np.ndarray, spent: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asking, held, same) of the words at the leaves that each searching word's budget reaches; same: nothing of it was spent.

    ``held`` and ``asking`` are vectors; ``spent`` is what was spent above ``level``. Sorted by their counts, the words below a node are
    neighbours: a node is a range of them. Where few are left, the rest of their counts is compared at once.
    """
    order = np.lexsort(held.T[::-1])
    held = held[order]
    found: list[tuple] = []
    stack = [(0, len(held), level, np.arange(len(asking)), spent)]
    while stack:
        low, high, depth, who, used = stack.pop()
        rest = GROUPS - depth
        if rest and (high - low) * len(who) > AT_ONCE and high - low > 8:
            column, own = held[low:high, depth], asking[who, depth]
            values, starts = np.unique(column, return_index=True)
            for c, a, b in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), high - low], strict=True):
                more, fewer = (own == c - 1) & (used == 0), (own == c + 1) & (used == 1)
                go = np.flatnonzero((own == c) | more | fewer)
                if len(go):
                    stack.append((low + a, low + b, depth + 1, who[go], used[go] + more[go] + fewer[go]))
            continue
        step = max(1, 4 * AT_ONCE // (high - low))
        for s in range(0, len(who), step):
            q, u = who[s : s + step], used[s : s + step]
            apart = held[None, low:high, depth:] - asking[q][:, None, depth:]
            up, down = apart == 1, apart == -1
            ups, downs = up.sum(axis=2), down.sum(axis=2)
            ok = (ups + downs == (apart != 0).sum(axis=2)) & (ups <= (u == 0)[:, None]) & (downs <= (u < 2)[:, None]) & (downs <= ups + (u > 0)[:, None])
            if rest:
                ok &= (downs == 0) | (ups == 0) | (up.argmax(axis=2) < down.argmax(axis=2))
            x, y = np.nonzero(ok)
            found.append((q[x], order[low + y], (u[x] == 0) & (ups[x, y] + downs[x, y] == 0)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)


def near_in(cell: list[int], asking: list[str], asking_n: np.ndarray, spent: np.ndarray, held: list[str], held_n: np.ndarray) -> dict[str, tuple]:
    """word -> (number of words one edit apart, smallest of minus n and word) of what a cell's words and those that search in it find."""
    q, w, same = reached(vectors(held), vectors(asking), spent, len(cell))
    # Words with equal vectors search for each other: one side is enough.
    once = ~same | (np.array(asking, object)[q] < np.array(held, object)[w]) if len(q) else same
    q, w = q[once], w[once]
    yes = verified(Letters(asking), q, Letters(held), w)
    found: dict[str, tuple] = {}
    for a, b in zip(q[yes].tolist(), w[yes].tolist(), strict=True):
        x, y, n, m = asking[a], held[b], int(asking_n[a]), int(held_n[b])
        for word, minus, other in ((x, -m, y), (y, -n, x)):
            k, *best = found.get(word, (0, 0, ""))
            found[word] = (k + 1, *(min((minus, other), tuple(best)) if k else (minus, other)))
    return found


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (smallest of minus n and word): what is one edit from each word that has such words."""
    nodes = trie(words)
    asked = routed(words, nodes)
    cut = lambda rows, key, name: rows.groupBy(key).agg(F.ceil(F.count("*") / CELL).alias(name))
    placed = words.select(F.array().cast("array<smallint>").alias("cell"), "word", "n").where(F.lit(False))
    for level in [r[0] for r in nodes.where("cell").select(F.size("prefix")).distinct().collect()]:
        at = nodes.where(F.col("cell") & (F.size("prefix") == level)).select(F.col("prefix").alias("cell"))
        placed = placed.unionAll(words.select(F.slice("vec", 1, level).alias("cell"), "word", "n").join(at, "cell"))
    placed = materialize(placed)
    parts = lambda rows: rows.join(materialize(cut(rows, "cell", "parts")), "cell").groupBy("cell", F.pmod(F.xxhash64("word"), "parts").alias("part"))
    held = parts(placed).agg(F.collect_list(F.struct("word", "n")).alias("held"))
    asking = parts(asked).agg(F.collect_list(F.struct("word", "n", "spent")).alias("asking"))
    tasks = asking.join(held.withColumnRenamed("part", "held_part"), "cell")
    tasks = tasks.select("cell", "asking.word", "asking.n", "asking.spent", F.col("held.word").alias("held"), F.col("held.n").alias("held_n"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cell, word, n, spent, held, held_n in zip(*[b[c] for c in b.columns], strict=True):
                found = near_in(cell, list(word), np.asarray(n), np.asarray(spent, np.int8), list(held), np.asarray(held_n))
                out += [(w, *x) for w, x in found.items()]
            yield pd.DataFrame(out, columns=["word", "n_near", "minus", "near"]).astype({"n_near": "int64", "minus": "int64"})

    found = tasks.mapInPandas(search, "word string, n_near long, minus long, near string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("minus", "near")).alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """word, root: where the chain of forms that starts at each word of ``forms`` (word, form) ends.

    Each round doubles the steps; a form is five times as common as its word, so that chains are short and can't close.
    """
    jumps = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(jumps.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        jumps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return jumps


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts, and the commoner spelling that each is a variant of.

    A word's form is the commonest word one edit from it (ties: the first in code-point order), if it is at least five times as
    common; else form and form_n are null. Root is where the forms of forms end, the word itself if it has none. n_near counts the
    words one edit from it. Null, empty and letterless texts have no words; a null id counts as an empty one; rows that repeat an id or
    a text count each. An empty table gives an empty result; further columns are not read.
    """
    words = vocabulary(df, id_col, text_col)
    near = neighbours(words)
    told = words.select("word", "n").join(near, "word", "left")
    named = -F.col("best.minus") >= FACTOR * F.col("n")
    told = materialize(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(named, F.col("best.near")).alias("form"), F.when(named, -F.col("best.minus")).alias("form_n")))
    roots = followed(told.where("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
