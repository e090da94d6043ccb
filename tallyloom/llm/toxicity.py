"""Toxicity by a gap-weighted subsequence string-kernel support vector machine.

Kernel: two words are as alike as the three-character subsequences they share, each occurrence weighted
``DECAY`` to the power of the characters it spans (at most ``SPAN``), divided by a norm that depends on each
word's length. An insult with an inserted or changed character keeps most of its subsequences. Words carry
end marks; runs of single characters ("i d i o t") are read as one word.

Learning (one task, on a bounded sample of labelled rows): labels mark documents, not sentences, and one insult in one sentence
makes a document toxic. So every sentence of a clean document is a clean one, and of a toxic document's sentences at least one is
toxic, as toxic as its worst word, which multiple-instance learning calls a witness. Sentences need not be cut apart for that: a
document's bag is the union of its sentences' words, and the kernel compares words only. Witnesses start as words that clean documents don't use. Landmarks are picked from
witnesses and from the clean words nearest to them; the Nyström map sends a word to its kernel values against
the landmarks, whitened; a linear SVM (squared hinge) separates witnesses from clean words, and witnesses
are picked again with it.

Scoring (tasks): the machine is linear in subsequences, so landmarks, whitening and weights fold into one
weight for each three-character subsequence. A text is one array of character classes, and a word's decision
is a sum over ten shifted look-ups: cost is linear in the text and memory is bounded by a slice.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

#: Bounds of the sample of labelled rows, by class, and of the characters of their texts in all.
MAX_TOXIC = 800
MAX_CLEAN = 3000
MAX_CHARACTERS = 64_000_000
#: Words of so many characters and more are scored but not learned from: their subsequences are those of half the alphabet.
LONGEST_LEARNED = 64
DECAY = 0.7
SPAN = 6
LANDMARKS = 320
CLASSES = 64
MARK = 63
THRESHOLD = 0.3
#: Score of every text where the labels teach nothing: below THRESHOLD, so that nothing is called toxic without evidence.
UNKNOWN = 0.05
#: Characters scored at a time. A slice ends where a word ends, outside runs of single characters, and is longer if it has to be.
SLICE = 1 << 18
#: (distance to the second, distance to the third) character of a subsequence.
SHAPES = [(j, k) for k in range(2, SPAN) for j in range(1, k)]

SPACE = np.zeros(0x110, bool)
SPACE[[0x20, *range(9, 14), 0x85, 0xA0]] = True


def classes() -> np.ndarray:
    """Class of each code point below 0x250: a letter of a to z its own, whatever its case; the rest share the others."""
    table = np.zeros(0x250, np.int32)
    for c in range(0x250):
        low = ord(chr(c).lower()[0])
        table[c] = low - 96 if 97 <= low <= 122 else 37 + low % 26 if chr(c).isalpha() else 27 + low % 10
    return table


TABLE = classes()


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character classes with a mark before and after each word, and the position of each word's first mark."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    code = np.where(points < 0x250, TABLE[np.minimum(points, 0x24F)], 37 + points % 26).astype(np.int32)
    blank = blanks(points)
    # A blank between two single characters is taken out: "i d i o t" is one word.
    around = np.concatenate([[True], blank, [True]])
    single = ~blank & around[:-2] & around[2:]
    glue = np.zeros(len(blank), bool)
    glue[1:-1] = blank[1:-1] & single[:-2] & single[2:]
    code[blank] = MARK
    # Runs of blanks, and full stops or commas at a word's end, count once or not at all.
    trail = np.isin(points, (33, 34, 40, 41, 44, 46, 58, 59, 63)) & (around[2:] | around[:-2])
    keep = ~glue & ~trail & ~(blank & np.concatenate([[False], blank[:-1]]))
    code = np.concatenate([[MARK], code[keep], [MARK]]).astype(np.int32)
    code = code[np.concatenate([[True], (code[1:] != MARK) | (code[:-1] != MARK)])]
    return code, np.flatnonzero(code == MARK)[:-1]


def blanks(points: np.ndarray) -> np.ndarray:
    return SPACE[np.minimum(points, 0x10F)] & (points < 0x110)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut where ``encode`` reads the same on either side: at blanks between words.

    A blank between two single characters joins them, so that no cut is made there. A word, or a run of single characters, that is
    longer than a part stays whole.
    """
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text):
            # Two characters on either side tell whether a blank joins single characters.
            near = blanks(np.frombuffer(text[max(at - 2, 0) : end + 2].encode("utf-32-le", "replace"), np.uint32))
            blank = np.concatenate([[True, True], near, [True, True]])
            single = ~blank[1:-1] & blank[:-2] & blank[2:]
            cuts = np.flatnonzero(near & ~(single[:-2] & single[2:])) + max(at - 2, 0)
            cuts = cuts[(cuts > at) & (cuts <= end)]
            if len(cuts):
                end = int(cuts[-1])
                break
            end += size
        yield text[at:end]
        at = end


def norm(sizes: np.ndarray) -> np.ndarray:
    """Norm of words of so many characters (and two marks), whatever their length."""
    n = np.asarray(sizes, np.float64) + 2
    return np.sqrt(np.maximum(sum(DECAY ** (2 * (k + 1)) * np.maximum(n - k, 0) for _, k in SHAPES), 1e-9))


#: Norms of short words, looked up; longer ones are computed.
NORM = norm(np.arange(256))


def norms_of(sizes: np.ndarray) -> np.ndarray:
    out = NORM[np.minimum(sizes, len(NORM) - 1)]
    if (long := sizes >= len(NORM)).any():
        out[long] = norm(sizes[long])
    return out


def word_sums(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sum of the weights of the subsequences of each word."""
    marks = np.flatnonzero(code == MARK)
    total = np.zeros(len(code), np.float32)
    to_next = np.repeat(marks[1:], np.diff(marks)) - np.arange(marks[-1])
    wide = code.astype(np.int32)
    for j, k in SHAPES:
        m = len(code) - k
        if m <= 0:
            continue
        at = (wide[:m] * CLASSES + wide[j : j + m]) * CLASSES + wide[k:]
        total[:m] += np.float32(DECAY ** (k + 1)) * weight[at] * (to_next[:m] >= k)
    return np.add.reduceat(total, marks[:-1]) if len(marks) > 1 else np.empty(0, np.float32)


@dataclass
class Machine:
    """Weights of subsequences, and the calibration of a document's score."""

    weight: np.ndarray
    bias: float
    slope: tuple[float, float, float]

    def words(self, text: str) -> np.ndarray:
        """Decision of every word of a text (positive: toxic)."""
        out = []
        for part in slices(text):
            code, starts = encode(part)
            if len(starts):
                size = np.diff(np.append(starts, len(code) - 1)) - 1
                out.append(word_sums(code, self.weight) / norms_of(size) + self.bias)
        return np.concatenate(out) if out else np.empty(0, np.float32)

    def features(self, text: str) -> tuple[float, float]:
        """Worst word's decision, and how many words are on the toxic side (logarithm)."""
        d = self.words(text)
        return (float(np.clip(d.max(), -3, 3)), float(np.log1p((d > 0).sum()))) if len(d) else (-3.0, 0.0)

    def score(self, text: str | None) -> float:
        worst, many = self.features(text or "")
        c, a, b = self.slope
        return float(1 / (1 + np.exp(-np.clip(c + a * worst + b * many, -30, 30))))


def kernel_rows(words: list[str], landmarks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kernel of each word against each landmark; the landmarks' subsequences and their features."""
    index = np.unique(np.concatenate([subsequences(w)[0] for w in landmarks]))
    at = np.full(CLASSES**3, -1, np.int32)
    at[index] = np.arange(len(index))
    base = np.zeros((len(index), len(landmarks)), np.float32)
    for i, w in enumerate(landmarks):
        u, x = subsequences(w)
        np.add.at(base[:, i], at[u], x)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i, w in enumerate(words):
        u, x = subsequences(w)
        row = at[u]
        have = row >= 0
        if have.any():
            out[i] = x[have] @ base[row[have]]
    return out, index, base


@functools.lru_cache(maxsize=40_000)
def subsequences(word: str) -> tuple[np.ndarray, np.ndarray]:
    """A word's subsequences (repeats included) and their normalised weights."""
    code = np.array([MARK, *(int(TABLE[ord(c)]) if c < "\u0250" else 37 + ord(c) % 26 for c in word), MARK], np.int64)
    u, x = [], []
    for j, k in SHAPES:
        m = len(code) - k
        if m > 0:
            u.append((code[:m] * CLASSES + code[j : j + m]) * CLASSES + code[k:])
            x.append(np.full(m, DECAY ** (k + 1), np.float32))
    return np.concatenate(u), np.concatenate(x) / np.float32(norm(len(word)))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights (the last one the bias) of a squared-hinge SVM, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        on = y * (x @ w) < 1
        a = x[on] * cost[on, None]
        new = np.linalg.solve(0.1 * ridge + a.T @ x[on], a.T @ y[on])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * (w + new)
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Intercept and slopes of a lightly regularised logistic regression."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(w)), x.T @ (y - p) - 0.3 * w)
    return w


def clean_word(w: str) -> str:
    return w.lower().strip("!\"(),.:;?")


def train(texts: list[str], toxic: list[bool], rounds: int = 2) -> Machine:
    """Fit on labelled texts; where a class has no words, or no word tells toxic texts, every score is UNKNOWN."""
    once = distinct_texts(texts)
    # Every fourth text is kept back for the calibration.
    back = [i for i in once[3::4]] if len(once) >= 40 else once
    tests = [texts[i] for i in back], [toxic[i] for i in back]
    once = [i for n, i in enumerate(once) if n % 4 != 3] if len(once) >= 40 else once
    texts, toxic = [texts[i] for i in once], [toxic[i] for i in once]
    bags = [set(filter(None, map(clean_word, t.split()))) for t in texts]
    in_toxic: dict[str, int] = {}
    in_clean: dict[str, int] = {}
    for bag, t in zip(bags, toxic, strict=True):
        count = in_toxic if t else in_clean
        for w in bag:
            if len(w) < LONGEST_LEARNED:
                count[w] = count.get(w, 0) + 1
    empty = Machine(np.zeros(CLASSES**3, np.float32), 0.0, (float(np.log(UNKNOWN / (1 - UNKNOWN))), 0.0, 0.0))
    if not in_toxic or not in_clean:
        return empty
    witness = first_witnesses(bags, toxic, in_toxic, in_clean)
    if not witness:
        return empty
    clean = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    rng = np.random.default_rng(7)
    common = clean[:3000] + [clean[i] for i in sorted(rng.choice(len(clean), min(len(clean), 12_000), replace=False).tolist())]
    common = [w for w in dict.fromkeys(common) if w not in witness]
    machine = empty
    hard: list[str] = []
    for step in range(rounds + 1):
        ranked = sorted(witness, key=lambda w: (-witness[w], w))[:3000]
        marks = spread(ranked, LANDMARKS // 2)
        near = kernel_rows(common, marks)[0].max(axis=1)
        marks += [common[i] for i in np.argsort(-near, kind="stable")[: LANDMARKS // 4]]
        marks = list(dict.fromkeys(marks + hard[: LANDMARKS // 4] + common))[:LANDMARKS]
        rest = list(dict.fromkeys(common + hard))
        hidden = [v for w in ranked[:400] if len(w) > 3 for v in variants(w) if v not in in_clean]
        words = ranked + hidden + rest
        k, index, base = kernel_rows(words, marks)
        gram = kernel_rows(marks, marks)[0].astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        good = values > 1e-4 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        y = np.where(np.arange(len(words)) < len(ranked) + len(hidden), 1.0, -1.0)
        # All witnesses together weigh as much as all clean words; hidden spellings a tenth of their witness.
        cost = np.concatenate([np.full(len(ranked), len(rest) / len(ranked)), np.full(len(hidden), 0.1 * len(rest) / len(ranked)), 1 + np.log([in_clean[w] for w in rest])])
        w = linear_svm(k @ whiten, y, cost)
        weight = np.zeros(CLASSES**3, np.float32)
        weight[index] = base @ (whiten @ w[:-1])
        machine = Machine(weight, float(w[-1]), (0.0, 1.0, 0.0))
        if step == rounds:
            break
        # Clean words that the machine takes for toxic become negatives; toxic documents' worst words become witnesses.
        worst = decisions(machine, clean)
        hard = [clean[i] for i in np.argsort(-worst, kind="stable")[:4000] if worst[i] > -0.7]
        new = sorted(w for w in in_toxic if w not in witness and w not in in_clean)
        d = decisions(machine, new)
        witness |= {w: in_toxic[w] for w, x in zip(new, d, strict=True) if x > 0.5}
    x = np.array([machine.features(t) for t in tests[0]])
    subsequences.cache_clear()
    machine.slope = tuple(logistic(x, np.array(tests[1], float)).tolist())
    return machine


def decisions(machine: Machine, words: list[str]) -> np.ndarray:
    """Decision of each of ``words``, many at a time."""
    out = []
    for s in range(0, len(words), 20_000):
        part = words[s : s + 20_000]
        found = machine.words("  ".join(part))  # two blanks: single characters stay apart
        out.append(found if len(found) == len(part) else np.array([machine.words(w).max(initial=-3.0) for w in part]))
    return np.concatenate(out) if out else np.empty(0)


def variants(word: str) -> list[str]:
    """Spellings of a word that hide it: separators between letters, an inserted, doubled or dropped character."""
    rng = np.random.default_rng(len(word) * 1009 + sum(map(ord, word)))
    i = int(rng.integers(1, max(2, len(word))))
    sign = "-.*_"[int(rng.integers(4))]
    return [sign.join(word), word[:i] + sign + word[i:], word[:i] + "0123456789"[int(rng.integers(10))] + word[i:], word[:i] + word[i - 1] + word[i:]]


def grams(word: str) -> set[str]:
    marked = f"^{word}$"
    return {marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}


def first_witnesses(bags: list[set[str]], toxic: list[bool], in_toxic: dict[str, int], in_clean: dict[str, int]) -> dict[str, int]:
    """Words of toxic documents with a spelling (4 to 6 letters) that far more toxic documents use than chance allows."""
    number: dict[str, int] = {}
    of_word = {w: np.array([number.setdefault(g, len(number)) for g in grams(w)], np.int64) for w in in_toxic}
    counts = np.zeros((2, len(number) + 1), np.int64)
    known: dict[str, np.ndarray] = {}
    for bag, t in zip(bags, toxic, strict=True):
        found = []
        for w in bag:
            if len(w) < LONGEST_LEARNED:
                x = of_word.get(w)
                if x is None:
                    x = known.get(w)
                if x is None:
                    x = known[w] = np.array([number[g] for g in grams(w) if g in number], np.int64)
                found.append(x)
        if found:
            counts[int(t)][np.unique(np.concatenate(found))] += 1
    # All n documents that use a spelling are toxic by chance with probability share**n.
    share = sum(toxic) / len(toxic)
    least = max(3, int(np.ceil(np.log(0.01 / max(1, len(number))) / np.log(max(share, 1e-6)))))
    telling = (counts[1] >= least) & (counts[0] * 30 <= counts[1])
    return {w: n for w, n in in_toxic.items() if in_clean.get(w, 0) * 30 <= n and telling[of_word[w]].any()}


def distinct_texts(texts: list[str]) -> list[int]:
    """Positions of texts that neither begin nor end like an earlier one: copies would count as independent evidence."""
    seen: set[tuple] = set()
    out = []
    for i, t in enumerate(texts):
        words = t.split()
        ends = {(0, *words[:8]), (1, *words[-8:])}
        if words and ends.isdisjoint(seen):
            out.append(i)
        seen |= ends
    return out


def spread(words: list[str], n: int) -> list[str]:
    """Up to ``n`` of ``words``, each the least like those picked before it among the first words by rank."""
    pool = words[: 12 * n]
    k = kernel_rows(pool, pool)[0]
    picked = [0]
    best = k[0].copy()
    while len(picked) < min(n, len(pool)):
        i = int(np.argmin(best))
        picked.append(i)
        best = np.maximum(best, k[i])
    return [pool[i] for i in picked]


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, float]:
    """(id, text, toxic; toxic share of all labelled rows outside the held-out part): texts and labels of at most MAX_TOXIC and MAX_CLEAN of them, lowest hash first, as long as they have MAX_CHARACTERS in all."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col(id_col))).groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    rank = F.xxhash64(F.col(id_col))
    picked = known.where("toxic = 1").orderBy(rank).limit(MAX_TOXIC).unionAll(known.where("toxic = 0").orderBy(rank).limit(MAX_CLEAN))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.withColumnRenamed(id_col, "id")), "id").where("text IS NOT NULL")
    # Of rows that repeat an id one text is learned from.
    one = materialize(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    sizes = one.select("id", F.length("text").alias("n"), F.xxhash64("id").alias("rank")).orderBy("rank", "id").collect()
    taken = [r.id for r, total in zip(sizes, itertools.accumulate(r.n for r in sizes), strict=True) if total <= MAX_CHARACTERS]
    kept = one if len(taken) == len(sizes) else one.where(F.col("id").isin(taken))
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return kept.select("id", "text", "toxic"), share


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Learned in one task, which reads the bounded sample; the machine comes back as a row of a megabyte."""

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in b.itertuples(index=False, name=None)]
        rows.sort(key=lambda r: r[0])
        m = train([r[1] for r in rows], [r[2] == 1 for r in rows])
        yield pd.DataFrame({"weight": [m.weight.tobytes()], "bias": [m.bias], "slope": [list(m.slope)], "toxic": [sum(r[2] == 1 for r in rows)], "n": [len(rows)]})

    sample, share = training_sample(docs, labels, id_col, text_col)
    got = sample.coalesce(1).mapInPandas(learn, "weight binary, bias double, slope array<double>, toxic long, n long").first()
    if got is None:
        return train([], [])
    machine = Machine(np.frombuffer(got.weight, np.float32), got.bias, tuple(got.slope))
    if machine.weight.any() and 0 < got.toxic < got.n:
        # The sample holds more toxic rows than the labels do: correct the intercept for it.
        odds = lambda p: float(np.log(p / (1 - p)))
        machine.slope = (machine.slope[0] + odds(share) - odds(got.toxic / got.n), *machine.slope[1:])
    return machine


def score_column(machine: Machine, text: Column, spark) -> Column:
    """A column of scores from 0 to 1; a null or empty text gets the score of a text without words."""
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([shared.value.score(x) for x in t], dtype="float64")

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, held_out, score, predicted (1 if the score is at least THRESHOLD).

    Where no labelled row joins, or the rows that do are of one class, every score is UNKNOWN and no document is predicted toxic. A
    null text scores like an empty one, as a text without words. A row with a null id is scored, not learned from and not held out; rows
    that repeat an id are scored singly, and one of their texts at most is learned from. An empty table gives an empty result.
    """
    machine = fit(docs, labels, id_col, text_col)
    score = score_column(machine, F.col(text_col), docs.sparkSession)
    scored = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with all their columns: all rows where the labels lack a class.

    A null or empty text has no toxic word and stays, as do rows with a null id; repeated rows stay or go together. An
    empty table gives an empty result.
    """
    machine = fit(docs, labels, id_col, text_col)
    return docs.where(score_column(machine, F.col(text_col), docs.sparkSession) < THRESHOLD)
