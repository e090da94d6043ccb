"""Packing: exact lowest-cost placing against a plain search, cuts only where needed, equal rows apart."""

import random

import pytest

from tallyloom.llm import packing


def plain_pack(lengths, capacity):
    """The same rule by looking at every open sequence."""
    used, cost = [0] * (sum(lengths) // capacity), [0.0] * (sum(lengths) // capacity)
    out = [[] for _ in lengths]

    def take(s, n):
        used[s] += n
        cost[s] += n + n * n / packing.QUADRATIC
        return used[s] - n

    late = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fit = [(cost[s], s) for s in range(len(used)) if used[s] + lengths[i] <= capacity]
        if fit:
            out[i].append((0, lengths[i], min(fit)[1], take(min(fit)[1], lengths[i])))
        else:
            late.append(i)
    for i in late:
        start = 0
        while start < lengths[i]:
            rest = lengths[i] - start
            fit = [(cost[s], s) for s in range(len(used)) if used[s] + rest <= capacity]
            if fit:
                s = min(fit)[1]
            else:
                most = max((capacity - u for u in used), default=0)
                s = min((cost[k], k) for k in range(len(used)) if capacity - used[k] == most)[1] if most else len(used)
                if s == len(used):
                    used.append(0)
                    cost.append(0.0)
            n = min(rest, capacity - used[s])
            out[i].append((start, n, s, take(s, n)))
            start += n
    return out


@pytest.mark.parametrize(("capacity", "most"), [(16, 16), (24, 9), (1024, 1023), (1024, 1024), (1024, 90), (7, 7)])
def test_equals_a_plain_search(capacity, most):
    rng = random.Random(capacity * most)
    for n in (0, 1, 2, 5, 60, 300):
        lengths = [rng.randint(1, most) for _ in range(n)]
        assert packing.pack(lengths, capacity) == plain_pack(lengths, capacity)
    assert packing.pack([capacity] * 5, capacity) == plain_pack([capacity] * 5, capacity)


def test_a_body_longer_than_a_sequence_is_an_error():
    with pytest.raises(ValueError, match="longer"):
        packing.pack([1025])


def test_few_cuts_and_one_padded_sequence():
    rng = random.Random(6)
    lengths = [min(1023, int(rng.lognormvariate(6, 1)) + 1) for _ in range(5000)]
    pieces = packing.pack(lengths)
    load, cost = {}, {}
    for n, parts in zip(lengths, pieces, strict=True):
        at = 0
        for start, size, s, offset in parts:
            assert start == at
            at += size
            load.setdefault(s, []).append((offset, size))
            cost[s] = cost.get(s, 0) + size + size * size / packing.QUADRATIC
        assert at == n
    for s, parts in load.items():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1]
        load[s] = ends[-1]
    assert max(load.values()) <= 1024 and sum(1024 - x for x in load.values()) < 1024
    assert sum(len(p) > 1 for p in pieces) < 0.12 * len(pieces)


def test_equal_rows_spread_over_the_groups(spark, monkeypatch):
    """Rows that repeat id and text are dealt like any others."""
    monkeypatch.setattr(packing, "GROUP_BODIES", 50)
    rows = [(7, "the same text again and again")] * 1000 + [(None, None)] * 100
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    groups = {}
    for r in got:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(got) >= 1100 and len(groups) > 15 and max(groups.values()) < 120
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)


def test_long_documents_stand_alone(spark):
    rows = [(1, "word " * 5000), (2, "other"), (1, "word " * 5000)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    full = [r for r in got if r.length == 1024]
    assert len(full) >= 8 and len({r.sequence_id for r in full}) == len(full) and all(r.offset == 0 for r in full)
    for copies in (r for r in got if r.doc_id == 1 and r.start == 0):
        assert copies.doc_tokens > 4096


VOCABULARY = ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


class Calls:
    """Counts the calls that go to a rank file."""

    def __init__(self, ranks, seen):
        self.ranks, self.seen = ranks, seen

    def encode_to_tiktoken_buffer(self, text, allowed):
        self.seen.append(text)
        return self.ranks.encode_to_tiktoken_buffer(text, allowed)


def test_latin_words_are_encoded_together():
    """A call costs more than a word: a Latin text takes one, whatever its words and white space; with few other words, one for each run of Latin ones."""
    encode, seen = packing.WordEncoder(*VOCABULARY), []
    for name, value in list(vars(encode).items()):
        if hasattr(value, "encode_to_tiktoken_buffer"):
            setattr(encode, name, Calls(value, seen))
    words = [f"word{i}é" for i in range(300)]
    for gap in (" ", "\n", " \n "):
        seen.clear()
        text = gap.join(words)
        assert encode(text) == encode.by_library(text) and seen == [text]
    seen.clear()
    text = " ".join([*words, "слово", *words, "日本", "слово"])
    assert encode(text) == encode.by_library(text) and len(seen) <= 3


def test_ids_equal_the_library_whatever_the_white_space():
    encode, rng = packing.WordEncoder(*VOCABULARY), random.Random(3)
    plain = [" ", " ", "  ", "\n", " \n", "\n ", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\x00", "a", "The", "straße", "ɏ", "'s", " 'll", "12", "!?", "<|", "x" * 50]
    wide = [" ", " ", "　", "​", "᠎", "﻿", "слово", "日本", "ɐ", "é", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for bits in (plain, plain + wide) for _ in range(8000)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}" for c in range(0x260)]
    texts += [" ".join(rng.choice(words) for _ in range(12)) for words in (["a", "é,\n", "x", "12"] * 5 + ["слово", "日本\n"], ["a", "слово", "дом", "—"]) for _ in range(4000)]
    assert [x for x in texts if encode(x) != encode.by_library(x)] == []
