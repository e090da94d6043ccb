"""Sampling over the whole lattice: runs of blanks, long units, and frequencies against all paths."""

import random

import numpy as np
import pytest

from tallyloom.llm import sp_codec


@pytest.fixture(scope="module")
def codec():
    return sp_codec.Codec(sp_codec.MODEL)


def all_paths(codec, word: bytes, at: int = 0):
    if at == len(word):
        yield (), 1.0
        return
    for end in range(at + 1, len(word) + 1):
        options = [(codec.byte_id[word[at]], codec.rare)] if end == at + 1 else []
        options += [codec.weight[word[at:end]]] if word[at:end] in codec.weight else []
        for i, x in options:
            for rest, y in all_paths(codec, word, end):
                yield (i, *rest), x * y


@pytest.mark.parametrize("text", [" the", "   a", "x    ", "日本", "they"])
@pytest.mark.parametrize("long", [2, 1000])
def test_frequencies(codec, monkeypatch, text, long):
    """Sampled segmentations against every path, with plain and with logarithmic sums."""
    monkeypatch.setattr(sp_codec, "LONG", long)
    assert len(sp_codec.cuts(text.encode())) == (2 if text == "x    " else 1)
    if text == "x    ":
        text = text[1:]
    want = dict(all_paths(codec, text.encode()))
    total = sum(want.values())
    got, n = {}, 4000
    for ids in codec.encode([text] * n, list(range(n))):
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
    assert set(got) <= set(want)
    for p, x in want.items():
        assert abs(got.get(p, 0) / n - x / total) < 0.04


def test_pieces_of_several_blanks_are_reached(codec):
    blanks = {i for p, (i, _) in codec.weight.items() if len(p) > 1 and not p.strip(b" ")}
    assert blanks and any(not blanks.isdisjoint(ids.tolist()) for ids in codec.encode(["a" + " " * 16 + "b"] * 200, list(range(200))))


def test_long_text_without_blanks(codec):
    """No byte piece is forced into it, and sums stay in range."""
    rng = random.Random(3)
    common = [p.decode() for p in list(codec.weight)[4000:9000] if b" " not in p][:300]
    text = "".join(rng.choices(common, k=4000))
    ids = codec.encode([text], [7])[0]
    assert codec.decode(ids) == text
    assert np.isin(ids, codec.byte_ids).mean() < 0.02
    whole = "".join(chr(0x4E00 + i % 2000) for i in range(3000))
    assert codec.decode(codec.encode([whole], [1])[0]) == whole


def test_cuts_lose_nothing():
    rng = random.Random(4)
    for _ in range(300):
        data = "".join(rng.choices(["a", "b", " ", "  ", "\n", "é", "　"], k=rng.randint(0, 12))).encode()
        units = sp_codec.cuts(data)
        assert b"".join(units) == data and all(b" " not in u.lstrip(b" ") and u for u in units)
