"""The pipeline against plain loops, and on tables with nothing in them."""

import re
import zlib

import numpy as np

import corpus_pipeline

from .test_llm import SCHEMA, awkward, near_table, words_of

PIECE = re.compile(r"[ \t\n\x0b\f\r]*[^\x20\x09-\x0D]+")


def largest(rows):
    return max(rows, key=lambda r: (r[0] is not None, r[0] or 0))


def smallest(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def without_copies(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r)
    return [largest(g) for g in groups.values()]


def without_near_copies(rows):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    return [smallest([r for r, g in zip(rows, group, strict=True) if g == k]) for k in sorted(set(group))]


def without_repeats(rows):
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    out = []
    for i, t in rows:
        w, gone = words_of(t), set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        if gone:
            pieces = PIECE.findall(t)
            text = "".join(p for k, p in enumerate(pieces) if k not in gone)
            # What follows the last word stays, unless the text now begins elsewhere and lost its first blanks.
            t = text.lstrip(" \t\n\x0b\x0c\r") if 0 in gone else text + t[len("".join(pieces)) :]
        out.append((i, t))
    return out


def test_against_plain_loops(spark, tmp_path):
    """Null ids and texts, copies, near copies, shared passages; no labels, so that nothing is toxic."""
    from tokenizers import Tokenizer

    import public_tokenizers

    rows = [(i, t) for i, t in awkward() if i is not None] + [(i + 1000 if i is not None else None, t) for i, t in near_table() if i not in (20, 21)] + [(None, "a null id of its own")]
    table = [(i, t, "en", None, None, 1, "x", 2, None, "r", "k", 3) for i, t in rows]
    spark.createDataFrame(table, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = without_repeats(without_near_copies(without_copies(rows)))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted(([*tok.encode(t or "", add_special_tokens=False).ids, 0] for i, t in want), key=len)
    told = sorted((r.doc_tokens for r in got if r.start == 0))
    assert told == [len(x) for x in ids]
    by_id = {}
    for i, t in want:
        by_id.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert {r.doc_id for r in got} == set(by_id)
    for r in got:
        some = [x for x in by_id[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in {zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) for x in some}


def test_empty_tables_pass_every_stage(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, empty, str(tmp_path))
        assert made.count() == 0 and (name == "packing" or made.columns == empty.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
