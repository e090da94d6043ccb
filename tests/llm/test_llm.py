"""The numbered operators against brute force and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tallyloom.llm import exact_dedup, graph, html_extract, near_copies, packing, quality_classifier, quality_rules, simhash, sp_codec, substring_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, sha string, fp long, key string, ranges string, kept string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(n)]


def awkward():
    """Nulls, empty texts, blanks of many kinds, copies, near copies, shared passages, a long text, a repeated row."""
    rng, words = random.Random(2), vocabulary()
    passage = " ".join(rng.choices(words, k=60))
    base = " ".join(rng.choices(words, k=200))
    texts = [None, "", "   \n\t", "one", "a b", "A\x0bB\x0cC D   e", base, base, base + " tail", base.replace(" ", "\n", 3), None, ""]
    texts += [" ".join(rng.choices(words, k=30)) + " " + passage + "\n" + " ".join(rng.choices(words, k=30)) for _ in range(4)]
    texts += [passage, " ".join(rng.choices(words, k=6000)), "x " * 400, "same line\n" * 30, "#### %%% " * 30, "tail ends here. " * 2]
    return [(i, t) for i, t in enumerate(texts)] + [(7, base), (None, base), (None, "orphan")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 2}", None, 1, "x", 2, None, "r", "k", 3) for i, t in awkward()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words_of(t):
    return [w.encode() for w in WORD.findall(t or "")]


def test_quality_counts(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality_rules.judged(docs).collect()}
    for i, t in awkward():
        t, w = t or "", words_of(t)
        marked, seen = [False] * len(w), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        for at in seen.values():
            for k in at if len(at) > 1 else []:
                marked[k : k + 8] = [True] * 8
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[(i, len(w), sum(len(x.decode()) for x in w))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(marked))
        assert r.base_failed == (len(w) < 20 or 100 * sum(marked) > 30 * len(w)) and not (r.base_failed and r.kept)



def test_exact_dedup(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_COPIES", 2)  # so that small groups take the broadcast way too
    got = exact_dedup.ranked_copies(docs).collect()
    groups = {}
    for i, t in awkward():
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(awkward())
    for r in got:
        t = next(x for x in groups if hashlib.sha256(x.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[t]) and r.keep_id == max((i for i in groups[t] if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(groups)
    stay = exact_dedup.drop_copies(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def test_sketch_finds_heavy_digests(spark):
    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE cast(id AS string) END AS sha").repartition(7)
    assert "hot" in {r.sha for r in exact_dedup.heavy_candidates(df, "sha", 16).collect()}


def test_simhash(docs):
    fps = {}
    for i, t in awkward():
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.setdefault(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), []).append(i)
    got = simhash.near_duplicates(docs).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    lowest = {}
    for f, ids in fps.items():
        lowest[find(f)] = min([x for x in [*ids, lowest.get(find(f))] if x is not None], default=None)
    assert len(got) == len(awkward())
    for r in got:
        f = int(r.fingerprint, 16)
        assert r.doc_id in fps[f] and r.component_id == lowest[find(f)]
    assert simhash.keep_one(docs).columns == docs.columns


@pytest.mark.parametrize("tile", [4, 512])
def test_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        fps |= {f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(8)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (f >> 63 << 64), n) for n, f in enumerate(fps)], "fp long, node long")
    root = {r.node: r.root for r in graph.components(simhash.links(nodes, 2)).collect()}
    want = list(range(len(fps)))
    for _ in range(len(fps)):
        new = [min(want[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(fps))]
        if new == want:
            break
        want = new
    assert [root.get(n, n) for n in range(len(fps))] == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (5, 5)], "u long, v long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_packing(docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    ids = {}
    for i, t in awkward():
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, lists in ids.items():
        for x in lists:
            pieces = {(r.start, r.length): r.ids_crc32 for r in by_doc[doc, len(x)]}
            assert sum(n for _, n in pieces) == len(x)
            for (s, n), crc in pieces.items():
                if len(lists) == 1:
                    assert zlib.crc32(np.array(x[s : s + n], "<u4").tobytes()) == crc
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024


def test_substring_dedup(docs):
    rows = [(i, t) for i, t in awkward()]
    first = {}
    for i, t in rows:
        w = words_of(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    got = [tuple(r) for r in substring_dedup.cut_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = substring_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    sha = lambda t: hashlib.sha256(b" ".join(words_of(t))).hexdigest()
    assert sorted(sha(r.text) for r in kept.collect()) == sorted(x[3] for x in want)


def test_toxicity_tolerates_hidden_spellings():
    rng, words = random.Random(8), [w for w in vocabulary(2000, 9) if len(w) > 2]
    bad = ["grumbel", "snarvok", "plithox"]
    texts, toxic = [], []
    for n in range(400):
        t = rng.choices(words, k=40)
        if n % 5 == 0:
            for w in bad:
                t.insert(rng.randrange(len(t)), w)
        texts.append(" ".join(t) + ".")
        toxic.append(n % 5 == 0)
    m = toxicity.train(texts[:300], toxic[:300])
    right = sum((m.score(t) >= toxicity.THRESHOLD) == y for t, y in zip(texts[300:], toxic[300:], strict=True))
    assert right >= 95
    assert m.words("gru-mbel")[0] > m.words("table")[0] and len(m.words("g r u m b e l")) == 1
    assert 0 <= m.score("") <= 1 and m.score(None) == m.score("")


def test_decisions_equal_the_explicit_kernel():
    """A word's folded decision against a sum over all its gapped subsequences."""
    rng = np.random.default_rng(3)
    m = toxicity.Machine(rng.normal(size=toxicity.CLASSES**3).astype(np.float32), 0.25, (0.0, 1.0, 0.0))
    for word in ("a", "ab", "grumbel", "snàrvok", "x" * 40, "g.r.u.m"):
        code, _ = toxicity.encode(word)
        total = 0.0
        for i in range(len(code)):
            for k in range(i + 2, min(i + toxicity.SPAN, len(code))):
                for j in range(i + 1, k):
                    total += toxicity.DECAY ** (k - i + 1) * float(m.weight[(code[i] * toxicity.CLASSES + code[j]) * toxicity.CLASSES + code[k]])
        assert np.isclose(m.words(word)[0], total / float(toxicity.norm(len(code) - 2)) + 0.25, atol=1e-4)


def test_long_words_are_measured_alike():
    """A word's decision doesn't drift with its length: the norm follows the sum."""
    weight = np.zeros(toxicity.CLASSES**3, np.float32)
    code, _ = toxicity.encode("abcabcabc")
    weight[:] = 0.01
    m = toxicity.Machine(weight, -1.0, (0.0, 1.0, 0.0))
    got = [float(m.words("abc" * n)[0]) for n in (1_000, 20_000)]
    want = [0.01 * sum(toxicity.DECAY ** (k + 1) * (3 * n + 2 - k) for _, k in toxicity.SHAPES) / toxicity.norm(3 * n) - 1 for n in (1_000, 20_000)]
    assert np.allclose(got, want, rtol=1e-3)


def test_toxicity_query(docs, labels, empty):
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(awkward())
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a &amp; b<p>c\n d", "a & b\nc d"), ("<script>no</script><style>x</style>", ""),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T</h1><p><b>bold.<br><p>two</p></article><footer>f</footer>", "T\nbold.\ntwo"),
        ("<body><header>h</header><main><p>one two three</p><aside>side</aside><div class='comments'><p>said</p></div><form>f</form></main></body>", "one two three"),
        ("<body><div class=\"cookie-notice\">c</div><div><p>text here is long enough</p><ul><li>x<li>y</ul></div><div class='ad'>buy</div>", "text here is long enough\nx\ny"),
    ],
)
def test_html(html, text):
    assert html_extract.extract(html) == text


def test_html_query(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in html_extract.main_text(pages).orderBy("n_chars").collect()] == [(None, None, "", 0), (1, "u", "é", 1)]


def test_sentencepiece_round_trip(docs):
    rows = sp_codec.round_trip(docs).collect()
    assert len(rows) == len(awkward()) and all(r.lossless for r in rows)
    ids = sp_codec.encoded(docs.where("doc_id = 6")).first().ids
    again = sp_codec.encoded(docs.repartition(2)).where("doc_id = 6").first().ids
    assert ids == again
    back = sp_codec.decoded(sp_codec.encoded(docs))
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t in awkward())


def test_sampling_follows_the_lattice():
    """Frequencies of sampled segmentations against all paths of a small word."""
    codec = sp_codec.Codec(sp_codec.MODEL)
    word = b" the"
    w = codec.weight

    def paths(at):
        if at == len(word):
            yield (), 1.0
            return
        for end in range(at + 1, len(word) + 1):
            options = [(codec.byte_id[word[at]], codec.rare)] if end == at + 1 else []
            options += [w[word[at:end]]] if word[at:end] in w else []
            for i, x in options:
                for rest, y in paths(end):
                    yield (i, *rest), x * y

    want = dict(paths(0))
    total = sum(want.values())
    n = 4000
    got = {}
    for ids in codec.encode([" the"] * n, list(range(n))):
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
    for p, x in want.items():
        assert abs(got.get(p, 0) / n - x / total) < 0.04
    assert codec.decode(codec.encode(["▁ ▁x\u0000"], [1])[0]) == "▁ ▁x\u0000"


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/1?q", "https://www.example.com/en/2", "http://example.com/en", "http://x.net/es/", "http://net/fr/x#y", "http://x.net/de/", None, "nothing", "http://com?x", "http://xcom/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages, spark.createDataFrame([], "url string, block boolean")).collect()}
    assert got[0] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[1][2:] == ("www.example.com/en/", "allow") and got[2][2] == "com/"
    assert got[3][2:] == ("net/es/", "block") and got[4] == ("net", "/fr/x", "net/fr/", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("", "", None, "allow") == got[7] and got[8] == ("com", "", None, "allow") and got[9][2] is None


def test_url_mining(spark):
    rows = [(f"http://s{i % 7}.spam-farm.org/en/{i}", i % 10 != 0) for i in range(200)] + [(f"http://s{i % 7}.fine.org/en/{i}", i % 20 == 0) for i in range(600)]
    labelled = spark.createDataFrame(rows, "url string, block boolean")
    pages = spark.createDataFrame([(1, "http://new.spam-farm.org/en/9"), (2, "http://new.fine.org/en/9")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.judged(pages, labelled).collect()} == {1: "block", 2: "allow"}


def test_quality_classifier(docs, labels, empty):
    got = quality_classifier.classified(docs, labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classified(docs, labels.limit(0)).count() == len(awkward())


def test_empty_tables(empty, labels):
    for made in (
        quality_rules.judged(empty), exact_dedup.ranked_copies(empty), exact_dedup.drop_copies(empty), quality_classifier.classified(empty, labels), toxicity.toxicity(empty, labels),
        simhash.near_duplicates(empty), simhash.keep_one(empty), packing.pack_documents(empty), substring_dedup.cut_repeats(empty), substring_dedup.without_repeats(empty), sp_codec.round_trip(empty),
    ):
        assert made.count() == 0


def test_pipeline(spark, docs, labels, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert at.columns == docs.columns
    want = sorted((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32) for r in at.collect() if r.doc_id is not None)
    got = sorted((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None)
    assert got == want


def near_table():
    """Texts at many similarities, chains of edits, short texts, case and white space, ids that repeat."""
    rng, words = random.Random(12), vocabulary(2000, 13)
    rows = [(None, "only"), (0, ""), (1, None), (2, " \n"), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([30, 80, 300]))
        for _ in range(4):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rng.choice([1, 1, 2, len(base) // 40 + 1])):
                base[rng.randrange(len(base))] = rng.choice(words)
    return rows + [(20, "a text of its own that no other row has"), (21, rows[10][1])]


@pytest.mark.parametrize("tile", [3, 512])
def test_near_copies_against_all_pairs(spark, monkeypatch, tmp_path, tile):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "TILE", tile)
    rows = near_table()
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words_of(t)]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    assert len(set(group)) < len(rows) - 30
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()]
    assert len(kept) == len(set(group)) == len({group[rows.index(r)] for r in kept})
    lowest = {}
    for (i, _), g in zip(rows, group, strict=True):
        lowest[g] = min([x for x in (i, lowest.get(g)) if x is not None], default=None)
    assert all(r[0] == lowest[group[rows.index(r)]] for r in kept)


def test_repeated_ids_with_other_texts(spark):
    """An id's texts keep their own ranges and their own components."""
    rng, words = random.Random(21), vocabulary(3000, 22)
    passage, other = rng.choices(words, k=80), rng.choices(words, k=700)
    rows = [(1, passage), (2, passage), (5, rng.choices(words, k=60) + passage), (5, other), (5, rng.choices(words, k=51)), (7, other[:300] + passage[:55]), (7, other[400:]), (5, passage[:70] + other[:90])]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            first[tuple(w[k : k + 50])] = min(i, first.get(tuple(w[k : k + 50]), i))
    want = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in substring_dedup.cut_repeats(table).collect()) == sorted(want)
    assert sorted(hashlib.sha256(" ".join(r.text.split()).encode()).hexdigest() for r in substring_dedup.without_repeats(table).collect()) == sorted(x[3] for x in want)


def test_spans_are_verified_at_their_source(spark, monkeypatch):
    """Spans that a hash has claimed wrongly are found and stay; equal ones still go."""
    rng, words = random.Random(31), vocabulary(3000, 32)
    passage = rng.choices(words, k=70)
    other = rng.choices(words, k=70)
    rows = [(1, " ".join(passage)), (2, " ".join(other)), (3, " ".join(passage[:60] + rng.choices(words, k=20)))]
    docs = spark.createDataFrame([(i, i + 100, t) for i, t in rows], "doc long, row long, text string")
    claimed = [(2, 102, [(0, 70, 1, 101, 0)]), (3, 103, [(0, 60, 1, 101, 0), (5, 55, 2, 102, 5)])]
    spans = spark.createDataFrame(claimed, f"doc long, row long, ranges {substring_dedup.SPANS}")
    got = {r.doc: [(x.a, x.b, x.src) for x in r.ranges] for r in substring_dedup.verified(docs, spans).collect()}
    assert got == {2: [], 3: [(0, 60, 1)]}


def test_windows_in_a_row_are_one_span():
    import pandas as pd

    r = lambda a, b, src, sa: {"a": a, "b": b, "src": src, "src_row": 9, "sa": sa}
    got = substring_dedup.compacted(pd.Series([[r(10, 60, 1, 0), r(11, 61, 1, 1), r(60, 120, 1, 50), r(200, 250, 1, 5), r(12, 62, 2, 7)]]))[0]
    assert [(x["a"], x["b"], x["src"], x["sa"]) for x in got] == [(200, 250, 1, 5), (10, 120, 1, 0), (12, 62, 2, 7)]


@pytest.mark.parametrize("keep", [simhash.keep_one, near_copies.keep_one])
def test_each_component_keeps_a_row(spark, keep):
    rng, words = random.Random(23), vocabulary(3000, 24)
    a, b = (" ".join(rng.choices(words, k=80)) for _ in range(2))
    table = spark.createDataFrame([(5, a), (6, a.replace(" ", "\n")), (5, b), (3, b.replace(" ", "  "))], "doc_id long, text string")
    assert sorted((r.doc_id, r.text.split()[0]) for r in keep(table).collect()) == [(3, b.split()[0]), (5, a.split()[0])]


@pytest.mark.parametrize("toxic", [[], [None] * 30, [1] * 30, [0] * 30])
def test_labels_without_a_class_drop_nothing(spark, docs, toxic):
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    assert toxicity.without_toxic(docs, labels).count() == len(awkward())
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {0}


def test_every_url_rule_blocks(spark):
    """More bad hosts than MAX_RULES: each one's rule holds."""
    hosts = url_filter.MAX_RULES + 30
    rows = [(f"http://bad{'abcdefghij'[h % 10]}{h}x.org/p{i}", True) for h in range(hosts) for i in range(25)] + [(f"http://good{h}x.org/p{i}", False) for h in range(2 * hosts) for i in range(25)]
    pages = [(h, f"http://bad{'abcdefghij'[h % 10]}{h}x.org/new") for h in range(hosts)] + [(-1, "http://good3x.org/new"), (-2, None)]
    got = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rows, "url string, block boolean")).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == set(range(hosts)) and len(got) == len(pages)
