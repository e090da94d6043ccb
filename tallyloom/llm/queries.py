"""Queries of the numbered operators, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judged

    return judged(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import ranked_copies

    return ranked_copies(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classified

    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sp_codec import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


#: How a page's article begins: what the text of the document that it shows begins with.
OPENING = r"(?s)<article>.*?<p>(?:<b>)?([^<]*)"


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A URL is one to block if the labelled documents that its page's article begins like are all of quality 0."""
    from .url_filter import judged

    pages, labels, docs = (table(spark, sf_dir, x) for x in ("pages", "labels", "documents"))
    line = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("opening")
    known = docs.select("doc_id", line).join(labels.where("quality IS NOT NULL"), "doc_id").groupBy("opening").agg((F.max("quality") == 0).alias("block"))
    shown = pages.select("url", F.regexp_extract(F.coalesce("html", F.lit("")), OPENING, 1).alias("opening"))
    return judged(pages, shown.join(known, "opening").select("url", "block"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import cut_repeats

    return cut_repeats(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import variants

    return variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import index, search

    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def url_sql() -> str:
    """op7 in SQL: the policy, and every combination of tokens tried as a rule."""
    from .url_filter import MAX_TOKENS, MIN_CONFIDENCE, MIN_COUNT, MIN_LIFT, MIN_SUPPORT, POLICY

    fits = [(w, r, *r.split("/", 1)) for w, r in sorted(POLICY, key=lambda x: -len(x[1]))]
    case = lambda k: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{(w, r)[k]}'" for w, r, h, p in fits)
    label = lambda kind: f"lambda x: '{kind}:' || x"
    more = "".join(
        f", s{k} AS (SELECT a.nr, a.block, list_append(a.s, b.t) AS s FROM s{k - 1} a JOIN tok b ON a.nr = b.nr AND a.s[{k - 1}] < b.t)" for k in range(2, MAX_TOKENS + 1)
    )
    return rf"""WITH known AS (SELECT split_part(coalesce(text, ''), chr(10), 1) AS opening, max(quality) = 0 AS block FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1),
        cut AS (SELECT page_id, url, html, coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '') AS h0, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS nr FROM pages),
        urls AS (SELECT *, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM cut),
        spelled AS (SELECT *, list_distinct(list_filter(list_concat(list_transform(string_split(host, '.'), {label("host")}), list_transform(regexp_split_to_array(path, '[/._-]+'), {label("path")}),
            list_transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)=', 1), {label("query")})), lambda x: NOT regexp_matches(x, '^(path|host|query):\d*$'))) AS tokens FROM urls),
        taught AS (SELECT s.nr, s.tokens, k.block FROM spelled s JOIN known k ON k.opening = regexp_extract(coalesce(s.html, ''), '{OPENING}', 1) WHERE s.url IS NOT NULL),
        seen AS (SELECT count(*) AS n, coalesce(sum(CAST(block AS INTEGER)), 0) AS bad FROM taught),
        every AS (SELECT nr, block, unnest(tokens) AS t FROM taught),
        tok AS (SELECT * FROM every WHERE t IN (SELECT t FROM every GROUP BY t HAVING count(*) >= {MIN_COUNT} AND count(*) < (SELECT n FROM seen))),
        s1 AS (SELECT nr, block, [t] AS s FROM tok){more},
        rules AS (SELECT s FROM ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, MAX_TOKENS + 1))}), seen GROUP BY s, n, bad
            HAVING count(*) >= {MIN_COUNT} AND count(*) FILTER (block) >= greatest({MIN_SUPPORT} * bad, {MIN_COUNT * MIN_CONFIDENCE})
            AND count(*) FILTER (block) >= {MIN_CONFIDENCE} * count(*) AND count(*) FILTER (block) * n >= {MIN_LIFT} * bad * count(*)),
        told AS (SELECT *, EXISTS (SELECT 1 FROM rules r WHERE list_has_all(tokens, r.s)) AS mined FROM spelled)
        SELECT page_id, host, path, CASE {case(1)} END AS rule, coalesce(CASE {case(0)} END, CASE WHEN mined THEN 'block' ELSE 'allow' END) AS verdict, mined FROM told"""


#: op10 in SQL: every window of 50 words spelled out.
REPEATS = r"""WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), sized AS (SELECT *, len(w) AS n FROM split),
    starts AS (SELECT doc_id, w, unnest(range(1, n - 48)) AS j FROM sized WHERE n >= 50), spelled AS (SELECT doc_id, j, array_to_string(w[j:j + 49], ' ') AS k FROM starts),
    firsts AS (SELECT k, min(doc_id) AS f FROM spelled GROUP BY k), gone AS (SELECT doc_id, j FROM spelled JOIN firsts USING (k) WHERE f < doc_id),
    words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS j FROM sized),
    cut AS (SELECT w.doc_id, w.word, w.j, max(CASE WHEN g.j IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.j = w.j),
    told AS (SELECT doc_id, count(*) FILTER (c = 1) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (c = 0) AS kept FROM cut GROUP BY 1)
    SELECT s.doc_id, s.n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM sized s LEFT JOIN told t ON t.doc_id = s.doc_id"""


#: op11 in SQL: the checksum byte by byte, and words that agree once a letter is left out of one or both.
SPELLED = r"""WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM range(256) t(i)),
    runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY 1, 2),
    spelled AS (SELECT *, hex(doc_id || ':' || run) AS x FROM runs),
    summed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT))), lambda c, b: xor(tab[xor(c, b) % 256 + 1], c >> 8)), 4294967295) AS h FROM spelled, crc),
    cut AS (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
    less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.d = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.d = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, {'m': -n, 'o': other}) AS other, max(n) AS most FROM near GROUP BY 1),
    told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN other END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
    chain AS (SELECT word, word AS at FROM told UNION ALL SELECT c.word, t.form FROM chain c JOIN told t ON t.word = c.at WHERE t.form IS NOT NULL),
    ends AS (SELECT c.word, c.at AS root FROM chain c JOIN told t ON t.word = c.at WHERE t.form IS NULL)
    SELECT t.word, t.form, e.root, t.n, t.n_near, t.form_n FROM told t JOIN ends e ON e.word = t.word"""

#: op12 in SQL: every document scored for every item.
RANKED = r"""WITH cut AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM cut GROUP BY 1, 2),
    sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
    totals AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
    dfs AS (SELECT term, count(*) AS df FROM tfs WHERE term IN (SELECT term FROM asked) GROUP BY 1),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM dfs, totals),
    impacts AS (SELECT t.doc_id, t.term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)) AS i FROM tfs t JOIN dfs USING (term) JOIN sizes s ON s.doc_id = t.doc_id, totals),
    scores AS (SELECT item_id, doc_id, sum(times * w * i)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY 1, 2)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""

#: op13 in SQL: the shingles that any two sets share, counted.
LINKED = r"""WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k:k + 4], ' ')))) AS s FROM split WHERE len(w) > 0),
    nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets GROUP BY s),
    long AS (SELECT node, n, unnest(s) AS g FROM nodes),
    links AS (SELECT a.node AS u, b.node AS v FROM long a JOIN long b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.node, b.node, a.n, b.n HAVING 185 * count(*) >= 85 * (a.n + b.n)),
    sym AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach AS (SELECT node AS u, node AS v FROM nodes UNION SELECT r.u, s.v FROM reach r JOIN sym s ON s.u = r.v),
    roots AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY 1),
    told AS (SELECT t.doc_id, len(t.s) AS n, r.root FROM sets t JOIN nodes d ON d.s = t.s JOIN roots r ON r.node = d.node)
    SELECT d.doc_id, coalesce(t.n, 0) AS n_shingles, coalesce(t.root, d.doc_id) AS component_id, coalesce(t.root, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN told t USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_spelling_variants": SPELLED,
        "op12_lexical_search": RANKED,
        "op13_minhash": LINKED,
        "op10_substring_dedup": REPEATS,
        "op7_url_filters": url_sql(),
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
