"""URL filtering: a policy of host and path rules, and mined token rules for what the policy leaves open.

Tokens of a URL (host labels, path words, query keys) are mined with Spark's FP-growth over labelled URLs, the label
being one more item. Tokens that too few URLs have, or that all have, can't make a rule and are left out; tokens that
occur in exactly the same labelled URLs are one item, so that a host's fixed path doesn't double the itemsets with
each of its words. A combination of up to ``MAX_TOKENS`` items becomes a block rule if its support, confidence and
lift are high enough and no part of it does as well alone. Each rule is indexed by its rarest item; a URL looks up
the rules of its own tokens and checks those few.
"""

from __future__ import annotations

from itertools import chain

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, sized_broadcast

POLICY = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MIN_COUNT = 20
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.5
MIN_LIFT = 2.0
#: Longest combination that becomes a rule.
MAX_TOKENS = 4
#: Most rules that are matched as a literal; more are matched by joins, none is dropped.
MAX_RULES = 200
#: Item tables of up to so many rows are broadcast.
BROADCAST_ITEMS = 100_000
BLOCKED = "label:block"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def policy_rule(host: Column, path: Column, policy=POLICY) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(policy, key=lambda r: len(r[1])):  # the longest is tried first, as the outermost
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; numbers are left out, as no rule can rest on them."""
    words = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("host:"), x))
    segments = F.transform(F.split(path_of(url), "[/._-]+"), lambda x: F.concat(F.lit("path:"), x))
    query = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.filter(F.concat(words, segments, query), lambda x: ~x.rlike(r"^(path|host|query):\d*$")))


def token_items(rows: DataFrame, n: int) -> DataFrame:
    """(token, item) of the tokens of ``rows`` (url, tokens) that can be part of a rule; tokens of the very same URLs share an item."""
    counts = rows.select(F.explode("tokens").alias("token"), F.xxhash64("url").alias("at")).groupBy("token")
    uses = counts.agg(F.count("*").alias("uses"), F.sum(F.col("at").cast("decimal(38,0)")).alias("where"))
    uses = materialize(uses.where((F.col("uses") >= MIN_COUNT) & (F.col("uses") < n)))
    return materialize(uses.join(uses.groupBy("uses", "where").agg(F.min("token").alias("item")), ["uses", "where"]).select("token", "item"))


def item_sets(rows: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """``key`` and the distinct items of its tokens; ``rows``: key, tokens."""
    small, _ = sized_broadcast(items, BROADCAST_ITEMS)
    return rows.select(key, F.explode("tokens").alias("token")).join(small, "token").groupBy(key).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Block rules (items, confidence, count) of ``labelled`` (url, block), and the tokens of each item (token, item).

    All rules that pass and of which no part one item shorter does as well. Rows without a label or URL teach nothing.
    """
    rows = labelled.where("block IS NOT NULL AND url IS NOT NULL").select("url", "block", tokens_of(F.col("url")).alias("tokens"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("block").cast("int")), F.lit(0))).first()
    spark = labelled.sparkSession
    if not bad:
        return spark.createDataFrame([], "items array<string>, confidence double, count long"), spark.createDataFrame([], "token string, item string")
    items = token_items(rows, n)
    baskets = item_sets(rows, items, "row").join(rows.select("row", "block"), "row")
    baskets = materialize(baskets.select(F.concat("items", F.when(F.col("block"), F.array(F.lit(BLOCKED))).otherwise(F.array().cast("array<string>"))).alias("items")))
    # The least count of a rule's blocked URLs, as a share of the baskets; half a row less, as shares are rounded.
    least = max(MIN_SUPPORT * bad, MIN_COUNT * min_confidence)
    held = max(1, baskets.count())
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (least - 0.5) / held))).fit(baskets).freqItemsets
    sets = materialize(sets.where(F.size("items") <= MAX_TOKENS + 1).select(F.array_sort("items").alias("items"), "freq"))
    hits = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 1)).select(F.array_remove("items", BLOCKED).alias("items"), F.col("freq").alias("hit"))
    rules = hits.join(sets, "items").where((F.col("freq") >= MIN_COUNT) & (F.col("hit") >= least))
    rules = rules.select("items", (F.col("hit") / F.col("freq")).alias("confidence"), F.col("freq").alias("count"))
    rules = materialize(rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") * n >= MIN_LIFT * bad)))
    # A rule with a part that does as well alone says nothing more; one that stays for want of an item less changes no verdict.
    parts = rules.select("items", "confidence", F.explode(F.transform("items", lambda t: F.array_remove("items", t))).alias("part"))
    better = parts.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("alone")), "part").where("alone >= confidence")
    return materialize(rules.join(better.select("items").distinct(), "items", "left_anti")), items


def matcher(rules: DataFrame, items: DataFrame, tokens: Column) -> Column:
    """True where one of the mined ``rules``, at most MAX_RULES, has a token of each of its items in ``tokens``."""
    found = [r["items"] for r in rules.select("items").collect()]
    if not found:
        return F.lit(False)
    needed = rules.select(F.explode("items").alias("item")).distinct()
    of_item = {r["item"]: sorted(r["tokens"]) for r in items.join(needed, "item").groupBy("item").agg(F.collect_set("token").alias("tokens")).collect()}
    uses: dict[str, int] = {}
    for x in chain.from_iterable(found):
        uses[x] = uses.get(x, 0) + 1
    index: dict[str, list[list[list[str]]]] = {}
    for r in found:
        for token in of_item[min(r, key=lambda x: (uses[x], x))]:
            index.setdefault(token, []).append([of_item[x] for x in r])
    rule = lambda r: F.array(*[F.array(*map(F.lit, x)) for x in r])
    literal = F.create_map(*chain.from_iterable((F.lit(k), F.array(*map(rule, v))) for k, v in sorted(index.items())))
    mine = F.filter(tokens, lambda t: F.map_contains_key(literal, t))
    return F.exists(mine, lambda t: F.exists(F.element_at(literal, t), lambda r: F.forall(r, lambda x: F.arrays_overlap(x, tokens))))


def matched_urls(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url): the distinct ones of ``urls`` (url) that have all items of a rule, however many rules there are.

    A rule is looked up under its rarest item, so that an item of many URLs is joined with few rules.
    """
    of_url = item_sets(urls.where("url IS NOT NULL").distinct().withColumn("tokens", tokens_of(F.col("url"))), items, "url")
    listed = rules.select("items", F.explode("items").alias("item"))
    uses = listed.groupBy("item").agg(F.count("*").alias("uses"))
    index = listed.join(uses, "item").groupBy("items").agg(F.min(F.struct("uses", "item")).alias("rarest"))
    index = index.select(F.col("rarest.item").alias("item"), F.col("items").alias("rule"))
    hits = of_url.select("url", "items", F.explode("items").alias("item")).join(index, "item")
    return hits.where(F.size(F.array_except("rule", "items")) == 0).select("url").distinct()


def judged(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", policy=POLICY) -> DataFrame:
    """One row per page: ``id_col``, host, path, rule, verdict, mined (whether a mined rule matches).

    A null URL, or one without ``://``, has an empty host and path and no rule; its verdict is the mined rules'. Pages that
    repeat an id or URL are judged singly; further columns are left out. Without labels no rule is mined.
    """
    url = F.col(url_col)
    rules, items = mine_rules(labelled)
    if rules.limit(MAX_RULES + 1).count() <= MAX_RULES:
        mined = matcher(rules, items, tokens_of(url))
    else:
        name = free_name(pages.columns, "matched")
        pages = pages.join(matched_urls(pages.select(url.alias("url")), rules, items).select(F.col("url").alias(name)), url == F.col(name), "left")
        mined = F.col(name).isNotNull()
    rows = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), mined.alias("mined"))
    rule, verdict = policy_rule(F.col("host"), F.col("path"), policy)
    method = F.when(F.col("mined"), "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "mined")
