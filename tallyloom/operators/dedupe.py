"""Fuzzy name duplicates: a complete blocked similarity join, components, and the best of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.functions.plan import once
from tallyloom.sources.store import written

from .order import placed


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join by sorting both sides: label passing joins many times, and each broadcast would go through the driver."""
    return left.join(right.hint("merge"), on, how)


def keyed(names: DataFrame) -> DataFrame:
    """``names`` with their key, made once a row; those without one are left out."""
    return once(names, key=T.dedupe_key(F.col("name"))).where("key <> ''")


def stripped(keys: DataFrame) -> DataFrame:
    """key, s (the key without affixes), n (its length) of each distinct key; written."""
    return written(keys.select("key").distinct().withColumn("s", T.strip_affixes(F.col("key"))).withColumn("n", F.length("s")))


def edits_allowed(n: Column) -> Column:
    return F.when(n >= 8, 2).when(n >= 5, 1).otherwise(0)


def holders(forms: DataFrame) -> DataFrame:
    """(x, y): ``y`` holds ``x`` (distinct forms s, n), which has four characters at least and four tenths of the length of ``y``.

    A string that holds another holds all of its four-grams: the shorter one is looked up under its rarest.
    """
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("n") - 3), lambda i: F.col("s").substr(i, F.lit(4))))).alias("gram")
    spelled = written(forms.where("n >= 4").select("s", "n", grams))
    uses = spelled.groupBy("gram").agg(F.count("*").alias("uses"))
    rarest = spelled.join(uses, "gram").groupBy("s", "n").agg(F.min(F.struct("uses", "gram")).alias("r"))
    long = spelled.select(F.col("s").alias("y"), F.col("n").alias("yn"), "gram")
    inside = rarest.select(F.col("s").alias("x"), F.col("n").alias("xn"), F.col("r.gram").alias("gram"))
    inside = inside.join(long, "gram")
    return inside.where((F.col("xn") < F.col("yn")) & (F.col("xn") >= 0.4 * F.col("yn")) & F.contains("y", "x")).select("x", "y")


def blocks(forms: DataFrame) -> DataFrame:
    """block, s, n, cut: distinct forms of five characters and more under their segments (cut), and as what may be near such a form.

    The shorter of two forms k edits apart is cut into k + 1 even segments; one of them is in the longer one as it is. It can't be far from
    its own place either: before segment i there are at most i edits, after it at most k - i, so that few places need a look. A block
    is named by the shorter one's length, the segment's number and its text.
    """
    n = F.col("n")

    def segment(length: Column, k: Column, i: Column) -> tuple[Column, Column]:
        """Where segment ``i`` of a form of ``length`` begins (from 0), and how long it is; longer ones come last."""
        least, short = F.floor(length / (k + 1)).cast("int"), k + 1 - length % (k + 1)
        return i * least + F.greatest(F.lit(0), i - short), least + (i >= short).cast("int")

    def named(length: Column, i: Column, text: Column) -> Column:
        return F.concat_ws(":", length.cast("string"), i.cast("string"), text)

    def own(i: Column) -> Column:
        start, size = segment(n, edits_allowed(n), i)
        return F.struct(named(n, i, F.col("s").substr(start + 1, size)).alias("block"), F.lit(True).alias("cut"))

    def found(length: Column) -> Column:
        k, more = edits_allowed(length), n - length

        def at(i: Column) -> Column:
            start, size = segment(length, k, i)
            first = F.greatest(F.lit(0), start - i, start + more - (k - i))
            last = F.least(n - size, start + i, start + more + (k - i))
            places = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda p: F.struct(named(length, i, F.col("s").substr(p + 1, size)).alias("block"), F.lit(False).alias("cut")))

        every = F.flatten(F.transform(F.sequence(F.lit(0), k), at))
        return F.when((length >= 5) & (more <= k), every).otherwise(F.array().cast("array<struct<block:string,cut:boolean>>"))

    listed = F.concat(F.transform(F.sequence(F.lit(0), edits_allowed(n)), own), *[found(n - d) for d in range(3)])
    # Few bytes make much work: they are dealt to all cores.
    dealt = forms.where("n >= 5").repartition(forms.sparkSession.sparkContext.defaultParallelism)
    return written(dealt.select("s", "n", F.explode(F.array_distinct(listed)).alias("b")).select("b.block", "s", "n", "b.cut"))


def within_edits(pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (x, y) that are as many edits apart as the shorter one allows."""
    k = edits_allowed(F.least(F.length("x"), F.length("y")))
    near = F.when(k == 2, F.levenshtein("x", "y", 2) >= 0).when(k == 1, F.levenshtein("x", "y", 1) >= 0).otherwise(False)
    return pairs.where((F.col("x") != F.col("y")) & near)


def sides(listed: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """The forms that are cut in each block, and those that may be near them."""
    cut, seen = (listed.where(t).select("block", F.col("s").alias(c), *[F.col(m).alias(f"{c}_{m}") for m in more]) for t, c in (("cut", "x"), ("NOT cut", "y")))
    return cut, seen


def similar_names(keys: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct keys (column key) that name one thing.

    Candidates come from equi-joins, each complete for its rule: equal stripped keys, a rare four-gram, an even segment near its place.
    They are verified exactly. For groups alone ``name_roots`` needs no pairs.
    """
    base = stripped(keys)
    forms = base.select("s", "n").distinct()
    cut, seen = sides(blocks(forms))
    pairs = holders(forms).unionAll(within_edits(cut.join(seen, "block").select("x", "y"))).distinct()
    side = lambda form, key: base.select(F.col("s").alias(form), F.col("key").alias(key))
    found = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").select("a", "b")
    same = base.where("n >= 3").select("s", F.col("key").alias("a")).join(side("s", "b"), "s").select("a", "b")
    return found.unionAll(same).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def name_roots(keys: DataFrame) -> DataFrame:
    """(key, root): the smallest key that similar names lead to, itself for one that is like no other.

    Only links that span a group are drawn. Keys with one stripped form are that form's smallest key. In a block, each form is compared with
    the block's smallest; then blocks whose forms aren't one group yet are gone through, and only forms of different groups are compared.
    """
    base = stripped(keys)
    forms = written(base.where("n >= 3").groupBy("s", "n").agg(F.min("key").alias("key")))
    listed = blocks(forms.select("s", "n"))
    heads = written(listed.groupBy("block").agg(F.min(F.when(F.col("cut"), F.col("s"))).alias("x"), F.min(F.when(~F.col("cut"), F.col("s"))).alias("y")).where("x IS NOT NULL AND y IS NOT NULL"))
    stars = listed.join(heads, "block").select(F.when(F.col("cut"), F.col("s")).otherwise(F.col("x")).alias("x"), F.when(F.col("cut"), F.col("y")).otherwise(F.col("s")).alias("y"))
    links = written(holders(forms).unionAll(within_edits(stars.where("x <> y").distinct())))
    roots = components(links.toDF("a", "b"))
    placed = written(listed.join(roots, F.col("s") == F.col("key"), "left").select("block", "s", "cut", F.coalesce("root", "s").alias("root")))
    several = written(placed.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block"))
    cut, seen = sides(placed.join(several, "block"), "root")
    more = written(within_edits(cut.join(seen, "block").where("x_root <> y_root")).select(F.col("x_root").alias("a"), F.col("y_root").alias("b")).distinct())
    told = sorted_join(forms, roots.select(F.col("key").alias("s"), "root"), "s", "left").select("s", "key", F.coalesce("root", "s").alias("root"))
    if not more.isEmpty():
        # Groups are joined up by their names: what is in them is not passed through again.
        joined = components(more).select(F.col("key").alias("root"), F.col("root").alias("top"))
        told = sorted_join(told, joined, "root", "left").select("s", "key", F.coalesce("top", "root").alias("root"))
    # Groups are named by their smallest key: it is the smallest of its form.
    named = written(sorted_join(told, told.groupBy("root").agg(F.min("key").alias("first")), "root").select("s", "first"))
    return sorted_join(base, named, "s", "left").select("key", F.coalesce("first", "key").alias("root"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(key, root): root is the smallest key of each component; labels spread and then jump, written each round."""
    both = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = written(both.select(F.col("a").alias("key")).distinct().withColumn("root", F.col("key")))
    for _ in range(rounds):
        best = sorted_join(both, label, F.col("b") == F.col("key")).groupBy("a").agg(F.min("root").alias("near"))
        stepped = sorted_join(label, best, F.col("key") == F.col("a")).select("key", "root", F.least("root", "near").alias("to"))
        jumped = sorted_join(stepped, label.select(F.col("key").alias("k2"), F.col("root").alias("r2")), F.col("to") == F.col("k2"))
        new = written(jumped.select("key", F.least("to", "r2").alias("root"), (F.least("to", "r2") != F.col("root")).alias("moved")))
        label = new.select("key", "root")
        if new.where("moved").isEmpty():
            return label
    raise RuntimeError("components didn't settle")


def duplicate_groups(names: DataFrame) -> DataFrame:
    """id, name, score, root, size, tag (BEST or DUPLICATE) of each card in a group of two or more."""
    rows = written(keyed(names).select("id", "name", "score", "key"))  # texts are read for their names once
    rooted = written(rows.join(name_roots(rows), "key"))
    # The best one is the highest score, then the first id; no task sorts a whole group.
    first = F.min(F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("low"), "id"))
    groups = rooted.groupBy("root").agg(F.count("*").alias("size"), first.alias("best")).where("size >= 2")
    tag = F.when(F.col("id") == F.col("best.id"), "BEST").otherwise("DUPLICATE")
    return rooted.join(groups, "root").select("id", "name", "score", "root", "size", tag.alias("tag"))


def in_groups(groups: DataFrame) -> DataFrame:
    """root, id, place: the order of a duplicates view within each group, best score first, then the first id."""
    ordered = placed(groups.select("root", "id", "score"), [F.col("root").asc(), F.coalesce("score", F.lit(-1.0)).desc(), F.col("id").asc()], "at")
    starts = ordered.groupBy("root").agg(F.min("at").alias("start"))
    return ordered.join(starts, "root").select("root", "id", (F.col("at") - F.col("start") + 1).alias("place"))


def group_best(groups: DataFrame) -> DataFrame:
    return groups.where("tag = 'BEST'").select("root", "id", "score")


def cull_losers(groups: DataFrame) -> DataFrame:
    return groups.where("tag = 'DUPLICATE'").select("id", "root")
