"""Components of what is similar among the members of common lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.graph import components
from .common import broadcast_if_small, cut

#: Lists of more members than this count as long.
DENSE = 32

__all__ = ["components", "linked"]


def linked(lists: DataFrame, fits: Callable[[str, str], Column], common: Callable[[Column, Column], Column], verify: Callable[[DataFrame], DataFrame], families: Callable[[DataFrame], DataFrame] | None = None, dense: int = DENSE, smallest: Callable[[Column], Column] = lambda n: F.lit(0)) -> DataFrame:
    """Components under the verified links among members of common lists: node, root; nodes without a link are absent.

    lists: gram, key, n, head, head_n, one row for each member of each list, head being the first member; fits(n, m) is
    a cheap condition on sizes, common(n, m) how many lists two members must share, verify turns candidate pairs (a, b)
    into those that are links. First every member meets the head of its lists only. Then lists that hold several
    components are taken up, and in them the pairs of a member outside the list's largest component with the members of
    other components. A pair within one component adds nothing to it, so no component is lost, and a large group of
    copies costs one pair a member. With families given, lists of more than dense members that are still open are not
    paired: the members of such lists form families (those that share a list), and families(members) gives links enough
    to join whatever is similar within one; members (with their size n) outside its largest component are marked minor.
    Two members that share long lists only share common of them, so who is in fewer (for the smallest(n) that fits) is in
    no family, and lists that meet by chance make none; a pair of a shorter list counts what long lists both may share.
    """
    heads = lists.where((F.col("key") != F.col("head")) & fits("n", "head_n")).groupBy(F.col("head").alias("a"), F.col("key").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("head_n").alias("m"))
    first = cut(heads.where(F.col("c") >= common(F.col("n"), F.col("m"))).select("a", "b"))
    edges = cut(verify(first))
    roots = components(edges)
    placed = lists.join(roots, F.col("key") == F.col("node"), "left").select("gram", "key", "n", F.coalesce("root", "key").alias("comp"))
    several = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("gram")
    opened = cut(placed.join(several, "gram", "left_semi"))
    in_long = F.lit(0).cast("long")
    if families is not None:
        long = broadcast_if_small(opened.groupBy("gram").agg(F.count("*").alias("members")).where(F.col("members") > dense).select("gram"))
        held = opened.join(long, "gram", "left_semi")
        often = broadcast_if_small(held.groupBy("key").agg(F.count("*").alias("long")))
        kept = held.join(often, "key").where(F.col("long") >= common(F.col("n"), smallest(F.col("n"))))
        # who is left of a list: a list left with one component joins nobody
        left = cut(kept.select("gram", "key", "n", "comp"))
        still = left.groupBy("gram").agg(F.min("key").alias("least"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("gram", "least")
        crowd = cut(left.join(still, "gram").select("key", "least", "comp", "n").distinct())
        opened = opened.join(long, "gram", "left_anti").join(often, "key", "left")
        in_long = F.coalesce("long", in_long)
        if not crowd.isEmpty():
            of_family = components(crowd.select("key", "least")).select(F.col("node").alias("key"), F.col("root").alias("family"))
            placed_in = cut(of_family.join(crowd.select("key", "comp", "n").distinct(), "key"))
            major = placed_in.groupBy("family", "comp").count().groupBy("family").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"))
            edges = edges.union(cut(families(placed_in.join(major, "family").select("key", "family", "n", (F.col("comp") != F.col("major")).alias("minor")))))
    opened = opened.withColumn("long", in_long)
    major = opened.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"))
    marked = opened.join(major, "gram").withColumn("minor", F.col("comp") != F.col("major"))
    minor = marked.where("minor").select("gram", F.col("key").alias("k2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("long").alias("long2"))
    # of two minor members, the smaller key is taken on the left, so a pair comes once a list
    once = ~F.col("minor") | (F.col("key") < F.col("k2"))
    met = marked.join(minor, "gram").where((F.col("comp") != F.col("comp2")) & once & fits("n", "n2"))
    across = met.groupBy(F.least("key", "k2").alias("a"), F.greatest("key", "k2").alias("b")).agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("n2").alias("m"), F.first(F.least("long", "long2")).alias("more"))
    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = cut(across.where(F.col("c") + F.col("more") >= common(F.col("n"), F.col("m"))).select("a", "b").join(tried, ["a", "b"], "left_anti"))
    return components(edges if second.isEmpty() else edges.union(cut(verify(second))))
