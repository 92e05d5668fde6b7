"""Edit metrics, the exact radius join in metric space, and connected components."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.common import Memo, cut


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: edits, and swaps of neighbours even around later edits. A true metric."""
    if a == b:
        return 0
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    last: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        matched = 0
        for j in range(1, len(b) + 1):
            i1, j1 = last.get(b[j - 1], 0), matched
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, matched = 0, j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[a[i - 1]] = i
    return d[-1][-1]


@Memo
def levenshtein(a: str, b: str) -> int:
    """Insertions, deletions and replacements that turn one text into the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0], diagonal = i, i, i - 1
        for j, y in enumerate(b, 1):
            left = min(left + 1, row[j] + 1, diagonal + (x != y))
            diagonal, row[j] = row[j], left
    return row[-1]


def unmatched(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """What is left of two bags of words when equal words are taken off both."""
    p, q = Counter(a), Counter(b)
    return list((p - q).elements()), list((q - p).elements())


def assignment(cost: list[list[int]]) -> int:
    """Least total cost of a square matrix with one entry in each row and column, by shortest augmenting paths."""
    n = len(cost)
    if n <= 3:
        return min((sum(cost[k][c] for k, c in enumerate(order)) for order in itertools.permutations(range(n))), default=0)
    inf = float("inf")
    of_row, of_column, holder = [0.0] * n, [0.0] * n, [-1] * n
    for start in range(n):
        slack, before, seen = [inf] * n, [-1] * n, [False] * n
        row, column = start, -1
        while True:
            best, following = inf, -1
            for c in range(n):
                if not seen[c]:
                    reduced = cost[row][c] - of_row[row] - of_column[c]
                    if reduced < slack[c]:
                        slack[c], before[c] = reduced, column
                    if slack[c] < best:
                        best, following = slack[c], c
            of_row[start] += best
            for c in range(n):
                if seen[c]:
                    of_row[holder[c]] += best
                    of_column[c] -= best
                else:
                    slack[c] -= best
            column = following
            seen[column] = True
            if holder[column] < 0:
                break
            row = holder[column]
        while before[column] >= 0:
            holder[column] = holder[before[column]]
            column = before[column]
        holder[column] = start
    return sum(cost[holder[c]][c] for c in range(n))


def bag_distance(a: str, b: str) -> int:
    """Least edits that turn the words of one text into those of the other, in any order; a word may come or go whole.

    This is the assignment distance over the Levenshtein distance, with the empty word as the partner of what is left over,
    and so a true metric. Equal words may be paired first: by the triangle inequality that is among the best pairings.
    """
    x, y = unmatched(a.split(), b.split())
    size = max(len(x), len(y))
    x += [""] * (size - len(x))
    y += [""] * (size - len(y))
    return assignment([[levenshtein(v, w) for w in y] for v in x])


@F.pandas_udf(T.IntegerType())
def _bag_pair(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bag_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _bag_each(a: pd.Series, pivots: pd.Series) -> pd.Series:
    return pd.Series([[bag_distance(x, p) for p in ps] for x, ps in zip(a, pivots, strict=True)], dtype=object)


class Metric(NamedTuple):
    """A metric on points: of two; of one with each of an array, where a null stands for more than the least plus a slack; a cheap lower bound of the first."""

    pair: Callable[[Column, Column], Column]
    each: Callable[[Column, Column, Column], Column]
    bound: Callable[[Column, Column], Column]


def _words_and_number(a: Column, b: Column) -> Column:
    w = lambda x, y: F.levenshtein(a[x], b[y])
    return F.least(w("p1", "p1") + w("p2", "p2"), w("p1", "p2") + w("p2", "p1")) + F.abs(a["num"] - b["num"]).cast("int")


def _letters(x: Column) -> Column:
    return F.length(x["p1"]) + F.length(x["p2"])


def _words_and_number_each(a: Column, pivots: Column, slack: Column) -> Column:
    """Only pivots whose number lets them be nearest, or nearest plus the slack, have their words compared."""
    apart = lambda p: F.abs(a["num"] - p["num"])
    reach = F.array_min(F.transform(pivots, lambda p: apart(p) + _letters(a) + _letters(p))) + slack
    return F.get(F.transform(F.array(reach), lambda most: F.transform(pivots, lambda p: F.when(apart(p) <= most, _words_and_number(a, p)))), F.lit(0))


#: Points struct<p1, p2, num>: the bag distance of two words (either may be empty) plus the difference of the numbers.
WORDS_AND_NUMBER = Metric(_words_and_number, _words_and_number_each, lambda a, b: F.abs(_letters(a) - _letters(b)) + F.abs(a["num"] - b["num"]))
#: Points string: :func:`bag_distance`.
BAGS = Metric(_bag_pair, lambda a, pivots, slack: _bag_each(a, pivots), lambda a, b: F.abs(F.length(F.replace(a, F.lit(" "), F.lit(""))) - F.length(F.replace(b, F.lit(" "), F.lit("")))))


#: Comparisons that are one task's work, tasks from which a cell is split, and pivots of a cell at most.
WORK, SPLIT, PIVOTS = 1 << 18, 8, 128


def radius_join(points: DataFrame, metric: Metric = WORDS_AND_NUMBER) -> DataFrame:
    """(space, a, b, who_a, who_b): all pairs of a home point a and a point b of one space within its radius.

    ``points``: space, radius (the same throughout a space), point (of the type the metric takes), home (whether pairs of
    this point are asked for) and who (any payload). A point is never paired with one of the same payload.

    A cell holds the points near one pivot. Each point has its home in the cell of its nearest pivot; it is also copied into
    every cell whose pivot is at most twice the radius farther: by the triangle inequality no pair is lost, since a partner
    y of x has d(y, pivot of x) <= d(y, pivot of y) + 2r. Each space begins as one cell; a cell of more than SPLIT
    times WORK comparisons is split by as many pivots as its size asks for, and its cells again, so pivots grow with the data. Where the points lie so
    evenly far apart that most would be copied into most cells, pivots cannot part them; such a cell stays whole, its home
    points are dealt out to as many tasks as its comparisons need, and each task meets all points of the cell. Which points
    are pivots, and how far cells are split, changes the speed and never the result. Within a cell, only pairs whose
    distances to its pivot differ by the radius at most are compared further. Nothing is capped.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = points.select("space", "radius", "point", "home", "who", F.lit("").alias("cell"), F.lit(0).alias("d"))
    cells, key = cut(cells.repartition(tasks, "point")), ["space", "cell"]
    while True:
        sizes = cells.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
        sizes = cut(sizes.where("h > 0").withColumn("tasks", F.ceil(F.col("n") * F.col("h") / WORK).cast("int")))
        big = sizes.where(F.col("tasks") > SPLIT).withColumn("k", F.least(F.lit(PIVOTS), F.ceil(2 * F.sqrt("tasks"))).cast("int"))
        if big.isEmpty():
            break
        # the points first in order of a hash: the pivots, and others on which the copies of a split are counted beforehand
        unit = F.pmod(F.xxhash64("space", "point"), F.lit(1 << 30)) / float(1 << 30)
        some = cells.join(big, key).where(unit * F.col("n") <= 4 * F.col("k")).groupBy(*key).agg(F.first("radius").alias("radius"), F.first("k").alias("k"), F.array_sort(F.collect_set(F.struct(unit.alias("u"), "point"))).alias("some"))
        some = some.select(*key, "radius", "k", F.transform("some", lambda s: s["point"]).alias("some")).withColumn("pivots", F.slice("some", 1, F.col("k")))
        tried = some.select(*key, "radius", "pivots", F.explode("some").alias("x")).withColumn("to", metric.each(F.col("x"), F.col("pivots"), 2 * F.col("radius")))
        tried = tried.groupBy(*key).agg(F.avg(F.size(F.filter("to", lambda d: d <= F.array_min("to") + 2 * F.col("radius")))).alias("copies"))
        pivots = cut(some.join(tried, key).where((F.size("pivots") > 1) & (2 * F.col("copies") <= F.size("pivots"))).select(*key, "pivots"))
        if pivots.isEmpty():
            break
        to = F.filter(F.transform(F.col("to"), lambda d, k: F.struct(d.alias("d"), k.alias("to"))), lambda t: t["d"].isNotNull())
        split = cells.join(pivots, key).withColumn("to", metric.each(F.col("point"), F.col("pivots"), 2 * F.col("radius"))).withColumn("to", to).withColumn("own", F.array_min("to"))
        split = split.select("space", "radius", "point", "home", "who", "cell", "own", F.inline(F.filter("to", lambda t: t["d"] <= F.col("own.d") + 2 * F.col("radius"))).alias("d", "to"))
        split = split.select("space", "radius", "point", (F.col("home") & (F.col("to") == F.col("own.to"))).alias("home"), "who", F.concat_ws(".", "cell", F.col("to").cast("string")).alias("cell"), "d")
        cells = cut(cells.join(pivots.select(*key), key, "left_anti").unionByName(split))
    dealt = cells.join(sizes.select(*key, "tasks"), key)
    a = dealt.where("home").select(*key, F.pmod(F.xxhash64("point"), F.col("tasks").cast("long")).alias("task"), F.col("point").alias("a"), F.col("who").alias("who_a"), F.col("d").alias("d_a"), "radius")
    b = dealt.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks").cast("long") - 1)).alias("task"), F.col("point").alias("b"), F.col("who").alias("who_b"), F.col("d").alias("d_b"))
    pairs = a.join(b, [*key, "task"]).where((F.abs(F.col("d_a") - F.col("d_b")) <= F.col("radius")) & (F.col("who_a") != F.col("who_b")))
    near = (metric.bound(F.col("a"), F.col("b")) <= F.col("radius")) & (metric.pair(F.col("a"), F.col("b")) <= F.col("radius"))
    return pairs.where(near).select("space", "a", "b", "who_a", "who_b")


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edges (a, b) of one partition as stars with the same components: every node with the smallest of its component."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for edges in batches:
        for a, b in zip(edges.a, edges.b, strict=True):
            p, q = root(a), root(b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    yield pd.DataFrame([(x, root(x)) for x in list(parent)], columns=["a", "b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component): connected components of (a, b), by the smallest label of the neighbourhood and of its label.

    Each partition first replaces its edges by stars, which leaves fewer edges and short ways. Each round then takes the
    smallest label around and follows labels of labels, so the number of rounds grows as the logarithm of a component's
    diameter. Labels are written to the shared checkpoint folder each round and never collected. Nodes that have no edge but
    to themselves are their own component; null ends make no edge.
    """
    stars = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").mapInPandas(_forest, "a string, b string")
    both = cut(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    for _ in range(rounds):
        seen = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        new = label.join(seen, "node").join(jump, "component", "left")
        new = cut(new.select("node", F.least("component", "m", "c2").alias("component"), F.col("component").alias("old")))
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError(f"no end after {rounds} rounds")
