"""Matchings, independent sets and components over tables of pairs. What can be solved apart is: images whose pairs fit in a task are solved
each in one step, larger images fall into components, which are dealt to tasks, and only components of more than LIMIT pairs go through
rounds over the whole table. Rounds cut the lineage with checkpoint(), whose folder executors share."""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Pairs that one task solves, at most (a pair takes some 40 bytes); hashing may put a few times as many small components together.
LIMIT = 500_000

#: The auction's least step is divided by this from phase to phase (speed only).
FALL = 32


def _ready(spark: SparkSession) -> None:
    """Sets a checkpoint folder where none is: one of spark.checkpoint.dir, else in the warehouse, or on a local master a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc.setCheckpointDir(base or (tempfile.mkdtemp(prefix="spark-checkpoint-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"))


def cut(df: DataFrame) -> DataFrame:
    _ready(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, by: str = "image") -> DataFrame:
    """by, node, root: the least node that each node of the edges (by, a, b) reaches, for the nodes other than the roots. Where no image has more
    than LIMIT edges, each is done in one step; else large-star and small-star rounds alternate until the stars no longer change."""
    pairs = lambda df: df.select(by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges, state = cut(pairs(edges)), None
    most = edges.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    if most <= LIMIT and isinstance(edges.schema["a"].dataType, (IntegralType, StringType)):
        own = edges.select(by, F.col("a").alias("node"), F.col("b").alias("root"))
        return own.groupBy(by).applyInArrow(_rooted, own.schema)
    while True:
        both = edges.unionAll(edges.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(by, "a").agg(F.min("b").alias("m")).select(by, "a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, [by, "a"]).select(by, F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.filter("m < a").select(by, "a", F.col("m").alias("b")))
        large = cut(pairs(large))
        low = large.groupBy(by, "a").agg(F.min("b").alias("m"))
        small = large.join(low, [by, "a"]).select(by, F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select(by, "a", F.col("m").alias("b")))
        edges = cut(pairs(small))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64(by, "a", "b"))).first())
        if now == state:
            return edges.select(by, F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def _rooted(edges: pa.Table) -> pa.Table:
    """The edges (by, node, root) of one image as its nodes and the least ones that they reach, roots left out."""
    by, *ends = (edges[k].combine_chunks() for k in range(3))
    known = pc.unique(pa.concat_arrays(ends))
    known = known.take(pc.sort_indices(known))
    a, b = (pc.index_in(k, known).to_numpy() for k in ends)
    label = np.arange(len(known))
    while True:
        p, q = label[a], label[b]
        met = p != q
        if not met.any():
            break
        a, b = p[met], q[met]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    nodes = np.flatnonzero(label != np.arange(len(known)))
    return pa.Table.from_arrays([by.take(pa.array(np.zeros(len(nodes), np.int64))), known.take(pa.array(nodes)), known.take(pa.array(label[nodes]))], names=edges.column_names)


def _picked(rows: DataFrame, keys: list[str], pick: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """The rows of each group that pick gives the numbers of."""
    return rows.groupBy(*keys).applyInArrow(lambda table: table.combine_chunks().take(pa.array(pick(table), pa.int64())), rows.schema)


def solved(pairs: DataFrame, pick: Callable[[pa.Table], np.ndarray], in_rounds: Callable[[DataFrame], DataFrame] | None, sides: bool = True) -> DataFrame:
    """The pairs (image, a, b, ...) that pick chooses of each image, whose components don't matter to each other; sides: a and b are ids of two
    kinds. in_rounds does the same for components of more than LIMIT pairs; without it, those are solved each in one task."""
    pairs = cut(pairs)
    sizes = pairs.groupBy("image").agg(F.count("*").alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= LIMIT:
        return _picked(pairs, ["image"], pick)
    columns = pairs.columns
    sized = pairs.join(sizes, "image")
    small, large = sized.filter(F.col("_n") <= LIMIT).select(*columns), cut(sized.filter(F.col("_n") > LIMIT))
    node = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("id")) if sides else F.col(c)
    roots = components(large.select("image", node(0, "a").alias("a"), node(1, "b").alias("b"))).select("image", F.col("node").alias("_node"), F.col("root").alias("_root"))
    # The least node of a component is its root and has no row there.
    rooted = large.withColumn("_node", node(1, "b")).join(roots, ["image", "_node"], "left").withColumn("_root", F.coalesce("_root", "_node"))
    each = rooted.groupBy("image", "_root").agg(F.count("*").alias("_own"))
    rooted = cut(rooted.join(each, ["image", "_root"]))
    light = F.col("_own") <= LIMIT if in_rounds else F.lit(True)
    part = F.when(F.col("_own") > LIMIT, F.xxhash64("_root")).otherwise(F.pmod(F.xxhash64("_root"), F.ceil(F.col("_n") / LIMIT)))
    dealt = rooted.filter(light).select(*columns, part.alias("_part"))
    out = _picked(small, ["image"], pick).unionAll(_picked(dealt, ["image", "_part"], pick).select(*columns))
    heavy = rooted.filter(~light).select(*columns)
    return out if in_rounds is None or heavy.isEmpty() else out.unionAll(in_rounds(heavy))


def _bid(table: pa.Table, step: int) -> pa.Table:
    """The places (o, price, owner) that change hands as the free bidders of the table (p, o, w, price, owner) bid until none is left: one raises its
    best place's price to where its second best is as good, less step, and who had the place is free, to bid on if its rows are here as well."""
    order = pc.sort_indices(table, sort_keys=[("p", "ascending"), ("o", "ascending")])
    rows = table.take(order)
    bidders, first = np.unique(rows["p"].to_numpy(), return_index=True)
    places, one, at = np.unique(rows["o"].to_numpy(), return_index=True, return_inverse=True)
    price = rows["price"].to_numpy()[one].tolist()
    number = {p: i for i, p in enumerate(bidders.tolist())}
    owner = [p if p is None else number.get(p, -1) for p in rows["owner"].take(pa.array(one)).to_pylist()]
    ends = [*first.tolist()[1:], len(rows)]
    ways = [list(zip(o, w)) for o, w in ((at[i:j].tolist(), rows["w"][i:j].to_pylist()) for i, j in zip(first.tolist(), ends))]
    served, changed = {i for i in owner if i is not None and i >= 0}, set()
    free = deque(i for i in range(len(bidders)) if i not in served)
    while free:
        i = free.popleft()
        best, best_v, second = -1, None, None
        for o, w in ways[i]:
            v = w - price[o]
            if best_v is None or v > best_v:
                best, best_v, second = o, v, best_v
            elif second is None or v > second:
                second = v
        price[best] += best_v - (best_v if second is None else second) + step
        if owner[best] is not None and owner[best] >= 0:
            free.append(owner[best])
        owner[best] = i
        changed.add(best)
    out = sorted(changed)
    return pa.table({"o": pa.array(places[out], pa.int64()), "price": pa.array([price[o] for o in out], pa.int64()), "owner": pa.array(bidders[[owner[o] for o in out]], pa.int64())})


def _around(ways: DataFrame, free: DataFrame, prices: DataFrame, size: int) -> DataFrame | None:
    """The ways of the free bidders and of those they may set free, as many steps on as size rows allow; None if the free ones' own are more."""
    near, found = free, None
    while True:
        own = cut(ways.join(near, "p", "left_semi"))
        if own.count() > size:
            return found
        found, before = own, near
        near = cut(own.select("o").distinct().join(prices, "o").filter("owner is not null").select(F.col("owner").alias("p")).unionAll(before).distinct())
        if near.count() == before.count():
            return found


def best_in_rounds(pairs: DataFrame, units: int = 1_000_000, size: int = 4 * LIMIT) -> DataFrame:
    """The pairs (image, a, b, iou) of a one-to-one matching with the greatest total of round(units * iou), exactly, by an auction over the whole
    table. Each side's nodes get doubles that stand for staying alone: a bids for the b of its pairs or its own double, the double of b for b or the
    doubles of its pairs' a, so all bidders are served in the end and any prices may be started from. Values are multiplied by more than the number
    of bidders; the bids' least step falls by FALL from phase to phase down to 1, where the total can't be improved by a whole unit.
    In a round bidders are dealt to tasks of about size rows, each of which goes through its bids at the prices before the round; then the highest
    bid for a place counts and whoever lost is free in the next round. Prices only rise and who has a place has it at its price, so a round needs no
    other agreement. When the free bidders are few, one task takes them and what lies around them. Prices beyond a long raise an error."""
    pairs = cut(pairs.groupBy("image", "a", "b").agg(F.max("iou").alias("iou")).withColumn("w", F.round(F.col("iou") * units).cast("long")).filter("w > 0"))
    number = lambda c: cut(pairs.select("image", c).distinct().withColumn(f"_{c}", F.monotonically_increasing_id() * 2))
    a, b = number("a"), number("b")
    n = a.count() + b.count()
    step = max((pairs.agg(F.max("w")).first()[0] or 0) * (n + 1) // 4, 1)
    known = cut(pairs.join(a, ["image", "a"]).join(b, ["image", "b"]))
    way = lambda df, p, o, w=F.lit(0).cast("long"): df.select(p.alias("p"), o.alias("o"), w.alias("w"))
    p, q = F.col("_a"), F.col("_b")
    ways = cut(way(known, p, q, F.col("w") * (n + 1)).unionAll(way(known, q + 1, p + 1)).unionAll(way(a, p, p + 1)).unionAll(way(b, q + 1, q)))
    blocks = -(-ways.count() // size)
    nobody = F.lit(None).cast("long")
    prices = cut(ways.select("o").distinct().select("o", F.lit(0).cast("long").alias("price"), nobody.alias("owner")))
    bidding = lambda least: lambda table: _bid(table.combine_chunks(), least)
    turn = 0
    while n:
        while True:
            free = cut(ways.select("p").distinct().join(prices.select(F.col("owner").alias("p")), "p", "left_anti"))
            if free.isEmpty():
                break
            turn += 1
            near = _around(ways, free, prices, size) if blocks > 1 else ways
            dealt = ways.withColumn("block", F.pmod(F.xxhash64("p", F.lit(turn)), F.lit(blocks))) if near is None else near.withColumn("block", F.lit(0).cast("long"))
            bids = dealt.join(prices, "o").groupBy("block").applyInArrow(bidding(step), "o long, price long, owner long")
            prices = cut(prices.unionByName(bids).groupBy("o").agg(F.max(F.struct("price", "owner")).alias("s")).select("o", "s.*"))
        if step == 1:
            break
        step, prices = max(step // FALL, 1), prices.withColumn("owner", nobody)
    chosen = prices.select(F.col("owner").alias("_a"), F.col("o").alias("_b")).filter("_a % 2 = 0 and _b % 2 = 0")
    return known.join(chosen, ["_a", "_b"]).select("image", "a", "b", "iou")


def _numbered(table: pa.Table, *columns: str) -> tuple[list[int], int]:
    """The ids of columns that share their ids, one column after the other, as numbers from 0 on, and how many there are."""
    every = pa.concat_arrays([table[c].combine_chunks() for c in columns]).dictionary_encode()
    return every.indices.to_pylist(), len(every.dictionary)


def matched(pairs: DataFrame, *order) -> DataFrame:
    """The pairs (image, a, b, ...) that one-to-one matching takes which goes through them in a strict order."""
    names = [f"_o{k}" for k in range(len(order))]

    def pick(table: pa.Table) -> np.ndarray:
        (a, n), (b, m) = _numbered(table, "a"), _numbered(table, "b")
        free_a, free_b, out = [True] * n, [True] * m, []
        for k in pc.sort_indices(table, sort_keys=[(c, "ascending") for c in names]).to_pylist():
            if free_a[a[k]] and free_b[b[k]]:
                free_a[a[k]] = free_b[b[k]] = False
                out.append(k)
        return np.array(out, np.int64)

    ordered = pairs.withColumns(dict(zip(names, (F.col(o) if isinstance(o, str) else o for o in order))))
    return solved(ordered, pick, lambda rest: matched_in_rounds(rest, *names)).select(*pairs.columns)


def matched_in_rounds(pairs: DataFrame, *order) -> DataFrame:
    """The same: in each round the pairs that come first for both their sides, after which all pairs of these sides go."""
    left = cut(pairs.withColumn("_key", F.struct(*order)))
    columns, out = pairs.columns, None
    while True:
        best = lambda side: left.groupBy("image", side).agg(F.min("_key").alias(f"_best_{side}"))  # noqa: E731, B023
        taken = cut(left.join(best("a"), ["image", "a"]).filter("_key = _best_a").join(best("b"), ["image", "b"]).filter("_key = _best_b").select(*columns))
        if taken.isEmpty():
            return taken if out is None else out
        out = taken if out is None else out.unionAll(taken)
        left = cut(left.join(taken.select("image", "a"), ["image", "a"], "left_anti").join(taken.select("image", "b"), ["image", "b"], "left_anti"))


def first_come_set(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes (image, fiber_id) that stay if they come one after the other and each goes that is paired with one that stays before it.
    pairs: image, a, b with a before b."""

    def pick(table: pa.Table) -> np.ndarray:
        """A pair for each node that goes: its last one with a node that stays."""
        ids, n = _numbered(table, "a", "b")
        a, b = ids[: len(table)], ids[len(table) :]
        after: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        waits, gone_by = [0] * n, [-1] * n
        for k, (p, q) in enumerate(zip(a, b)):
            after[p].append((q, k))
            waits[q] += 1
        ready = [p for p in range(n) if not waits[p]]
        while ready:
            p = ready.pop()
            for q, k in after[p]:
                if gone_by[p] < 0:
                    gone_by[q] = k
                waits[q] -= 1
                if not waits[q]:
                    ready.append(q)
        return np.array([k for k in gone_by if k >= 0], np.int64)

    own = pairs.select("image", "a", "b").distinct()
    gone = solved(own, pick, _gone_in_rounds, sides=False).select("image", F.col("b").alias("fiber_id"))
    return nodes.join(gone, ["image", "fiber_id"], "left_anti")


def _gone_in_rounds(pairs: DataFrame) -> DataFrame:
    """The same pairs' nodes b that go. In each round nodes stay that no open one precedes, and those paired with them behind go."""
    open_, gone = cut(pairs.select("image", "a", "b").distinct()), None
    while not open_.isEmpty():
        later = open_.select("image", F.col("b").alias("a")).distinct()
        stay = open_.select("image", "a").distinct().join(later, ["image", "a"], "left_anti")
        out = cut(open_.join(stay, ["image", "a"], "left_semi"))
        gone = out if gone is None else gone.unionAll(out)
        away = out.select("image", "b").distinct()
        open_ = cut(open_.join(stay, ["image", "a"], "left_anti").join(away, ["image", "b"], "left_anti").join(away.withColumnRenamed("b", "a"), ["image", "a"], "left_anti"))
    return gone
