"""SimHash near-duplicates.

Fingerprints: A-Z lower-cased, words split at ASCII white space, 3-word shingles with repeats, XXH64 (seed 42); a bit is set if it is set
in over half the hashes. Links join fingerprints at `radius` or fewer differing bits, found by tiled exact comparison: distinct
fingerprints fall into cells by the population counts of their two halves, cells are split into tiles of a bounded size, and tile pairs
whose counts differ by more than the radius are skipped (the distance is at least the difference of the counts). Each remaining pair of
tiles is compared in full by numpy exclusive-or and bit counts, and yields a spanning forest of its links, so groups of copies don't
emit all their pairs. Components follow by alternating large-star and small-star rounds.

Defined cases: null and empty texts have fingerprint zero, linked like any other; repeated rows share their component; a component's id
is its smallest non-null doc_id (null if it has none); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, bound_arrow, free_name, materialise
from .rolling import Hashes, mixed

#: Fingerprints in a tile.
TILE = 2048
#: Shingles that the order of prefixes puts last, at most.
COMMON = 200_000
#: Bits of the sketch of a shingle set; sets in a block of those that share a shingle; sets of a shingle and size that meet without sketches.
SKETCH, BLOCK, FEW = 512, 256, 32


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_per_shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -words_per_shingle])).tolist()
    stops = (ends[words_per_shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), "<u8", len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), words_per_shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index for each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at `radius` or fewer differing bits."""
    found = []
    for at in range(0, len(left), 128):
        near = np.bitwise_count(left[at : at + 128, None] ^ right[None, :]) <= radius
        i, j = np.nonzero(near)
        if len(i):
            found.append((i + at, j))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])) if found else (np.zeros(0, int), np.zeros(0, int))


def links(nodes: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """nodes: distinct fp. Links (a, b) of fingerprints that connect what all pairs within the radius connect."""
    spark = nodes.sparkSession
    tall = nodes.withColumns({"hi": F.bit_count(F.shiftrightunsigned("fp", 32)), "lo": F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))})
    counts = {(r.hi, r.lo): -(-r.n // tile) for r in tall.groupBy("hi", "lo").agg(F.count("*").alias("n")).collect()}  # at most 33 * 33 cells
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    parts = F.create_map(*[F.lit(x) for (hi, lo), n in counts.items() for x in (hi * 64 + lo, n)])
    cell = F.col("hi") * 64 + F.col("lo")
    tiles = tall.select("fp", cell.alias("cell"), F.pmod(F.xxhash64("fp"), parts[cell]).cast("long").alias("part")).groupBy("cell", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    near = F.array(*[F.lit(h * 64 + low) for h in range(-radius, radius + 1) for low in range(-radius, radius + 1) if abs(h) + abs(low) <= radius and h * 64 + low >= 0])
    pairs = tiles.select("cell", "part", F.col("fps").alias("left"), F.explode(F.transform(near, lambda d: F.col("cell") + d)).alias("other"))
    pairs = pairs.select("cell", "part", "left", "other", F.explode(F.when(parts[F.col("other")].isNotNull(), F.sequence(F.lit(0).cast("long"), parts[F.col("other")].cast("long") - 1))).alias("other_part"))
    pairs = pairs.filter((F.col("other") > F.col("cell")) | (F.col("other_part") >= F.col("part")))
    right = tiles.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("fps").alias("right"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                left, right = (v.values.to_numpy() for v in (x, y))
                i, j = tile_links(left.view(np.uint64), right.view(np.uint64), radius)
                both = np.concatenate([left, right])
                root = forest(i, j + len(left), len(both)) if (left[i] != right[j]).any() else np.arange(len(both))
                keep = both != both[root]
                yield pa.RecordBatch.from_arrays([pa.array(both[keep]), pa.array(both[root][keep])], schema=schema)

    with arrow_rows(spark, 64):
        joined = pairs.join(right, ["other", "other_part"]).select("left", "right")
        return materialise(joined.mapInArrow(compare, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with root the smallest node reachable, for the nodes of the links (a, b) other than the roots. Alternates large-star and small-star rounds,
    each written to the shared folder, until the stars no longer change."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    with Scratch(edges.sparkSession, "stars") as scratch:
        edges, state = scratch.write(edges), None
        while True:
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.filter("m < a").select("a", F.col("m").alias("b")))
            large = scratch.write(large.filter("a <> b").distinct())
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(low.select("a", F.col("m").alias("b")))
            new = scratch.write(small.distinct())
            now = tuple(new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.expr("sum(cast(a as decimal(38,0)) - b)")).first())
            if now == state:
                return materialise(new.select(F.col("a").alias("node"), F.col("b").alias("root")), "components")
            scratch.drop(edges, large)
            edges, state = new, now


def near_duplicates(docs: DataFrame, radius: int = 3, words_per_shingle: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    with Scratch(docs.sparkSession, "simhash") as scratch:
        bound_arrow(docs.sparkSession)
        fps = scratch.write(fingerprints(docs, words_per_shingle))
        nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
        groups = components(links(nodes.select("fp"), radius))
        # Components of fingerprints first; then the smallest document of each.
        member = nodes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
        first = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
        member = member.join(first, "root").select("fp", "component_id")
        return materialise(fps.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "near")


def shingle_set(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: one for a shorter text, none for an empty one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    last = min(words_per_shingle, len(words))
    starts, stops = np.concatenate(([0], ends))[: len(words) - last + 1], ends[last - 1 :] - 1
    joined = np.frombuffer(b" ".join(words), np.uint8)
    return np.unique(mixed(Hashes(joined).window(starts, stops)).view(np.int64), sorted=True)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(rows: DataFrame, words_per_shingle: int) -> DataFrame:
    """key (a long) and text to key and items, the text's shingle set."""
    schema = pa.schema([("key", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(x.as_py(), words_per_shingle) for x in batch.column(1)]).cast(schema.field(1).type)], schema=schema)

    return rows.mapInArrow(run, "key long, items array<long>")


def sketch(items: np.ndarray) -> bytes:
    """SKETCH bits: each is 1 if an odd number of the set's hashes falls on it. Two sets differ in at least as many hashes as their sketches
    do in bits, as a hash of both changes both sketches alike."""
    odd = np.bincount(items.view(np.uint64) % np.uint64(SKETCH), minlength=SKETCH) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _prefixes(rows: DataFrame, at_least: float, words_per_shingle: int, common: list[int]) -> DataFrame:
    """doc_id, digest and text to doc_id, digest, cls (equal for equal sets), n, fp (the SimHash of the set), the sketch and prefix: the first
    shingles of the set, rare ones before those of `common` (rarest first). Sets of a Jaccard index of at_least share a shingle of their
    prefixes, whatever the order is. Of equal sets that a task meets only the first has a prefix, the others' are empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("cls", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("sketch", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    hot = np.array(common, np.int64)
    by_hash = np.argsort(hot)
    hashes = hot[by_hash]

    def run(batches):
        seen = set()
        for batch in batches:
            cls, n, fps, marks, prefix = [], [], [], [], []
            for x in batch.column(2):
                items = shingle_set(x.as_py(), words_per_shingle)
                cls.append(xxhash.xxh64_intdigest(items.tobytes()))
                n.append(len(items))
                fps.append(majority(items))
                marks.append(sketch(items))
                if cls[-1] in seen:
                    prefix.append(items[:0])
                    continue
                seen.add(cls[-1])
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, items), len(hashes) - 1)
                    items = items[np.argsort(np.where(hashes[at] == items, by_hash[at] + 1, 0), kind="stable")]
                prefix.append(items[: len(items) - int(np.ceil(at_least * len(items) - 1e-9)) + 1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(marks, pa.binary()), _lists(prefix).cast(schema.field(6).type)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, digest long, cls long, n long, fp long, sketch binary, prefix array<long>")


def _by_fingerprint(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """classes: cls and fp. Pairs (a, b) that the SimHash links propose: the least sets of two linked fingerprints, and each set with the least one
    of its own fingerprint."""
    nodes = scratch.write(classes.groupBy("fp").agg(F.min("cls").alias("least")))
    side = lambda name: nodes.select(F.col("fp").alias(name), F.col("least").alias(f"of_{name}"))
    linked = links(nodes.select("fp"), radius).join(side("a"), "a").join(side("b"), "b").select("of_a", "of_b")
    equal = classes.join(nodes, "fp").filter("cls <> least").select("cls", "least")
    return scratch.write(linked.unionAll(equal).toDF("p", "q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())


def _fits(p: str, q: str, at_least: float) -> Column:
    """Of two sets that first meet in a shingle, no more than the rests of both can be common."""
    n, m, i, j = (F.col(f"{side}.{x}") for x in ("n", "pos") for side in (p, q))
    return (F.least(n - i, m - j) >= at_least / (1 + at_least) * (n + m) - 1e-6) & (F.col(f"{p}.cls") != F.col(f"{q}.cls"))


def _near_in_blocks(left: DataFrame, sketches: DataFrame, at_least: float, scratch: Scratch) -> DataFrame:
    """left: item, own (cls, n, pos) and root. Pairs (a, b) of sets with different roots that share an item and that neither their sizes,
    their places in the prefixes nor their sketches (by cls) rule out.

    The sets of an item fall into classes of size, as sets whose sizes differ by more than at_least can't be alike. Sets of one class, or of two
    that follow each other, meet. Where both have at most FEW sets, each set meets few others and all these pairs become rows. Else the
    classes are cut into blocks that meet whole and are compared in numpy, so only pairs that the sketches leave become rows; keys of
    blocks are paired first, and the blocks' sets follow by joins."""
    rows = left.withColumn("size", F.floor(F.log("own.n") / -F.log(F.lit(at_least)) + 1e-9) if at_least < 1 else F.col("own.n").cast("long"))
    cells = scratch.write(rows.groupBy("item", "size").agg(F.count("*").alias("sets"), F.min("root").alias("low"), F.max("root").alias("high")))
    below = cells.select("item", (F.col("size") + 1).alias("size"), F.col("sets").alias("o_sets"), F.col("low").alias("o_low"), F.col("high").alias("o_high"))
    met = cells.filter("low < high").select("item", "size", "sets", F.col("size").alias("o_size"), F.col("sets").alias("o_sets"))
    met = met.unionAll(cells.join(below, ["item", "size"]).filter("least(low, o_low) < greatest(high, o_high)").select("item", "size", "sets", (F.col("size") - 1).alias("o_size"), "o_sets"))
    met = scratch.write(met)
    few = met.filter(F.greatest("sets", "o_sets") <= FEW).select("item", "size", "o_size")
    other = rows.select("item", F.col("size").alias("o_size"), F.col("own").alias("other"), F.col("root").alias("o_root"))
    plain = rows.join(few, ["item", "size"]).join(other, ["item", "o_size"]).filter("root <> o_root").filter(_fits("own", "other", at_least))
    plain = plain.select(F.least("own.cls", "other.cls").alias("a"), F.greatest("own.cls", "other.cls").alias("b"))

    last = lambda sets: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(sets) / BLOCK) - 1)
    met = met.filter(F.greatest("sets", "o_sets") > FEW).select("item", "size", "o_size", "o_sets", F.explode(last("sets")).alias("block"))
    met = met.select("item", "size", "block", "o_size", F.explode(last("o_sets")).alias("o_block"))
    met = scratch.write(met.filter("o_size < size or o_block >= block"))
    used = met.select("item", "size").unionAll(met.select("item", F.col("o_size").alias("size"))).distinct()
    dealt = rows.join(cells.select("item", "size", F.ceil(F.col("sets") / BLOCK).alias("blocks")).join(used, ["item", "size"], "left_semi"), ["item", "size"])
    dealt = dealt.select("item", "size", F.pmod(F.xxhash64("own.cls"), F.col("blocks")).alias("block"), "own.cls", "own.n", "own.pos", "root").join(sketches, "cls")
    blocks = scratch.write(dealt.groupBy("item", "size", "block").agg(F.collect_list(F.struct("cls", "n", "pos", "root", "sketch")).alias("sets")))
    other = blocks.select("item", F.col("size").alias("o_size"), F.col("block").alias("o_block"), F.col("sets").alias("o_sets"))
    both = met.join(blocks, ["item", "size", "block"]).join(other, ["item", "o_size", "o_block"]).select("sets", "o_sets")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    common, apart = at_least / (1 + at_least), (1 - at_least) / (1 + at_least)

    def side(column: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
        ends = np.cumsum(pc.list_value_length(column).to_numpy(), dtype=np.int64)
        *numbers, marks = column.flatten().flatten()
        return ends, [*(x.to_numpy() for x in numbers), np.frombuffer(b"".join(marks.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)]

    def compare(batches):
        for batch in batches:
            (ends, x), (o_ends, y) = side(batch.column(0)), side(batch.column(1))
            found = [np.zeros((2, 0), np.int64)]
            for start, stop, o_start, o_stop in zip(np.append(0, ends[:-1]), ends, np.append(0, o_ends[:-1]), o_ends):
                cls, n, pos, root = (v[start:stop, None] for v in x[:4])
                o_cls, o_n, o_pos, o_root = (v[None, o_start:o_stop] for v in y[:4])
                i, j = np.nonzero((cls != o_cls) & (root != o_root) & (np.minimum(n - pos, o_n - o_pos) >= common * (n + o_n) - 1e-6))
                i, j = i + start, j + o_start
                bits = np.bitwise_count(x[4][i] ^ y[4][j]).sum(1, dtype=np.int64)
                keep = bits <= apart * (x[1][i] + y[1][j]) + 1e-6
                pair = np.stack([x[0][i[keep]], y[0][j[keep]]])
                found.append(np.sort(pair, axis=0))
            a, b = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    return plain.unionAll(both.mapInArrow(compare, "a long, b long")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard index of at_least."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= at_least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))

    side = lambda key, items: sets.select(F.col("key").alias(key), F.col("items").alias(items))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_classes(docs: DataFrame, at_least: float = 0.8, words_per_shingle: int = 5, radius: int = 3) -> DataFrame:
    """doc_id, digest (of the text) and root for each row: rows share a root if a chain of texts joins them whose shingle sets have, each
    with the next, a Jaccard index of at_least (above 0). SimHash first: fingerprints of the sets are linked at `radius` bits, as in
    near_duplicates, and links are confirmed on the whole sets. Fingerprints of sets that are only just alike differ in more bits than tiles can
    tell apart, so an exact search follows for what SimHash hasn't joined: candidates share a shingle of their prefixes, all are confirmed, and
    only pairs that are joined already are passed over. Three rounds: each set with the least and the greatest one that
    it shares a shingle with; in shingles whose sets aren't joined yet, all with those of the least and the greatest root; then what is
    left, in blocks, where sketches rule out most pairs before any becomes a row. So a large group of near copies is joined by few pairs.
    Texts without words are alike."""
    spark = docs.sparkSession
    bound_arrow(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")

    def fits(p: str, q: str) -> Column:
        return _fits(p, q, at_least)

    def pairs(df: DataFrame, p: str, q: str) -> DataFrame:
        return df.filter(fits(p, q)).select(F.least(f"{p}.cls", f"{q}.cls").alias("a"), F.greatest(f"{p}.cls", f"{q}.cls").alias("b"))

    with Scratch(spark, "near") as scratch:
        # Any one order is right; this one, from a sixteenth of the texts, keeps passages of many texts out of the prefixes.
        seen = _sets(rows.filter(F.pmod("digest", F.lit(16)) == 0).dropDuplicates(["digest"]).select(F.col("digest").alias("key"), "text"), words_per_shingle)
        seen = seen.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c")).filter("c > 1")
        common = [r.item for r in reversed(seen.orderBy(F.desc("c"), "item").limit(COMMON).select("item").collect())]
        marked = scratch.write(_prefixes(rows, at_least, words_per_shingle, common))
        of_class = scratch.write(marked.groupBy("cls").agg(F.min("digest").alias("digest"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch")))
        sets = links_ = None

        def confirm(found: DataFrame) -> None:
            """Adds the links among the pairs that are found."""
            nonlocal sets, links_
            needed = found.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
            if sets is not None:
                needed = needed.join(sets.select(F.col("key").alias("cls")), "cls", "left_anti")
            needed = scratch.write(of_class.select("cls", "digest").join(needed, "cls"))
            if not needed.isEmpty():
                texts = rows.select("digest", "text").join(needed, "digest").dropDuplicates(["digest", "cls"])
                new = scratch.write(_sets(texts.select(F.col("cls").alias("key"), "text"), words_per_shingle))
                sets = new if sets is None else sets.unionAll(new)
            if sets is not None:
                new = scratch.write(_confirmed(found, sets, at_least))
                links_ = new if links_ is None else links_.unionAll(new)

        def joined(found: DataFrame) -> DataFrame:
            """Confirms the pairs that are found; the roots by all links so far."""
            confirm(found)
            return components(links_ if links_ is not None else found)

        def rooted(df: DataFrame, roots: DataFrame) -> DataFrame:
            """item, own and root of the shingles whose sets have several roots."""
            out = scratch.write(df.select("item", "own").join(roots, F.col("own.cls") == F.col("node"), "left").select("item", "own", F.coalesce("root", "own.cls").alias("root")))
            split = out.groupBy("item").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("item")
            return out.join(split, "item", "left_semi")

        hashed = _by_fingerprint(of_class.select("cls", "fp"), radius, scratch)
        confirm(hashed)
        # The sets of a shingle are shuffled once: both sides of the join read whole rows, so they share the exchange.
        own = marked.select("cls", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "item"))
        own = own.select("item", F.struct("cls", "n", "pos").alias("own")).repartition("item")
        several = own.groupBy("item").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("item")
        own = scratch.write(own.distinct().join(several, "item", "left_semi"))
        ends = own.groupBy("item").agg(F.min("own").alias("low"), F.max("own").alias("high"))
        met = own.join(ends, "item").groupBy("own.cls").agg(F.min(F.when(fits("own", "low"), F.col("low.cls"))).alias("low"), F.max(F.when(fits("own", "high"), F.col("high.cls"))).alias("high"))
        met = met.select("cls", F.explode(F.array("low", "high")).alias("other")).filter("other is not null")
        met = met.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct()
        roots = joined(scratch.write(met.join(hashed, ["a", "b"], "left_anti")))
        left = scratch.write(rooted(own, roots))
        scratch.drop(own)
        both = left.select("item", "own", "root", F.struct("root", "own").alias("one"))
        both = both.join(both.groupBy("item").agg(F.min("one").alias("low"), F.max("one").alias("high")), "item")
        both = both.select("own", "root", F.explode(F.array("low", "high")).alias("other")).filter("root <> other.root").select("own", F.col("other.own").alias("other"))
        stars = scratch.write(pairs(both, "own", "other").distinct())
        if not stars.isEmpty():
            roots = joined(stars)
            left = rooted(left, roots)
        rest = _near_in_blocks(left, of_class.select("cls", "sketch"), at_least, scratch)
        rest = scratch.write(rest.join(stars, ["a", "b"], "left_anti"))
        if not rest.isEmpty():
            roots = joined(rest)
        return materialise(marked.select("doc_id", "digest", "cls").join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", "digest", F.coalesce("root", "cls").alias("root")), "classes")


def keep_one(docs: DataFrame, at_least: float = 0.8, words_per_shingle: int = 5, radius: int = 3) -> DataFrame:
    """One row (all columns) of each group of near copies, by similar_classes (SimHash links, confirmed, then an exact search for the rest): the one with the least doc_id (rows without one come last),
    then the least text digest. A null or empty text counts as one without words, and all of these are one group; of rows equal in doc_id
    and text one stays; an empty table gives no rows; columns of any name are carried."""
    found = similar_classes(docs, at_least, words_per_shingle, radius)
    key_id, key_digest = (free_name(docs.columns, c) for c in ("key_id", "key_digest"))
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("k"))
    least = least.select(F.col("k.doc_id").alias(key_id), F.col("k.digest").alias(key_digest))
    counts = found.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col(key_id)) & (F.col("digest") == F.col(key_digest))
    kept = materialise(least.join(counts, same).select(key_id, key_digest, "n"), "kept")
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key_id)) & (F.xxhash64("text") == F.col(key_digest))
    once = docs.join(kept.filter("n = 1").drop("n"), same, "left_semi")
    repeated = docs.join(kept.filter("n > 1").drop("n"), same).select(key_id, key_digest, F.struct(*own).alias("row"))
    repeated = repeated.groupBy(key_id, key_digest).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return once.unionAll(repeated)
