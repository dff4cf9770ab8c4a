"""Document fingerprints: Merkle trees over sections, paragraphs and short runs.

A text falls into sections (behind blank lines), these into paragraphs (lines), these into leaves: runs that end at a space, or where there is
none at a letter of a few, so cuts follow the text and not the position; only the first characters of a text are cut more finely, so that
short texts have several leaves too. All parts together are the text. A node's digest is the hash of its children's, up to the root, so roots
test equality. A fingerprint holds the root, then each section's and paragraph's digest and the leaves with their lengths, all but the root
cut short; it gives the whole tree back.

Likeness goes down the differing branches: nodes of one level with equal digests count with all their characters, the children of the
others are compared on the next level. `edits` locates changes alike: it passes over equal branches and goes down the differing ones.

Defined cases: a null text is an empty one, whose tree has no leaf; two empty fingerprints have likeness 1; documents follow each other by
descending doc_id, null last, and by the text's hash where ids repeat; a single document is its own next; an empty table gives no rows;
further columns are ignored, whatever their names. Very long texts are read whole; a line of any length has leaves of bounded length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import bound_arrow

#: Leaves of two characters before FINE, of at least 6 before MIDDLE, of at least 24 behind: there the first word end after some letters,
#: about one in four, counts, so that the cuts of shifted texts soon meet again.
FINE, MIDDLE = 32, 256
_SHORT = re.compile(r"(?s).{6,16}? |.{6,16}?[aeiou0-4/+]|.{1,16}")
_LONG = re.compile(r"(?s).{24,80}?[aeimquy159] |.{24,80}? |.{24,80}?[aeiou0-4/+]|.{1,80}")
#: Hexadecimal digits of the root, of sections and paragraphs, of a leaf's hash and length.
ROOT, INNER, LEAF, SIZE = 32, 8, 6, 2
#: Documents of a range in which neighbours are found, about, and ranges (what the driver knows of the table is one key for each).
RANGE, RANGES = 5000, 100_000

#: A node: digest as the fingerprint holds it, characters, children.
Node = tuple[str, int, list]


def _runs(paragraph: str, at: int) -> list[str]:
    """The leaves of a paragraph that starts at character `at` of its text."""
    out, i = [], 0
    if at < FINE:
        out = [paragraph[k : k + 2] for k in range(0, min(len(paragraph), FINE - at), 2)]
        i = 2 * len(out)
    if at + i < MIDDLE:
        out += _SHORT.findall(paragraph[i : MIDDLE - at])
        i = max(i, MIDDLE - at)
    return out + _LONG.findall(paragraph, i) if i < len(paragraph) else out


def _parts(text: str, mark: str) -> list[str]:
    """text cut behind each mark."""
    parts = text.split(mark)
    return [p + mark for p in parts[:-1]] + parts[-1:] * (parts[-1] != "")


def tree(text: str | None) -> Node:
    at, sections, above = 0, [], b""
    for section in _parts(text or "", "\n\n"):
        paragraphs, below = [], b""
        lines = _parts(section, "\n")
        if len(lines) > 1 and lines[-1] == "\n":  # the blank line goes with the line before it
            lines[-2:] = [lines[-2] + "\n"]
        for line in lines:
            leaves, digests = [], []
            for k, run in enumerate(_runs(line, at)):
                digest = xxh3_128_digest(run.encode(), at + 2 * k + 1 if at + 2 * k < FINE else 0)
                digests.append(digest)
                leaves.append((f"{digest.hex()[:LEAF]}{len(run):0{SIZE}x}", len(run), ()))
            own = xxh3_128_digest(b"".join(digests), 1)
            paragraphs.append((own.hex()[:INNER], len(line), leaves))
            below += own
            at += len(line)
        own = xxh3_128_digest(below, 2)
        sections.append((own.hex()[:INNER], len(section), paragraphs))
        above += own
    return hashlib.blake2b(above, digest_size=ROOT // 2).hexdigest(), at, sections


def written(root: Node) -> str:
    """The fingerprint of a tree."""
    return root[0] + "".join("/" + s[0] + "".join("." + p[0] + "".join([x[0] for x in p[2]]) for p in s[2]) for s in root[2])


def read(fingerprint: str) -> Node:
    """The tree of a fingerprint."""
    sections = []
    for section in fingerprint.split("/")[1:]:
        key, *lines = section.split(".")
        paragraphs = []
        for line in lines:
            leaves = [(line[i : i + LEAF + SIZE], int(line[i + LEAF : i + LEAF + SIZE], 16), ()) for i in range(INNER, len(line), LEAF + SIZE)]
            paragraphs.append((line[:INNER], sum(x[1] for x in leaves), leaves))
        sections.append((key, sum(p[1] for p in paragraphs), paragraphs))
    return fingerprint[:ROOT], sum(s[1] for s in sections), sections


def fingerprint(text: str | None) -> str:
    return written(tree(text))


def likeness(a: Node, b: Node) -> float:
    """Characters below equal branches, as a share of all of both."""
    if a[0] == b[0]:
        return 1.0
    same, xs, ys = 0, a[2], b[2]
    while xs and ys:
        left: dict[str, int] = {}
        for x in xs:
            left[x[0]] = left.get(x[0], 0) + 1
        open_y = []
        for y in ys:
            if left.get(y[0]):
                left[y[0]] -= 1
                same += y[1]
            else:
                open_y.append(y)
        open_x = []
        for x in xs:
            if left[x[0]]:
                left[x[0]] -= 1
                open_x.append(x)
        xs, ys = ([child for node in nodes for child in node[2]] for nodes in (open_x, open_y))
    return 2 * same / (a[1] + b[1])


def edits(a: Node, b: Node, at: int = 0) -> list[tuple[int, int]]:
    """Character ranges of b's text that differ from a's: equal branches are passed over; children are matched from both ends."""
    if a[0] == b[0]:
        return []
    x, y = a[2], b[2]
    if not x or not y:
        return [(at, at + b[1])]
    least = min(len(x), len(y))
    head = next((i for i in range(least) if x[i][0] != y[i][0]), least)
    tail = next((i for i in range(least - head) if x[-1 - i][0] != y[-1 - i][0]), least - head)
    at += sum(n[1] for n in y[:head])
    mine, theirs = y[head : len(y) - tail], x[head : len(x) - tail]
    if len(mine) != len(theirs):
        return [(at, at + sum(n[1] for n in mine))]
    out: list[tuple[int, int]] = []
    for p, q in zip(theirs, mine):
        for lo, hi in edits(p, q, at):
            if out and out[-1][1] == lo:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        at += q[1]
    return out


def edited(text: str, following: str) -> str:
    """text with its last third (rounded down) replaced by as many first characters of the next document, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, and the tree's root alone, for every row of docs."""
    bound_arrow(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.string()), pa.array([x[:ROOT] for x in fps], pa.string())], names=["doc_id", "fingerprint", "root"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string, root string")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<array<long>>"


def compare_with_next(docs: DataFrame, per_range: int = RANGE) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document; edits are the ranges of the edited text that
    differ. Documents go to ranges of (doc_id, hash of the text); each range gets the first document of the one that follows as well, so
    neighbours meet without any window over the whole table."""
    spark = docs.sparkSession
    bound_arrow(spark, 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # In the order wanted: nulls last, then by descending id.
    rows = rows.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), F.xxhash64("text").alias("hash"))
    key = ["none", "down", "hash"]
    step = max(per_range, -(-rows.count() // RANGES))

    def first_of_each(batches):
        n = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange(-n % step, batch.num_rows, step)))
            n += batch.num_rows

    firsts = rows.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(first_of_each, "none int, down long, hash long").toPandas()
    firsts = firsts.drop_duplicates().sort_values(key, ignore_index=True)
    n_ranges = len(firsts)
    if not n_ranges:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast([firsts[k].to_numpy() for k in key])

    @F.pandas_udf("array<int>")
    def ranges_of(none: pd.Series, down: pd.Series, hash: pd.Series) -> pd.Series:
        """The range of a key; and of its first key, also the range before, in which it is a guest (-1 - range)."""
        bounds, own = shared.value, [none.to_numpy(), down.to_numpy(), hash.to_numpy()]
        both = [np.concatenate([b, x]) for b, x in zip(bounds, own)]
        is_bound = np.arange(len(both[0])) < n_ranges
        order = np.lexsort((~is_bound, *both[::-1]))  # of equal keys the bound comes first
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(is_bound[order]) - 1
        place = place[n_ranges:]
        first = np.logical_and.reduce([b[place] == x for b, x in zip(bounds, own)])
        return pd.Series([[p, -1 - (p - 1) % n_ranges] if f else [p] for p, f in zip(place.tolist(), first.tolist())])

    dealt = rows.withColumn("range", F.explode(ranges_of(*key)))
    dealt = dealt.select("doc_id", "text", *key, F.greatest("range", -1 - F.col("range")).alias("range"), (F.col("range") < 0).cast("int").alias("guest"))
    dealt = dealt.repartitionById(n_ranges, "range").sortWithinPartitions("range", "guest", *key).select("doc_id", "text", "range", "guest")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        last = None  # range, id, text, tree
        for batch in batches:
            out = []
            for doc_id, text, number, guest in zip(*(c.to_pylist() for c in batch.columns)):
                own = tree(text)
                if last is not None and last[0] == number:
                    _, id_, before, root = last
                    changed = edited(before, text)
                    other = tree(changed)
                    out.append((id_, len(before), hashlib.sha256(changed.encode()).hexdigest(), written(root), written(other), likeness(root, other), likeness(root, own), edits(root, other)))
                last = None if guest else (number, doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return dealt.mapInArrow(run, RESULT)
