"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: bulk-synchronous best-fit. Pieces are range-sorted by length (longest first) and numbered within their length;
gaps are kept sorted by size. In each round all unplaced pieces of the next length look up their successor, the smallest
gap that holds them; conflicts for one gap size are resolved by rank (the i-th piece goes to the i-th gap), the gaps shrink,
and the round repeats until no piece is left. Pieces of one length, and gaps of one size, are interchangeable, so a round
works on counts and rank intervals: the sweep's state has at most `capacity` sizes whatever the number of documents, and the
placement of every row follows from its (length, rank) on the executors. An interval of gaps is split at most once for each length and
shrinks at most `capacity` times, so the number of runs is bounded by the capacity alone.

Defined cases: a null text is an empty one and gives one piece that holds only the closing id; a null or repeated doc_id is
carried as it is, every row is packed once and `row_id` tells rows apart; very long texts are cut into pieces like any other; an empty
table gives no rows; further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import deque
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import Scratch, bound_arrow, materialise

#: Distinct runs whose ids one Python worker remembers.
RUNS_KEPT = 1_000_000
#: Bytes with A-Z in lower case, and tabs and line ends as spaces.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[9, 10]] = 32
#: Kinds of bytes: 0 space, 1 letters, digits and what is beyond ASCII, 2 others; and those that leave their word whole.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(48, 58), *range(97, 123), *range(128, 256)]] = 1
_KIND[32] = 0
_WHOLE = np.zeros(256, bool)
_WHOLE[[39, *range(28, 32), 0xC2, *range(0xC6, 256)]] = True

#: Texts on which runs and whole texts must give the same ids for a tokenizer to be used by runs.
_PROBES = ("", "Two Words", " a  b\n\nC\t", "It's x1's 12ab-3, (end).", "ÉTÉ été x", "na\u00efve Stra\u00dfe 10\u00d72", "日本語 text", "a\u200bb \u0130x", "<|end|> <pad>", "I'LL don't", "tab\tsep  double\r\nline")

PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"


def run_starts(raw: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the runs of the texts' bytes (as _PLAIN gives them) start; spaces go with the run before them."""
    kind = _KIND[raw]
    run, word = np.empty(len(raw), bool), np.empty(len(raw), bool)
    word[1:] = (kind[1:] != 0) & (kind[:-1] == 0)
    run[1:] = (kind[1:] != 0) & (kind[1:] != kind[:-1])
    run[text_starts] = word[text_starts] = True
    whole = _WHOLE[raw]
    for first, second in ((b"<", b"|"), (b"\xc3", b"\x97"), (b"\xc3", b"\xb7"), (b"\xc4", b"\xb0")):  # special tokens; signs and a capital I among letters
        whole[:-1] |= (raw[:-1] == first[0]) & (raw[1:] == second[0])
    if whole.any():
        at = np.flatnonzero(word)
        kept = np.logical_or.reduceat(whole, at)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[at[kept] + 1] += 1
        inside[np.append(at[1:], len(raw))[kept]] -= 1
        run &= (np.cumsum(inside[:-1], dtype=np.int8) == 0) | word
    return np.flatnonzero(run)


class RunIds(dict):
    """Run of characters -> its ids as unsigned 32-bit bytes, as the tokenizer gives them.

    The pre-tokenizer never joins text across white space, nor letters and digits with other characters (contractions, which start at an
    apostrophe, aside), and it lower-cases. So the ids of a text are those of its runs in order: of letters and digits, and of other
    characters; words (between spaces, tabs and line ends) with an apostrophe, or with characters beyond ASCII other than Latin letters,
    are runs of their own. A tokenizer that works otherwise, as probes show, codes whole texts instead."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), False
        probes = pa.array([*_PROBES, " ".join(_PROBES)])
        by_runs, by_texts = self.ids(probes, 0), self._of_texts(probes, 0)
        self.whole = not all(np.array_equal(a, b) for a, b in zip(by_runs, by_texts))

    def _of_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array([*x.ids, end_id], "<u4") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *found]), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def look_up(self, runs: list[str]) -> list[bytes]:
        new = [r for r in runs if r not in self]
        if len(self) + len(new) > RUNS_KEPT:
            self.clear()
            new = runs
        for run, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self[run] = array("I", found.ids).tobytes()
        return [self[r] for r in runs]

    def ids(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, each followed by end_id, and where each text's ids stop."""
        if self.whole:
            return self._of_texts(texts, end_id)
        texts = texts.cast(pa.string())  # 32-bit offsets, whatever the session's Arrow strings have
        edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        raw = _PLAIN[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]]
        edges -= edges[0]
        starts = run_starts(raw, edges[:-1][np.diff(edges) > 0]) if len(raw) else np.zeros(0, np.int64)
        offsets = np.append(starts, len(raw)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        found = self.look_up([r.rstrip(" ") for r in coded.dictionary.to_pylist()]) + [np.uint32(end_id).tobytes()]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        behind = np.searchsorted(starts, edges[1:])  # the end of each text stands behind its runs
        which = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), behind, len(found) - 1)
        n = size[which]
        stops = np.cumsum(n)
        ids = flat[np.repeat(begin[which] - (stops - n), n) + np.arange(stops[-1] if len(stops) else 0)]
        return ids, stops[behind + np.arange(len(behind))]


@cache
def run_ids(path: str) -> RunIds:
    """One per Python worker, which Spark uses again for later tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return RunIds(path)


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """One row per piece: row_id (one for each row of docs), doc_id, piece, start, length, ids_crc32 (and ids, if kept). Each document's
    ids end with end_id; only documents beyond the capacity are cut, into full pieces and a last shorter one."""

    def cut(batches):
        runs = run_ids(tokenizer_path)
        for batch in batches:
            texts = batch.column(2).fill_null("")
            ids, stops = runs.ids(texts, end_id)
            sizes = np.diff(stops, prepend=0)
            pieces = -(-sizes // capacity)
            own = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[own] - start)
            at = (stops - sizes)[own] + start
            view = memoryview(np.ascontiguousarray(ids)).cast("B")
            crc = np.fromiter((zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(at))
            take = pa.array(own)
            columns = [batch.column(0).take(take), batch.column(1).take(take), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if keep_ids:  # pieces lie one after the other
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    bound_arrow(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids array<int>" * keep_ids)


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rounds of the sweep, one length after another from the longest. counts: pieces by length. Rows of the result: length, first
    rank, bins, pieces per bin, first bin, offset in the bin; rank r of the length lies in the run with the largest first rank <= r."""
    gaps: dict[int, deque] = {}
    sizes: list[int] = []
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def add(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                gaps[size] = deque()
                insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)  # the successor among the gap sizes
            if at == len(sizes):
                each = capacity // length
                n = -(-left // each)
                add(capacity, bins, n)
                bins += n
                continue
            size = sizes[at]
            first, n = gaps[size].popleft()
            each = min(size // length, left)
            used = min(n, left // each)
            if used < n:
                gaps[size].appendleft((first + used, n - used))
            elif not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            runs.append((length, rank, used, each, first, capacity - size))
            rank += used * each
            left -= used * each
            add(size - each * length, first, used)
    return np.asarray(runs, dtype=np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces (with length between 1 and capacity, row_id, doc_id, piece and any further columns)."""
    spark, columns = pieces.sparkSession, pieces.columns
    ordered = pieces.repartitionByRange(F.desc("length"), F.col("row_id"), F.col("piece")).sortWithinPartitions(F.desc("length"), "row_id", "piece")
    at = columns.index("length")

    def number(batches):
        task, last, seen = TaskContext.get().partitionId(), None, 0  # rows of one length are neighbours
        for batch in batches:
            length = batch.column(at).to_numpy()
            if len(length):
                first = np.flatnonzero(np.concatenate(([True], length[1:] != length[:-1])))
                pos = np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
                if length[0] == last:
                    pos[: first[1] if len(first) > 1 else len(pos)] += seen
                last, seen = length[-1], int(pos[-1]) + 1
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(pos), task, np.int32)), pa.array(pos.astype(np.int64))], names=[*columns, "_task", "_pos"])

    fields = list(pieces.schema.fields)
    with Scratch(spark, "pack") as scratch:
        ranked = scratch.write(ordered.mapInArrow(number, StructType([*fields, StructField("_task", IntegerType()), StructField("_pos", LongType())])))
        # By task and length; ranges keep a length together, so there are at most tasks + capacity rows.
        table = ranked.groupBy("_task", "length").agg(F.count("*").alias("n")).orderBy(F.desc("length"), "_task").toPandas()
        before = table.groupby("length")["n"].cumsum() - table["n"]
        runs = plan_runs({int(k): int(v) for k, v in table.groupby("length")["n"].sum().items()}, capacity)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        starts = np.stack([table["_task"].to_numpy(np.int64) * (capacity + 1) + table["length"].to_numpy(np.int64), before.to_numpy(np.int64)])
        shared = spark.sparkContext.broadcast((runs, starts[:, np.argsort(starts[0])]))

        def place(batches):
            runs, starts = shared.value
            keys = (runs[:, 0] << 44) + runs[:, 1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                length, task, pos = (batch.column(k).to_numpy().astype(np.int64) for k in (at, len(columns), len(columns) + 1))
                rank = starts[1][np.searchsorted(starts[0], task * (capacity + 1) + length)] + pos
                run = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
                inside = rank - run[:, 1]
                placed = [pa.array(run[:, 4] + inside // run[:, 3]), pa.array(run[:, 5] + inside % run[:, 3] * length)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *placed], names=[*columns, "sequence_id", "offset"])

        out = ranked.mapInArrow(place, StructType([*fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
        return materialise(out, "packed")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenises and packs whole documents; with keep_ids the rows carry the pieces' ids, which laid at their offsets give the sequences."""
    with Scratch(docs.sparkSession, "pieces") as scratch:
        return pack(scratch.write(tokenise(docs, tokenizer_path, capacity, end_id, keep_ids)), capacity)
