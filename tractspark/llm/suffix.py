"""Exact removal of byte strings of a fixed length that start more than once in a corpus, by suffix arrays.

Every string of LENGTH bytes has one anchor that its bytes alone decide: the leftmost smallest hash among its K-byte grams. Runs of strings
with one anchor make a context; contexts are grouped by a hash of bytes that all their strings share around the anchor, so equal strings
meet in one group. Equal contexts are counted first, so that copies don't fill a shard; they are told by 128 bits of BLAKE2b under a key drawn for
each run, as polynomial hashes can be made to agree. The distinct contexts of the groups that hold several are
dealt to shards of bounded size, and a shard's suffix array is built by induced sorting: classify suffixes, sort leftmost-smaller (LMS)
substrings by induction, name them by comparing neighbours' symbols, sort the reduced string of names by recursion where names repeat, induce the whole array in linear
passes, then compute permuted common prefixes from the irreducible ones. Neighbours that share LENGTH bytes start equal strings.
A group with more contexts than a shard takes is split over several; their shards' distinct strings then meet by hashes modulo primes and modulo 2^64.

Anchors, counts and contexts only choose what is compared and never drop a string: any two equal strings share their group.

Passages are reported beside: runs of WORDS or more words (whatever lies between ASCII white space) that start elsewhere too, found alike over
hashes of words (modulo primes, with bases drawn for each run). They aren't removed unless their bytes are.

Defined cases: null and empty texts have no bytes and lose none; texts shorter than LENGTH lose none; matches never cross documents;
repeated rows are documents of their own, so both lose all strings; null doc_ids are carried; an empty table gives no rows; further
columns are ignored, whatever their names; very long texts are hashed by segments that overlap.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_arrow, materialise
from .rolling import Hashes, SafeHashes, draw_bases, mixed

LENGTH, K = 400, 32
#: Words of a passage, and of the grams that anchor it.
WORDS, WORD_GRAM = 51, 8
#: Bytes that are hashed at once, contexts of one group that one shard takes, and bytes of a shard, about.
SEGMENT, GROUP, SHARD = 1 << 19, 1500, 1 << 20
#: Symbols from which on suffixes are induced one by one and not a bucket at a time.
SYMBOLS = 4096

_U = np.uint64


Naming = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: bytes) -> np.ndarray:
    """128 bits of the bytes of each range, as two longs; equal for equal bytes alone, for all that can be found."""
    raw = memoryview(np.ascontiguousarray(data)).cast("B")
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16, key=key).digest() for a, b in zip(start.tolist(), stop.tolist())])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def by_bytes(key: bytes) -> Naming:
    return lambda data, start, stop: digests(data, start, stop, key)


def by_words(bases: tuple[int, int]) -> Naming:
    def name(data, start, stop):
        h = SafeHashes(data, bases).window(start, stop)
        return np.stack([h, np.zeros_like(h)], axis=1)

    return name


def contexts(data: np.ndarray, ends: np.ndarray, naming: Naming, length: int = LENGTH, k: int = K) -> np.ndarray:
    """data: the bytes of texts after each other; ends: where each stops. Rows: first string start, strings, group hash, both names."""
    begins = np.concatenate(([0], ends[:-1]))
    out, span, half = [], length - k + 1, (length - k) // 2
    bits = 20
    for at in range(0, len(data), SEGMENT):
        stop = min(len(data), at + SEGMENT)
        low, high = at, min(len(data), stop + length - 1)
        piece = data[low:high]
        n = len(piece) - length + 1  # string starts
        if n <= 0:
            continue
        own = np.searchsorted(ends, np.arange(at, at + n), side="right")
        fits = np.arange(at, at + n) + length <= ends[np.minimum(own, len(ends) - 1)]
        if not fits.any():
            continue
        one = Hashes(piece)
        m = len(piece) - k + 1
        keys = mixed(one.window(slice(0, m), slice(k, k + m)))
        keys = (keys & ~_U((1 << bits) - 1)) | np.arange(m, dtype=_U)
        blocks = np.full(-(-m // span) * span, ~_U(0))
        blocks[:m] = keys
        blocks = blocks.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
        anchor = (least & _U((1 << bits) - 1)).astype(np.int64)
        starts = np.arange(n)
        far = anchor - starts >= half
        change = np.ones(n, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1]) | (own[1:] != own[:-1]) | (fits[1:] != fits[:-1])
        first = np.flatnonzero(change)
        count = np.diff(np.append(first, n))
        keep = fits[first]
        first, count = first[keep], count[keep]
        a, f = anchor[first], far[first]
        # All strings of a near run hold [a, a + length - half + 1), of a far one [a - half, a + k).
        group = one.window(np.where(f, a - half, a), np.where(f, a + k, a + length - half + 1)) + f.astype(_U) * _U(0x5851F42D4C957F2D)
        names = naming(piece, first, first + count + length - 1)
        out.append(np.stack([first + at, count, mixed(group).view(np.int64), names[:, 0], names[:, 1]]))
    return np.concatenate(out, axis=1).T if out else np.zeros((0, 5), np.int64)


def _induce(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Suffix array from LMS positions in order: larger suffixes by a pass up the buckets, then smaller ones by a pass down."""
    n, size = len(t), len(counts)
    heads = np.concatenate(([0], np.cumsum(counts)[:-1]))
    tails = np.cumsum(counts)
    sa = np.full(n, -1, np.int32)
    seed_at = np.searchsorted(t[seeds], np.arange(size + 1))  # seeds are sorted by their first byte
    l_end = heads.copy()

    def deal(pred: np.ndarray, put: np.ndarray, sign: int) -> None:
        kind = t[pred]
        order = np.argsort(kind, kind="stable")
        kind, pred = kind[order], pred[order]
        n_of = np.bincount(kind, minlength=size)
        rank = np.arange(len(kind)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
        sa[put[kind] + rank if sign > 0 else put[kind] - 1 - rank] = pred
        put += sign * n_of

    def smaller(entries: np.ndarray, c: int, want_s: bool) -> tuple[np.ndarray, np.ndarray]:
        pred = entries[entries > 0] - 1
        pred = pred[is_s[pred] == want_s]
        same = t[pred] == c
        return pred[same], pred[~same]

    used = np.flatnonzero(counts)
    for c in used:
        done = heads[c]
        others = []
        while done < l_end[c]:
            front = sa[done : l_end[c]]
            done = l_end[c]
            same, rest = smaller(front, c, False)
            sa[done : done + len(same)] = same
            l_end[c] += len(same)
            others.append(rest)
        others.append(smaller(seeds[seed_at[c] : seed_at[c + 1]], c, False)[1])
        rest = np.concatenate(others)
        if len(rest):
            deal(rest, l_end, 1)
    s_end = tails.copy()
    sa[0] = n - 1  # the end mark
    for c in used[::-1]:
        done = tails[c]
        others = []
        while done > s_end[c]:
            front = sa[s_end[c] : done][::-1]
            done = s_end[c]
            same, rest = smaller(front, c, True)
            s_end[c] -= len(same)
            sa[s_end[c] : done] = same[::-1]
            others.append(rest)
        others.append(smaller(sa[heads[c] : l_end[c]][::-1], c, True)[1])
        rest = np.concatenate(others)
        rest = rest[rest != n - 1]
        if len(rest):
            deal(rest, s_end, -1)
    return sa


def _induce_each(t: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The same for many symbols with few suffixes each, where passes over buckets gain nothing: one suffix after the other."""
    n = len(t)
    # The symbol before each suffix if that suffix is a larger one, or a smaller one; -1 where it isn't, and for places still empty (-1).
    before = np.full((2, n + 1), -1, np.int64)
    before[0, 1:n], before[1, 1:n] = np.where(is_s[:-1], -1, t[:-1]), np.where(is_s[:-1], t[:-1], -1)
    larger, smaller = before[0].tolist(), before[1].tolist()
    tails = np.cumsum(counts)
    place = np.full(n, -1, np.int64)
    kind = t[seeds]  # seeds are sorted by their first symbol: they fill the ends of its bucket
    place[tails[kind] - 1 - (np.searchsorted(kind, kind, side="right") - 1 - np.arange(len(kind)))] = seeds
    sa, front, tails = place.tolist(), [0, *tails[:-1].tolist()], tails.tolist()
    for j in sa:  # sees what is placed ahead
        c = larger[j]
        if c >= 0:
            k = front[c]
            sa[k] = j - 1
            front[c] = k + 1
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            k = tails[c] - 1
            sa[k] = j - 1
            tails[c] = k
    return np.array(sa, np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """t: small non-negative numbers, the last of them 0 and no other."""
    n = len(t)
    counts = np.bincount(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = 1
    known = np.where(step != 0, np.arange(n), n)
    is_s = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    induce = _induce_each if len(counts) > SYMBOLS else _induce
    if not len(lms):
        return np.zeros(1, np.int32) if n < 2 else induce(t, is_s, np.array([n - 1], np.int32), counts)
    rough = induce(t, is_s, lms[np.argsort(t[lms], kind="stable")], counts)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    # LMS substrings, each to the next LMS position, are in order now; neighbours are equal if their sizes and all their symbols are.
    size = np.append(lms[1:], n - 1) + 1 - lms
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(len(lms))
    at = place[rough]
    new = np.ones(len(at), bool)
    alike = np.flatnonzero(size[at[1:]] == size[at[:-1]]) + 1
    if len(alike):
        long = size[at[alike]].astype(np.int64)
        begin = np.cumsum(long) - long
        step = np.arange(begin[-1] + long[-1]) - np.repeat(begin, long)
        differs = t[np.repeat(lms[at[alike]], long) + step] != t[np.repeat(lms[at[alike - 1]], long) + step]
        new[alike] = np.logical_or.reduceat(differs, begin)
    name = np.empty(len(at), np.int32)
    name[at] = np.cumsum(new)
    # The last LMS position is the end mark, whose name is the least and its own: the reduced string ends like t does.
    order = at if new.all() else suffix_array(name - 1)
    return induce(t, is_s, lms[order], counts)


def repeated(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Of the parts after each other with one mark between: a mask of positions whose `length` bytes start elsewhere too, and the parts'
    first positions. The parts differ from each other."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    firsts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    n = int(sizes.sum()) + len(parts)
    raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    t = raw.astype(np.int16) + 2
    marks = firsts + sizes
    t[marks] = 1
    t[-1] = 0
    sa = suffix_array(t)
    phi = np.full(n, -1, np.int32)
    phi[sa[1:]] = sa[:-1]
    before = np.maximum(np.arange(n) - 1, 0)
    hard = (phi < 1) | (t[before] != t[np.maximum(phi, 1) - 1])
    hard[firsts] = True
    at = np.flatnonzero(hard & (phi >= 0))
    plcp = np.zeros(n, np.int64)
    padded = np.concatenate([t, np.zeros(4, t.dtype)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 4).view()  # four symbols, eight bytes, at each position
    words = np.ascontiguousarray(words).view(np.int64).ravel()
    x, y, run = at, phi[at].astype(np.int64), at
    longest = int(sizes.max()) + 1
    for step in range(0, longest + 4, 4):
        plcp[run] = step
        ok = (x + 4 <= n) & (y + 4 <= n)
        x, y, run = x[ok], y[ok], run[ok]
        ok = words[x] == words[y]
        x, y, run = x[ok] + 4, y[ok] + 4, run[ok]
        if not len(run):
            break
    # The last, partly equal four.
    x, y = at + plcp[at], phi[at] + plcp[at]
    more = np.ones(len(at), bool)
    for _ in range(3):
        more &= (x < n) & (y < n)
        more[more] = padded[x[more]] == padded[y[more]]
        x, y = x + more, y + more
        plcp[at] += more
    gap = np.repeat(marks, sizes + 1) - np.arange(n)  # a common prefix counts to the mark
    plcp[at] = np.minimum(plcp[at], gap[at])
    source = np.maximum.accumulate(np.where(hard, np.arange(n), 0))
    plcp = np.maximum(0, plcp[source] - (np.arange(n) - source))
    pairs = plcp >= length
    mask = pairs.copy()
    mask[phi[pairs]] = True
    return mask, firsts


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_OCCURRENCES = "gkey long, ctx long, ctx2 long, doc_id long, thash long, pos long, cnt int"
_OCCURRENCE = pa.schema([("gkey", pa.int64()), ("ctx", pa.int64()), ("ctx2", pa.int64()), ("doc_id", pa.int64()), ("thash", pa.int64()), ("pos", pa.int64()), ("cnt", pa.int32())])


def _found(batch: pa.RecordBatch, data: np.ndarray, ends: np.ndarray, naming: Naming, length: int, k: int, kind: int) -> pa.RecordBatch:
    """The contexts of a batch (doc_id, thash, text) whose texts' symbols lie after each other in data; the last bit of a group's key tells what
    the symbols are: bytes (0) or words (1)."""
    found = contexts(data, ends, naming, length, k)
    own = np.searchsorted(ends, found[:, 0], side="right")
    pos = found[:, 0] - np.concatenate(([0], ends[:-1]))[own]
    take = pa.array(own)
    columns = [pa.array(found[:, 2] & ~1 | kind), pa.array(found[:, 3]), pa.array(found[:, 4]), batch.column(0).take(take), batch.column(1).take(take), pa.array(pos), pa.array(found[:, 1].astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, schema=_OCCURRENCE)


def word_hashes(texts: list[bytes], bases: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words after each other, and where each text's stop."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = np.concatenate(([True], (raw == 32) | ((raw > 8) & (raw < 14))))
    first, stop = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts)))
    return SafeHashes(raw, bases).window(first, stop), np.searchsorted(first, ends)


def _occurrences(rows: DataFrame, length: int, words: int, key: bytes, bases: tuple[int, int]) -> DataFrame:
    """Contexts of bytes and of words, in one pass over the texts."""

    def run(batches):
        for batch in batches:
            texts = [x.as_py().encode() for x in batch.column(2)]
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield _found(batch, np.frombuffer(b"".join(texts), np.uint8), ends, by_bytes(key), length, K, 0)
            yield _found(batch, *word_hashes(texts, bases), by_words(bases), words, WORD_GRAM, 1)

    return rows.filter(F.octet_length("text") >= min(length, 2 * words - 1)).mapInArrow(run, _OCCURRENCES)


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["thash"] == b["thash"])


def _met(scratch: Scratch, occ: DataFrame, length: int, words: int) -> tuple[DataFrame, DataFrame]:
    """Of the contexts those that aren't alone in their group: the ranges (gkey, doc_id, thash, lo, hi) of contexts that are equal to another, and
    the distinct contexts of groups with several, with kinds (contexts of the group), m (equal ones) and one place of each."""
    occ = scratch.write(occ)
    differ = (F.min("ctx") < F.max("ctx")) | (F.min("ctx2") < F.max("ctx2"))
    groups = occ.groupBy("gkey").agg(F.count("*").alias("total"), differ.alias("differ")).filter("total > 1").select("gkey", "differ")
    live = scratch.write(occ.join(scratch.write(groups), "gkey"))  # a table of its own, so that a hot group's side can be split
    scratch.drop(occ)
    one = ("differ", "doc_id", "thash", "pos", "cnt")  # first() takes all of them from one row
    seen = scratch.write(live.groupBy("gkey", "ctx", "ctx2").agg(F.count("*").alias("m"), *(F.first(c).alias(c) for c in one)))
    equal = seen.filter("m > 1").select("gkey", "ctx", "ctx2")
    reach = F.when(F.col("gkey").bitwiseAND(1) == 1, F.lit(words)).otherwise(F.lit(length))
    direct = live.join(equal, ["gkey", "ctx", "ctx2"], "left_semi").select("gkey", "doc_id", "thash", F.col("pos").alias("lo"), (F.col("pos") + F.col("cnt") + reach - 1).alias("hi"))
    direct = scratch.write(direct)
    scratch.drop(live)
    several = seen.filter("differ")
    kinds = several.groupBy("gkey").agg(F.count("*").alias("kinds"))
    return direct, scratch.write(several.join(kinds, "gkey").select("gkey", "ctx", "ctx2", "kinds", "m", *one[1:]))


_STRINGS = "doc_id long, thash long, gkey long, at array<long>, hashes array<long>, more array<long>"


def _across(found: DataFrame, length: int) -> DataFrame:
    """Ranges of strings that meet by hash: found has the strings' hashes, and their places (-1 where they needn't be given back)."""
    met = found.select("doc_id", "thash", "gkey", F.explode(F.arrays_zip("at", "hashes", "more")).alias("s")).select("doc_id", "thash", "gkey", "s.at", F.col("s.hashes").alias("h"), F.col("s.more").alias("h2"))
    both = met.groupBy("gkey", "h", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("gkey", "h", "h2")
    return met.filter("at >= 0").join(both, ["gkey", "h", "h2"], "left_semi").select("doc_id", "thash", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))


def _sorted(scratch: Scratch, asked: DataFrame, length: int, bases: tuple[int, int]) -> DataFrame:
    """doc_id, thash, gkey, at, hashes, more, lo, hi: what the suffix arrays of the shards tell of the contexts asked for."""
    cut = "gkey long, ctx long, ctx2 long, m long, doc_id long, thash long, pos long, cnt int, split boolean, shard long, part binary"

    def cut_out(batches):
        names = ["gkey", "ctx", "ctx2", "m", "doc_id", "thash", "pos", "cnt", "split", "shard", "part"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, thash, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for s in wanted:
                    row = (s["gkey"], s["ctx"], s["ctx2"], s["m"], doc_id, thash, s["pos"], s["cnt"], s["split"], s["shard"], raw[s["pos"] : s["pos"] + s["cnt"] + length - 1])
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64()] * 7 + [pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    def sort_shard(table):
        table = table.combine_chunks()
        parts = table["part"].to_pylist()
        order = {}
        for i, named in enumerate(zip(*(table[c].to_pylist() for c in ("gkey", "ctx", "ctx2")))):
            order.setdefault(named, i)
        index = list(order.values())  # a context that a repeated row gives twice is taken once
        mask, firsts = repeated([parts[i] for i in index], length)
        is_split = table["split"][0].as_py()
        out: list[list] = [[] for _ in range(8)]
        doc, thash, gkey, m, pos, cnt = (table[c].to_pylist() for c in ("doc_id", "thash", "gkey", "m", "pos", "cnt"))
        known: set = set()
        for i, first in zip(index, firsts):
            own = mask[first : first + cnt[i]]
            lo, hi = _runs(own)
            at = h = np.zeros((0, 2), np.int64)
            if is_split:  # each distinct string once for the shard; alone ones with their place
                data, s = np.frombuffer(parts[i], np.uint8), np.arange(cnt[i])
                h = np.stack([SafeHashes(data, bases).window(s, s + length), mixed(Hashes(data).window(s, s + length)).view(np.int64)], axis=1)
                named = list(map(tuple, h.tolist()))
                fresh = np.array([not (dup and x in known) for x, dup in zip(named, own.tolist())], bool)
                known.update(x for x, dup in zip(named, own.tolist()) if dup)
                at, h = np.where(own | (m[i] > 1), -1, s + pos[i])[fresh], h[fresh]
            if len(lo) or is_split:
                for column, value in zip(out, (doc[i], thash[i], gkey[i], at.ravel() if is_split else None, h[:, 0] if is_split else None, h[:, 1] if is_split else None, lo + pos[i], hi + pos[i] + length - 1)):
                    column.append(value)
        types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 5
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "thash", "gkey", "at", "hashes", "more", "lo", "hi"])

    wanted = asked.filter("strings is not null").select("doc_id", "thash", "text", "strings")
    return scratch.write(wanted.mapInArrow(cut_out, cut).groupBy("split", "shard").applyInArrow(sort_shard, _STRINGS + ", lo array<long>, hi array<long>"))


def _word_strings(asked: DataFrame, words: int, bases: tuple[int, int]) -> DataFrame:
    """The hashes of all passages in the contexts asked for."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, thash, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                own = SafeHashes(word_hashes([text.encode()], bases)[0], bases)
                for s in wanted:
                    at = s["pos"] + np.arange(s["cnt"])
                    for column, value in zip(out, (doc_id, thash, s["gkey"], np.where(s["m"] > 1, -1, at), own.window(at, at + words), np.zeros(len(at), np.int64))):
                        column.append(value)
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "thash", "gkey", "at", "hashes", "more"])

    return asked.filter("passages is not null").select("doc_id", "thash", "text", "passages").mapInArrow(run, _STRINGS)


def covered(scratch: Scratch, rows: DataFrame, length: int = LENGTH, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, thash, text): doc_id, thash, lo, hi of byte ranges whose every `length`-byte string starts elsewhere too, and the
    same of word ranges whose every run of `words` words does."""
    bound_arrow(rows.sparkSession, 256)
    key, bases = os.urandom(16), draw_bases()
    direct, several = _met(scratch, _occurrences(rows, length, words, key, bases), length, words)
    is_words = F.col("gkey").bitwiseAND(1) == 1
    word_several, several = several.filter(is_words), several.filter(~is_words)
    n_bytes = several.agg(F.sum(F.col("cnt") + length)).first()[0] or 0
    split = F.col("kinds") > GROUP
    shard = F.when(split, F.xxhash64("gkey", F.pmod(F.xxhash64("ctx"), F.ceil(F.col("kinds") / GROUP)))).otherwise(F.pmod(F.xxhash64("gkey"), F.lit(n_bytes // SHARD + 1)))
    strings = several.withColumns({"split": split, "shard": shard}).select("doc_id", "thash", F.struct("gkey", "ctx", "ctx2", "m", "pos", "cnt", "split", "shard").alias("string"), F.lit(None).alias("passage"))
    passages = word_several.select("doc_id", "thash", F.lit(None).alias("string"), F.struct("gkey", "m", "pos", "cnt").alias("passage"))
    none_if_empty = lambda c: F.when(F.size(F.collect_list(c)) > 0, F.collect_list(c))
    wanted = strings.unionAll(passages).groupBy("doc_id", "thash").agg(none_if_empty("string").alias("strings"), none_if_empty("passage").alias("passages"))
    asked = rows.join(wanted, _same_doc(rows, wanted)).select(rows["doc_id"], rows["thash"], "text", "strings", "passages")
    asked = scratch.write(asked)
    found = _sorted(scratch, asked, length, bases)
    inside = found.select("doc_id", "thash", F.explode(F.arrays_zip("lo", "hi")).alias("r")).select("doc_id", "thash", "r.lo", "r.hi")
    at = ("doc_id", "thash", "lo", "hi")
    ranges = direct.filter(~is_words).select(*at).unionAll(inside).unionAll(_across(found.filter("hashes is not null"), length))
    return ranges, direct.filter(is_words).select(*at).unionAll(_across(scratch.write(_word_strings(asked, words, bases)), words))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed ranges, lo:hi, comma-joined) and passage_words (words in
    passages) for every row of docs; with keep_bytes also the remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("thash"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "passage_words"] + ["kept"] * keep_bytes
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.binary()] * keep_bytes

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text, ranges, passages in zip(*(c.to_pylist() for c in batch.columns)):
                raw, kept, at = text.encode(), [], 0
                spans = merged([(r["lo"], r["hi"]) for r in ranges or ()])
                for lo, hi in spans:
                    kept.append(raw[at:lo])
                    at = hi
                rest = b"".join(kept) + raw[at:]
                in_passages = sum(hi - lo for lo, hi in merged([(r["lo"], r["hi"]) for r in passages or ()]))
                row = (doc_id, len(raw), len(raw) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), ",".join(f"{lo}:{hi}" for lo, hi in spans), in_passages, rest)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    with Scratch(docs.sparkSession, "suffix") as scratch:
        ranges, passages = covered(scratch, rows, length, words)
        one = F.struct("lo", "hi")
        each = ranges.select("doc_id", "thash", one.alias("range"), F.lit(None).alias("passage")).unionAll(passages.select("doc_id", "thash", F.lit(None).alias("range"), one.alias("passage")))
        lists = scratch.write(each.groupBy("doc_id", "thash").agg(F.collect_set("range").alias("ranges"), F.collect_set("passage").alias("passages")))
        both = rows.join(lists, _same_doc(rows, lists), "left").select(rows["doc_id"], "text", "ranges", "passages")
        return materialise(both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string, passage_words long" + ", kept binary" * keep_bytes), "kept")
