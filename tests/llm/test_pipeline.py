"""Every stage of the pipeline against a brute-force version in plain Python, each on what the brute-force version of the last one kept."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from tractspark.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def bag(rows):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows)


def good(docs, trees):
    inner = trees.feature.shape[1]
    out = []
    for d in docs:
        x, total = quality.statistics(d["text"]), trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < inner:
                node = 2 * node + (2 if x[feature[node]] > threshold[node] else 1)
            total += leaf[node - inner]
        if 1 / (1 + math.exp(-total)) >= 0.3:
            out.append(d)
    return out


def shingles(text):
    words = [w for w in BLANK.split("".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_each(docs):
    sets, group = [shingles(d["text"]) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for d, g in zip(docs, group):
        first[g] = min(first.get(g, d["doc_id"]), d["doc_id"])
    return [d for d, g in zip(docs, group) if d["doc_id"] == first[g]]


def values(text):
    """(start, stop, value) of the credentials that the base patterns find."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(*m.span(2), m[2]) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [(*m.span(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [(*m.span(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def without_secrets(docs):
    owners, repositories = defaultdict(set), defaultdict(set)
    for d in docs:
        for _, _, v in values(d["text"] or ""):
            owners[v].add(d["source"])
            repositories[v].add(d["doc_id"])
    out = []
    for d in docs:
        at, parts = 0, []
        for a, b in sorted({(a, b) for a, b, v in values(d["text"] or "") if len(owners[v]) < 2 and len(repositories[v]) < 10}):
            if a >= at:
                parts.append(d["text"][at:a] + "[REDACTED]")
            at = max(at, b)
        text = "".join(parts) + d["text"][at:] if at else d["text"]
        out.append(d | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def mixed(docs):
    size = lambda d: sum(1 for w in BLANK.split(d["text"] or "") if w)
    of = defaultdict(list)
    for d in docs:
        of[d["source"]].append(d)
    sources = sorted(of, key=lambda s: (s is None, s or ""))
    weight, total = {s: 1 + k % 3 for k, s in enumerate(sources)}, {s: sum(map(size, of[s])) for s in sources}
    target, open_, left = {}, set(sources), float(sum(total.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        if not full:
            target |= share
            break
        target |= {s: 3.0 * total[s] for s in full}
        left, open_ = left - sum(3 * total[s] for s in full), open_ - full
    seats = round(sum(target.values()) / mixing.BLOCK)
    quotients = sorted((-target[s] / (2 * k + 1), i, k) for i, s in enumerate(sources) for k in range(-(-3 * total[s] // mixing.BLOCK)))
    quota = Counter(sources[i] for _, i, _ in quotients[:seats])
    out = []
    for s in sources:
        assert len(of[s]) <= mixing.SHARD  # one shard for each source
        budget, at = min(quota[s] * mixing.BLOCK, 3 * total[s]), 0
        for d in sorted(of[s], key=lambda d: hashlib.md5(f"{mixing.SEED}:{d['doc_id']}:{hashlib.md5((d['text'] or '').encode()).hexdigest()}".encode()).hexdigest()):
            n = size(d)
            taken = budget // total[s] * n + min(n, max(0, budget % total[s] - at)) if n else 0
            at += n
            out += [d] * (-(-taken // n) if n else 0)
    return out


def best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        g = min(fits, default=None)
        if g is None:
            g = capacity
        else:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trees = quality.fit_on(docs, labels)
    brute = rows_of(docs)
    wants = (lambda x: good(x, trees), one_each, without_secrets, mixed)
    for (name, stage), want in zip(corpus_pipeline.STAGES, wants):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        brute = want(brute)
        assert 0 < len(brute) and bag(rows_of(out)) == bag(brute), name
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in brute], docs.schema)
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert not packed.duplicated(["row_id", "piece"]).any()
    tokenizer, pieces = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for d in brute:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), queries.CAPACITY)):
            own = ids[at : at + queries.CAPACITY]
            pieces[d["doc_id"], piece, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))] += 1
    assert Counter(zip(packed.doc_id, packed.piece, packed.start, packed.length, packed.ids_crc32)) == pieces
    for ids, length, crc in zip(packed.ids, packed.length, packed.ids_crc32):
        assert len(ids) == length and zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids)) == crc
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= queries.CAPACITY
    assert packed.sequence_id.nunique() <= best_fit(packed.length, queries.CAPACITY)


ODD = "doc_id long, text string, lang string, source string, n_chars long, quality_score string, quality_predicted string, `a b` string, key_id string, key_digest string, secret_cuts string, mix_times string, _live string, row string, n int, root string, `c.d` string"


def test_stages_defined_cases(spark):
    """Nulls in every column, empty, repeated and very long texts, ties, columns of clashing and unusual names, empty tables."""
    extra = ("e",) * 9 + (1,) + ("e",) * 2
    long = " ".join(f"word{i % 977} of{i % 31} {i}" for i in range(250_000))
    assert len(long) > 4_000_000
    rows = [(1, "token=abcdef123456 and more words here", "en", "s", 0, *extra), (1, "token=abcdef123456 and more words here", "en", "s", 0, *extra), (2, "", "en", None, 0, *extra), (3, None, "en", "s", 0, *extra), (None,) * 17, (None, "words of a row without an id", None, None, None, *extra), (5, long, "en", "t", 0, *extra)]
    docs, labels = spark.createDataFrame(rows, ODD), spark.createDataFrame([], "doc_id long, quality int")
    out = {}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        real = quality.keep_good
        if stage is corpus_pipeline.good_quality:
            kept = real(docs, labels)
        else:
            kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        out[name] = kept.collect()
    assert [len(x) for x in out.values()][:3] == [7, 4, 4]  # repeated rows, and all texts without words, are one group each
    assert {r.doc_id for r in list(out.values())[1]} == {1, 2, None, 5}
    by_id = {r.doc_id: r for r in list(out.values())[2]}
    assert by_id[1].text == "token=[REDACTED] and more words here" and by_id[1].n_chars == 36 and by_id[5].text == long and by_id[1]["a b"] == "e"
    assert {r.doc_id for r in list(out.values())[3]} <= {1, None, 5}  # texts without words aren't in the mix
    packed = corpus_pipeline.packed(spark, kept, "").collect()
    assert sum(r.length for r in packed if r.doc_id == 5) > 250_000
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs.limit(0), "").count() == 0, name
    assert quality.keep_good(docs.limit(0), labels).count() == 0
