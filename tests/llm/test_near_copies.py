"""Near copies of the pipeline against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from tractspark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    x, y = (set(simhash.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def kept(texts):
    group = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if group[i] != group[j] and jaccard(a[1], texts[j][1]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    order = lambda i: (texts[i][0] is None, texts[i][0] or 0)
    return sorted(map(str, (texts[min((i for i in range(len(texts)) if group[i] == g), key=order)] for g in set(group))))


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], SCHEMA)
    return sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect())


def test_planted_copies(spark):
    random.seed(11)
    words = [f"w{i}" for i in range(5000)]
    texts, levels = [], []
    for k in range(60):
        base = random.choices(words, k=random.choice((30, 80, 300)))
        copy = list(base)
        for _ in range(random.randint(1, max(1, len(base) // 45))):
            copy[random.randrange(len(copy))] = f"x{k}"
        texts += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        levels.append(jaccard(texts[-2][1], texts[-1][1]))
    assert sum(0.8 <= x < 0.97 for x in levels) > 20 and sum(x < 0.8 for x in levels) > 3
    base = random.choices(words, k=200)
    chain = [base[i : i + 180] for i in range(0, 20, 4)] + [base[:100] + random.choices(words, k=3) + base[103:] for _ in range(30)]
    texts += [(200 + i, " ".join(t)) for i, t in enumerate(chain)] + [(300, None), (301, " "), (302, "one two"), (303, "One  two")]
    assert stage(spark, texts) == kept(texts)




def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group about as alike as 0.8 asks, in many blocks: one document of each class stays, and sketches leave few pairs to compare."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "FEW", 8)
    found, inner = [], simhash._near_in_blocks

    def counted(*args):
        out = args[-1].write(inner(*args))
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "_near_in_blocks", counted)
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(150):
        copy = list(base)
        for at in random.sample(range(200), random.randint(2, 5)):
            copy[at] = f"x{k}-{at}"
        texts.append((k, " ".join(copy)))
    sets = [simhash.shingle_set(t) for _, t in texts]
    marks = [int.from_bytes(simhash.sketch(s)) for s in sets]
    assert all((x ^ y).bit_count() <= len(set(s.tolist()) ^ set(o.tolist())) for s, x in zip(sets, marks) for o, y in zip(sets, marks))
    expected = kept(texts)
    links = sum(jaccard(a[1], b[1]) >= 0.8 for i, a in enumerate(texts) for b in texts[:i])
    assert 0 < links < 2000 and len(expected) > 1
    assert stage(spark, texts) == expected
    assert found[0] < 2 * links


def test_simhash_proposes_links(spark, monkeypatch):
    """The stage's first links are SimHash's: it alone joins copies that differ in a word or two, and what it can't see is joined after it."""
    proposed, inner = [], simhash._by_fingerprint

    def taken(*args):
        out = inner(*args)
        proposed.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "_by_fingerprint", taken)
    random.seed(7)
    texts = []
    for k in range(12):
        base = random.choices([f"w{i}" for i in range(3000)], k=900)
        near, far = list(base), list(base)
        near[0] = f"x{k}"
        for at in range(10, 190, 10):
            far[at] = f"y{k}"
        texts += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    assert all(jaccard(texts[k][1], texts[k + 2][1]) >= 0.8 for k in range(0, 36, 3))
    sets = {i: simhash.shingle_set(t) for i, t in texts}
    fps = {i: simhash.majority(s) for i, s in sets.items()}
    linked = [(i, j) for i in fps for j in fps if i < j and (fps[i] ^ fps[j]).bit_count() <= 3]
    assert all((3 * k, 3 * k + 1) in linked for k in range(12)) and any((3 * k, 3 * k + 2) not in linked for k in range(12))
    assert stage(spark, texts) == kept(texts) and len(kept(texts)) == 12
    cls = {simhash.xxhash.xxh64_intdigest(s.tobytes()): i for i, s in sets.items()}
    pairs = {tuple(sorted(cls[x % 2**64] for x in p)) for p in proposed}
    assert all((fps[i] ^ fps[j]).bit_count() <= 6 for i, j in pairs) and len(pairs) >= 12
