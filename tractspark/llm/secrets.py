"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Base spans, leftmost and non-overlapping for each kind: `assign`, `access` and `hex` (patterns below). Each assigned value, access key and
hex run is a candidate; its SHA-256 is counted over the corpus by distinct documents (repositories) and distinct sources (owners). A
candidate that at least EXAMPLE_OWNERS owners hold, or at least EXAMPLE_REPOSITORIES documents of fewer, is a widely copied example; the
others are owner-specific, live-looking credentials.
The method adds one span for each candidate, of kind `live` or `example`, over the credential itself (for assign the value alone).

Positions come from the pieces between matches: split() and regexp_extract_all() walk a text alike, so lengths add up to offsets.

Defined cases: a null text is an empty one and has no spans; a null source is an owner of its own; null or repeated doc_ids are carried;
repeated rows give equal rows and count as one document; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, own_columns, running_most, running_sums

# Fixed patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Letters of the value, characters.
VALUE_LENGTH = 8
#: Owners, and repositories of any owners, from which on a credential counts as a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 2, 10


def _matches(text: Column, pattern: str, kind: str, rank: int, group: int) -> Column:
    """Array of structs start, rank, kind, stop, value_start, value."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # A match starts behind the gaps and matches before it and its own gap; the last gap has no match behind it.
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda gap, w: gap + F.length(w))
    joined = F.arrays_zip(running_sums(sizes).alias("at"), F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))

    def one(x):
        start = x["at"] + x["gap"]
        stop = start + F.length(x["whole"])
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), (stop - F.length(x["value"])).alias("value_start"), x["value"].alias("value"))

    return F.transform(joined, one)


def _guarded(text: Column, hint: Column, pattern: str, kind: str, rank: int, group: int) -> Column:
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int,value_start:int,value:string>>")
    return F.when(hint & text.rlike(pattern), _matches(text, pattern, kind, rank, group)).otherwise(none)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind as listed. In a pattern that ends in `[..]+` the value is the end of its match."""
    assign = F.filter(_guarded(text, F.lit(True), ASSIGN, "assign", 0, 1), lambda s: F.length(s["value"]) >= VALUE_LENGTH)
    access = _guarded(text, text.contains("AKIA"), ACCESS, "access", 1, 0)
    return F.array_sort(F.concat(assign, access, _guarded(text, F.lit(True), HEX, "hex", 2, 0)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def with_spans(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, source, text_key (a hash of the text), base (array of base spans), added (array of the method's spans, kind `live` or
    `example`) and copies, the number of rows of docs that are equal in all of these."""
    found = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), base_spans(F.coalesce("text", F.lit(""))).alias("base"))
    found = materialise(found.groupBy("doc_id", "source", "text_key", "base").agg(F.count("*").alias("copies")), "secrets")
    bare, held = found.filter(F.size("base") == 0), found.filter(F.size("base") > 0)
    candidates = held.select("doc_id", "source", "text_key", F.explode(F.array_distinct(F.transform("base", lambda s: _digest(s["value"])))).alias("digest"))
    # A doc_id is one repository of its owner, whatever number of texts it has; rows without an id are told apart by their text.
    repository = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("text_key"))
    by_owner = candidates.select("digest", "source", repository.alias("repository")).distinct().groupBy("digest", "source").agg(F.count("*").alias("repositories"))
    owners = by_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    owners = owners.filter((F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)).select("digest")
    keys = ["doc_id", "source", "text_key"]
    seen = candidates.join(owners, "digest").groupBy(*keys).agg(F.collect_set("digest").alias("examples"))
    seen = seen.select(*(F.col(k).alias(f"_{k}") for k in keys), "examples")
    held = held.join(seen, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    known = F.coalesce("examples", F.array().cast("array<binary>"))
    added = F.transform("base", lambda s: F.struct(s["value_start"].alias("start"), F.lit(3).alias("rank"), F.when(F.array_contains(known, _digest(s["value"])), "example").otherwise("live").alias("kind"), s["stop"].alias("stop")))
    held = held.select(*keys, "base", F.array_distinct(added).alias("added"), "copies")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")
    return held.unionAll(bare.select(*keys, "base", none.alias("added"), "copies"))


def scan(docs: DataFrame, **thresholds) -> DataFrame:
    """Counts and span strings for every row of docs."""
    spans = with_spans(docs, **thresholds).withColumn("copy", F.explode(F.expr("array_repeat(0, cast(copies as int))")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    slim = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    every = F.array_sort(F.concat(slim, F.col("added")))
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", **thresholds) -> DataFrame:
    """docs with each live-looking credential in text replaced by `mark` (n_chars follows); widely copied examples stay. All rows stay, with
    columns of any name; a null text stays null."""
    keys = {k: free_name(docs.columns, f"secret_{k}") for k in ("doc_id", "source", "text_key")}
    cuts = free_name(docs.columns, "secret_cuts")
    spans = F.transform(F.filter("added", lambda s: s["kind"] == "live"), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    live = with_spans(docs, **thresholds).select(*(F.col(k).alias(v) for k, v in keys.items()), F.array_sort(spans).alias(cuts)).filter(F.size(cuts) > 0)
    row = {"doc_id": F.col("doc_id"), "source": F.col("source"), "text_key": F.xxhash64("text")}
    marked = docs.join(live, [row[k].eqNullSafe(F.col(v)) for k, v in keys.items()], "left")
    # Spans of different kinds may overlap: what a cut before has taken isn't cut again.
    stops = F.transform(cuts, lambda s: s["stop"])
    parts = F.zip_with(running_most(stops), cuts, lambda reach, s: F.struct(reach.alias("from"), s["start"].alias("to")))
    pieces = F.transform(F.filter(parts, lambda p: p["to"] >= p["from"]), lambda p: F.concat(F.substring("text", p["from"] + 1, p["to"] - p["from"]), F.lit(mark)))
    rebuilt = F.concat(F.array_join(pieces, ""), F.substring("text", F.array_max(stops) + 1, F.length("text")))
    text = F.when(F.col(cuts).isNotNull(), rebuilt).otherwise(F.col("text"))
    new = {"text": text.alias("text")} | ({"n_chars": F.length(text).cast("long").alias("n_chars")} if "n_chars" in docs.columns else {})
    return marked.select(*(new.get(c, own) for c, own in zip(docs.columns, own_columns(docs))))
