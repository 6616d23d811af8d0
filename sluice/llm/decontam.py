"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

1. How often each benchmark term stands in the documents is counted over all of them.
2. Of every distinct window of a benchmark item the two rarest terms that occur are its probes. Neighbouring
   windows with the same two places form one segment of the item. A window with a term that never occurs
   cannot occur either; it is probed for proximity only.
3. The postings (term, document, position) of the probes are stored.
4. A probe's postings, less the probe's place in the item, are the places where the item could start. The
   lists of a segment's two probes are intersected on document and start; what remains is compared with
   the segment word by word, so every reported window stands in the document exactly. Lists that agree up to
   a slack, but not exactly, are proximity matches.

A window that an item repeats is looked up once, so that a repetitive item doesn't meet a repetitive text in
every pair of places. The benchmark side of a join is broadcast only if its counted rows and bytes stay under
BROADCAST_ROWS and BROADCAST_BYTES; beyond it the join is shuffled. Documents are exploded to words, never
paired with one another.

Defined cases: a null text has no words; a null item has no window; items with equal ids count once in a
document's list, an item without an id hits but isn't listed; rows equal in doc_id and text are looked up
once and keep a row each; of terms that are equally rare the one that stands first is the probe; texts of one
word repeated take time in proportion to their words; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm._shared import materialise, scratch, unused

#: Words of a window, words that a proximity match may be off; rows and bytes of a benchmark-side table that is broadcast.
WINDOW, SLACK, BROADCAST_ROWS, BROADCAST_BYTES = 10, 5, 1_000_000, 64 << 20
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same without A-Z, to count words without lowering them.
_BOTH_CASES = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; empty for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))  # lower() is faster, and the same for ASCII
    return F.array_remove(F.split(plain, _DELIMITERS), "")


def small(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows and their bytes are few enough."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        one = F.octet_length(name) if kind == "string" else F.aggregate(name, F.lit(0), lambda n, w: n + F.octet_length(w) + 16) if kind == "array<string>" else F.lit(8)
        size = size + F.coalesce(one, F.lit(0)) + 8
    found = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= BROADCAST_ROWS and found["bytes"] <= BROADCAST_BYTES else df


def _keyed(documents: DataFrame) -> DataFrame:
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return documents.select(doc_id.alias("d"), F.xxhash64("text").alias("h"), "text")


def _tokens(documents: DataFrame) -> DataFrame:
    return _keyed(documents).select("d", "h", F.posexplode(words(F.col("text"))).alias("pos", "word")).select("d", "h", "pos", F.xxhash64("word").alias("term"))


def probes(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Segments (probe, item_id, exact, lo, words, size) and the probes (probe, rank, q, term) of their windows.

    A segment holds the words of an item's consecutive windows, the first at word `lo`, that share their two
    probes; q is a probe's place in the item; exact says whether all terms of its windows occur.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("iw")).where(F.size("iw") > 0).distinct()
    items = materialise(items.withColumn("item", F.xxhash64("item_id", F.to_json("iw"))), "items")
    places = items.select("item", F.posexplode("iw").alias("q", "word")).select("item", "q", F.xxhash64("word").alias("term"))
    terms = materialise(places.select("term").distinct(), "terms")
    counts = materialise(_tokens(documents).select("term").join(small(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")
    known = places.join(small(counts), "term", "left").select("item", "q", "term", F.coalesce("n", F.lit(0)).alias("n"))
    lists = known.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("q", "n", "term"))).alias("x"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("x") - window, F.lit(0)))
    part = lambda s: F.slice("x", s + 1, window)
    one = lambda s: F.struct(s.alias("lo"), F.xxhash64(F.transform(part(s), lambda y: y["term"])).alias("same"), F.sort_array(F.transform(part(s), lambda y: F.struct(y["n"].alias("n"), y["q"].alias("q"), y["term"].alias("term")))).alias("r"))
    windows = lists.select("item", F.explode(F.transform(starts, one)).alias("w")).select("item", "w.*")
    windows = windows.groupBy("item", "same").agg(F.min(F.struct("lo", "r")).alias("w")).select("item", "w.lo", "w.r")
    occurs = F.filter("r", lambda y: y["n"] > 0)
    ranked = windows.select("item", "lo", (F.col("r")[0]["n"] > 0).alias("exact"), occurs.alias("r")).where(F.size("r") > 0)
    chosen = ranked.select("item", "lo", "exact", F.col("r")[0].alias("one"), F.coalesce(F.try_element_at("r", F.lit(2)), F.col("r")[0]).alias("two"))
    chosen = chosen.groupBy("item", "exact", "one", "two").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"))
    chosen = materialise(chosen.withColumn("probe", F.xxhash64("item", "exact", F.col("one.q"), F.col("two.q"))), "windows")
    texts = chosen.select("probe", "item", "exact", "lo", "hi").join(items, "item")
    segments = texts.select("probe", "item_id", "exact", "lo", F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo") + window).alias("words"), F.least(F.size("iw"), F.lit(window)).alias("size"))
    both = F.array(F.struct(F.lit(1).alias("rank"), "one.q", "one.term"), F.struct(F.lit(2).alias("rank"), "two.q", "two.term"))
    return materialise(segments, "segments"), materialise(chosen.select("probe", F.explode(both).alias("p")).select("probe", "p.*"), "probes")


def postings(documents: DataFrame, probed: DataFrame) -> DataFrame:
    """The stored index (term, d, h, pos) of the probes' terms."""
    return materialise(_tokens(documents).join(small(probed.select("term").distinct()), "term").select("term", "d", "h", "pos"), "postings")


def _starts(probed: DataFrame, index: DataFrame, rank: int) -> DataFrame:
    """(probe, d, h, start): where an item would have to start for its probe to stand where it does."""
    return index.join(small(probed.where(F.col("rank") == rank).drop("rank")), "term").select("probe", "d", "h", (F.col("pos") - F.col("q")).alias("start"))


def alignments(probed: DataFrame, index: DataFrame) -> DataFrame:
    """(probe, d, h, start): places where both probes of a segment agree on its item's start."""
    return _starts(probed, index, 1).join(_starts(probed, index, 2), ["probe", "d", "h", "start"])


def exact_windows(documents: DataFrame, segments: DataFrame, probed: DataFrame, index: DataFrame) -> DataFrame:
    """(d, h, item_id, first, size): every place where a window of an item stands in a document."""
    exact = segments.where("exact")
    asked = probed.join(small(exact.select("probe")), "probe", "left_semi")
    places = materialise(alignments(asked, index), "places")
    # each text is joined once, with the list of its places; what leaves it are slices as long as a segment
    sized = places.join(small(exact.select("probe", "lo", F.size("words").alias("n"))), "probe")
    lists = materialise(sized.groupBy("d", "h").agg(F.collect_list(F.struct("probe", (F.col("start") + F.col("lo")).alias("at"), "n")).alias("x")), "lists")
    texts = _keyed(documents).join(small(lists.select("d", "h")), ["d", "h"], "left_semi").dropDuplicates(["d", "h"])
    texts = texts.join(lists, ["d", "h"]).select("d", "h", "x", words(F.col("text")).alias("dw"))

    def part(p: Column) -> Column:
        """The document's words where the segment's lie, from the segment's word `skip` on."""
        skip = F.greatest(-p["at"], F.lit(0))
        n = F.greatest(F.least(p["n"] - skip, F.size("dw") - p["at"] - skip), F.lit(0))
        return F.struct(p["probe"].alias("probe"), skip.alias("skip"), (p["at"] + skip).alias("at"), F.slice("dw", p["at"] + skip + 1, n).alias("there"))

    aligned = texts.select("d", "h", F.explode(F.transform("x", part)).alias("p")).select("d", "h", "p.*").join(small(exact.drop("exact", "lo")), "probe")
    same = F.zip_with(F.slice("words", F.col("skip") + 1, F.size("there")), F.col("there"), lambda a, b: a == b)
    checked = aligned.where(F.size("there") >= F.col("size")).select("d", "h", "item_id", "at", "size", same.alias("same"))
    starts = F.filter(F.sequence(F.lit(0), F.size("same") - F.col("size")), lambda s: F.forall(F.slice("same", s + 1, F.col("size")), lambda x: x))
    return checked.select("d", "h", "item_id", F.explode(F.transform(starts, lambda s: s + F.col("at"))).alias("first"), "size")


def matched_windows(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, item_id, first, size): every place where a window of an item stands in a document."""
    segments, probed = probes(documents, benchmark, window)
    exact = probed.join(small(segments.where("exact").select("probe")), "probe", "left_semi")
    return exact_windows(documents, segments, exact, postings(documents, exact))


def near_places(segments: DataFrame, probed: DataFrame, index: DataFrame, slack: int = SLACK) -> DataFrame:
    """(d, h, item_id, start, distance): both probes of a window near their places, but not exactly there.

    distance is how far apart the two starts are, 1 to `slack`. Starts are joined by their bucket of
    slack + 1 and its neighbours, so no list is crossed with another.
    """
    bucket = F.floor(F.col("start") / (slack + 1))
    one = _starts(probed, index, 1).withColumn("bucket", bucket)
    two = _starts(probed, index, 2).withColumn("bucket", F.explode(F.array(*(bucket + i for i in (-1, 0, 1))))).withColumnRenamed("start", "other")
    near = one.join(two, ["probe", "d", "h", "bucket"]).withColumn("distance", F.abs(F.col("start") - F.col("other"))).where(F.col("distance").between(1, slack))
    return near.join(small(segments.select("probe", "item_id")), "probe").select("d", "h", "item_id", "start", "distance")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document.

    n_near counts the items with a proximity match in the document; it doesn't make a document contaminated.
    """
    segments, probed = probes(documents, benchmark, window)
    index = postings(documents, probed)
    found = materialise(exact_windows(documents, segments, probed, index), "found")
    hits = found.select("d", "h", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("pos")).distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = found.groupBy("d", "h").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    near = near_places(segments, probed, index, slack).select("d", "h", "item_id").where("item_id is not null").distinct().groupBy("d", "h").agg(F.count(F.lit(1)).alias("n_near"))
    sums = materialise(hits.join(listed, ["d", "h"]).join(near, ["d", "h"], "full").withColumnsRenamed({"d": "_d", "h": "_h"}), "sums")
    every = _keyed(documents).select("d", "h", F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), _BOTH_CASES), "")).cast("long").alias("n_words"))
    joined = every.join(sums, (F.col("d") == F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no window of the benchmark stands."""
    with scratch(documents.sparkSession) as keep:
        hit = keep(materialise(matched_windows(documents, benchmark, window).select("d", "h").distinct(), "hit"))
    d, h = unused(documents, "_d", "_h")
    keyed = documents.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), h: F.xxhash64("text")})
    return keyed.join(small(hit.withColumnsRenamed({"d": d, "h": h})), [d, h], "left_anti").select(documents.columns)


def proximity_matches(documents: DataFrame, benchmark: DataFrame, slack: int = SLACK, window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, distance): both probes of a window near their places, but not exactly there."""
    segments, probed = probes(documents, benchmark, window)
    near = near_places(segments, probed, postings(documents, probed), slack)
    return near.select(F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"), "item_id", F.col("start").cast("long").alias("start"), F.col("distance").cast("long").alias("distance")).distinct()
