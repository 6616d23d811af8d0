"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text's words are hashed; a k-mer of K words is an anchor if the smallest of its S-word substrings lies
at one of its edges. Whether it does depends on the k-mer alone, so equal passages have equal anchors
wherever they stand. A text with fewer than K words has one anchor, its whole word sequence; one without
any word has its whole text. The fingerprint holds the SIZE smallest distinct anchor hashes, a bottom-k
sketch whose overlap estimates the Jaccard similarity of the anchor sets. Beside each hash stands the word
where its anchor first stands, so that the anchors two texts share also say how the texts lie on each other.

Defined cases: a null text is an empty text, whose fingerprint is empty; two empty fingerprints are alike
(1), an empty and another one are not (0); rows without a doc_id come last in descending order; rows equal
in doc_id and text are one document in that order and keep a row each, rows with equal doc_id and other
texts follow the hash of the text; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm._shared import materialise

#: Words of an anchor and of its inner substrings, hashes of a fingerprint.
K, S, SIZE = 4, 2, 48
_DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_ID = -(1 << 63)
_LOW = (1 << 32) - 1


def with_anchors(df: DataFrame, text: str, to: str) -> DataFrame:
    """Add array column `to`: (hash, pos) of each closed syncmer of column `text`, pos in words.

    Each step is a column of its own, so that no array is computed twice.
    """
    t = {x: f"_{to}_{x}" for x in ("h", "s", "m", "i")}
    words = F.array_remove(F.split(F.lower(F.col(text)), _DELIMITERS), "")
    df = df.withColumn(t["h"], F.transform(words, lambda w: F.xxhash64(w)))
    h, n = F.col(t["h"]), F.size(t["h"])
    tail = lambda x, by: F.slice(x, F.lit(1 + by), F.greatest(F.size(x) - by, F.lit(0)))
    head = lambda x, by: F.slice(x, F.lit(1), F.greatest(F.size(x) - by, F.lit(0)))
    inner, spans = h, K - S + 1
    for i in range(1, S):
        inner = F.zip_with(head(inner, 1), tail(h, i), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(t["s"], inner)
    s = F.col(t["s"])
    least = head(s, spans - 1)
    for i in range(1, spans):
        least = F.zip_with(least, F.slice(s, F.lit(1 + i), F.greatest(F.size(s) - (spans - 1), F.lit(0))), lambda a, b: F.least(a, b))
    df = df.withColumn(t["m"], least)
    # the least substring at the first or the last place
    closed = F.zip_with(F.zip_with(F.col(t["m"]), head(s, spans - 1), lambda m, a: F.when(m != a, m)), tail(s, spans - 1), lambda m, b: m.isNull() | (m == b))
    df = df.withColumn(t["i"], closed)
    # a k-mer's hash: that of the substrings that cover it
    cover = head(s, spans - 1)
    for i in sorted({*range(S, spans, S), spans - 1}):
        cover = F.zip_with(cover, F.slice(s, F.lit(1 + i), F.greatest(F.size(s) - (spans - 1), F.lit(0))), lambda a, b: F.xxhash64(a, b))
    chosen = F.zip_with(F.col(t["i"]), cover, lambda ok, x: F.when(ok, x))
    found = F.filter(F.transform(chosen, lambda x, i: F.struct(x.alias("hash"), i.alias("pos"))), lambda x: x["hash"].isNotNull())
    short = lambda x: F.array(F.struct(x.alias("hash"), F.lit(0).alias("pos")))
    whole = F.when(n > 0, F.xxhash64(h)).otherwise(F.xxhash64(F.col(text)))
    anchors = F.when(n >= K, found).when(F.length(F.col(text)) > 0, short(whole)).otherwise(F.slice(short(whole), 1, 0))
    return df.withColumn(to, anchors).drop(*t.values())


def with_sketch(df: DataFrame, anchors: str, to: str) -> DataFrame:
    """Add column `to`: the SIZE smallest distinct 32-bit hashes of column `anchors`, each with its first place."""
    slim = f"_{to}_sorted"
    # one number each, the hash in its upper half: numbers sort without a comparator
    packed = F.transform(anchors, lambda x: x["hash"].bitwiseAND(F.lit(~_LOW)).bitwiseOR(x["pos"].cast("long")))
    df = df.withColumn(slim, F.sort_array(packed))
    upper = lambda x: F.shiftright(x, 32).cast("int")
    first = F.filter(slim, lambda x, i: (i == 0) | (upper(F.get(F.col(slim), i - 1)) != upper(x)))
    kept = F.transform(F.slice(first, 1, SIZE), lambda x: F.struct(upper(x).alias("hash"), x.bitwiseAND(F.lit(_LOW)).cast("int").alias("pos")))
    return df.withColumn(to, kept).drop(slim)


def hashes(sketch: Column) -> Column:
    return F.transform(sketch, lambda x: x["hash"])


def as_text(found: Column) -> Column:
    """The hashes of a sketch, eight digits each."""
    return F.array_join(F.transform(found, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))), 8, "0")), "")


def with_alignment(df: DataFrame, a: str, b: str, shift: str, share: str) -> DataFrame:
    """Positional matching of two sketches: how many words b's anchors stand after a's, and how many agree on it.

    `shift` is the median over the anchors that both hold (null without any), `share` the part of a's anchors
    that match at just that shift.
    """
    where = F.map_from_arrays(hashes(F.col(b)), F.transform(b, lambda x: x["pos"]))
    df = df.withColumn("_there", where)
    apart = F.sort_array(F.array_compact(F.transform(a, lambda x: F.try_element_at("_there", x["hash"]) - x["pos"])))
    df = df.withColumn("_apart", apart)
    df = df.withColumn(shift, F.get(F.col("_apart"), F.floor((F.size("_apart") - 1) / 2).cast("int")))
    agree = F.size(F.filter("_apart", lambda x: x == F.col(shift)))
    return df.withColumn(share, F.when(F.col(shift).isNull(), F.lit(0.0)).otherwise(agree / F.size(a))).drop("_there", "_apart")


def likeness(a: Column, b: Column) -> Column:
    """The share of the SIZE smallest of both arrays of hashes that each of them holds, 0 to 1."""
    both = F.slice(F.sort_array(F.array_union(a, b)), 1, SIZE)
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))


def _with_next(slim: DataFrame) -> DataFrame:
    """Add the key (nd, nh) of the next row in descending order; after the last comes the first."""
    order = [F.col("d").desc(), F.col("h").asc()]
    ranged = materialise(slim.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "order")
    inside = Window.partitionBy("_p").orderBy(*order)
    # one row per range: its first row is what follows the last row of the range before
    first = ranged.groupBy("_p").agg(F.max_by(F.struct("d", "h"), F.struct("d", F.bitwise_not("h"))).alias("first"))
    over = Window.orderBy("_p")
    after = first.select("_p", F.coalesce(F.lead("first").over(over), F.first("first").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    following = F.coalesce(F.lead(F.struct("d", "h")).over(inside), F.col("after"))
    return ranged.join(F.broadcast(after), "_p").withColumn("next", following).select(*slim.columns, F.col("next.d").alias("nd"), F.col("next.h").alias("nh"))


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, their likenesses and alignment, for documents(doc_id, text).

    The edited text ends, instead of with its last third, with as much of the next document in descending
    doc_id order. Texts are shuffled once, by their key; a second use of that exchange brings the third
    that each needs of its successor.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = documents.select(doc_id.alias("d"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    slim = rows.groupBy("d", "h").agg(F.count(F.lit(1)).alias("copies"), F.max(F.length("text")).cast("long").alias("n"))
    pairs = materialise(_with_next(slim), "pairs")
    if not pairs.where("copies > 1").isEmpty():
        rows = rows.dropDuplicates(["d", "h"])
    # both sides rename every column in one order, so that Spark finds their exchanges equal and runs one
    following = rows.select(F.col("d").alias("nd"), F.col("text").alias("next"), F.col("h").alias("nh"))
    own = rows.select(F.col("d").alias("od"), F.col("text").alias("own"), F.col("h").alias("oh"))
    third = F.floor(F.col("n") / 3).cast("int")
    prefix = pairs.join(following, ["nd", "nh"]).select("d", "h", "n", "copies", "nd", "nh", third.alias("third"), F.col("next").substr(F.lit(1), third).alias("prefix"))
    both = own.join(prefix, (F.col("od") == F.col("d")) & (F.col("oh") == F.col("h")))
    both = both.withColumn("edited", F.concat(F.col("own").substr(F.lit(1), (F.col("n") - F.col("third")).cast("int")), F.col("prefix")))
    both = both.select("d", "h", "n", "copies", "nd", "nh", "own", "edited")
    for text, to in (("own", "a"), ("edited", "b")):
        both = with_sketch(with_anchors(both, text, f"{to}_anchors"), f"{to}_anchors", to).drop(f"{to}_anchors")
    both = with_alignment(both, "a", "b", "shift_edited", "aligned_edited")
    made = both.select("d", "h", "n", "copies", "nd", "nh", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("a")).alias("a"), hashes(F.col("b")).alias("b"), "shift_edited", "aligned_edited")
    made = materialise(made, "fingerprints")
    other = made.select(F.col("d").alias("nd"), F.col("h").alias("nh"), F.col("a").alias("c"))
    found = made.join(other, ["nd", "nh"]).withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return found.select(
        F.when(F.col("d") != _NO_ID, F.col("d")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("a")).alias("fingerprint"),
        as_text(F.col("b")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
        "shift_edited",
        "aligned_edited",
    )
