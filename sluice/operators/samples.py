"""Samples: validation, split, labels, batches, image tokens and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import bound, holdout, pad
from sluice.operators.corpus import group_offsets
from sluice.operators.transforms import column

#: Fixed value: labels that losses ignore.
IGNORED = -100


def violations(df: DataFrame) -> DataFrame:
    """Add `error`: why a row isn't a valid sample, null if it is.

    An empty text counts as none, a null image path as no path; an empty list of images is valid.
    """
    text, messages = F.coalesce(column(df, "text"), F.lit("")) != "", F.col("messages").isNotNull()
    bad = F.exists("messages", lambda m: m["role"].isNull() | m["content"].isNull())
    broken = F.exists(column(df, "images", "array<string>"), lambda i: i.isNull())
    error = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "missing id")
        .when(~text & ~messages, "neither text nor messages")
        .when(text & messages, "both text and messages")
        .when(F.coalesce(bad, F.lit(False)), "message without role or content")
        .when(F.coalesce(broken, F.lit(False)), "image without path")
    )
    return df.withColumn("error", error)


def normalised_images(df: DataFrame) -> DataFrame:
    """Rows whose empty lists of images have become null."""
    return df.withColumn("images", F.when(F.size("images") > 0, F.col("images")))


def strict(df: DataFrame) -> DataFrame:
    """The rows, failing at the first invalid one."""
    checked = violations(df)
    return checked.withColumn("id", F.when(F.col("error").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("invalid sample: "), "error")).cast("string"))).drop("error")


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def split(df: DataFrame, key: str, share: float) -> DataFrame:
    """Add `split`: val or train, by the id's digest alone."""
    return df.withColumn("split", F.when(holdout(F.col(key).cast("string"), share), "val").otherwise("train"))


def part(df: DataFrame, key: str, share: float, which: str) -> DataFrame:
    """The rows of the train or val part, or all."""
    if which not in ("train", "val", "all"):
        raise ValueError("which must be train, val or all")
    rows = split(df, key, share)
    return (rows if which == "all" else rows.where(F.col("split") == which)).drop("split")


def without_empty(df: DataFrame, mask: str = "attention_mask") -> DataFrame:
    """Rows whose mask covers a token."""
    return df.where(F.aggregate(mask, F.lit(0), lambda a, x: a + x) > 0)


def truncated(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def masked_labels(ids: Column, assistant_mask: Column) -> Column:
    """Ids where the assistant speaks, IGNORED elsewhere."""
    return F.zip_with(ids, assistant_mask, lambda t, m: F.when(m.cast("int") != 0, t).otherwise(IGNORED))


def tail_labels(ids: Column, n: Column) -> Column:
    """Ids of the last n tokens, IGNORED before."""
    return F.transform(ids, lambda t, i: F.when(i >= F.size(ids) - n, t).otherwise(IGNORED))


def batches(df: DataFrame, order: Column, size: int, *within: str) -> DataFrame:
    """Add `batch`: groups of `size` consecutive rows in `order` within each of `within`."""
    placed = group_offsets(df.withColumn("_o", order), list(within), ["_o"], F.lit(1))
    return placed.withColumn("batch", F.floor(F.col("before") / size).cast("int")).drop("_o", "before")


def length_batches(df: DataFrame, chunk: str, length: str, key: str, has_images: Column, size: int) -> DataFrame:
    """Add `images` and `batch`: within a chunk longest first, rows with images and without never in one batch."""
    rows = df.withColumn("images", has_images)
    return batches(rows, F.struct((-F.col(length)).alias("l"), F.col(key).alias("k")), size, chunk, "images")


def within_length(df: DataFrame, ids: str, most: int, has_images: Column) -> DataFrame:
    """Rows with images go if they are too long, as a run of image tokens can't be cut; others are truncated."""
    return df.where(~has_images | (F.size(ids) <= most)).withColumn(ids, truncated(F.col(ids), most))


def encoded(df: DataFrame, most: int, pad_id: int = 0) -> DataFrame:
    """`input_ids`, `attention_mask`, `labels` of samples, given their token arrays.

    Of text_ids all are labels; of chat_ids those under assistant_mask or, without a mask, as many at the end as
    the last answer (answer_ids) has; image_ids come from image_encoded and carry their own labels in
    image_labels. A row without any is one masked padding token, for without_empty to drop.
    """
    ids = lambda name: truncated(column(df, name, "array<int>"), most)
    text, chat, images = ids("text_ids"), ids("chat_ids"), column(df, "image_ids", "array<int>")
    mask, answer = ids("assistant_mask"), column(df, "answer_ids", "array<int>")
    chat_labels = F.when(mask.isNotNull(), masked_labels(chat, mask)).otherwise(tail_labels(chat, F.coalesce(F.when(answer.isNotNull(), F.size(answer)), F.lit(0))))
    none = F.array(F.lit(pad_id))
    out = df.withColumn("input_ids", F.coalesce(images, text, chat, none))
    found = F.when(images.isNotNull(), F.coalesce(column(df, "image_labels", "array<int>"), images)).when(text.isNotNull(), text).when(chat.isNotNull(), chat_labels).otherwise(F.array(F.lit(IGNORED)))
    known = F.coalesce(images, text, chat).isNotNull()
    return out.withColumns({"labels": found, "attention_mask": F.transform("input_ids", lambda _: F.when(known, 1).otherwise(0))})


def image_encoded(df: DataFrame, ids: str, grids: str, images: str, pad_id: int, video_id: int, merge: int, most: int, mask: str = "assistant_mask") -> DataFrame:
    """Samples with images: pads counted, expanded to image tokens, over-long rows dropped, labelled and typed.

    Adds image_ids, image_labels, types. The assistant's mask is expanded with the ids; image tokens are never labels.
    """
    rows = consistent_images(df, ids, pad_id, images)
    flat = F.zip_with(ids, mask, lambda x, m: F.struct(x.alias("x"), m.cast("int").alias("m")))
    wide = _expanded(flat, F.col(ids), F.col(grids), pad_id, merge)
    rows = rows.withColumn("_wide", wide).where(F.size("_wide") <= most)
    rows = rows.withColumn("image_ids", F.transform("_wide", lambda s: s["x"]))
    labels = F.transform("_wide", lambda s: F.when((s["m"] != 0) & (s["x"] != pad_id), s["x"]).otherwise(IGNORED))
    return rows.withColumns({"image_labels": labels, "types": token_types(F.col("image_ids"), pad_id, video_id)}).drop("_wide")


def microbatch_inputs(samples: DataFrame, embeddings: DataFrame, cached: DataFrame, rollouts: DataFrame, first_layer: int) -> DataFrame:
    """(sid, pos, vec, origin): what a block starts from: embeddings at the first layer, else rollout rows, else cached ones.

    embeddings(sid, pos, vec), cached and rollouts(sid, layer, pos, vec) hold the output of the layer before.
    """
    if first_layer == 0:
        return samples.select("sid").join(embeddings, "sid").select("sid", "pos", "vec", F.lit("embedding").alias("origin"))
    before = F.col("layer") == first_layer - 1
    both = rollouts.where(before).select("sid", "pos", "vec", F.lit(0).alias("o")).unionByName(cached.where(before).select("sid", "pos", "vec", F.lit(1).alias("o")))
    best = samples.select("sid").join(both, "sid").groupBy("sid", "pos").agg(F.min_by("vec", "o").alias("vec"), F.min("o").alias("o"))
    return best.select("sid", "pos", "vec", F.when(F.col("o") == 0, "rollout").otherwise("cache").alias("origin"))


def padded(df: DataFrame, keys: list[str], ids: str, filler: int = 0, multiple: int = 1) -> DataFrame:
    """Ids, mask and labels of each row padded to its batch's longest, rounded up to a multiple."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(*keys))
    to = (F.ceil(longest / multiple) * multiple).cast("int")
    rows = df.withColumn("_to", to)
    ones = F.transform(ids, lambda _: F.lit(1))
    labels = F.col("labels") if "labels" in df.columns else F.col(ids)
    return rows.withColumns({"labels": pad(labels, F.col("_to"), F.lit(IGNORED)), "attention_mask": pad(ones, F.col("_to"), F.lit(0)), ids: pad(F.col(ids), F.col("_to"), F.lit(filler))}).drop("_to")


def padded_positions(positions: Column, to: Column) -> Column:
    """Each axis continued by its last value plus one."""
    return F.transform(positions, lambda axis: pad(axis, to, F.coalesce(F.try_element_at(axis, F.lit(-1)) + 1, F.lit(0))))


def complete_layers(activations: DataFrame, batch: str, sample: str, layer: str) -> DataFrame:
    """(batch, layer) of the layers that every sample of the batch has."""
    all_of = activations.groupBy(batch).agg(F.count_distinct(sample).alias("n"))
    have = activations.groupBy(batch, layer).agg(F.count_distinct(sample).alias("m"))
    return have.join(all_of, batch).where("m = n").select(batch, layer)


def consistent_images(df: DataFrame, ids: str, pad_id: int, images: str) -> DataFrame:
    """Rows with as many image pads as images."""
    return df.where(F.size(F.filter(ids, lambda x: x == pad_id)) == F.size(images))


def image_tokens(grid: Column, merge: int) -> Column:
    """Tokens of an image with (frames, rows, columns) after merging squares of merge * merge."""
    return (grid[0] * F.floor(grid[1] / merge) * F.floor(grid[2] / merge)).cast("int")


def _expanded(items: Column, ids: Column, grids: Column, pad_id: int, merge: int) -> Column:
    """items, one for each id, with those of image pads repeated; the k-th pad takes the k-th grid."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(x == pad_id, i)), lambda i: i.isNotNull())
    count = lambda i, pads: image_tokens(F.try_element_at(grids, F.array_position(pads, i).cast("int")), merge)
    pairs = F.zip_with(items, ids, lambda s, x: F.struct(s.alias("s"), (x == pad_id).alias("pad")))
    return bound(places, lambda pads: F.flatten(F.transform(pairs, lambda p, i: F.when(p["pad"], F.array_repeat(p["s"], count(i, pads))).otherwise(F.array(p["s"])))))


def expanded(ids: Column, grids: Column, pad_id: int, merge: int) -> Column:
    """Each image pad repeated as often as its image has tokens."""
    return _expanded(ids, ids, grids, pad_id, merge)


def token_types(ids: Column, image_id: int, video_id: int) -> Column:
    """0 for text, 1 for image, 2 for video tokens."""
    return F.transform(ids, lambda x: F.when(x == image_id, 1).when(x == video_id, 2).otherwise(0))


def positions_3d(df: DataFrame, key: str, types: str, grids: str, merge: int) -> DataFrame:
    """(key, pos, t, h, w): three-axis positions of every token of each sample.

    Runs of one type are islands. A text run advances the counter by its length, an image run by the
    longer side of its merged grid; the k-th image or video run takes the k-th grid.
    """
    tokens = df.select(key, grids, F.posexplode(types).alias("pos", "type"))
    order = Window.partitionBy(key).orderBy("pos")
    change = (F.coalesce(F.lag("type").over(order), F.lit(-1)) != F.col("type")).cast("int")
    tokens = tokens.withColumn("_c", change).withColumn("run", F.sum("_c").over(order))
    runs = tokens.groupBy(key, "run", "type").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.first(grids).alias("g"))
    by_run = Window.partitionBy(key).orderBy("run")
    runs = runs.withColumn("k", F.sum((F.col("type") > 0).cast("int")).over(by_run)).withColumn("grid", F.when(F.col("type") > 0, F.try_element_at("g", F.col("k").cast("int"))))
    rows, columns = F.floor(F.col("grid")[1] / merge), F.floor(F.col("grid")[2] / merge)
    runs = runs.withColumns({"rows": rows, "cols": columns}).withColumn("step", F.when(F.col("type") == 0, F.col("n")).otherwise(F.greatest("rows", "cols")))
    runs = runs.withColumn("base", F.coalesce(F.sum("step").over(by_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = tokens.select(key, "pos", "run").join(runs.select(key, "run", "type", "start", "rows", "cols", "base"), [key, "run"]).withColumn("o", F.col("pos") - F.col("start"))
    axis = lambda image: F.when(F.col("type") == 0, F.col("base") + F.col("o")).otherwise(F.col("base") + image).cast("int")
    return at.select(key, "pos", axis(F.floor(F.col("o") / (F.col("rows") * F.col("cols")))).alias("t"), axis(F.floor(F.col("o") / F.col("cols")) % F.col("rows")).alias("h"), axis(F.col("o") % F.col("cols")).alias("w"))
