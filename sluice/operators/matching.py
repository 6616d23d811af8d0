"""Merge plans: similarity of experts and neurons, hosts, one-to-one matching, weighted sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.expressions import dot, unit

#: Bytes of a matrix that is sent to every executor.
KEPT_BYTES = 128 << 20
#: Similarities that a block holds at once.
BLOCK_CELLS = 4_000_000
#: Dropped and kept experts of a tile, and similarities of it that a task holds at once.
TILE_ROWS, TILE_COLUMNS, TILE_CELLS = 2048, 8192, 1 << 20
#: Dropped experts of a tile whose weights are given back one by one.
PLAN_ROWS = 128


def similarities(dropped: DataFrame, kept: DataFrame, vector: str = "vec", eps: float = 1e-12) -> DataFrame:
    """(layer, dropped, kept, sim) of every pair within a layer; experts of a layer are few by nature."""
    units = lambda d, as_: d.select("layer", F.col("expert").alias(as_), unit(F.col(vector), eps).alias(f"u_{as_}"))
    return units(dropped, "dropped").join(units(kept, "kept"), "layer").select("layer", "dropped", "kept", dot(F.col("u_dropped"), F.col("u_kept")).alias("sim"))


def softmax_weights(sims: DataFrame, tau: float = 0.1) -> DataFrame:
    """Add `w`: the softmax of a dropped expert's similarities."""
    row = Window.partitionBy("layer", "dropped")
    raised = F.exp((F.col("sim") - F.max("sim").over(row)) / max(tau, 1e-6))
    return sims.withColumn("_e", raised).withColumn("w", F.col("_e") / F.sum("_e").over(row)).drop("_e")


def _tiles(dropped: DataFrame, kept: DataFrame, rows: int, run: Callable[[pa.Table, pa.Table], dict], schema: str) -> DataFrame:
    """run(left, right) over tiles of each layer: about `rows` dropped and TILE_COLUMNS kept experts, every pair of them in one tile.

    dropped and kept hold (layer, expert, vec) and more; vec is null in the tile where it or an element of it is.
    """
    sizes = dropped.groupBy("layer").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_rows")).join(kept.groupBy("layer").agg(F.ceil(F.count(F.lit(1)) / TILE_COLUMNS).cast("int").alias("_columns")), "layer")
    sizes = F.broadcast(sizes)  # a row a layer
    place = lambda n: F.pmod(F.xxhash64("expert"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = F.when(F.forall("vec", lambda x: x.isNotNull()), F.col("vec").cast("array<double>"))
    d = dropped.withColumn("vec", known).join(sizes, "layer").withColumn("_row", place("_rows")).withColumn("_column", every("_columns"))
    k = kept.withColumn("vec", known).join(sizes, "layer").withColumn("_column", place("_columns")).withColumn("_row", every("_rows"))
    keys = ["layer", "_row", "_column"]
    types = dict(part.rsplit(" ", 1) for part in (f"layer {dict(dropped.dtypes)['layer']}, " + schema).split(", "))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = run(left, right) if left.num_rows and right.num_rows else {}
        if not found:
            return pa.table({name: [] for name in types})
        n = len(next(iter(found.values())))
        layer = left["layer"].slice(0, 1).combine_chunks()
        return pa.table({"layer": layer.take(pa.array(np.zeros(n, np.int64))), **found})

    d, k = (side.drop("_rows", "_columns") for side in (d, k))
    d, k = d.toDF(*d.columns), k.toDF(*k.columns)  # both may come from one table, whose columns would be ambiguous
    return d.groupBy(*keys).cogroup(k.groupBy(*keys)).applyInArrow(tile, ", ".join(f"{a} {b}" for a, b in types.items()))


def _vectors(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width; those that are null have none."""
    vectors = table["vec"].combine_chunks()
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    places = {int(w): np.flatnonzero(widths == w) for w in np.unique(widths) if w >= 0}
    return {w: (at, pc.list_flatten(vectors.take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(len(at), w)) for w, at in places.items()}


def _cosines(left: pa.Table, right: pa.Table, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places left, their vectors, places right, similarities), block by block; vectors of unlike widths have none."""
    units = lambda m: m / np.maximum(np.sqrt((m * m).sum(axis=1)), eps)[:, None]
    others = {w: (at, units(m)) for w, (at, m) in _vectors(right).items()}
    for w, (at, m) in _vectors(left).items():
        if w in others:
            to, v = others[w]
            step = max(1, TILE_CELLS // len(to))
            for i in range(0, len(at), step):
                yield at[i : i + step], m[i : i + step], to, units(m[i : i + step]) @ v.T


def _with_tops(dropped: DataFrame, kept: DataFrame, tau: float, eps: float) -> DataFrame:
    """Add `top` and `z`: the greatest similarity of each dropped expert in its layer, and the sum under its softmax."""

    def tops(left, right):
        out = [(at, s.max(axis=1), np.exp((s - s.max(axis=1)[:, None]) / tau).sum(axis=1)) for at, _, _, s in _cosines(left, right, eps)]
        if not out:
            return {}
        at, top, z = map(np.concatenate, zip(*out, strict=True))
        return {"expert": left["expert"].combine_chunks().take(pa.array(at)), "top": top, "z": z}

    parts = _tiles(dropped, kept, TILE_ROWS, tops, f"expert {dict(dropped.dtypes)['expert']}, top double, z double")
    both = parts.groupBy("layer", "expert").agg(F.max("top").alias("top"), F.collect_list(F.struct("top", "z")).alias("_parts"))
    z = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p["z"] * F.exp((p["top"] - F.col("top")) / tau))
    return dropped.join(both.select("layer", "expert", "top", z.alias("z")), ["layer", "expert"], "left")


def cosine_weighted_sums(kept: DataFrame, dropped: DataFrame, tau: float, alpha: float, eps: float = 1e-12) -> DataFrame:
    """(layer, kept, i, value): weighted_sums under the softmax_weights of the similarities, whose pairs never become rows.

    kept and dropped hold (layer, expert, vec), a row an expert. Similarities are made by tiles of a matrix product, once
    for the greatest and the sum of each dropped expert, once for its share in each kept one.
    """
    tau = max(tau, 1e-6)

    def shares(left, right):
        top, z = (left[c].to_numpy() for c in ("top", "z"))
        sums = {}
        for at, m, to, s in _cosines(left, right, eps):
            found = (np.exp((s - top[at, None]) / tau) / z[at, None]).T @ m
            sums[m.shape[1]] = (to, found if m.shape[1] not in sums else sums[m.shape[1]][1] + found)
        if not sums:
            return {}
        at = np.concatenate([to for to, _ in sums.values()])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.full(len(to), w) for w, (to, _) in sums.items()]))]).astype(np.int32)
        y = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([found.ravel() for _, found in sums.values()])))
        return {"expert": right["expert"].combine_chunks().take(pa.array(at)), "part": left["_row"].combine_chunks().take(pa.array(np.zeros(len(at), np.int64))), "y": y}

    slim = lambda d: d.select("layer", "expert", "vec")
    rated = _with_tops(slim(dropped), slim(kept), tau, eps)
    parts = _tiles(rated, slim(kept), TILE_ROWS, shares, f"expert {dict(kept.dtypes)['expert']}, part int, y array<double>")
    whole = parts.groupBy("layer", "expert").agg(F.sort_array(F.collect_list(F.struct("part", "y"))).alias("_y"))
    added = whole.select("layer", "expert", F.aggregate(F.slice("_y", 2, 1 << 30), F.col("_y")[0]["y"], lambda a, p: F.zip_with(a, p["y"], lambda x, y: x + y)).alias("_y"))
    value = F.transform("vec", lambda x, i: x.cast("double") + alpha * F.coalesce(F.get("_y", i), F.lit(0.0)))
    return slim(kept).join(added, ["layer", "expert"], "left").select("layer", F.col("expert").alias("kept"), F.posexplode(value).alias("i", "value"))


def cooccurrence_weights(pairs: DataFrame) -> DataFrame:
    """Add `w`: each (layer, dropped, kept, cnt) over its row's sum; rows of zeros become uniform."""
    row = Window.partitionBy("layer", "dropped")
    return pairs.withColumn("w", F.when(F.sum("cnt").over(row) == 0, 1 / F.count(F.lit(1)).over(row)).otherwise(F.col("cnt") / F.greatest(F.sum("cnt").over(row), F.lit(1e-12))))


def hosts(sims: DataFrame) -> DataFrame:
    """(layer, dropped, host): the most similar kept expert, ties to the smaller id."""
    best = F.max(F.struct("sim", (-F.col("kept")).alias("k")))
    return sims.groupBy("layer", "dropped").agg(best.alias("b")).select("layer", "dropped", (-F.col("b.k")).alias("host"), F.col("b.sim").alias("sim"))


def alpha_scale(usage: DataFrame, dropped: DataFrame) -> DataFrame:
    """Add `scale`: a dropped expert's usage over the mean of its layer's dropped; 1 where that is 0.

    Layers without usage give no row.
    """
    known = usage.select("layer").distinct()
    rows = dropped.join(known, "layer").join(usage, ["layer", "expert"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    mean = F.avg("cnt").over(Window.partitionBy("layer"))
    return rows.withColumn("scale", F.when(mean <= 0, 1.0).otherwise(F.col("cnt") / mean))


def local_matches(dropped: DataFrame, kept: DataFrame, host: DataFrame, least: float) -> DataFrame:
    """(layer, dropped, neuron, host, host_neuron, sim, hosted): each neuron's best in its expert's host.

    dropped and kept hold (layer, expert, neuron, vec) with unit vectors.
    """
    d = dropped.select("layer", F.col("expert").alias("dropped"), "neuron", F.col("vec").alias("a")).join(host.select("layer", "dropped", "host"), ["layer", "dropped"])
    k = kept.select("layer", F.col("expert").alias("host"), F.col("neuron").alias("host_neuron"), F.col("vec").alias("b"))
    sims = d.join(k, ["layer", "host"]).select("layer", "dropped", "neuron", "host", "host_neuron", dot(F.col("a"), F.col("b")).alias("sim"))
    best = sims.groupBy("layer", "dropped", "neuron", "host").agg(F.max(F.struct("sim", (-F.col("host_neuron")).alias("n"))).alias("m"))
    return best.select("layer", "dropped", "neuron", "host", (-F.col("m.n")).alias("host_neuron"), F.col("m.sim").alias("sim"), (F.col("m.sim") >= least).alias("hosted"))


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, the largest first, ties to the smaller place; without sorting the rest."""
    if len(row) <= k:
        return np.argsort(-row, kind="stable")
    least = np.partition(row, len(row) - k)[len(row) - k]
    some = np.flatnonzero(row >= least)
    return some[np.argsort(-row[some], kind="stable")][:k]


def top_candidates(dropped: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """(row, slot, col, sim): the k most similar kept rows of each dropped row, by blocks of a matrix product.

    dropped(row, vec) and kept(col, vec) hold unit vectors. The kept side goes to the executors as a matrix of
    KEPT_BYTES at most; a larger one goes in as many blocks as it takes, whose best are then put together.
    """
    found = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    size = 8 * found["n"] * (found["width"] or 0)
    blocks = max(1, -(-size // KEPT_BYTES))
    step = max(1, min(1024, BLOCK_CELLS * blocks // max(1, found["n"])))
    schema = "row long, col long, sim double"
    out = None
    for b in range(blocks):
        part = kept.where(F.pmod(F.xxhash64("col"), F.lit(blocks)) == b).orderBy("col").collect()
        ids, matrix = np.array([r["col"] for r in part], np.int64), np.array([r["vec"] for r in part], np.float64)
        shared = dropped.sparkSession.sparkContext.broadcast((ids, matrix))

        def block(frames, shared=shared):
            ids, matrix = shared.value
            for frame in frames:
                for at in range(0, len(frame) if len(ids) else 0, step):
                    rows = frame.iloc[at : at + step]
                    sims = np.array(rows["vec"].tolist(), np.float64) @ matrix.T
                    order = np.array([_first(row, k) for row in sims])
                    yield pd.DataFrame({"row": np.repeat(rows["row"].to_numpy(), order.shape[1]), "col": ids[order].ravel(), "sim": np.take_along_axis(sims, order, 1).ravel()})

        best = dropped.select("row", "vec").mapInPandas(block, schema)
        out = best if out is None else out.unionByName(best)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("sim"), "col")) - 1  # k rows a block
    return out.withColumn("slot", place).where(F.col("slot") < k).select("row", "slot", "col", "sim")


def greedy_matching(candidates: DataFrame, group: str) -> DataFrame:
    """One-to-one matches of (group, row, slot, col, sim): rows by best similarity, each its first free column."""

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        frame = frame.sort_values(["row", "slot"])
        best = frame.groupby("row")["sim"].first().reset_index().sort_values(["sim", "row"], ascending=[False, True])
        by_row = dict(tuple(frame.groupby("row")))
        for row in best["row"]:
            for col, sim in zip(by_row[row]["col"], by_row[row]["sim"], strict=True):
                if col not in taken:
                    taken.add(col)
                    out.append((frame[group].iloc[0], row, col, sim))
                    break
        return pd.DataFrame(out, columns=[group, "row", "col", "sim"])

    schema = f"{group} {dict(candidates.dtypes)[group]}, row long, col long, sim double"
    return candidates.groupBy(group).applyInPandas(match, schema)


def hungarian(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a least-cost assignment of an n * m matrix with n <= m."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = ~used[1:]
            reduced = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[1:][free] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


def block_matching(candidates: DataFrame, group: str, block: int = 1024) -> DataFrame:
    """One-to-one matches: rows by best similarity in blocks, each block assigned at least cost.

    Columns that an earlier block took are gone; pairs that aren't candidates are never matched.
    """

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "slot"])
        best = frame.groupby("row")["sim"].max().reset_index().sort_values(["sim", "row"], ascending=[False, True])["row"].to_numpy()
        taken, out = set(), []
        for at in range(0, len(best), block):
            rows = best[at : at + block]
            part = frame[frame["row"].isin(rows) & ~frame["col"].isin(taken)]
            cols = np.unique(part["col"])
            cost = np.full((len(rows), len(cols) + len(rows)), 1e3)  # a column of its own leaves a row unmatched
            cost[:, : len(cols)] = 1e6
            cost[pd.Index(rows).get_indexer(part["row"]), np.searchsorted(cols, part["col"])] = -part["sim"]
            sims = {(r, c): s for r, c, s in zip(part["row"], part["col"], part["sim"], strict=True)}
            for row, place in zip(rows, hungarian(cost), strict=True):
                if place < len(cols):
                    taken.add(cols[place])
                    out.append((frame[group].iloc[0], row, cols[place], sims[row, cols[place]]))
        return pd.DataFrame(out, columns=[group, "row", "col", "sim"])

    schema = f"{group} {dict(candidates.dtypes)[group]}, row long, col long, sim double"
    return candidates.groupBy(group).applyInPandas(match, schema)


def match_stats(matches: DataFrame) -> DataFrame:
    """Of each layer: neurons, hosted, below the threshold, mean and linear quantiles of hosted similarity, most guests of a host neuron."""
    sim = F.when(F.col("hosted"), F.col("sim"))
    loads = matches.where("hosted").groupBy("layer", "host", "host_neuron").agg(F.count(F.lit(1)).alias("n")).groupBy("layer").agg(F.max("n").alias("max_load"))
    stats = matches.groupBy("layer").agg(F.count(F.lit(1)).alias("total"), F.count_if("hosted").alias("hosted"), F.count_if(~F.col("hosted")).alias("below"), F.coalesce(F.avg(sim), F.lit(0.0)).alias("sim_mean"), F.coalesce(F.percentile(sim, 0.1), F.lit(0.0)).alias("sim_p10"), F.coalesce(F.percentile(sim, 0.9), F.lit(0.0)).alias("sim_p90"))
    return stats.join(loads, "layer", "left").withColumn("max_load", F.coalesce("max_load", F.lit(0)))


def merge_warnings(stats: DataFrame, least_rate: float = 0.10, most_load: int = 32) -> DataFrame:
    """(layer, warning, value): layers where few neurons found a host, or one host took many."""
    rate = F.col("hosted") / F.greatest(F.col("total"), F.lit(1))
    found = F.array(
        F.when((rate < least_rate) & (F.col("total") > 0), F.struct(F.lit("few hosted").alias("warning"), rate.alias("value"))),
        F.when(F.col("max_load") >= most_load, F.struct(F.lit("crowded host").alias("warning"), F.col("max_load").cast("double").alias("value"))),
    )
    return stats.select("layer", F.explode(F.array_compact(found)).alias("x")).select("layer", "x.*")


def merge_plan(weights: DataFrame, alpha: float) -> DataFrame:
    """(layer, json): each layer's dropped and surviving experts and the weights (dropped, kept, w) between them."""
    ids = lambda c: F.sort_array(F.collect_set(c))
    triples = F.sort_array(F.collect_list(F.struct("dropped", "kept", "w")))
    rows = weights.groupBy("layer").agg(ids("dropped").alias("dropped"), ids("kept").alias("surviving"), triples.alias("weights"))
    return rows.select("layer", F.to_json(F.struct(F.lit(alpha).alias("alpha"), "dropped", "surviving", "weights")).alias("json"))


def merge_plan_heads(dropped: DataFrame, kept: DataFrame, alpha: float) -> DataFrame:
    """(layer, json): a layer's dropped and surviving experts; merge_plan_weights has the rest of a plan whose pairs are too many for one text."""
    ids = lambda d, as_: d.groupBy("layer").agg(F.sort_array(F.collect_set("expert")).alias(as_))
    return ids(dropped, "dropped").join(ids(kept, "surviving"), "layer").select("layer", F.to_json(F.struct(F.lit(alpha).alias("alpha"), "dropped", "surviving")).alias("json"))


def merge_plan_weights(dropped: DataFrame, kept: DataFrame, tau: float, eps: float = 1e-12) -> DataFrame:
    """(layer, dropped, json): the softmax_weights of each dropped expert, as the lists `kept` and `w`.

    An expert has a row for every TILE_COLUMNS kept ones or so; a weight is null if its vectors can't be compared.
    """
    tau = max(tau, 1e-6)

    def weights(left, right):
        right = right.sort_by("expert")
        n, m = left.num_rows, right.num_rows
        w, known = np.zeros((n, m)), np.zeros((n, m), bool)
        top, z = (left[c].to_numpy() for c in ("top", "z"))
        for at, _, to, s in _cosines(left, right, eps):
            w[np.ix_(at, to)] = np.exp((s - top[at, None]) / tau) / z[at, None]
            known[np.ix_(at, to)] = True
        texts = pa.array(w.ravel(), mask=None if known.all() else ~known.ravel(), from_pandas=False).cast(pa.string())
        if not np.isfinite(w).all():
            texts = pc.if_else(pa.array(np.isnan(w.ravel())), '"NaN"', texts)
        lists = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pc.fill_null(texts, "null")), ",")
        expert, ids = left["expert"].combine_chunks(), ",".join(map(str, right["expert"].to_pylist()))
        return {"dropped": expert, "json": pc.binary_join_element_wise('{"dropped":', expert.cast(pa.string()), f',"kept":[{ids}],"w":[', lists, "]}", "")}

    slim = lambda d: d.select("layer", "expert", "vec")
    return _tiles(_with_tops(slim(dropped), slim(kept), tau, eps), slim(kept), PLAN_ROWS, weights, f"dropped {dict(dropped.dtypes)['expert']}, json string")


def complement(every: DataFrame, surviving: DataFrame) -> DataFrame:
    """(layer, expert): the experts of `every` that don't survive."""
    return every.select("layer", "expert").distinct().join(surviving.select("layer", "expert"), ["layer", "expert"], "left_anti")


#: How dropped neurons find a host, by name.
STRATEGIES = {"local": local_matches, "global_greedy": lambda c, group: greedy_matching(c, group), "block_hungarian": lambda c, group, block=1024: block_matching(c, group, block)}
#: How whole experts are weighted, by name.
WEIGHTINGS = {"cosine": softmax_weights, "cooccurrence": cooccurrence_weights}


def strategy(name: str):
    """The matching or weighting of a name; an unknown one raises ValueError."""
    found = STRATEGIES.get(name) or WEIGHTINGS.get(name)
    if found is None:
        raise ValueError(f"unknown merge strategy: {name}")
    return found


def load_histogram(matches: DataFrame, places: DataFrame) -> DataFrame:
    """(layer, load, n): kept neurons of places(layer, host, host_neuron) by guests, 4 meaning 4 or more."""
    guests = matches.where("hosted").groupBy("layer", "host", "host_neuron").agg(F.count(F.lit(1)).alias("guests"))
    loads = places.join(guests, ["layer", "host", "host_neuron"], "left").select("layer", F.least(F.coalesce("guests", F.lit(0)), F.lit(4)).cast("int").alias("load"))
    return loads.groupBy("layer", "load").agg(F.count(F.lit(1)).alias("n"))


def overall(stats: DataFrame) -> DataFrame:
    """Totals over layers and the mean similarity weighted by hosted neurons."""
    return stats.agg(F.sum("total").alias("total"), F.sum("hosted").alias("hosted"), F.coalesce(F.sum(F.col("sim_mean") * F.col("hosted")) / F.nullif(F.sum("hosted"), F.lit(0)), F.lit(0.0)).alias("sim_mean"))


def scattered(matches: DataFrame, columns: DataFrame, scale: Column) -> DataFrame:
    """(layer, host, host_neuron, h, value): hosted neurons' columns (layer, dropped, neuron, h, x) added up."""
    return matches.where("hosted").join(columns, ["layer", "dropped", "neuron"]).groupBy("layer", "host", "host_neuron", "h").agg(F.sum(F.col("x") * scale).alias("value"))


def weighted_sums(kept: DataFrame, dropped: DataFrame, weights: DataFrame, alpha: float) -> DataFrame:
    """(layer, kept, i, value): kept element + alpha * the weighted sum of dropped elements."""
    added = weights.join(dropped.select("layer", F.col("expert").alias("dropped"), "i", "x"), ["layer", "dropped"]).groupBy("layer", "kept", "i").agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    return kept.select("layer", F.col("expert").alias("kept"), "i", "x").join(added, ["layer", "kept", "i"], "left").select("layer", "kept", "i", (F.col("x") + alpha * F.coalesce("y", F.lit(0.0))).alias("value"))
