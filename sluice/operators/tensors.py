"""Keyed tensors: key classification, pruning, overrides, parameter counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.expressions import halves

#: Patterns of parameter names, first match wins, as (pattern, type); groups: layer, expert or rest.
KEY_PATTERNS = [
    (r"^(?:model\.language_model\.embed_tokens|model\.embed_tokens)\.weight$", "embedding"),
    (r"^lm_head\.weight$", "lm_head"),
    (r"^model\.(?:language_model\.)?layers\.(\d+)\.mlp\.gate\.", "router"),
    (r"^model\.language_model\.layers\.(\d+)\.mlp\.experts\.", "routed_expert_stack"),
    (r"^model\.layers\.(\d+)\.mlp\.experts\.\d+\.", "routed_expert"),
    (r"^model\.(?:language_model\.)?layers\.(\d+)\.mlp\.shared_expert", "shared_expert"),
    (r"^model\.language_model\.layers\.(\d+)\.(?:self_attn|linear_attn)", "attention"),
    (r"^model\.layers\.(\d+)\..*(?:self_attn|attention)", "attention"),
    (r"^model\.language_model\.layers\.(\d+)\..*norm", "layernorm"),
    (r"^model\.layers\.(\d+)\..*(?:norm|ln)", "layernorm"),
    (r"^model\.(?:language_model\.)?layers\.(\d+)\.", "other"),
    (r"norm", "layernorm"),
]


#: Architectures and model types that the patterns above are for.
ARCHITECTURES = ["Qwen2MoeForCausalLM", "Qwen2MoeModel", "Qwen1.5MoEForCausalLM", "Qwen3_5MoeForConditionalGeneration", "Qwen3_5MoeModel"]
MODEL_TYPES, NESTED_TYPES = ["qwen2_moe", "qwen_moe"], ["qwen3_5_moe", "qwen3_5_moe_text"]
#: Adapters by name: whether a configuration is theirs, and their patterns; more may be registered.
ADAPTERS: dict[str, tuple[Callable[[dict], bool], list[tuple[str, str]]]] = {}


def register_adapter(name: str, detect: Callable[[dict], bool], patterns: list[tuple[str, str]]) -> None:
    ADAPTERS[name] = detect, patterns


def _is_known(config: dict) -> bool:
    kind = config.get("model_type")
    inner = config["text_config"] if isinstance(config.get("text_config"), dict) else config
    if kind in MODEL_TYPES + NESTED_TYPES:
        return bool((inner if kind in NESTED_TYPES else config).get("num_experts"))
    return any(a in (config.get("architectures") or []) for a in ARCHITECTURES)


register_adapter("stacked_experts", _is_known, KEY_PATTERNS)


def adapter_of(config: dict) -> str:
    """The name of the first adapter that knows the configuration; none raises ValueError."""
    for name, (detect, _) in ADAPTERS.items():
        if detect(config):
            return name
    raise ValueError("no adapter knows this configuration")


def edited_config(config: dict, experts: int, per_token: int) -> dict:
    """The configuration of a model with fewer experts; its text part if it has one."""
    nested = isinstance(config.get("text_config"), dict)
    part = config["text_config"] if nested else config
    new = part | {"num_experts": int(experts), "num_experts_per_tok": int(per_token)} | ({"moe_topk": int(per_token)} if "moe_topk" in part else {})
    return config | {"text_config": new} if nested else new


def key_type(key: Column, patterns: list[tuple[str, str]] = KEY_PATTERNS) -> Column:
    found = F.lit("other")
    for pattern, kind in reversed(patterns):
        found = F.when(key.rlike(pattern), kind).otherwise(found)
    return found


def classified(df: DataFrame, key: str = "key") -> DataFrame:
    """Add `layer`, `type` and `expert` of each parameter name."""
    number = lambda pattern: F.expr(f"try_cast(nullif(regexp_extract({key}, '{pattern}', 1), '') as int)")
    layer = number(r"^model\\.(?:language_model\\.)?layers\\.(\\d+)\\.")
    expert = F.when(key_type(F.col(key)) == "routed_expert", number(r"\\.mlp\\.experts\\.(\\d+)\\."))
    return df.withColumns({"layer": layer, "type": key_type(F.col(key)), "expert": expert})


def renamed_expert(key: Column, old: Column, new: Column) -> Column:
    return F.replace(key, F.concat(F.lit(".experts."), old.cast("string"), F.lit(".")), F.concat(F.lit(".experts."), new.cast("string"), F.lit(".")))


def pruned(weights: DataFrame, mapped: DataFrame) -> DataFrame:
    """weights(key, ...) without dropped experts; survivors take the ids of mapped(layer, old_id, new_id).

    Parameters of layers without a mapping pass unchanged.
    """
    rows = classified(weights)
    known = F.broadcast(mapped.select("layer").distinct().withColumn("mapped", F.lit(True)))  # one row per layer
    ids = mapped.withColumnsRenamed({"old_id": "expert"})
    joined = rows.join(known, "layer", "left").join(ids, ["layer", "expert"], "left")
    kept = joined.where((F.col("type") != "routed_expert") | F.col("mapped").isNull() | F.col("new_id").isNotNull())
    key = F.when(F.col("new_id").isNotNull(), renamed_expert(F.col("key"), F.col("expert"), F.col("new_id"))).otherwise(F.col("key"))
    return kept.withColumn("key", key).select(*weights.columns)


def sliced_rows(weights: DataFrame, mapped: DataFrame, row: str = "row") -> DataFrame:
    """Rows (layer, row, ...) of stacked experts or a router along axis 0, kept and renumbered."""
    return weights.join(mapped.withColumnRenamed("old_id", row), ["layer", row]).withColumn(row, F.col("new_id")).drop("new_id")


def overridden(base: DataFrame, snapshot: DataFrame, key: str, value: str) -> DataFrame:
    """The base's keys with the snapshot's value where it has the key (add `overridden`)."""
    new = snapshot.select(F.col(key), F.col(value).alias("_new"), F.lit(True).alias("_has"))
    out = base.join(new, key, "left").withColumn(value, F.when(F.col("_has"), F.col("_new")).otherwise(F.col(value)))
    return out.withColumn("overridden", F.coalesce("_has", F.lit(False))).drop("_new", "_has")


def without_prefixes(df: DataFrame, prefixes: list[str], key: str = "key") -> DataFrame:
    drop = F.lit(False)
    for p in prefixes:
        drop = drop | F.col(key).startswith(p)
    return df.where(~drop)


def parameter_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """Parameters by `keys`: the product of each distinct key's shape, added up."""
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return df.dropDuplicates(["key"]).groupBy(*keys).agg(F.sum(size).alias("parameters"), F.count(F.lit(1)).alias("tensors"))


#: Parts of names that never go to the matrix optimizer, and the least inner side of a stack that does.
PLAIN_NAMES, LEAST_SIDE = ["embed_tokens", "lm_head", "embedding", "embeddings", "wte", "wpe", "lora_A", "lora_B"], 8


def optimizer_part(name: Column, shape: Column) -> Column:
    """Which optimizer a parameter belongs to: matrices, four dimensions and stacks of matrices that aren't thin, else adam."""
    plain = F.lit(False)
    for part in PLAIN_NAMES:
        plain = plain | name.contains(part)
    n = F.size(shape)
    stack = (n == 3) & (F.least(F.get(shape, F.lit(1)), F.get(shape, F.lit(2))) >= LEAST_SIDE)
    return F.when(~plain & ((n == 2) | (n == 4) | F.coalesce(stack, F.lit(False))), "matrix").otherwise("adam")


def matrix_rate(base: Column, rows: Column, columns: Column) -> Column:
    """The rate of a matrix: base * 0.2 * sqrt of its longer side."""
    return base * 0.2 * F.sqrt(F.greatest(rows, columns))


def sample_keys(df: DataFrame, n: int = 16, key: str = "key") -> DataFrame:
    """The first keys, those of feed-forward blocks before others."""
    return df.orderBy(F.col(key).contains("mlp").desc(), key).limit(n)


#: The endings of the names that hold a layer's stacked experts and its router.
EXPERT_ENDINGS, ROUTER_ENDING = {"gate_up_proj": ".mlp.experts.gate_up_proj", "down_proj": ".mlp.experts.down_proj"}, ".mlp.gate.weight"


def expert_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """(layer, gate_up_proj, down_proj): the names of each layer's stacked experts; layers that lack one give no row."""
    rows = df.select(key)
    parts = []
    for name, ending in EXPERT_ENDINGS.items():
        layer = F.regexp_extract(key, r"(?:^|\.)(\d+)" + ending.replace(".", r"\.") + "$", 1)
        parts.append(rows.select(F.nullif(layer, F.lit("")).cast("int").alias("layer"), F.lit(name).alias("name"), key).where("layer is not null"))
    names = list(EXPERT_ENDINGS)
    found = parts[0].unionByName(parts[1]).groupBy("layer").agg(*(F.max(F.when(F.col("name") == n, F.col(key))).alias(n) for n in names))
    return found.where(" and ".join(f"{n} is not null" for n in names))


def router_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """(layer, key): the name of each layer's router."""
    layer = F.nullif(F.regexp_extract(key, r"(?:^|\.)layers\.(\d+)\.", 1), F.lit("")).cast("int")
    rows = df.where(F.col(key).endswith(ROUTER_ENDING)).select(layer.alias("layer"), F.col(key).alias("key")).where("layer is not null")
    return rows.groupBy("layer").agg(F.max("key").alias("key"))


def layer_keys(df: DataFrame, prefix: str, layer: int, key: str = "key") -> DataFrame:
    """The parameters of one layer, by the prefix of their names."""
    return df.where(F.col(key).startswith(f"{prefix}{layer}."))


def layer_stack(df: DataFrame, names: DataFrame, layer: int, name: str, key: str = "key") -> DataFrame:
    """The rows of one layer's stacked experts or router, as doubles, by names(layer, <name>)."""
    wanted = F.broadcast(names.where(F.col("layer") == layer).select(F.col(name).alias(key)))  # one row
    return df.join(wanted, key).withColumn("data", F.col("data").cast("array<double>"))


def prefixed(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Names with `prefix` before them, a dot between."""
    return df.withColumn(key, F.concat(F.lit(prefix.rstrip(".") + "."), F.col(key)))


def by_shard(weight_map: DataFrame) -> DataFrame:
    """(shard, keys, n): the names in each shard of weight_map(key, shard), so that a shard is opened once."""
    return weight_map.groupBy("shard").agg(F.sort_array(F.collect_list("key")).alias("keys"), F.count(F.lit(1)).alias("n"))


def split_gate_up(df: DataFrame, rows: str = "data") -> DataFrame:
    """Stacked gate and up projections as two columns, `gate` and `up`."""
    gate, up = halves(F.col(rows))
    return df.withColumns({"gate": gate, "up": up})


def joined_gate_up(df: DataFrame) -> DataFrame:
    """The inverse: `gate` and `up` one after the other in `data`."""
    return df.withColumn("data", F.concat("gate", "up"))


#: The size of each quantised format as a share of the plain one, that of others, and what headers add.
QUANT_SHARES, OTHER_SHARE, HEADER = {"BF16": 1.00, "F16": 1.00, "Q8_0": 0.53, "Q6_K": 0.41, "Q5_K_M": 0.31, "Q5_K_S": 0.30, "Q4_K_M": 0.27, "Q4_K_S": 0.25, "Q3_K_L": 0.22, "Q3_K_M": 0.20}, 0.55, 1.05


def export_sizes(files: DataFrame, formats: list[str]) -> DataFrame:
    """(format, bytes): the plain export of files(size) and each quantised one, as estimated before writing."""
    plain = files.agg((F.coalesce(F.sum("size"), F.lit(0)) * HEADER).cast("long").alias("plain"))
    shares = F.array(F.struct(F.lit("plain").alias("format"), F.lit(1.0).alias("share")), *(F.struct(F.lit(f).alias("format"), F.lit(QUANT_SHARES.get(f, OTHER_SHARE)).alias("share")) for f in formats))
    return plain.select("plain", F.explode(shares).alias("x")).select("x.format", (F.col("plain") * F.col("x.share")).cast("long").alias("bytes"))
