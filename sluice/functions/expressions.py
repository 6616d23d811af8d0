"""Column expressions that the operators share; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the stripping of text counts as white space beyond the Unicode property.
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(text: Column) -> Column:
    """Text without Unicode white space at its ends."""
    return F.regexp_replace(text, _EDGES, "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return text.isNull() | (strip(text) == "")


def first_truthy(*columns: Column) -> Column:
    """The first column that is neither null nor an empty string."""
    return F.coalesce(*(F.when(c != "", c) for c in columns))


def token_count(text: Column) -> Column:
    """The default token counter: runs of characters that aren't white space."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, r"[ \t\n\x0B\f\r]+"), ""))).cast("long")


def holdout(sample_id: Column, share: float) -> Column:
    """Whether an id belongs to the validation part: first 32 bits of its SHA-1 over 2**32 - 1, below `share`."""
    if not 0 <= share < 0.5:
        raise ValueError("share must be in [0, 0.5)")
    return F.lit(False) if share == 0 else F.conv(F.substring(F.sha1(sample_id.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0) < share


def nearest_rank(values: Column, q: float) -> Column:
    """The element of a sorted array at index round-half-even(q * (n - 1)); null for an empty array."""
    place = F.rint(F.lit(q) * (F.size(values) - 1)).cast("int") + 1
    return F.try_element_at(F.sort_array(values), F.greatest(place, F.lit(1)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(values: Column) -> Column:
    return F.sqrt(dot(values, values))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine of two vectors; each norm is at least eps."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, also where `use` has it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unit(values: Column, eps: float = 1e-12) -> Column:
    """A vector over its norm, which is at least eps."""
    return bound(F.greatest(norm(values), F.lit(eps)), lambda n: F.transform(values, lambda x: x.cast("double") / n))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    """Shifted by the maximum; the temperature is at least 1e-6. Linear in the width."""
    t = max(temperature, 1e-6)
    raised = bound(F.array_max(values).cast("double"), lambda top: F.transform(values, lambda x: F.exp((x.cast("double") - top) / t)))
    return bound(raised, lambda r: bound(total(r), lambda s: F.transform(r, lambda x: x / s)))


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def top_indices(values: Column, k: int) -> Column:
    """Indices of the k largest values, ties to the smaller index."""
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])


def pad(values: Column, to: Column, filler: Column) -> Column:
    """An array extended at its end to `to` elements."""
    return F.concat(values, F.array_repeat(filler, F.greatest(to - F.size(values), F.lit(0)).cast("int")))


def bucket_of(n: Column, edges: Sequence[int]) -> Column:
    """The first i with n <= edges[i + 1]; null above the last edge."""
    found = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        found = F.when(n <= edges[i + 1], F.lit(i)).otherwise(found)
    return found


def layer_spec(spec: str | None, layers: int, n: int = 1) -> list[int]:
    """Layers named by `all` or nothing, `every_<k>`, `every_n` or `every_layer_interval`, `block_<k>`, or a list.

    Steps are at least 1. A list, in brackets or with a comma, comes back sorted without repeats.
    """
    spec = (spec or "").strip().lower()
    if spec in ("", "all"):
        return list(range(layers))
    kind, _, rest = spec.partition("_")
    named = spec in ("every_n", "every_layer_interval")
    if named or kind in ("every", "block") and rest.isdecimal():
        step = max(1, n if named else int(rest))
        return list(range(step - 1 if kind == "block" else 0, layers, step))
    if spec.startswith("[") or "," in spec:
        return sorted({int(x) for x in spec.strip("[]").split(",") if x.strip()})
    raise ValueError(f"unknown layers: {spec!r}")


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A key whose order is a seeded shuffle that any cluster repeats."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def safe_name(sample_id: Column) -> Column:
    """An id with everything but letters, digits, dot, underscore and hyphen replaced by an underscore."""
    return F.regexp_replace(sample_id, r"[^A-Za-z0-9._-]", "_")


def local_path(uri: Column) -> Column:
    """The path of a file URI, with the slash before a drive letter removed; other strings as they are."""
    path = F.regexp_replace(uri, "^file://", "")
    return F.when(uri.startswith("file://"), F.when(path.rlike("^/[A-Za-z]:"), F.substring(path, 2, 1 << 30)).otherwise(path)).otherwise(uri)


def learning_rate(step: Column, kind: str, warmup: int, steps: int, least: float = 0.1) -> Column:
    """The factor of the base rate at a step: linear warm-up, then cosine, linear or constant."""
    if kind not in ("cosine", "linear", "constant") or not 0 <= least <= 1:
        raise ValueError("unknown schedule, or least share outside 0..1")
    progress = F.least(F.greatest((step - warmup) / float(max(1, steps - warmup)), F.lit(0.0)), F.lit(1.0))
    later = {
        "constant": F.lit(1.0),
        "cosine": F.lit(least) + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress)),
        "linear": F.greatest(F.lit(least), 1 - progress * (1 - least)),
    }[kind]
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(later) if warmup > 0 else later


def micro_step(place: Column, accumulate: int) -> Column:
    """The optimizer step that a micro-step belongs to."""
    return F.floor(place / max(1, accumulate)).cast("long")


def halves(values: Column) -> tuple[Column, Column]:
    """The two halves of an array; the first is the shorter one of an odd length."""
    n = F.floor(F.size(values) / 2).cast("int")
    return F.slice(values, F.lit(1), n), F.slice(values, n + 1, F.size(values) - n)


def reshaped(values: Column, width: int) -> Column:
    """A flat array as rows of `width`; null if it doesn't divide."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / width).cast("int") - 1), lambda i: F.slice(values, i * width + 1, F.lit(width)))
    return F.when(F.size(values) == 0, F.array().cast("array<array<double>>")).when(F.size(values) % width == 0, rows)


def squeezed(values: Column, kind: str = "float") -> Column:
    """An array of matrices without its leading dimension if that is one, else null; elements as `kind`."""
    return F.when(F.size(values) == 1, F.transform(values[0], lambda row: row.cast(f"array<{kind}>")))


#: How paths name a layer, first match wins.
LAYER_PATTERNS = [r"(?i)cache[_\-]?layer[_\-]?(\d+)", r"(?i)layer[s]?[_\-.]?(\d+)", r"(?i)block[_\-.]?(\d+)", r"(?i)decoder[_\-.]?layer[_\-.]?(\d+)", r"^(\d+)$"]


def layer_of_path(path: Column) -> Column:
    """The layer that an array of path elements names: the last element that names one wins."""

    def number(text: Column) -> Column:
        found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in LAYER_PATTERNS]
        return F.coalesce(*found).try_cast("int")

    return F.try_element_at(F.array_compact(F.transform(F.reverse(path), number)), F.lit(1))


def smart_size(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """struct(height, width): both rounded to multiples of `factor`, with an area between `least` and `most` pixels.

    The aspect ratio is kept as far as the rounding allows; sides longer than 200 times the other are rejected.
    """
    area = (height * width).cast("double")
    near = lambda x: F.greatest(F.lit(factor), F.rint(x / factor) * factor)
    shrink, grow = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor)
    up = lambda x: F.ceil(x * grow / factor) * factor
    size = near(height) * near(width)
    side = lambda x: F.when(size > most, down(x)).when(size < least, up(x)).otherwise(near(x)).cast("int")
    fits = F.greatest(height, width) <= 200 * F.least(height, width)
    return F.when(fits, F.struct(side(height).alias("height"), side(width).alias("width")))
