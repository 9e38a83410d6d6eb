"""Labels, tags, keys and digests as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothing_hz(label: Column, raw_hz: float | None = None, strict: bool = False) -> Column:
    """Hz of a smoothing label (`raw`, `30Hz`, `12p5Hz`); raw and invalid labels give `raw_hz`, but with `strict` invalid ones are an error.

    Then a label that is empty, or whose rate is 0, is invalid too.
    """
    text = F.replace(F.regexp_extract(F.lower(F.trim(label)), "^([0-9]+(?:[.p][0-9]+)?)(?:hz)?$", 1), F.lit("p"), F.lit("."))
    hz = F.when(text != "", text).try_cast("double")
    if strict:
        wrong = (F.lower(F.trim(label)) != "raw") & ~F.coalesce(hz > 0, F.lit(False))
        hz = F.when(F.coalesce(wrong, F.lit(True)), F.raise_error(F.concat(F.lit("invalid smoothing level: "), F.coalesce(label, F.lit("null"))))).otherwise(hz)
    return F.coalesce(hz, F.lit(raw_hz).cast("double"))


def smoothing_label(hz: Column) -> Column:
    """`30Hz`, `12p5Hz`; null is `raw`."""
    text = F.when(hz == F.floor(hz), F.floor(hz).cast("string")).otherwise(hz.cast("string"))
    return F.coalesce(F.concat(F.replace(text, F.lit("."), F.lit("p")), F.lit("Hz")), F.lit("raw"))


def smoothing_rank(label: Column) -> Column:
    """Sort key: raw first, then Hz from high to low."""
    return F.when(F.lower(label) == "raw", F.lit(float("-inf"))).otherwise(-smoothing_hz(label, 0.0))


def method_key(base: Column, label: Column) -> Column:
    """`base::label`, or `base` without a label."""
    return F.concat_ws("::", base, F.when(label != "", label))


def method_base(key: Column) -> Column:
    return F.split_part(key, F.lit("::"), F.lit(1))


def method_variant(key: Column) -> Column:
    return F.split_part(key, F.lit("::"), F.lit(2))


def method_rank(key: Column, order: list[str]) -> Column:
    """Place of the method in the caller's order, from 1; methods that it lacks come after it."""
    at = F.array_position(F.array(*map(F.lit, order)), method_base(key))
    return F.when(at == 0, len(order) + 1).otherwise(at)


def model_parameters(name: Column) -> dict[str, Column]:
    """k, rate, smooth, duty and seed base in a model name like `k1_r12_s2p0_d0p45_sb11000`; null without a match."""
    pattern = "k([0-9]+)_r([0-9]+)_s([0-9]+p[0-9]+)_d([0-9]+p[0-9]+)_sb([0-9]+)"
    one = lambda g: F.replace(F.regexp_extract(name, pattern, g), F.lit("p"), F.lit("."))
    return {c: F.when(one(g) != "", one(g)).try_cast("double") for g, c in enumerate(("k", "rate", "smooth", "duty", "seed_base"), 1)}


def tag_epoch(tag: Column) -> Column:
    """Epoch id of a cache tag: up to `_epoch<n>`, else the text before `_s..._ms<d>`, else the tag."""
    explicit = F.regexp_extract(tag, "^(.*_epoch[0-9]+)", 1)
    before = F.regexp_replace(tag, "_s[^_]*_ms[0-9]+.*$", "")
    return F.when(explicit != "", explicit).when(before != "", before).otherwise(tag)


def tag_stem(tag: Column) -> Column:
    return F.regexp_replace(tag_epoch(tag), "_epoch[0-9]+$", "")


def tag_trial(tag: Column) -> Column:
    text = F.regexp_extract(tag, "_trial([0-9]+)", 1)
    return F.when(text != "", text).try_cast("long")


def infer_dataset(name: Column, pattern: str) -> Column:
    """First group of the pattern in a file's stem, else the stem."""
    stem = F.regexp_replace(F.regexp_replace(name, "^.*/", ""), "\\.[^.]*$", "")
    found = F.regexp_extract(stem, pattern, 1)
    return F.when(found != "", found).otherwise(stem)


def tag_token(value: Column) -> Column:
    """A parameter in a tag: `.` as `p`, blanks as `_`."""
    return F.replace(F.replace(value, F.lit("."), F.lit("p")), F.lit(" "), F.lit("_"))


def number_text(value: Column, digits: int = 6) -> Column:
    """A number in at most `digits` significant digits without trailing zeros, as tags have it: 9, 1.3, 0.35, 1e-05, 1e+06; null stays null.

    The binary value itself is rounded, as by `%g`: 1.000025 lies below its decimal form and gives 1.00002. Of two equally near, the even one.
    """

    @F.pandas_udf("string")
    def general(values: pd.Series) -> pd.Series:
        return pd.Series([f"{x:.{digits}g}" for x in values])

    return F.when(value.isNotNull(), general(value.cast("double")))


def sanitized(value: Column) -> Column:
    """Text as part of a file name: trimmed, blanks and `/` as `_`, `.` as `p`."""
    return F.translate(F.trim(value), " ./", "_p_")


def float_text(value: Column) -> Column:
    """A number as `12.5` or `30.0`, as run tags have it."""
    return value.cast("double").cast("string")


def run_tag(methods: Column, order: list[tuple[str, str]], rates: dict[str, Column], marks: dict[str, Column] | None = None) -> Column:
    """Tag of a run from the `methods` array of its lower-case method names: a token for each of `order(method, name)` that is among them.

    A method with a rate in `rates` has it in its token (`<name>30p0`), or `raw` (the text after `|` of the name, if it has one) without;
    `marks` (method -> text) follow. `no_methods` without any.
    """
    tokens = []
    for method, name in order:
        name, _, none = name.partition("|")
        token = F.lit(name)
        if method in rates:
            token = F.concat(token, F.coalesce(F.replace(float_text(rates[method]), F.lit("."), F.lit("p")), F.lit(none or "raw")))
        if marks and method in marks:
            token = F.concat(token, F.coalesce(marks[method], F.lit("")))
        tokens.append(F.when(F.array_contains(methods, method), token))
    return F.coalesce(F.nullif(F.concat_ws("_", *tokens), F.lit("")), F.lit("no_methods"))


def cache_tag(dataset: Column, label: Column, most: Column, fs: Column, sigma: Column) -> Column:
    """`<dataset>_s<label>_ms<most>_rs<fs or raw>_bm<sigma>`, numbers in six and three significant digits."""
    rate = F.coalesce(tag_token(number_text(fs)), F.lit("raw"))
    return F.concat(dataset, F.lit("_s"), tag_token(label), F.lit("_ms"), most.cast("string"), F.lit("_rs"), rate, F.lit("_bm"), tag_token(number_text(sigma, 3)))


def combo_tag(run: Column, rate: Column, smooth: Column, duty: Column, seed: Column) -> Column:
    """`<run>_r<rate>_s<smooth>_d<duty>_sb<seed>` of a sweep's combination, as `parse_combo` reads it."""
    part = lambda x: sanitized(number_text(x))
    return F.concat(sanitized(run), F.lit("_r"), part(rate), F.lit("_s"), part(smooth), F.lit("_d"), part(duty), F.lit("_sb"), seed.cast("long").cast("string"))


def parse_combo(tag: Column) -> dict[str, Column]:
    """run, rate, smooth, duty and seed of a tag of `combo_tag`; null without a match."""
    pattern = "^(.*)_r([-+0-9pe]+)_s([-+0-9pe]+)_d([-+0-9pe]+)_sb(-?[0-9]+)$"
    one = lambda g: F.nullif(F.regexp_extract(tag, pattern, g), F.lit(""))
    number = lambda g: F.replace(one(g), F.lit("p"), F.lit(".")).try_cast("double")
    return {"run": one(1), "rate": number(2), "smooth": number(3), "duty": number(4), "seed": one(5).try_cast("long")}


def events_per_bin(target: Column, native: float) -> Column:
    """Greatest number of events a bin may hold at the target rate; null is the native rate. A rate of 0 or less is an error."""
    r = F.greatest(F.lit(native) / target, F.lit(1.0))
    half = F.ceil(r / 2)
    near = lambda x, atol: F.abs(target - x) <= atol + 1e-5 * x
    return (
        F.when(target.isNull() | near(native, 1e-8), F.lit(2))
        .when(target <= 0, F.raise_error(F.lit("a target rate must be above 0")).cast("int"))
        .when(near(30.0, 0.1), F.greatest(F.lit(4), half + 1))
        .when(near(10.0, 0.1), F.greatest(F.lit(7), half))
        .otherwise(F.greatest(F.lit(3), F.ceil(r) + 1))
        .cast("long")
    )


def config_signature(config: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text map as JSON with sorted keys and without blanks."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(config)))
    return F.substring(F.sha2(F.to_json(ordered), 256), 1, 16)


def natural_key(text: Column) -> Column:
    """Sort key that compares digits as numbers and letters without case."""
    parts = F.regexp_extract_all(F.lower(text), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")


def seconds(indices: Column, rate: float = 1e4) -> Column:
    """Sample numbers of an array as seconds."""
    return F.transform(indices, lambda x: x / F.lit(rate))
