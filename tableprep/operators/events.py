"""Quality of event logs: regular arrival, outliers, duplicates, and JSON records against a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tableprep.functions.columns import col
from tableprep.functions.counts import lookup, modes
from tableprep.functions.ordered import ROWS_PER_BLOCK, previous_in_order, time_block
from tableprep.functions.quantiles import exact_quantiles
from tableprep.session import cut_lineage

Z_FACTOR, Z_LIMIT = 0.6745, 3.5  # fixed values of the modified z-score


def inter_arrival(df: DataFrame, key: str, ts: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(key, iat): seconds since the previous event of the same key; only times above 0 are kept.

    Events of a key at the same instant have no time between them, so repeats are merged before anything is sorted.
    """
    rows = df.select(col(key).alias(key), col(ts).alias(ts)).dropna().distinct()
    block = time_block(df.select(col(ts).alias(ts)).dropna(), ts, rows_per_block)
    rows = previous_in_order(rows, [key], ts, block, "_previous")
    seconds = (F.unix_micros(col(ts).cast("timestamp")) - F.unix_micros(F.col("_previous").cast("timestamp"))) / 1e6
    return rows.select(key, seconds.alias("iat")).filter("iat > 0")


def mode_deviation(iat: DataFrame, key: str, value: str = "iat") -> DataFrame:
    """(key, mode, deviation): mean distance of the values from their mode, per key.

    Works on counted values, so a key with very many events is merged before any row moves. The modes are written before they
    meet the counts: broadcast if they are few, else a join whose sides are bare shuffles, which is split at a hot key.
    """
    counts = cut_lineage(iat.filter(col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")))
    mode = counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("mode"))
    return (lookup(counts, cut_lineage(mode), key, "inner").groupBy(key)
            .agg(F.first("mode").alias("mode"),
                 (F.sum(F.abs(F.col(value) - F.col("mode")) * F.col("n")) / F.sum("n")).alias("deviation")))


def regularity_by_key(iat: DataFrame, key: str, value: str = "iat") -> float | None:
    """1 minus the mean of the deviations after scaling them to 0..1 over the keys."""
    low, high, mean = mode_deviation(iat, key, value).agg(F.min("deviation"), F.max("deviation"),
                                                         F.avg("deviation")).first()
    if mean is None:
        return None
    return round(1 - ((mean - low) / (high - low) if high > low else 0.0), 3)


def _mode(iat: DataFrame, value: str) -> float | None:
    return modes(iat, {"v": col(value)}, "double").get("v", (None,))[0]


def regularity(iat: DataFrame, value: str = "iat") -> float | None:
    """Times within half a mode of the mode earn points, farther ones cost points."""
    mode = _mode(iat, value)
    if not mode:
        return None
    error = F.abs(col(value) - F.lit(mode)) / F.lit(mode)
    good, count, bad = iat.agg(F.sum(F.when(error <= 0.5, 1 - 2 * error)), F.count_if(error <= 0.5),
                               F.sum(F.when(error > 0.5, 2 * error))).first()
    whole = count + (bad or 0.0)
    return round((good or 0.0) / whole, 3) if whole else None


def arrival_outliers(iat: DataFrame, value: str = "iat") -> float | None:
    """1 minus the share of rows whose modified z-score lies above 3.5."""
    mode = _mode(iat, value)
    if mode is None:
        return None
    spread = exact_quantiles(iat, {"d": F.abs(col(value) - F.lit(mode))}, [0.5])["d"][0]
    if not spread:
        return None
    n, bad = iat.agg(F.count("*"), F.count_if(Z_FACTOR * (col(value) - F.lit(mode)) / F.lit(spread) > Z_LIMIT)).first()
    return round(1 - bad / n, 3)


def duplicate_score(df: DataFrame, first: str, second: str) -> float | None:
    """1 minus the share of rows that repeat an earlier pair of values."""
    n, pairs = df.groupBy(first, second).count().agg(F.sum("count"), F.count("*")).first()
    return round(1 - (n - pairs) / n, 3) if n else None


NOTES = {"$schema", "$id", "title", "description", "default", "examples", "definitions", "$defs", "$comment", "format"}


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _part(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _same(value: Column, wanted) -> Column:
    """The value equals a constant of the schema, in kind and content; 1 and 1.0 are equal."""
    kind = _kind(value)
    if wanted is None:
        return kind == "VOID"
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (_part(value, "boolean") == F.lit(wanted))
    if isinstance(wanted, (int, float)):
        return _is(value, "number") & (_part(value, "double") == F.lit(float(wanted)))
    if isinstance(wanted, str):
        return (kind == "STRING") & (_part(value, "string") == F.lit(wanted))
    if isinstance(wanted, list):
        return kind.startswith("ARRAY") & (F.size(_part(value, "array<variant>")) == len(wanted)) & _all(
            _same(F.try_variant_get(value, f"$[{i}]", "variant"), w) for i, w in enumerate(wanted))
    entries = _part(value, "map<string,variant>")
    return kind.startswith("OBJECT") & (F.size(entries) == len(wanted)) & _all(
        F.map_contains_key(entries, F.lit(k)) & _same(F.try_element_at(entries, F.lit(k)), w) for k, w in wanted.items())


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _any(tests) -> Column:
    return ~_all(~F.coalesce(t, F.lit(False)) for t in tests)


def _is(value: Column, name: str) -> Column:
    kind = _kind(value)
    number = (kind == "BIGINT") | kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    if name == "integer":
        return number & (_part(value, "double") == F.floor(_part(value, "double")))
    names = {"number": number, "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
             "array": kind.startswith("ARRAY"), "object": kind.startswith("OBJECT")}
    if name not in names:
        raise ValueError(f"unknown type {name!r}")
    return names[name]


def _fits(value: Column, rule, root: dict, path: tuple[str, ...] = ()) -> Column:
    """Whether a value (a variant) obeys a schema: one expression, built by recursion over the schema."""
    if isinstance(rule, bool):
        return F.lit(rule)
    if "$ref" in rule:
        ref = rule["$ref"]
        if ref in path or not ref.startswith("#"):
            raise ValueError(f"reference {ref!r} is recursive or points outside the schema")
        target = root
        for step in ref[1:].strip("/").split("/") if len(ref) > 1 else ():
            target = target[step.replace("~1", "/").replace("~0", "~")]
        return _fits(value, target, root, (*path, ref))
    sub = lambda v, r: _fits(v, r, root, path)
    number, text = _part(value, "double"), _part(value, "string")
    items, entries = _part(value, "array<variant>"), _part(value, "map<string,variant>")
    of = {"number": ~_is(value, "number"), "string": ~_is(value, "string"), "array": ~_is(value, "array"), "object": ~_is(value, "object")}
    known = set(rule.get("properties", {}))
    patterns = list(rule.get("patternProperties", {}))
    tests = []
    for word, want in rule.items():
        if word == "type":
            tests.append(_any(_is(value, t) for t in ([want] if isinstance(want, str) else want)))
        elif word == "enum":
            tests.append(_any(_same(value, w) for w in want))
        elif word == "const":
            tests.append(_same(value, want))
        elif word in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            edge = F.lit(float(want))
            ratio = number / edge if word == "multipleOf" else number
            tests.append(of["number"] | {
                "minimum": number >= edge, "maximum": number <= edge, "exclusiveMinimum": number > edge,
                "exclusiveMaximum": number < edge, "multipleOf": F.abs(ratio - F.rint(ratio)) < 1e-9}[word])
        elif word in ("minLength", "maxLength"):
            n = F.char_length(text)
            tests.append(of["string"] | ((n >= want) if word == "minLength" else (n <= want)))
        elif word == "pattern":
            tests.append(of["string"] | text.rlike(want))
        elif word in ("minItems", "maxItems"):
            tests.append(of["array"] | ((F.size(items) >= want) if word == "minItems" else (F.size(items) <= want)))
        elif word == "uniqueItems":
            plain = F.transform(items, lambda v: F.to_json(v))
            tests.append(of["array"] | F.lit(not want) | (F.size(F.array_distinct(plain)) == F.size(items)))
        elif word == "items" and isinstance(want, list):
            for i, r in enumerate(want):
                tests.append(of["array"] | (F.size(items) <= i) | sub(F.try_variant_get(value, f"$[{i}]", "variant"), r))
        elif word == "items":
            tests.append(of["array"] | F.forall(items, lambda v: sub(v, want)))
        elif word == "contains":
            tests.append(of["array"] | F.exists(items, lambda v: sub(v, want)))
        elif word in ("minProperties", "maxProperties"):
            tests.append(of["object"] | ((F.size(entries) >= want) if word == "minProperties" else (F.size(entries) <= want)))
        elif word == "required":
            tests.append(of["object"] | _all(F.map_contains_key(entries, F.lit(k)) for k in want))
        elif word == "properties":
            for k, r in want.items():
                tests.append(of["object"] | ~F.map_contains_key(entries, F.lit(k)) | sub(F.try_element_at(entries, F.lit(k)), r))
        elif word == "patternProperties":
            for k, r in want.items():
                tests.append(of["object"] | F.forall(F.map_entries(entries), lambda e: ~e["key"].rlike(k) | sub(e["value"], r)))
        elif word == "additionalProperties":
            tests.append(of["object"] | F.forall(F.map_entries(entries), lambda e: _any(
                [e["key"].isin(*known) if known else F.lit(False), *[e["key"].rlike(p) for p in patterns]]) | sub(e["value"], want)))
        elif word in ("anyOf", "allOf", "oneOf", "not"):
            if word == "not":
                tests.append(~sub(value, want))
            elif word == "oneOf":
                tests.append(sum((sub(value, r).cast("int") for r in want), F.lit(0)) == 1)
            else:
                tests.append((_any if word == "anyOf" else _all)(sub(value, r) for r in want))
        elif word not in NOTES:
            raise ValueError(f"schema keyword {word!r} is not supported")
    return _all(tests)


def check_schema(df: DataFrame, name: str, schema: dict) -> dict[str, int]:
    """Checks JSON records in a text column against an object schema, in one scan.

    Counts records, records that fail, records with properties the schema does not allow, and missing required
    properties. Understood are the validation keywords of draft 7, nested to any depth, with local references that are
    not recursive; `format` is a note, as in the draft. Other keywords raise. A text that is no JSON object fails.
    """
    doc = F.try_parse_json(col(name))
    entries = F.when(_kind(doc).startswith("OBJECT"), _part(doc, "map<string,variant>"))
    keys = F.map_keys(entries)
    required = schema.get("required", [])
    absent = F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) if required else F.lit(0)
    extra = F.lit(False)
    if schema.get("additionalProperties", True) is False:
        named = schema.get("properties", {})
        other = [F.lit(False)] if not named else []
        extra = F.exists(keys, lambda k: ~_any([*other, *([k.isin(*named)] if named else []),
                                                *[k.rlike(p) for p in schema.get("patternProperties", {})]]))
    ok = F.coalesce(entries.isNotNull() & _fits(doc, schema, schema), F.lit(False))
    row = df.agg(F.count("*"), F.count_if(~ok), F.count_if(keys.isNotNull() & extra),
                 F.sum(F.when(keys.isNotNull(), absent).otherwise(0))).first()
    return dict(zip(("records", "failures", "with_extra", "missing_required"), (row[0], row[1], row[2], row[3] or 0)))


def required_fields(df: DataFrame, name: str, required: Sequence[str]) -> dict[str, int]:
    """Records, and required keys that are absent or null, summed over all records."""
    entries = _part(F.try_parse_json(col(name)), "map<string,variant>")
    absent = [F.count_if(F.coalesce(_kind(F.try_element_at(entries, F.lit(key))), F.lit("VOID")) == "VOID") for key in required]
    n, missing = df.agg(F.count("*"), sum(absent, F.lit(0))).first()
    return {"records": n, "missing": missing}
