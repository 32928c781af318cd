"""Nearest rows of a rule table and of a table of vectors, and tables of experience that grow without repeats."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.feature import IDF, HashingTF, Normalizer, Tokenizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableprep.functions.columns import col
from tableprep.functions.nearest import nearest
from tableprep.operators.metafeatures import FEATURES

RULE_KEEP = 0.9                      # fixed value: share of the rules that eviction keeps
DEDUP_FACTOR = 5                     # fixed value: hits fetched per wanted result
SEPARATOR = "||META||"               # fixed value: stands between text and metadata in a fingerprint
PIPE = "operator_id"


def encode_pipe(pipe: Column) -> Column:
    """[3, 7, 12] -> '3|7|12'."""
    return F.array_join(pipe.cast("array<string>"), "|")


def decode_pipe(text: Column) -> Column:
    return F.transform(F.split(text, r"\|"), lambda x: x.cast("int"))


def squared_l2(vec: Column, query: Sequence[float]) -> Column:
    pairs = F.zip_with(vec.cast("array<double>"), F.lit([float(q) for q in query]), lambda a, b: (a - b) * (a - b))
    return F.aggregate(pairs, F.lit(0.0), lambda total, d: total + d)


def nearest_rules(rules: DataFrame, features: Sequence[float], k: int = 10) -> DataFrame:
    """The k rules closest to a feature vector, as (operator_id, dist), nearest first.

    One scan; every task keeps k rows.
    """
    if len(features) != len(FEATURES):
        raise ValueError(f"expected {len(FEATURES)} features, got {len(features)}")
    dist = F.sqrt(sum(((col(f) - float(v)) * (col(f) - float(v)) for f, v in zip(FEATURES, features)), F.lit(0.0)))
    return rules.select(PIPE, dist.alias("dist")).orderBy("dist", PIPE).limit(k)


def nearest_rule(rules: DataFrame, features: Sequence[float], k: int = 10) -> list[int]:
    """Operator ids of the closest rule; k times -1 for an empty table."""
    best = nearest_rules(rules, features, 1).select(decode_pipe(F.col(PIPE))).first()
    return list(best[0]) if best else [-1] * k


def search_vector(table: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "id",
                  where: Column | None = None) -> DataFrame:
    """The k rows with the smallest squared L2 distance among those that pass the filter, with a `dist` column."""
    rows = table if where is None else table.filter(where)
    return rows.withColumn("dist", squared_l2(col(vector), query)).orderBy("dist", key).limit(k)


def search_vectors(table: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", key: str = "id",
                   query_key: str = "query", where: Column | None = None) -> DataFrame:
    """The k nearest rows of many queries at once, as (query, id, dist, rank)."""
    rows = table if where is None else table.filter(where)
    hits = nearest(queries.select(col(query_key).alias("id"), col(vector).alias("vec")),
                   rows.select(col(key).alias("id"), col(vector).alias("vec")), k)
    return hits.select(F.col("qid").alias(query_key), F.col("id").alias(key), (F.col("dist") * F.col("dist"))
                       .alias("dist"), "rank")


def first_per_id(hits: DataFrame, k: int, key: str = "id") -> DataFrame:
    """Keeps the nearest hit of every id, then the k nearest."""
    best = hits.groupBy(key).agg(F.min_by(F.struct(*[col(c) for c in hits.columns]), "dist").alias("hit"))
    return best.select("hit.*").orderBy("dist", key).limit(k)


def search_dedup(table: DataFrame, query: Sequence[float], k: int = 5, vector: str = "embedding", key: str = "id",
                 where: Column | None = None) -> DataFrame:
    """Fetches five times k hits, keeps one per id, returns k."""
    return first_per_id(search_vector(table, query, k * DEDUP_FACTOR, vector, key, where), k, key)


def text_index(table: DataFrame, text: str, size: int = 1 << 18):
    """(function from a frame to the same frame with a sparse `embedding` vector) fitted on the texts of `table`.

    Hashed TF-IDF weights scaled to length 1 stand in for a hosted embedding model. With 2^18 slots words hardly ever
    share one, and a text keeps only the weights of its own words.
    """
    tokens = Tokenizer(inputCol=text, outputCol="_words")
    counts = HashingTF(numFeatures=size, inputCol="_words", outputCol="_tf")
    weights = IDF(inputCol="_tf", outputCol="_tfidf").fit(counts.transform(tokens.transform(table)))
    scaled = Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit")

    def embed(df: DataFrame) -> DataFrame:
        rows = scaled.transform(weights.transform(counts.transform(tokens.transform(df))))
        return rows.withColumn("embedding", F.col("_unit")).drop("_words", "_tf", "_tfidf", "_unit")

    return embed


def sparse_l2(vec: Column, query) -> Column:
    """Squared distance of sparse vectors to a sparse query: |v|^2 + |q|^2 - 2 v q, where v q needs the query's slots alone."""
    weights = F.create_map(*[F.lit(x) for i, v in zip(query.indices, query.values) for x in (int(i), float(v))]) if len(
        query.indices) else F.expr("map(-1, 0.0D)")
    held = F.unwrap_udt(vec)
    products = F.zip_with(held["indices"], held["values"], lambda i, v: v * F.coalesce(F.try_element_at(weights, i), F.lit(0.0)))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda t, x: t + x)
    own = total(F.transform(held["values"], lambda v: v * v))
    return F.greatest(own + float(query.values @ query.values) - 2 * total(products), F.lit(0.0))


def search_text(table: DataFrame, query: str, k: int = 5, text: str = "text", key: str = "id",
                where: Column | None = None, dedup: bool = False) -> DataFrame:
    """As `search_vector` (or `search_dedup`) with an embedded query text."""
    embed = text_index(table, text)
    asked = embed(table.sparkSession.createDataFrame([(query,)], f"{text} string")).first()["embedding"]
    rows = embed(table if where is None else table.filter(where))
    found = rows.withColumn("dist", sparse_l2(col("embedding"), asked)).drop("embedding").orderBy("dist", key)
    return first_per_id(found.limit(k * DEDUP_FACTOR), k, key) if dedup else found.limit(k)


def append_rules(rules: DataFrame, new: DataFrame, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Adds rules and drops repeats. Nothing is lost unless a `limit` is given: a table that has reached it first gives up
    about a tenth of its rules, chosen by a hash of the rule, in place and without a sort."""
    if limit is not None and rules.count() >= limit:
        text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in rules.columns], F.lit(str(seed)))
        rules = rules.filter(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") < F.lit(round(RULE_KEEP * (1 << 32))))
    return rules.unionByName(new).distinct()


def _json(x: Column, kind: T.DataType) -> Column:
    """JSON with sorted keys, of a value of any type."""
    if isinstance(kind, T.StructType):
        pairs = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), _json(x.getField(f.name), f.dataType))
                 for f in sorted(kind.fields, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(x)), lambda k: F.concat(
            _json(k.cast("string"), T.StringType()), F.lit(": "), _json(F.try_element_at(x, k), kind.valueType)))
        body = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: _json(v, kind.elementType)), ", "), F.lit("]"))
    else:
        body = F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    return F.when(x.isNull(), F.lit("null")).otherwise(body)


def fingerprint(text: Column, meta: Column | None = None, kind: T.DataType = T.MapType(T.StringType(), T.StringType())) -> Column:
    """md5 of the text and its metadata as JSON with sorted keys. Metadata is a map or a struct, whose fields may be of
    mixed types; none, or a missing one, is {}. A missing text is ''."""
    body = F.lit("{}") if meta is None else F.when(meta.isNull(), F.lit("{}")).otherwise(_json(meta, kind))
    return F.md5(F.concat(F.coalesce(text, F.lit("")), F.lit(SEPARATOR), body))


def append_unseen(known: DataFrame, new: DataFrame, text: str = "text", meta: str = "meta") -> DataFrame:
    """Rows of `new` whose fingerprint is not yet in `known` (a frame with a `fingerprint` column), one per fingerprint.
    A frame without the metadata column counts as having none."""
    has = meta in new.columns
    print_ = fingerprint(col(text), col(meta), new.schema[meta].dataType) if has else fingerprint(col(text))
    marked = new.withColumn("fingerprint", print_)
    return marked.dropDuplicates(["fingerprint"]).join(known.select("fingerprint"), "fingerprint", "left_anti")


def save_experience(table: DataFrame, path: str) -> None:
    """Appends rows with their fingerprints."""
    table.write.mode("append").parquet(path)


def load_experience(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
