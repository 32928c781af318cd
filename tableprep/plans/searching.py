"""Nearest rows, experience tables and the analytics of chain logs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tableprep.functions.columns import one_row
from tableprep.functions.nearest import nearest, neighbours_within
from tableprep.functions.ordered import drop_context, number_rows, overlapping_blocks, time_block
from tableprep.operators import catalog, logs, search, textindex, vectorindex
from tableprep.operators.metafeatures import FEATURES
from tableprep.plans.registry import query, scratch, table
from tableprep.plans.tables import rounded

# One rule per supplier: 17 numbers from its line items (the same text runs in both engines).
FACTS = ["avg(l_quantity)", "avg(l_discount)", "avg(l_tax)", "avg(l_extendedprice) / 1000", "stddev_samp(l_quantity)",
         "stddev_samp(l_discount)", "stddev_samp(l_tax)", "stddev_samp(l_extendedprice) / 1000", "min(l_quantity)",
         "max(l_quantity)", "min(l_extendedprice) / 1000", "max(l_extendedprice) / 1000", "avg(l_linenumber)",
         "avg(l_quantity * l_discount)", "avg(l_quantity * l_tax)", "avg(l_discount * l_tax)",
         "avg(l_quantity * l_quantity) / 100"]
NAMED = [f"{fact} AS {name}" for fact, name in zip(FACTS, FEATURES)]
RULES = f"""rules AS (SELECT {', '.join(NAMED)}, '9|' || l_suppkey || '|25' AS operator_id FROM lineitem
  GROUP BY l_suppkey), q AS (SELECT {', '.join(NAMED)} FROM lineitem)"""
RULE_DISTANCE = "sqrt(" + " + ".join(f"power(r.{f} - q.{f}, 2)" for f in FEATURES) + ")"


def _rules(spark, sf):
    facts = [F.expr(fact).alias(name) for fact, name in zip(FACTS, FEATURES)]
    items = table(spark, sf, "lineitem")
    rules = items.groupBy("l_suppkey").agg(*facts).withColumn(
        "operator_id", F.concat(F.lit("9|"), F.col("l_suppkey"), F.lit("|25"))).drop("l_suppkey")
    return rules, list(items.agg(*facts).first())


@query("c1_same_row_columns", """SELECT o_orderkey, round(o_totalprice / 1000, 6) AS thousands, o_orderstatus FROM orders""")
def c1(spark, sf):
    """New columns are added in the same projection: no join by position."""
    return rounded(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("thousands"),
                                                     "o_orderstatus"))


@query("c2_nearest_rule", f"""WITH {RULES} SELECT cast(unnest(string_split(operator_id, '|')) AS INT) AS op FROM (
  SELECT operator_id FROM rules r, q ORDER BY {RULE_DISTANCE}, operator_id LIMIT 1)""")
def c2(spark, sf):
    return spark.createDataFrame([(op,) for op in search.nearest_rule(*_rules(spark, sf))], "op int")


@query("c3_top_rules", f"""WITH {RULES} SELECT operator_id, round({RULE_DISTANCE}, 6) AS dist FROM rules r, q
  ORDER BY {RULE_DISTANCE}, operator_id LIMIT 10""")
def c3(spark, sf):
    return rounded(search.nearest_rules(*_rules(spark, sf), 10))


CENTRES = """c AS (SELECT label, list(v ORDER BY i) AS v FROM (SELECT label, i, avg(v) AS v FROM (SELECT label,
  unnest(embedding::DOUBLE[]) AS v, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""
CENTRE = """m AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, avg(v) AS v FROM (SELECT
  unnest(embedding::DOUBLE[]) AS v, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i))"""
L2 = "power(array_distance(e.embedding::DOUBLE[64], {}.v::DOUBLE[64]), 2)"


def _centres(vectors, *keys):
    cells = vectors.select(*keys, F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    means = cells.groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))),
                                                lambda s: s["v"]).alias("embedding"))


@query("c4_vector_search", f"""WITH {CENTRE} SELECT vec_id, label, round({L2.format('m')}, 6) AS dist FROM embeddings e, m
  WHERE label > 2 ORDER BY {L2.format('m')}, vec_id LIMIT 5""")
def c4(spark, sf):
    """The vectors nearest to the mean of all, among some labels."""
    vectors = table(spark, sf, "embeddings")
    centre = _centres(vectors).first()["embedding"]
    hits = search.search_vector(vectors, centre, 5, "embedding", "vec_id", F.col("label") > 2)
    return rounded(hits.select("vec_id", "label", "dist"))


@query("c4_vector_search_many", f"""WITH {CENTRES} SELECT c.label AS query, vec_id, round({L2.format('c')}, 6) AS dist
  FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY c.label ORDER BY {L2.format('c')}, vec_id) <= 5""")
def c4_many(spark, sf):
    """The vectors nearest to the mean of each label."""
    vectors = table(spark, sf, "embeddings")
    queries = _centres(vectors, "label").withColumnRenamed("label", "query")
    hits = search.search_vectors(vectors, queries, 5, "embedding", "vec_id")
    return rounded(hits.select("query", "vec_id", "dist"))


@query("c5_text_search", "SELECT min(doc_id) AS doc_id, 0.0::DOUBLE AS dist FROM documents")
def c5(spark, sf):
    """The whole text of the first document finds that document at distance 0."""
    docs = table(spark, sf, "documents")
    hits = search.search_text(docs, docs.agg(F.min_by("text", "doc_id")).first()[0], 1, key="doc_id", dedup=True)
    return rounded(hits.select("doc_id", "dist"))


def _grown_index(vectors):
    """Half of the labels first, the other half added to the stored cells."""
    path = scratch(vectors.sparkSession)
    vectorindex.build(vectors.filter("label <= 4"), path, key="vec_id")
    vectorindex.append(vectors.filter("label > 4"), path, key="vec_id")
    return path


@query("c4_vector_index_grown", f"""WITH {CENTRES} SELECT c.label AS query, vec_id, round({L2.format('c')}, 6) AS dist
  FROM embeddings e, c QUALIFY row_number() OVER (PARTITION BY c.label ORDER BY {L2.format('c')}, vec_id) <= 5""")
def c4_index(spark, sf):
    """The vectors nearest to the mean of each label, from a stored index to which rows were added."""
    vectors = table(spark, sf, "embeddings")
    queries = _centres(vectors, "label").withColumnRenamed("label", "query")
    return rounded(vectorindex.search(spark, _grown_index(vectors), queries, 5, key="vec_id").select("query", "vec_id", "dist"))


@query("c6_dedup_index", f"""WITH {CENTRES}, h AS (SELECT c.label AS query, e.label, {L2.format('c')} AS dist FROM embeddings e, c
  QUALIFY row_number() OVER (PARTITION BY c.label ORDER BY {L2.format('c')}, vec_id) <= 25)
  SELECT query, label, round(min(dist), 6) AS dist FROM h GROUP BY query, label
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY min(dist)) <= 5""")
def c6_index(spark, sf):
    """The nearest vector of each label counts once, for many queries on the stored index."""
    vectors = table(spark, sf, "embeddings")
    queries = _centres(vectors, "label").withColumnRenamed("label", "query")
    hits = vectorindex.search_distinct(spark, _grown_index(vectors), queries, "label", 5, key="vec_id")
    return rounded(hits.select("query", "label", "dist"))


@query("c7_neighbour_votes", f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[64] AS v, label, label >= 5 AS known FROM embeddings),
  d AS (SELECT t.vec_id, r.label FROM e t JOIN e r ON NOT t.known AND r.known
    QUALIFY row_number() OVER (PARTITION BY t.vec_id ORDER BY array_distance(t.v, r.v), r.vec_id) <= 5)
  SELECT vec_id, label, count(*) AS votes FROM d GROUP BY vec_id, label""")
def c7(spark, sf):
    """How the five nearest vectors with other labels vote."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    hits = nearest(vectors.filter("label < 5"), vectors.filter("label >= 5"), 5)
    return hits.groupBy(F.col("qid").alias("vec_id"), "label").agg(F.count("*").alias("votes"))


@query("c8_radius_join", """SELECT a.vec_id, count(*) AS near FROM embeddings a JOIN embeddings b
  ON array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]) <= 1.2 GROUP BY a.vec_id""")
def c8(spark, sf):
    """How many vectors, itself included, lie within a radius of each vector."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return neighbours_within(vectors, vectors, 1.2).withColumnRenamed("qid", "vec_id")


# Weights of all texts by the frequencies in some of them (`known`), and the five best texts for every hundredth one.
TEXT_HITS = """WITH tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang,
    unnest(regexp_extract_all(lower(text), '[^\\x09-\\x0D ]+')) AS term FROM documents) GROUP BY ALL),
  idf AS (SELECT term, ln(((SELECT count(*) FROM documents WHERE {known}) + 1.0) / (count(*) FILTER ({known}) + 1)) AS idf
    FROM tf GROUP BY term),
  w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term) WHERE tf * idf > 0),
  u AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w),
  s AS (SELECT q.doc_id AS query, d.doc_id, sum(q.u * d.u) AS score FROM u q JOIN u d USING (term) WHERE q.doc_id % 100 = 0 GROUP BY ALL)
  SELECT query, doc_id, round(greatest(2 - 2 * score, 0), 6) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY query
  ORDER BY round(score, 12) DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 5"""


def _text_hits(spark, sf, known):
    docs, path = table(spark, sf, "documents"), scratch(spark)
    textindex.build(docs.filter(known), path, key="doc_id")
    rest = docs.filter(~known)
    if not rest.isEmpty():
        textindex.append(rest, path, key="doc_id")
    asked = docs.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "text")
    return rounded(textindex.search(spark, path, asked, 5, key="doc_id"))


@query("c5_text_index", TEXT_HITS.format(known="true"))
def c5_index(spark, sf):
    """Every hundredth text is searched for in a stored index of all texts."""
    return _text_hits(spark, sf, F.lit(True))


@query("c5_text_index_grown", TEXT_HITS.format(known="lang = 'en'"))
def c5_grown(spark, sf):
    """The same in an index of the English texts to which all others were added."""
    return _text_hits(spark, sf, F.col("lang") == "en")


@query("c6_dedup_search", f"""WITH {CENTRE} SELECT label, round(min(dist), 6) AS dist FROM (SELECT label, {L2.format('m')}
  AS dist FROM embeddings e, m ORDER BY dist LIMIT 25) GROUP BY label ORDER BY min(dist) LIMIT 5""")
def c6(spark, sf):
    """The nearest vector of each label counts once."""
    vectors = table(spark, sf, "embeddings")
    centre = _centres(vectors).first()["embedding"]
    return rounded(search.search_dedup(vectors, centre, 5, "embedding", "label").select("label", "dist"))


@query("n1_rule_append", f"""WITH {RULES} SELECT count(*) + (SELECT count(*) FROM rules WHERE has_missing > 26) AS appended,
  count(DISTINCT operator_id) AS repeated, count(*) FILTER (cast('0x' || substr(md5(operator_id || '|0'), 1, 8) AS BIGINT) < round(0.9 * 4294967296)) AS evicted
  FROM rules""")
def n1(spark, sf):
    rules = _rules(spark, sf)[0]
    other = rules.filter("has_missing > 26").withColumn("operator_id", F.lit("1|25"))
    return one_row(spark, appended=search.append_rules(rules, other).count(),
                   repeated=search.append_rules(rules, rules).count(),
                   evicted=search.append_rules(rules.select("operator_id"), rules.select("operator_id").limit(0), limit=10).count())


# Chain logs: one step per event. The operator comes from the properties, the accuracy from the value.
LOG = """log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
  cast(json_extract_string(props, '$.k') AS INT) % 26 AS op, value / 500 AS acc, hour(ts)::DOUBLE AS cost,
  50 + cast(json_extract_string(props, '$.k') AS DOUBLE) / 2 AS quality FROM events)"""
RUNS = """runs AS (SELECT user_id AS dataset, (step - 1) // 6 AS run, list(op ORDER BY step) AS ops,
  arg_max(acc, step) AS acc FROM log GROUP BY ALL)"""


def _log(spark, sf):
    events = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select("user_id", "event_id", "ts", (k % 26).alias("op"), (F.col("value") / 500).alias("acc"),
                         F.hour("ts").cast("double").alias("cost"), (50 + k / 2).alias("quality"))
    numbered = number_rows(rows, ["user_id"], ["ts", "event_id"], time_block(rows, "ts"), "step")
    return numbered.drop("event_id", "ts")


def _runs(spark, sf):
    """Six steps make a run."""
    steps = _log(spark, sf).withColumn("run", F.floor((F.col("step") - 1) / 6))
    return steps.groupBy(F.col("user_id").alias("dataset"), "run").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "op"))), lambda s: s["op"]).alias("ops"),
        F.max_by("acc", "step").alias("acc"))


@query("n2_encode_decode", f"""WITH {LOG}, {RUNS} SELECT dataset, run, array_to_string(ops, '|') AS encoded,
  list_sum(ops)::BIGINT AS decoded_sum FROM runs""")
def n2(spark, sf):
    encoded = _runs(spark, sf).select("dataset", "run", search.encode_pipe(F.col("ops")).alias("encoded"))
    return encoded.withColumn("decoded_sum", F.aggregate(search.decode_pipe(F.col("encoded")), F.lit(0).cast("long"),
                                                         lambda t, v: t + v))


MARK = """md5(text || '||META||{"lang": "' || lang || '", "source": "' || source || '"}')"""


def _documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", F.create_map(
        F.lit("source"), "source", F.lit("lang"), "lang").alias("meta"))


@query("n3_fingerprint_append", f"""SELECT DISTINCT {MARK} AS fingerprint FROM documents WHERE {MARK} NOT IN
  (SELECT {MARK} FROM documents WHERE lang = 'en')""")
def n3(spark, sf):
    """English documents are known already."""
    documents = _documents(spark, sf)
    known = documents.filter("lang = 'en'").select(search.fingerprint(F.col("text"), F.col("meta")).alias("fingerprint"))
    return search.append_unseen(known, documents).select("fingerprint")


@query("n4_experience_files", f"SELECT count(DISTINCT {MARK}) AS kept, count(*) AS offered FROM documents")
def n4(spark, sf):
    """All documents are saved in two steps and offered once more."""
    path = scratch(spark)
    documents = _documents(spark, sf)
    nothing = documents.limit(0).select(F.lit("").alias("fingerprint"))
    search.save_experience(search.append_unseen(nothing, documents.filter("lang = 'en'")), path)
    search.save_experience(search.append_unseen(search.load_experience(spark, path), documents), path)
    saved = search.load_experience(spark, path)
    assert search.append_unseen(saved, documents).isEmpty()
    return saved.agg(F.count("*").alias("kept")).withColumn("offered", F.lit(documents.count()).cast("long"))


LAGGED = """x AS (SELECT *, lag(acc) OVER w AS a1, lag(acc, 2) OVER w AS a2, lag(op) OVER w AS o1,
  lag(quality) OVER w AS q1, lag(cost) OVER w AS c1, first_value(acc) OVER w AS a0 FROM log
  WINDOW w AS (PARTITION BY user_id ORDER BY step))"""


@query("o5_step_reward", f"""WITH {LOG}, {LAGGED} SELECT user_id, step, op, round((acc - coalesce(a1, 0.05))
  / (coalesce(a1, 0.05) + 1e-6) + CASE WHEN op = 25 AND o1 < 6 THEN 1 WHEN op = 25 AND o1 < 25 THEN 5 ELSE 0 END, 6)
  AS reward FROM x""")
def o5(spark, sf):
    return rounded(logs.step_rewards(_log(spark, sf), ["user_id"], 0.05).select("user_id", "step", "op", "reward"))


@query("o6_weighted_reward", f"""WITH {LOG}, {LAGGED} SELECT user_id, step, round((acc - greatest(coalesce(a1, 0.05), 0.05))
  / nullif(coalesce(a1, 0.05), 0) + 0.3 * (quality - coalesce(q1, 60)) / coalesce(q1, 60)
  - 0.1 * (cost - coalesce(c1, 0) + 10) / (coalesce(c1, 0) + 10), 6) AS reward FROM x""")
def o6(spark, sf):
    runs = _log(spark, sf).withColumnRenamed("acc", "downstream")
    return rounded(logs.weighted_rewards(runs, ["user_id"], (0.05, 60.0), 0.3, 0.1).select("user_id", "step", "reward"))


@query("o7_leaderboard", f"""WITH {LOG}, {RUNS} SELECT dataset, array_to_string(ops, '|') AS ops, round(acc, 6) AS acc
  FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, runs.ops) = 1""")
def o7(spark, sf):
    return rounded(logs.leaderboard(_runs(spark, sf)).withColumn("ops", search.encode_pipe(F.col("ops"))))


@query("o8_best_runs", f"""WITH {LOG}, {RUNS}, d AS (SELECT dataset, ops, max(acc) AS acc FROM runs GROUP BY ALL)
  SELECT dataset, array_to_string(ops, '|') AS ops, round(acc, 6) AS acc FROM d
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY acc DESC, d.ops) <= 10""")
def o8(spark, sf):
    best = logs.best_runs(_runs(spark, sf))
    return rounded(best.select("dataset", search.encode_pipe(F.col("ops")).alias("ops"), "acc"))


GRAMS = """g AS (SELECT n AS size, ops[i:i + n - 1] AS pattern FROM (SELECT ops, n, unnest(range(1, len(ops) - n + 2)) AS i
  FROM runs, (VALUES (2), (3), (4)) t(n))), k AS (SELECT size, pattern, count(*) AS n FROM g GROUP BY ALL)"""


@query("o9_ngrams", f"""WITH {LOG}, {RUNS}, {GRAMS} SELECT size, array_to_string(pattern, '|') AS pattern, n FROM k""")
def o9(spark, sf):
    return logs.ngram_counts(_runs(spark, sf)).withColumn("pattern", search.encode_pipe(F.col("pattern")))


@query("o10_next_step_rules", f"""WITH {LOG}, {RUNS}, {GRAMS}, r AS (SELECT * FROM k
  QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, pattern) <= 3), c AS (SELECT pattern[1] AS last FROM k
  WHERE size = 2 ORDER BY n DESC, pattern LIMIT 1)
  SELECT size, array_to_string(pattern, '|') AS pattern, n FROM r, c WHERE pattern[1] = last""")
def o10(spark, sf):
    """Rules for a chain that ends with the first operator of the most frequent pair."""
    counts = logs.ngram_counts(_runs(spark, sf))
    top = counts.filter("size = 2").orderBy(F.desc("n"), "pattern").first()["pattern"][0]
    return logs.next_step_rules(counts, [top]).withColumn("pattern", search.encode_pipe(F.col("pattern")))


SLOPES = """s AS (SELECT user_id, step, CASE WHEN step >= 10 THEN regr_slope(acc, step) OVER (PARTITION BY user_id
  ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS slope FROM log)"""


@query("o11_score_slopes", f"WITH {LOG}, {SLOPES} SELECT user_id, step, round(slope, 6) AS slope FROM s")
def o11(spark, sf):
    return rounded(logs.score_slopes(_log(spark, sf), ["user_id"]).select("user_id", "step", "slope"))


@query("o11_plateau_hits", f"""WITH RECURSIVE {LOG}, {SLOPES}, c AS (SELECT user_id, step FROM s WHERE slope <= 0.01),
  h AS (SELECT user_id, min(step) AS step FROM c GROUP BY user_id
  UNION ALL SELECT h.user_id, min(c.step) FROM h JOIN c ON c.user_id = h.user_id AND c.step >= h.step + 5
  GROUP BY h.user_id, h.step) SELECT * FROM h""")
def o11_hits(spark, sf):
    return logs.plateau_hits(_log(spark, sf), ["user_id"]).filter("hit").select("user_id", "step")


@query("o12_drop_alarms", f"""WITH {LOG}, {LAGGED} SELECT user_id, step, CASE WHEN step <= 2 THEN 0
  WHEN acc < a1 * 0.6 THEN 1 WHEN round(acc - a1, 9) <= -0.001 AND round(a1 - a2, 9) <= -0.001 THEN 2
  WHEN step >= 4 AND round((acc - a0) / (step - 1), 9) < 0 THEN 3 ELSE 0 END AS alarm FROM x""")
def o12(spark, sf):
    return logs.drop_alarms(_log(spark, sf), ["user_id"]).select("user_id", "step", "alarm")


@query("o12_stagnation_alarms", f"""WITH {LOG} SELECT user_id, step, step > 5 AND max(acc - 0.1) OVER (PARTITION BY user_id
  ORDER BY step ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) < 0.1 AS alarm FROM log""")
def o12_stagnation(spark, sf):
    episodes = _log(spark, sf).withColumn("gain", F.col("acc") - 0.1)
    return logs.stagnation_alarms(episodes, ["user_id"], 0.1).select("user_id", "step", "alarm")


def _group_rule(group: list[int]) -> str:
    return f"len(list_filter(ops, lambda x: list_contains({group}, x))) <= 1"


ADJACENT = "[i FOR i IN range(1, len(ops)) IF ops[i] = ops[i + 1]]"
VALID = (f"len({ADJACENT}) = 0 AND NOT list_contains(ops[1:len(ops) - 1], 25) AND "
         + " AND ".join(_group_rule(g) for g in catalog.EXCLUSIVE))


@query("o13_chain_validity", f"""WITH {LOG}, {RUNS} SELECT dataset, run, {VALID} AS valid, {VALID}
  AND len(list_distinct(list_transform(list_filter(ops, lambda x: x < 25), lambda x: CASE WHEN x < 4 THEN 0 WHEN x < 6 THEN 2
  WHEN x < 15 THEN 3 WHEN x < 24 THEN 4 ELSE 5 END))) = len(list_filter(ops, lambda x: x < 25)) AS one_per_category
  FROM runs""")
def o13(spark, sf):
    ops = F.col("ops")
    return _runs(spark, sf).select("dataset", "run", catalog.valid_chain(ops).alias("valid"),
                                   catalog.valid_chain(ops, True).alias("one_per_category"))


SPELLINGS = ["MinMaxScaler", "<PCA_AUTO_Prim>", "blank", "Nothing", "ImputerMean", "a StandardScalerPrim step", "Encoder",
             "Power"]
CATALOG = "cat AS (SELECT unnest(" + str(catalog.NAMES) + ") AS name, unnest(range(0, 25)) AS op)"


@query("o14_operator_lookup", f"""WITH {CATALOG}, t AS (SELECT event_id, replace(replace({SPELLINGS}[
  cast(json_extract_string(props, '$.k') AS INT) % 8 + 1], '<', ''), '>', '') AS name FROM events),
  u AS (SELECT t.name, coalesce(min(op) FILTER (contains(cat.name, t.name) OR contains(t.name, cat.name)), 25) AS op
  FROM (SELECT DISTINCT name FROM t) t, cat GROUP BY t.name)
  SELECT event_id, CASE WHEN t.name = 'blank' THEN 25 ELSE u.op END::INT AS op FROM t JOIN u ON u.name = t.name""")
def o14(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.get(F.array(*[F.lit(s) for s in SPELLINGS]), k % 8)
    return table(spark, sf, "events").select("event_id", catalog.find_operator(name).alias("op"))


# Answers as a model might give them, one form per event type.
def _answers(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    a, b = (k % 25).cast("string"), (k % 7).cast("string")
    kind = F.col("event_type")
    answer = (F.when(kind == "view", F.concat(F.lit('```json\n{"suggested_pipeline": ['), a, F.lit(", "), b,
                                              F.lit('], "rationale": "r"}\n```')))
              .when(kind == "click", F.concat(F.lit('{"pipe": ["MinMaxScaler", "<blank>", "op '), a, F.lit('"]}')))
              .when(kind == "error", F.concat(F.lit("I would take ["), a, F.lit(", "), b, F.lit("] here")))
              .when(kind == "signup", F.concat(F.lit('{"suggested_pipeline": ["'), a, F.lit('", "'), b, F.lit('"]}')))
              .otherwise(F.lit("no idea")))
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


@query("o15_parse_chains", """WITH t AS (SELECT event_id, event_type, cast(json_extract_string(props, '$.k') AS INT) AS k
  FROM events) SELECT event_id, CASE WHEN event_type IN ('view', 'error', 'signup') THEN (k % 25) || '|' || (k % 7)
  WHEN event_type = 'click' THEN '6|25|25' END AS ops FROM t""")
def o15(spark, sf):
    return _answers(spark, sf).select("event_id", search.encode_pipe(logs.parse_chain(F.col("answer"))).alias("ops"))


@query("o16_parse_weights", """WITH t AS (SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events),
  w AS (SELECT event_id, unnest([3, 7, 25]) AS op, unnest([k, 50, 25]) / 100.0::DOUBLE AS weight FROM t)
  SELECT event_id, op, weight, round(weight / sum(weight) OVER (PARTITION BY event_id), 6) AS scaled,
  round(CASE WHEN op = 25 THEN 0 ELSE weight END / sum(CASE WHEN op = 25 THEN 0 ELSE weight END)
  OVER (PARTITION BY event_id), 6) + 0.0 AS masked FROM w""")
def o16(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(F.lit('Weights: {"3": 0.'), F.lpad(k.cast("string"), 2, "0"), F.lit(', 7: 0.50, "25": 0.25} done'))
    rows = table(spark, sf, "events").select("event_id", logs.parse_weights(text).alias("w"))
    scaled = rows.select("event_id", "w", logs.normalize_weights(F.col("w")).alias("s"),
                         logs.normalize_weights(F.col("w"), F.lit([3, 7])).alias("m"))
    return rounded(scaled.select("event_id", F.explode("w").alias("op", "weight"), "s", "m").select(
        "event_id", "op", "weight", F.element_at("s", F.col("op")).alias("scaled"),
        F.element_at("m", F.col("op")).alias("masked")))


MOVES = """t AS (SELECT o1 AS s, op AS a, op AS n, sqrt(acc) - sqrt(a1) + 0.05 AS r FROM x WHERE o1 IS NOT NULL AND o1 <> 25)"""
SWEEPS = """q1 AS (SELECT s, a, avg(r) AS q FROM t GROUP BY ALL), v1 AS (SELECT s, max(q) AS v FROM q1 GROUP BY s),
  q2 AS (SELECT t.s, a, avg(r + 0.9 * coalesce(v, 0)) AS q FROM t LEFT JOIN v1 ON v1.s = t.n GROUP BY ALL),
  v2 AS (SELECT s, max(q) AS v FROM q2 GROUP BY s),
  q3 AS (SELECT t.s, a, avg(r + 0.9 * coalesce(v, 0)) AS q FROM t LEFT JOIN v2 ON v2.s = t.n GROUP BY ALL)"""


def _moves(spark, sf):
    """Each step leads from the operator before it to its own."""
    rows = overlapping_blocks(_log(spark, sf), "step", 1)
    w = Window.partitionBy("user_id", "_block").orderBy("step")
    rows = drop_context(rows.withColumn("state", F.lag("op").over(w)).withColumn("_a1", F.lag("acc").over(w)))
    return rows.filter("state <> 25").select("state", F.col("op").alias("action"), F.col("op").alias("next_state"),
                                             (F.sqrt("acc") - F.sqrt("_a1") + 0.05).alias("reward"))


@query("o17_transition_values", f"""WITH {LOG}, {LAGGED}, {MOVES}, {SWEEPS} SELECT s AS state, a AS action,
  round(q, 6) + 0.0 AS q FROM q3""")
def o17(spark, sf):
    return rounded(logs.transition_values(_moves(spark, sf), 3))


@query("o18_greedy_chains", f"""WITH RECURSIVE {LOG}, {LAGGED}, {MOVES}, {SWEEPS}, p AS (SELECT s, CASE WHEN q > 0 THEN a
  ELSE 25 END AS a FROM q3 QUALIFY row_number() OVER (PARTITION BY s ORDER BY q DESC, a) = 1),
  g AS (SELECT s AS start, [s] AS ops, s AS now, 0 AS i FROM p UNION ALL SELECT start, list_append(ops, step), step, i + 1
  FROM (SELECT start, ops, i, CASE WHEN i = 8 THEN 25 ELSE coalesce(p.a, 25) END AS step FROM g LEFT JOIN p ON p.s = g.now
  WHERE g.now <> 25)) SELECT start, array_to_string(ops, '|') AS ops FROM g WHERE now = 25""")
def o18(spark, sf):
    chains = logs.greedy_chains(logs.transition_values(_moves(spark, sf), 3))
    return chains.withColumn("ops", search.encode_pipe(F.col("ops")))
