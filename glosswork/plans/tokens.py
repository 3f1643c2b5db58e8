"""Queries over the token stream, the documents, and the tables derived from them."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import register, schedule, windowing
from ..functions.geometry import three_parts, three_parts_inverse
from ..functions.vectors import doubles
from ..operators import corpus, mixtures, pairs, providers, vectorspace
from ..operators.folds import fold_probabilities, stat
from ..session import materialise, remove, shared_dir, small
from ..sources import samples
from ..streaming import sums
from ..tables import table
from . import states
from .states import rounded

#: Frequent tokens that pairwise queries of the bigram model are about; its probabilities are over all tokens.
BIGRAM_TOKENS = 12


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.latest(table(spark, sf_dir, "corpus"))


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current tokens written once, for queries that go over them several times."""
    return materialise(current(spark, sf_dir), "current")


def _top(held: DataFrame, n: int) -> list[int]:
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return [r["token"] for r in corpus.top_tokens(counts, "token", n).collect()]


def tokenize_positions(spark, sf_dir):
    """Words of all documents with their places."""
    return corpus.words(table(spark, sf_dir, "documents"))


def vocab_counts(spark, sf_dir):
    """Occurrences and documents of every word."""
    return corpus.vocabulary_counts(corpus.words(table(spark, sf_dir, "documents")), "word")


def token_counts(spark, sf_dir):
    """Occurrences and documents of every token of the stream."""
    return corpus.vocabulary_counts(current(spark, sf_dir), "token")


def decay_weights(spark, sf_dir):
    """Offset tables of all decay forms and directions."""
    parts = []
    for decay in windowing.DECAYS:
        for direction in windowing.DIRECTIONS:
            for target in (True, False):
                made = windowing.offsets(spark, 4, decay, 0.5, direction, target)
                parts.append(made.select(F.lit(decay).alias("decay"), F.lit(direction).alias("direction"), F.lit(target).alias("target"), "o", "wt"))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return rounded(whole)


def _window(spark: SparkSession) -> DataFrame:
    return windowing.offsets(spark, 2, "harmonic", include_target=False)


def fcm_window(spark, sf_dir):
    """Summed weights of tokens in the windows of tokens, two positions to both sides."""
    return rounded(corpus.window_counts(current(spark, sf_dir), _window(spark)))


def fcm_pmi(spark, sf_dir):
    """Association values of those sums."""
    return rounded(corpus.count_pmi(corpus.window_counts(current(spark, sf_dir), _window(spark))))


def _bigrams(spark, sf_dir) -> tuple[DataFrame, DataFrame, int]:
    held = _held(spark, sf_dir)
    model, size = providers.bigram_model(held)
    return held, model, size


def bigram_marginals(spark, sf_dir):
    """Mean predicted probability of every token that follows another, over all contexts, weighted by how often these occur."""
    _, model, size = _bigrams(spark, sf_dir)
    return rounded(providers.bigram_marginals(model, size), 9)


def _by(*columns):
    return Window.partitionBy(*columns)


def bigram_pmi(spark, sf_dir):
    """Association values of the frequent tokens as predictions of the same contexts."""
    held, model, size = _bigrams(spark, sf_dir)
    weighed = providers.bigram_predictions(model, size, _top(held, BIGRAM_TOKENS)).select("prev", "token", "p", F.col("total").alias("c"))
    a = weighed.select("prev", F.col("token").alias("t"), F.col("p").alias("pt"), "c")
    b = weighed.select("prev", F.col("token").alias("w"), F.col("p").alias("pw"))
    m = a.join(b, "prev").groupBy("t", "w").agg((F.sum(F.col("c") * F.col("pt") * F.col("pw")) / F.sum("c")).alias("m"))
    z = weighed.groupBy("token").agg((F.sum(F.col("p") * F.col("c")) / F.sum("c")).alias("z"))
    joined = m.join(z.select(F.col("token").alias("t"), F.col("z").alias("zt")), "t").join(z.select(F.col("token").alias("w"), F.col("z").alias("zw")), "w")
    return rounded(joined.select("t", "w", F.log(F.col("m") / (F.col("zt") * F.col("zw"))).alias("pmi")))


def bigram_perplexity(spark, sf_dir):
    """Mean loss and perplexity of the bigram model on what it was counted from."""
    _, model, _ = _bigrams(spark, sf_dir)
    return rounded(corpus.perplexity(model.select("p", F.col("n").cast("double").alias("weight"))), 5)


def window_avg_probability(spark, sf_dir):
    """Mean and mean square of the window-averaged probability of each frequent token over all whole positions."""
    held, model, size = _bigrams(spark, sf_dir)
    predictions = materialise(providers.bigram_predictions(model, size, _top(held, BIGRAM_TOKENS)), "predictions")
    mean, tokens = corpus.window_predictions(held, windowing.offsets(spark, 1, "exponential", 0.5), predictions)
    sums_of = fold_probabilities(mean, lambda p: {"s": p.sum(0), "q": (p * p).sum(0), "n": np.full(p.shape[1], len(p))} if p.size else {})
    s, q, n = (stat(sums_of, k, "k", value=k) for k in "sqn")
    joined = s.join(q, "k").join(n, "k")
    names = F.lit(tokens)
    return rounded(joined.select(F.get(names, F.col("k")).alias("token"), F.col("n").cast("bigint").alias("n"), (F.col("s") / F.col("n")).alias("mean"), (F.col("q") / F.col("n")).alias("square")), 9)


def _line(spark, sf_dir) -> DataFrame:
    """States in order of their row, as one document."""
    return states.labelled(spark, sf_dir).select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))


def window_avg_aitchison(spark, sf_dir):
    """States averaged over a window of two to both sides."""
    mean = samples.window_states(_line(spark, sf_dir), windowing.offsets(spark, 2, "linear", include_target=True))
    return rounded(mean.select("pos", F.posexplode("v").alias("j", "x")))


def extract_marginals(spark, sf_dir):
    """Marginals of an extraction over a window of one to both sides, written to the shared folder."""
    _, w = states.model(spark, sf_dir)
    folder = f"{shared_dir(spark)}/extract-{uuid.uuid4().hex}"
    samples.extract(_line(spark, sf_dir), w, windowing.offsets(spark, 1), folder, "line")
    z = materialise(table(spark, folder, "line_Z").select("token", "z", "z_sum"), "marginals")
    remove(spark, folder)
    return rounded(z)


def next_token_filter(spark, sf_dir):
    """Positions that are followed by the third most frequent token."""
    held = _held(spark, sf_dir)
    return corpus.predicting(held, _top(held, 3)[2])


def phrase_search(spark, sf_dir):
    """States before the end of a phrase of the two most frequent tokens."""
    held = _held(spark, sf_dir)
    return corpus.phrase_ends(held, _top(held, 2))


def context_snippets(spark, sf_dir):
    """Text around the ends of documents: what precedes and follows their boundary token."""
    vocab = table(spark, sf_dir, "vocab")
    held = current(spark, sf_dir)
    marks = vocab.where("boundary = 'document'").select("token")
    places = held.join(small(marks, 16), "token", "left_semi").select("doc_id", (F.col("pos") - 1).alias("pos"))
    return corpus.snippets(held, places, vocab, 5, 3)


def instance_labels(spark, sf_dir):
    """Labels of a uniform sample of 200 positions: the six tokens that end with the predicted one."""
    held = _held(spark, sf_dir)
    chosen = corpus.sampled(corpus.next_token(held), ["doc_id", "pos"], 200)
    return corpus.labelled_places(held, chosen, table(spark, sf_dir, "vocab"), 6)


def uniform_subsample(spark, sf_dir):
    """A uniform sample of 500 positions."""
    return corpus.sampled(current(spark, sf_dir), ["doc_id", "pos"], 500)


def valid_positions(spark, sf_dir):
    """Positions of every document with four before and two behind them."""
    lengths = current(spark, sf_dir).groupBy("doc_id").agg((F.max("pos") + 1).alias("length"))
    return corpus.valid_positions(lengths, 4, 2)


def training_blocks(spark, sf_dir):
    """64 blocks of 16 tokens with their continuation."""
    return corpus.training_blocks(current(spark, sf_dir), 16, 64)


def _stored_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of strings with their mean stored association, from values that are finite."""
    v = table(spark, sf_dir, "vocab").where("str IS NOT NULL")
    rows = table(spark, sf_dir, "pmi").where("t IS NOT NULL AND w IS NOT NULL AND pmi IS NOT NULL AND NOT isnan(pmi) AND abs(pmi) < 1e300")
    mean = rows.groupBy("t", "w").agg(F.avg("pmi").alias("similarity"))
    a = v.select(F.col("token").alias("t"), F.trim("str").alias("word1"))
    b = v.select(F.col("token").alias("w"), F.trim("str").alias("word2"))
    return mean.join(a, "t").join(b, "w").select("word1", "word2", "similarity")


def pairs_enrich_oov(spark, sf_dir):
    """Stored pairs with the tokens of exactly their words, where the vocabulary has them."""
    return rounded(pairs.with_tokens(_stored_pairs(spark, sf_dir), table(spark, sf_dir, "vocab")))


def pairs_coverage(spark, sf_dir):
    """How many of the stored pairs have both words in the vocabulary."""
    return pairs.coverage(pairs.with_tokens(_stored_pairs(spark, sf_dir), table(spark, sf_dir, "vocab")))


def candidate_lookup(spark, sf_dir):
    """Tokens of all vocabulary strings without spaces and in capitals, by the first form that is known."""
    v = table(spark, sf_dir, "vocab")
    words = v.select(F.trim("str").alias("word")).union(v.select(F.upper(F.trim("str"))))
    return pairs.resolve(words, v)


def _token_vectors(spark, sf_dir) -> DataFrame:
    """Mean of the complete vectors of every token."""
    e = table(spark, sf_dir, "embedding").where("token IS NOT NULL AND size(e) = 48").select("emb_id", "token", doubles("e").alias("e")).dropDuplicates(["emb_id"])
    fine = e.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e30)) & F.exists("e", lambda x: x != 0))
    long = fine.select("token", F.posexplode("e").alias("j", "x")).groupBy("token", "j").agg(F.avg("x").alias("x"))
    return vectorspace.lists_of(long, "token", "j", "x", "e")


def spearman_eval(spark, sf_dir):
    """Rank correlation of stored associations with cosines of token vectors."""
    bench = _stored_pairs(spark, sf_dir).withColumn("name", F.lit("stored"))
    return rounded(pairs.run_benchmarks(bench, _token_vectors(spark, sf_dir), table(spark, sf_dir, "vocab")).select("name", "n_pairs", "benchmark_size", "coverage", "spearman_r"), 5)


def spearman_dot(spark, sf_dir):
    """The same with products, by the length of the first word."""
    bench = _stored_pairs(spark, sf_dir).withColumn("name", F.concat(F.lit("length "), F.length("word1").cast("string")))
    return rounded(pairs.run_benchmarks(bench, _token_vectors(spark, sf_dir), table(spark, sf_dir, "vocab"), "dot").select("name", "n_pairs", "benchmark_size", "coverage", "spearman_r"), 4)


def benchmark_registry(spark, sf_dir):
    """The known benchmarks."""
    return pairs.benchmark_table(spark)


def sample_quality(spark, sf_dir):
    """Rows of the working sample by what is wrong with their state."""
    rows = table(spark, sf_dir, "work_sample").select(doubles("h").alias("h"), F.col("log_z"))
    bad = F.exists("h", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = F.when(F.col("h").isNull(), "null").when(F.size("h") != 64, "length").when(bad, "not finite").when(~F.exists("h", lambda x: x != 0), "zero").otherwise("usable")
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count("log_z").alias("with_log_z"))


def sense_shares(spark, sf_dir):
    """Mean responsibility of every sense of every target, each state once."""
    r = table(spark, sf_dir, "responsibilities").where("t IS NOT NULL AND row_index IS NOT NULL AND sense_id IS NOT NULL AND r IS NOT NULL AND NOT isnan(r)")
    once = r.groupBy("t", "row_index", "sense_id").agg(F.max("r").alias("r"))
    return rounded(once.groupBy("t", "sense_id").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("share")))


def sense_exemplars(spark, sf_dir):
    """The three states of greatest responsibility for every sense of every target."""
    r = table(spark, sf_dir, "responsibilities").where("t IS NOT NULL AND row_index IS NOT NULL AND sense_id IS NOT NULL AND r IS NOT NULL AND NOT isnan(r)")
    once = r.groupBy("t", "row_index", "sense_id").agg(F.max("r").alias("r"))
    rank = F.row_number().over(_by("t", "sense_id").orderBy(F.desc("r"), "row_index"))
    return rounded(once.withColumn("rank", rank).where("rank <= 3").select("t", "sense_id", "rank", "row_index", "r"))


def learning_rate_schedule(spark, sf_dir):
    """Learning rates of 200 steps with warm-up and cosine decay."""
    return rounded(spark.range(200).select(F.col("id").alias("step"), schedule.learning_rate(F.col("id"), 1.0, 0.1, 20, 150).alias("rate")))


def model_shapes(spark, sf_dir):
    """Width, heads, parameters and batch of models of 1 to 40 layers."""
    depth = spark.range(1, 41).select(F.col("id").alias("depth"))
    shaped = depth.select("depth", *(c.cast("bigint").alias(k) for k, c in schedule.model_shape(F.col("depth")).items() if k != "n_layer"))
    return shaped.withColumn("batch", schedule.batch_tokens(F.col("n_params") * 20.0, 12 * 1024).cast("bigint"))


def training_plans(spark, sf_dir):
    """Batch, iterations, rates and epochs of models of 1 to 40 layers on a corpus of 50 million tokens, two epochs at most."""
    depth = spark.range(1, 41).select(F.col("id").alias("depth"))
    parameters = schedule.model_shape(F.col("depth"))["n_params"].cast("double")
    plan = schedule.training_plan(parameters, 12 * 1024, 20.0, 50e6, 2)
    whole = {"tokens", "accumulation", "iterations", "warmup"}
    return depth.select("depth", *((c.cast("bigint") if k in whole else F.round(c, 8)).alias(k) for k, c in plan.items()))


def _ilr_function(spark, sf_dir):
    register.register(spark)
    states.labelled(spark, sf_dir).createOrReplaceTempView("gw_states")


def ilr_function(spark, sf_dir):
    """Log-ratio coordinates of every state by the SQL function, each with its number."""
    _ilr_function(spark, sf_dir)
    return rounded(spark.sql("SELECT row, pos + 1 AS i, y FROM (SELECT row, posexplode(v) AS (pos, y) FROM (SELECT row, vector_ilr(h) AS v FROM gw_states))"))


def gram_by_label(spark, sf_dir):
    """Weighted sums of outer products of the states of every label, with the aggregate called from SQL."""
    _ilr_function(spark, sf_dir)
    return rounded(spark.sql("SELECT label, pos AS place, g FROM (SELECT label, posexplode(g) AS (pos, g) FROM (SELECT label, weighted_gram(slice(h, 1, 3), 1.0D + row % 3) AS g FROM gw_states GROUP BY label))"), 4)


def composition_parts(spark, sf_dir):
    """Mean log-ratio coordinates of three-part compositions, and of the parts they stand for."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") / 100.0).alias("a"), (F.col("l_discount") + 0.01).alias("b"), (F.col("l_tax") + 0.01).alias("c"))
    y1, y2 = three_parts(F.col("a"), F.col("b"), F.col("c"))
    back = three_parts_inverse(F.col("y1"), F.col("y2"))
    parts = rows.withColumns({"y1": y1, "y2": y2}).withColumns(dict(zip(("pa", "pb", "pc"), back)))
    return rounded(parts.groupBy("l_returnflag", "l_linestatus").agg(*(F.avg(c).alias(c) for c in ("y1", "y2", "pa", "pb", "pc"))))


def context_window_function(spark, sf_dir):
    """The table function of windows, called from SQL."""
    register.register(spark)
    return rounded(spark.sql("SELECT o, wt FROM context_window(3, 'power', 0.5D, 'backward', true)"))


def kish_by_label(spark, sf_dir):
    """Effective sample size of event values by type, with the aggregate called from SQL."""
    register.register(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("gw_events")
    return rounded(spark.sql("SELECT event_type, kish_ess(value) AS ess FROM gw_events WHERE value IS NOT NULL GROUP BY event_type"), 4)


def stream_marginals(spark, sf_dir):
    """Marginals from sums that a stream of states leaves behind."""
    _, w = states.model(spark, sf_dir)
    _, weights = providers.matrix(w)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).format("parquet").option("pathGlobFilter", "embeddings.parquet").load(sf_dir)
    sums.accumulate(providers.states(raw), weights, f"{base}/sums", f"{base}/checkpoint").awaitTermination()
    folded = materialise(sums.current(spark, f"{base}/sums"), "sums")
    remove(spark, base)
    n = folded.where("stat = 'n'").select(F.col("value").alias("n"))
    z = folded.where("stat = 'z'").join(F.broadcast(n))
    return rounded(z.select(F.col("j").alias("token"), (F.col("value") / F.col("n")).alias("z")))


def stream_event_windows(spark, sf_dir):
    """Events per day from a stream with late rows allowed."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir)
    per = raw.select(F.col("ts").cast("timestamp").alias("loaded_at"), F.col("event_type").alias("token"))
    sums.upsert(sums.windowed_counts(per, "1 day", "1 day"), f"{base}/windows", f"{base}/checkpoint").awaitTermination()
    days = materialise(sums.newest(spark, f"{base}/windows", "window_start").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n"), "days")
    remove(spark, base)
    return days


def sense_snippets(spark, sf_dir):
    """Text around one position of every document, as the examples of senses show it."""
    held = _held(spark, sf_dir)
    places = held.where("pos = 20").select(F.col("doc_id").alias("row"), "doc_id", "pos")
    examples = places.select((F.col("row") % 3).cast("int").alias("sense_id"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"), "row")
    return mixtures.sense_examples_in_text(examples, places, held, table(spark, sf_dir, "vocab"), 4)


_NAMES = (
    "tokenize_positions vocab_counts token_counts decay_weights fcm_window fcm_pmi bigram_marginals bigram_pmi bigram_perplexity window_avg_probability"
    " window_avg_aitchison extract_marginals next_token_filter phrase_search context_snippets instance_labels uniform_subsample valid_positions training_blocks"
    " pairs_enrich_oov pairs_coverage candidate_lookup spearman_eval spearman_dot benchmark_registry sample_quality sense_shares sense_exemplars"
    " learning_rate_schedule model_shapes training_plans ilr_function gram_by_label composition_parts context_window_function kish_by_label stream_marginals stream_event_windows sense_snippets"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_CUR = """cur AS (SELECT doc_id, pos, token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY loaded_at DESC NULLS LAST) AS rn
  FROM corpus WHERE doc_id IS NOT NULL AND pos IS NOT NULL) WHERE rn = 1 AND token IS NOT NULL)"""
_WORDS = r"""parts AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS word FROM parts)"""
_FREQ = f"{_CUR}, freq AS (SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM cur GROUP BY token), ranked AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS r FROM freq)"
_FCM = f"""{_CUR}, off AS (SELECT * FROM (VALUES (-2, 0.5::DOUBLE), (-1, 1.0), (1, 1.0), (2, 0.5)) v(o, wt)),
fcm AS (SELECT a.token AS t, b.token AS w, sum(wt) AS f FROM cur a, off JOIN cur b ON b.doc_id = a.doc_id AND b.pos = a.pos + off.o GROUP BY ALL)"""
_BIGRAM = f"""{_FREQ}, v AS (SELECT token FROM ranked WHERE r <= {BIGRAM_TOKENS}), follow AS (SELECT a.token AS prev, b.token FROM cur a JOIN cur b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1),
bi AS (SELECT prev, token, count(*) AS n FROM follow GROUP BY ALL), ctx AS (SELECT prev, sum(n) AS c FROM bi GROUP BY prev), size AS (SELECT count(*) AS s FROM freq),
model AS (SELECT ctx.prev, v.token, coalesce(bi.n, 0) AS n, (coalesce(bi.n, 0) + 0.5) / (c + 0.5 * (SELECT s FROM size)) AS p, c::DOUBLE AS c FROM ctx CROSS JOIN v LEFT JOIN bi ON bi.prev = ctx.prev AND bi.token = v.token)"""
_STORED = """v AS (SELECT token, str FROM vocab WHERE str IS NOT NULL), mean AS (SELECT t, w, avg(pmi) AS similarity FROM pmi
  WHERE t IS NOT NULL AND w IS NOT NULL AND pmi IS NOT NULL AND NOT isnan(pmi) AND abs(pmi) < 1e300 GROUP BY ALL),
stored AS (SELECT trim(a.str) AS word1, trim(b.str) AS word2, similarity FROM mean JOIN v a ON a.token = t JOIN v b ON b.token = w),
strs AS (SELECT str, min(token) AS token FROM v GROUP BY str)"""
_TRIED = """tried AS (SELECT word, unnest([1, 2, 3, 4]) AS c, unnest([word, ' ' || word, lower(word), ' ' || lower(word)]) AS str FROM asked),
resolved AS (SELECT word, arg_min(token, c) AS token FROM tried JOIN strs USING (str) GROUP BY word)"""
_VECTORS = """once AS (SELECT emb_id, any_value(token) AS token, any_value(e::DOUBLE[]) AS e FROM embedding WHERE token IS NOT NULL AND len(e) = 48 GROUP BY emb_id),
fine AS (SELECT * FROM once WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR abs(x) > 1e30)) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
tv AS (SELECT token, list(x ORDER BY j) AS e FROM (SELECT token, j, avg(x) AS x FROM (SELECT token, unnest(range(48)) AS j, unnest(e) AS x FROM fine) GROUP BY ALL) GROUP BY token)"""


def _spearman(name: str, score: str, digits: int) -> str:
    return f"""WITH {_STORED}, {_VECTORS}, bench AS (SELECT *, {name} AS name FROM stored), asked AS (SELECT DISTINCT word FROM (SELECT word1 AS word FROM bench UNION ALL SELECT word2 FROM bench)), {_TRIED},
known AS (SELECT word, e FROM resolved JOIN tv USING (token)),
scored AS (SELECT name, similarity, {score} AS score FROM bench LEFT JOIN known a ON a.word = word1 LEFT JOIN known b ON b.word = word2),
good AS (SELECT * FROM scored WHERE score IS NOT NULL),
ranks AS (SELECT name, rank() OVER (PARTITION BY name ORDER BY similarity) + (count(*) OVER (PARTITION BY name, similarity) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY name ORDER BY score) + (count(*) OVER (PARTITION BY name, score) - 1) / 2.0 AS rb FROM good),
r AS (SELECT name, count(*) AS benchmark_size, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END AS r FROM ranks GROUP BY name),
t AS (SELECT name, count(*) AS n_pairs FROM scored GROUP BY name)
SELECT name, n_pairs, coalesce(benchmark_size, 0) AS benchmark_size, round(coalesce(benchmark_size, 0) / n_pairs::DOUBLE, {digits}) AS coverage, round(r, {digits}) + 0.0 AS spearman_r FROM t LEFT JOIN r USING (name)"""


_RESP = """once AS (SELECT t, row_index, sense_id, max(r) AS r FROM responsibilities WHERE t IS NOT NULL AND row_index IS NOT NULL AND sense_id IS NOT NULL AND r IS NOT NULL AND NOT isnan(r) GROUP BY ALL)"""
_DECAY = """SELECT decay, direction, target, o, round(wt, 6) AS wt FROM (
  SELECT decay, direction, target, o::INTEGER AS o, CASE WHEN o = 0 THEN 1.0 WHEN decay = 'linear' THEN (4 - abs(o)) / 4.0 WHEN decay = 'harmonic' THEN 1.0 / abs(o)
    WHEN decay = 'exponential' THEN exp(-0.5 * abs(o)) WHEN decay = 'power' THEN pow(1 + abs(o), -0.5) ELSE 1.0 END::DOUBLE AS wt
  FROM (VALUES ('linear'), ('harmonic'), ('exponential'), ('power'), ('none')) d(decay), (VALUES ('symmetric'), ('forward'), ('backward')) e(direction), (VALUES (true), (false)) f(target), range(-4, 5) g(o)
  WHERE (direction <> 'forward' OR o >= 0) AND (direction <> 'backward' OR o <= 0) AND (o <> 0 OR target)) WHERE wt > 0"""
_SNIP = """named AS (SELECT p.doc_id, p.pos, c.pos - p.pos AS o, str FROM places p JOIN cur c ON c.doc_id = p.doc_id AND c.pos BETWEEN p.pos + {low} AND p.pos + {high} JOIN vocab v ON v.token = c.token WHERE str IS NOT NULL),
text AS (SELECT p.doc_id, p.pos, coalesce(string_agg(str, ' ' ORDER BY o) FILTER (o < 1), '') AS context_before, coalesce(string_agg(str, ' ' ORDER BY o) FILTER (o = 1), '') AS focus,
  coalesce(string_agg(str, ' ' ORDER BY o) FILTER (o > 1), '') AS context_after FROM places p LEFT JOIN named n ON n.doc_id = p.doc_id AND n.pos = p.pos GROUP BY ALL)"""
_EXTRACT = states._W + """, win AS (SELECT a.row, a.j, (a.x + b.x + c.x) / 3 AS x FROM h a JOIN h b ON b.row = a.row - 1 AND b.j = a.j JOIN h c ON c.row = a.row + 1 AND c.j = a.j),
l AS (SELECT win.row, w.token, sum(win.x * w.x) AS l FROM win JOIN w USING (j) GROUP BY ALL), p AS (SELECT row, token, exp(l) / sum(exp(l)) OVER (PARTITION BY row) AS p FROM l)"""

_STATES = """st AS (SELECT vec_id AS row, label, list_transform(embedding, lambda x: x::DOUBLE) AS h FROM embeddings WHERE embedding IS NOT NULL)"""

ORACLES = {
    "tokenize_positions": f"WITH {_WORDS} SELECT doc_id, pos, word FROM words",
    "vocab_counts": f"WITH {_WORDS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM words GROUP BY word",
    "token_counts": f"WITH {_FREQ} SELECT token, n, docs FROM freq",
    "decay_weights": _DECAY,
    "fcm_window": f"WITH {_FCM} SELECT t, w, round(f, 6) AS f FROM fcm",
    "fcm_pmi": f"""WITH {_FCM}, s AS (SELECT sum(f) AS s FROM fcm), a AS (SELECT t, sum(f) AS f_t FROM fcm GROUP BY t), b AS (SELECT w, sum(f) AS f_w FROM fcm GROUP BY w)
SELECT t, w, round(f, 6) AS f, round(ln(f * s / (f_t * f_w)), 6) + 0.0 AS pmi FROM fcm JOIN a USING (t) JOIN b USING (w), s""",
    "bigram_marginals": f"""WITH {_BIGRAM}, seen AS (SELECT token, sum(c * n / (c + 0.5 * (SELECT s FROM size))) AS more FROM bi JOIN ctx USING (prev) GROUP BY token),
rest AS (SELECT sum(c * 0.5 / (c + 0.5 * (SELECT s FROM size))) AS rest, sum(c) AS total FROM ctx) SELECT token, round((more + rest) / total, 9) AS z FROM seen, rest""",
    "bigram_pmi": f"""WITH {_BIGRAM}, z AS (SELECT token, sum(p * c) / sum(c) AS z FROM model GROUP BY token),
m AS (SELECT a.token AS t, b.token AS w, sum(a.c * a.p * b.p) / sum(a.c) AS m FROM model a JOIN model b USING (prev) GROUP BY ALL)
SELECT t, w, round(ln(m / (x.z * y.z)), 6) + 0.0 AS pmi FROM m JOIN z x ON x.token = t JOIN z y ON y.token = w""",
    "bigram_perplexity": f"WITH {_BIGRAM}, e AS (SELECT sum(n)::DOUBLE AS n, sum(-ln((n + 0.5) / (c + 0.5 * (SELECT s FROM size))) * n) / sum(n) AS loss FROM bi JOIN ctx USING (prev)) SELECT round(n, 5) AS n, round(loss, 5) AS loss, round(exp(loss), 5) AS perplexity FROM e",
    "window_avg_probability": f"""WITH {_BIGRAM}, x AS (SELECT doc_id, pos, model.token, p FROM cur JOIN model ON model.prev = cur.token),
a AS (SELECT b.doc_id, b.pos, b.token, (b.p + exp(-0.5) * (a.p + c.p)) / (1 + 2 * exp(-0.5)) AS x FROM x b JOIN x a ON a.doc_id = b.doc_id AND a.pos = b.pos - 1 AND a.token = b.token JOIN x c ON c.doc_id = b.doc_id AND c.pos = b.pos + 1 AND c.token = b.token)
SELECT token, count(*) AS n, round(avg(x), 6) AS mean, round(avg(x * x), 6) AS square FROM a GROUP BY token""",
    "window_avg_aitchison": f"""WITH {states._H}, e AS (SELECT a.row AS pos, a.j, (0.5 * b.x + a.x + 0.5 * c.x) / 2 AS x FROM h a JOIN h b ON b.row = a.row - 1 AND b.j = a.j JOIN h c ON c.row = a.row + 1 AND c.j = a.j)
SELECT pos, j, round(x, 6) + 0.0 AS x FROM e WHERE pos >= 1""",
    "extract_marginals": f"WITH {_EXTRACT}, e AS (SELECT token, avg(p) AS z, sum(p) AS z_sum FROM p GROUP BY token) SELECT token, round(z, 6) AS z, round(z_sum, 6) AS z_sum FROM e",
    "next_token_filter": f"WITH {_FREQ} SELECT a.doc_id, a.pos, a.token FROM cur a JOIN cur b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE b.token = (SELECT token FROM ranked WHERE r = 3)",
    "phrase_search": f"WITH {_FREQ} SELECT a.doc_id, a.pos FROM cur a JOIN cur b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.token = (SELECT token FROM ranked WHERE r = 1) AND b.token = (SELECT token FROM ranked WHERE r = 2)",
    "context_snippets": f"WITH {_CUR}, places AS (SELECT doc_id, pos - 1 AS pos FROM cur WHERE token IN (SELECT token FROM vocab WHERE boundary = 'document')), {_SNIP.format(low=-4, high=4)} SELECT * FROM text",
    "instance_labels": f"""WITH {_CUR}, places AS (SELECT a.doc_id, a.pos FROM cur a JOIN cur b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 ORDER BY md5(a.doc_id || '|' || a.pos), a.doc_id, a.pos LIMIT 200), {_SNIP.format(low=-4, high=1)}
SELECT doc_id, pos, trim(CASE WHEN true THEN context_before || ' ' || focus END) AS label FROM text""",
    "sense_snippets": f"""WITH {_CUR}, places AS (SELECT doc_id, pos FROM cur WHERE pos = 20), {_SNIP.format(low=-3, high=5)}
SELECT (doc_id % 3)::INT AS sense_id, 1 AS rank, 1.0::DOUBLE AS score, doc_id, pos, context_before, focus, context_after FROM text""",
    "uniform_subsample": f"WITH {_CUR} SELECT doc_id, pos, token FROM cur ORDER BY md5(doc_id || '|' || pos), doc_id, pos LIMIT 500",
    "valid_positions": f"WITH {_CUR}, l AS (SELECT doc_id, max(pos) + 1 AS length FROM cur GROUP BY doc_id) SELECT doc_id, unnest(range(0, length - 6)) AS row, unnest(range(4, length - 2)) AS pos FROM l WHERE length > 6",
    "training_blocks": f"""WITH {_CUR}, l AS (SELECT doc_id, max(pos) + 1 AS length FROM cur GROUP BY doc_id), s AS (SELECT doc_id, unnest(range(0, length - 16)) AS start FROM l WHERE length > 16),
c AS (SELECT * FROM s ORDER BY md5(doc_id || '|' || start), doc_id, start LIMIT 64), t AS (SELECT c.doc_id, start, list(token ORDER BY pos) AS l FROM c JOIN cur ON cur.doc_id = c.doc_id AND pos BETWEEN start AND start + 16 GROUP BY ALL)
SELECT doc_id, start, l[1:16] AS x, l[2:17] AS y FROM t WHERE len(l) = 17""",
    "pairs_enrich_oov": f"WITH {_STORED} SELECT word1, word2, round(similarity, 6) + 0.0 AS similarity, a.token AS t1, b.token AS t2 FROM stored LEFT JOIN strs a ON a.str = word1 LEFT JOIN strs b ON b.str = word2",
    "pairs_coverage": f"WITH {_STORED} SELECT count(*) AS pairs, count(*) FILTER (a.token IS NOT NULL AND b.token IS NOT NULL) AS known, count(*) FILTER (a.token IS NULL OR b.token IS NULL) AS unknown FROM stored LEFT JOIN strs a ON a.str = word1 LEFT JOIN strs b ON b.str = word2",
    "candidate_lookup": f"WITH {_STORED}, asked AS (SELECT DISTINCT word FROM (SELECT trim(str) AS word FROM vocab UNION ALL SELECT upper(trim(str)) FROM vocab) WHERE word IS NOT NULL), {_TRIED} SELECT word, token FROM resolved",
    "spearman_eval": _spearman("'stored'", "list_cosine_similarity(a.e, b.e)", 5),
    "spearman_dot": _spearman("'length ' || length(word1)", "list_dot_product(a.e, b.e)", 4),
    "sample_quality": """WITH q AS (SELECT log_z, CASE WHEN h IS NULL THEN 'null' WHEN len(h) <> 64 THEN 'length' WHEN len(list_filter(h::DOUBLE[], lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite'
  WHEN len(list_filter(h::DOUBLE[], lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'usable' END AS kind FROM work_sample) SELECT kind, count(*) AS n, count(log_z) AS with_log_z FROM q GROUP BY kind""",
    "sense_shares": f"WITH {_RESP} SELECT t, sense_id, count(*) AS n, round(avg(r), 6) + 0.0 AS share FROM once GROUP BY ALL",
    "sense_exemplars": f"WITH {_RESP}, k AS (SELECT *, row_number() OVER (PARTITION BY t, sense_id ORDER BY r DESC, row_index) AS rank FROM once) SELECT t, sense_id, rank, row_index, round(r, 6) + 0.0 AS r FROM k WHERE rank <= 3",
    "learning_rate_schedule": "SELECT step, round(CASE WHEN step < 20 THEN (step + 1) / 21.0::DOUBLE WHEN step > 150 THEN 0.1::DOUBLE ELSE 0.1 + 0.45 * (1 + cos(pi() * (step - 20) / 130.0)) END, 6) AS rate FROM range(200) r(step)",
    "training_plans": """WITH d AS (SELECT depth, ceil(depth * 64 / 64.0)::BIGINT * 64 AS n_embd FROM range(1, 41) r(depth)), h AS (SELECT *, ceil(floor(8 * n_embd / 3.0) / 256)::BIGINT * 256 AS hidden FROM d),
p AS (SELECT depth, (20 * depth * (4 * n_embd * n_embd + 3 * n_embd * hidden))::BIGINT AS tokens FROM h),
a AS (SELECT *, greatest(1, greatest(pow(2, round_even(log2(greatest(524288 * pow(tokens::DOUBLE / 1e10, 0.383), 12288)), 0)), 12288)::BIGINT // 12288) AS accumulation FROM p),
b AS (SELECT *, accumulation * 12288 AS batch FROM a), i AS (SELECT *, least(greatest(1, tokens // batch), greatest(1, 100000000 // batch)) AS iterations, sqrt(batch / 524288.0::DOUBLE) AS ratio FROM b)
SELECT depth, tokens, accumulation, iterations, round(6e-4::DOUBLE * ratio, 8) AS learning_rate, round(6e-5::DOUBLE * ratio, 8) AS least_rate, round(least(0.1::DOUBLE * ratio * (1e10::DOUBLE / tokens), 0.5), 8) AS weight_decay,
  greatest(100, least(2000, iterations // 20)) AS warmup, round(iterations * batch / 5e7::DOUBLE, 8) AS epochs_run FROM i""",
    "ilr_function": f"""WITH {_STATES}, x AS (SELECT row, unnest(h) AS x, generate_subscripts(h, 1) AS k FROM st), s AS (SELECT row, k, x, sum(x) OVER (PARTITION BY row ORDER BY k) AS s, lead(x) OVER (PARTITION BY row ORDER BY k) AS nxt FROM x)
SELECT row, (k)::INT AS i, round(sqrt(k / (k + 1.0::DOUBLE)) * (s / k - nxt), 6) AS y FROM s WHERE nxt IS NOT NULL""",
    "gram_by_label": f"""WITH {_STATES}, a AS (SELECT *, 1.0::DOUBLE + row % 3 AS wt FROM st), ij AS (SELECT i, j FROM range(3) x(i), range(3) y(j))
SELECT label, (i * 3 + j)::INT AS place, round(sum(wt * h[i + 1] * h[j + 1]), 4) AS g FROM a, ij GROUP BY label, i, j""",
    "model_shapes": """WITH d AS (SELECT depth, ceil(depth * 64 / 64.0)::BIGINT * 64 AS n_embd FROM range(1, 41) r(depth)), h AS (SELECT *, ceil(floor(8 * n_embd / 3.0) / 256)::BIGINT * 256 AS hidden FROM d),
p AS (SELECT depth, n_embd, n_embd // 64 AS n_head, depth * (4 * n_embd * n_embd + 3 * n_embd * hidden) AS n_params FROM h)
SELECT *, greatest(pow(2, round_even(log2(greatest(524288 * pow(n_params * 20.0::DOUBLE / 1e10, 0.383), 12288)), 0)), 12288)::BIGINT AS batch FROM p""",
    "composition_parts": """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity / 100 AS a, l_discount + 0.01 AS b, l_tax + 0.01 AS c FROM lineitem)
SELECT l_returnflag, l_linestatus, round(avg((ln(a) - ln(b)) / sqrt(2)), 6) + 0.0 AS y1, round(avg((ln(a) + ln(b) - 2 * ln(c)) / sqrt(6)), 6) + 0.0 AS y2, round(avg(a / (a + b + c)), 6) AS pa, round(avg(b / (a + b + c)), 6) AS pb,
  round(avg(c / (a + b + c)), 6) AS pc FROM r GROUP BY ALL""",
    "context_window_function": "SELECT o::INTEGER AS o, round(pow(1 + abs(o), -0.5), 6) AS wt FROM range(-3, 1) r(o)",
    "kish_by_label": "SELECT event_type, round(sum(value) ^ 2 / sum(value * value), 4) AS ess FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "stream_marginals": f"WITH {states._P} SELECT token, round(z, 6) AS z FROM z",
    "stream_event_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1",
}
