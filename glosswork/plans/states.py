"""Queries over the table of labelled vectors: states, with the centroid model as unembedding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import ilr_adjoint, ilr_apply, log_composition
from ..functions.vectors import dot, logsumexp
from ..functions.windowing import offsets
from ..operators import density, distinctiveness, embeddings, mixtures, moments, providers, similarity, vectorspace, views
from ..session import materialise
from ..sources.samples import window_pair_similarities, working_sample
from ..tables import table

#: Decimals to which values are compared.
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All DOUBLE columns rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.states(table(spark, sf_dir, "embeddings"))


def model(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States and the centroid unembedding."""
    states = labelled(spark, sf_dir)
    return states, providers.centroid_unembedding(states)


def sharp(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States and an unembedding of 32 single states, which predicts more sharply."""
    states = labelled(spark, sf_dir)
    return states, providers.sharp_unembedding(states)


def token_marginals(spark, sf_dir):
    """Mean and sum of every token's probability."""
    return rounded(moments.marginals(*model(spark, sf_dir)).select("token", "z", "z_sum"))


def token_marginals_long(spark, sf_dir):
    """The same from distributions in long form, as stored samples give them."""
    return rounded(moments.marginals_of(providers.probabilities(*model(spark, sf_dir))))


def moment_matrix(spark, sf_dir):
    """Mean product of the probabilities of each pair of tokens."""
    return rounded(moments.moments(*model(spark, sf_dir)).select("t", "w", "m"))


def moment_matrix_subset(spark, sf_dir):
    """The rows of three targets only."""
    return rounded(moments.moments(*model(spark, sf_dir), targets=[0, 3, 7]).select("t", "w", "m"))


def pmi_matrix(spark, sf_dir):
    """Association values of all pairs of tokens."""
    return rounded(moments.pmi(moments.moments(*model(spark, sf_dir))))


def pmi_sharp(spark, sf_dir):
    """Association values under the sharper model."""
    return rounded(moments.pmi(moments.moments(*sharp(spark, sf_dir))))


def pmi_top_tokens(spark, sf_dir):
    """Association values of the four most probable tokens with all."""
    states, w = model(spark, sf_dir)
    top = moments.marginals(states, w).orderBy(F.desc(F.round("z", 9)), "token").limit(4)
    return rounded(moments.pmi(moments.moments(states, w, targets=sorted(r["token"] for r in top.collect()))))


def _wide(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """States and a vocabulary of thousands: every usable state of the working sample is a token."""
    return labelled(spark, sf_dir), providers.usable_unembedding(table(spark, sf_dir, "work_sample"))


def moment_matrix_wide(spark, sf_dir):
    """Mean products of the probabilities of eight targets with a vocabulary of thousands, summed by target in absolute value and for one other token."""
    states, w = _wide(spark, sf_dir)
    w = materialise(w, "vocabulary")
    targets = sorted(r["token"] for r in w.select("token").orderBy("token").limit(8).collect())
    m = moments.moments(states, w, targets=targets)
    return rounded(m.groupBy("t").agg(F.count(F.lit(1)).alias("n"), (F.sum("m") * 1e3).alias("total"), (F.sum(F.when(F.col("t") == F.col("w"), F.col("m"))) * 1e6).alias("own")))


def pair_similarity_wide(spark, sf_dir):
    """The quantities of pairs of neighbouring tokens of that vocabulary; only these tokens are brought together."""
    states, w = _wide(spark, sf_dir)
    few = w.select(F.col("token").alias("t1")).orderBy("t1").limit(64)
    named = few.select("t1", F.lead("t1").over(Window.orderBy("t1")).alias("t2")).na.drop()  # 64 rows
    return rounded(similarity.pair_similarities(named, states, w), 5)


def pair_similarity_window(spark, sf_dir):
    """The quantities over states averaged in a window of one to both sides, from the states themselves."""
    states, w = model(spark, sf_dir)
    line = states.select(F.lit(0).cast("bigint").alias("doc_id"), F.col("row").alias("pos"), F.col("h").alias("v"))
    return rounded(window_pair_similarities(_all_pairs(w), line, w, offsets(spark, 1)))


def _all_pairs(unembedding: DataFrame) -> DataFrame:
    tokens = unembedding.select(F.col("token").alias("t1"))
    return tokens.join(tokens.select(F.col("t1").alias("t2")))


def pair_similarity(spark, sf_dir):
    """Expected probability, expected surprisal and divergence of every ordered pair."""
    states, w = model(spark, sf_dir)
    return rounded(similarity.pair_similarities(_all_pairs(w), states, w))


def pair_kl_sharp(spark, sf_dir):
    """Divergences under the sharper model."""
    states, w = sharp(spark, sf_dir)
    return rounded(similarity.pair_similarities(_all_pairs(w), states, w, ["kl"]))


def log_partition(spark, sf_dir):
    """Logarithm of the partition sum of every state."""
    return rounded(distinctiveness.with_log_partition(*model(spark, sf_dir)).select("row", "log_z"))


def log_partition_columns(spark, sf_dir):
    """The same by column expressions, within the JVM."""
    states, w = model(spark, sf_dir)
    return rounded(states.join(providers.as_row(w)).select("row", logsumexp(F.transform("model", lambda m: dot("h", m["w"]))).alias("log_z")))


def _field(spark, sf_dir, token: int = 0) -> DataFrame:
    states, w = model(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    return distinctiveness.distinctiveness_field(distinctiveness.with_log_partition(states, w), w, token, float(z[token]))


def distinctiveness_field(spark, sf_dir):
    """Distinctiveness of token 0 at every state."""
    return rounded(_field(spark, sf_dir))


def expected_distinctiveness(spark, sf_dir):
    """Mean distinctiveness of token 0, its effective sample size and mean weight."""
    return rounded(distinctiveness.expected_distinctiveness(_field(spark, sf_dir)), 5)


def expected_distinctiveness_all(spark, sf_dir):
    """The same for every token in one pass."""
    return rounded(distinctiveness.expected_distinctiveness_all(*model(spark, sf_dir)), 5)


def token_weights_ess(spark, sf_dir):
    """Sum of the weights of token 0 with the greatest scaled to one, and effective sample size."""
    states, w = model(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    weights = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, 0, float(z[0]), stabilise=True)
    return rounded(weights.agg(F.sum("omega").alias("total"), distinctiveness.effective_size().alias("ess")), 5)


def dplus_moment(spark, sf_dir):
    """Moments weighted by positive distinctiveness."""
    states, w = model(spark, sf_dir)
    return rounded(moments.excess_moments(states, w, moments.marginal_vector(states, w)))


def dplus_centroids(spark, sf_dir):
    """Mean states weighted by positive distinctiveness."""
    states, w = model(spark, sf_dir)
    return rounded(moments.centroids(states, w, z=moments.marginal_vector(states, w)))


def aitchison_centroids(spark, sf_dir):
    """Mean state of every token by probability, the overall mean taken off."""
    return rounded(moments.centroids(*model(spark, sf_dir), origin="aitchison"))


def aitchison_centroids_ilr(spark, sf_dir):
    """The same in log-ratio coordinates."""
    states, w = model(spark, sf_dir)
    return rounded(moments.in_ilr_space(w, moments.centroids(states, w, origin="aitchison")))


def unembedding_ilr(spark, sf_dir):
    """The unembedding in log-ratio coordinates."""
    return rounded(moments.ilr_of_unembedding(model(spark, sf_dir)[1]))


def ilr_pmi(spark, sf_dir):
    """Association values in log-ratio coordinates."""
    return rounded(moments.ilr_embedding(moments.pmi(moments.moments(*model(spark, sf_dir)))))


def ilr_roundtrip(spark, sf_dir):
    """Association values moved to log-ratio coordinates and back: rows with their mean taken off."""
    forth = moments.ilr_embedding(moments.pmi(moments.moments(*model(spark, sf_dir))))
    return rounded(ilr_adjoint(forth, ["t"]))


def ilr_states(spark, sf_dir):
    """Log-ratio coordinates of every predictive distribution."""
    p = providers.probabilities(*model(spark, sf_dir))
    return rounded(ilr_apply(p.withColumn("l", log_composition("p")), ["row"], "token", "l"))


def degenerate_direction(spark, sf_dir):
    """The direction whose products with all unembedding vectors are nearest to one; products with it."""
    _, w = sharp(spark, sf_dir)
    v = moments.degenerate_direction(w)
    return rounded(w.select("token", dot("w", F.array(*[F.lit(float(x)) for x in v])).alias("product")), 5)


CONTRASTS = [(0, 1), (2, 3), (4, 5)]


def contrast_projection(spark, sf_dir):
    """Coordinates of all states on three contrast axes."""
    states, w = model(spark, sf_dir)
    return rounded(vectorspace.on_axes(states, vectorspace.contrast_axes(w, CONTRASTS)))


def contrast_facets(spark, sf_dir):
    """All ordered pairs of two contrast coordinates of a state."""
    states, w = model(spark, sf_dir)
    return rounded(vectorspace.facets(vectorspace.on_axes(states, vectorspace.contrast_axes(w, CONTRASTS[:2]))))


def _knn(spark, sf_dir, metric):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("e"))
    found = vectorspace.nearest_tokens(v.where("id % 100 = 0"), v, 5, metric)
    return rounded(found.select("id", "rank", "score"), 5)


def knn_cosine(spark, sf_dir):
    """The five best vectors by cosine for every vector whose id is divisible by 100, against all."""
    return _knn(spark, sf_dir, "cosine")


def knn_euclidean(spark, sf_dir):
    """The same by distance."""
    return _knn(spark, sf_dir, "euclidean")


def standardize(spark, sf_dir):
    """Mean and spread of every component."""
    return rounded(vectorspace.standardisation(labelled(spark, sf_dir)))


def total_variance_by_label(spark, sf_dir):
    """Variance of states within and between labels."""
    return rounded(mixtures.variance_by_label(labelled(spark, sf_dir)))


def weighted_cov(spark, sf_dir):
    """Weighted covariance of states under token 0."""
    states, w = model(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, 0, float(z[0]))
    g = vectorspace.gram(states.join(omega, "row"), "h", "omega")
    total = F.broadcast(g.where("stat = 'w' AND j = 0").select(F.col("value").alias("sw")))
    s = g.where("stat = 's'")
    a, b = (s.select(F.col("j").alias(k), F.col("value").alias(f"s_{k}")) for k in ("i", "j"))
    joined = g.where("stat = 'g'").select("i", "j", "value").join(a, "i").join(b, "j").join(total)
    return rounded(joined.select("i", "j", (F.col("value") / F.col("sw") - F.col("s_i") * F.col("s_j") / (F.col("sw") * F.col("sw"))).alias("cov")))


def _points(spark, sf_dir, weight=None) -> DataFrame:
    states, w = model(spark, sf_dir)
    axes = vectorspace.contrast_axes(w, CONTRASTS[:2])
    (p, q) = axes.values()
    points = states.select("row", F.lit("0-1 2-3").alias("facet"), dot("h", F.array(*map(F.lit, p))).alias("x"), dot("h", F.array(*map(F.lit, q))).alias("y"))
    if weight is None:
        return points.withColumn("w", F.lit(1.0))
    z = moments.marginal_vector(states, w)
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, weight, float(z[weight]))
    return points.join(omega.withColumnRenamed("omega", "w"), "row")


def kde_grid(spark, sf_dir):
    """Kernel density of states on two contrast axes."""
    return rounded(density.kernel_density(_points(spark, sf_dir), ["facet"], 16), 5)


def kde_token(spark, sf_dir):
    """Kernel density under the weights of token 0."""
    return rounded(density.kernel_density(_points(spark, sf_dir, 0), ["facet"], 16), 5)


def kde_log_ratio(spark, sf_dir):
    """Logarithm of the density under the weights of token 0 over that of all states."""
    return rounded(density.log_ratio_density(_points(spark, sf_dir, 0), ["facet"], 16), 4)


def kde_tokens_scaled(spark, sf_dir):
    """Densities of the states of three labels, each scaled to a greatest value of one."""
    points = _points(spark, sf_dir).join(labelled(spark, sf_dir).select("row", F.col("label").alias("token")), "row").where("token < 3")
    return rounded(density.scaled_density(points, ["facet"], "token", 12), 5)


def kde_bands(spark, sf_dir):
    """How many of three levels the scaled density of token 0 exceeds at each place."""
    found = density.scaled_density(_points(spark, sf_dir, 0).withColumn("token", F.lit(0)), ["facet"], "token", 12)
    return density.bands(found.withColumn("density", F.round("density", 5)), [0.1, 0.3, 0.6]).select("gi", "gj", "band")


def pca_token(spark, sf_dir):
    """Variances of the principal axes of the states under token 0."""
    return rounded(pca_token_exact(spark, sf_dir))


def pca_token_exact(spark, sf_dir):
    states, w = model(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, 0, float(z[0]))
    _, axes, value = vectorspace.principal_axes(states.join(omega, "row"), "h", "omega")
    return vectorspace.axes_table(spark, axes, value).select("pc", "s")


def svd_embedding(spark, sf_dir):
    """Four-dimensional embedding of the tokens from association values in log-ratio coordinates."""
    y = moments.ilr_embedding(moments.pmi(moments.moments(*sharp(spark, sf_dir))))
    embedded, _, _ = vectorspace.svd_embedding(vectorspace.lists_of(y, "t", "i", "y"), 4)
    return embedded.select("t", F.transform("e", lambda x: F.round(x, 4)).alias("e"))


def embedding_products(spark, sf_dir):
    """Products of the tokens' embeddings in all dimensions, which are those of their association values in log-ratio coordinates."""
    made = embeddings.embed(*sharp(spark, sf_dir), k=31, alpha=1.0)
    a = made.vectors.select(F.col("token").alias("t1"), F.col("e").alias("a"))
    b = made.vectors.select(F.col("token").alias("t2"), F.col("e").alias("b"))
    return rounded(a.join(b).select("t1", "t2", dot("a", "b").alias("product")), 4)


def pca_trace(spark, sf_dir):
    """Sum of the variances of the principal axes of token 0, which is the trace of the weighted covariance."""
    return rounded(pca_token_exact(spark, sf_dir).agg(F.sum("s").alias("trace"), F.count(F.lit(1)).alias("axes")), 5)


def degenerate_products(spark, sf_dir):
    """Products of all unembedding vectors with the degenerate direction, over their mean: one."""
    _, w = model(spark, sf_dir)
    axis = moments.degenerate_direction(w)
    products = vectorspace.project(w.select("token", F.col("w").alias("h")), axis[:, None], out="p").select("token", F.get("p", F.lit(0)).alias("p"))
    mean = products.agg(F.avg("p")).first()[0]
    return rounded(products.select("token", (F.col("p") / F.lit(mean)).alias("product")), 5)


def field_weights(spark, sf_dir):
    """Weights of token 0 over a density of the states, here a spherical one."""
    states, w = model(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, 0, float(z[0]))
    dense = states.select("row", (dot("h", "h") * -0.5).alias("log_g")).join(omega, "row")
    return rounded(mixtures.field_weights(dense, "log_g").select("row", F.log("omega").alias("log_weight")), 5)


def suggest_axes(spark, sf_dir):
    """Token pairs whose contrasts are nearest to the principal axes."""
    states, w = sharp(spark, sf_dir)
    _, axes, value = vectorspace.principal_axes(states, "h")
    return rounded(vectorspace.suggest_contrasts(w, axes[:, :3], value, n=2), 4)


def suggest_axes_projection(spark, sf_dir):
    """Token pairs that lie farthest apart on each component of the unembedding."""
    _, w = sharp(spark, sf_dir)
    return rounded(vectorspace.suggest_contrasts(w, np.eye(64)[:, :4], np.ones(4), n=3, by="projection").drop("share"))


def _senses(spark, sf_dir, **options):
    states, w = sharp(spark, sf_dir)
    z = moments.marginal_vector(states, w)
    omega = distinctiveness.token_weights(distinctiveness.with_log_partition(states, w), w, 0, float(z[0]))
    lift = moments.unembedding_coordinates(moments.Model.of(w))
    return mixtures.fit_senses(states.select("row", "h").join(omega, "row"), 0, lift, **(options or {"k": 2, "tries": 1, "iterations": 25}))


def fit_senses(spark, sf_dir):
    """Two senses of token 0: share and mean state."""
    senses, _ = _senses(spark, sf_dir)
    return mixtures.sense_table(senses, table(spark, sf_dir, "embeddings")).select("t", "sense_id", "pi", "nu_h")


def sense_balance(spark, sf_dir):
    """What must hold of the senses of token 0, their number chosen by BIC: shares sum to one, greatest first, and variances within and between make up the whole."""
    senses, shares = _senses(spark, sf_dir, k=None)
    split = mixtures.variance_split(senses)
    once = shares.where("sense_id = 0").select(F.col("x").alias("x"), "omega")
    sums = vectorspace.gathered(vectorspace.gram(once, "x", "omega"))
    mean = sums["s"] / sums["w"][0]
    whole = float(np.trace(sums["g"] / sums["w"][0] - np.outer(mean, mean)))
    pi = senses.mixture.pi
    row = (round(float(pi.sum()), 6), bool((np.diff(pi) <= 0).all()), bool(1 <= len(pi) <= 5), bool(abs(split["within"] + split["between"] - whole) < 0.01 * whole))
    return spark.createDataFrame([row], "shares double, sorted boolean, chosen boolean, balanced boolean")


def sense_examples(spark, sf_dir):
    """The five states that show each sense best."""
    senses, shares = _senses(spark, sf_dir)
    return mixtures.sense_examples(shares, senses, 5)


def variance_split(spark, sf_dir):
    """Variance within and between the senses of token 0, of states and of log-ratio coordinates."""
    senses, _ = _senses(spark, sf_dir)
    rows = [(space, *(float(x) for x in mixtures.variance_split(senses, y).values())) for space, y in (("h", False), ("y", True))]
    return spark.createDataFrame(rows, "space string, within_var double, between_var double, total_var double, within_share double, between_share double")


def log_density(spark, sf_dir):
    """Logarithm of a fitted density at every state."""
    states = labelled(spark, sf_dir)
    fitted = density.DensityModel.fit(states, k=1)
    return rounded(states.select("row", fitted.log_density("h").alias("log_density")), 3)


def embedding_pipeline(spark, sf_dir):
    """Products of the tokens' embeddings, which no rotation or sign changes."""
    made = embeddings.embed(*sharp(spark, sf_dir), k=6)
    a = made.vectors.select(F.col("token").alias("t1"), F.col("e").alias("a"))
    b = made.vectors.select(F.col("token").alias("t2"), F.col("e").alias("b"))
    return rounded(a.join(b).select("t1", "t2", dot("a", "b").alias("product")), 4)


def _sample(spark, sf_dir):
    states, w = model(spark, sf_dir)
    return distinctiveness.with_log_partition(states, w), w


def density_view(spark, sf_dir):
    """Density of all states on three contrast axes, all ordered pairs of them."""
    sample, w = _sample(spark, sf_dir)
    return rounded(views.density_view(sample, w, n=8, basis="contrast", contrasts=CONTRASTS), 4)


def density_view_tokens(spark, sf_dir):
    """Densities of two tokens on the singular axes, each scaled to a greatest value of one."""
    sample, w = _sample(spark, sf_dir)
    z = moments.marginal_vector(*model(spark, sf_dir))
    return rounded(views.density_view(sample, w, {0: float(z[0]), 3: float(z[3])}, n=8, basis="global", pcs=(0, 1)), 3)


def distinctiveness_view(spark, sf_dir):
    """Where token 0 is more probable than overall, on two contrast axes."""
    sample, w = _sample(spark, sf_dir)
    z = moments.marginal_vector(*model(spark, sf_dir))
    return rounded(views.distinctiveness_view(sample, w, 0, float(z[0]), n=8, clip=2.0, basis="contrast", contrasts=CONTRASTS[:2]), 4)


def token_basis(spark, sf_dir):
    """Spread of the states on the first three principal axes of token 0."""
    sample, w = _sample(spark, sf_dir)
    z = moments.marginal_vector(*model(spark, sf_dir))
    on = embeddings.coordinates(sample, w, "token", 0, float(z[0]), (0, 1, 2))
    return rounded(on.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("x").alias("spread")), 4)


def work_sample_built(spark, sf_dir):
    """The working sample of 100 states with partition sums."""
    states, w = model(spark, sf_dir)
    return rounded(working_sample(states, w, 100).select("row_index", "log_z"))


_NAMES = (
    "token_marginals token_marginals_long moment_matrix moment_matrix_subset pmi_matrix pmi_sharp pmi_top_tokens pair_similarity pair_kl_sharp log_partition"
    " log_partition_columns distinctiveness_field expected_distinctiveness expected_distinctiveness_all token_weights_ess dplus_moment dplus_centroids"
    " aitchison_centroids aitchison_centroids_ilr unembedding_ilr ilr_pmi ilr_roundtrip ilr_states degenerate_direction contrast_projection contrast_facets"
    " knn_cosine knn_euclidean standardize total_variance_by_label weighted_cov kde_grid kde_token kde_log_ratio kde_tokens_scaled kde_bands pca_token"
    " svd_embedding moment_matrix_wide pair_similarity_wide pair_similarity_window embedding_products pca_trace degenerate_products field_weights suggest_axes suggest_axes_projection fit_senses sense_balance sense_examples variance_split log_density work_sample_built embedding_pipeline density_view density_view_tokens distinctiveness_view token_basis"
)
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_H = """h AS (SELECT vec_id AS row, label, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL)"""
_W = f"""{_H}, w AS (SELECT label AS token, j, 8 * avg(x) AS x FROM h GROUP BY ALL)"""
_W_SHARP = f"""{_H}, w AS (SELECT row::INTEGER AS token, j, 8 * x AS x FROM h WHERE row < 32)"""


def _p(w: str) -> str:
    return f"""{w}, l AS (SELECT h.row, w.token, sum(h.x * w.x) AS l FROM h JOIN w USING (j) GROUP BY ALL),
top AS (SELECT row, max(l) AS top FROM l GROUP BY row),
lz AS (SELECT l.row, any_value(top) + ln(sum(exp(l - top))) AS log_z FROM l JOIN top USING (row) GROUP BY l.row),
p AS (SELECT l.row, l.token, exp(l - log_z) AS p, l - log_z AS lp FROM l JOIN lz USING (row)),
z AS (SELECT token, avg(p) AS z, sum(p) AS z_sum FROM p GROUP BY token)"""


_P, _P_SHARP = _p(_W), _p(_W_SHARP)
_P_WIDE = """st AS (SELECT vec_id AS row, list_transform(embedding, lambda x: x::DOUBLE) AS h FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT row_index::INTEGER AS token, any_value(list_transform(h, lambda x: x::DOUBLE)) AS v FROM work_sample WHERE row_index IS NOT NULL AND len(h) = 64
  AND len(list_filter(h, lambda x: x IS NULL OR isnan(x) OR abs(x) > 1e30)) = 0 AND len(list_filter(h, lambda x: x <> 0)) > 0 GROUP BY row_index),
w AS (SELECT token, v, 8 / sqrt(list_dot_product(v, v)) AS k FROM v), l AS MATERIALIZED (SELECT row, token, k * list_dot_product(h, v) AS l FROM st, w),
lz AS (SELECT row, max(l) AS top, ln(sum(exp(l))) AS log_z FROM l GROUP BY row), p AS MATERIALIZED (SELECT row, token, exp(l - log_z) AS p, l - log_z AS lp FROM l JOIN lz USING (row)),
z AS MATERIALIZED (SELECT token, avg(p) AS z, sum(p) AS z_sum FROM p GROUP BY token)"""
_W_WINDOW = f"""h0 AS (SELECT vec_id AS row, label, unnest(range(len(embedding))) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE embedding IS NOT NULL), w AS (SELECT label AS token, j, 8 * avg(x) AS x FROM h0 GROUP BY ALL),
h AS (SELECT a.row, a.j, (a.x + b.x + c.x) / 3 AS x FROM h0 a JOIN h0 b ON b.row = a.row - 1 AND b.j = a.j JOIN h0 c ON c.row = a.row + 1 AND c.j = a.j)"""
_M = "m AS (SELECT a.token AS t, b.token AS w, avg(a.p * b.p) AS m FROM p a JOIN p b USING (row) GROUP BY ALL)"
_PMI = f"""{_M}, pmi AS (SELECT t, w, ln(greatest(m, 1e-30)) - ln(greatest(x.z, 1e-30)) - ln(greatest(y.z, 1e-30)) AS pmi
FROM m JOIN z x ON x.token = t JOIN z y ON y.token = w)"""
_D = "d AS (SELECT row, token, lp - ln(z) AS d, exp(lp - ln(z)) AS omega FROM p JOIN z USING (token))"
_PAIRS = """sums AS (SELECT a.token AS t1, b.token AS t2, sum(a.p * b.p) AS e, sum(a.p * greatest(b.lp, ln(1e-30))) AS c, sum(a.p * greatest(a.lp, ln(1e-30))) AS o
  FROM p a JOIN p b USING (row) GROUP BY ALL),
pairs AS (SELECT t1, t2, e / greatest(x.z_sum, 1e-30) AS expected_probability, -c / greatest(x.z_sum, 1e-30) AS expected_surprisal,
  (o - c) / greatest(x.z_sum, 1e-30) + ln(greatest(y.z, 1e-30)) - ln(greatest(x.z, 1e-30)) AS kl
  FROM sums JOIN z x ON x.token = t1 JOIN z y ON y.token = t2)"""
_A = """a AS (SELECT j, i, sqrt(1 / (i * (i + 1.0))) * s - sqrt(i / (i + 1.0)) * n AS y FROM (
  SELECT j, row_number() OVER o AS i, sum(x) OVER o AS s, lead(x) OVER o AS n FROM w WINDOW o AS (PARTITION BY j ORDER BY token)) WHERE n IS NOT NULL)"""
_CENTROID = """mean AS (SELECT j, avg(x) AS mean FROM h GROUP BY j),
c AS (SELECT p.token AS t, h.j, sum(p.p * h.x) / greatest(sum(p.p), 1e-30) AS x FROM p JOIN h USING (row) GROUP BY ALL),
centred AS (SELECT t, j, x - mean AS x FROM c JOIN mean USING (j))"""
_ILR_PMI = f"""{_PMI}, y AS (SELECT t, i, sqrt(1 / (i * (i + 1.0))) * s - sqrt(i / (i + 1.0)) * n AS y FROM (
  SELECT t, row_number() OVER o AS i, sum(pmi) OVER o AS s, lead(pmi) OVER o AS n FROM pmi WINDOW o AS (PARTITION BY t ORDER BY w)) WHERE n IS NOT NULL)"""


def _axis(p: int, n: int) -> str:
    return f"SELECT '{p}-{n}' AS axis, j, a.x - b.x AS x FROM w a JOIN w b USING (j) WHERE a.token = {p} AND b.token = {n}"


_ON_AXES = "axes AS (" + " UNION ALL ".join(_axis(*c) for c in CONTRASTS) + "), onto AS (SELECT row, axis, sum(h.x * axes.x) AS x FROM h JOIN axes USING (j) GROUP BY ALL)"
_XY = """xy AS (SELECT a.row, a.x, b.x AS y FROM onto a JOIN onto b USING (row) WHERE a.axis = '0-1' AND b.axis = '2-3')"""


def _shape(points: str, name: str, by: str = "") -> str:
    """Bounds and kernel of weighted points ``(by, x, y, w)``."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")  # by must not be f, the bandwidth factor
    return f"""{name} AS (SELECT {keys}sw, lx, hx, ly, hy, f, f * f * c * (sxx / sw - sx * sx / sw / sw) AS cxx, f * f * c * (sxy / sw - sx * sy / sw / sw) AS cxy,
  f * f * c * (syy / sw - sy * sy / sw / sw) AS cyy FROM (SELECT *, 1 / (1 - sww / (sw * sw)) AS c, pow(sw * sw / sww, -1.0 / 6) AS f FROM (
  SELECT {keys}sum(w) AS sw, sum(w * w) AS sww, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy,
    min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy FROM {points} {group})))"""


def _grid(shape: str, n: int, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    return f"""g AS (SELECT {keys}gi, gj, lx - 0.05 * (hx - lx) + 1.1 * (hx - lx) * gi / {n - 1}.0 AS gx, ly - 0.05 * (hy - ly) + 1.1 * (hy - ly) * gj / {n - 1}.0 AS gy
  FROM {shape}, range({n}) a(gi), range({n}) b(gj))"""


def _kernel(s: str) -> str:
    det = f"({s}.cxx * {s}.cyy - {s}.cxy * {s}.cxy)"
    return f"""exp(-0.5 * ({s}.cyy * (q.x - gx) * (q.x - gx) - 2 * {s}.cxy * (q.x - gx) * (q.y - gy) + {s}.cxx * (q.y - gy) * (q.y - gy)) / {det}) / (2 * pi() * sqrt{det})"""


_PLAIN = f"{_W}, {_ON_AXES}, {_XY}, q AS (SELECT row, x, y, 1.0::DOUBLE AS w FROM xy)"
_TOKEN0 = f"{_P}, {_D}, {_ON_AXES}, {_XY}, q AS (SELECT row, x, y, omega AS w FROM xy JOIN d USING (row) WHERE token = 0)"


def _r(*columns: str, digits: int = DIGITS) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


_SIMPLE = {
    "token_marginals": (_P, f"SELECT token, {_r('z', 'z_sum')} FROM z"),
    "token_marginals_long": (_P, f"SELECT token, {_r('z', 'z_sum')} FROM z"),
    "sense_balance": (_H, "SELECT 1.0::DOUBLE AS shares, TRUE AS sorted, TRUE AS chosen, TRUE AS balanced"),
    "moment_matrix_wide": (f"{_P_WIDE}, m AS (SELECT a.token AS t, b.token AS w, avg(a.p * b.p) AS m FROM (SELECT * FROM p WHERE token IN (SELECT token FROM w ORDER BY token LIMIT 8)) a JOIN p b USING (row) GROUP BY ALL), e AS (SELECT t, count(*) AS n, sum(m) * 1e3 AS total, sum(m) FILTER (t = w) * 1e6 AS own FROM m GROUP BY t)", f"SELECT t, n, {_r('total', 'own')} FROM e"),
    "pair_similarity_wide": (f"""{_P_WIDE}, few AS (SELECT token, lead(token) OVER (ORDER BY token) AS t2 FROM (SELECT token FROM w ORDER BY token LIMIT 64)),
sums AS (SELECT a.token AS t1, b.token AS t2, sum(a.p * b.p) AS e, sum(a.p * greatest(b.lp, ln(1e-30))) AS c, sum(a.p * greatest(a.lp, ln(1e-30))) AS o FROM few f JOIN p a ON a.token = f.token JOIN p b ON b.row = a.row AND b.token = f.t2 GROUP BY ALL),
pairs AS (SELECT t1, t2, e / greatest(x.z_sum, 1e-30) AS expected_probability, -c / greatest(x.z_sum, 1e-30) AS expected_surprisal, (o - c) / greatest(x.z_sum, 1e-30) + ln(greatest(y.z, 1e-30)) - ln(greatest(x.z, 1e-30)) AS kl
  FROM sums JOIN z x ON x.token = t1 JOIN z y ON y.token = t2)""", f"SELECT t1, t2, {_r('expected_probability', 'expected_surprisal', 'kl', digits=5)} FROM pairs"),
    "pair_similarity_window": (f"""{_p(_W_WINDOW)}, {_PAIRS}""", f"SELECT t1, t2, {_r('expected_probability', 'expected_surprisal', 'kl')} FROM pairs"),
    "embedding_products": (f"{_P_SHARP}, {_ILR_PMI}, e AS (SELECT a.t AS t1, b.t AS t2, sum(a.y * b.y) AS product FROM y a JOIN y b USING (i) GROUP BY ALL)", f"SELECT t1, t2, {_r('product', digits=4)} FROM e"),
    "pca_trace": (f"""{_P}, {_D}, o AS (SELECT row, omega FROM d WHERE token = 0), s AS (SELECT sum(omega) AS sw FROM o), m AS (SELECT j, sum(omega * x) / any_value(sw) AS m FROM h JOIN o USING (row), s GROUP BY j),
e AS (SELECT sum(omega * (x - m) * (x - m)) / any_value(sw) AS trace, count(DISTINCT j) AS axes FROM h JOIN o USING (row) JOIN m USING (j), s)""", f"SELECT {_r('trace', digits=5)}, axes FROM e"),
    "degenerate_products": (_H, "SELECT label AS token, 1.0::DOUBLE AS product FROM h GROUP BY label"),
    "field_weights": (f"{_P}, {_D}, g AS (SELECT row, -0.5 * sum(x * x) AS g FROM h GROUP BY row), e AS (SELECT row, ln(greatest(omega, 1e-300)) - greatest(g, -30) AS log_weight FROM d JOIN g USING (row) WHERE token = 0)", f"SELECT row, {_r('log_weight', digits=5)} FROM e"),
    "moment_matrix": (f"{_P}, {_M}", f"SELECT t, w, {_r('m')} FROM m"),
    "moment_matrix_subset": (f"{_P}, {_M}", f"SELECT t, w, {_r('m')} FROM m WHERE t IN (0, 3, 7)"),
    "pmi_matrix": (f"{_P}, {_PMI}", f"SELECT t, w, {_r('pmi')} FROM pmi"),
    "pmi_sharp": (f"{_P_SHARP}, {_PMI}", f"SELECT t, w, {_r('pmi')} FROM pmi"),
    "pmi_top_tokens": (f"{_P}, {_PMI}", f"SELECT t, w, {_r('pmi')} FROM pmi WHERE t IN (SELECT token FROM z ORDER BY round(z, 9) DESC, token LIMIT 4)"),
    "pair_similarity": (f"{_P}, {_PAIRS}", f"SELECT t1, t2, {_r('expected_probability', 'expected_surprisal', 'kl')} FROM pairs"),
    "pair_kl_sharp": (f"{_P_SHARP}, {_PAIRS}", f"SELECT t1, t2, {_r('kl')} FROM pairs"),
    "log_partition": (_P, f"SELECT row, {_r('log_z')} FROM lz"),
    "log_partition_columns": (_P, f"SELECT row, {_r('log_z')} FROM lz"),
    "distinctiveness_field": (f"{_P}, {_D}", f"SELECT row, {_r('d')} FROM d WHERE token = 0"),
    "expected_distinctiveness": (f"{_P}, {_D}, e AS (SELECT sum(omega * d) / sum(omega) AS kl, sum(omega) ^ 2 / sum(omega * omega) AS ess, avg(omega) AS mean_omega FROM d WHERE token = 0)", f"SELECT {_r('kl', 'ess', 'mean_omega', digits=5)} FROM e"),
    "expected_distinctiveness_all": (f"{_P}, {_D}, e AS (SELECT token, sum(omega * d) / sum(omega) AS kl, sum(omega) ^ 2 / sum(omega * omega) AS ess, avg(omega) AS mean_omega FROM d GROUP BY token)", f"SELECT token, {_r('kl', 'ess', 'mean_omega', digits=5)} FROM e"),
    "token_weights_ess": (f"{_P}, {_D}, e AS (SELECT sum(omega) / max(omega) AS total, sum(omega) ^ 2 / sum(omega * omega) AS ess FROM d WHERE token = 0)", f"SELECT {_r('total', 'ess', digits=5)} FROM e"),
    "dplus_moment": (f"{_P}, {_D}, e AS (SELECT d.token AS t, p.token AS w, avg(greatest(d, 0) * p) AS m, avg(greatest(d, 0)) AS z_d FROM d JOIN p USING (row) GROUP BY ALL)", f"SELECT t, w, {_r('m', 'z_d')} FROM e"),
    "dplus_centroids": (f"{_P}, {_D}, e AS (SELECT d.token AS t, h.j, sum(greatest(d, 0) * x) / greatest(sum(greatest(d, 0)), 1e-30) AS x FROM d JOIN h USING (row) GROUP BY ALL)", f"SELECT t, j, {_r('x')} FROM e"),
    "aitchison_centroids": (f"{_P}, {_CENTROID}", f"SELECT t, j, {_r('x')} FROM centred"),
    "aitchison_centroids_ilr": (f"{_P}, {_CENTROID}, {_A}, e AS (SELECT t, i, sum(centred.x * a.y) AS y FROM centred JOIN a USING (j) GROUP BY ALL)", f"SELECT t, i, {_r('y')} FROM e"),
    "unembedding_ilr": (f"{_W}, {_A}", f"SELECT i, j, {_r('y')} FROM a"),
    "ilr_pmi": (f"{_P}, {_ILR_PMI}", f"SELECT t, i, {_r('y')} FROM y"),
    "ilr_roundtrip": (f"{_P}, {_PMI}, e AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY w) AS i, pmi - avg(pmi) OVER (PARTITION BY t) AS x FROM pmi)", f"SELECT t, i, {_r('x')} FROM e"),
    "ilr_states": (f"{_P}, {_A}, e AS (SELECT row, i, sum(h.x * a.y) AS y FROM h JOIN a USING (j) GROUP BY ALL)", f"SELECT row, i, {_r('y')} FROM e"),
    "contrast_projection": (f"{_W}, {_ON_AXES}", f"SELECT row, axis, {_r('x')} FROM onto"),
    "contrast_facets": (f"{_W}, {_ON_AXES}, e AS (SELECT a.row, a.axis AS x_label, b.axis AS y_label, a.x, b.x AS y FROM onto a JOIN onto b USING (row) WHERE a.axis <> b.axis AND a.axis <> '4-5' AND b.axis <> '4-5')", f"SELECT row, x_label, y_label, {_r('x', 'y')} FROM e"),
    "standardize": (f"{_H}, e AS (SELECT j, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END AS std FROM h GROUP BY j)", f"SELECT j, {_r('mean', 'std')} FROM e"),
    "total_variance_by_label": (f"""{_H}, c AS (SELECT label, j, avg(x) AS m, count(*) AS n, var_pop(x) AS v FROM h GROUP BY ALL), t AS (SELECT sum(v) AS total_var FROM (SELECT var_pop(x) AS v FROM h GROUP BY j)),
k AS (SELECT sum(n * v) / (SELECT count(DISTINCT row) FROM h) AS within_var FROM c), e AS (SELECT within_var, total_var - within_var AS between_var, total_var, within_var / total_var AS within_share FROM k, t)""", f"SELECT {_r('within_var', 'between_var', 'total_var', 'within_share')} FROM e"),
    "weighted_cov": (f"""{_P}, {_D}, o AS (SELECT row, omega FROM d WHERE token = 0), s AS (SELECT sum(omega) AS sw FROM o), m AS (SELECT j, sum(omega * x) / any_value(sw) AS m FROM h JOIN o USING (row), s GROUP BY j),
e AS (SELECT a.j AS i, b.j, sum(omega * (a.x - ma.m) * (b.x - mb.m)) / any_value(sw) AS cov FROM h a JOIN h b USING (row) JOIN o USING (row) JOIN m ma ON ma.j = a.j JOIN m mb ON mb.j = b.j, s GROUP BY ALL)""", f"SELECT i, j, {_r('cov')} FROM e"),
    "kde_grid": (f"{_PLAIN}, {_shape('q', 's')}, {_grid('s', 16)}, e AS (SELECT '0-1 2-3' AS facet, gi, gj, gx AS x, gy AS y, sum(q.w / s.sw * {_kernel('s')}) AS density FROM g, s, q GROUP BY ALL)", f"SELECT facet, gi, gj, {_r('x', 'y', 'density', digits=5)} FROM e"),
    "kde_token": (f"{_TOKEN0}, {_shape('q', 's')}, {_grid('s', 16)}, e AS (SELECT '0-1 2-3' AS facet, gi, gj, gx AS x, gy AS y, sum(q.w / s.sw * {_kernel('s')}) AS density FROM g, s, q GROUP BY ALL)", f"SELECT facet, gi, gj, {_r('x', 'y', 'density', digits=5)} FROM e"),
    "density_view": (f"""{_W}, {_ON_AXES}, q AS (SELECT a.row, a.axis || ' ' || b.axis AS facet, a.x, b.x AS y, 1.0::DOUBLE AS w FROM onto a JOIN onto b USING (row) WHERE a.axis <> b.axis),
{_shape('q', 's', 'facet')}, {_grid('s', 8, 'facet')}, e AS (SELECT split_part(facet, ' ', 1) AS x_label, split_part(facet, ' ', 2) AS y_label, gi, gj, gx AS x, gy AS y, sum(q.w / s.sw * {_kernel('s')}) AS density FROM g JOIN s USING (facet) JOIN q USING (facet) GROUP BY ALL)""", f"SELECT x_label, y_label, gi, gj, {_r('x', 'y', 'density', digits=4)} FROM e"),
    "kde_log_ratio": (f"""{_TOKEN0}, u AS (SELECT row, x, y, 1.0::DOUBLE AS w FROM q), {_shape('u', 'f')}, {_shape('q', 'o')}, {_grid('f', 16)},
r AS (SELECT o.sw, o.cxx * k AS cxx, o.cxy * k AS cxy, o.cyy * k AS cyy FROM o, (SELECT (f.f / o.f) ^ 2 AS k FROM f, o)),
e AS (SELECT '0-1 2-3' AS facet, gi, gj, gx AS x, gy AS y, ln(greatest(sum(q.w / r.sw * {_kernel('r')}), 1e-12)) - ln(greatest(sum({_kernel('f')} / f.sw), 1e-12)) AS log_ratio FROM g, f, r, q GROUP BY ALL)""", f"SELECT facet, gi, gj, {_r('x', 'y', 'log_ratio', digits=4)} FROM e"),
    "kde_tokens_scaled": (f"""{_W}, {_ON_AXES}, {_XY}, lab AS (SELECT vec_id AS row, label AS token FROM embeddings WHERE label < 3), q AS (SELECT row, token, x, y, 1.0::DOUBLE AS w FROM xy JOIN lab USING (row)),
{_shape('q', 's', 'token')}, {_grid('s', 12, 'token')}, k AS (SELECT g.token, gi, gj, gx AS x, gy AS y, sum(q.w / s.sw * {_kernel('s')}) AS density FROM g JOIN s USING (token) JOIN q USING (token) GROUP BY ALL),
e AS (SELECT '0-1 2-3' AS facet, token, gi, gj, x, y, density / max(density) OVER (PARTITION BY token) AS density FROM k)""", f"SELECT facet, token, gi, gj, {_r('x', 'y', 'density', digits=5)} FROM e"),
    "kde_bands": (f"""{_TOKEN0}, {_shape('q', 's')}, {_grid('s', 12)}, k AS (SELECT gi, gj, sum(q.w / s.sw * {_kernel('s')}) AS density FROM g, s, q GROUP BY ALL),
e AS (SELECT gi, gj, round(density / max(density) OVER (), 5) AS density FROM k)""", "SELECT gi, gj, (density > 0.1)::INTEGER + (density > 0.3)::INTEGER + (density > 0.6)::INTEGER AS band FROM e"),
    "suggest_axes_projection": (f"""{_W_SHARP}, r AS (SELECT j AS pc, token, x, row_number() OVER (PARTITION BY j ORDER BY x DESC, token) AS rp, row_number() OVER (PARTITION BY j ORDER BY x, token) AS rn FROM w WHERE j < 4),
e AS (SELECT a.pc, a.rp AS rank, a.token AS positive, b.token AS negative, a.x - b.x AS score FROM r a JOIN r b ON a.pc = b.pc AND a.rp = b.rn WHERE a.rp <= 3 AND a.token <> b.token)""", f"SELECT pc, rank, positive, negative, {_r('score')} FROM e"),
    "work_sample_built": (f"{_P}, e AS (SELECT row AS row_index, log_z FROM lz WHERE row IN (SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 100))", f"SELECT row_index, {_r('log_z')} FROM e"),
}
ORACLES = {name: f"WITH {ctes} {select}" for name, (ctes, select) in _SIMPLE.items()}
for _name, _score in (("knn_cosine", "list_cosine_similarity(a.v, b.v)"), ("knn_euclidean", "-(list_distance(a.v, b.v) ^ 2)")):
    ORACLES[_name] = f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.id, {_score} AS s, b.id AS other FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 9) DESC, other) AS rank FROM s)
SELECT id, rank, round(s, 5) + 0.0 AS score FROM r WHERE rank <= 5"""
