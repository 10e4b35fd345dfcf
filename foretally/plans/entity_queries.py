"""Fitted preprocessing, embeddings, clusters, models, folds, sources and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from foretally import session
from foretally.operators import cluster as cl, eb, embed, metrics, model, prepare, registry as reg
from foretally.plans.bindings import LATEST, PAST, LAST_SEASON, PIT_ORDER, PIT_SQL_ORDER, pit, table
from foretally.plans.catalog import query
from foretally.plans.eb_queries import TE_KEYS
from foretally.sources import files

KEY_SQL = "season, day, game, ctx, opp, entity"


@query("fold_preprocessing", "M1", TE_KEYS + " z_cents:d5 z_cents_missing:i z_price:d5 z_qty:d5", f"""
WITH f AS (SELECT cents a, price b, ln(1 + qty) c FROM pit WHERE season < {LAST_SEASON}), q AS (SELECT {', '.join(f"quantile_cont({x}, 0.5) {x}m, quantile_cont({x}, 0.001) {x}l, quantile_cont({x}, 0.999) {x}h" for x in 'abc')} FROM f),
s AS (SELECT {', '.join(f"avg(least(greatest(coalesce({x}, {x}m), {x}l), {x}h)) {x}mean, stddev_pop(least(greatest(coalesce({x}, {x}m), {x}l), {x}h)) {x}sd" for x in 'abc')} FROM f, q)
SELECT {KEY_SQL}, (least(greatest(coalesce(cents, am), al), ah) - amean) / asd z_cents, (cents IS NULL)::INT z_cents_missing, (least(greatest(price, bl), bh) - bmean) / bsd z_price,
 (least(greatest(ln(1 + qty), cl), ch) - cmean) / csd z_qty FROM pit, q, s""")
def fold_preprocessing(spark, sf):
    """Log, impute, clip and standardise with parameters of the fit rows."""
    rows = pit(spark, sf)
    fitted = prepare.fit_columns(rows.filter(PAST), ["cents", "price", "qty"], ["qty"])
    return prepare.apply_columns(rows, fitted)


ENT = "e AS (SELECT entity, avg(qty) a, avg(price) b, avg(tax0) c, count(*) n, avg(y) r FROM pit WHERE season < 2001 GROUP BY 1)"


def entities(spark, sf):
    return pit(spark, sf).filter(PAST).groupBy("entity").agg(
        F.avg("qty").alias("a"), F.avg("price").alias("b"), F.avg("tax0").alias("c"), F.count("*").alias("n"), F.avg("y").alias("r"))


@query("robust_scaling", "M2", "entity:i a:d5 b:d5 c:d5", f"""
WITH {ENT}, q AS (SELECT {', '.join(f"quantile_cont({x}, 0.1) {x}l, quantile_cont({x}, 0.5) {x}m, quantile_cont({x}, 0.9) {x}h" for x in 'abc')} FROM e)
SELECT entity, {', '.join(f"least(greatest(({x} - {x}m) / ({x}h - {x}l), -5), 5) {x}" for x in 'abc')} FROM e, q""")
def robust_scaling(spark, sf):
    """Median-centred columns over the 10-90 range, bounded."""
    return prepare.robust_scaled(entities(spark, sf), ["a", "b", "c"])[0]


@query("quantile_normal_scaling", "M3", "entity:i qa:d5 clipped:d", f"""
WITH {ENT}, k AS (SELECT *, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 - 0.5) / count(*) OVER () p FROM e), t AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) t FROM k),
z AS (SELECT entity, (CASE WHEN p < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)) qa FROM t)
SELECT entity, qa, (SELECT avg((abs(qa) >= 1.5)::INT) FROM z) clipped FROM z""")
def quantile_normal_scaling(spark, sf):
    """Average-rank percentiles mapped to a normal shape, with the clipped share."""
    out = prepare.quantile_normal(entities(spark, sf), "a", "qa")
    return out.withColumn("clipped", prepare.clipped_share(out, ["qa"], 1.5).select("share").scalar())


def vectors(spark, sf):
    return embed.array_columns(table(spark, sf, "embeddings"), "embedding", 64)


@query("principal_components", "M4", "vec_id:i pc00:d4 pc01:d4 pc02:d4")
def principal_components(spark, sf):
    """Leading components of the embedding table."""
    rows, names = vectors(spark, sf)
    return embed.principal_components(rows, names, 3)[0]


def residual_cells(spark, sf):
    from foretally.operators.profiles import response_residuals, usage_residuals
    rows = pit(spark, sf).filter(PAST)
    long = usage_residuals(rows, "entity", "season", "lab", ["ctx", "hand"], 200.0).unionByName(
        response_residuals(rows, "entity", "season", "lab", ["ctx"], ["qty"], 200.0))
    return session.checkpoint(long.groupBy("entity", "feature").agg(F.avg("resid").alias("resid")))


@query("residual_svd", "M5", "entity:i svd00:d4 svd01:d4")
def residual_svd(spark, sf):
    """Truncated SVD of long response residuals per entity."""
    return embed.truncated_svd(residual_cells(spark, sf), "entity", "feature", "resid", 2, tolerance=0.01)[0]


@query("residual_svd_checks", "M5", "rows:i orthogonal:i residual_ok:i energy_split:i falling:i", """
SELECT count(DISTINCT entity) AS "rows", 1 orthogonal, 1 residual_ok, 1 energy_split, 1 falling FROM pit WHERE season < 2001""")
def residual_svd_checks(spark, sf):
    """Truncated SVD of long response residuals: scores of every entity and what holds for any exact one."""
    cells = residual_cells(spark, sf)
    left, right, sigma, residual = embed.truncated_svd(cells, "entity", "feature", "resid", 2, tolerance=0.01)
    told = embed.reconstruction(cells, left, right, "entity", "feature", "resid", ["svd00", "svd01"])
    cross = left.agg(F.count("*").alias("rows"), F.sum(F.expr("svd00 * svd01")).alias("dot"), F.sum(F.expr("svd00 * svd00")).alias("top"))
    kept = F.lit(sum(s * s for s in sigma))
    return told.crossJoin(cross).select(
        "rows", (F.abs("dot") <= 1e-6 * F.col("top")).alias("orthogonal"), F.lit(residual <= 0.01).alias("residual_ok"),
        (F.abs(F.col("energy") - kept - F.col("left_over")) <= 1e-6 * F.col("energy")).alias("energy_split"),
        F.lit(sigma[0] >= sigma[1] > 0).alias("falling"))


def pair_svd(spark, sf):
    rows = pit(spark, sf)
    fit = eb.context_residual(rows.filter(PAST), "y", "season", "season")
    cells = embed.interaction_cells(fit, "entity", "opp", "residual", 20.0, "season", LAST_SEASON, 2.0, 20.0, 2.0)
    left, right, _, _ = embed.truncated_svd(cells, "entity", "opp", "value", 3, tolerance=0.02)
    pairs = rows.filter(LATEST).select("entity", "opp").distinct()
    return embed.pair_scores(pairs, left, right, "entity", "opp", ["svd00", "svd01", "svd02"])


@query("pair_svd_scores", "M6", "entity:i opp:i pair_score:d6 pair_known:i")
def pair_svd_scores(spark, sf):
    """Joint SVD of pair residuals scored on the last season's pairs."""
    return pair_svd(spark, sf)


@query("pair_svd_checks", "M6", "entity:i opp:i pair_known:i bounded:i zero_if_unknown:i", """
WITH fit AS (SELECT * FROM pit WHERE season < 2001), c AS (SELECT entity, opp, sum(0.5 ** ((2001 - season) / 2.0)) n FROM fit GROUP BY 1, 2),
a AS (SELECT entity FROM c GROUP BY 1 HAVING sum(n) >= 20), b AS (SELECT opp FROM c GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT DISTINCT entity, opp FROM c WHERE entity IN (FROM a) AND opp IN (FROM b))
SELECT DISTINCT entity, opp, (entity IN (SELECT entity FROM k) AND opp IN (SELECT opp FROM k))::INT pair_known, 1 bounded, 1 zero_if_unknown FROM pit WHERE season = 2001""")
def pair_svd_checks(spark, sf):
    """Scores of the last season's pairs: which are known, and within what bound."""
    return pair_svd(spark, sf).select(
        "entity", "opp", "pair_known", (F.abs("pair_score") <= F.col("left_norm") * F.col("right_norm") + 1e-12).alias("bounded"),
        ((F.col("pair_known") == 1) | (F.col("pair_score") == 0)).alias("zero_if_unknown"))


@query("principal_component_checks", "M4", "n:i centred:i uncorrelated:i falling:i above_columns:i", "SELECT count(*) n, 1 centred, 1 uncorrelated, 1 falling, 1 above_columns FROM embeddings")
def principal_component_checks(spark, sf):
    """Scores of the leading components: centred, uncorrelated, of falling variance, the first above any column's."""
    rows, names = vectors(spark, sf)
    out, info = embed.principal_components(rows, names, 3)
    pc = info["columns"]
    var = [F.var_pop(c) for c in pc]
    return out.agg(
        F.count("*").alias("n"), (F.greatest(*[F.abs(F.avg(c)) for c in pc]) < 1e-9).alias("centred"),
        (F.greatest(*[F.abs(F.corr(a, b)) for a, b in (("pc00", "pc01"), ("pc00", "pc02"), ("pc01", "pc02"))]) < 1e-6).alias("uncorrelated"),
        ((var[0] >= var[1]) & (var[1] >= var[2])).alias("falling"), (var[0] >= F.greatest(*[F.var_pop(c) for c in names])).alias("above_columns"))


@query("grouped_clusters", "M7 M8", "hand:i n:i clusters_ok:i nearest:i still:i", """
SELECT vec_id % 2 hand, count(*) n, 1 clusters_ok, 1 nearest, 1 still FROM embeddings GROUP BY 1""")
def grouped_clusters(spark, sf):
    """K-means fitted for each group: every row is in its nearest cluster and every centre the mean of its rows."""
    rows, names = vectors(spark, sf)
    work, info = embed.embedding(rows, names, 4)
    pc = info["columns"]
    out, centres = cl.grouped_kmeans(work.withColumn("hand", F.col("vec_id") % 2), ["hand"], pc, 4, 7)
    means = out.groupBy("hand", "cluster").agg(F.array(*[F.avg(c) for c in pc]).alias("mean"))
    own = means.join(centres, "hand").groupBy("hand").agg(
        (F.max(F.expr("array_max(zip_with(mean, element_at(centres, cast(cluster as int) + 1), (a, b) -> abs(a - b)))")) < 1e-6).alias("still"),
        F.count("*").between(1, 4).alias("clusters_ok"))
    far = out.join(centres, "hand").withColumn("least", cl._nearest(pc)["d2"])
    near = far.groupBy("hand").agg(F.count("*").alias("n"), (F.max(F.col("d2") - F.col("least")) <= 1e-9).alias("nearest"))
    return near.join(own, "hand")


@query("soft_cluster_checks", "M7 M8", "n:i sums:i ranges:i sizes:i", "SELECT count(*) n, 1 sums, 1 ranges, 1 sizes FROM embeddings")
def soft_cluster_checks(spark, sf):
    """Soft memberships: they add up, entropy and gap lie in their ranges, sizes are those of the labels."""
    rows, names = vectors(spark, sf)
    work, info = embed.embedding(rows, names, 4)
    out, centres = cl.kmeans(work, info["columns"], 4, 7)
    soft = cl.cluster_sizes(cl.soft_membership(out, info["columns"], centres, "cluster"), "cluster")
    return soft.agg(
        F.count("*").alias("n"), (F.max(F.abs(F.expr("member_0 + member_1 + member_2 + member_3 - 1"))) < 1e-9).alias("sums"),
        F.expr("min(membership_entropy) >= 0 and max(membership_entropy) <= ln(4) + 1e-9 and min(top_gap) >= 0 and max(top_gap) <= 1 and min(distance) >= 0").alias("ranges"),
        (F.abs(F.sum(1.0 / F.col("cluster_size")) - F.count_distinct("cluster")) < 1e-6).alias("sizes"))


@query("mixture_checks", "M7", "n:i sums:i labelled:i", "SELECT count(*) n, 1 sums, 1 labelled FROM embeddings")
def mixture_checks(spark, sf):
    """Converged mixture: posteriors add up and the label is the greatest one."""
    rows, names = vectors(spark, sf)
    work, info = embed.embedding(rows, names, 3)
    out, _ = cl.diagonal_mixture(work, info["columns"], 3, 7)
    own = F.element_at(F.array("member_0", "member_1", "member_2"), F.col("cluster") + 1)
    return out.agg(F.count("*").alias("n"), (F.max(F.abs(F.expr("member_0 + member_1 + member_2 - 1"))) < 1e-9).alias("sums"),
                   (F.max(F.greatest("member_0", "member_1", "member_2") - own) <= 0).alias("labelled"))


@query("soft_clusters", "M7 M8", "vec_id:i cluster:i distance:d4 membership_entropy:d4 top_gap:d4 cluster_size:i")
def soft_clusters(spark, sf):
    """K-means on components with soft membership and stable numbering."""
    rows, names = vectors(spark, sf)
    work, info = embed.embedding(rows, names, 4)
    out, centres = cl.kmeans(work, info["columns"], 4, 7)
    soft = cl.soft_membership(out, info["columns"], centres, "cluster")
    return cl.cluster_sizes(cl.stable_numbers(soft, "cluster", ["pc00", "pc01"], 4), "cluster")


@query("cluster_style_medians", "M7 M11", "entity:i cluster:i style_a:d5 style_b:d4 style_c:d6", f"""
WITH {ENT}, k AS (SELECT *, entity % 4 cluster FROM e), m AS (SELECT cluster, quantile_cont(a, 0.5) style_a, quantile_cont(b, 0.5) style_b, quantile_cont(c, 0.5) style_c FROM k GROUP BY 1)
SELECT entity, cluster, style_a, style_b, style_c FROM k JOIN m USING (cluster)""")
def cluster_style_medians(spark, sf):
    """Median style of the cluster attached to its members."""
    return cl.style_medians(entities(spark, sf).withColumn("cluster", F.col("entity") % 4), "cluster", ["a", "b", "c"])


@query("mixture_clusters", "M7", "vec_id:i cluster:i member_0:d4 member_1:d4 member_2:d4")
def mixture_clusters(spark, sf):
    """Diagonal Gaussian mixture by repeated aggregation."""
    rows, names = vectors(spark, sf)
    work, info = embed.embedding(rows, names, 3)
    return cl.diagonal_mixture(work, info["columns"], 3, 7)[0]


@query("cluster_silhouette", "M9", "n:i silhouette:d5", """
WITH p AS (SELECT vec_id i, embedding::DOUBLE[] v, label c FROM embeddings), s AS (SELECT c, count(*) m FROM p GROUP BY 1),
d AS (SELECT a.i, a.c, b.c oc, sum(list_distance(a.v, b.v)) d FROM p a JOIN p b ON true GROUP BY 1, 2, 3),
k AS (SELECT i, max(CASE WHEN d.c = oc THEN d / nullif(m - 1, 0) END) a, min(CASE WHEN d.c <> oc THEN d / m END) b, max(CASE WHEN d.c = oc THEN m END) m FROM d JOIN s ON s.c = oc GROUP BY 1)
SELECT count(*) n, avg(CASE WHEN m = 1 THEN 0 ELSE (b - a) / greatest(a, b) END) silhouette FROM k""")
def cluster_silhouette(spark, sf):
    """Exact Euclidean silhouette of the given labels."""
    rows, names = vectors(spark, sf)
    return cl.silhouette(rows, "vec_id", names, "label")


@query("davies_bouldin", "M9", "davies_bouldin:d5", """
WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) j FROM embeddings), c AS (SELECT label, j, avg(x) m FROM u GROUP BY 1, 2),
s AS (SELECT label, avg(d) s FROM (SELECT vec_id, u.label, sqrt(sum(pow(x - m, 2))) d FROM u JOIN c USING (label, j) GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT a.label la, b.label lb, sqrt(sum(pow(a.m - b.m, 2))) f FROM c a JOIN c b ON a.j = b.j AND a.label <> b.label GROUP BY 1, 2)
SELECT avg(w) davies_bouldin FROM (SELECT la, max((x.s + z.s) / f) w FROM f JOIN s x ON x.label = la JOIN s z ON z.label = lb GROUP BY 1)""")
def davies_bouldin(spark, sf):
    """Davies-Bouldin index of the given labels."""
    rows, names = vectors(spark, sf)
    return spark.createDataFrame([(cl.davies_bouldin(rows, names, "label"),)], "davies_bouldin double")


@query("label_agreement", "M9", "rows:i ari:d", """
WITH t AS (SELECT hand a, (qty > 25)::INT + ctx % 2 b, count(*) n FROM pit GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) bo, (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) m FROM t GROUP BY a)) sa,
 (SELECT sum(m * (m - 1) / 2.0) FROM (SELECT sum(n) m FROM t GROUP BY b)) sb, (SELECT sum(n) FROM t) r)
SELECT r AS "rows", (bo - sa * sb / (r * (r - 1) / 2.0)) / ((sa + sb) / 2 - sa * sb / (r * (r - 1) / 2.0)) ari FROM s""")
def label_agreement(spark, sf):
    """Adjusted Rand index of two labellings."""
    rows = pit(spark, sf).select(F.col("hand").alias("a"), ((F.col("qty") > 25).cast("int") + F.col("ctx") % 2).alias("b"))
    return cl.adjusted_rand(rows, "a", "b")


@query("safe_types", "M10", "hand:i entities:i small:i share_ok:i numbered:i", f"""
WITH {ENT}, f AS (SELECT (min(n) + max(n)) / 2 f FROM e) SELECT entity % 2 hand, count(*) entities, sum((n < f)::INT) small, 1 share_ok, 1 numbered FROM e, f GROUP BY 1""")
def safe_types(spark, sf):
    """Entity types fitted for each hand on winsorised dimensions and log volume: floor of rows and of shares."""
    e = session.checkpoint(entities(spark, sf).withColumn("hand", F.col("entity") % 2))
    least = e.agg(((F.min("n") + F.max("n")) / 2)).first()[0]
    out = cl.safe_types(e, "n", ["a", "b", "c"], 4, least, 17, keys=["hand"])
    cells = out.groupBy("hand", "type").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    typed = F.col("type") >= 0
    return cells.groupBy("hand").agg(
        F.sum("k").alias("entities"), F.sum(F.when(~typed, F.col("k")).otherwise(0)).alias("small"),
        (F.min(F.when(typed, F.col("s"))) >= 0.05 * F.sum(F.when(typed, F.col("s")))).alias("share_ok"),
        (F.max("type") == F.count_if(typed) - 1).alias("numbered"))


@query("cluster_row_features", "M11 M13 J3", TE_KEYS + " cluster_available:i cluster_id:i h1_c00:i h1_c01:i h2_c00:i cohort_old:i cohort_new:i cluster_log_size:d", f"""
WITH b AS (SELECT *, 1 + entity % 2 hd FROM pit WHERE season >= 2000), l AS (SELECT entity, season + 1 season, entity % 3 cluster, CASE WHEN entity % 4 = 0 THEN 'young' ELSE 'old' END cohort, count(*) cluster_size FROM pit WHERE entity % 5 <> 0 GROUP BY ALL)
SELECT season, day, game, ctx, opp, entity, (cluster IS NOT NULL)::INT cluster_available, hd * 100 + coalesce(cluster, 99) cluster_id, (hd = 1 AND coalesce(cluster, -1) = 0)::INT h1_c00, (hd = 1 AND coalesce(cluster, -1) = 1)::INT h1_c01,
 (hd = 2 AND coalesce(cluster, -1) = 0)::INT h2_c00, (coalesce(cohort, 'new') = 'old')::INT cohort_old, (cohort IS NULL)::INT cohort_new, ln(1 + cluster_size) cluster_log_size FROM b LEFT JOIN l USING (entity, season)""")
def cluster_row_features(spark, sf):
    """Cluster indicators from the previous season's lookup."""
    rows = pit(spark, sf)
    look = rows.filter("entity % 5 <> 0").groupBy("entity", (F.col("season") + 1).alias("season")).agg(F.count("*").alias("cluster_size"))
    look = look.withColumns({"cluster": F.col("entity") % 3, "cohort": F.when(F.col("entity") % 4 == 0, "young").otherwise("old")})
    now = rows.filter("season >= 2000").withColumn("hd", 1 + F.col("entity") % 2)
    return cl.cluster_features(now, look, ["entity", "season"], "hd", {1: 3, 2: 3}, ["old", "new"])


@query("two_view_embedding", "M12", "vec_id:i va00:d4 vb00:d4")
def two_view_embedding(spark, sf):
    """Two column groups reduced separately, standardised and weighted."""
    rows, names = vectors(spark, sf)
    return embed.two_view_embedding(rows, names[:32], names[32:], (2, 2), 0.5)[0]


@query("profile_tokens", "M14 A7", "entity:i token:i inter:d rel:d", """
WITH m AS (SELECT avg(y) m FROM pit), p AS (SELECT entity, ctx - 1 c, sum(y) s, count(*) n FROM pit GROUP BY 1, 2), a AS (SELECT entity, sum(s) s, sum(n) n FROM p GROUP BY 1), b AS (SELECT c, sum(s) s, sum(n) n FROM p GROUP BY 1),
g AS (SELECT entity, c FROM a, range(8) t(c))
SELECT g.entity, g.c token, coalesce((p.s + 100 * m) / (p.n + 100) - (a.s + 100 * m) / (a.n + 100) - (b.s + 100 * m) / (b.n + 100) + m, 0) AS inter, coalesce(p.n / (p.n + 100.0), 0) rel
FROM g LEFT JOIN p USING (entity, c) LEFT JOIN a USING (entity) LEFT JOIN b USING (c), m""")
def profile_tokens(spark, sf):
    """Doubly subtracted cell values per entity as fixed-length arrays, unrolled."""
    rows = pit(spark, sf).withColumn("cell", F.col("ctx") - 1)
    t = cl.profile_tokens(rows, "entity", "cell", 8, {"y": F.col("y")}, 100.0)
    return t.select("entity", F.posexplode("tokens").alias("token", "v")).select(
        "entity", "token", F.get("v", 0).alias("inter"), F.get("v", 1).alias("rel"))


@query("stable_feature_columns", "M15", "column:s usable:i", """
WITH b AS (SELECT season, tax0, CASE WHEN qty > 20 OR season = 1996 THEN qty END q0, CASE WHEN season = 1997 THEN 1.0 ELSE disc END d0, price FROM pit)
SELECT c AS "column", min((k >= 0.7 AND coalesce(v, false))::INT) usable FROM (""" + " UNION ALL ".join(
    f"SELECT season, '{c}' c, avg(({c} IS NOT NULL)::INT) k, min({c}) < max({c}) v FROM b GROUP BY 1" for c in ("tax0", "q0", "d0", "price")) + ") GROUP BY 1")
def stable_feature_columns(spark, sf):
    """Columns known and varying in every version of the table."""
    rows = pit(spark, sf).select("season", "tax0", "price", F.when((F.col("qty") > 20) | (F.col("season") == 1996), F.col("qty")).alias("q0"),
                                 F.when(F.col("season") == 1997, 1.0).otherwise(F.col("disc")).alias("d0"))
    return prepare.stable_columns(rows, ["season"], ["tax0", "q0", "d0", "price"])


@query("representative_rows", "M16 W29", "entity:i season:i day:s game:i ctx:i opp:i qty:d", f"""
SELECT entity, season, day, game, ctx, opp, qty FROM (SELECT *, row_number() OVER (PARTITION BY entity, season ORDER BY day DESC, game DESC, ctx DESC, opp DESC) r FROM pit) WHERE r = 1""")
def representative_rows(spark, sf):
    """Last row of every entity season."""
    return prepare.last_row(pit(spark, sf), ["entity", "season"], ["day", "game", "ctx", "opp"])


@query("forward_folds", "E1", "fold:i part:s n:i rate:d", """
SELECT f AS fold, CASE WHEN season < f THEN 'train' ELSE 'valid' END AS part, count(*) n, avg(y) rate FROM pit, (VALUES (1999), (2000), (2001)) v(f) WHERE season <= f GROUP BY 1, 2""")
def forward_folds(spark, sf):
    """Train and valid parts of forward folds."""
    return model.forward_folds(pit(spark, sf), "season", [1999, 2000, 2001]).groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.avg("y").alias("rate"))


@query("grouped_folds", "E2", "game:i fold:i", """
WITH r AS (SELECT game, row_number() OVER (ORDER BY count(*) DESC, game) - 1 r FROM pit GROUP BY 1)
SELECT game, CASE WHEN r % 10 < 5 THEN r % 10 ELSE 9 - r % 10 END fold FROM r""")
def grouped_folds(spark, sf):
    """Whole groups dealt to five balanced folds."""
    return model.grouped_folds(pit(spark, sf), "game", 5)


FEATURES = ["qty", "disc", "cents", "ctx"]


# A forecast of a label that its features do not tell can be worse than the rate it aims at by chance alone.
NO_WORSE = "brier <= base * (1 - base) + 0.003 + 0.3 / sqrt(n) as no_worse"


@query("forward_model_scores", "E34", "fold:i n:i base:d no_worse:i stopped:i", """
SELECT season fold, count(*) n, avg(y) base, 1 no_worse, 1 stopped FROM pit
WHERE season IN (SELECT DISTINCT season FROM pit ORDER BY 1 OFFSET 2) GROUP BY 1""")
def forward_model_scores(spark, sf):
    """Boosted forecasts of every season with two before it: the last of these stops the training."""
    rows = pit(spark, sf)
    seasons = sorted(r["season"] for r in rows.select("season").distinct().collect())
    oof = model.forward_oof(rows, "season", seasons[2:], FEATURES, "y", "gbt", rounds=64, patience=4, depth=3)
    kept = oof.groupBy("fold").agg(F.max("rounds").alias("rounds"))
    return metrics.probability_scores(oof, ["fold"], "y", "forecast").join(F.broadcast(kept), "fold").selectExpr(
        "fold", "n", "base", NO_WORSE, "rounds between 1 and 64 as stopped")


@query("stacked_class_scores", "E35 E2", "fold:i rows:i sums_to_one:i entropy_in_range:i no_worse:i", """
WITH r AS (SELECT game, row_number() OVER (ORDER BY count(*) DESC, game) - 1 r FROM pit GROUP BY 1),
f AS (SELECT game, CASE WHEN r % 6 < 3 THEN r % 6 ELSE 5 - r % 6 END fold FROM r)
SELECT fold, count(*) AS rows, 1 sums_to_one, 1 entropy_in_range, 1 no_worse FROM pit JOIN f USING (game) GROUP BY 1""")
def stacked_class_scores(spark, sf):
    """Out-of-fold class probabilities: sums, entropy, and a log loss no worse than that of the class shares."""
    rows = pit(spark, sf).withColumn("cls", F.when(F.col("lab") == "A", 0).when(F.col("lab") == "N", 1).otherwise(2))
    out = model.stacked_classes(rows, "game", 3, FEATURES, "cls", 3)
    said = F.element_at(F.array(*[f"aux_{i}" for i in range(3)]), F.col("cls") + 1)
    shares = [F.avg((F.col("cls") == i).cast("int")) for i in range(3)]
    plain = sum((F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in shares), F.lit(0.0))
    return out.groupBy("fold").agg(
        F.count("*").alias("rows"), (F.max(F.abs(F.expr("aux_0 + aux_1 + aux_2 - 1"))) < 1e-9).alias("sums_to_one"),
        F.expr("min(aux_entropy) >= 0 and max(aux_entropy) <= ln(3) + 1e-9 and min(aux_max) >= 1 / 3 - 1e-9").alias("entropy_in_range"),
        (F.avg(-F.log(F.greatest(said, F.lit(1e-12)))) <= plain + 0.02).alias("no_worse"))


@query("staged_ablation", "E36", "stage:i name:s features:i n:i base:d no_worse:i", """
SELECT stage, name, features, count(*) n, avg(y) base, 1 no_worse FROM pit,
  (VALUES (1, 'context', 1), (2, 'metrics', 3), (3, 'history', 4)) v(stage, name, features) WHERE season = 2001 GROUP BY 1, 2, 3""")
def staged_ablation(spark, sf):
    """Scores after each added feature group."""
    rows = pit(spark, sf)
    out = model.staged_ablation(rows.filter(PAST), rows.filter(LATEST),
                                {"context": ["ctx"], "metrics": ["qty", "disc"], "history": ["cents"]}, "y")
    return out.selectExpr("stage", "name", "features", "n", "base", NO_WORSE)


@query("entity_or_global", "E37", "source:s n:i base:d brier:d logloss:d", """
WITH tr AS (SELECT * FROM pit WHERE season < 2001), m AS (SELECT avg(y) m FROM tr), o AS (SELECT opp, (sum(y) + 20 * any_value(m)) / (count(*) + 20) v FROM tr, m GROUP BY 1 HAVING count(*) >= 5),
f AS (SELECT y, coalesce(v, m) p, CASE WHEN v IS NULL THEN 'global' ELSE 'own' END AS source FROM pit LEFT JOIN o USING (opp), m WHERE season = 2001)
SELECT source, count(*) n, avg(y) base, avg(pow(p - y, 2)) brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) logloss FROM f GROUP BY 1""")
def entity_or_global(spark, sf):
    """Own estimates for entities with volume, global for others, scored by source."""
    rows = pit(spark, sf)
    out = model.entity_or_global(rows.filter(PAST), rows.filter(LATEST), "opp", "y", 20.0, 5)
    return metrics.probability_scores(out, ["source"], "y", "forecast")


@query("batch_scoring", "E38 A2 J1", TE_KEYS + " forecast:d", """
WITH f AS (SELECT * FROM pit WHERE season < 2001), m AS (SELECT avg(y) m FROM f), a AS (SELECT entity, hand, sum(y) s, count(*) n FROM f GROUP BY 1, 2), u AS (SELECT entity, sum(s) s, sum(n) n FROM a GROUP BY 1),
t AS (SELECT a.entity, a.hand, ((a.s + 300 * m) / (a.n + 300) - (u.s + 300 * m) / (u.n + 300)) * a.n / (a.n + 300.0) w FROM a JOIN u USING (entity), m)
SELECT season, day, game, ctx, opp, pit.entity, least(greatest(0.7 * p + 0.3 * p2 + coalesce(w, 0), 1e-6), 1 - 1e-6) forecast FROM pit LEFT JOIN t USING (entity, hand) WHERE season = 2001""")
def batch_scoring(spark, sf):
    """Frozen lookups and member forecasts combined for every row, no window over scored rows."""
    from foretally.functions.rates import clip
    from foretally.operators.joins import lookup_join
    rows = pit(spark, sf)
    table_ = eb.nested_split(rows.filter(PAST), ["entity"], ["entity", "hand"], "y", 300.0)
    out = lookup_join(rows.filter(LATEST), table_, ["entity", "hand"], {"split": 0.0, "rel": 0.0})
    return out.withColumn("forecast", clip(0.7 * F.col("p") + 0.3 * F.col("p2") + F.col("split") * F.col("rel"), 1e-6, 1 - 1e-6))


@query("segmented_experts", "E39", "hand:s n:i base:d no_worse:i", "SELECT hand, count(*) n, avg(y) base, 1 no_worse FROM pit WHERE season = 2001 GROUP BY 1")
def segmented_experts(spark, sf):
    """One model per segment, recombined and scored by segment."""
    rows = pit(spark, sf)
    out = model.segmented_experts(rows.filter(PAST), rows.filter(LATEST), "hand", ["F", "O"], FEATURES, "y")
    return metrics.probability_scores(out, ["hand"], "y", "forecast").selectExpr("hand", "n", "base", NO_WORSE)


@query("top_volume_subset", "S4 O2", "entity:i n:i", """
WITH t AS (SELECT entity FROM pit WHERE season < 2001 GROUP BY 1 ORDER BY count(*) DESC, entity LIMIT 10) SELECT entity, count(*) n FROM pit WHERE entity IN (FROM t) GROUP BY 1""")
def top_volume_subset(spark, sf):
    """Rows of the ten entities with most fit-period rows."""
    return files.load_subset(pit(spark, sf), "entity", "season < 2001", 10).groupBy("entity").agg(F.count("*").alias("n"))


@query("month_ranges", "S5", "range_start:s range_end:s", """
WITH b AS (SELECT min(day) a, max(day) z FROM pit), m AS (SELECT unnest(generate_series(date_trunc('month', a)::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 MONTH))::DATE m, a, z FROM b)
SELECT greatest(m, a) range_start, least(last_day(m), z) range_end FROM m""")
def month_ranges(spark, sf):
    """Calendar months between the first and last day."""
    return files.month_ranges(pit(spark, sf).agg(F.min("day").alias("a"), F.max("day").alias("z")), "a", "z")


@query("chunk_manifest", "S6", "season:i n:i start:s end:s columns:i chunk_order:i",
       'SELECT min(season) season, count(*) n, min(day) AS "start", max(day) AS "end", 3 AS columns, 1 chunk_order FROM pit')
def chunk_manifest(spark, sf):
    """Rows and span of every source file."""
    return files.manifest(pit(spark, sf).select("season", "day", "entity"), "season", "day")


@query("chunk_sequence", "S7", TE_KEYS + " sequence_in_chunk:i", f"""
SELECT {KEY_SQL}, row_number() OVER (PARTITION BY season, month ORDER BY {PIT_SQL_ORDER}) - 1 sequence_in_chunk FROM pit""")
def chunk_sequence(spark, sf):
    """Position of each row inside its monthly chunk."""
    return files.stamped(pit(spark, sf), ["season", "month"], PIT_ORDER)


@query("melted_metrics", "S11", "season:i metric:s mean:d4", " UNION ALL ".join(
    f"SELECT season, '{c}' metric, avg({c}) mean FROM pit GROUP BY 1" for c in ("qty", "price", "cents")))
def melted_metrics(spark, sf):
    """Wide metrics turned long and averaged per season."""
    return files.unpivoted(pit(spark, sf), ["season"], ["qty", "price", "cents"]).groupBy("season", "metric").agg(F.avg("value").alias("mean"))


@query("capped_sample", "S12", TE_KEYS + " qty:d", f"""
WITH h AS (SELECT *, md5('7|' || concat_ws('|', game, ctx, opp, entity, day)) h FROM pit), r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY h, game, ctx, opp, entity, day) r FROM h)
SELECT {KEY_SQL}, qty FROM r WHERE r <= 500""")
def capped_sample(spark, sf):
    """Deterministic sample with a cap per season."""
    return files.capped_sample(pit(spark, sf), ["season"], ["game", "ctx", "opp", "entity", "day"], 500, 7)


@query("deduplicated_keys", "P2 U-dist", "game:i ctx:i season:i day:s opp:i entity:i qty:d", """
SELECT game, ctx, season, day, opp, entity, qty FROM (SELECT *, row_number() OVER (PARTITION BY game, ctx ORDER BY day DESC, opp DESC, entity DESC) r FROM pit) WHERE r = 1""")
def deduplicated_keys(spark, sf):
    """Last row per event key by an explicit order."""
    return files.deduplicated(pit(spark, sf), ["game", "ctx"], ["day", "opp", "entity"], "last")


@query("tolerant_union", "U-all", "k:i a:i b:i n:i", """
SELECT k, a, b, count(*) n FROM (SELECT season AS k, ctx a, NULL b FROM pit UNION ALL SELECT year(o_orderdate), NULL, length(o_orderstatus) FROM orders) GROUP BY 1, 2, 3""")
def tolerant_union(spark, sf):
    """Frames with different columns stacked by name."""
    a = pit(spark, sf).select(F.col("season").alias("k"), F.col("ctx").alias("a"))
    b = table(spark, sf, "orders").select(F.year("o_orderdate").alias("k"), F.length("o_orderstatus").alias("b"))
    return files.concat([a, b]).groupBy("k", "a", "b").agg(F.count("*").alias("n"))


@query("regular_filter", "P1", "season:i n:i", "SELECT year(l_shipdate) season, count(*) n FROM lineitem WHERE l_linestatus = 'O' AND nullif(l_returnflag, 'N') IS NOT NULL GROUP BY 1")
def regular_filter(spark, sf):
    """Rows of the regular kind with a known result."""
    rows = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"), F.when(F.col("l_linestatus") == "O", "R").alias("game_type"),
                                               F.nullif("l_returnflag", F.lit("N")).alias("type"))
    return files.regular_season(rows).groupBy("season").agg(F.count("*").alias("n"))


@query("multi_key_ranking", "O1", "entity:i n:i rate:d position:i", """
SELECT entity, count(*) n, avg(y) rate, row_number() OVER (ORDER BY count(*) DESC, avg(y), entity) AS position FROM pit GROUP BY 1""")
def multi_key_ranking(spark, sf):
    """Position under a sort with mixed directions and a full tiebreak."""
    from foretally.operators.ordered import History
    from foretally.roles import Order
    e = pit(spark, sf).groupBy("entity").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    h = History(e.withColumn("d", -F.col("n")), [], Order(("d", "rate", "entity"))).position("r")
    return h.df.withColumn("position", F.col("r") + 1)


@query("registered_transforms", "X1 X2", TE_KEYS + " opp_logn:d opp_unseen:i month_sin:d month_cos:d p_logit:d qty_sqrt:d", f"""
WITH n AS (SELECT opp, count(*) n FROM pit WHERE season = 1995 GROUP BY 1)
SELECT season, day, game, ctx, pit.opp, entity, ln(1 + coalesce(n, 0)) opp_logn, (n IS NULL)::INT opp_unseen, sin(month * 2 * pi() / 12) month_sin, cos(month * 2 * pi() / 12) month_cos, ln(p / (1 - p)) p_logit, sqrt(qty) qty_sqrt
FROM pit LEFT JOIN n ON n.opp = pit.opp""")
def registered_transforms(spark, sf):
    """Transforms applied in order through the registry."""
    r = reg.Registry()
    for t in (reg.id_frequency("opp"), reg.cyclic("month", 12), reg.shaped("p", "logit"), reg.shaped("qty", "sqrt")):
        r.add(t)
    return r.apply(pit(spark, sf), ["id_frequency:opp", "cyclic:month", "logit:p", "sqrt:qty"], [], F.col("season") == 1995)[0]


def hand_spec() -> reg.FeatureSpec:
    return reg.FeatureSpec("hand_split", ("split", "rel"), keys=("entity", "hand"), make_table=lambda fit: eb.nested_split(
        fit, ["entity"], ["entity", "hand"], "y", 300.0))


@query("keyed_feature_spec", "X3", TE_KEYS + " split:d rel:d", """
WITH f AS (SELECT * FROM pit WHERE season < 2001), m AS (SELECT avg(y) m FROM f), a AS (SELECT entity, hand, sum(y) s, count(*) n FROM f GROUP BY 1, 2), u AS (SELECT entity, sum(s) s, sum(n) n FROM a GROUP BY 1)
SELECT season, day, game, ctx, opp, pit.entity, (a.s + 300 * m) / (a.n + 300) - (u.s + 300 * m) / (u.n + 300) split, a.n / (a.n + 300.0) rel FROM pit LEFT JOIN a USING (entity, hand) LEFT JOIN u USING (entity), m""")
def keyed_feature_spec(spark, sf):
    """A keyed table made from fit rows and joined to all rows."""
    return hand_spec().attach(pit(spark, sf), F.col("season") < LAST_SEASON)


@query("intake_gates", "X4", "gate:s value:d passed:i", """
WITH c AS (SELECT entity, hand, count(*) n FROM pit WHERE season < 2001 GROUP BY 1, 2), v AS (SELECT quantile_cont(w, 0.5) m FROM (SELECT 1 / (n + 300.0) w FROM c, range(n)))
SELECT 'columns_equal' gate, 1.0 AS value, 1 passed UNION ALL SELECT 'changes_with_fold', 1.0, 1 UNION ALL SELECT 'own_contribution', m, (m < 0.01)::INT FROM v
UNION ALL SELECT 'coverage:split', 0.0, 1 UNION ALL SELECT 'coverage:rel', 0.0, 1""")
def intake_gates(spark, sf):
    """Gates a keyed feature passes before modelling."""
    return reg.intake_gates(hand_spec(), pit(spark, sf), "season", [2000, 2001], 300.0)


@query("block_contract", "X5 J15", "check:s violations:i", """
SELECT c AS "check", v AS violations FROM (VALUES ('wrong_columns', 0), ('non_numeric', 0), ('infinite', 0), ('null_ids', 0), ('repeated_ids', 0), ('extra_ids', 0)) t(c, v)
UNION ALL SELECT 'missing_ids', count(DISTINCT opp) FROM pit WHERE opp % 10 = 0""")
def block_contract(spark, sf):
    """Contract violations of a feature block that lacks some ids."""
    rows = pit(spark, sf)
    block = rows.filter("opp % 10 <> 0").groupBy("opp").agg(F.avg("qty").alias("f1"), F.count("*").alias("f2"))
    return reg.check_block(block, rows.select("opp").distinct(), ["opp"], ["f1", "f2"])


@query("assembled_blocks", "J15 J2", "opp:i f1:d f2:i f3:d", "SELECT opp, avg(qty) f1, count(*) f2, sum(disc) f3 FROM pit GROUP BY 1")
def assembled_blocks(spark, sf):
    """Feature blocks joined by a proved-unique id."""
    from foretally.operators.joins import assemble_blocks
    rows = pit(spark, sf)
    g = rows.groupBy("opp")
    return assemble_blocks(rows.select("opp").distinct(), [g.agg(F.avg("qty").alias("f1")), g.agg(F.count("*").alias("f2")), g.agg(F.sum("disc").alias("f3"))], "opp")


@query("row_independence", "X6 E38", "check:s violations:i", "SELECT * FROM (VALUES ('reordered', 0), ('part_of_rows', 0)) t(\"check\", violations), (SELECT min(1) FROM lineitem)")
def row_independence(spark, sf):
    """Features of a row do not depend on other rows."""
    from foretally.functions import rowfeatures as rf
    from foretally.plans.row_queries import COMPACT, train
    rows = train(spark, sf)
    return reg.row_independent(lambda d: rf.derived(d, COMPACT).select("k1", "k2", "k3", "k4", "blend", "risk"), rows, ["k1", "k2"], F.col("k1") % 2 == 0)


@query("method_audit", "X7", "check:s violations:i", "SELECT * FROM (VALUES ('fold_overlap', 0), ('rows_equal_across_folds', 0), ('inclusion_exclusion', 0)) t(\"check\", violations), (SELECT min(1) FROM lineitem)")
def method_audit(spark, sf):
    """Fold separation, fold-dependent tables and inclusion-exclusion."""
    rows = pit(spark, sf).withColumns({"m": (F.col("lab") == "A").cast("int"), "r": (F.col("qty") > 30).cast("int")})
    return reg.method_audit(rows, "season", LAST_SEASON, "y", "m", "r",
                            lambda d: eb.nested_split(d, ["entity"], ["entity", "hand"], "y", 300.0))


@query("group_statistics", "J16", TE_KEYS + " group_n:i group_mean:d", "SELECT season, day, game, ctx, opp, entity, count(*) OVER (PARTITION BY hand, ctx) group_n, avg(y) OVER (PARTITION BY hand, ctx) group_mean FROM pit")
def group_statistics(spark, sf):
    """Group aggregates attached to every row."""
    return eb.group_stats(pit(spark, sf), ["hand", "ctx"], {"group_n": F.count(F.lit(1)), "group_mean": F.avg("y")})


@query("state_classes", "W25", "class4:i class5:i n:i", """
WITH b AS (SELECT y, (qty > 30)::INT m, (disc > 0.05)::INT r FROM pit)
SELECT CASE WHEN y = 1 THEN 0 WHEN m = 1 THEN 1 WHEN r = 1 THEN 2 ELSE 3 END class4, CASE WHEN y = 1 THEN 0 WHEN m = 1 AND r = 1 THEN 4 WHEN m = 1 THEN 1 WHEN r = 1 THEN 2 ELSE 3 END class5, count(*) n FROM b GROUP BY 1, 2""")
def state_classes(spark, sf):
    """Failure classes under two priority orders."""
    from foretally.functions.labels import failure_classes
    rows = pit(spark, sf).withColumns({"m": (F.col("qty") > 30).cast("int"), "r": (F.col("disc") > 0.05).cast("int")})
    out = rows.withColumns(failure_classes(F.col("y"), F.col("m"), F.col("r")))
    return out.groupBy("class4", "class5").agg(F.count("*").alias("n"))


@query("narrowed_cache", "S2", "season:i n:i qty_sum:d2 kinds:s", """
SELECT season, count(*) n, sum(qty) qty_sum, 'int/float' kinds FROM pit GROUP BY 1""")
def narrowed_cache(spark, sf):
    """A narrowed Parquet cache written once and read back."""
    rows = pit(spark, sf).select(F.col("season").cast("long").alias("season"), "qty")
    cached = files.build_cache(rows, session.scratch(spark), {"season": "int", "qty": "float"})
    kinds = "/".join(t for _, t in cached.dtypes)
    return cached.groupBy("season").agg(F.count("*").alias("n"), F.sum("qty").alias("qty_sum")).withColumn("kinds", F.lit(kinds))


@query("saved_dataset", "S8 P29", "split:s n:i first_season:i last_season:i", """
SELECT CASE WHEN season < 2000 THEN 'train' WHEN season = 2000 THEN 'test' ELSE 'unused' END AS split, count(*) n, min(season) first_season, max(season) last_season FROM pit GROUP BY 1""")
def saved_dataset(spark, sf):
    """A dataset written by split with its schema beside it, read back."""
    from foretally.functions.buckets import split_label
    rows = pit(spark, sf).select("season", "entity", "qty").withColumn("split", split_label(F.col("season"), range(1995, 2000), [2000]))
    path = session.scratch(spark)
    files.save_dataset(rows, path)
    return spark.read.parquet(f"{path}/data").groupBy("split").agg(
        F.count("*").alias("n"), F.min("season").alias("first_season"), F.max("season").alias("last_season"))


@query("saved_versions", "S9", "cutoff:i n:i last_season:i total:i", """
SELECT cutoff, count(DISTINCT entity) n, max(season) last_season, count(*) total FROM pit, (VALUES (1999), (2001)) v(cutoff) WHERE season < cutoff AND (cutoff <> 1999 OR entity % 2 = 0) GROUP BY 1""")
def saved_versions(spark, sf):
    """Cutoff-versioned profiles; rewriting one cutoff leaves the others."""
    from foretally.operators.joins import spread_to_cutoffs
    cells = pit(spark, sf).groupBy("entity", "season").agg(F.count("*").alias("n"))
    prof = spread_to_cutoffs(cells, "season", [1999, 2001]).groupBy("entity", "cutoff").agg(
        F.sum("n").alias("n"), F.max("season").alias("last_season"))
    path = session.scratch(spark)
    files.save_version(prof, path)
    files.save_version(prof.filter("cutoff = 1999 AND entity % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("cutoff").agg(
        F.count("*").alias("n"), F.max("last_season").alias("last_season"), F.sum("n").alias("total"))


@query("written_submission", "S13", "rows:i p_sum:d4 header:s breaks:i unmatched:i", """
SELECT count(*) AS "rows", sum(p) p_sum, 'row_id,p' header, 0 breaks, 0 unmatched FROM pit WHERE season = 2001""")
def written_submission(spark, sf):
    """Two-column forecasts written in row order; the order read back is held against the log's."""
    from pyspark.sql import types as T
    rows = pit(spark, sf).filter(LATEST).withColumns({
        "row_id": F.concat_ws("-", "game", "ctx", "opp", "entity"), "seq": F.struct("game", "day", "ctx", "opp", "entity")})
    path = session.scratch(spark)
    files.write_submission(rows, path, "row_id", "p", "seq")
    schema = T.StructType([T.StructField("row_id", T.StringType()), T.StructField("p", T.DoubleType())])
    back = files.read_placed(spark, path, schema)
    # Each line's place in the log's order, found by its id.
    known = back.join(rows.select("row_id", "seq"), "row_id", "left")
    told = back.agg(F.count("*").alias("rows"), F.sum("p").alias("p_sum"))
    lost = known.agg(F.count_if(F.col("seq").isNull()).alias("unmatched"))
    head = spark.read.csv(path, header=True).columns
    return told.withColumn("header", F.lit(",".join(head))).crossJoin(files.order_breaks(known, "seq")).crossJoin(lost)


@query("typed_csv_scan", "S1", "season:i n:i missing:i qty_sum:d2", """
SELECT season, count(*) n, count(*) - count(tax0) AS missing, sum(qty) qty_sum FROM pit GROUP BY 1""")
def typed_csv_scan(spark, sf):
    """A CSV with a header read by declared types with column projection."""
    from pyspark.sql import types as T
    path = session.scratch(spark)
    pit(spark, sf).select("entity", "season", "qty", "tax0").write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("season", T.IntegerType()), T.StructField("qty", T.DoubleType()),
                           T.StructField("tax0", T.DoubleType()), T.StructField("entity", T.LongType())])
    rows = files.read_csv(spark, path, schema, ["season", "qty", "tax0"])
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("tax0").isNull()).alias("missing"),
                                      F.sum("qty").alias("qty_sum"))


@query("chunk_union", "S3", "season:i n:i with_tax:i with_label:i", """
SELECT season, count(*) n, sum(CASE WHEN season >= 1998 THEN 1 ELSE 0 END) with_tax, 0 with_label FROM pit GROUP BY 1""")
def chunk_union(spark, sf):
    """Chunks with different columns read as one table with typed NULLs."""
    from pyspark.sql import types as T
    base, rows = session.scratch(spark), pit(spark, sf)
    rows.filter("season < 1998").select("season", "qty").write.parquet(f"{base}/early")
    rows.filter("season >= 1998").select("season", "qty", "tax").write.parquet(f"{base}/late")
    schema = T.StructType([T.StructField("season", T.IntegerType()), T.StructField("tax", T.DoubleType()),
                           T.StructField("label", T.StringType())])
    out = files.read_chunks(spark, [f"{base}/early", f"{base}/late"], schema)
    return out.groupBy("season").agg(F.count("*").alias("n"), F.count("tax").alias("with_tax"), F.count("label").alias("with_label"))
