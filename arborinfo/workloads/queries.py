"""Registered queries: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborinfo.functions import circular, entropy, vec3
from arborinfo.functions.entropy import PRIORS
from arborinfo.functions.nsb import nsb_entropy
from arborinfo.functions.special import bessel_ratio, digamma, lgamma, log_i0, trigamma
from arborinfo.lineage import materialize, scratch_path
from arborinfo.operators import (
    cluster, dwell, em, geometry, information, logits, mixture, pairs, spanning, topology,
)
from arborinfo.plans.fit import fit_angles, fit_logits
from arborinfo.plans.tree import InformationTree
from arborinfo.sinks.drawing import drawn_edges, drawn_nodes
from arborinfo.sinks.results import save_tree
from arborinfo.sources.columns import encode_states, state_dictionary
from arborinfo.sources.results import load_tree
from arborinfo.streaming.pair_counts import streaming_pair_counts
from arborinfo.workloads import stand_ins as given
from arborinfo.workloads.stand_ins import VARIABLES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Variables whose joint law is read off along a path, and those a subtree is spanned by.
PATH_ENDS = ("l_linestatus", "o_orderstatus")
SUBSET = ["l_linestatus", "l_tax", "o_orderstatus"]
SWEEP = [round(0.01 * i, 2) for i in range(1, 100)]
SEED = 7


def query(func: Query) -> Query:
    QUERIES[func.__name__] = func
    return func


def r(column, digits: int = 10, name: str | None = None):
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, digits).alias(name or column)


# -- entropies ---------------------------------------------------------------------------------


@query
def node_entropy_plugin(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return t.nodes.select("var", "n_obs", "k", r("s"))


def _node_posterior(prior):
    def run(spark, sf_dir):
        t = given.item_tree(spark, sf_dir, prior=prior)
        return t.nodes.select("var", r("s_pm", 9), r("s_se", 6))

    return run


def _pair_posterior(prior):
    def run(spark, sf_dir):
        t = given.item_tree(spark, sf_dir, prior=prior)
        out = information.posterior_information(t.pair_counts, t.nodes, prior)
        return out.select("u", "v", r("s_uv_pm", 9), r("s_uv_se", 6), r("i_pm", 9), r("i_se", 6))

    return run


for _prior in PRIORS:
    QUERIES[f"node_entropy_posterior_{_prior}"] = _node_posterior(_prior)
    QUERIES[f"pair_information_posterior_{_prior}"] = _pair_posterior(_prior)


@query
def entropy_mean_square(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    square = entropy.posterior_mean_square(F.col("s_pm"), F.col("s_se"))
    return t.nodes.select("var", r(square, 8, "s_sq"))


@query
def special_functions(spark, sf_dir):
    """digamma, trigamma and ln Gamma of the count of each joint state, the Bessel terms of it
    scaled into the range of concentrations."""
    counts = given.wide_rows(spark, sf_dir).groupBy("l_discount", "l_tax").agg(
        F.count(F.lit(1)).cast("double").alias("n")
    ).withColumn("kappa", 10.0 + F.col("n") % 30)
    return counts.select(
        "l_discount", "l_tax", r(F.expr(digamma("n")), 9, "psi"),
        r(F.expr(trigamma("n")), 9, "psi1"), r(F.expr(lgamma("n")), 6, "lg"),
        r(F.expr(log_i0("kappa")), 8, "li0"), r(F.expr(bessel_ratio("kappa")), 8, "ratio"),
    )


@query
def node_entropy_nsb(spark, sf_dir):
    """Entropies under the mixture of priors; l_discount may have 20 values, not all of them seen."""
    counts = given.item_tree(spark, sf_dir).node_counts
    listed = counts.groupBy("var").agg(F.count(F.lit(1)).alias("k"))
    counts = counts.join(listed, "var").withColumn("k", F.when(F.col("var") == "l_discount", 20).otherwise(F.col("k")))
    return nsb_entropy(counts, ["var"], "k").select("var", r("s_nsb", 8), r("s_nsb_se", 8))


@query
def pair_information_fixed_beta(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return entropy.fixed_beta_information(t.pair_counts, 2.5).select("u", "v", r("i_beta", 9))


@query
def pair_log_likelihood_fixed_beta(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    out = entropy.fixed_beta_log_likelihood(t.pair_counts, 2.5)
    return out.select("u", "v", r("log_likelihood", 4))


@query
def dwell_gaps(spark, sf_dir):
    gaps = dwell.mean_gaps(given.sequences(spark, sf_dir), ["user_id"], "ts")
    return gaps.select("user_id", "state", r("gap", 8))


@query
def block_jackknife(spark, sf_dir):
    out = dwell.block_jackknife(given.sequences(spark, sf_dir), ["user_id"], "ts")
    return out.select("user_id", r("s_se", 6))


# -- pairs -------------------------------------------------------------------------------------


@query
def pair_counts(spark, sf_dir):
    return pairs.pair_counts(given.wide_rows(spark, sf_dir), VARIABLES)


@query
def pair_counts_many(spark, sf_dir):
    """More columns than joint rows are counted for, with nulls, negative and large numbers."""
    return pairs.pair_counts(given.many_columns(spark, sf_dir), given.MANY)


@query
def pair_probabilities(spark, sf_dir):
    out = pairs.pair_probabilities(given.item_tree(spark, sf_dir).pair_counts)
    return out.select("u", "v", "xu", "xv", r("p"))


@query
def pair_information(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return t.edges.select("u", "v", "n_obs", r("s_u"), r("s_v"), r("s_uv"), r("i"))


@query
def pair_information_long_states(spark, sf_dir):
    t = InformationTree.from_states(
        given.order_states(spark, sf_dir), ["nation", "priority", "segment", "status"]
    )
    return t.edges.select("u", "v", "n_obs", r("i"))


@query
def pair_counts_encoded(spark, sf_dir):
    """Columns replaced by state numbers from most to least frequent, counted as matrices."""
    rows = given.table(spark, sf_dir, "events").select(
        "event_type", F.hour("ts").alias("hour"), F.dayofweek("ts").alias("day")
    )
    names = ["day", "event_type", "hour"]
    coded = encode_states(rows, names, materialize(state_dictionary(rows, names), "dictionary"))
    return pairs.pairs_of_arrays(coded, F.array(*names), names)


@query
def streamed_pair_counts(spark, sf_dir):
    """The pair counts of a stream over line items, taken from its last state."""
    source = spark.readStream.schema(given.table(spark, sf_dir, "lineitem").schema).option(
        "pathGlobFilter", "lineitem.parquet"
    ).parquet(sf_dir)
    names = ["l_linestatus", "l_returnflag", "l_discount", "l_linenumber"]
    folder = scratch_path(spark, "stream")
    schema = "u string, v string, xu string, xv string, n long, batch long"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/b={number}")

    stream = (
        streaming_pair_counts(source, names).writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        .foreachBatch(keep).start()
    )
    stream.awaitTermination()
    out = spark.read.schema(schema).parquet(f"{folder}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).select("u", "v", "xu", "xv", "n")


# -- tree --------------------------------------------------------------------------------------


@query
def tree_edges(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return t.edges.join(t.tree, ["u", "v"]).select("u", "v", r("i"))


@query
def tree_edges_by_components(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    tree = spanning.maximum_spanning_tree(t.edges, "i", driver_edges=0)
    return t.edges.join(tree, ["u", "v"]).select("u", "v", r("i"))


@query
def tree_edge_posterior(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return t.tree_edges.select("u", "v", r("i"), r("i_pm", 9), r("i_se", 6))


@query
def tree_summary(spark, sf_dir):
    return given.item_tree(spark, sf_dir).summary().select(
        r("sum_entropy", 8), r("sum_mi", 8), r("entropy", 8)
    )


@query
def tree_summary_plugin(spark, sf_dir):
    return given.item_tree(spark, sf_dir, estimator="mle").summary().select(
        r("sum_entropy"), r("sum_mi"), r("entropy")
    )


@query
def tree_entropy_interval(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).entropy_interval(0.95)
    return out.select(r("entropy", 8), r("entropy_se", 6), r("lo", 6), r("hi", 6))


@query
def node_entropies(spark, sf_dir):
    return given.item_tree(spark, sf_dir).node_entropies().select("var", r("entropy", 9))


@query
def node_information(spark, sf_dir):
    return given.item_tree(spark, sf_dir).node_information().select("var", r("sum_mi", 9))


@query
def node_contributions(spark, sf_dir):
    return given.item_tree(spark, sf_dir).node_contributions().select("var", r("contribution", 9))


@query
def edge_information(spark, sf_dir):
    return given.item_tree(spark, sf_dir).edge_information().select("u", "v", r("mi", 9))


def _matrix(kind):
    def run(spark, sf_dir):
        out = given.item_tree(spark, sf_dir, estimator="mle").information_matrix(kind, diag=True)
        return out.select("u", "v", r("value"))

    return run


for _kind in ("empirical", "chow_liu", "hybrid"):
    QUERIES[f"information_matrix_{_kind}"] = _matrix(_kind)


@query
def information_matrix_pivot(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).information_pivot(kind="empirical")
    return out.select("u", *[r(v) for v in VARIABLES])


@query
def tree_trim(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    return t.trim(SUBSET).select("u", "v", r("i"))


@query
def tree_neighbours(spark, sf_dir):
    return given.item_tree(spark, sf_dir).neighbours("l_linenumber").select("v", r("i"), r("i_pm", 9))


@query
def tree_paths(spark, sf_dir):
    return given.item_tree(spark, sf_dir).paths.select("u", "v", "d", "first", "last")


@query
def tree_leaf_paths(spark, sf_dir):
    return given.item_tree(spark, sf_dir).leaf_paths("l_discount")


@query
def refit_to_subset(spark, sf_dir):
    t = given.item_tree(spark, sf_dir).refit_to_subset(SUBSET + ["l_returnflag"])
    return t.edges.join(t.tree, ["u", "v"]).select("u", "v", r("i"))


@query
def change_prior(spark, sf_dir):
    return given.item_tree(spark, sf_dir).with_prior("laplace").summary().select(
        r("sum_entropy", 8), r("sum_mi", 8), r("entropy", 8)
    )


@query
def saved_tree_summary(spark, sf_dir):
    """Written out, read back and asked again; the names are residues of a first chain."""
    folder = scratch_path(spark, "saved")
    names = dict(zip(VARIABLES, given.RESIDUE_NAMES))
    rows = given.wide_rows(spark, sf_dir).withColumnsRenamed(names)
    save_tree(InformationTree.from_columns(rows, given.RESIDUE_NAMES), folder, attributes={"source": "items"})
    t = load_tree(spark, folder)
    return t.entropy_interval().select(r("entropy", 8), r("entropy_se", 6), r("lo", 6), r("hi", 6))


# -- model -------------------------------------------------------------------------------------


@query
def transfer_matrix(spark, sf_dir):
    return given.item_tree(spark, sf_dir).transfers.select("u", "v", "xu", "xv", r("p"))


@query
def transfer_matrix_fixed_state(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).transfer_matrix("l_discount", "l_tax", fix="0.02")
    return out.select("xu", "xv", r("p"))


@query
def path_joint(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).joint_distribution(*PATH_ENDS)
    return out.select("xu", "xv", r("p"))


@query
def implied_information(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).implied_information()
    return out.select("u", "v", r("i_cl"))


@query
def implied_information_with_knockouts(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).implied_information(knockout=True)
    return out.select("u", "v", r("i_cl"))


@query
def edge_knockout(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).knockout_joints()
    return out.select("u", "v", "xu", "xv", r("p"))


@query
def log_probability(spark, sf_dir):
    """Every row scored; the mean by order priority."""
    rows = given.wide_rows(spark, sf_dir)
    scored = given.item_tree(spark, sf_dir).log_probability(rows)
    return scored.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("log_p"), 8).alias("log_p")
    )


@query
def log_probability_with_nulls(spark, sf_dir):
    """Rows with missing values, scored by the tree that counted them."""
    rows = given.wide_rows(spark, sf_dir).withColumn("l_linenumber", F.expr("nullif(l_linenumber, 3)"))
    scored = InformationTree.from_columns(rows, VARIABLES).log_probability(rows)
    return scored.groupBy(F.expr("coalesce(cast(l_linenumber as string), 'null') AS l_linenumber")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("log_p"), 8).alias("log_p")
    )


@query
def tree_sample(spark, sf_dir):
    """One draw per order."""
    ids = given.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return given.item_tree(spark, sf_dir).sample(ids, seed=SEED)


@query
def reweighted_joints(spark, sf_dir):
    """Edge joints under node marginals that favour no state."""
    t = given.item_tree(spark, sf_dir)
    flat = t.node_counts.join(t.nodes.select("var", "k"), "var").select(
        "var", "state", (1.0 / F.col("k")).alias("p")
    )
    return t.reweighted(flat, "l_discount").select("u", "v", "xu", "xv", r("p"))


# -- uncertainty -------------------------------------------------------------------------------


@query
def leave_one_out_entropies(spark, sf_dir):
    return given.item_tree(spark, sf_dir).leave_one_out_entropies().select("node", r("entropy"))


@query
def leave_one_out_contributions(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).leave_one_out_contributions()
    return out.select("node", "var", r("contribution"))


@query
def contribution_spread(spark, sf_dir):
    return given.item_tree(spark, sf_dir).contribution_spread().select("var", r("s_contribution_se", 9))


@query
def tree_errors(spark, sf_dir):
    out = given.item_tree(spark, sf_dir).errors
    return out.select(
        r("mle_bias", 8), r("counts_variance", 8), r("structural_variance", 8), r("rmse", 6)
    )


# -- states of score arrays --------------------------------------------------------------------


@query
def score_states(spark, sf_dir):
    return logits.logits_to_states(given.scores(spark, sf_dir))


@query
def score_tree(spark, sf_dir):
    t = fit_logits(given.scores(spark, sf_dir))
    return t.edges.join(t.tree, ["u", "v"]).select("u", "v", r("i"))


# -- circular statistics and mixtures ----------------------------------------------------------


@query
def circular_mean(spark, sf_dir):
    out = given.label_means(given.angles(spark, sf_dir))
    return out.select("residue", "label", "feature", "n", r("mu", 8))


@query
def wrapped_angles(spark, sf_dir):
    """Sums of angles wrapped back, and values clamped into the range of concentrations."""
    rows = given.angles(spark, sf_dir).select("residue", "frame", F.posexplode("theta").alias("feature", "x"))
    odd = F.col("feature") % 4 != 3
    return rows.select(
        "residue", "frame", "feature", r(circular.wrap_angle(F.col("x") * 5.0, odd), 8, "wrapped"),
        r(circular.clamp_kappa(F.col("x") * 300.0, odd), 6, "clamped"),
    )


@query
def component_log_density(spark, sf_dir):
    """Summed log-density of each frame under each component, by joins alone."""
    params = mixture.feature_rows(
        mixture.mixtures_table(spark, given.label_mixtures(spark, sf_dir))
    )
    params = materialize(params, "params")
    rows = given.angles(spark, sf_dir).select("residue", "frame", F.posexplode("theta").alias("feature", "x"))
    density = F.expr(circular.von_mises_log_density("x", "mu", "kappa"))
    out = rows.join(params, ["residue", "feature"]).groupBy("residue", "frame", "comp").agg(
        F.sum(density).alias("log_density")
    )
    return out.select("residue", "frame", "comp", r("log_density", 4))


@query
def mixture_responsibilities(spark, sf_dir):
    out = mixture.responsibilities(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir))
    return out.select("residue", "frame", F.posexplode("r").alias("comp", "r")).select(
        "residue", "frame", "comp", r("r", 7)
    )


@query
def mixture_log_likelihood(spark, sf_dir):
    out = mixture.responsibilities(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir))
    return out.groupBy("residue").agg(F.round(F.avg("log_density"), 6).alias("ll"))


@query
def expectation_step(spark, sf_dir):
    out = mixture.expectation_sums(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir))
    return out.select("residue", "comp", "feature", r("w", 6), r("c", 6), r("s", 6))


@query
def expected_log_likelihood(spark, sf_dir):
    """sum of r ln f over frames and components, from the sums of the E-step, and of w ln w."""
    out = mixture.expected_log_likelihood(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir))
    return out.select("residue", r("ell", 5))


@query
def maximization_step(spark, sf_dir):
    sums = mixture.expectation_sums(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir))
    out = mixture.maximization(sums)
    return out.select("residue", "comp", "feature", r("logw", 6), r("mu", 6), r("kappa", 3))


@query
def mixture_divergence(spark, sf_dir):
    """Divergence of each component from component 0 of its residue."""
    rows = mixture.feature_rows(mixture.mixtures_table(spark, given.label_mixtures(spark, sf_dir)))
    rows = materialize(rows, "params")
    base = rows.filter("comp = 0").select(
        "residue", "feature", F.col("mu").alias("mu1"), F.col("kappa").alias("kappa1")
    )
    kl = F.expr(circular.von_mises_kl("mu", "kappa", "mu1", "kappa1"))
    out = rows.join(base, ["residue", "feature"]).groupBy("residue", "comp").agg(F.sum(kl).alias("kl"))
    return out.select("residue", "comp", r("kl", 6))


@query
def mixture_fit_trace(spark, sf_dir):
    angle_rows = mixture.by_residue(given.angles(spark, sf_dir))
    fit = em.fit_mixtures(angle_rows, given.label_mixtures(spark, sf_dir))
    return fit.table.trace.select("residue", "iter", "ll", "converged")


@query
def mixture_seeds(spark, sf_dir):
    angle_rows = mixture.by_residue(given.angles(spark, sf_dir))
    masks = mixture.mask_table(angle_rows)
    start = mixture.initial_mixtures(angle_rows, masks, given.COMPONENTS, SEED)
    return mixture.mixtures_table(spark, start)


# -- clustering --------------------------------------------------------------------------------


def _overlap(spark, sf_dir):
    return materialize(
        cluster.component_overlap(given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir)),
        "overlap",
    )


def _membership(spark, sf_dir, eps=0.96):
    overlap = _overlap(spark, sf_dir)
    near = cluster.neighbourhood(cluster.component_distances(overlap), F.lit(eps))
    weights = cluster.component_weights(overlap)
    return overlap, cluster.density_states(near, weights, ["residue"], min_mass=0.16)


@query
def component_distances(spark, sf_dir):
    out = cluster.component_distances(_overlap(spark, sf_dir))
    return out.select("residue", "i", "j", r("d", 7))


@query
def neighbourhood_size(spark, sf_dir):
    out = cluster.neighbourhood(cluster.component_distances(_overlap(spark, sf_dir)), F.lit(0.96))
    return out.groupBy("residue", "i").agg(F.count(F.lit(1)).alias("n"))


@query
def eps_of_spread(spark, sf_dir):
    out = cluster.eps_of_spread(cluster.component_distances(_overlap(spark, sf_dir)))
    return out.select("residue", r("eps", 7))


@query
def density_states(spark, sf_dir):
    _, members = _membership(spark, sf_dir)
    return members.select("residue", "comp", "state", "is_noise")


@query
def clustering_summary(spark, sf_dir):
    overlap, members = _membership(spark, sf_dir)
    n = cluster.component_weights(overlap).select("residue", "n").distinct()
    out = cluster.state_entropy(members, n, ["residue"])
    return out.select("residue", r("s", 6), r("s_pm", 6), r("s_se", 5))


@query
def assigned_states(spark, sf_dir):
    _, members = _membership(spark, sf_dir)
    return cluster.assign_states(
        given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir), members
    )


@query
def assigned_state_summary(spark, sf_dir):
    out = cluster.state_summary(assigned_states(spark, sf_dir))
    return out.select("residue", "n_states", r("s", 8), r("s_se", 6))


@query
def eps_sweep(spark, sf_dir):
    out = cluster.eps_sweep(_overlap(spark, sf_dir), None, None, SWEEP)
    return out.select("residue", r("eps", 2), r("s", 6), r("s_pm", 6), r("s_se", 5))


@query
def eps_sweep_with_density_matrices(spark, sf_dir):
    angle_rows = given.angles(spark, sf_dir)
    fits = given.label_mixtures(spark, sf_dir)
    return cluster.eps_sweep(_overlap(spark, sf_dir), angle_rows, fits)


@query
def eps_resampling(spark, sf_dir):
    overlap = _overlap(spark, sf_dir)
    eps = cluster.eps_of_spread(cluster.component_distances(overlap), 0.1)
    out = cluster.eps_resampling(overlap, eps, SEED)
    return out.select("residue", r("s_mean", 6), r("s_se", 5))


@query
def component_jackknife(spark, sf_dir):
    overlap = _overlap(spark, sf_dir)
    eps = cluster.eps_of_spread(cluster.component_distances(overlap), 0.1)
    out = cluster.component_jackknife(
        given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir), overlap, eps
    )
    return out.select("residue", r("s_mean", 6), r("s_se", 5))


@query
def von_neumann_entropy(spark, sf_dir):
    _, members = _membership(spark, sf_dir)
    matrices = cluster.density_matrix(
        given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir), members
    )
    return cluster.von_neumann_entropy(matrices, ["residue"])


@query
def density_matrices(spark, sf_dir):
    _, members = _membership(spark, sf_dir)
    out = cluster.density_matrix(
        given.angles(spark, sf_dir), given.label_mixtures(spark, sf_dir), members
    )
    return out.select("residue", "i", "j", r("x", 7))


@query
def angle_tree(spark, sf_dir):
    """The whole way from angles to the tree."""
    run = fit_angles(
        given.angles(spark, sf_dir).drop("label"), start=given.label_mixtures(spark, sf_dir),
    )
    return run.tree.tree_edges


# -- geometry ----------------------------------------------------------------------------------


@query
def chain_internal_coordinates(spark, sf_dir):
    out = geometry.backbone_internal(given.points(spark, sf_dir))
    return out.select("frame", "pos", r("length", 7), r("angle", 7), r("dihedral", 7))


@query
def placed_points(spark, sf_dir):
    """Each point of a chain placed again from the three before it."""
    from pyspark.sql import Window

    along = Window.partitionBy("frame").orderBy("pos")
    p = F.struct("x", "y", "z")
    rows = given.points(spark, sf_dir).select("frame", "pos", p.alias("d"), *[
        F.lag(p, k).over(along).alias(n) for k, n in ((1, "c"), (2, "b"), (3, "a"))
    ]).filter("a is not null")
    a, b, c, d = (vec3.vec(k) for k in "abcd")
    rows = rows.withColumn("i", vec3.decompose(a, b, c, d))
    out = vec3.place(a, b, c, F.col("i.length"), F.col("i.angle"), F.col("i.dihedral"))
    return rows.select("frame", "pos", *[r(v, 6, n) for n, v in zip("xyz", out)])


@query
def rebuilt_chain_distances(spark, sf_dir):
    """Chains rebuilt from internal coordinates: distances to the fourth point before."""
    from pyspark.sql import Window

    along = Window.partitionBy("frame").orderBy("pos")
    p = F.struct("x", "y", "z")
    zeros = given.points(spark, sf_dir).filter("pos < 3").select(
        "frame", (F.col("pos") - 3).alias("pos"),
        # Any three points off a line may stand before the chain.
        (F.col("pos") == 0).cast("double").alias("x"), (F.col("pos") == 1).cast("double").alias("y"),
        F.lit(0.0).alias("z"),
    )
    internal = geometry.backbone_internal(given.points(spark, sf_dir).unionByName(zeros))
    built = geometry.rebuild_backbone(internal)
    rows = built.select("frame", "pos", p.alias("d"), F.lag(p, 4).over(along).alias("a")).filter("a is not null")
    return rows.select("frame", "pos", r(vec3.distance(vec3.vec("a"), vec3.vec("d")), 6, "distance"))


@query
def rigid_alignment(spark, sf_dir):
    """Chains moved so that their first three points span the standard frame."""
    pts = given.points(spark, sf_dir)
    first = pts.filter("pos < 3").groupBy("frame").pivot("pos", [0, 1, 2]).agg(F.first(F.struct("x", "y", "z")))
    rows = pts.join(first.withColumnsRenamed({"0": "a", "1": "b", "2": "c"}), "frame")
    lit = lambda *v: vec3.Vec(*[F.lit(float(x)) for x in v])
    out = vec3.align_rigid(
        vec3.vec(F.struct("x", "y", "z")), tuple(vec3.vec(k) for k in "abc"),
        (lit(0, 0, 0), lit(0, 1, 0), lit(1, 1, 0)),
    )
    return rows.select("frame", "pos", *[r(v, 6, n) for n, v in zip("xyz", out)])


@query
def superposed_frames(spark, sf_dir):
    """Mean squared distance of each frame to the first one after superposition."""
    atoms = given.peptide(spark, sf_dir)
    moved = geometry.superpose(atoms)
    first = atoms.filter("frame = 0").select("serial", *[F.col(k).alias(f"r{k}") for k in "xyz"])
    square = sum((F.pow(F.col(k) - F.col(f"r{k}"), 2) for k in "xyz"), F.lit(0.0))
    return moved.join(first, "serial").groupBy("frame").agg(F.round(F.avg(square), 6).alias("msd"))


@query
def strided_alpha_carbons(spark, sf_dir):
    atoms = topology.select_alpha_carbons(topology.select_protein(given.peptide(spark, sf_dir)))
    return atoms.filter("frame % 5 = 0").select("frame", "residue", r("x", 6), r("y", 6), r("z", 6))


@query
def residue_numbers(spark, sf_dir):
    """Nations as residues, regions as chains."""
    rows = given.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("serial"), F.lit("CA").alias("name"),
        F.upper(F.substring("n_name", 1, 3)).alias("resname"),
        F.col("n_nationkey").alias("resseq"), F.col("n_regionkey").alias("chain"),
    )
    return topology.residue_numbers(rows).select("resseq", "chain", "residue", "label")


@query
def slot_coordinates(spark, sf_dir):
    out = geometry.slot_list(geometry.slot_coordinates(given.peptide(spark, sf_dir)))
    return out.select("frame", "residue", "aa", "slot", r("x", 6), r("y", 6), r("z", 6))


@query
def residue_internal_coordinates(spark, sf_dir):
    out = geometry.internal_coordinates(geometry.slot_coordinates(given.peptide(spark, sf_dir)))
    return out.select("frame", "residue", "slot", r("length", 6), r("angle", 6), r("dihedral", 6))


@query
def angle_features(spark, sf_dir):
    internal = geometry.internal_coordinates(geometry.slot_coordinates(given.peptide(spark, sf_dir)))
    out = geometry.angle_features(internal)
    return out.select("residue", "frame", F.posexplode("theta").alias("feature", "x")).select(
        "residue", "frame", "feature", r("x", 6)
    )


@query
def folded_frames(spark, sf_dir):
    """Peptides folded back from internal coordinates: bond lengths to the alpha carbon."""
    internal = geometry.internal_coordinates(geometry.slot_coordinates(given.peptide(spark, sf_dir)))
    built = geometry.fold(internal)
    centre = built.filter("slot = 1").select("frame", "residue", *[F.col(k).alias(f"c{k}") for k in "xyz"])
    square = sum((F.pow(F.col(k) - F.col(f"c{k}"), 2) for k in "xyz"), F.lit(0.0))
    return built.join(centre, ["frame", "residue"]).select(
        "frame", "residue", "slot", r(F.sqrt(square), 6, "distance")
    )


@query
def mean_bond_lengths(spark, sf_dir):
    internal = geometry.internal_coordinates(geometry.slot_coordinates(given.peptide(spark, sf_dir)))
    out = geometry.mean_lengths(internal)
    return out.groupBy("residue", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("length"), 6).alias("length")
    )


# -- drawing -----------------------------------------------------------------------------------


def _drawn(spark, sf_dir):
    t = given.item_tree(spark, sf_dir)
    vectors = given.table(spark, sf_dir, "embeddings")
    # Each coordinate is the mean over the vectors of the sum of every 21st component.
    width = 3 * len(VARIABLES)
    sums = vectors.select(F.posexplode("embedding").alias("k", "e")).groupBy((F.col("k") % width).alias("k")).agg(
        F.sum(F.col("e").cast("double")).alias("e")
    )
    one = F.lit(1).alias("one")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).select(one, "n")
    means = sums.select(one, "*").join(count, "one").select(
        F.floor(F.col("k") / 3).cast("int").alias("serial"), F.element_at(F.array(*map(F.lit, "xyz")), F.col("k") % 3 + 1).alias("axis"),
        (F.col("e") / F.col("n")).alias("e"),
    ).groupBy("serial").pivot("axis", list("xyz")).agg(F.first("e"))
    points = means.select(
        F.element_at(F.array(*map(F.lit, VARIABLES)), F.col("serial") + 1).alias("var"),
        (F.col("serial") + 1).alias("serial"), F.col("serial").alias("resseq"), "x", "y", "z",
    )
    nodes = materialize(drawn_nodes(t, points), "drawn")
    return t, nodes


@query
def drawing_nodes(spark, sf_dir):
    _, nodes = _drawn(spark, sf_dir)
    return nodes.select("id", "var", r("entropy", 8), r("bfactor", 8), r("vdw", 8))


@query
def drawing_edges(spark, sf_dir):
    t, nodes = _drawn(spark, sf_dir)
    out = drawn_edges(t, nodes, min_mi=0.0003, min_radius=0.02, high=0.002)
    return out.select(
        "u_id", "v_id", r("mi", 8), r("radius", 7), *[r(f"colour.{c}", 6, c) for c in "rgb"]
    )
