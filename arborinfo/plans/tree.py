"""The information tree of a set of variables, and the questions one asks it."""

from __future__ import annotations

from functools import cached_property
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.functions.entropy import check_estimator, check_prior
from arborinfo.lineage import materialize, settle
from arborinfo.operators import errors, information, model, paths as tree_paths_ops
from arborinfo.operators.pairs import (
    node_counts,
    pair_counts,
    pair_counts_long,
    pair_probabilities,
)
from arborinfo.operators.spanning import maximum_spanning_tree
from arborinfo.operators.tree_index import TreeIndex

#: Matrices of a model that are held as a local relation.
CENTRE_ROWS = 1000


class InformationTree:
    """Maximum information spanning tree over pair counts.

    The data is read once, to count the states of all pairs; that table is written to the
    shared folder and everything else derives from it. Properties are DataFrames that are
    planned once and evaluated when used. Posterior terms are computed for nodes and tree
    edges only.
    """

    def __init__(
        self,
        counts: DataFrame,
        estimator: str = "bayes",
        prior: str = "haldane",
        uncertainty: bool = True,
        tree: DataFrame | None = None,
    ):
        self.estimator = check_estimator(estimator)
        self.prior = check_prior(prior)
        self.uncertainty = uncertainty
        self.pair_counts = counts
        if tree is not None:
            self.__dict__["tree"] = tree

    # -- construction ---------------------------------------------------------------------

    @classmethod
    def from_columns(cls, df: DataFrame, variables: list[str], **options) -> InformationTree:
        """Each row of ``df`` is a joint observation of the columns ``variables``."""
        return cls(materialize(pair_counts(df, variables), "pairs"), **options)

    @classmethod
    def from_states(cls, states: DataFrame, variables: list[str] | None = None, **options):
        """From long (frame, var, state) rows with integer states."""
        return cls(materialize(pair_counts_long(states, variables), "pairs"), **options)

    def with_prior(self, prior: str) -> InformationTree:
        """The same counts and tree under another prior."""
        out = type(self)(
            self.pair_counts, self.estimator, prior, self.uncertainty, tree=self.tree
        )
        # What does not depend on the prior is not computed again.
        for name in ("node_counts", "edges", "paths", "index", "transfers", "coverings", "centre_tables"):
            if name in self.__dict__:
                out.__dict__[name] = self.__dict__[name]
        return out

    def refit_to_subset(self, variables: list[str], uncertainty: bool = False) -> InformationTree:
        """The tree of some of the variables."""
        kept = self.pair_counts.filter(F.col("u").isin(variables) & F.col("v").isin(variables))
        return type(self)(kept, self.estimator, self.prior, uncertainty)

    # -- tables ---------------------------------------------------------------------------

    @cached_property
    def node_counts(self) -> DataFrame:
        """(var, state, n)."""
        return settle(node_counts(self.pair_counts), "nodes")

    @cached_property
    def node_probabilities(self) -> DataFrame:
        """(var, state, p)."""
        total = self.node_counts.groupBy("var").agg(F.sum("n").alias("_t"))
        return self.node_counts.join(total, "var").select(
            "var", "state", (F.col("n") / F.col("_t")).alias("p")
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """(var, n_obs, k, s, s_pm, s_se)."""
        return settle(information.node_table(self.node_counts, self.prior), "node_table")

    @cached_property
    def edges(self) -> DataFrame:
        """(u, v, n_obs, s_u, s_v, s_uv, i) of all pairs, plug-in."""
        return settle(
            information.plugin_information(self.pair_counts, self.nodes), "edge_table"
        )

    @cached_property
    def tree(self) -> DataFrame:
        """(u, v) of the tree. Its weights are plug-in values under every estimator."""
        return maximum_spanning_tree(self.edges, "i")

    @cached_property
    def tree_edges(self) -> DataFrame:
        """(u, v, i, i_pm, i_se) of the tree."""
        plugin = self.edges.join(self.tree, ["u", "v"]).select("u", "v", "i")
        if self.estimator == "mle" and not self.uncertainty:
            return plugin.withColumns(
                {c: F.lit(None).cast("double") for c in ("i_pm", "i_se")}
            )
        counts = self.pair_counts.join(self.tree, ["u", "v"])
        posterior = information.posterior_information(counts, self.nodes, self.prior)
        joined = plugin.join(posterior.select("u", "v", "i_pm", "i_se"), ["u", "v"])
        return settle(joined, "tree_edges")

    @cached_property
    def paths(self) -> DataFrame:
        """Paths between all ordered pairs of variables."""
        return tree_paths_ops.tree_paths(self.tree)

    @cached_property
    def index(self) -> TreeIndex:
        """Ancestors, branches and paths of the tree."""
        return TreeIndex.of(self.tree)

    @property
    def _s(self):
        return F.col("s" if self.estimator == "mle" else "s_pm")

    @property
    def _i(self):
        return F.col("i" if self.estimator == "mle" else "i_pm")

    # -- entropies ------------------------------------------------------------------------

    def node_entropies(self) -> DataFrame:
        """(var, entropy)."""
        return self.nodes.select("var", self._s.alias("entropy"))

    def node_information(self) -> DataFrame:
        """(var, sum_mi): information summed over the tree neighbours."""
        ends = tree_paths_ops.directed(self.tree_edges, "i", "i_pm")
        summed = ends.groupBy(F.col("u").alias("var")).agg(F.sum(self._i).alias("sum_mi"))
        return self.nodes.select("var").join(summed, "var", "left").fillna(0.0, ["sum_mi"])

    def node_contributions(self) -> DataFrame:
        """(var, contribution): entropy minus half the summed information."""
        return self.node_entropies().join(self.node_information(), "var").select(
            "var", (F.col("entropy") - 0.5 * F.col("sum_mi")).alias("contribution")
        )

    def edge_information(self) -> DataFrame:
        """(u, v, mi) of the tree edges."""
        return self.tree_edges.select("u", "v", self._i.alias("mi"))

    def summary(self) -> DataFrame:
        """One row: sum_entropy, sum_mi, entropy."""
        one = F.lit(1).alias("_one")
        s = self.node_entropies().agg(F.sum("entropy").alias("sum_entropy")).select(one, "*")
        i = self.edge_information().agg(F.sum("mi").alias("sum_mi")).select(one, "*")
        return s.join(i, "_one").select(
            "sum_entropy", "sum_mi", (F.col("sum_entropy") - F.col("sum_mi")).alias("entropy")
        )

    def sum_marginal_entropy(self) -> float:
        return self.summary().first()["sum_entropy"]

    def sum_information(self) -> float:
        return self.summary().first()["sum_mi"]

    def entropy(self) -> float:
        return self.summary().first()["entropy"]

    def entropy_interval(self, level: float = 0.95) -> DataFrame:
        """One row: entropy, entropy_se, lo, hi."""
        z = abs(NormalDist().inv_cdf((1.0 - level) / 2.0))
        one = F.lit(1).alias("_one")
        joined = self.summary().select(one, "entropy").join(
            self.errors.select(one, F.col("rmse").alias("entropy_se")), "_one"
        )
        return joined.select(
            "entropy", "entropy_se",
            (F.col("entropy") - z * F.col("entropy_se")).alias("lo"),
            (F.col("entropy") + z * F.col("entropy_se")).alias("hi"),
        )

    # -- uncertainty ----------------------------------------------------------------------

    @cached_property
    def coverings(self) -> DataFrame:
        """The heaviest graph edges over each tree edge and around each variable."""
        return settle(errors.coverings(self.edges, self.tree, self.index), "coverings")

    @cached_property
    def _leave_out(self) -> tuple[DataFrame, DataFrame]:
        weights = self.edges.join(self.tree, ["u", "v"]).select("u", "v", "i")
        own = settle(errors.own_contributions(self.nodes, weights), "contributions")
        return own, settle(errors.leave_out_changes(weights, self.coverings), "leave_out")

    def leave_one_out_entropies(self) -> DataFrame:
        """(node, entropy): plug-in entropy of the tree refitted without each variable."""
        return errors.leave_out_entropies(*self._leave_out)

    def leave_one_out_contributions(self) -> DataFrame:
        """(node, var, contribution) in the tree refitted without ``node``."""
        return errors.leave_out_contributions(self.edges, *self._leave_out)

    def contribution_spread(self) -> DataFrame:
        """(var, s_contribution_se)."""
        return errors.contribution_spread(self.leave_one_out_contributions())

    @cached_property
    def errors(self) -> DataFrame:
        """One row: mle_bias, counts_variance, structural_variance, rmse."""
        return errors.tree_errors(self.nodes, self.tree_edges, self.leave_one_out_entropies())

    # -- graph ----------------------------------------------------------------------------

    def variables(self) -> DataFrame:
        return self.nodes.select("var")

    def neighbours(self, var: str) -> DataFrame:
        """(v, i, i_pm, i_se) of the tree edges at ``var``."""
        return (
            tree_paths_ops.directed(self.tree_edges, "i", "i_pm", "i_se")
            .filter(F.col("u") == var).drop("u")
        )

    def trim(self, variables: list[str]) -> DataFrame:
        """Tree edges on the paths between ``variables``."""
        return tree_paths_ops.subtree(self.tree_edges, self.index, variables)

    def root(self) -> str:
        return self.nodes.agg(F.min("var").alias("r")).first()["r"]

    def ordered_edges(self, root: str | None = None) -> list[tuple[str, str]]:
        """Directed (parent, child) edges, parents first."""
        return [(parent, child) for parent, child, _ in self.index.away_from(root or self.root())]

    def leaf_paths(self, root: str | None = None) -> DataFrame:
        """(leaf, step, parent, child)."""
        return tree_paths_ops.leaf_paths(self.pair_counts.sparkSession, self.index, root or self.root())

    # -- probability model ------------------------------------------------------------------

    @cached_property
    def transfers(self) -> DataFrame:
        """(u, v, xu, xv, p) with p = P(xv | xu), both orientations of each tree edge."""
        return settle(
            model.transfer_matrix(self.pair_counts.join(self.tree, ["u", "v"], "left_semi")),
            "transfers",
        )

    def transfer_matrix(self, u: str, v: str, fix: str | None = None) -> DataFrame:
        """P(v | u) of one tree edge; ``fix`` makes every row lead to that state of v."""
        pair = F.array_sort(F.array("u", "v")) == F.array(*[F.lit(x) for x in sorted((u, v))])
        rows = model.transfer_matrix(
            self.pair_counts.filter(pair), {v: fix} if fix is not None else None
        )
        return rows.filter((F.col("u") == u) & (F.col("v") == v))

    def joint_distribution(self, u: str, v: str) -> DataFrame:
        """(xu, xv, p) along the tree path from u to v."""
        return model.path_joint(self.transfers, self.node_probabilities, self.index.path(u, v))

    @cached_property
    def centre_tables(self) -> DataFrame:
        """Laws of the variables given the centres of a centroid decomposition."""
        return settle(
            model.centre_tables(self.transfers, self.node_probabilities, self.index), "centres", rows=CENTRE_ROWS
        )

    def implied_joints(self) -> DataFrame:
        """(u, v, xu, xv, p) of all pairs."""
        return model.implied_joints(self.centre_tables)

    def implied_information(self, knockout: bool = False) -> DataFrame:
        """(u, v, i_cl): information of all pairs implied by the tree.

        With ``knockout`` the value of a tree edge is what the tree without it implies.
        """
        sums = model.implied_entropies(self.centre_tables)
        if knockout:
            out = model.joint_entropies(self.knockout_joints())
            sums = sums.join(self.tree, ["u", "v"], "left_anti").unionByName(out)
        return model.information_of_entropies(sums, self.nodes).withColumnRenamed("i", "i_cl")

    def knockout_joints(self) -> DataFrame:
        """(u, v, xu, xv, p) of each tree edge in the tree that may not use it."""
        bridges = settle(errors.knockout_bridges(self.coverings), "bridges")
        ways = [(r["a"], r["b"], r["u"], r["v"]) for r in bridges.collect()]
        pieces = [(a, u) for a, _, u, _ in ways if a != u] + [(v, b) for _, b, _, v in ways if v != b]
        return errors.knockout_joints(
            bridges, model.implied_conditionals(self.centre_tables, self.index, pieces),
            self.transfers_of(bridges), self.node_probabilities,
        )

    def transfers_of(self, pairs: DataFrame) -> DataFrame:
        """Transfer matrices of the graph edges listed in ``pairs`` in either orientation."""
        wanted = pairs.select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        ).distinct()
        return model.transfer_matrix(self.pair_counts.join(wanted, ["u", "v"], "left_semi"))

    def edge_knockout(self, u: str, v: str) -> DataFrame:
        """(xu, xv, p) of u and v in the tree without that edge (or as implied, off the tree)."""
        a, b = sorted((u, v))
        path = self.index.path(a, b)
        transfers = self.transfers
        if len(path) == 2:  # one path, over the bridge
            bridge = errors.knockout_bridge(self.edges, self.index, a, b)
            if bridge is not None:
                path = self.index.path(a, bridge[0]) + self.index.path(bridge[1], b)
                crossed = self.pair_counts.filter(
                    (F.col("u") == min(bridge)) & (F.col("v") == max(bridge))
                )
                transfers = transfers.unionByName(model.transfer_matrix(crossed))
        rows = model.path_joint(transfers, self.node_probabilities, path)
        if (u, v) != (a, b):
            rows = rows.select(F.col("xv").alias("xu"), F.col("xu").alias("xv"), "p")
        return rows

    def information_matrix(
        self, kind: str = "empirical", variables: list[str] | None = None, diag: bool = False
    ) -> DataFrame:
        """(u, v, value) with both orientations.

        ``empirical`` holds the plug-in information of all pairs (posterior means exist on
        tree edges only), ``chow_liu`` what the tree implies, ``hybrid`` the first where
        u < v and the second where u > v.
        """
        if kind not in ("empirical", "chow_liu", "hybrid"):
            raise ValueError("kind must be 'empirical', 'chow_liu' or 'hybrid'")
        seen = self.edges.select("u", "v", F.col("i").alias("value"))
        flip = lambda e: e.select(F.col("v").alias("u"), F.col("u").alias("v"), "value")
        if kind == "empirical":
            out = seen.union(flip(seen))
        else:
            implied = self.implied_information().select("u", "v", F.col("i_cl").alias("value"))
            out = (seen if kind == "hybrid" else implied).union(flip(implied))
        if diag:
            out = out.union(self.nodes.select("var", "var", self._s))
        if variables:
            out = out.filter(F.col("u").isin(variables) & F.col("v").isin(variables))
        return out

    def information_pivot(self, **options) -> DataFrame:
        """The information matrix with one column per variable, NULL where there is no value."""
        long = self.information_matrix(**options)
        names = sorted(options.get("variables") or [r["var"] for r in self.variables().collect()])
        return long.groupBy("u").pivot("v", names).agg(F.first("value"))

    def log_probability(self, rows: DataFrame, root: str | None = None, name: str = "log_p"):
        """Log-probability of each row that has one column per variable."""
        root = root or self.root()
        return model.log_probability(
            rows, self.transfers, self.node_probabilities, self.ordered_edges(root), root, name
        )

    def sample(self, n: int | DataFrame, seed: int = 0, root: str | None = None) -> DataFrame:
        """``n`` draws from the tree (or one per ``id`` of a table): id and a column per variable."""
        root = root or self.root()
        ids = self.pair_counts.sparkSession.range(n) if isinstance(n, int) else n
        return model.sample(
            ids, self.transfers, self.node_probabilities, self.ordered_edges(root), root, seed
        )

    def reweighted(self, marginals: DataFrame, root: str | None = None) -> DataFrame:
        """Edge joints after replacing the node marginals, (u, v, xu, xv, p)."""
        return model.reweighted_joints(self.transfers, self.ordered_edges(root), marginals)

    def pair_probabilities(self) -> DataFrame:
        return pair_probabilities(self.pair_counts)
