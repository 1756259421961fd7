"""From angles to an information tree: mixtures, clustering, states, tree."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborinfo.lineage import materialize
from arborinfo.operators import cluster, em, mixture
from arborinfo.operators.logits import logits_to_states
from arborinfo.plans.tree import InformationTree

log = logging.getLogger("arborinfo")


def timed(message: str, func, report=log.info):
    """Report how long each call of ``func`` takes."""

    @wraps(func)
    def wrapped(*args, **kwargs):
        start = time.time()
        result = func(*args, **kwargs)
        minutes, seconds = divmod(time.time() - start, 60)
        report("%s in %d minutes and %.3f seconds.", message, int(minutes), seconds)
        return result

    return wrapped


@dataclass
class AngleFit:
    """What a run over angles leaves: parameters, clustering, states and tree."""

    fit: em.Fit
    params: DataFrame
    overlap: DataFrame
    distances: DataFrame
    eps: DataFrame
    membership: DataFrame
    states: DataFrame
    tree: InformationTree


def fit_angles(
    angles: DataFrame,
    masks: DataFrame | None = None,
    labels: dict[int, str] | None = None,
    components: int = 100,
    seed: int = 0,
    atol: float = 1e-2,
    max_iter: int = 100,
    spread: float = 1.0,
    min_mass: float = cluster.MIN_MASS,
    prior: str = "haldane",
    estimator: str = "bayes",
    start: dict[int, mixture.Mixture] | None = None,
) -> AngleFit:
    """Run the whole analysis on (residue, frame, theta).

    ``start`` continues from given parameters instead of seeding new ones; ``labels`` names
    the residues in the tree.
    """
    angles = mixture.by_residue(angles)
    feature_masks = mixture.mask_table(angles, masks)
    begin = start or timed("Seeded mixture components", mixture.initial_mixtures)(
        angles, feature_masks, components, seed
    )
    report = lambda i, done, total: log.info("Iteration %d: %d of %d residues converged.", i, done, total)
    fit = timed("Fitted mixtures", em.fit_mixtures)(angles, begin, atol, max_iter, report)
    overlap = materialize(cluster.component_overlap(angles, fit.mixtures), "overlap")
    distances = materialize(cluster.component_distances(overlap), "distances")
    eps = materialize(cluster.eps_of_spread(distances, spread), "eps")
    near = cluster.neighbourhood(distances.join(eps, "residue"), F.col("eps"))
    membership = materialize(
        cluster.density_states(near, cluster.component_weights(overlap), ["residue"], min_mass),
        "membership",
    )
    states = materialize(cluster.assign_states(angles, fit.mixtures, membership), "states")
    return AngleFit(
        fit, em.parameter_table(fit.table.state), overlap, distances, eps,
        membership, states,
        tree_of_states(
            states, labels or {r: str(r) for r in feature_masks}, prior=prior, estimator=estimator
        ),
    )


def tree_of_states(states: DataFrame, labels: dict[int, str], **options) -> InformationTree:
    """The tree of (residue, frame, state) rows; ``labels`` names the residues."""
    names = F.array(*[F.lit(labels.get(r)) for r in range(max(labels) + 1)])
    named = states.select("frame", names[F.col("residue")].alias("var"), "state")
    return InformationTree.from_states(named, list(labels.values()), **options)


def fit_logits(logits: DataFrame, **options) -> InformationTree:
    """The tree of the most likely letters of (frame, residue, s array<double>)."""
    return InformationTree.from_states(logits_to_states(logits), **options)
