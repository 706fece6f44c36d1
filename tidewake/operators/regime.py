"""Regime models on ordered series: Gaussian hidden Markov models and online changepoints.

A model is fitted a task: the bars of one fit (some thousands) are a group. What
runs over long series (filtering, changepoints) is an ordered fold with a small
state, so it needs no group in memory and can stream.

A row's evidence is a vector over states, scaled so that its largest entry is 1;
a belief is a probability vector that moves on by the transition matrix, is
multiplied by the evidence and normalised. Fitted probabilities are smoothed by
``PRIOR`` counts, so none is zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewake.operators.fold import ordered_fold

#: Least variance of a state, and counts that smooth its moves.
FLOOR = 1e-8
PRIOR = 1e-3


@dataclass
class Regimes:
    """States by their start and transition probabilities, and a diagonal normal each."""

    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    @classmethod
    def of_row(cls, row) -> Regimes:
        """From a row's flat lists."""
        k = len(row["start"])
        return cls(*(np.asarray(row[c], float).reshape(shape) for c, shape in (("start", k), ("move", (k, k)), ("means", (k, -1)), ("variances", (k, -1)))))

    def flat(self) -> dict[str, list[list[float]]]:
        return {c: [getattr(self, c).ravel().tolist()] for c in ("start", "move", "means", "variances")}

    def evidence(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Densities of each row under each state over the row's largest, and the logarithms of these."""
        z = (x[:, None, :] - self.means) ** 2 / self.variances + np.log(2 * math.pi * self.variances)
        log = -z.sum(2) / 2
        top = log.max(1)
        return np.exp(log - top[:, None]), top

    def advance(self, belief: np.ndarray | None, evidence: np.ndarray) -> tuple[np.ndarray, float]:
        """The belief after one more row of evidence, and the row's share of the likelihood."""
        ahead = (self.start if belief is None else belief @ self.move) * evidence
        scale = float(ahead.sum())
        return ahead / scale, scale


def beliefs(model: Regimes, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The belief at each row given the rows up to it, and each row's scale."""
    out, scales, belief = np.empty_like(evidence), np.empty(len(evidence)), None
    for t, e in enumerate(evidence):
        belief, scales[t] = model.advance(belief, e)
        out[t] = belief
    return out, scales


def hindsight(model: Regimes, evidence: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """What the rows behind each one say about its state, on the scale of the beliefs: belief times this is the smoothed state."""
    out = np.ones_like(evidence)
    for t in range(len(evidence) - 1, 0, -1):
        out[t - 1] = model.move @ (evidence[t] * out[t]) / scales[t]
    return out


def by_quantiles(x: np.ndarray, k: int) -> Regimes:
    """A start for fitting: rows in order of their first feature, cut into k parts, a state for each."""
    parts = np.array_split(x[np.argsort(x[:, 0], kind="stable")], k)
    sticky = np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))
    return Regimes(np.full(k, 1 / k), sticky / sticky.sum(1, keepdims=True), np.array([p.mean(0) for p in parts]), np.array([np.maximum(p.var(0), FLOOR) for p in parts]))


def fit(x: np.ndarray, k: int = 3, rounds: int = 100, tol: float = 1e-4) -> tuple[Regimes, float]:
    """A model by expectation-maximisation and its log-likelihood, states in order of their first mean.

    It ends when a round gains less than ``tol`` a row.
    """
    model, reached = by_quantiles(x, k), -np.inf
    for _ in range(rounds):
        evidence, top = model.evidence(x)
        alpha, scales = beliefs(model, evidence)
        beta = hindsight(model, evidence, scales)
        now = float((np.log(scales) + top).mean())
        if now - reached < tol:
            break
        reached = now
        smoothed = alpha * beta
        # Expected moves of all pairs of neighbouring rows in one product.
        moves = model.move * (alpha[:-1].T @ (evidence[1:] * beta[1:] / scales[1:, None])) + PRIOR
        mass = smoothed.sum(0)[:, None] + PRIOR
        means = (smoothed.T @ x + PRIOR * model.means) / mass
        spread = np.stack([smoothed[:, j] @ (x - means[j]) ** 2 for j in range(k)])
        first = smoothed[0] + PRIOR
        model = Regimes(first / first.sum(), moves / moves.sum(1, keepdims=True), means, np.maximum(spread / mass, FLOOR))
    order = np.argsort(model.means[:, 0], kind="stable")
    model = Regimes(model.start[order], model.move[np.ix_(order, order)], model.means[order], model.variances[order])
    evidence, top = model.evidence(x)
    return model, float((np.log(beliefs(model, evidence)[1]) + top).sum())


def likeliest(model: Regimes, evidence: np.ndarray) -> np.ndarray:
    """The likeliest states of all rows together; ties go to the lowest."""
    best, came = model.start * evidence[0], []
    for e in evidence[1:]:
        through = best[:, None] * model.move
        came.append(through.argmax(0))
        best = through.max(0) * e
        best = best / best.max()
    path = [int(best.argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return np.array(path[::-1])


def fit_groups(df: DataFrame, keys: list[str], order: str, features: list[str], k: int = 3, rounds: int = 60, tol: float = 1e-4) -> DataFrame:
    """One row of parameters a group: (keys, n, loglik, start, move, means, variances), lists flattened by rows."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(order)[features].to_numpy(float)
        if len(x) < 2 * k:
            return pd.DataFrame(columns=[*keys, "n", "loglik", "start", "move", "means", "variances"])
        model, total = fit(x, k, rounds, tol)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] for c in keys}, "n": [len(x)], "loglik": [total], **model.flat()})

    wanted = df.select(*keys, order, *features).dropna(subset=features)
    return wanted.groupBy(*keys).applyInPandas(run, f"{kinds}, n long, loglik double, start array<double>, move array<double>, means array<double>, variances array<double>")


def filtered(df: DataFrame, params: DataFrame, keys: list[str], order: list[str], features: list[str]) -> DataFrame:
    """(keys, order[0], probs, regime): causal state probabilities of each row under its key's parameters."""
    kind = df.schema[order[0]].dataType.simpleString()
    rows = df.dropna(subset=features).join(params.drop("n", "loglik"), keys)

    def step(state, row):
        if "model" not in state:
            state["model"], state["belief"] = Regimes.of_row(row._asdict()), None
        evidence, _ = state["model"].evidence(np.array([[getattr(row, f) for f in features]], float))
        state["belief"], _ = state["model"].advance(state["belief"], evidence[0])
        return [(getattr(row, order[0]), state["belief"].tolist(), int(state["belief"].argmax()))]

    return ordered_fold(rows, keys, order, dict, step, f"`{order[0]}` {kind}, probs array<double>, regime int")


def decoded(df: DataFrame, params: DataFrame, keys: list[str], order: str, features: list[str]) -> DataFrame:
    """(keys, order, smoothed, path): probabilities given all of a group's rows, and its likeliest states; not causal.

    Both need a group's rows at once, so groups should be the bars of one fit.
    """
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    rows = df.select(*keys, order, *features).dropna(subset=features).join(params.drop("n", "loglik"), keys)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        model = Regimes.of_row(frame.iloc[0])
        evidence, _ = model.evidence(frame[features].to_numpy(float))
        alpha, scales = beliefs(model, evidence)
        smoothed = alpha * hindsight(model, evidence, scales)
        return frame[[*keys, order]].assign(smoothed=smoothed.tolist(), path=likeliest(model, evidence).astype(np.int32))

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, smoothed array<double>, path int")


class RunLength:
    """Posterior of how long the present run has lasted, over at most ``most`` lengths, under a normal-inverse-gamma prior (mean, weight, shape, rate).

    A run's rows enter by their number, sum and sum of squares alone, from which
    the posterior follows in closed form.
    """

    def __init__(self, hazard: float = 250.0, most: int = 500, prior: tuple[float, float, float, float] = (0.0, 1.0, 1.0, 1.0)):
        if hazard <= 1 or most < 2 or min(prior[1:]) <= 0:
            raise ValueError("hazard must be over 1, lengths 2 or more, and the prior positive")
        self.change, self.most, self.prior = 1 / hazard, most, prior
        self.chance, self.total, self.squares = np.ones(1), np.zeros(1), np.zeros(1)
        shapes = prior[2] + np.arange(most) / 2
        self.gammas = np.array([math.lgamma(a + 0.5) - math.lgamma(a) for a in shapes])

    def densities(self, x: float) -> np.ndarray:
        """Student's density of x after each run, over the largest."""
        mean, weight, shape, rate = self.prior
        n = np.arange(len(self.chance))
        weights = weight + n
        means = (weight * mean + self.total) / weights
        rates = rate + np.maximum(self.squares + weight * mean * mean - weights * means * means, 0) / 2
        freedom = 2 * shape + n
        spread = 2 * rates * (1 + 1 / weights)  # scale squared times degrees of freedom
        log = self.gammas[: len(n)] - np.log(spread) / 2 - (freedom + 1) / 2 * np.log1p((x - means) ** 2 / spread)
        return np.exp(log - log.max())

    def step(self, x: float) -> tuple[float, int]:
        """Probability that a run begins here, and the likeliest length (the lowest on ties)."""
        joint = self.chance * self.densities(x)
        joint /= joint.sum()
        keep = slice(0, self.most)
        chance = np.append(self.change, joint * (1 - self.change))[keep]
        self.chance = chance / chance.sum()
        self.total = np.append(0.0, self.total + x)[keep]
        self.squares = np.append(0.0, self.squares + x * x)[keep]
        return float(self.chance[0]), int(self.chance.argmax())


def run_lengths(df: DataFrame, x: str, keys: list[str], order: list[str], hazard: float = 250.0, most: int = 500, prior=(0.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """(keys, order[0], p_change, run_length) of each row of an ordered series."""
    kind = df.schema[order[0]].dataType.simpleString()

    def step(state, row):
        return [(getattr(row, order[0]), *state.step(float(getattr(row, x))))]

    return ordered_fold(df.where(f"`{x}` IS NOT NULL"), keys, order, lambda: RunLength(hazard, most, prior), step, f"`{order[0]}` {kind}, p_change double, run_length int")
