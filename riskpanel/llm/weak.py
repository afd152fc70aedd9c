"""A label model for overlapping voters, and a hashed linear model trained on its posteriors. Both see bounded input only."""

from __future__ import annotations

import numpy as np
import xxhash

ROUNDS = 500
TOLERANCE = 1e-7
#: Pseudo-counts of a voter's outcomes (against, abstains, for) in the positive class; the other class has them reversed.
PRIOR = np.array([0.2, 1.0, 1.8])
#: Posterior to begin with, without and with a vote against.
FIRST = (0.9, 0.1)


def estimate(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote rows (1 for, -1 against, 0 abstains) and how often each occurs.

    A voter has its own chances of the three outcomes in either class, so that one which sees a single kind of fault is
    not taken to vouch for the rest. Returns the posterior of the positive class for each row and the chances, shape
    (2, voters, 3). Stops when no posterior moves by TOLERANCE.
    """
    outcomes = np.stack([votes == -1, votes == 0, votes == 1], axis=2).astype(float)
    posterior = np.where((votes == -1).any(axis=1), FIRST[1], FIRST[0])
    chances = np.stack([np.tile(PRIOR / PRIOR.sum(), (votes.shape[1], 1)), np.tile(PRIOR[::-1] / PRIOR.sum(), (votes.shape[1], 1))])
    for _ in range(ROUNDS if len(votes) else 0):
        weights = counts * posterior, counts * (1 - posterior)
        chances = np.stack([np.tensordot(w, outcomes, 1) + p for w, p in zip(weights, (PRIOR, PRIOR[::-1]))])
        chances /= chances.sum(axis=2, keepdims=True)
        odds = np.log(weights[0].sum() + 1) - np.log(weights[1].sum() + 1) + np.tensordot(outcomes, np.log(chances[0]) - np.log(chances[1]), 2)
        now = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved, posterior = np.abs(now - posterior).max(), now
        if moved < TOLERANCE:
            break
    return posterior, chances


def slot(feature: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(feature) % size


def fit_linear(rows: list[tuple[list[int], list[float]]], target: np.ndarray, size: int, steps: int = 300, rate: float = 1.0,
               ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse hashed rows (slots, values) with soft targets, by accelerated gradient descent."""
    weight, bias = np.zeros(size), 0.0
    if not rows:
        return weight, bias
    lengths = [len(s) for s, _ in rows]
    owner = np.repeat(np.arange(len(rows)), lengths)
    at = np.concatenate([np.asarray(s, np.int64) for s, _ in rows])
    value = np.concatenate([np.asarray(v, float) for _, v in rows])
    speed, bias_speed = np.zeros(size), 0.0
    scale = rate / max(1e-9, (np.bincount(owner, value * value, len(rows)).mean() + 1))
    for _ in range(steps):
        margin = np.bincount(owner, weight[at] * value, len(rows)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        slope = np.bincount(at, error[owner] * value, size) / len(rows) + ridge * weight
        speed = 0.9 * speed - 4 * scale * slope
        bias_speed = 0.9 * bias_speed - 4 * scale * error.mean()
        weight += speed
        bias += bias_speed
    return weight, float(bias)
