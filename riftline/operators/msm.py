"""Markov-model scores of transition counts, a row and a column for each state.

With the reference laws of both ends of a transition diagonal, the operator to
take singular values of is the count matrix scaled by the roots of its row and
column sums: no matrix root is needed.
"""

from __future__ import annotations

import warnings

import numpy as np

FLOOR = 1e-12
SCORES = {
    "VAMP1": lambda s: s.sum(),
    "VAMP2": lambda s: (s * s).sum(),
    "VAMPE": lambda s: len(s) - (s * s).sum(),
}


def symmetric_power(a: np.ndarray, p: float) -> np.ndarray:
    """A power of a symmetric matrix whose eigenvalues below ``FLOOR`` count as that."""
    values, axes = np.linalg.eigh((a + a.T) / 2)
    return (axes * np.clip(values, FLOOR, None) ** p) @ axes.T


def kinetic_spectrum(flow: np.ndarray) -> np.ndarray:
    """Singular values, descending, without the trivial largest one if there are others. Scaling ``flow`` changes nothing."""
    out, into = flow.sum(1), flow.sum(0)
    scale = np.sqrt(np.outer(out, into))
    scaled = np.divide(flow, scale, out=np.zeros_like(scale), where=scale > 0)
    s = np.linalg.svd(scaled, compute_uv=False)
    return s[min(1, len(s) - 1) :]


def vamp(flow: np.ndarray, kind: str) -> float:
    """A score of the flow between states; NaN where the spectrum can't be found."""
    if kind not in SCORES:
        raise ValueError(f"unknown score {kind!r}, not one of {', '.join(SCORES)}")
    try:
        return float(SCORES[kind](kinetic_spectrum(flow)))
    except np.linalg.LinAlgError:
        return float("nan")


def vamp_from_counts(counts: np.ndarray, kind: str = "VAMP2") -> float:
    """States that are never left are taken out of both sides, with a warning."""
    counts = np.array(counts, float)
    if counts.ndim != 2 or counts.shape[0] != counts.shape[1]:
        raise ValueError("counts must be square")
    left = np.flatnonzero(counts.any(1))
    if len(left) < len(counts):
        warnings.warn(f"{len(counts) - len(left)} states without outgoing counts are left out", stacklevel=2)
    return vamp(counts[left][:, left], kind)


def stationary(t: np.ndarray) -> np.ndarray:
    """The law that a transition matrix keeps: pi (T - 1) = 0 and sum 1, as one least-squares system."""
    n = len(t)
    system = np.vstack([t.T - np.eye(n), np.ones(n)])
    pi = np.abs(np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0])
    return pi / pi.sum()


def vamp_from_transitions(t: np.ndarray, kind: str = "VAMP2") -> float:
    t = np.asarray(t, float)
    return vamp(stationary(t)[:, None] * t, kind)


def reversible(counts: np.ndarray, tolerance: float = 1e-5, rounds: int = 10_000) -> np.ndarray:
    """Row-normalised maximum-likelihood reversible counts, by fixed-point iteration."""
    c = np.asarray(counts, float)
    both, out = c + c.T, c.sum(1)
    x = both.copy()
    for _ in range(rounds):
        flow = x.sum(1)
        rate = np.divide(out, flow, out=np.zeros_like(out), where=flow > 0)
        bottom = rate[:, None] + rate[None, :]
        new = np.divide(both, bottom, out=np.zeros_like(both), where=bottom > 0)
        done = np.abs(new - x).max() < tolerance
        x = new
        if done:
            break
    sums = x.sum(1, keepdims=True)
    return np.divide(x, sums, out=np.zeros_like(x), where=sums > 0)


def dense(rows, states: list) -> np.ndarray:
    """A count matrix from (from_state, to_state, n) rows."""
    at = {s: k for k, s in enumerate(states)}
    out = np.zeros((len(states),) * 2)
    for a, b, n in rows:
        out[at[a], at[b]] = n
    return out
