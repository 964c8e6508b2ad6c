"""Active inference agents over small models: each agent has a model of its own or one for all; its loop is a few steps, and many agents run in parallel.

A model is a dict of lists: A[o][s], B[s_next][s][a], C[o], D[s].
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-16
STEPS = "agent string, t int, observation int, action int, belief array<double>, free_energy double"


def demo_model() -> dict:
    """Two states, observations and actions: the first action keeps, the second changes the state."""
    return {"A": [[0.9, 0.1], [0.1, 0.9]], "B": [[[1, 0], [0, 1]], [[0, 1], [1, 0]]], "C": [1.0, -1.0], "D": [0.5, 0.5]}


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    return float(sum(x * np.log(x / (y + EPS)) for x, y in zip(p, q) if x > EPS))


def step(model: dict[str, np.ndarray], belief: np.ndarray, o: int) -> tuple[np.ndarray, int, np.ndarray, float]:
    """Posterior after an observation, best action (first of greatest preference), belief after it, and free energy."""
    joint = model["A"][o] * belief
    posterior = joint / joint.sum() if joint.sum() > 0 else belief
    following = [model["B"][:, :, a] @ posterior for a in range(model["B"].shape[2])]
    action = int(np.argmax([model["C"] @ (model["A"] @ s) for s in following]))
    energy = -np.log(max(float(model["A"][o] @ posterior), EPS)) + divergence(posterior, model["D"])
    return posterior, action, following[action], float(energy)


def episode(model: dict, steps: int, *, threshold: float | None = None) -> list[tuple]:
    """(t, observation, action, belief, free energy) of each step; observations are the most likely ones. Ends early once beliefs move less than ``threshold``."""
    m = {k: np.asarray(v, float) for k, v in model.items()}
    belief, out = m["D"], []
    for t in range(steps):
        o = int(np.argmax(m["A"] @ belief))
        posterior, action, new, energy = step(m, belief, o)
        out.append((t, o, action, posterior.tolist(), energy))
        if threshold is not None and divergence(new, belief) < threshold:
            break
        belief = new
    return out


def learn(model: dict, episodes: int, steps: int, *, rate: float = 0.1) -> dict:
    """The model after some episodes: D becomes the running mean of last beliefs (the first replaces it), A is blended with the observed shares and normalised."""
    m = {k: np.asarray(v, float).copy() for k, v in model.items()}
    for k in range(episodes):
        run = episode(m, steps)
        m["D"] = (m["D"] * k + np.asarray(run[-1][3])) / (k + 1)
        counts = np.zeros_like(m["A"])
        for _, o, _, belief, _ in run:
            counts[o] += belief
        total = counts.sum(axis=1, keepdims=True)
        seen = np.divide(counts, total, out=m["A"].copy(), where=total > 0)
        blended = (1 - rate) * m["A"] + rate * seen
        m["A"] = blended / blended.sum(axis=0, keepdims=True)
    return {k: v.tolist() for k, v in m.items()}


def run_agents(agents: DataFrame, model: dict, *, steps: int, threshold: float | None = None) -> DataFrame:
    """Steps of each agent (column agent), all from the same model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trail = episode(model, steps, threshold=threshold)
        for frame in frames:
            rows = [(a, *x) for a in frame["agent"] for x in trail]
            yield pd.DataFrame(rows, columns=["agent", "t", "observation", "action", "belief", "free_energy"])

    return agents.select("agent").mapInPandas(run, STEPS)


def run_models(agents: DataFrame, *, steps: int, threshold: float | None = None) -> DataFrame:
    """Steps of each agent from its own model: agent, states, actions (numbers), and a, b, c, d, the matrices row by row (b: next state, state, action)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                model = {"A": np.reshape(r.a, (-1, r.states)), "B": np.reshape(r.b, (r.states, r.states, r.actions)), "C": r.c, "D": r.d}
                rows += [(r.agent, *x) for x in episode(model, steps, threshold=threshold)]
            yield pd.DataFrame(rows, columns=["agent", "t", "observation", "action", "belief", "free_energy"])

    return agents.select("agent", "states", "actions", "a", "b", "c", "d").mapInPandas(run, STEPS)


def expected_free_energy(model: dict, belief: list[float], actions: list[int]) -> float:
    """Over the steps of a policy, the entropy of the predicted observation less its preference; the least value is the best policy."""
    m, s, total = {k: np.asarray(v, float) for k, v in model.items()}, np.asarray(belief, float), 0.0
    for a in actions:
        s = m["B"][:, :, a] @ s
        o = m["A"] @ s
        total += float(-(o[o > 0] * np.log(o[o > 0])).sum() - m["C"] @ o)
    return total


def ranked_policies(policies: DataFrame, model: dict, belief: list[float]) -> DataFrame:
    """policy, actions, efe of policies (policy, actions: array of action numbers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(efe=[expected_free_energy(model, belief, list(x)) for x in frame["actions"]])

    return policies.select("policy", "actions").mapInPandas(run, "policy string, actions array<int>, efe double")
