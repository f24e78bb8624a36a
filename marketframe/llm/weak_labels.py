"""Expectation-maximisation for votes: rules of unknown reliability, two classes, no labels.

Rows enter as counts per pattern of votes, at most ``3 ** rules`` of them, so the fit is the same work
at any number of rows; counting the patterns is Spark's part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

#: Votes: 1 for the positive class, -1 against it, 0 abstains.
VOTES = (-1, 0, 1)


class Reliability:
    """Class prior and, per rule, the probability of each vote in either class."""

    def __init__(self, prior: float, tables: list[dict[tuple[int, int], float]]):
        self.prior, self.tables = prior, tables

    def weights(self) -> list[dict[int, float]]:
        """Per rule, what each vote adds to the log odds of the positive class."""
        return [{v: math.log(t[v, 1] / t[v, 0]) for v in VOTES} for t in self.tables]

    @property
    def bias(self) -> float:
        return math.log(self.prior / (1 - self.prior))

    def posterior(self, votes: Sequence[int]) -> float:
        odds = self.bias + sum(w[v] for w, v in zip(self.weights(), votes))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))

    def accuracies(self) -> list[float]:
        """Per rule, the share of right votes among its votes."""
        out = []
        for t in self.tables:
            right = self.prior * t[1, 1] + (1 - self.prior) * t[-1, 0]
            wrong = self.prior * t[-1, 1] + (1 - self.prior) * t[1, 0]
            out.append(right / (right + wrong))
        return out


def fit(
    patterns: Mapping[tuple[int, ...], int],
    rules: int,
    prior: float = 0.5,
    accuracy: float = 0.8,
    belief: float = 0.02,
    rounds: int = 200,
    tolerance: float = 1e-7,
) -> Reliability:
    """Reliabilities from pattern counts.

    Every rule starts by voting rightly with probability ``accuracy`` when it votes, which settles
    which of the two classes is the positive one; that start also stays in the estimate as if it had
    been seen on a share ``belief`` of all rows, so that a rare pattern cannot claim a class for
    itself. Without patterns the start values come back.
    """
    total = sum(patterns.values())
    start = []
    for k in range(rules):
        seen = {v: (sum(n for p, n in patterns.items() if p[k] == v) + 1) / (total + 3) for v in VOTES}
        table = {}
        for c in (0, 1):
            share = prior if c else 1 - prior
            odds = {v: seen[v] * (1 if v == 0 else (accuracy if (v > 0) == bool(c) else 1 - accuracy) / max(share, 1e-9)) for v in VOTES}
            table.update({(v, c): odds[v] / sum(odds.values()) for v in VOTES})
        start.append(table)
    model = Reliability(prior, start)
    if not total:
        return model
    for _ in range(rounds):
        positive = {p: model.posterior(p) for p in patterns}
        mass = sum(positive[p] * n for p, n in patterns.items())
        held = belief * total + 1
        tables = []
        for k in range(rules):
            table = {}
            for c in (0, 1):
                seen = {v: sum((positive[p] if c else 1 - positive[p]) * n for p, n in patterns.items() if p[k] == v) for v in VOTES}
                whole = sum(seen.values()) + held
                table.update({(v, c): (seen[v] + held * start[k][v, c]) / whole for v in VOTES})
            tables.append(table)
        new = Reliability(min(max((mass + held * prior) / (total + held), 1e-4), 1 - 1e-4), tables)
        change = max(abs(new.tables[k][v, c] - model.tables[k][v, c]) for k in range(rules) for v in VOTES for c in (0, 1))
        model = new
        if change < tolerance:
            break
    return model
