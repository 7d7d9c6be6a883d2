"""One classifier with the settings of a single neuron; it picks the learner they name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from separatrix.functions.vectors import affine, sign_inclusive
from separatrix.operators import adaline, perceptron
from separatrix.operators.models import LinearModel
from separatrix.operators.tables import standardize

LEARNERS = (None, "regular", "stochastic")


@dataclass
class Neuron:
    """``gradient_descent`` is None for the perceptron rule, ``"regular"`` for batch
    descent and ``"stochastic"`` for row-by-row descent. Labels are -1 and +1.

    After ``fit``, ``weights`` holds the weights, intercept first, and ``history``
    the errors (perceptron) or costs (descent) per epoch.
    """

    eta: float = 0.01
    n_iter: int = 10
    shuffle: bool = True
    random_state: int = 0
    standardize_input: bool = True
    gradient_descent: str | None = None
    columns: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def prepare(self, df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None) -> DataFrame:
        """The table with z-scores in place of the columns, if inputs are to be standardized."""
        return standardize(df, columns, fitted_on) if self.standardize_input else df

    def fit(self, df: DataFrame, columns: Sequence[str], label: str, key: str) -> Neuron:
        """Learn from zero weights; ``key`` is unique and orders the rows."""
        if self.gradient_descent not in LEARNERS:
            raise ValueError(f"unknown optimization approach {self.gradient_descent!r}")
        if self.gradient_descent == "regular":
            model = adaline.fit_batch(df, columns, label, self.eta, self.n_iter)
        elif self.gradient_descent == "stochastic":
            model = adaline.fit_stochastic(
                df, columns, label, key, self.eta, self.n_iter, self.random_state, self.shuffle
            )
        else:
            model = perceptron.fit_ordered(df, columns, label, [key], self.eta, self.n_iter)
        return self._keep(model)

    def partial_fit(self, df: DataFrame, columns: Sequence[str], label: str, order: Sequence) -> Neuron:
        """Go on from the current weights with one row-by-row pass over further rows."""
        return self._keep(adaline.partial_fit(df, columns, label, order, self.eta, self.weights or None))

    def _keep(self, model: LinearModel) -> Neuron:
        self.columns, self.weights, self.history = model.columns, model.weights, model.history
        return self

    def net_input(self) -> Column:
        return affine(self.columns, self.weights)

    def predict(self) -> Column:
        return sign_inclusive(self.net_input())
