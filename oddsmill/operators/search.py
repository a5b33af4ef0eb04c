"""Searches whose function values come from Spark jobs: every point of a round is known before it, so that a job takes all searches' points at once."""
from __future__ import annotations

import math
from collections.abc import Callable, Hashable

import numpy as np

#: Lengths tried along a direction, half the width of a difference, and the longest step in any parameter.
LENGTHS, WIDTH, LONGEST = (1.0, 3.0, 1.7, 0.5, 0.2, 0.05, 0.005, 1e-4), 1e-4, 1.5
#: Times that a step is cut before a direction is given up, and longest steps in a row before they grow.
CUTS, RUNS = 8, 4


class Descent:
    """Least point of a smooth function by quasi-Newton steps (BFGS), with differences for gradients.

    ask() gives a round's points, tell() takes their values: points along a direction, with the neighbours of the one
    at length 1; and the neighbours of a point where another length was best. It has converged when no gradient is over
    g_tol, when three steps in a row gained under f_tol, or when no length along the steepest descent gains.
    `inverse` is the inverse curvature about the start, where it is known.
    """

    def __init__(self, start: np.ndarray, g_tol: float = 1e-5, f_tol: float = 1e-7, inverse: np.ndarray | None = None) -> None:
        self.x, self.value, self.g_tol, self.f_tol = np.array(start, float), math.inf, g_tol, f_tol
        self.converged, self.stage, self.slow, self.step = not len(self.x), "start", 0, None
        self.gradient, self.inverse = np.zeros(len(self.x)), np.eye(len(self.x)) if inverse is None else inverse
        self.fresh = inverse is None

    @staticmethod
    def around(x: np.ndarray) -> list[np.ndarray]:
        return [x + sign * WIDTH * e for e in np.eye(len(x)) for sign in (1, -1)]

    def ask(self) -> list[np.ndarray]:
        if self.stage == "start":
            return [self.x, *self.around(self.x)]
        if self.stage == "gradient":
            return self.around(self.x)
        return [*(self.x + t * self.direction for t in LENGTHS), *self.around(self.x + self.direction)]

    def tell(self, values: list[float]) -> None:
        values = [v if math.isfinite(v) else math.inf for v in values]
        if self.stage == "line":
            k, values, near = int(np.argmin(values[: len(LENGTHS)])), values[: len(LENGTHS)], values[len(LENGTHS) :]
            if values[k] < self.value:
                gain, self.value = self.value - values[k], values[k]
                self.step, self.stage = LENGTHS[k] * self.direction, "gradient"
                self.x = self.x + self.step
                self.slow = self.slow + 1 if gain < self.f_tol else 0
                if k == 0:
                    self.turn(near)
            elif self.fresh:
                self.converged = True
            else:
                self.restart()
            return
        if self.stage == "start":
            self.value, *values = values
        self.turn(values)

    def turn(self, values: list[float]) -> None:
        """A new direction, by the values around the point."""
        d = np.array(values[::2]) - np.array(values[1::2])
        g = np.where(np.isfinite(d), d, 0.0) / (2 * WIDTH)
        if self.step is not None:
            self.learn(self.step, g - self.gradient)
        self.gradient = g
        if np.abs(g).max() <= self.g_tol or self.slow >= 3:
            self.converged = True
        self.aim()

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = float(s @ y)
        if sy <= 1e-14:
            return
        if self.fresh:
            self.inverse = np.eye(len(s)) * (sy / float(y @ y))
        left = np.eye(len(s)) - np.outer(s, y) / sy
        self.inverse = left @ self.inverse @ left.T + np.outer(s, s) / sy
        self.fresh = False

    def restart(self) -> None:
        self.inverse, self.fresh = np.eye(len(self.x)), True
        self.aim()

    def aim(self) -> None:
        d = -self.inverse @ self.gradient
        if d @ self.gradient >= 0 and not self.fresh:
            self.restart()
            return
        self.direction, self.stage = d * min(1.0, LONGEST / max(float(np.abs(d).max()), 1e-300)), "line"


class Sloped:
    """Least point of a smooth function by quasi-Newton steps (BFGS), where a point's value comes with its gradient.

    ask() gives one point, tell() takes (value, gradient): a step of the trial's length, cut by a parabola until it gains
    enough. It has converged as Descent has: no gradient over g_tol, three steps in a row under f_tol, or no gain along
    the steepest descent. After RUNS longest steps in a row steps may be twice as long each time, so that a parameter
    without a least point runs off in few steps.
    """

    def __init__(self, start: np.ndarray, g_tol: float = 1e-5, f_tol: float = 1e-7, inverse: np.ndarray | None = None) -> None:
        self.x, self.value, self.g_tol, self.f_tol = np.array(start, float), math.inf, g_tol, f_tol
        self.converged, self.began, self.slow, self.cuts, self.length = not len(self.x), False, 0, 0, 1.0
        self.gradient, self.inverse = np.zeros(len(self.x)), np.eye(len(self.x)) if inverse is None else inverse
        self.fresh, self.direction, self.longest = inverse is None, np.zeros(len(self.x)), LONGEST
        self.runs = 0

    def ask(self) -> list[np.ndarray]:
        return [self.x + self.length * self.direction if self.began else self.x]

    def tell(self, found: list[tuple[float, np.ndarray]]) -> None:
        value, gradient = found[0]
        known = math.isfinite(value) and bool(np.isfinite(gradient).all())
        if not self.began:
            self.began = True
            if known:
                self.value, self.gradient = value, np.array(gradient, float)
            self.turn()
            return
        slope = float(self.gradient @ self.direction)
        if known and value < self.value and value <= self.value + 1e-4 * self.length * slope:
            step, gain, before = self.length * self.direction, self.value - value, self.gradient
            self.x, self.value, self.gradient = self.x + step, value, np.array(gradient, float)
            self.slow = self.slow + 1 if gain < self.f_tol else 0
            self.runs = self.runs + 1 if np.abs(step).max() > 0.99 * self.longest else 0
            self.longest = LONGEST * 2.0 ** max(self.runs - RUNS, 0)
            self.learn(step, self.gradient - before)
            self.turn()
            return
        parabola = 2 * (value - self.value - self.length * slope) if known else math.inf
        self.length *= min(max(-slope * self.length / parabola, 0.1), 0.5) if parabola > 0 and known else 0.2
        self.cuts += 1
        if self.cuts >= CUTS:
            if self.fresh:
                self.converged = True
            else:
                self.inverse, self.fresh = np.eye(len(self.x)), True
                self.turn()

    def learn(self, s: np.ndarray, y: np.ndarray) -> None:
        sy = float(s @ y)
        if sy <= 1e-14:  # bent the other way: the next step is longer
            self.inverse = self.inverse * 3
            return
        if self.fresh:
            self.inverse = np.eye(len(s)) * (sy / float(y @ y))
        left = np.eye(len(s)) - np.outer(s, y) / sy
        self.inverse = left @ self.inverse @ left.T + np.outer(s, s) / sy
        self.fresh = False

    def turn(self) -> None:
        """A new direction, and whether one is needed."""
        if np.abs(self.gradient).max() <= self.g_tol or self.slow >= 3:
            self.converged = True
        d = -self.inverse @ self.gradient
        if d @ self.gradient >= 0 and not self.fresh:
            self.inverse, self.fresh = np.eye(len(self.x)), True
            d = -self.gradient
        self.direction, self.length, self.cuts = d * min(1.0, self.longest / max(float(np.abs(d).max()), 1e-300)), 1.0, 0


def run_all(searches: dict[Hashable, Descent | Sloped], values: Callable[[dict[Hashable, list[np.ndarray]]], dict[Hashable, list]], most: int) -> int:
    """Runs searches to their ends, `most` rounds at most; `values` gives the values (and gradients) of all points of a round. Returns the rounds."""
    for k in range(most):
        asked = {name: s.ask() for name, s in searches.items() if not s.converged}
        if not asked:
            return k
        got = values(asked)
        for name in asked:
            searches[name].tell(got[name])
    return most
