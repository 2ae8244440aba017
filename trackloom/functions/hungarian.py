"""Minimum-cost assignment by shortest augmenting paths."""

from __future__ import annotations

import numpy as np


def assign(cost) -> list[tuple[int, int]]:
    """(row, column) pairs, in order of rows, of least total cost; min(rows, columns) pairs.

    Costs must be finite. Of equal optima the one found first stays, so give rows and columns in
    order of id. An empty matrix has no pairs. Cubic in the smaller side times the larger.
    """
    cost = np.asarray(cost, dtype=float)
    if cost.size == 0:
        return []
    if not np.isfinite(cost).all():
        raise ValueError("costs must be finite")
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in assign(cost.T))
    n, m = cost.shape
    row_price, column_price = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for start in range(n):
        # Dijkstra over columns from the free row, with reduced costs
        distance, through = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        row, reached = start, 0.0
        column = -1
        while True:
            step = reached + cost[row] - row_price[row] - column_price
            better = ~done & (step < distance)
            distance[better], through[better] = step[better], row
            column = int(np.argmin(np.where(done, np.inf, distance)))
            reached = distance[column]
            done[column] = True
            if row_of[column] < 0:
                break
            row = row_of[column]
        closed = np.flatnonzero(done)
        row_price[start] += reached
        others = closed[row_of[closed] >= 0]
        row_price[row_of[others]] += reached - distance[others]
        column_price[closed] -= reached - distance[closed]
        while True:
            row = through[column]
            row_of[column] = row
            if row == start:
                break
            column = int(np.flatnonzero((row_of == row) & (np.arange(m) != column))[0])
    return sorted((int(r), c) for c, r in enumerate(row_of.tolist()) if r >= 0)


def total_cost(cost, pairs: list[tuple[int, int]]) -> float:
    return float(sum(np.asarray(cost, dtype=float)[r, c] for r, c in pairs))
