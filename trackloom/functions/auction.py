"""One-to-one matching of most weight over sparse pairs."""

from __future__ import annotations

from collections import deque


def match(rows, columns, weights) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matching of greatest total weight; some may stay alone. weights: positive whole numbers.

    An auction whose increments shrink to one. Rows and columns stand on both sides, each with a
    free pair to itself, so that all find a partner and every stage ends; with weights times one more
    than the number of bidders the last stage is exact. Memory is in proportion to the pairs.
    """
    row_names, column_names = sorted(set(rows)), sorted(set(columns))
    at_row, at_column = {r: i for i, r in enumerate(row_names)}, {c: i for i, c in enumerate(column_names)}
    n_rows, n_columns = len(row_names), len(column_names)
    n = n_rows + n_columns
    wants: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for r, c, w in zip(rows, columns, weights, strict=True):
        i, j = at_row[r], at_column[c]
        wants[i].append((j, int(w) * (n + 1)))
        wants[n_rows + j].append((n_columns + i, int(w) * (n + 1)))
    for i in range(n_rows):
        wants[i].append((n_columns + i, 0))
    for j in range(n_columns):
        wants[n_rows + j].append((j, 0))
    price, step = [0] * n, max(1, max((w for some in wants for _, w in some), default=0) // 4)
    while True:
        owner: list[int | None] = [None] * n
        waiting = deque(range(n))
        while waiting:
            p = waiting.popleft()
            first = second = None
            for o, w in wants[p]:
                v = w - price[o]
                if first is None or v > first[0]:
                    first, second = (v, o), first
                elif second is None or v > second[0]:
                    second = (v, o)
            o = first[1]
            price[o] += step + (first[0] - second[0] if second else 0)
            if owner[o] is not None:
                waiting.append(owner[o])
            owner[o] = p
        if step == 1:
            break
        step = max(1, step // 5)
    return [(row_names[p], column_names[o]) for o, p in enumerate(owner[:n_columns]) if p is not None and p < n_rows]
