"""Exact nearest rows of arrays, and the regions into which tables are divided for it."""

from __future__ import annotations

import numpy as np

#: Rows of a block, within which all pairs are compared.
BLOCK = 256


def regions(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Places of rows, divided at the middle of the widest column until a part has at most ``most`` rows or equal ones only."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) > most:
            part = x[at]
            spread = part.var(0)
            col = part[:, int(spread.argmax())]
            low = col < _middle(col)
            if low.any() and not low.all():
                todo += [at[~low], at[low]]
                continue
        out.append(at)
    return out


def _middle(col: np.ndarray) -> float:
    """The median; the next greater value where no value is less than it."""
    cut = np.partition(col, len(col) // 2)[len(col) // 2]
    if not (col < cut).any() and (col > cut).any():
        cut = col[col > cut].min()
    return cut


def fit_tree(x: np.ndarray, most: int) -> list[tuple[int, float, int, int]]:
    """Splits ``(column, cut, low, high)`` of rows into regions of at most ``most``; a negative child ``-1 - i`` is region i, numbered
    from left to right. Node 0 is the root; without a split all rows are region 0."""
    nodes: list[tuple[int, float, int, int]] = []
    leaves = 0

    def grow(at: np.ndarray) -> int:
        nonlocal leaves
        if len(at) > most:
            part = x[at]
            c = int(part.var(0).argmax())
            cut = float(_middle(part[:, c]))
            low = part[:, c] < cut
            if low.any() and not low.all():
                me = len(nodes)
                nodes.append((c, cut, 0, 0))
                left, right = grow(at[low]), grow(at[~low])
                nodes[me] = (c, cut, left, right)
                return me
        leaves += 1
        return -leaves

    grow(np.arange(len(x)))
    return nodes


def place(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    """The region of every row."""
    out = np.zeros(len(x), np.int32)
    todo = [(0, np.arange(len(x)))] if nodes else []
    while todo:
        node, at = todo.pop()
        if node < 0:
            out[at] = -1 - node
        elif len(at):
            c, cut, left, right = nodes[node]
            low = x[at, c] < cut
            todo += [(left, at[low]), (right, at[~low])]
    return out


def gaps(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distances of rows to boxes, a row of the result per row."""
    out = np.zeros((len(x), len(lo)))
    for i in range(x.shape[1]):
        g = np.maximum(np.maximum(lo[None, :, i] - x[:, i, None], x[:, i, None] - hi[None, :, i]), 0)
        out += g * g
    return out


def _same(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct row, and the number of every row's."""
    x = np.ascontiguousarray(x + 0.0)  # -0 is 0
    _, first, code = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0], return_index=True, return_inverse=True)
    return first, code


def nearest(q: np.ndarray, c: np.ndarray, k: int, ids: tuple[np.ndarray, np.ndarray] | None = None, bound: np.ndarray | None = None, cosine: bool = False, digits: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row of q, row of c, distance)``: the ``k`` nearest rows of ``c`` to each row of ``q``, distances rounded, ties to the first row.

    ``ids``: numbers of the rows of ``q`` and of ``c``; rows of one number are no neighbours. ``bound``: rounded distances beyond
    which nothing is sought. ``cosine``: rows have length 1, the distance is one less their product. Exact: single precision
    and boxes around blocks only leave out what is farther away than ``k`` others for sure. Equal rows are compared once.
    """
    none = np.zeros(0, np.int64)
    if not len(q) or not len(c):
        return none, none, np.zeros(0)
    most = k + (int(np.unique(ids[1], return_counts=True)[1].max()) if ids else 0)  # those of a row's own number are dropped at the end
    # of equal rows only the first can be among the nearest
    first, code = _same(c)
    order = np.argsort(code, kind="stable")
    sorted_code = code[order]
    start = np.searchsorted(sorted_code, np.arange(len(first)))
    times = np.minimum(np.bincount(code), most)
    asked, which = _same(q)
    reach = np.full(len(asked), np.inf)
    if bound is not None:
        reach = np.full(len(asked), -np.inf)
        np.maximum.at(reach, which, bound)
    dist = (lambda d2: np.round(d2 / 2, digits)) if cosine else (lambda d2: np.round(np.sqrt(d2), digits))
    square = (lambda d: 2 * (d + 10.0**-digits)) if cosine else (lambda d: (d + 10.0**-digits) ** 2)

    shift = c.mean(0)
    cd, qd = c[first] - shift, q[asked] - shift
    cb, qb = regions(cd, BLOCK), regions(qd, BLOCK)
    cat = np.concatenate(cb)
    cd, first, start, times = cd[cat], first[cat], start[cat], times[cat]
    ends = np.concatenate([[0], np.cumsum([len(b) for b in cb])])
    lo, hi = np.minimum.reduceat(cd, ends[:-1], axis=0), np.maximum.reduceat(cd, ends[:-1], axis=0)
    c32 = np.hstack([cd, np.ones((len(cd), 1))]).astype(np.float32)
    c32[:, -1] = -(cd**2).sum(1) / 2
    c_norm = float((cd**2).sum(1).max())

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in qb:
        x = qd[rows]
        x_norm = (x**2).sum(1)
        slip = (x.shape[1] + 16) * 2.4e-7 * (x_norm.max() + c_norm)  # more than single precision can be wrong by
        x32 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
        # boxes nearest to the rows' own come first
        gap = (np.maximum(np.maximum(lo - x.max(0), x.min(0) - hi), 0) ** 2).sum(1)
        turn = np.argsort(gap, kind="stable")
        far = square(reach[rows]) + slip
        best = (none, none, np.zeros(0))
        at, width = 0, 4
        while at < len(turn) and gap[turn[at]] <= far.max():
            blocks = turn[at : at + width]
            at, width = at + width, min(2 * width, 64)
            blocks = blocks[gap[blocks] <= far.max()]
            cols = np.concatenate([np.arange(ends[b], ends[b + 1]) for b in blocks])
            near = x32 @ c32[cols].T  # half of |x|² less the squared distance
            cut = far
            if np.isinf(cut).any() and len(cols) > most:
                cut = np.minimum(cut, x_norm - 2 * np.partition(near, len(cols) - most, axis=1)[:, len(cols) - most] + 2 * slip)
            i, j = np.divmod(np.flatnonzero(near >= ((x_norm - cut - slip) / 2).astype(np.float32)[:, None]), len(cols))
            j = cols[j]
            d = dist(((x[i] - cd[j]) ** 2).sum(1))
            # equal rows of c, the first of them
            n = times[j]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, d, j = np.repeat(i, n), np.repeat(d, n), order[np.repeat(start[j], n) + step]
            i, j, d = (np.concatenate(p) for p in zip(best, (i, j, d), strict=True))
            s = np.lexsort((j, d, i))
            i, j, d = i[s], j[s], d[s]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            full = i[rank == most - 1]
            far[full] = np.minimum(far[full], square(d[rank == most - 1]) + slip)
            keep = rank < most
            best = i[keep], j[keep], d[keep]
        found.append((rows[best[0]], best[1], best[2]))
    u, j, d = (np.concatenate(p) for p in zip(*found, strict=True))
    # every row of q has the neighbours of its distinct row, without itself
    s = np.argsort(u, kind="stable")
    u, j, d = u[s], j[s], d[s]
    n = np.bincount(u, minlength=len(asked))
    begin = np.cumsum(n) - n
    m = n[which]
    row = np.repeat(np.arange(len(q)), m)
    e = np.repeat(begin[which], m) + np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    j, d = j[e], d[e]
    ok = ids[1][j] != ids[0][row] if ids else np.ones(len(row), bool)
    if bound is not None:
        ok &= d <= bound[row]
    row, j, d = row[ok], j[ok], d[ok]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], j[keep], d[keep]
