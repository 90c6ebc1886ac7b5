"""Boosted and bagged histogram trees, fitted inside tasks (K3, K4).

A fit is a task of its own: Spark deals the training rows into shards of bounded size,
and every (parameters, fold, shard) is fitted where it lies, so hundreds of fits of a
search run side by side in one job. The trees of a fit's shards form a committee whose
mean is the prediction; a model is a table with a row for each member.
"""

from __future__ import annotations

import numpy as np

#: Bins of a numeric column; a category has one for each level.
BINS = 64
#: Added to the sum of second derivatives of a leaf, in units of a row.
SHRINK = 1.0
#: Columns are summed together while they have so many cells in common at most.
CELLS = 512
#: Rows that are led to their leaves together, and levels of a tree that masks decide (a bit for each of 2^5 nodes).
ROWS_AT_ONCE, MASKED = 256, 5


class Binning:
    """Numeric columns by quantile edges, categories by the order of their mean label in the training rows."""

    def __init__(self, edges: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.edges, self.ranks = edges, ranks

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, n_numeric: int) -> Binning:
        share = np.linspace(0, 1, BINS + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, j], share, method="lower")) for j in range(n_numeric)]
        ranks = []
        for j in range(n_numeric, x.shape[1]):
            level = x[:, j].astype("i4")
            n = np.bincount(level)
            mean = np.divide(np.bincount(level, y), n, out=np.full(len(n), y.mean()), where=n > 0)
            ranks.append(np.argsort(np.argsort(mean, kind="stable"), kind="stable").astype("i4"))
        return cls(edges, ranks)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, "i4")
        for j, e in enumerate(self.edges):
            out[:, j] = np.searchsorted(e, x[:, j], side="left")  # bin k holds values up to edge k
        for j, r in enumerate(self.ranks, len(self.edges)):
            level = x[:, j].astype("i4")
            known = (level >= 0) & (level < len(r))
            out[:, j] = np.where(known, r[np.where(known, level, 0)] if len(r) else 0, 0)
        return out


def joined(bins: np.ndarray, most: int) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """Columns put together while their values in common are few: (columns, cell of each row, bins of each cell).

    ``bins`` has a row for each column. Columns that hang together (a region's and a
    year's figures) have hardly more cells together than one has bins, so the rows are
    gone through once for all of them.
    """
    out: list[tuple[list[int], np.ndarray, np.ndarray]] = []
    for j in np.argsort(bins.max(axis=1, initial=0), kind="stable"):
        width = int(bins[j].max(initial=0)) + 1
        for k, (columns, cell, values) in enumerate(out):
            size = values.shape[1] * width
            if size > 1 << 16:
                continue
            both = cell * width + bins[j]
            seen = np.flatnonzero(np.bincount(both, minlength=size))
            if len(seen) > max(most, values.shape[1]):
                continue
            number = np.zeros(size, "i8")
            number[seen] = np.arange(len(seen))
            out[k] = ([*columns, int(j)], number[both], np.vstack([values[:, seen // width], seen % width]))
            break
        else:
            seen = np.arange(width)
            out.append(([int(j)], bins[j].astype("i8"), seen[None]))
    return out


class Splits:
    """Every split of every column, and how its sums come from those of the cells of :func:`joined`."""

    def __init__(self, bins: np.ndarray) -> None:
        self.bins, self.parts, columns, cuts = bins, [], [], []
        for held, cell, values in joined(bins, CELLS):
            pick, ends, before = [], [], []
            for c, v in zip(held, values, strict=True):
                order = np.argsort(v, kind="stable")
                last = np.flatnonzero(np.diff(v[order], append=-1))  # the last cell of each bin
                before.append(np.full(len(last), len(v) * len(pick)))
                ends.append(before[-1] + last + 1)
                columns.append(np.full(len(last), c))
                cuts.append(v[order][last])
                pick.append(order)
            self.parts.append((cell, values.shape[1], *map(np.concatenate, (pick, ends, before))))
        column, cut = np.concatenate(columns), np.concatenate(cuts)
        self.order = np.lexsort((cut, column))
        self.column, self.cut = column[self.order], cut[self.order]

    def sums(self, cells: list[np.ndarray], place: np.ndarray, count: int, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """For each of ``count`` nodes: the sum of all, and those to the left of every split."""
        out, total = [], None
        for cell, (_, size, pick, ends, before) in zip(cells, self.parts, strict=True):
            flat = place * size
            flat += cell
            held = np.bincount(flat, weights, count * size).reshape(count, size)
            total = held.sum(axis=1) if total is None else total
            upto = np.zeros((count, len(pick) + 1))
            np.cumsum(held.take(pick, axis=1), axis=1, out=upto[:, 1:])
            out.append(upto.take(ends, axis=1) - upto.take(before, axis=1))
        return total, np.concatenate(out, axis=1).take(self.order, axis=1)


def siblings(whole: tuple[np.ndarray, np.ndarray], part: tuple[np.ndarray, np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of both children of each node, of which ``part`` holds those of the one on ``side``: the other's are what is left of ``whole``."""
    out, node = [], 2 * np.arange(len(side))
    for w, p in zip(whole, part, strict=True):
        both = np.empty((2 * len(w), *w.shape[1:]))
        both[node + side], both[node + 1 - side] = p, w - p
        out.append(both)
    return out[0], out[1]


def grow(splits: Splits, rows: np.ndarray | None, g: np.ndarray, h: np.ndarray | None, depth: int, min_rows: float, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree, level by level: (split column or -1, split bin, value of each node, each row's leaf).

    ``rows`` are those that take part (None: all), ``used`` tells of each column whether
    it does. A node is split where the gain of the sums of ``g`` over ``h`` (None: all
    one) is largest; of those that differ by rounding alone, in the first column and bin.
    Below the root only the rows of the lighter of two siblings are summed.
    """
    n, width = len(g), splits.bins.shape[1]
    nodes = (1 << depth + 1) - 1
    column, cut, value = np.full(nodes, -1, "i2"), np.zeros(nodes, "i2"), np.zeros(nodes)
    at = np.zeros(n, "i8")
    value[0] = g.sum() / ((n if h is None else h.sum()) + SHRINK)
    cells = [cell if rows is None else cell[rows] for cell, *_ in splits.parts]
    flat, row = splits.bins.ravel(), np.arange(n) if rows is None else rows
    open_ = used[splits.column]
    sums = lighter = None
    for level in range(depth):
        first, count = (1 << level) - 1, 1 << level
        place, every = at - first, np.arange(count)
        if sums is None:
            sums = [splits.sums(cells, place, count, w) for w in (g, h)]
        else:
            some = np.flatnonzero((place & 1) == lighter[place >> 1])
            held, above = [cell.take(some) for cell in cells], place.take(some) >> 1
            sums = [siblings(whole, splits.sums(held, above, count >> 1, None if w is None else w.take(some)), lighter) for w, whole in zip((g, h), sums, strict=True)]
        (total_g, left_g), (total_h, left_h) = sums
        right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
        gain = left_g**2 / (left_h + SHRINK) + right_g**2 / (right_h + SHRINK) - (total_g**2 / (total_h + SHRINK))[:, None]
        gain[(left_h < min_rows) | (right_h < min_rows) | ~open_] = 0.0
        most = gain.max(axis=1)
        best = (gain >= (most - 1e-9 * (1 + most))[:, None]).argmax(axis=1)
        split = most > 1e-9
        if not split.any():
            break
        j, b, parent = splits.column[best], splits.cut[best], first + every
        column[parent[split]], cut[parent[split]] = j[split], b[split]
        left = (left_g[every, best], left_h[every, best])
        for side, (sg, sh) in enumerate((left, (total_g - left[0], total_h - left[1]))):
            child = 2 * parent + 1 + side
            value[child] = np.where(split, sg / (sh + SHRINK), value[parent])
        lighter = np.where(split, 2 * left[1] > total_h, True).astype("i8")
        # an unsplit node hands its rows to its left child
        over = flat.take((j * width).take(place) + row, mode="clip") > np.where(split, b, np.iinfo("i4").max).take(place)
        at = 2 * at + 1 + over
    while at.size and at.max(initial=0) < (1 << depth) - 1:  # nodes of an ended tree go on to the lowest level
        at = 2 * at + 1
    for parent in range((1 << depth) - 1):
        if column[parent] < 0:
            value[2 * parent + 1] = value[parent]
    return column, cut, value, at


def fit_trees(x: np.ndarray, y: np.ndarray, n_numeric: int, *, kind: str, task: str, rounds: int, depth: int, rate: float = 0.05, subsample: float = 1.0, min_rows: float = 20.0, seed: int = 0) -> dict:
    """A boosted (``kind`` "boosted") or bagged ("forest") ensemble of ``rounds`` trees as packed arrays."""
    rng = np.random.default_rng(seed)
    binning = Binning.fit(x, y, n_numeric)
    n, f = x.shape
    bins = np.ascontiguousarray(binning(x).T)
    splits, every = Splits(bins), np.ones(f, bool)
    logistic = kind == "boosted" and task != "regression"
    start = float(y.mean())
    if logistic:
        p = min(max(start, 1e-6), 1 - 1e-6)
        start = float(np.log(p / (1 - p)))
    if kind == "forest":
        start, rate = 0.0, 1.0 / rounds
    now = np.full(n, start)
    trees = []
    mean = float(y.mean())
    for _ in range(rounds):
        used, kept = every, None
        if kind == "forest":
            weight = rng.poisson(subsample, n).astype("f8")
            used = np.zeros(f, bool)
            used[rng.choice(f, max(1, -(-f * 7 // 10)), replace=False)] = True
            kept = np.flatnonzero(weight)  # the others add nothing to any sum
            h = weight[kept]
            g = h * (y[kept] - mean)
        elif logistic:
            p = 1 / (1 + np.exp(-now))
            g, h = y - p, p * (1 - p)
        else:
            g, h = y - now, None
        if kind == "boosted" and subsample < 1:
            kept = np.flatnonzero(rng.random(n) < subsample)
            g, h = g[kept], None if h is None else h[kept]
        column, cut, value, leaf = grow(splits, kept, g, h, depth, min_rows * (0.1 if logistic else 1.0), used)
        if kind == "forest":
            value = value + mean
        trees.append((column, cut, value))
        if kind == "boosted":
            if kept is not None:
                leaf = leaves(column[None], cut[None], depth, bins, [])[:, 0]
            now += rate * value[leaf]
    column, cut, value = (np.stack(z) for z in zip(*trees, strict=True))
    return {
        "start": start, "rate": rate, "depth": depth, "logistic": logistic, "edges": [e.tolist() for e in binning.edges], "ranks": [r.tolist() for r in binning.ranks],
        "column": column.astype("<i2").tobytes(), "cut": cut.astype("<i2").tobytes(), "value": value.astype("<f8").tobytes(),
    }


class Scorer:
    """What a member's predictions need, made ready once."""

    def __init__(self, member: dict) -> None:
        self.binning = Binning([np.array(e) for e in member["edges"]], [np.array(r, "i4") for r in member["ranks"]])
        self.depth, self.start, self.rate, self.logistic = (member[k] for k in ("depth", "start", "rate", "logistic"))
        nodes = (1 << self.depth + 1) - 1
        self.column, self.cut = (np.frombuffer(member[c], "<i2").reshape(-1, nodes) for c in ("column", "cut"))
        self.value = np.frombuffer(member["value"], "<f8")
        self.masks = _masks(self.column, self.cut, min(self.depth, MASKED))
        self.offset = (np.arange(len(self.column)) * nodes)[None]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A value, or the positive class's probability, of each row."""
        out = np.empty(len(x))
        for lo in range(0, len(x), 1 << 16):
            bins = np.ascontiguousarray(self.binning(x[lo : lo + (1 << 16)]).T)
            tables = []
            for columns, cell, values in joined(bins, CELLS):
                reach = [self.masks[c].take(np.minimum(v, self.masks.shape[1] - 1), axis=0) for c, v in zip(columns, values, strict=True) if c < len(self.masks)]
                if reach:
                    tables.append((cell, np.bitwise_and.reduce(reach)))
            for begin in range(0, bins.shape[1], ROWS_AT_ONCE):
                part = slice(begin, begin + ROWS_AT_ONCE)
                at = leaves(self.column, self.cut, self.depth, bins[:, part], [(cell[part], table) for cell, table in tables])
                at += self.offset
                out[lo + begin : lo + begin + len(at)] = self.start + self.rate * self.value.take(at, mode="clip").sum(axis=1)
        return 1 / (1 + np.exp(-out)) if self.logistic else out


def predict_trees(member: dict, x: np.ndarray) -> np.ndarray:
    """The member's prediction: a value, or the positive class's probability."""
    return Scorer(member)(x)


def _masks(column: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """For each column a table (bin, tree) of which nodes below the first ``levels`` a row of that bin may still reach; the least such is where it goes.

    A node that sends rows to the right takes all places under its left child from them.
    """
    widest = int(cut.max(initial=0)) + 2
    out = np.full((int(column.max(initial=0)) + 1, widest, len(column)), (1 << 32) - 1, "u4")
    tree, bins = np.arange(len(column)), np.arange(widest)
    for node in range((1 << levels) - 1):
        level = (node + 1).bit_length() - 1
        under = 1 << levels - level - 1
        left = ((1 << under) - 1) << (2 * under * (node + 1 - (1 << level)))
        some = tree[column[:, node] >= 0]
        c = column[some, node].astype("i8")
        out[c, :, some] &= np.where(bins > cut[some, node][:, None], np.uint32(~left & ((1 << 32) - 1)), np.uint32((1 << 32) - 1))
    return out


def leaves(column: np.ndarray, cut: np.ndarray, depth: int, bins: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each row (a column of ``bins``) in each tree (a row of ``column`` and ``cut``).

    ``tables`` (cell of each row, mask of each cell and tree) decide the first levels;
    from there, or without them from the root, rows are led down.
    """
    nodes, n = column.shape[1], bins.shape[1]
    base = np.arange(len(column)) * nodes
    done = min(depth, MASKED) if tables else 0
    if tables:
        open_ = tables[0][1].take(tables[0][0], axis=0)
        for cell, table in tables[1:]:
            open_ &= table.take(cell, axis=0)
        open_ &= ~open_ + np.uint32(1)  # the lowest bit, whose exponent is the place
        at = (open_.astype("f4").view("i4") >> 23).astype("i8")
        at += (1 << done) - 1 - 127
    else:
        at = np.zeros((n, len(column)), "i8")
    if done < depth:
        # a node that isn't split sends all rows to its left child
        begin = np.where(column < 0, 0, column).astype("i8").ravel() * n
        limit = np.where(column < 0, np.iinfo("i4").max, cut.astype("i8")).astype("i4").ravel()
        flat, row = np.ascontiguousarray(bins).ravel(), np.arange(n)[:, None]
        for _ in range(done, depth):
            at += base
            over = flat.take(begin.take(at, mode="clip") + row, mode="clip") > limit.take(at, mode="clip")
            at -= base
            at *= 2
            at += 1
            at += over
    return at
