"""Pairwise slopes of points that stand in few columns of equal ``x`` (years): counts, the median, the signed-rank test.

Inside two columns sorted by ``y`` the slopes up to a threshold are, for every point of the first, a prefix of the second.
One threshold is so counted in O(n log n) per pair of columns, without listing pairs. Slopes are compared as the doubles
``(y2 - y1) / (x2 - x1)``, as in the direct fit.

The test statistic is the number of pairs of a positive and a smaller negative slope (and a part that only depends on counts).
It is bounded from correlations of the columns' cell counts, whose work does not grow with the pairs. What they leave open adds up
over intervals of magnitudes, so intervals are tasks of their own. In an interval it is either bounded from counts at
rungs, or exact from the interval's slopes, a batch at a time.
"""

import math

import numpy as np

#: Slopes held at once for the median.
BATCH = 3_000_000
#: Slopes held at once for the test: few stay in a core's cache, but each lookup of a batch's ends should yield some.
SMALL_BATCH = 600_000
MOST_BATCH = 16_000_000
#: Sorted slopes gone through at once.
PIECE = 131_072
#: Thresholds times points looked up at once.
LOOKUPS = 65_536
SAMPLE = 200_000


def halfway(lo: float, hi: float) -> float:
    """A double between two doubles, in the order of their bit patterns; ``lo`` if there is none."""
    rank = lambda v: (lambda i: i if i >= 0 else -(i & 0x7FFFFFFFFFFFFFFF))(int(np.float64(v).view(np.int64)))
    m = (rank(lo) + rank(hi)) // 2
    return float(np.int64(abs(m)).view(np.float64)) * (1.0 if m >= 0 else -1.0)


class Columns:
    """Distinct finite points with weights, as columns of equal ``x``."""

    def __init__(self, x, y, w):
        order = np.lexsort((y, x))
        x, y, w = x[order], y[order], w[order].astype(float)
        xs, first = np.unique(x, return_index=True)
        self.single = bool((w == 1).all())
        self.y, self.w = np.split(y, first[1:]), np.split(w, first[1:])
        self.sums = [np.concatenate(([0.0], np.cumsum(v))) for v in self.w]
        self.above = [np.append(v, np.inf) for v in self.y]
        self.below = [np.insert(v, 0, -np.inf) for v in self.y]
        self.sides = [(a, b, xs[b] - xs[a]) for a in range(len(xs)) for b in range(a + 1, len(xs))]
        #: The largest weight of a slope is at most this.
        self.heavy = int(max(v.max() for v in self.w)) ** 2
        self.total = float(sum(self.sums[a][-1] * self.sums[b][-1] for a, b, _ in self.sides))
        self.pairs = sum(len(self.y[a]) * len(self.y[b]) for a, b, _ in self.sides)
        self.lookups = sum(len(self.y[a]) for a, _, _ in self.sides)

    def _reach(self, a: int, b: int, d: float, t: np.ndarray, strict: bool) -> np.ndarray:
        """Per threshold and point of column ``a``: points of ``b`` with a slope up to (below, if ``strict``) the threshold."""
        ya, yb = self.y[a], self.y[b]
        base = np.tile(ya, len(t))
        far, tt = np.repeat(t * d, len(ya)) + base, np.repeat(t, len(ya))
        at = np.searchsorted(yb, far, "left" if strict else "right")
        inside = np.less if strict else np.less_equal
        # The search rounds otherwise than the slopes do: step over the points it misplaced.
        while True:
            more = inside((self.above[b][at] - base) / d, tt)
            if not more.any():
                break
            at += more
        while True:
            less = ~inside((self.below[b][at] - base) / d, tt)
            if not less.any():
                return at.reshape(len(t), len(ya))
            at -= less

    def ends(self, t: float, strict: bool) -> list[np.ndarray]:
        if math.isinf(t):
            return [np.full(len(self.y[a]), len(self.y[b]) if t > 0 else 0) for a, b, _ in self.sides]
        return [self._reach(a, b, d, np.array([t]), strict)[0] for a, b, d in self.sides]

    def count(self, t: np.ndarray, strict: bool = False) -> np.ndarray:
        """Weighted number of slopes up to (below) each finite threshold."""
        out = np.zeros(len(t))
        for a, b, d in self.sides:
            step = max(1, LOOKUPS // len(self.y[a]))
            for i in range(0, len(t), step):
                at = self._reach(a, b, d, t[i:i + step], strict)
                out[i:i + step] += at.sum(axis=1) if self.single else self.sums[b][at] @ self.w[a]
        return out

    def listed(self, start: list[np.ndarray], end: list[np.ndarray]):
        """Slopes between two reaches, and their weights (None: all 1)."""
        n = sum(int((e - s).sum()) for s, e in zip(start, end))
        s, ww = np.empty(n), None if self.single else np.empty(n)
        self.list_into(start, end, s, ww, Scratch())
        return s, ww

    def list_into(self, start: list[np.ndarray], end: list[np.ndarray], s: np.ndarray, ww: np.ndarray | None, scratch: "Scratch") -> None:
        done = 0
        for (a, b, d), lo, hi in zip(self.sides, start, end):
            n = hi - lo
            size = int(n.sum())
            j = np.repeat(lo - (np.cumsum(n) - n), n)
            j += scratch.positions(size)
            here = slice(done, done + size)
            np.take(self.y[b], j, out=s[here], mode="clip")
            s[here] -= np.repeat(self.y[a], n)
            s[here] /= d
            if ww is not None:
                np.take(self.w[b], j, out=ww[here], mode="clip")
                ww[here] *= np.repeat(self.w[a], n)
            done += size

    def sample(self, most: int = SAMPLE) -> np.ndarray:
        """Sorted slopes of pairs drawn evenly from all pairs of distinct points, the same in every run."""
        rng = np.random.default_rng(7)
        share = [most * len(self.y[a]) * len(self.y[b]) / self.pairs for a, b, _ in self.sides]
        draw = lambda c, n: self.y[c][rng.integers(0, len(self.y[c]), n)]
        return np.sort(np.concatenate([(draw(b, math.ceil(n)) - draw(a, math.ceil(n))) / d for (a, b, d), n in zip(self.sides, share)]))


class Scratch:
    """Arrays that batches use in turn: fetching new memory for each of them costs more time than the work in it."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def get(self, name: str, size: int, kind=float) -> np.ndarray:
        if name not in self.kept or len(self.kept[name]) < size:
            self.kept[name] = np.empty(size + size // 4, kind)
        return self.kept[name][:size]

    def positions(self, size: int) -> np.ndarray:
        if "positions" not in self.kept or len(self.kept["positions"]) < size:
            self.kept["positions"] = np.arange(size + size // 4)
        return self.kept["positions"][:size]


# --- the median -------------------------------------------------------------------------------------

def median(cols: Columns, batch: int | None = None) -> float:
    """Midpoint of the two central slopes."""
    batch = batch or min(BATCH, max(100_000, cols.pairs // 20))
    drawn, memo = cols.sample(), {}
    values = [_nth(cols, k, drawn, batch, memo) for k in ((cols.total + 1) // 2, cols.total // 2 + 1)]
    return values[0] + (values[1] - values[0]) / 2


def _nth(cols: Columns, k: float, drawn: np.ndarray, batch: int, memo: dict) -> float:
    """The ``k``-th smallest slope. ``memo`` keeps what was counted or listed for an earlier ``k``."""
    known = memo.setdefault("counts", {-math.inf: 0.0, math.inf: cols.total})
    while True:
        lo = max(t for t, n in known.items() if n < k)
        hi = min(t for t, n in known.items() if n >= k)
        at_lo, at_hi = cols.ends(lo, False), cols.ends(hi, False)
        if sum(int((e - s).sum()) for s, e in zip(at_lo, at_hi)) <= batch:
            if memo.get("at") != (lo, hi):
                s, w = cols.listed(at_lo, at_hi)
                order = np.argsort(s, kind="stable")
                memo["at"], memo["s"] = (lo, hi), s[order]
                memo["cum"] = np.arange(1, len(s) + 1) if w is None else np.cumsum(w[order])
            return float(memo["s"][np.searchsorted(memo["cum"], k - known[lo])])
        if math.isfinite(lo) and math.isfinite(hi) and np.nextafter(lo, hi) >= hi:
            return hi
        inside = drawn[np.searchsorted(drawn, lo, "right"):np.searchsorted(drawn, hi, "left")]
        aim = (k - known[lo]) / (known[hi] - known[lo])
        if len(inside) >= 100:
            near = 3 / math.sqrt(len(inside))
            at = np.clip(np.array([aim - near, aim, aim + near]), 0, 1) * (len(inside) - 1)
            ts = inside[np.rint(at).astype(int)]
        else:
            ts = np.array([halfway(lo, hi)])
            if math.isfinite(lo) and math.isfinite(hi):
                ts = np.append(ts, lo + (hi - lo) * np.clip([aim - 0.02, aim, aim + 0.02], 0, 1))
        ts = np.unique(ts[(ts > lo) & (ts < hi)])
        if not len(ts):
            ts = np.array([np.nextafter(lo, hi)])
        known.update(zip(ts.tolist(), cols.count(ts).tolist()))


# --- the test statistic -----------------------------------------------------------------------------

def _sides(cols: Columns, t: float):
    """Reaches of a magnitude: slopes up to ``t``, and slopes below ``-t``."""
    return cols.ends(t, False), cols.ends(-t, True)


def bounded(cols: Columns, rungs: np.ndarray):
    """``up, down, cross, room, ties, loose`` of the magnitudes in ``(rungs[0], rungs[-1]]``, from counts at the rungs.

    ``cross`` counts positive slopes above smaller negative ones, equal ones half, and is short by at most ``room``; the sum of
    ``size^3 - size`` over tied magnitudes is ``ties`` or up to ``loose`` more.
    """
    inner = rungs[np.isfinite(rungs)]
    le, lt = cols.count(inner), cols.count(-inner, strict=True)
    if len(inner) < len(rungs):
        le, lt = np.append(le, cols.total), np.append(lt, 0.0)
    up, down = np.diff(le), -np.diff(lt)
    both = up + down
    return (
        float(up.sum()), float(down.sum()), float((up * (np.cumsum(down) - down)).sum()), float((up * down).sum()),
        0.0, float((both**3 - both).clip(min=0).sum()),
    )


def _steps(cols: Columns, cells: int) -> dict[float, tuple[int, list]]:
    """Per distance of ``x``: the cells that ``y`` takes there, and the pairs of columns at it."""
    near, by = min(d for _, _, d in cols.sides), {}
    for a, b, d in cols.sides:
        by.setdefault(d, []).append((a, b))
    return {d: (math.ceil(cells * near / d) + 1, ab) for d, ab in by.items()}


def _length(cells: int) -> int:
    """Numbers in a transform, at least twice the cells, of small factors."""
    unit = 1 << max(0, (2 * cells).bit_length() - 4)
    return -(-2 * cells // unit) * unit


def blur_work(cols: Columns, cells: int) -> float:
    """Work of ``blurred``, in lookups."""
    return 2.0 * cols.lookups + sum(2.0 * _length(m) * (len(ab) + 1) for m, ab in _steps(cols, cells).values())


def blurred(cols: Columns, cells: int):
    """The same over all magnitudes, from slopes known to within two of ``cells``; None where rounding might reach a count.

    Columns at distance ``d`` of ``x`` are counted into cells of ``y`` that are ``d`` times as wide as a cell of slopes. How many
    pairs are ``k`` cells apart is a correlation of these counts, and their slopes lie between ``k - 1`` and ``k + 1`` cells.
    """
    low, near = min(float(y[0]) for y in cols.y), min(d for _, _, d in cols.sides)
    width = (max(float(y[-1]) for y in cols.y) - low) / near / cells
    if not 0 < width < math.inf:
        return None
    up, down, zero = np.zeros(cells + 4), np.zeros(cells + 4), np.zeros(1)
    for d, (m, ab) in _steps(cols, cells).items():
        size, seen, norm = _length(m), {}, {}
        spectrum = pos = neg = room = 0.0
        for a, b in ab:
            for c in (a, b):
                if c not in seen:
                    n = np.bincount(((cols.y[c] - low) / (width * d)).astype(np.int64), weights=cols.w[c], minlength=m)
                    seen[c], norm[c] = np.fft.rfft(n, size), math.sqrt(float(n @ n))
            spectrum = spectrum + np.conj(seen[a]) * seen[b]
            room += norm[a] * norm[b]
            le, lt = (float(cols.sums[b][cols._reach(a, b, d, zero, strict)[0]] @ cols.w[a]) for strict in (False, True))
            pos, neg = pos + float(cols.sums[a][-1] * cols.sums[b][-1]) - le, neg + lt
            while len(seen) > 4:
                seen.pop(next(iter(seen)))
        if room * size.bit_length() * 2.0**-48 > 0.25:
            return None
        apart = np.rint(np.fft.irfft(spectrum, size))
        rises, falls = apart[2:m], apart[:-m:-1][1:]
        up[2:m] += rises
        down[2:m] += falls
        # Of the pairs up to one cell apart only the number of each sign is known.
        up[1] += pos - rises.sum()
        down[1] += neg - falls.sum()
    # Slopes at least three cells apart are in order, those more than two cells the other way are not. Rounding moves none by half a cell.
    below = np.concatenate(([0.0] * 3, np.cumsum(down)))
    sure = float((up * below[:len(up)]).sum())
    most = float((up * np.append(below[5:], [below[-1]] * 2)).sum())
    both = np.concatenate(([0.0], up + down, [0.0] * 2))
    tied = both[:-3] + both[1:-2] + both[2:-1] + both[3:]
    return float(up.sum()), float(down.sum()), sure, most - sure, 0.0, float((tied**3 - tied).clip(min=0).sum())


def exact(cols: Columns, lo: float, hi: float, guide: np.ndarray, batch: int | None = None):
    """The same for the magnitudes in ``(lo, hi]``, with nothing left open. ``guide`` are sorted sampled magnitudes."""
    batch = batch or min(MOST_BATCH, max(SMALL_BATCH, 20 * cols.lookups))
    inside = guide[(guide > lo) & (guide < hi)]
    step = max(1, int(len(guide) * batch * 0.7 / cols.pairs))
    todo = [hi, *np.unique(inside[step::step])[::-1].tolist()]
    up = down = cross = ties = 0.0
    at, scratch = _sides(cols, lo), Scratch()
    while todo:
        t = todo[-1]
        to = _sides(cols, t)
        size = sum(int((e - s).sum()) for s, e in zip((*at[0], *to[1]), (*to[0], *at[1])))
        most = batch if _room(cols, lo, t) else min(batch, SMALL_BATCH)
        if size > most and not np.nextafter(lo, math.inf) >= t:
            below = guide[(guide > lo) & (guide < t)]
            cut = float(below[len(below) // 2]) if len(below) else halfway(lo, t)
            todo.append(cut if lo < cut < t else float(np.nextafter(lo, math.inf)))
            continue
        todo.pop()
        if size > most:  # one magnitude
            u, d = (sum(float((cols.sums[b][e] - cols.sums[b][s]) @ cols.w[a]) for (a, b, _), s, e in zip(cols.sides, *k)) for k in ((at[0], to[0]), (to[1], at[1])))
            c, same = u * d / 2, (u + d) ** 3 - (u + d)
        else:
            u, d, c, same = _crossed(cols, at, to, scratch)
        cross += c + u * down
        up, down, ties = up + u, down + d, ties + same
        lo, at = t, to
    return up, down, cross, 0.0, ties, 0.0


def _crossings(p, wp, q, wq):
    """Of positive slopes ``p`` and negative ones ``q``: the weights of both, positive slopes above smaller magnitudes (equal: half), and the ties."""
    mag, w = np.concatenate((q, p)), None if wp is None else np.concatenate((wq, wp))
    up, down = (float(len(p)), float(len(q))) if w is None else (float(wp.sum()), float(wq.sum()))
    if not len(mag):
        return up, down, 0.0, 0.0
    return up, down, *(_ranked(mag, len(q), Scratch()) if w is None else _ranked_weights(mag, w, len(q), Scratch()))


def _bits(magnitude: float) -> int:
    return int(np.float64(magnitude).view(np.uint64))


def _room(cols: Columns, lo: float, hi: float) -> bool:
    """Whether a key of 64 bits holds a magnitude between two, its sign and its weight."""
    return cols.single or (_bits(hi) - _bits(lo)).bit_length() + 1 + cols.heavy.bit_length() <= 64


def _crossed(cols: Columns, at: tuple, to: tuple, scratch: Scratch):
    """``up, down``, positive slopes above smaller magnitudes of negative ones (equal: half) and the ties, of the slopes between two magnitudes."""
    n_up, n_down = (sum(int((e - s).sum()) for s, e in zip(*k)) for k in ((at[0], to[0]), (to[1], at[1])))
    n = n_up + n_down
    if n == 0:
        return 0.0, 0.0, 0.0, 0.0
    mag, w = scratch.get("mag", n), None if cols.single else scratch.get("weight", n)
    cols.list_into(to[1], at[1], mag[:n_down], None if w is None else w[:n_down], scratch)
    cols.list_into(at[0], to[0], mag[n_down:], None if w is None else w[n_down:], scratch)
    if w is None:
        return float(n_up), float(n_down), *_ranked(mag, n_down, scratch)
    np.abs(mag, out=mag)
    low, high = float(mag.min()), float(mag.max())
    ranked = _ranked_packed(mag, w, n_down, low, cols.heavy.bit_length(), scratch) if _room(cols, low, high) else _ranked_weights(mag, w, n_down, scratch)
    return float(w[n_down:].sum()), float(w[:n_down].sum()), *ranked


def _ranked(mag, n_down: int, scratch: Scratch):
    # Bits of a double rise with its magnitude; the sign is shifted out, and the last bit of the key tells the sides apart.
    key, one = mag.view(np.uint64), np.uint64(1)
    key <<= one
    key[n_down:] += one
    key.sort()
    return _gone_through(key, 0, scratch)


def _ranked_packed(mag, w, n_down: int, low: float, width: int, scratch: Scratch):
    """Magnitudes above the least one, the side and the weight, of ``width`` bits, in one key."""
    key = mag.view(np.uint64)
    key -= np.uint64(_bits(low))
    key <<= np.uint64(width + 1)
    key[n_down:] += np.uint64(1 << width)
    for i in range(0, len(key), PIECE):
        key[i:i + PIECE] += w[i:i + PIECE].astype(np.uint64)
    key.sort()
    return _gone_through(key, width, scratch)


def _gone_through(key, width: int, scratch: Scratch):
    """``cross`` and ``ties`` of sorted keys: a magnitude, a bit for positive slopes, and ``width`` bits of weight (0: all 1)."""
    n, cross, ties, minus, start = len(key), 0.0, 0.0, 0.0, 0
    shift, one, mask = np.uint64(width + 1), np.uint64(1), np.uint64((1 << width) - 1)
    while start < n:
        end = min(n, start + PIECE)
        if end < n:  # equal magnitudes stay together
            end = int(np.searchsorted(key, (((key[end - 1] >> shift) + one) << shift) - one, "right"))
        k, m, start = key[start:end], end - start, end
        apart = np.bitwise_xor(k[1:], k[:-1], out=scratch.get("apart", m - 1, np.uint64))
        same = np.flatnonzero(np.less(apart, one << shift, out=scratch.get("same", m - 1, bool)))
        if width:
            each = np.bitwise_and(k, mask, out=scratch.get("low", m, np.uint64)).astype(float)
            side = np.right_shift(k, np.uint64(width), out=scratch.get("low", m, np.uint64))
            side &= one
            above = np.multiply(each, side, out=scratch.get("plus", m))
            below = np.subtract(each, above, out=scratch.get("minus", m))
            up, down = float(above.sum()), float(below.sum())
            cross += minus * up + float(above @ np.cumsum(below, out=below))
            cubes = np.multiply(each, each, out=below)
            ties += float(cubes @ each) - up - down
        else:
            above = np.bitwise_and(k, one, out=scratch.get("low", m, np.uint64)).view(np.int64)
            up = int(above.sum())
            down = m - up
            cross += minus * up + int(above @ scratch.positions(m)) - up * (up - 1) // 2
        minus += down
        if len(same):
            # Of equal magnitudes the negative ones come first; half of their pairs with positive ones are taken back.
            at, first, size = _runs(same)
            if width:
                size = np.add.reduceat(each[at], first)
                ties -= float(np.take(cubes, at) @ each[at])
            plus = np.add.reduceat(above[at], first).astype(float)
            cross -= float((plus * (size - plus)).sum()) / 2
            ties += float((size**3).sum()) - (0.0 if width else float(size.sum()))
    return cross, ties


def _runs(same):
    """Runs of positions, each of ``same`` being equal to the next position: all positions, where a run begins among them, and its length."""
    new = np.flatnonzero(np.diff(same) > 1) + 1
    start, end = same[np.concatenate(([0], new))], same[np.concatenate((new - 1, [len(same) - 1]))] + 2
    first = np.cumsum(end - start) - (end - start)
    return np.arange(int((end - start).sum())) + np.repeat(start - first, end - start), first, (end - start).astype(float)


def _ranked_weights(mag, w, n_down: int, scratch: Scratch):
    """With weights, magnitudes are sorted with their positions in one key, which keeps their highest bits that fit beside."""
    n = len(mag)
    np.abs(mag, out=mag)
    bits, total, cubes = mag.view(np.uint64), float(w.sum()), np.multiply(w, w, out=scratch.get("cubes", n))
    ties = float(cubes @ w) - total
    low, room = bits.min(), np.uint64(n.bit_length())
    cut = np.uint64(max(0, int(bits.max() - low).bit_length() + int(room) - 64))
    key = np.subtract(bits, low, out=scratch.get("key", n, np.uint64))
    key >>= cut
    key <<= room
    key += scratch.positions(n).view(np.uint64)
    key.sort()
    order = np.bitwise_and(key, (np.uint64(1) << room) - np.uint64(1), out=scratch.get("order", n, np.uint64)).view(np.int64)
    key >>= room
    same = np.flatnonzero(np.equal(key[1:], key[:-1], out=scratch.get("same", n - 1, bool)))
    if cut and len(same):
        # Magnitudes that differ in lower bits only: put in order in their own places, equal ones as they stood.
        at = _runs(same)[0]
        order[at] = order[at][np.argsort(mag[order[at]], kind="stable")]
        at = at[:-1][np.diff(at) == 1]
        same = at[mag[order[at]] == mag[order[at + 1]]]
    sorted_, plus = np.take(w, order, out=scratch.get("sorted", n), mode="clip"), scratch.get("plus", n)
    np.multiply(sorted_, np.greater_equal(order, n_down, out=scratch.get("side", n, bool)), out=plus)
    minus = np.subtract(sorted_, plus, out=scratch.get("minus", n))
    cross = float(plus @ np.cumsum(minus, out=minus))
    if len(same):
        # Of equal magnitudes the negative ones come first; half of their pairs with positive ones are taken back.
        at, first, _ = _runs(same)
        each = sorted_[at]
        size, above = np.add.reduceat(each, first), np.add.reduceat(plus[at], first)
        cross -= float((above * (size - above)).sum()) / 2
        ties += float((size**3 - np.add.reduceat(each * each * each, first)).sum())
    return cross, ties


def joined(parts) -> tuple:
    """Neighbouring intervals, in order, as one."""
    up = down = cross = room = ties = loose = 0.0
    for u, d, c, r, t, o in parts:
        cross += c + u * down
        up, down, room, ties, loose = up + u, down + d, room + r, ties + t, loose + o
    return up, down, cross, room, ties, loose
