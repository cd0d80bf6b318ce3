"""Sequence kernels for Python workers: edit distances, cheapest alignments and common subsequences, in bulk.

Alignments of many pairs run together, one anti-diagonal a step: its cells do not depend on each other, and each is
worked out from its three neighbours by the very sums of the plain recurrence. Only cells near the corners' diagonals are
looked at: a path that leaves them by e pays for 2 e more left-over words, so once a cheaper path is known they are all that
counts. Where such a band is too large to be held, all cells are worked out: of the costs only every ``BLOCK``-th pair of
diagonals is kept, and the moves between are worked out again on the way back.
"""

from __future__ import annotations

import numpy as np

#: Diagonals worked out again at once on the way back, and cells (pairs times longest sides) of one batch, which also
#: bound the moves that are kept without working them out again.
BLOCK = 128
BATCH_CELLS = 1 << 22
#: Cells of one batch of bands.
BAND_CELLS = 1 << 20
#: Pairs of words whose edit distances are worked out together, and entries of their table of letters.
WORD_PAIRS = 1 << 14
LETTERS = 1 << 22


def numbered(*lists: list[str]) -> list[np.ndarray]:
    """The lists with each different entry as one number."""
    number: dict[str, int] = {}
    return [np.array([number.setdefault(x, len(number)) for x in one], np.int64) for one in lists]


def edit_distances(left: list[str], right: list[str], pairs: np.ndarray) -> np.ndarray:
    """Levenshtein distances of ``left[a]`` and ``right[b]`` for rows (a, b), all pairs of a block at once."""
    codes = []
    for words in (left, right):
        width = max(map(len, words), default=0)
        table = np.zeros((len(words), width), np.uint32)
        for k, w in enumerate(words):
            table[k, : len(w)] = [ord(c) for c in w]
        codes.append((table, np.array([len(w) for w in words], np.int32)))
    (a, size_a), (b, size_b) = codes
    out = np.maximum(size_a[pairs[:, 0]], size_b[pairs[:, 1]])
    letters = np.unique(a)
    kinds = len(letters) + 1
    if a.shape[1] > 63 or len(left) * kinds > LETTERS:
        return _distances_by_rows(a, size_a, b, size_b, pairs)
    # Myers' bit-parallel form: a bit per letter of the left word, one step per letter of the right one
    found = np.minimum(np.searchsorted(letters, b), max(len(letters) - 1, 0))
    code = np.where(letters[found] == b, found, len(letters)) if len(letters) else np.zeros(b.shape, np.int64)
    code = np.ascontiguousarray(code.T)
    at = np.zeros((len(left), kinds), np.uint64)
    for k in range(a.shape[1]):
        rows = np.flatnonzero(size_a > k)
        at[rows, np.searchsorted(letters, a[rows, k])] |= np.uint64(1 << k)
    at = at.reshape(-1)
    order = np.argsort(size_b[pairs[:, 1]].astype(np.uint16), kind="stable") if b.shape[1] < 1 << 16 else np.argsort(size_b[pairs[:, 1]])
    one = np.uint64(1)
    for start in range(0, len(order), WORD_PAIRS):
        chosen = order[start : start + WORD_PAIRS]
        i, j = pairs[chosen, 0], pairs[chosen, 1]
        m, n = size_a[i], size_b[j]
        base, last = i * kinds, np.maximum(m - 1, 0).astype(np.uint64)
        up, down = np.full(len(chosen), ~np.uint64(0)), np.zeros(len(chosen), np.uint64)
        score = m.astype(np.int64)
        low = 0
        for k in range(int(n[-1])):
            while low < len(n) and n[low] <= k:  # words that have ended; pairs come by the right word's length
                low = int(np.searchsorted(n, k, side="right"))
            pv, mv = up[low:], down[low:]
            eq = at[base[low:] + code[k][j[low:]]]
            vertical = eq | mv
            across = (((eq & pv) + pv) ^ pv) | eq
            plus, minus = mv | ~(across | pv), pv & across
            score[low:] += ((plus >> last[low:]) & one).astype(np.int64) - ((minus >> last[low:]) & one).astype(np.int64)
            plus = (plus << one) | one
            up[low:], down[low:] = (minus << one) | ~(vertical | plus), plus & vertical
        out[chosen] = np.where(m == 0, n, score)
    return out


def _distances_by_rows(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The same by the plain recurrence, for long words or many letters."""
    out = np.zeros(len(pairs), np.int32)
    order = np.lexsort((size_b[pairs[:, 1]], size_a[pairs[:, 0]])) if len(pairs) else np.zeros(0, np.int64)
    for start in range(0, len(order), WORD_PAIRS):
        chosen = order[start : start + WORD_PAIRS]
        i, j = pairs[chosen, 0], pairs[chosen, 1]
        m, n = size_a[i], size_b[j]
        x, y = a[i], b[j]
        row = np.repeat(np.arange(int(n.max(initial=0)) + 1, dtype=np.int32)[:, None], len(chosen), axis=1)
        found = np.where(m == 0, n, 0)
        for k in range(int(m.max(initial=0))):
            before = row[0].copy()
            row[0] = k + 1
            for col in range(1, len(row)):
                best = np.minimum(np.minimum(row[col], row[col - 1]) + 1, before + (x[:, k] != y[:, col - 1]))
                before = row[col].copy()
                row[col] = best
            ends = np.flatnonzero(m == k + 1)
            if len(ends):
                found[ends] = row[n[ends], ends]
        out[chosen] = found
    return out


def alignments(pairs: list[tuple[list[str], list[str]]], gap: float = 0.72) -> list[list[tuple[int, int, float]]]:
    """For each pair of word lists the pairs (place, place, similarity) of their cheapest alignment.

    A word left over costs ``gap``, a pair of words one less their similarity, which is one less the edit distance over the longer
    word's length. Of equally cheap steps a pair is preferred, then a left-over word of the first list.
    """
    out: list[list[tuple[int, int, float]]] = [[] for _ in pairs]
    wide = {k: 2 + (len(a) + len(b)) // 64 for k, (a, b) in enumerate(pairs) if a and b}
    large: list[int] = []
    while wide:
        bands = {k: _band(*map(len, pairs[k]), w) for k, w in wide.items()}
        size = {k: (high - low + 1) // 2 for k, (low, high) in bands.items()}
        large += [k for k in wide if size[k] * sum(map(len, pairs[k])) > BAND_CELLS]
        todo = sorted(wide.keys() - set(large), key=lambda k: (size[k], sum(map(len, pairs[k]))))
        again = {}
        while todo:
            rows = steps = count = 0
            for k in todo:
                rows, steps = max(rows, size[k]), max(steps, sum(map(len, pairs[k])))
                if count and (count + 1) * rows * steps > BAND_CELLS:
                    break
                count += 1
            batch, todo = todo[:count], todo[count:]
            batch.sort(key=lambda k: -sum(map(len, pairs[k])))
            found, total = _align_bands([pairs[k] for k in batch], [bands[k] for k in batch], gap)
            for k, one, cost in zip(batch, found, total, strict=True):
                n, m = map(len, pairs[k])
                needed = int(((cost + 1e-6) / gap - abs(n - m)) / 2)
                if needed <= wide[k] or wide[k] >= max(n, m):
                    out[k] = one
                else:
                    again[k] = needed
        wide = again
    todo = sorted(large, key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    while todo:
        n = m = count = 0
        for k in todo:
            rows, cols = max(n, len(pairs[k][0])), max(m, len(pairs[k][1]))
            if count and (count + 1) * rows * cols > BATCH_CELLS:
                break
            n, m, count = rows, cols, count + 1
        batch, todo = todo[:count], todo[count:]
        for k, found in zip(batch, _align([pairs[k] for k in batch], gap), strict=True):
            out[k] = found
    return out


def _band(n: int, m: int, wide: int) -> tuple[int, int]:
    """First and last difference of places (i - j) of a band; the first is even, and so is their number."""
    low = max(min(0, n - m) - wide, -m)
    low -= low % 2
    high = min(max(0, n - m) + wide, n)
    return low, high + (high - low + 1) % 2


def _align_bands(batch: list[tuple[list[str], list[str]]], bands: list[tuple[int, int]], gap: float) -> tuple[list, np.ndarray]:
    """Alignments within bands, and their costs; pairs come by falling number of words.

    Row r of step d holds the cells whose i - j is 2 r (odd steps: 2 r + 1) above the band's first: their three neighbours
    are rows of the two steps before, and the words beside them slices of two shifted tables.
    """
    count = len(batch)
    n, m = (np.array([len(x[side]) for x in batch], np.int64) for side in (0, 1))
    low = np.array([b[0] for b in bands], np.int64)
    total = n + m
    steps, rows = int(total[0]), max((b[1] - b[0] + 1) // 2 for b in bands)
    number: tuple[dict, dict] = {}, {}
    ids = []
    for side, size in ((0, n), (1, m)):
        table = np.zeros((count, int(size.max())), np.int64)
        for k, x in enumerate(batch):
            table[k, : len(x[side])] = [number[side].setdefault(w, len(number[side])) for w in x[side]]
        ids.append(table)
    y, column = np.arange(steps // 2 + 1 + rows)[:, None], np.arange(count)
    first = ids[0][column, np.clip(y + low // 2 - 1, 0, n - 1)]
    second = ids[1][column, np.clip(y - low // 2 - rows, 0, m - 1)]
    active = np.searchsorted(-total, -np.arange(steps + 1), side="right")
    ends = np.concatenate(([0], np.cumsum(active * rows)))
    keys = np.empty(ends[-1], np.int64)
    for d in range(1, steps + 1):
        s, t, k = (d + 1) // 2, d // 2, active[d]
        np.add(first[s : s + rows, :k] * len(number[1]), second[t : t + rows, :k][::-1], out=keys[ends[d] : ends[d + 1]].reshape(rows, k))
    keys[: ends[1]] = keys[ends[1]]
    different, where = np.unique(keys, return_inverse=True)
    both = np.stack(np.divmod(different, len(number[1])), axis=1)
    size = [np.array([len(w) for w in side], np.int64) for side in number]
    near = 1 - edit_distances(list(number[0]), list(number[1]), both) / np.maximum(np.maximum(size[0][both[:, 0]], size[1][both[:, 1]]), 1)
    costs = (1 - near)[where]
    now = np.full((2 * rows + 2, count), np.inf)
    now[1 - low, column] = 0
    moves, cost = np.zeros(ends[-1], np.uint8), np.zeros(count)
    for d in range(1, steps + 1):
        p, k = d % 2, active[d]
        here = now[1 + p : 1 + p + 2 * rows : 2, :k]
        best = here + costs[ends[d] : ends[d + 1]].reshape(rows, k)
        move = moves[ends[d] : ends[d + 1]].reshape(rows, k)
        for value, kind in ((now[p : p + 2 * rows : 2, :k] + gap, 1), (now[2 + p : 2 + p + 2 * rows : 2, :k] + gap, 2)):
            move[value < best] = kind
            np.minimum(best, value, out=best)
        here[:] = best
        for edge, kind in ((-d - low[:k], 2), (d - low[:k], 1)):  # cells without a word of the first list, of the second
            inside = np.flatnonzero((edge >= 0) & (edge < 2 * rows))
            now[1 + edge[inside], inside] = d * gap
            move[edge[inside] // 2, inside] = kind
        done = np.arange(active[d + 1] if d < steps else 0, k)
        cost[done] = now[1 + (n - m - low)[done], done]
    pairs_of: list[list[tuple[int, int, float]]] = [[] for _ in batch]
    i, j = n.copy(), m.copy()
    open_, path = column, []
    while len(open_):
        d = i[open_] + j[open_]
        at = ends[d] + ((i - j - low)[open_] // 2) * active[d] + open_
        kind = moves[at]
        i[open_] -= kind != 2
        j[open_] -= kind != 1
        hit = kind == 0
        path.append((open_[hit], i[open_][hit], j[open_][hit], near[where[at[hit]]]))
        open_ = open_[(i + j)[open_] > 0]
    for k, a, b, s in zip(*(np.concatenate(x[::-1]).tolist() for x in zip(*path, strict=True)), strict=True):
        pairs_of[k].append((a, b, s))
    return pairs_of, cost


class _Costs:
    """Similarities of the words of a batch: a table of distances between the different words of each pair of lists."""

    def __init__(self, batch: list[tuple[list[str], list[str]]]):
        self.sizes = [(len(a), len(b)) for a, b in batch]
        shape = (len(batch), max(n for n, _ in self.sizes)), (len(batch), max(m for _, m in self.sizes))
        self.first, self.second = np.zeros(shape[0], np.int64), np.zeros(shape[1], np.int64)
        words: list[dict[str, int]] = [{}, {}]
        own = []
        for k, lists in enumerate(batch):
            kinds = [list(dict.fromkeys(x)) for x in lists]
            for place, x, kind in zip((self.first, self.second), lists, kinds, strict=True):
                at = {w: i for i, w in enumerate(kind)}
                place[k, : len(x)] = [at[w] for w in x]
            own.append([[side.setdefault(w, len(side)) for w in kind] for side, kind in zip(words, kinds, strict=True)])
        tall, wide = max(len(a) for a, _ in own), max(len(b) for _, b in own)
        keys = np.full((len(batch), tall, wide), -1, np.int64)
        for k, (a, b) in enumerate(own):
            keys[k, : len(a), : len(b)] = np.array(a)[:, None] * len(words[1]) + np.array(b)[None, :]
        different, where = np.unique(keys, return_inverse=True)
        known = different >= 0
        distance = np.zeros(len(different), np.int32)
        both = np.stack(np.divmod(different[known], len(words[1])), axis=1)
        distance[known] = edit_distances(list(words[0]), list(words[1]), both)
        near = np.ones(len(different))
        size = [np.array([len(w) for w in side], np.int64) for side in words]
        near[known] -= distance[known] / np.maximum(np.maximum(size[0][both[:, 0]], size[1][both[:, 1]]), 1)
        self.near = near[where].reshape(-1)
        self.tall, self.wide = keys.shape[1:]
        self.cost = 1 - self.near
        self.row = (np.arange(len(batch))[:, None] * self.tall + self.first) * self.wide

    def of(self, table, k, i, j):
        """Entries of ``near`` or ``cost`` for places (i, j) of pair k; all may be arrays."""
        return table[self.row[k, i] + self.second[k, j]]


def _align(batch: list[tuple[list[str], list[str]]], gap: float) -> list[list[tuple[int, int, float]]]:
    costs = _Costs(batch)
    count, n, m = len(batch), costs.first.shape[1], costs.second.shape[1]
    each = np.arange(count)[:, None]

    def diagonal(d: int, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs and moves of the cells (i, d - i), by i; ``one`` and ``two`` are the diagonals before."""
        now, move = np.full((count, n + 1), np.inf), np.ones((count, n + 1), np.uint8)
        if d <= m:
            now[:, 0], move[:, 0] = d * gap, 2
        if d <= n:
            now[:, d] = d * gap
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        if len(i):
            best = two[:, i - 1] + costs.of(costs.cost, each, i - 1, d - i - 1)
            step = np.zeros(best.shape, np.uint8)
            for cost, kind in ((one[:, i - 1] + gap, 1), (one[:, i] + gap, 2)):
                step[cost < best] = kind
                best = np.minimum(best, cost)
            now[:, i], move[:, i] = best, step
        return now, move

    start = np.full((count, n + 1), np.inf)
    start[:, 0] = 0
    two, one = np.full((count, n + 1), np.inf), start
    stops = [(two, one)]  # the diagonals before 1, 1 + BLOCK, ...
    kept: list[np.ndarray] | None = [] if count * (n + 1) * (n + m) <= 2 * BATCH_CELLS else None
    for d in range(1, n + m + 1):
        now, move = diagonal(d, two, one)
        two, one = one, now
        if kept is not None:
            kept.append(move)
        elif d % BLOCK == 0:
            stops.append((two, one))
    at = [[a, b] for a, b in costs.sizes]
    found: list[list[tuple[int, int]]] = [[] for _ in batch]
    for block in range((n + m - 1) // BLOCK, -1, -1):
        low, high = block * BLOCK, min((block + 1) * BLOCK, n + m)
        moves = kept[low:high] if kept is not None else []
        two, one = stops[block if kept is None else 0]
        for d in range(low + 1 + len(moves), high + 1):
            now, move = diagonal(d, two, one)
            two, one = one, now
            moves.append(move)
        for k, place in enumerate(at):
            i, j = place
            while i + j > low:
                kind = moves[i + j - low - 1][k, i]
                i, j = i - (kind != 2), j - (kind != 1)
                if kind == 0:
                    found[k].append((i, j))
            place[:] = i, j
    out = []
    for k, pairs in enumerate(found):
        pairs.reverse()
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        out.append([(a, b, s) for (a, b), s in zip(pairs, costs.of(costs.near, k, i, j).tolist(), strict=True)])
    return out


# --- longest common subsequences -------------------------------------------------------------------------------


def _rows(a: list[str], b: list[str]):
    """After each entry of ``a`` a number whose bit j is 0 where the subsequence length grows at ``b[j]`` (Hyyro's bit-parallel form)."""
    masks: dict[str, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hits = row & masks.get(x, 0)
        row = (row + hits | row - hits) & full
        yield row


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    return len(b) - row.bit_count()


def common_pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, the later pairs preferred; a bit per cell is kept."""
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
            continue
        above = j - (rows[i - 1] & ((1 << j) - 1)).bit_count()
        left = j - 1 - (rows[i] & ((1 << (j - 1)) - 1)).bit_count()
        if above >= left:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]
