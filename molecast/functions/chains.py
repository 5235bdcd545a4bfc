"""Alignment of two chains by their shape: residues are paired so that the chain similarity score of the best superposition is large."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .descriptors import move, superpose, tm_scale, tm_score

#: What opening a gap costs when pairing by distance, and by structure classes.
GAP, CLASS_GAP = -0.6, -1.0
#: Distances of (1-3, 1-4, 1-5, 2-4, 2-5, 3-5) residue pairs of a helix and of a strand, how far off they may be, and below which the ends of a turn are.
PAIRS = ((0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 4))
HELIX, STRAND = (5.45, 5.18, 6.37, 5.45, 5.18, 5.45), (6.1, 10.4, 13.0, 6.1, 10.4, 6.1)
HELIX_TOLERANCE, STRAND_TOLERANCE, TURN_BELOW = 2.1, 1.42, 8.0


def structure_classes(x: np.ndarray) -> np.ndarray:
    """Coil 1, helix 2, turn 3, strand 4, from the two residues on either side; the two at each end are coil."""
    out = np.ones(len(x), np.int8)
    if len(x) < 5:
        return out
    five = [x[k : len(x) - 4 + k] for k in range(5)]
    d = np.stack([np.linalg.norm(five[a] - five[b], axis=1) for a, b in PAIRS], 1)
    fits = [(np.abs(d - ref) < most).all(1) for ref, most in ((HELIX, HELIX_TOLERANCE), (STRAND, STRAND_TOLERANCE))]
    out[2:-2] = np.select([fits[0], fits[1], d[:, 2] < TURN_BELOW], [2, 4, 3], 1)
    return out


#: Tables of at most so many cells are filled cell by cell, where numpy's calls would take longer than the cells.
SMALL = 2500


def _filled(score: np.ndarray, gap: float) -> tuple[list[list[float]], list[list[bool]]]:
    """Values of the best paths to each cell, and whether the last step is a pair."""
    n, m = score.shape
    value, straight = [[0.0] * (m + 1)], [[False] * (m + 1)]
    for row in score.tolist():
        above, paired, here, mine, left, came = value[-1], straight[-1], [0.0], [False], 0.0, False
        for j in range(1, m + 1):
            d, u = above[j - 1] + row[j - 1], above[j] + gap if paired[j] else above[j]
            v = left + gap if came else left
            came = d >= u and d >= v
            left = d if came else u if u >= v else v
            here.append(left)
            mine.append(came)
        value.append(here)
        straight.append(mine)
    return value, straight


def _filled_by_diagonals(score: np.ndarray, gap: float) -> tuple[list[list[float]], list[list[bool]]]:
    """The same for large tables, along anti-diagonals."""
    n, m = score.shape
    value, straight = np.zeros((n + 1, m + 1)), np.zeros((n + 1, m + 1), bool)
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        d = value[i - 1, j - 1] + score[i - 1, j - 1]
        u = value[i - 1, j] + np.where(straight[i - 1, j], gap, 0.0)
        v = value[i, j - 1] + np.where(straight[i, j - 1], gap, 0.0)
        straight[i, j] = (d >= u) & (d >= v)
        value[i, j] = np.maximum(d, np.maximum(u, v))
    return value.tolist(), straight.tolist()


def best_path(score: np.ndarray, gap: float) -> np.ndarray:
    """Pairs of a global alignment; opening a gap costs, ends and longer gaps are free."""
    value, straight = (_filled if score.size <= SMALL else _filled_by_diagonals)(score, gap)
    out, (i, j) = [], score.shape
    while i and j:
        if straight[i][j]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif value[i - 1][j] + (gap if straight[i - 1][j] else 0.0) >= value[i][j - 1] + (gap if straight[i][j - 1] else 0.0):
            i -= 1
        else:
            j -= 1
    return np.array(out[::-1], int).reshape(-1, 2)


@dataclass
class ChainAlignment:
    """Pairs (query, template), the motion of the query, and the chains."""

    query: np.ndarray
    template: np.ndarray
    pairs: np.ndarray
    motion: np.ndarray

    def score(self, length: int | None = None, d0: float | None = None) -> tuple[np.ndarray, float]:
        """Motion and similarity score, by the template's length unless given."""
        value, motion = tm_score(self.query, self.template, self.pairs, length or len(self.template), d0)
        return motion, value

    def rmsd(self) -> float:
        return superpose(self.query[self.pairs[:, 0]], self.template[self.pairs[:, 1]])[1]


def _gapless(x: np.ndarray, y: np.ndarray, d0: float) -> np.ndarray:
    """The shift of one chain along the other that superposes best."""
    best, pairs = -1.0, np.empty((0, 2), int)
    least = max(5, min(len(x), len(y)) // 2)
    for shift in range(-len(y) + least, len(x) - least + 1):
        i = np.arange(max(0, shift), min(len(x), len(y) + shift))
        m, _ = superpose(x[i], y[i - shift])
        value = (1 / (1 + np.square(move(m, x[i]) - y[i - shift]).sum(1) / d0**2)).sum()
        if value > best:
            best, pairs = value, np.stack([i, i - shift], 1)
    return pairs


def _settle(x: np.ndarray, y: np.ndarray, d0: float, rounds: int = 4) -> tuple[float, np.ndarray]:
    """Superpose pairs, and again those that come near, a few times: the best score's sum and its motion."""
    best, motion, pick, reach = -1.0, np.eye(4), np.arange(len(x)), min(8.0, max(4.5, d0))
    for _ in range(rounds):
        m, _ = superpose(x[pick], y[pick])
        d2 = np.square(move(m, x) - y).sum(1)
        if (value := (1 / (1 + d2 / d0**2)).sum()) > best:
            best, motion = value, m
        new = np.argsort(d2)[: max(3, int((d2 < reach * reach).sum()))]
        if len(new) == len(pick) and set(new) == set(pick):
            break
        pick = new
    return best, motion


def align_chains(query: np.ndarray, template: np.ndarray, query_classes: np.ndarray | None = None, template_classes: np.ndarray | None = None, rounds: int = 20) -> ChainAlignment:
    """Start from the best gapless shift, from structure classes, from both together and from superposed fragments; pair and superpose in turn until the pairs stay."""
    if min(len(query), len(template)) < 5:
        raise ValueError("a chain needs five residues at least")
    short = min(len(query), len(template))
    d0 = tm_scale(short)
    qc = structure_classes(query) if query_classes is None else query_classes
    tc = structure_classes(template) if template_classes is None else template_classes
    like = (qc[:, None] == tc[None]).astype(float)

    settled: dict[bytes, tuple[float, np.ndarray]] = {}  # starts soon meet, so the same pairs come again
    paths: dict[tuple[bytes, float], np.ndarray] = {}

    def settle(pairs: np.ndarray) -> tuple[float, np.ndarray]:
        """The score's sum of pairs, and of all residues with each other after the motion."""
        if (key := pairs.tobytes()) not in settled:
            value, m = _settle(query[pairs[:, 0]], template[pairs[:, 1]], d0)
            settled[key] = value, 1 / (1 + np.square(move(m, query)[:, None] - template[None]).sum(2) / d0**2)
        return settled[key]

    def path(pairs: np.ndarray, gap: float) -> np.ndarray:
        if (key := (pairs.tobytes(), gap)) not in paths:
            paths[key] = best_path(settle(pairs)[1], gap)
        return paths[key]

    first = _gapless(query, template, d0)
    starts = [first, best_path(like, CLASS_GAP), best_path(settle(first)[1] + 0.5 * like, CLASS_GAP)]
    span = min(20, short // 3)
    if span >= 5:
        pieces = [(i, j) for i in range(0, len(query) - span, max(1, len(query) // 6)) for j in range(0, len(template) - span, max(1, len(template) // 6))]
        pieces.sort(key=lambda p: superpose(query[p[0] : p[0] + span], template[p[1] : p[1] + span])[1])
        starts += [np.stack([np.arange(i, i + span), np.arange(j, j + span)], 1) for i, j in pieces[:2]]
    best = None
    for pairs in starts:
        if len(pairs) < 3:
            continue
        for gap in (GAP, 0.0):
            now = pairs
            for _ in range(rounds):
                value = settle(now)[0]
                if best is None or value > best[0]:
                    best = value, now
                new = path(now, gap)
                if len(new) < 3 or np.array_equal(new, now):
                    break
                now = new
    return ChainAlignment(query, template, best[1], tm_score(query, template, best[1])[1])
