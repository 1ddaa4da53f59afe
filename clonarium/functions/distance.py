"""Distance models between aligned sequences, and vectorised distances between all sequences of a group."""

from __future__ import annotations

import csv

import numpy as np

# Bases that each nucleotide code stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
GAPS = "-."
NUCLEOTIDES = GAPS + "".join(IUPAC)
AMINO_ACIDS = GAPS + "*ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Amino acids that ambiguity codes stand for.
AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "IL"}

# Distances of unlike bases, by pairs that share a distance, as (A-G and C-T, A-T and C-G, A-C and G-T).
PAIRED = {
    "hh_s1f": (0.64, 1.16, 1.21),
    "mk_rs1nf": (0.32, 1.17, 1.51),
    "hs1f_compat": (1, 1.75, 2.08),
    "m1n_compat": (1, 2.14, 2.86),
}


class Model:
    """A lookup table: between letters (``size`` 1), or between a letter and the window of ``size`` letters that it would replace."""

    def __init__(self, letters: str, table: np.ndarray, size: int = 1, windows: dict[str, int] | None = None):
        self.letters, self.table, self.size, self.windows = letters, table, size, windows
        self.code = np.full(256, 255, np.uint8)
        for i, c in enumerate(letters):
            self.code[ord(c)] = i

    @property
    def symmetric(self) -> bool:
        return self.size == 1 and bool((self.table == self.table.T).all())


def hamming() -> Model:
    """0 for codes that share a base (N and gaps share with all), else 1."""
    n = len(NUCLEOTIDES)
    table = np.zeros((n, n))
    for i, a in enumerate(NUCLEOTIDES):
        for j, b in enumerate(NUCLEOTIDES):
            table[i, j] = 0 if a in GAPS or b in GAPS else float(not set(IUPAC[a]) & set(IUPAC[b]))
    return Model(NUCLEOTIDES, table)


def amino() -> Model:
    """0 for letters that share an amino acid (X and gaps share with all), else 1."""
    n = len(AMINO_ACIDS)
    table = np.zeros((n, n))
    for i, a in enumerate(AMINO_ACIDS):
        for j, b in enumerate(AMINO_ACIDS):
            same = a in GAPS + "X" or b in GAPS + "X" or bool(set(AMBIGUOUS.get(a, a)) & set(AMBIGUOUS.get(b, b)))
            table[i, j] = float(not same)
    return Model(AMINO_ACIDS, table)


def paired(name: str) -> Model:
    letters = "ACGTN" + GAPS
    table = np.zeros((len(letters), len(letters)))
    transition, complement, other = PAIRED[name]
    for pairs, d in ((("AG", "CT"), transition), (("AT", "CG"), complement), (("AC", "GT"), other)):
        for a, b in pairs:
            i, j = letters.index(a), letters.index(b)
            table[i, j] = table[j, i] = d
    return Model(letters, table)


def windowed(path: str) -> Model:
    """A user's table of letters by windows (tab-separated, windows as columns): targeting models of five-letter windows."""
    with open(path, newline="") as f:
        rows = list(csv.reader(f, delimiter="\t"))
    columns = rows[0][1:]
    size = len(columns[0])
    letters = "".join(r[0] for r in rows[1:])
    table = np.array([[float(x) if x not in ("", "NA") else 0.0 for x in r[1:]] for r in rows[1:]])
    return Model(letters, table, size, None if size == 1 else {w: i for i, w in enumerate(columns)})


MODELS = {"ham": hamming, "aa": amino} | {name: (lambda name=name: paired(name)) for name in PAIRED}


def model(name: str) -> Model:
    """By name, or the path of a user's table."""
    return MODELS[name]() if name in MODELS else windowed(name)


def _encode(sequences: list[str], m: Model) -> np.ndarray:
    width = {len(s) for s in sequences}
    if len(width) > 1:
        raise IndexError("sequences must have equal lengths")
    raw = np.frombuffer("".join(sequences).encode("ascii", "replace"), np.uint8).reshape(len(sequences), -1)
    codes = m.code[raw]
    if (codes == 255).any():
        raise KeyError(f"letters without a distance: {sorted({chr(c) for c in raw[codes == 255]})}")
    return codes


def pairwise(sequences: list[str], m: Model, norm: str | None = "len", sym: str = "avg", block: int = 256) -> np.ndarray:
    """Distances of all pairs of distinct sequences as a matrix, in blocks of rows.

    Only unlike places count. ``norm``: divide by the length (len), by the number of unlike places (mut), or not (None or none).
    ``sym``: of the two distances of a place under a model that is not symmetric, their mean (avg) or the smaller one (min).
    """
    codes = _encode(sequences, m)
    u, length = codes.shape
    out = np.zeros((u, u))
    if m.size == 1:
        # A product of one row's distances to each letter by place with the other row's letters, for all pairs at once.
        table = m.table if m.symmetric else np.minimum(m.table, m.table.T) if sym == "min" else (m.table + m.table.T) / 2
        table = table * (1 - np.eye(len(table)))
        letters = len(m.letters)
        marks = np.zeros((u, length * letters))
        marks[np.arange(u)[:, None], np.arange(length) * letters + codes] = 1.0
        for lo in range(0, u, block):
            total = table[codes[lo : lo + block]].reshape(-1, length * letters) @ marks.T
            if norm == "mut":
                unlike = length - marks[lo : lo + block] @ marks.T
                total = np.divide(total, unlike, out=np.zeros_like(total), where=unlike > 0)
            out[lo : lo + block] = total / max(length, 1) if norm == "len" else total
        return out
    pad = "N" * ((m.size - 1) // 2)
    windows = np.array([[m.windows[(pad + s + pad)[i : i + m.size]] for i in range(length)] for s in sequences])
    for lo in range(0, u, block):
        own = codes[lo : lo + block]
        total = np.zeros((len(own), u))
        unlike = np.zeros((len(own), u))
        for p in range(length):
            a, b = own[:, p], codes[:, p]
            differ = a[:, None] != b[None, :]
            unlike += differ
            one, two = m.table[a][:, windows[:, p]], m.table[b][:, windows[lo : lo + block, p]].T
            d = np.minimum(one, two) if sym == "min" else (one + two) / 2
            total += np.where(differ, d, 0.0)
        if norm == "len":
            total /= max(length, 1)
        elif norm == "mut":
            total = np.divide(total, unlike, out=np.zeros_like(total), where=unlike > 0)
        out[lo : lo + block] = total
    return out


def single_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the components of pairs within ``threshold``."""
    n = len(distance)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            label[i] = i
            front = np.array([i])
            while len(front):
                near = (distance[front] <= threshold).any(axis=0) & (label < 0)
                label[near] = i
                front = np.flatnonzero(near)
    return label


def agglomerate(distance: np.ndarray, threshold: float, linkage: str) -> np.ndarray:
    """Labels by average or complete linkage, joined while the least distance of two clusters is within ``threshold``.

    Ties join the pair with the smaller first members. Distances to a joined cluster follow from those to its parts.
    """
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label = np.ones(n), np.arange(n)
    alive = np.ones(n, bool)
    nearest = d.argmin(axis=1) if n else np.zeros(0, int)
    while alive.sum() > 1:
        rows = np.flatnonzero(alive)
        best = d[rows, nearest[rows]]
        at = int(rows[best.argmin()])
        if d[at, nearest[at]] > threshold:
            break
        a, b = sorted((at, int(nearest[at])))
        if linkage == "average":
            joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        elif linkage == "complete":
            joined = np.maximum(d[a], d[b])
        else:
            raise ValueError("linkage is single, average or complete")
        joined[[a, b]] = np.inf
        joined[~alive] = np.inf
        d[a], d[:, a] = joined, joined
        d[b], d[:, b] = np.inf, np.inf
        alive[b] = False
        size[a] += size[b]
        label[label == b] = a
        for r in np.flatnonzero(alive):
            if r == a or nearest[r] in (a, b) or d[r, a] < d[r, nearest[r]]:
                nearest[r] = d[r].argmin()
    return label


def cluster(sequences: list[str], m: Model, threshold: float, linkage: str = "single", norm: str | None = "len", sym: str = "avg") -> np.ndarray:
    """Cluster labels (smallest member's place) of distinct sequences of one length; one sequence is a cluster without any distance."""
    if len(sequences) < 2:
        return np.zeros(len(sequences), int)
    d = pairwise(sequences, m, norm, sym)
    return single_linkage(d, threshold) if linkage == "single" else agglomerate(d, threshold, linkage)
