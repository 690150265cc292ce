"""Connection layouts: the names, keys and masks of pairs of codes.

``unordered``: pairs i < j, column by column of the upper triangle.  ``self``: the same
with the diagonal.  ``ordered``: every (ground i, response j), column j * p + i.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

SEPARATOR = " & "
LAYOUTS = ("unordered", "self", "ordered")


def triangle_indices(p: int, row: int | None = None):
    """Rows and columns of the upper triangle, or one of the two."""
    pairs = [(i, j) for j in range(p) for i in range(j)]
    both = [i for i, _ in pairs], [j for _, j in pairs]
    return both if row is None else both[row]


def index_pairs(p: int, layout: str = "unordered") -> list[tuple[int, int]]:
    if layout == "unordered":
        return [(i, j) for j in range(p) for i in range(j)]
    if layout == "self":
        return [(i, j) for j in range(p) for i in range(j + 1)]
    if layout == "ordered":
        return [(i, j) for j in range(p) for i in range(p)]
    raise ValueError(f"unknown layout {layout!r}")


def adjacency_key(codes: Sequence[str], layout: str = "unordered") -> list[tuple[str, str]]:
    return [(codes[i], codes[j]) for i, j in index_pairs(len(codes), layout)]


def pair_names(codes: Sequence[str], layout: str = "unordered") -> list[str]:
    return [a + SEPARATOR + b for a, b in adjacency_key(codes, layout)]


def infer_layout(columns: int, p: int) -> str:
    """The layout that has so many columns for p codes."""
    for layout in LAYOUTS:
        if len(index_pairs(p, layout)) == columns:
            return layout
    raise ValueError(f"{columns} columns fit no layout of {p} codes")


def key_codes(key: Iterable[tuple[str, str]]) -> list[str]:
    """Codes of a key in the order in which they first appear."""
    return list(dict.fromkeys(c for pair in key for c in pair))


def key_indices(key: Iterable[tuple[str, str]], codes: Sequence[str]) -> list[tuple[int, int]]:
    place = {c: k for k, c in enumerate(codes)}
    return [(place[a], place[b]) for a, b in key]


def vector_to_ut(v: Sequence[float]) -> list[float]:
    return [v[i] * v[j] for i, j in index_pairs(len(v))]


def masked(codes: Sequence[str], layout: str, mask=None, self_mask=None, upper_only: bool = False) -> set[int]:
    """Columns that a mask sets to zero.

    ``mask`` is p x p with 0 for a masked cell; either triangle masks an unordered pair
    unless ``upper_only``.  ``self_mask`` has a 0 for each code whose own column is masked.
    """
    p, gone = len(codes), set()
    for col, (i, j) in enumerate(index_pairs(p, layout)):
        if mask is not None:
            off = not mask[i][j]
            if layout != "ordered" and not upper_only:
                off = off or not mask[j][i]
            if i == j and layout != "ordered":
                off = False
            if off:
                gone.add(col)
        if self_mask is not None and i == j and not self_mask[i]:
            gone.add(col)
    return gone
