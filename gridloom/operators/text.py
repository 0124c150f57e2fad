"""Arrays as text of at most 80 columns. One job fetches the cells at the edges that can be shown, however large an array is."""

from __future__ import annotations

import itertools
from math import prod

from pyspark.sql import functions as F

from gridloom.functions import values
from gridloom.ndarray import NDArray, linear

# Fixed values of the text form: columns of a line, columns of a cell, and what stays at either end of a sequence of cells, of a
# matrix's rows, of its columns, and of pages.
LINE, CELL = 80, 20
CELLS, ROWS, COLUMNS, PAGES = 32, 3, 6, 3
GAP = "..."


def shown(v) -> str:
    """A cell: floats without a trailing .0, complex numbers without brackets."""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, complex):
        imaginary = "0" if v.imag == 0 else shown(v.imag)
        return f"{shown(v.real)}{'' if imaginary.startswith('-') else '+'}{imaginary}j"
    return repr(v).removesuffix(".0") if isinstance(v, float) else str(v)


def cut(text: str, width: int) -> str:
    """Shortened in the middle."""
    if len(text) <= width:
        return text
    left = (width - len(GAP) + 1) // 2
    return text[:left] + GAP + text[len(text) - (width - len(GAP) - left) :]


def edges(n: int, edge: int) -> list[int]:
    """All of n places, or edge of them at either end if more than one would be left out."""
    return list(range(n)) if n <= 2 * edge + 1 else [*range(edge), *range(n - edge, n)]


def with_gaps(places: list[int]):
    """The places, and None where some are left out."""
    for k, place in enumerate(places):
        if k and place != places[k - 1] + 1:
            yield None
        yield place


def fitting(n: int, known: list[int], width_of, room: int) -> list[int]:
    """As many of the known places, from both ends of n, as fit in room with a gap where some are left out."""
    if known == list(range(n)) and sum(map(width_of, known)) <= room:
        return known
    room -= len(GAP) + 2
    front, back = [], []
    low, high = 0, len(known) - 1
    while low <= high:
        from_front = len(front) <= len(back)
        width = width_of(known[low] if from_front else known[high])
        if width > room:
            break
        room -= width
        if from_front:
            front.append(known[low])
            low += 1
        else:
            back.append(known[high])
            high -= 1
    return front + back[::-1]


@values.plan
def fetched(a: NDArray, places: set[int]) -> dict[int, object]:
    """The cells at some C-order places."""
    if not places:
        return {}
    cells = a.base.select(linear(a.shape).alias("lin"), a.value.alias("v"))
    rows = (cells if len(places) == a.size else cells.filter(F.col("lin").isin(sorted(places)))).collect()
    return {r["lin"]: complex(r["v"]["re"], r["v"]["im"]) if a.dtype is complex else r["v"] for r in rows}


def sequence(texts: dict[int, str], n: int, between: str, room: int) -> str:
    kept = fitting(n, sorted(texts), lambda k: len(texts[k]) + len(between), room + len(between))
    parts = [GAP if k is None else texts[k] for k in with_gaps(kept)]
    if not kept and n:
        parts = [GAP]
    return between.join(parts)


def listed(cells: dict[int, str], n: int, name: str) -> str:
    return f"  @ {name}: [{sequence(cells, n, ', ', LINE - len(name) - 8)}]"


def described(a: NDArray) -> str:
    cells = {k: cut(shown(v), LINE // 2) for k, v in fetched(a, set(edges(a.size, CELLS))).items()}
    dims = {k: str(n) for k, n in enumerate(a.shape)}
    return "\n".join([
        f"gridloom-array at 0x{id(a):x}", listed(cells, a.size, "data"), listed(dims, a.ndim, "shape"),
        f"  @ ndim: {a.ndim}", f"  @ size: {a.size}", f"  @ dtype: {values.NAMES[a.dtype]}",
    ])


def printed(a: NDArray) -> str:
    if a.ndim < 2:
        cells = {k: cut(shown(v), CELL) for k, v in fetched(a, set(edges(a.size, CELLS))).items()}
        return f"[0] {sequence(cells, a.size, ' ', LINE - 4)}".rstrip() if a.ndim else cells[0]
    *leading, n, m = a.shape
    pages, rows, columns = edges(prod(leading), PAGES), edges(n, ROWS), edges(m, COLUMNS)
    place = {(p, r, c): (p * n + r) * m + c for p, r, c in itertools.product(pages, rows, columns)}
    found = fetched(a, set(place.values())) if a.size else {}
    texts = {key: cut(shown(found[at]), CELL) for key, at in place.items() if at in found}
    blocks = []
    for page in with_gaps(pages):
        if page is None:
            blocks.append(GAP)
            continue
        label = []
        for size in reversed(leading):
            page_rest, i = divmod(page if not label else page_rest, max(size, 1))
            label.insert(0, str(i))
        head = [cut(f"[{', '.join(label)}, ,]", LINE)] if leading else []
        blocks.append("\n".join(head + matrix({(r, c): t for (p, r, c), t in texts.items() if p == page}, rows, columns, m)))
    return "\n\n".join(blocks)


def matrix(texts: dict[tuple[int, int], str], rows: list[int], columns: list[int], m: int) -> list[str]:
    """The lines of a matrix, of cells by row and column: right-aligned under [,j], after [i,]."""
    names = {r: f"[{r},]" for r in rows}
    margin = max(map(len, names.values()), default=0)
    width = {c: max([len(f"[,{c}]"), *(len(texts[r, c]) for r in rows if (r, c) in texts)]) for c in columns}
    kept = fitting(m, columns, lambda c: width[c] + 1, LINE - margin)

    def line(name: str, cell) -> str:
        return f"{name:>{margin}}" + "".join(f" {GAP}" if c is None else f" {cell(c):>{width[c]}}" for c in with_gaps(kept))

    lines = [line("", lambda c: f"[,{c}]").rstrip()]
    return lines + [GAP if r is None else line(names[r], lambda c, r=r: texts.get((r, c), "")).rstrip() for r in with_gaps(rows)]
