"""Edit distances of long sequences, in Arrow batches.

A distance is computed a column at a time with the bits of whole numbers (64
cells or more per operation), in blocks of ``BLOCK`` rows that hand their lowest
row on as one step per column, so memory grows with the length of the texts and
not with their product. Only cells within a band around the diagonal are
visited; the band is doubled until the distance fits into it, which proves it.
Words are compared as numbers: each distinct word of a pair gets its own code.
"""

from collections.abc import Hashable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a block, and the half width of the first band tried.
BLOCK, BAND = 4096, 512


def _without_common_ends(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    n = min(len(a), len(b))
    start = next((i for i in range(n) if a[i] != b[i]), n)
    a, b = a[start:], b[start:]
    n -= start
    end = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return a[:len(a) - end], b[:len(b) - end]


def _within_band(a: Sequence[Hashable], b: Sequence[Hashable], half: int) -> int:
    """A number of edits that turns ``a`` into ``b``; the least, if at most ``half``.

    Rows are items of ``a``, columns those of ``b``. What lies outside the band
    counts as reached by single steps, so the result is never too small, and a
    path of at most ``half`` edits stays inside."""
    n, m = len(a), len(b)
    top = [1] * m  # step along the row above the block, at each column
    corner, left = 0, 0  # value above the block's first column, and that column
    for start in range(0, n, BLOCK):
        rows = a[start:start + BLOCK]
        first, last = max(0, start - half), min(m, start + len(rows) + half)
        corner += sum(top[left:first])
        left = first
        where: dict[Hashable, int] = {}
        for i, x in enumerate(rows):
            where[x] = where.get(x, 0) | 1 << i
        every, low = (1 << len(rows)) - 1, 1 << (len(rows) - 1)
        up, down = every, 0  # rows where a column rises or falls by one
        find = where.get
        for j in range(first, last):
            same, step = find(b[j], 0), top[j]
            either = same | down
            if step < 0:
                same |= 1
            diagonal = (((same & up) + up) ^ up) | same | down
            rise, fall = (down | ~(diagonal | up)) & every, up & diagonal
            top[j] = 1 if rise & low else -1 if fall & low else 0
            rise, fall = (rise << 1) & every, (fall << 1) & every
            if step > 0:
                rise |= 1
            elif step < 0:
                fall |= 1
            up, down = (fall | ~(either | rise)) & every, rise & either
        corner += len(rows)
        for j in range(last, m):  # beyond the band
            top[j] = 1
    return corner + sum(top[left:])


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Insertions, deletions and replacements that turn ``a`` into ``b``."""
    a, b = _without_common_ends(a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    half = max(BAND, len(b) - len(a))
    while True:
        found = _within_band(a, b, half)
        if found <= half or half >= len(b):
            return found
        half *= 2


def word_codes(*sides: Sequence[str]) -> list[list[int]]:
    """Each side's words as the numbers of the pair's distinct words."""
    codes: dict[str, int] = {}
    return [[codes.setdefault(w, len(codes)) for w in words] for words in sides]


def text_errors(hyp: Column, ref: Column) -> Column:
    """Struct ``char_errors, ref_chars, word_errors, ref_words`` of two string
    columns (null counts as empty): edit distances over characters and over
    words between white space, and the reference's lengths."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hyps, refs in batches:
            rows = []
            for h, r in zip(hyps.to_pylist(), refs.to_pylist(), strict=True):
                h, r = h or "", r or ""
                hw, rw = word_codes(h.split(), r.split())
                rows.append((edit_distance(h, r), len(r), edit_distance(hw, rw), len(rw)))
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(4)],
                                             ["char_errors", "ref_chars", "word_errors", "ref_words"])

    return F.arrow_udf(run, "char_errors long, ref_chars long, word_errors long, ref_words long")(hyp, ref)


def char_distance(hyp: Column, ref: Column) -> Column:
    """Edit distance over characters of two string columns (null counts as empty)."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hyps, refs in batches:
            yield pa.array([edit_distance(h or "", r or "") for h, r in zip(hyps.to_pylist(), refs.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "long")(hyp, ref)


def word_distance(hyp_words: Column, ref_words: Column) -> Column:
    """Edit distance over words of two ``array<string>`` columns (null counts as empty)."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hyps, refs in batches:
            yield pa.array([edit_distance(*word_codes(h or [], r or [])) for h, r in zip(hyps.to_pylist(), refs.to_pylist(), strict=True)],
                           pa.int64())

    return F.arrow_udf(run, "long")(hyp_words, ref_words)
