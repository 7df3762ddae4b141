"""Column functions on symbol sequences. Positions count from 1."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def letters(seq) -> Column:
    """The symbols of a sequence as an array; nothing for an empty one."""
    return F.filter(F.split(col(seq), ""), lambda c: c != "")


def outside(seq, alphabet: str = "ACGT") -> Column:
    """Whether a symbol is not of the alphabet. A negated class: `$` would also match before a trailing newline."""
    return col(seq).rlike(f"[^{alphabet}]")


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGT", "TGCA"))


def hamming(a, b) -> Column:
    """Sites at which two sequences of equal length differ."""
    differ = F.zip_with(letters(a), letters(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def changed_sites(first, *others) -> Column:
    """Sites at which any of the other sequences differs from the first."""
    flags = [F.zip_with(letters(first), letters(o), lambda x, y: x != y) for o in others]
    any_of = flags[0]
    for f in flags[1:]:
        any_of = F.zip_with(any_of, f, lambda x, y: x | y)
    return F.size(F.filter(any_of, lambda x: x))


def change_positions(a, b) -> Column:
    return F.filter(F.sequence(F.lit(1), F.greatest(F.length(col(a)), F.lit(1))), lambda i: F.substring(col(a), i, F.lit(1)) != F.substring(col(b), i, F.lit(1)))


def left_changed(a, b, left: int, width: int) -> Column:
    """Whether the mean changed position lies left of the middle of the inner window; null if nothing changed."""
    at = change_positions(a, b)
    mean = F.aggregate(at, F.lit(0.0), lambda s, x: s + x) / F.size(at)
    return F.when(F.size(at) > 0, mean <= left + (width + 1) / 2)


def gc_count(seq) -> Column:
    return F.length(F.regexp_replace(col(seq), "[^CG]", ""))


def wrap_substring(seq, start, stop) -> Column:
    """Substring of the circular sequence."""
    s = col(seq)
    times = F.ceil(stop / F.length(s)).cast("int")
    return F.substring(F.repeat(s, times), start, stop - start + 1)


def wrap_overwrite(seq, start, value) -> Column:
    """The circular sequence with value written from start on; what runs over the end goes on at the beginning."""
    s, v = col(seq), col(value)
    n = F.length(s)
    over = F.greatest(start + F.length(v) - 1 - n, F.lit(0))
    inside = F.length(v) - over
    line = F.overlay(s, F.substring(v, F.lit(1), inside), start)
    return F.when(over > 0, F.overlay(line, F.substring(v, inside + 1, over), F.lit(1))).otherwise(line)


def overwrite(seq, start, value) -> Column:
    return F.overlay(col(seq), col(value), start)


def pattern_index(pattern, bases: str) -> Column:
    """Place of a pattern in the enumeration whose first symbol varies fastest, from 0."""
    k = len(bases)
    digits = F.transform(letters(pattern), lambda c: F.instr(F.lit(bases), c) - 1)
    return F.aggregate(F.reverse(digits), F.lit(0).cast("long"), lambda s, x: s * k + x)


def flanks_lowered(pattern, left: int, width: int) -> Column:
    p = col(pattern)
    return F.concat(F.lower(F.substring(p, 1, left)), F.substring(p, left + 1, width), F.lower(F.substring(p, left + width + 1, 1 << 20)))


def orf_frame(pos, start) -> Column:
    return F.pmod(col(pos) - col(start), F.lit(3))
