"""Column functions over reads: q-gram codes, sketches, similarities and blocking keys. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ACGT"  # fixed: the value of a letter is its place here
VALID = "^[ACGT]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qgrams(seq: Column | str, q: int) -> Column:
    """The codes of all q-grams in order, repeats kept: the first letter of a gram is its lowest digit in base 4.

    A read shorter than q has an empty array; a null read null. Letters must be among ACGT.
    """
    seq = col(seq)
    values = F.transform(F.split(seq, ""), lambda c: F.instr(F.lit(LETTERS), c) - 1)

    def codes(v: Column) -> Column:
        def code(i: Column) -> Column:
            total = F.get(v, i)
            for p in range(1, q):
                total = total + F.get(v, i + p) * F.lit(4**p)
            return total.cast("int")

        # sequence() counts down where its end is lower, so short reads are left out first.
        return F.transform(F.sequence(F.lit(0), F.length(seq) - q), code)

    # The letter values become a variable once, through a one-element array.
    whole = F.transform(F.array(values), codes)[0]
    return F.when(seq.isNull(), F.lit(None).cast("array<int>")).when(F.length(seq) >= q, whole).otherwise(F.array().cast("array<int>"))


def permuted(code: Column, constants: tuple[int, int, int], bits: int) -> Column:
    """A bijection of [0, 2**bits): multiply and add, fold the high half in, and again."""
    a, b, c = constants
    mask = (1 << bits) - 1
    x = (code * F.lit(a) + F.lit(b)).bitwiseAND(F.lit(mask))
    x = x.bitwiseXOR(F.shiftright(x, bits // 2))
    x = (x * F.lit(c)).bitwiseAND(F.lit(mask))
    return x.bitwiseXOR(F.shiftright(x, max(1, bits // 2 - 1)))


def dice(a: Column | str, b: Column | str) -> Column:
    """Twice the size of the set intersection over the sum of the bag sizes; 0 where both are empty.

    Since bags count repeats, a read with repeated grams is less than 1 similar to itself.
    """
    a, b = col(a), col(b)
    total = F.size(a) + F.size(b)
    return F.when(total > 0, F.lit(2.0) * F.size(F.array_intersect(a, b)) / total).otherwise(F.lit(0.0))


def dice_of_sets(a: Column | str, n_a: Column | str, b: Column | str, n_b: Column | str) -> Column:
    """The same from gram sets as numbers of 64 bits each, and the sizes of the bags."""
    total = col(n_a) + col(n_b)
    common = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda s, x: s + x)
    return F.when(total > 0, F.lit(2.0) * common / total).otherwise(F.lit(0.0))


def within_edits(a: Column | str, b: Column | str, limit: int) -> Column:
    """Whether at most `limit` insertions, deletions and substitutions lie between a and b."""
    return F.levenshtein(col(a), col(b), limit) >= 0  # -1 above the limit


def accepted(similarity: Column, a: Column | str, b: Column | str, high: float, low: float, limit: int) -> Column:
    """Similar at once from `high` on; from `low` on if few edits lie between. The order of tests is fixed."""
    return F.when(similarity >= high, F.lit(True)).when(similarity >= low, within_edits(a, b, limit)).otherwise(F.lit(False))


def anchored(seq: Column | str, anchor: Column | str, length: int) -> Column:
    """`length` letters from the anchor's first occurrence on, or of the beginning where it has none; cut at the end."""
    seq = col(seq)
    start = F.greatest(F.instr(seq, col(anchor)), F.lit(1))
    return F.substring(seq, start, F.lit(length))


def substring_key(seq: Column | str, anchors: list[str], length: int) -> Column:
    """The anchored substrings in sorted order, so that anchors of a round may be swapped."""
    return F.array_sort(F.array(*(anchored(seq, F.lit(a), length) for a in anchors)))


def band_key(sig: Column | str, positions: tuple[int | Column, ...], bits: int) -> Column:
    """The sketch values at `positions` as digits of one number, the first lowest."""
    key = F.lit(0).cast("bigint")
    for j, i in enumerate(positions):
        key = key + F.shiftleft(F.get(col(sig), F.lit(i) if isinstance(i, int) else i).cast("bigint"), bits * j)
    return key


def tiebreak(seed: object, key: Column | str) -> Column:
    """A pseudo-random order of rows that reruns and other engines repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")).cast("binary"))
