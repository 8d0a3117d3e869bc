"""Column functions for nucleotides and per-base labels. No UDFs: all run inside Spark's expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Label codes, channel codes, and the two sets of allowed transitions.
IR, START, E1, E2, E0, STOP = range(6)
LABEL_NAMES = ["IR", "START", "E1", "E2", "E0", "STOP"]
BASES = "ACGTN"
PAD = 5
TRANSITIONS = {
    "reference": [(IR, IR), (IR, START), (START, E1), (E1, E2), (E2, E0), (E0, E1), (E0, STOP), (STOP, IR)],
    "label_cycle": [(IR, IR), (IR, START), (START, E1), (E1, E2), (E2, E0), (E0, E1), (E1, STOP), (STOP, IR)],
}


def shift_in(start: Column, end: Column) -> tuple[Column, Column]:
    """1-based inclusive to 0-based half-open."""
    return start - 1, end


def shift_out(start: Column, end: Column) -> tuple[Column, Column]:
    """0-based half-open to 1-based inclusive."""
    return start + 1, end


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def is_complete(cds_len: Column) -> Column:
    """At least two codons and a whole number of them. A stop codon is not asked for."""
    return (cds_len >= 6) & (cds_len % 3 == 0)


def code_string(seq: Column) -> Column:
    """One digit a base: A C G T N in either case are 0..4, anything else is 4."""
    return F.translate(F.regexp_replace(seq, "[^ACGTNacgtn]", "N"), "ACGTNacgtn", "0123401234")


def encode(seq: Column) -> Column:
    """Channel codes as array<tinyint>; an empty sequence is an empty array."""
    return digits(code_string(seq))


def one_hot(codes: Column, width: int, blank: int | None = None) -> Column:
    """array<array<tinyint>>; the code ``blank`` gives zeros only."""
    hot = lambda c, k: (c == k) if blank is None else (c == k) & (c != blank)
    return F.transform(codes, lambda c: F.array(*[hot(c, F.lit(k)).cast("tinyint") for k in range(width)]))


def pad_to(items: Column, length: int, fill: int = 0) -> Column:
    """Cut or fill on the right to ``length``."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(items))
    return F.slice(F.concat(items, F.array_repeat(F.lit(fill).cast("tinyint"), missing)), 1, length)


def pad_mask(codes: Column) -> Column:
    return F.transform(codes, lambda c: c == PAD)


def label_string(real: Column, orf_start: Column, orf_end: Column) -> Column:
    """One digit a base for ``real`` bases and an ORF whose ends may lie outside them; no ORF where it is null."""
    low = F.least(F.greatest(orf_start, F.lit(0)), real).cast("int")
    high = F.least(F.greatest(orf_end, F.lit(0)), real).cast("int")
    n = high - low
    cycle = F.repeat(F.lit("234"), (F.floor(n / 3) + 2).cast("int"))
    body = F.substring(cycle, (F.pmod(low - orf_start - 1, F.lit(3)) + 1).cast("int"), n)
    body = F.when((n > 0) & (orf_start == low), F.concat(F.lit("1"), F.substring(body, F.lit(2), n - 1))).otherwise(body)
    body = F.when((n > 0) & (orf_end == high), F.concat(F.substring(body, F.lit(1), n - 1), F.lit("5"))).otherwise(body)
    none = F.repeat(F.lit("0"), real.cast("int"))
    return F.when(orf_start.isNull() | (n <= 0), none).otherwise(F.concat(F.repeat(F.lit("0"), low), body, F.repeat(F.lit("0"), real.cast("int") - high)))


def digits(text: Column) -> Column:
    """A string of digits as array<tinyint>; an empty one is an empty array."""
    return F.when(F.length(text) == 0, F.array().cast("array<tinyint>")).otherwise(F.split(text, "").cast("array<tinyint>"))


def dense_labels(length: Column, orf_start: Column, orf_end: Column) -> Column:
    """Per-base labels of a sequence with the half-open ORF, or of none where it is null."""
    def label(i: Column) -> Column:
        inside = (i - orf_start - 1) % 3
        return (
            F.when(orf_start.isNull() | (i < orf_start) | (i >= orf_end), IR)
            .when(i == orf_end - 1, STOP)
            .when(i == orf_start, START)
            .when(inside == 0, E1)
            .when(inside == 1, E2)
            .otherwise(E0)
            .cast("tinyint")
        )

    return F.when(length <= 0, F.array().cast("array<tinyint>")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), length.cast("long") - 1), label))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def path_key(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    log_sum = F.log(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)))
    return F.transform(x, lambda v: v - top - log_sum)


def argmax(x: Column) -> Column:
    """Index of the largest value, the lowest on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def ratio_or_zero(a: Column, b: Column) -> Column:
    """0.0 when the denominator is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def ratio_epsilon(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1e-8))


def f1_or_nan(a: Column, b: Column) -> Column:
    """Harmonic mean; NaN if either is NaN or both are 0."""
    return F.when(F.isnan(a) | F.isnan(b) | (a + b == 0), F.lit(float("nan"))).otherwise(2 * a * b / (a + b))
