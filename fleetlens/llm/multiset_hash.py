"""Document fingerprints as a homomorphic hash of the multiset of paragraphs. Native expressions only.

A paragraph is hashed to a vector of ``LANES`` numbers modulo 2**32, and a document is the sum of the
vectors of its paragraphs, lane by lane, with their count in front. So the order of paragraphs plays no
part, and inserting or deleting paragraphs adds or subtracts their sum without the rest of the text.

A paragraph's number in a lane is 16 random bits above a 1 or -1 (modulo 2**16). Equality is decided on
all bits. The lower halves also tell how far two documents are apart: in the difference of two
fingerprints the signs of common paragraphs cancel, and the square of what is left in a lane
is, on average, the number of paragraphs that only one of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 64
#: Lanes of one SHA-512 value, eight hex digits each.
PER_HASH = 16
MASK = (1 << 32) - 1
HALF = 1 << 16
#: What Java's regular expressions and trim call ASCII white space.
BLANKS = " \t\n\r\x0b\x0c"


def paragraphs(text: Column) -> Column:
    """Lines of the text that are not blank, without the white space around them."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.btrim(p, F.lit(BLANKS)))
    return F.filter(lines, lambda p: p != "")


def _lanes(paragraph: Column) -> Column:
    """The vector of one paragraph, behind a one that counts it."""
    digests = F.array(
        *[F.sha2(F.concat(F.lit(f"{i}:"), paragraph), 512) for i in range(LANES // PER_HASH)]
    )
    pieces = F.flatten(F.transform(digests, lambda d: F.regexp_extract_all(d, F.lit("(.{8})"), 1)))

    def lane(piece: Column) -> Column:
        value = F.conv(piece, 16, 10).cast("long")
        # The lowest bit becomes the sign; bits 1 to 15 play no part.
        high = F.shiftrightunsigned(value, 16) * HALF
        return high + F.when(value % 2 == 0, F.lit(1)).otherwise(F.lit(HALF - 1))

    return F.concat(F.array(F.lit(1).cast("long")), F.transform(pieces, lane))


def empty() -> Column:
    return F.array_repeat(F.lit(0).cast("long"), LANES + 1)


def add(a: Column, b: Column) -> Column:
    """Vector of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MASK)))


def subtract(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(MASK)))


def of_paragraphs(listed: Column) -> Column:
    """Vector of an array of paragraphs: their count, then the sums of their lanes."""
    return F.aggregate(listed, empty(), lambda total, p: add(total, _lanes(p)))


def vector(text: Column) -> Column:
    """Vector of a whole text; a null text and a blank one have no paragraph and are all zeros."""
    return of_paragraphs(paragraphs(text))


def fingerprint(vector: Column) -> Column:
    """Text of a vector: eight hex digits for the count and for each lane."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def from_fingerprint(text: Column) -> Column:
    """The vector that ``fingerprint`` wrote."""
    pieces = F.regexp_extract_all(text, F.lit("(.{8})"), 1)
    return F.transform(pieces, lambda p: F.conv(p, 16, 10).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """Common share of two multisets of paragraphs, from their vectors alone; 1 if these are equal.

    With ``n`` paragraphs in both and an estimate ``d`` of those that one has and the other has not, it
    is (n - d) / (n + d), cut to 0 .. 1: common over all. The estimate is the mean over the lanes, so it is
    off by about a sixth of ``d``; it is exact for one paragraph, and 0 or 1 result exactly where
    the documents share nothing and have one paragraph together, or are equal.
    """

    def signed(x: Column) -> Column:
        low = x.bitwiseAND(F.lit(HALF - 1))
        return F.when(low >= HALF // 2, low - HALF).otherwise(low).cast("double")

    gaps = F.slice(subtract(a, b), 2, LANES)
    squares = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + signed(x) * signed(x))
    apart = squares / LANES
    count = (F.element_at(a, 1) + F.element_at(b, 1)).cast("double")
    share = F.try_divide(count - apart, count + apart)
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0))))
    )


def with_fingerprints(rows: DataFrame, text: str = "text", out: str = "vector") -> DataFrame:
    """``rows`` with the vector of each text. Equal texts, and texts with equal paragraphs in any order,
    have equal vectors. Other columns stay, a column named ``out`` is replaced, repeated rows are
    answered each, an empty table stays empty. Nothing is shuffled."""
    return rows.withColumn(out, vector(F.col(text).cast("string")))


def insert(stored: Column, added: Column) -> Column:
    """Vector after the paragraphs in the array ``added`` came in; null counts as none."""
    return add(stored, of_paragraphs(F.coalesce(added, F.array().cast("array<string>"))))


def delete(stored: Column, removed: Column) -> Column:
    """Vector after the paragraphs in the array ``removed`` went; null counts as none."""
    return subtract(stored, of_paragraphs(F.coalesce(removed, F.array().cast("array<string>"))))
