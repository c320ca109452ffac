"""Reference, identifier and question normalisers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from tallyforge.functions.money import blank_to_null, strip

# The shapes of references and record ids.
REF_WORD = r"(?i)\b(REF\d+)\b"
REF_ANYWHERE = r"(REF\d+)"
STL_ID = r"(STL\d+)"
ORD_ID = r"(ORD\d+)"


def found(c: Column, pattern: str) -> Column:
    """First capture of ``pattern``, NULL when it does not occur."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def reference_key(c: Column) -> Column:
    """N5. Upper-case trimmed reference; NULL when blank."""
    return F.upper(blank_to_null(c))


def settlement_key(utr: Column, description: Column) -> Column:
    """N5 + N6. The reference, or the REF word of the description when it is missing."""
    empty = utr.isNull() | (utr == "")
    return reference_key(F.when(empty, found(description, REF_WORD)).otherwise(utr))


def group_reference(c: Column) -> Column:
    """N7. First REF number in the upper-cased text, else the whole text; NULL when blank."""
    upper = reference_key(c)
    return F.coalesce(found(upper, REF_ANYWHERE), upper)


def settlement_group_reference(utr: Column, description: Column) -> Column:
    """M6k. A REF in the description wins, then one in the reference, then either text."""
    return (
        F.when(F.upper(description).contains("REF"), group_reference(description))
        .when(F.upper(utr).contains("REF"), group_reference(utr))
        .otherwise(F.coalesce(group_reference(utr), group_reference(description)))
    )


def alnum_reference(c: Column) -> Column:
    """N14. Letters and digits only, zeros after REF removed."""
    kept = F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")
    return F.regexp_replace(kept, "REF0*", "REF")


def digit_key(c: Column) -> Column:
    """N15. Digits without leading zeros; '' when there are none."""
    return F.regexp_replace(F.regexp_replace(c, "[^0-9]", ""), "^0+", "")


def number_tokens(*cols: Column) -> Column:
    """All digit runs of the given texts, without the meaningless '0' and '00'."""
    runs = [F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+)"), 1) for c in cols]
    return F.array_except(F.concat(*runs), F.array(F.lit("0"), F.lit("00")))


def numbers_overlap(left: Column, right: Column) -> Column:
    """N16."""
    return F.arrays_overlap(left, right)


def question_entity(question: Column) -> Column:
    """N18. What a question asks about: struct(filter_type, value)."""
    upper, lower = F.upper(question), F.lower(question)

    def entity(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("filter_type"), value.alias("value"))

    stl, order, ref = (found(upper, p) for p in (STL_ID, ORD_ID, REF_ANYWHERE))
    return (
        F.when(stl.isNotNull(), entity("settlement_id", stl))
        .when(order.isNotNull(), entity("order_id", order))
        .when(ref.isNotNull(), entity("utr_reference", ref))
        .when(
            lower.contains("chargeback") | lower.contains("reversal"),
            entity("category_count", F.lit("chargeback")),
        )
        .otherwise(entity("general_query", strip(question)))
    )


def sorted_tokens(c: Column) -> Column:
    """Whitespace tokens in order, joined by one space (name comparison, case kept)."""
    return F.array_join(F.sort_array(F.split(strip(c), r"\s+")), " ")


def comparison_text(name: Column, description: Column, reference: Column) -> Column:
    """F7. 'name description reference', blanks kept as empty parts."""
    return strip(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (name, description, reference)]))


def substrings_of(c: Column, lengths: Sequence[int]) -> Column:
    """Distinct substrings of the given lengths, as an array."""

    def of_length(n: int) -> Column:
        return F.when(
            F.length(c) >= n,
            F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n))),
        ).otherwise(F.array().cast("array<string>"))

    if not lengths:
        return F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[of_length(n) for n in lengths]))
