"""Unit-bearing numbers inside free text, and their match against published values.

Whole texts are searched inside the JVM by one alternation, so each text is
read once; the unit is then read off the short literal itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number shape, and the literals in order of precedence. A euro
# amount directly followed by a unit price is left to the unit price. The
# leading look-ahead skips every character that cannot start a literal.
NUMBER = r"(?<![\w.%-])(?:-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)"
ANY_LITERAL = (
    r"(?=[€\d-])(?:"
    rf"€\s?{NUMBER}\s?M\b"
    rf"|€\s?{NUMBER}(?!\s?M\b)(?![\d,.])(?!\s?EUR/MWh)"
    rf"|{NUMBER}\s?(?:EUR/MWh|EUR\b(?!/)|%|hours\b)"
    r")"
)


def literal_unit(literal: Column) -> Column:
    """Unit of a matched literal, from its first and last characters."""
    return (
        F.when(F.startswith(literal, F.lit("€")), "EUR")
        .when(F.endswith(literal, F.lit("EUR/MWh")), "EUR/MWh")
        .when(F.endswith(literal, F.lit("EUR")), "EUR")
        .when(F.endswith(literal, F.lit("%")), "%")
        .otherwise("hours")
    )


def number_literals(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, literal, value, unit, tolerance`` for every number with a unit.

    The tolerance is half a unit of the last printed digit.
    """
    found = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.explode(F.regexp_extract_all(text, F.lit(ANY_LITERAL), F.lit(0))).alias("literal"),
    )
    literal = F.col("literal")
    plain = F.regexp_replace(F.regexp_extract(literal, r"-?\d[\d,]*(?:\.\d+)?", 0), ",", "")
    millions = F.startswith(literal, F.lit("€")) & F.endswith(literal, F.lit("M"))
    parsed = found.select(
        "doc_id", "literal", plain.alias("number"), literal_unit(literal).alias("unit"),
        F.when(millions, F.lit(1e6)).otherwise(F.lit(1.0)).alias("scale"),
    )
    decimals = F.length(F.regexp_extract("number", r"\.(\d+)$", 1))
    return parsed.select(
        "doc_id", "literal",
        (F.col("number").cast("double") * F.col("scale")).alias("value"),
        "unit",
        (F.lit(0.5) * F.pow(F.lit(10.0), -decimals) * F.col("scale") + F.lit(1e-9)).alias("tolerance"),
    )


def numbers_by_unit(numbers: DataFrame) -> DataFrame:
    """Numeric published values; shares are offered as percent as well."""
    typed = numbers.select("unit", F.expr("try_cast(value as double)").alias("v")).where("v is not null")
    shares = typed.where("unit = 'share'").select(F.lit("%").alias("unit"), (F.col("v") * 100).alias("v"))
    return typed.unionByName(shares)


def unmatched_literals(literals: DataFrame, numbers: DataFrame) -> DataFrame:
    """Literals without a published value of their unit within tolerance.

    A literal is a multiple of its last printed digit, and values within half a digit
    of it round to that multiple; at a tie they may round either way. So both sides
    meet by unit, digit and multiple: an equality join, however many numbers are
    published, in which no unit is a key of its own.
    """
    step = (F.col("tolerance") - F.lit(1e-9)) * 2
    rows = literals.withColumn("step", step).withColumn("multiple", F.round(F.col("value") / F.col("step")).cast("long"))
    steps = rows.select(F.col("unit").alias("u"), F.col("step").alias("s")).distinct()
    published = numbers_by_unit(numbers)
    at = F.col("v") / F.col("s")
    slack = F.lit(1e-9) / F.col("s") + F.lit(1e-6)
    around = F.array_distinct(F.array(*[F.round(at + d).cast("long") for d in (-slack, slack)]))
    cells = published.join(steps, published["unit"] == steps["u"]).select("u", "s", "v", F.explode(around).alias("m"))
    on = (
        (F.col("unit") == F.col("u")) & (F.col("step") == F.col("s")) & (F.col("multiple") == F.col("m"))
        & (F.abs(F.col("v") - F.col("value")) <= F.col("tolerance"))
    )
    return rows.join(cells, on, "left_anti").drop("step", "multiple")
