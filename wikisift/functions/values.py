"""Number parsing and conflict resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wikisift.functions.expr import is_blank, let

# Number words and clock speed units.
NUMBER_WORDS = {"sixteen": 16.0, "single": 1.0, "four": 4.0}
UNIT_HERTZ = {"hz": 1e0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9}
INT_MIN, INT_MAX = -2147483648.0, 2147483647.0


def _lookup(key: Column, table: dict[str, float]) -> Column:
    result = F.when(F.lit(False), F.lit(0.0))
    for word, number in table.items():
        result = result.when(key == word, F.lit(number))
    return result


def parse_number(text: Column) -> Column:
    """A double; a few number words are known, anything unreadable is +Infinity (P10)."""
    word = _lookup(F.lower(text), NUMBER_WORDS)
    return F.when(
        text.isNotNull(), F.coalesce(word, text.try_cast("double"), F.lit(float("inf")))
    )


def clock_hertz(text: Column) -> Column:
    """``"1.5 MHz"`` to 1500000.0; a unit other than Hz/kHz/MHz/GHz raises."""

    def convert(parts: Column) -> Column:
        unit = F.lower(F.get(parts, F.lit(1)))
        factor = _lookup(unit, UNIT_HERTZ)
        bad = F.raise_error(F.concat(F.lit("Invalid clock speed "), text)).cast("double")
        return parse_number(F.get(parts, F.lit(0))) * F.coalesce(factor, bad)

    return F.when(text.isNotNull(), let(F.split(text, " ", -1), convert))


def to_int_saturating(number: Column) -> Column:
    """Truncate towards zero into a 32-bit int; out-of-range values stop at its ends, NaN is 0."""
    bounded = F.greatest(F.least(F.nanvl(number, F.lit(0.0)), F.lit(INT_MAX)), F.lit(INT_MIN))
    return F.when(number.isNotNull(), bounded.cast("int"))


def most_frequent(numbers: Column) -> Column:
    """Most frequent element of an ``array<double>``, the smallest on a tie, NULL when empty."""
    state = "struct<best:double,best_n:bigint,last:double,last_n:bigint>"
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).cast("bigint").alias("best_n"),
        F.lit(None).cast("double").alias("last"),
        F.lit(0).cast("bigint").alias("last_n"),
    ).cast(state)

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["last_n"] + 1).otherwise(F.lit(1).cast("bigint"))
        return let(
            run,
            lambda n: F.struct(
                F.when(n > acc["best_n"], x).otherwise(acc["best"]).alias("best"),
                F.greatest(n, acc["best_n"]).alias("best_n"),
                x.alias("last"),
                n.alias("last_n"),
            ),
        ).cast(state)

    return F.aggregate(F.sort_array(numbers), start, step, lambda acc: acc["best"])


def attribute_values(attributes: Column, name: str) -> Column:
    """All values of one attribute of an ``array<struct<name,value>>``, in order."""
    kept = F.filter(attributes, lambda a: a["name"] == name)
    return F.transform(kept, lambda a: a["value"])


def preferred_values(attributes: Column, name: str) -> Column:
    """The sure values of an attribute if there are any, else the doubtful ``name?`` ones."""
    return let(
        attribute_values(attributes, name),
        lambda sure: F.when(F.size(sure) > 0, sure).otherwise(attribute_values(attributes, name + "?")),
    )


def attributes_to_string(attributes: Column) -> Column:
    """Tab-separated ``name:value`` form of an attribute array."""
    return F.array_join(
        F.transform(attributes, lambda a: F.concat(F.coalesce(a["name"], F.lit("null")), F.lit(":"), a["value"])), "\t"
    )


def attributes_from_string(text: Column, strict: bool = False) -> Column:
    """Parse the tab-separated form (P12): split each entry at its first colon.

    Entries without a colon and those with a blank name or value are skipped; with
    ``strict`` an empty name or value raises, as only a broken rule makes one.
    """
    entries = F.filter(F.split(text, "\t", -1), lambda e: F.contains(e, F.lit(":")))
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(e, r"^([^:]*+):", 1).alias("name"),
            F.regexp_extract(e, r"(?s)^[^:]*+:(.*)$", 1).alias("value"),
        ),
    )
    if strict:
        pairs = F.transform(
            pairs,
            lambda p: F.when(
                (p["name"] == "") | (p["value"] == ""),
                F.raise_error(F.concat(F.lit("Empty name or value in "), p["name"], F.lit(":"), p["value"])),
            ).otherwise(p),
        )
    return drop_blank_attributes(pairs)


def drop_blank_attributes(attributes: Column) -> Column:
    return F.filter(attributes, lambda a: ~is_blank(a["name"]) & ~is_blank(a["value"]))


def technology(tech: Column) -> tuple[Column, Column]:
    """(architecture, logic) of a list of technology flags."""
    architecture = F.when(F.array_contains(tech, "serial"), "serial").otherwise("parallel")
    logic = (
        F.when(F.array_contains(tech, "vacuum-tubes"), "vacuum-tubes")
        .when(F.array_contains(tech, "electro-mechanical"), "electro-mechanical")
        .otherwise("transistor")
    )
    return architecture, logic
