"""Quantity kinds and units as dimension tables, and what a description says of them.

The tables have a fixed size, so they are broadcast.  Missing evidence gives null:
no term, or equally long terms of different kinds.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import text
from lemmata.operators import graph

# Kind | dimension | further terms (the kind's own name is a term).
KINDS = """
length | length | wavelength, wave length, height, depth, height difference, depth difference, wall thickness
area | length^2 | surface area, cross-sectional area
duration | time | time, time variable, period, sampling period, signal period
mass | mass | inertial mass, scalar mass
velocity | length time^-1 | speed, point velocity, velocity vector, wave speed, propagation speed, exit speed, mean normal velocity
acceleration | length time^-2 | acceleration vector
force | length mass time^-2 | net force, applied force, force vector
pressure | length^-1 mass time^-2 | mechanical pressure
momentum | length mass time^-1 |
energy | length^2 mass time^-2 | kinetic energy, mechanical energy, electric potential energy, heat, sensible heat, work, system work, internal energy change, boundary work
power | length^2 mass time^-3 | mechanical power, instantaneous power, electric power, heat transfer rate
stiffness | mass time^-2 |
damping-coefficient | mass time^-1 |
electric-charge | electric-current time | charge, signed charge, test charge
capacitance | electric-current^2 length^-2 mass^-1 time^4 | capacitor capacitance
inductance | electric-current^-2 length^2 mass time^-2 |
electric-current | electric-current | current, branch current, capacitor current
voltage | electric-current^-1 length^2 mass time^-3 | voltage drop, terminal voltage, potential difference, electric potential
electric-field | electric-current^-1 length mass time^-3 | electric field strength, electric field symbol
resistance | electric-current^-2 length^2 mass time^-3 | electrical resistance, resistor resistance
frequency | time^-1 | cyclic frequency, angular frequency, sampling frequency, wave frequency
temperature | thermodynamic-temperature | thermodynamic temperature, temperature change, temperature difference
density | length^-3 mass | fluid density, mass density
specific-heat-capacity | length^2 time^-2 thermodynamic-temperature^-1 | specific heat
thermal-conductivity | length mass time^-3 thermodynamic-temperature^-1 |
volume | length^3 | control volume, fluid volume
mass-flow-rate | mass time^-1 | mass flow, mass rate, mass per unit time
volumetric-flow-rate | length^3 time^-1 | volume rate, volume flow, volumetric flow
dimensionless |  | dimensionless quantity, probability, scalar probability, pi, circle constant
"""

# Unit | symbol | dimension | further spellings.
UNITS = """
metre | m | length | meter, meters, metre, metres
second | s | time | second, seconds
kilogram | kg | mass | kilogram, kilograms
ampere | A | electric-current | ampere, amperes
kelvin | K | thermodynamic-temperature | kelvin, kelvins
metre-per-second | m/s | length time^-1 | meter per second, meters per second, metre per second, metres per second
metre-per-second-squared | m/s^2 | length time^-2 | meters per second squared, metres per second squared
newton | N | length mass time^-2 | newton, newtons
volt | V | electric-current^-1 length^2 mass time^-3 | volt, volts
ohm | \\Omega | electric-current^-2 length^2 mass time^-3 | ohm, ohms
hertz | Hz | time^-1 | hertz
"""


def _cells(table: str) -> list[list[str]]:
    return [[c.strip() for c in line.split("|")] for line in table.strip().splitlines()]


def dimension(short: str) -> dict[str, int]:
    """Exponents by base of a dimension such as ``length time^-1``."""
    parts = (p.partition("^") for p in short.split())
    return {b: int(e or 1) for b, _, e in parts}


def dimension_name(exponents: dict) -> str:
    """Exponents as ``length:1/1 time:-2/1``."""
    return " ".join(f"{b}:{e.numerator}/{e.denominator}" for b, e in sorted(exponents.items()) if e)


def named_dimension(name: str) -> dict[str, Fraction]:
    """The exponents that ``dimension_name`` spells."""
    return {b: Fraction(e) for b, _, e in (part.partition(":") for part in name.split())}


KIND_DIMENSION = {k: dimension(d) for k, d, _ in _cells(KINDS)}
UNIT_DIMENSION = {u: dimension(d) for u, _, d, _ in _cells(UNITS)}


def kinds(spark: SparkSession) -> DataFrame:
    """(kind, dimension)."""
    return spark.createDataFrame([(k, dimension_name(d)) for k, d in KIND_DIMENSION.items()], "kind string, dimension string")


def units(spark: SparkSession) -> DataFrame:
    """(unit, symbol, dimension)."""
    return spark.createDataFrame([(u, s, dimension_name(dimension(d))) for u, s, d, _ in _cells(UNITS)], "unit string, symbol string, dimension string")


def kind_terms(spark: SparkSession) -> DataFrame:
    """(kind, term), terms normalised as descriptions are."""
    rows = {(k, t.replace("-", " ").strip()) for k, _, more in _cells(KINDS) for t in (k, *more.split(",")) if t.strip()}
    return spark.createDataFrame(sorted(rows), "kind string, term string")


def unit_of(description: Column) -> Column:
    """The unit that follows "in", "measured in", "unit" or "units of" as a whole word; the longest spelling counts."""
    rows = sorted(_cells(UNITS), key=lambda r: -max(len(r[1]), *(len(a) for a in r[3].split(","))))

    def says(symbol: str, more: str) -> Column:
        spelt = "|".join(sorted((a.strip() for a in more.split(",")), key=len, reverse=True))
        return description.rlike(rf" (?:in|measured in|unit|units of) (?:\Q{symbol}\E|(?i:{spelt}))(?![A-Za-z0-9/^]| per | squared)")

    return F.coalesce(*(F.when(says(symbol, more), F.lit(unit)) for unit, symbol, _, more in rows))


def said(df: DataFrame, description_col: str) -> DataFrame:
    """(description, kind, unit, code) of each distinct description: the kind of the longest term, null at a tie; code tells a unit of another dimension."""
    spark, d = df.sparkSession, description_col
    each = df.select(d).distinct()
    named = each.select(d, F.regexp_replace(d, r" (?:along|through|across|normal to) [\s\S]*", "").alias("_said"))
    terms = kind_terms(spark)
    found = text.contained_terms(named, d, F.col("_said"), terms.select("term").distinct(), "term").join(F.broadcast(terms), "term")
    best = found.groupBy(d).agg(F.max(F.struct(F.length("term"), "kind")).alias("hi"), F.max(F.length("term")).alias("top"), F.collect_set(F.struct(F.length("term").alias("n"), "kind")).alias("all"))
    clear = F.size(F.filter("all", lambda e: e["n"] == F.col("top"))) == 1
    best = best.select(d, F.when(clear, F.col("hi.kind")).alias("kind"))
    out = each.select(d, unit_of(F.col(d)).alias("unit")).join(graph.large(best), d, "left")
    out = out.join(F.broadcast(kinds(spark).withColumnRenamed("dimension", "_k")), "kind", "left").join(F.broadcast(units(spark).select("unit", F.col("dimension").alias("_u"))), "unit", "left")
    return graph.small(graph.stored(out.select(d, "kind", "unit", F.when(F.col("_k") != F.col("_u"), F.lit("quantity-unit-dimension-mismatch")).alias("code"))))


def described(df: DataFrame, id_col: str, description_col: str) -> DataFrame:
    """(id, kind, unit, code) of each row, by its description."""
    return df.select(id_col, description_col).join(said(df, description_col), description_col, "left").select(id_col, "kind", "unit", "code")
