"""The periodic table as a small static dimension.

Element values are fixed; period, group, valence electrons, type and state follow
from the atomic number. Isotopes beyond the major one of each element are a
parameter (a table of z, mass_number, weight, abundance).
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values, by atomic number from 0 (a placeholder) to 118.
SYMBOLS = """
Xx H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I
Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf
Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og
"""
NAMES = """
Dummy Hydrogen Helium Lithium Beryllium Boron Carbon Nitrogen Oxygen Fluorine Neon Sodium Magnesium Aluminium Silicon Phosphorus Sulfur Chlorine Argon
Potassium Calcium Scandium Titanium Vanadium Chromium Manganese Iron Cobalt Nickel Copper Zinc Gallium Germanium Arsenic Selenium Bromine Krypton
Rubidium Strontium Yttrium Zirconium Niobium Molybdenum Technetium Ruthenium Rhodium Palladium Silver Cadmium Indium Tin Antimony Tellurium Iodine
Xenon Caesium Barium Lanthanum Cerium Praseodymium Neodymium Promethium Samarium Europium Gadolinium Terbium Dysprosium Holmium Erbium Thulium
Ytterbium Lutetium Hafnium Tantalum Tungsten Rhenium Osmium Iridium Platinum Gold Mercury Thallium Lead Bismuth Polonium Astatine Radon Francium
Radium Actinium Thorium Protactinium Uranium Neptunium Plutonium Americium Curium Berkelium Californium Einsteinium Fermium Mendelevium Nobelium
Lawrencium Rutherfordium Dubnium Seaborgium Bohrium Hassium Meitnerium Darmstadtium Roentgenium Copernicium Nihonium Flerovium Moscovium Livermorium
Tennessine Oganesson
"""
WEIGHTS = """
0.0 1.0080 4.002602 6.94 9.0121831 10.81 12.011 14.007 15.999 18.998403162 20.1797 22.98976928 24.305 26.9815384 28.085 30.973761998 32.06 35.45 39.95
39.0983 40.078 44.955907 47.867 50.9415 51.9961 54.938043 55.845 58.933194 58.6934 63.546 65.38 69.723 72.630 74.921595 78.971 79.904 83.798 85.4678
87.62 88.905838 91.224 92.90637 95.95 97 101.07 102.90549 106.42 107.8682 112.414 114.818 118.710 121.760 127.60 126.90447 131.293 132.90545196
137.327 138.90547 140.116 140.90766 144.242 145 150.36 151.964 157.25 158.925354 162.500 164.930329 167.259 168.934219 173.045 174.9668 178.486
180.94788 183.84 186.207 190.23 192.217 195.084 196.966570 200.592 204.38 207.2 208.98040 209 210 222 223 226 227 232.0377 231.03588 238.02891 237 244
243 247 247 251 252 257 258 259 266 267 268 269 270 269 277 281 282 285 286 290 290 293 294 294
"""
COVALENT_RADII = """
0.16 0.31 0.28 1.28 0.96 0.84 0.76 0.71 0.66 0.57 0.58 1.66 1.41 1.21 1.11 1.07 1.05 1.02 1.06 2.03 1.76 1.70 1.60 1.53 1.39 1.55 1.48 1.29 1.24 1.32
1.22 1.22 1.20 1.19 1.20 1.20 1.16 2.20 1.95 1.90 1.75 1.64 1.54 1.47 1.46 1.42 1.39 1.45 1.44 1.42 1.39 1.39 1.38 1.39 1.40 2.44 2.15 2.07 2.04 2.03
2.01 1.99 1.98 1.98 1.96 1.94 1.92 1.92 1.89 1.90 1.87 1.87 1.75 1.70 1.62 1.51 1.44 1.41 1.36 1.36 1.32 1.45 1.46 1.48 1.40 1.50 1.50 2.60 2.21 2.15
2.06 2.00 1.96 1.90 1.87 1.80 1.69 1.68 1.68 1.65 1.67 1.73 1.76 1.61 1.57 1.49 1.43 1.41 1.34 1.29 1.28 1.21 1.22 1.36 1.43 1.62 1.75 1.65 1.57
"""
VDW_RADII = """
0.60 1.20 1.43 2.12 1.98 1.91 1.77 1.66 1.50 1.46 1.58 2.50 2.51 2.25 2.19 1.90 1.89 1.82 1.83 2.73 2.62 2.58 2.46 2.42 2.45 2.45 2.44 2.40 2.40 2.38
2.39 2.32 2.29 1.88 1.82 1.86 2.25 3.21 2.84 2.75 2.52 2.56 2.45 2.44 2.46 2.44 2.15 2.53 2.49 2.43 2.42 2.47 1.99 2.04 2.06 3.48 3.03 2.98 2.88 2.92
2.95 2.5 2.90 2.87 2.83 2.79 2.87 2.81 2.83 2.79 2.80 2.74 2.63 2.53 2.57 2.49 2.48 2.41 2.29 2.32 2.45 2.47 2.60 2.54 2.5 2.5 2.5 3.0 3.0 2.8 2.93
2.88 2.71 2.82 2.81 2.83 3.05 3.4 3.05 2.7 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0 3.0
"""
# -1 stands for no value.
ELECTRONEGATIVITIES = """
-1.0 2.20 -1.0 0.98 1.57 2.04 2.55 3.04 3.44 3.98 -1.0 0.93 1.31 1.61 1.90 2.19 2.58 3.16 -1.0 0.82 1.00 1.36 1.54 1.63 1.66 1.55 1.83 1.88 1.91 1.90
1.65 1.81 2.01 2.18 2.55 2.96 3.00 0.82 0.95 1.22 1.33 1.6 2.16 1.9 2.2 2.28 2.20 1.93 1.69 1.78 1.96 2.05 2.1 2.66 2.6 0.79 0.89 1.10 1.12 1.13 1.14
-1.0 1.17 -1.0 1.20 -1.0 1.22 1.23 1.24 1.25 -1.0 1.27 1.3 1.5 2.36 1.9 2.2 2.20 2.28 2.54 2.00 1.62 2.33 2.02 2.0 2.2 -1.0 0.7 0.9 1.1 1.3 1.5 1.38
1.36 1.28 1.3 1.3 1.3 1.3 1.3 1.3 1.3 1.3 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0 -1.0
"""
MAJOR_ISOTOPES = """
0 1 4 7 9 11 12 14 16 19 20 23 24 27 28 31 32 35 40 39 40 45 48 51 52 55 56 59 58 63 64 69 74 75 80 79 84 85 88 89 90 93 98 97 102 103 106 107 114 115
120 121 130 127 132 133 138 139 140 141 142 145 152 153 158 159 164 165 166 169 174 175 180 181 184 187 192 193 195 197 202 205 208 209 209 210 222
223 226 227 232 231 238 237 244 243 247 247 251 252 257 258 259 266 267 268 269 270 269 277 281 282 285 286 290 290 293 294 294
"""
NONMETALS = {1, 6, 7, 8, 15, 16, 34}
METALLOIDS = {5, 14, 32, 33, 51, 52, 84}
GASES = {1, 7, 8, 9, 17}
LIQUIDS = {35, 80}


class Element(NamedTuple):
    z: int
    symbol: str
    name: str
    period: int
    grp: int
    valence: int
    weight: float
    cov_radius: float
    vdw_radius: float
    eneg: float
    kind: str
    state: str
    main_group: bool
    major_isotope: int


def period_and_group(z: int) -> tuple[int, int]:
    """By the noble gases before z; the f-block is in group 3."""
    if z == 0:
        return 0, 0
    ends = (0, 2, 10, 18, 36, 54, 86, 118)
    period = next(p for p in range(1, 8) if z <= ends[p])
    place, left = z - ends[period - 1], ends[period] - z
    if place <= 2 and z != 2:
        return period, place
    if period >= 6 and left >= 15:
        return period, 3
    return period, 18 - left


def _valence(z: int, period: int, group: int) -> int:
    """Outer electrons; of the f-block those since the last noble gas, but 3 where the f-shell is full."""
    first = {6: 57, 7: 89}.get(period, 999)
    if group == 3 and z >= first:
        return 3 if z == first + 14 else z - first + 3
    return 2 if z == 2 else group if group <= 12 else group - 10


@lru_cache
def periodic_table() -> tuple[Element, ...]:
    out, columns = [], [x.split() for x in (SYMBOLS, NAMES, WEIGHTS, COVALENT_RADII, VDW_RADII, ELECTRONEGATIVITIES, MAJOR_ISOTOPES)]
    for z, (symbol, name, weight, cov, vdw, eneg, iso) in enumerate(zip(*columns, strict=True)):
        period, group = period_and_group(z)
        kind = "unknown" if z == 0 else "nonmetal" if group >= 17 or z in NONMETALS else "metalloid" if z in METALLOIDS else "metal"
        state = "unknown" if z == 0 else "gas" if group == 18 or z in GASES else "liquid" if z in LIQUIDS else "solid"
        out.append(Element(z, symbol, name, period, group, _valence(z, period, group), float(weight), float(cov), float(vdw), float(eneg), kind, state, group < 3 or group > 12, int(iso)))
    return tuple(out)


def find_element(key: int | str) -> Element | None:
    """By atomic number, symbol or name; text is compared without case."""
    if isinstance(key, int):
        return periodic_table()[key] if 0 <= key < len(periodic_table()) else None
    return next((e for e in periodic_table() if key.upper() in (e.symbol.upper(), e.name.upper())), None)


@lru_cache
def by_symbol() -> dict[str, Element]:
    return {e.symbol: e for e in periodic_table()}


SCHEMA = T.StructType([
    T.StructField(n, k) for n, k in zip(Element._fields, (T.IntegerType(), T.StringType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType(), *[T.DoubleType()] * 4, T.StringType(), T.StringType(), T.BooleanType(), T.IntegerType()), strict=True)
])


def elements(spark: SparkSession) -> DataFrame:
    """The 119 elements; small enough to broadcast by its fixed size."""
    return spark.createDataFrame([tuple(e) for e in periodic_table()], SCHEMA)
