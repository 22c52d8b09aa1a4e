"""Ready-made brand definitions: filters, code aliases, friendly names and family rules.

Operators take these as arguments; pass your own to analyse another catalogue.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

from periodica.functions.rules import Rule
from periodica.functions.text import normalize_text


@dataclass(frozen=True)
class BrandFilter:
    """Which raw codes belong to a brand, decided on the normalised text.

    ``contains`` and ``excludes`` are substrings, ``prefixes`` and the regular expressions
    ``patterns`` apply from the start of the text.
    """

    contains: tuple[str, ...] = ()
    prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()

    def expression(self) -> str:
        """All conditions as one regular expression, so that a row's text is built once."""

        def any_of(tokens: Sequence[str]) -> str:
            return "(?:" + "|".join(re.escape(t) for t in tokens) + ")"

        accepted = [f".*{any_of(self.contains)}"] if self.contains else []
        accepted += [any_of(self.prefixes)] if self.prefixes else []
        accepted += [f"(?:{p})" for p in self.patterns]
        rejected = f"(?!.*{any_of(self.excludes)})" if self.excludes else ""
        return f"^{rejected}(?:{'|'.join(accepted)})"

    def matches(self, code: Column) -> Column:
        return self.matches_normalized(normalize_text(code))

    def matches_normalized(self, normal: Column) -> Column:
        return normal.rlike(self.expression())


@dataclass(frozen=True)
class Brand:
    filter: BrandFilter
    aliases: Mapping[str, str] = field(default_factory=dict)
    names: Mapping[str, str] = field(default_factory=dict)
    families: Sequence[Rule] = ()
    default_family: str = "Outras"


# ---------------------------------------------------------------------------------------------
# Fixed values. Everything below is data that results depend on: token lists, code maps and
# labels, in the order in which they apply.
# ---------------------------------------------------------------------------------------------

BRAND_A = Brand(
    filter=BrandFilter(
        contains=("HARLEY", "DAVIDSON"),
        prefixes=("H-D/", "H.DAVIDSON/"),
        excludes=("FORD",),
    ),
    aliases={
        "HARLEYDAVIDSON/FLHTCI": "HARLEY DAVIDSON/FLHTCI",
        "HARLEYDAVIDSON/FLHTK TRI": "HARLEY DAVIDSON FLHT TRI",
        "I/H. DAVIDSON FXR": "I/H.DAVIDSON FXR",
        "I/HARLEY DAVIDSON FATBOY": "H-D/FLFB",
    },
    families=(
        Rule("Adventure", text=("PAN AMERICA",), code=("RA1250",)),
        Rule(
            "Sportster",
            text=("SPORTSTER", "IRON 883", "IRON 1200", "FORTY-EIGHT", "ROADSTER", "NIGHTSTER"),
            code=("XL", "RH975", "RH1250", "XR1200"),
        ),
        Rule(
            "Touring",
            text=(
                "ROAD GLIDE", "STREET GLIDE", "ROAD KING", "ULTRA", "ELECTRA GLIDE", "TRI GLIDE",
                "FREEWHEELER", "LIMITED",
            ),
            code=("FLHX", "FLHT", "FLHR", "FLTR"),
        ),
        Rule(
            "Softail",
            text=(
                "FAT BOY", "BREAKOUT", "HERITAGE", "STREET BOB", "LOW RIDER", "SOFTAIL", "SLIM",
                "DELUXE", "SPRINGER", "ROCKER", "CROSS BONES",
            ),
            code=("FLST", "FLFB", "FLHC", "FXBB", "FXBR", "FXLRS", "FXSB", "FXST"),
        ),
        Rule("Dyna", text=("DYNA", "SWITCHBACK", "WIDE GLIDE", "SUPER GLIDE"), code=("FXD", "FLD")),
        Rule("V-Rod", text=("V-ROD", "NIGHT ROD", "MUSCLE"), code=("VRSC",)),
        Rule("Street", text=("STREET 750", "STREET 500"), code=("XG",)),
        Rule("Trike", text=("TRIKE",)),
    ),
    default_family="Outras familias",
)

CORE_FAMILIES_A = ("Touring", "Softail", "Sportster")

# Premium models: this token in the friendly name, or this ending of the code without spaces.
PREMIUM_NAME_TOKEN = "CVO"
PREMIUM_CODE_SUFFIX = "SE"
# Independent imports: prefixes of the code.
IMPORT_PREFIXES = ("I/", "IMP/")

BRAND_B = Brand(
    filter=BrandFilter(patterns=(r"^(I/)?INDIAN([ /-]|$)", r"^IMP/INDIAN([ /-]|$)")),
    names={
        "INDIAN/SCOUT": "Scout",
        "I/INDIAN SCOUT": "Scout",
        "I/INDIAN SCOUT BOBBER": "Scout Bobber",
        "INDIAN/CHIEF VINTAGE": "Chief Vintage",
        "I/INDIAN CHIEF VINTAGE": "Chief Vintage",
        "INDIAN/CHIEF CLASSIC": "Chief Classic",
        "INDIAN/CHIEF SPRINGFIELD": "Chief Springfield",
        "I/INDIAN CHIEF SPRINGFLD": "Chief Springfield",
        "INDIAN/CHIEF ROADMASTER": "Chief Roadmaster",
        "I/INDIAN CHIEF ROADMASTR": "Chief Roadmaster",
        "INDIAN/CHIEF CHIEFTAIN": "Chief Chieftain",
        "I/INDIAN CHIEF CHIEFTAIN": "Chief Chieftain",
        "I/INDIAN CHIEF CHIEFT DH": "Chief Chieftain Dark Horse",
        "I/INDIAN CHIEF DARKHORSE": "Chief Dark Horse",
        "I/INDIAN CHIEF": "Chief",
        "IMP/INDIAN": "Indian (Heritage Import)",
        "I/INDIAN BOARD TRACK RAC": "Board Track Racer",
        "I/INDIAN VINTAGE LE": "Vintage LE",
    },
    families=(
        Rule("Scout", text=("SCOUT",)),
        Rule("Springfield", text=("SPRINGFIELD",)),
        Rule("Roadmaster", text=("ROADMASTER",)),
        Rule("Chieftain", text=("CHIEFTAIN",)),
        Rule("Chief", text=("CHIEF", "DARKHORSE", "DARK HORSE", "VINTAGE", "CLASSIC")),
        Rule("FTR", text=("FTR",)),
        Rule("Heritage / Classic", equals=("IMP/INDIAN",), prefixes=("I/INDIAN CHIEF",)),
    ),
    default_family="Outras",
)
