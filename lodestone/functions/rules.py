"""Patterns, word lists and weights of the rule packs. All values here are fixed: results depend on them."""

from __future__ import annotations

from dataclasses import dataclass, field

# Numbers of results and conditions.
EE = r"(\d{1,3}(?:\.\d+)?)\s*%\s*ee"
YIELD = r"(\d{1,3}(?:\.\d+)?)\s*%\s*yield"
#: Is in a text if EE or YIELD is: of a number its last digit is enough.
RESULT = r"\d\s*%\s*(?:ee|yield)"
PRESSURE = r"(\d{1,4}(?:\.\d+)?)\s*(bar|atm|psi|MPa|kPa)\b"
PRESSURE_RAW = r"(\d{1,4}(?:\.\d+)?)\s*(?:bar|atm|psi|MPa|kPa)\s*(?:H2|hydrogen)?"
TEMPERATURE = r"(-?\d{1,3}(?:\.\d+)?)\s*°?C\b"
TEMPERATURE_PLAIN = r"(\d{1,3}(?:\.\d+)?)\s*°?C\b"
TIME = r"(\d{1,3}(?:\.\d+)?)\s*h(?:ours?|r)?\b"
TON = r"TON\s*(?:of|=|:)?\s*(\d+)"
TOF = r"TOF\s*(?:of|=|:)?\s*(\d+(?:\.\d+)?)\s*h\^?-?1"
HYDROGEN_WORD = r"\b(?:H2|H₂|hydrogen)\b"

# Pressure units in bar.
BAR = {"bar": 1.0, "atm": 1.01325, "psi": 0.0689476, "mpa": 10.0, "kpa": 0.01}

# Confidence in hundredths.
CONFIDENCE_BASE = 15
CONFIDENCE = {"ee_percent": 25, "yield_percent": 20, "h2_pressure_bar": 15, "temperature_c": 8, "reaction_time_h": 5, "ligand": 5, "substrate_class": 4}
CONFIDENCE_HYDROGEN = 3

# Vocabularies of evidence windows.
WINDOW_SOLVENTS = (
    "THF", "dichloromethane", "DCM", "methanol", "MeOH", "ethanol", "EtOH", "toluene", "acetonitrile", "MeCN", "DMF", "DMSO", "hexane", "heptane", "isopropanol", "iPrOH", "ethyl acetate", "diethyl ether", "chloroform", "dioxane",
)
WINDOW_LIGANDS = ("BINAP", "Xyl-BINAP", "Josiphos", "SEGPHOS", "BIPHEP", "SYNPHOS", "Mandyphos", "Chiraphos", "Me-BPE", "DuPhos", "DIOP", "DPPE", "DPPP", "DPPM", "Triphos")
WINDOW_SUBSTRATES = ("aryl ketone", "ketone", "imine", "alkene", "olefin", "aldehyde", "ester", "amide", "enamide", "enamine", "acetophenone", "quinoline", "pyridine")

# Vocabularies of whole papers.
PAPER_SOLVENTS = ("thf", "dichloromethane", "dcm", "methanol", "ethanol", "toluene", "acetonitrile", "dmf", "dmso", "hexane", "heptane", "isopropanol", "ethyl acetate", "diethyl ether", "chloroform", "dioxane")
PAPER_LIGANDS = (
    "bisphosphine", "diphosphine", "phosphine", "binap", "josiphos", "trost", "xyl-binap", "p-nh-p", "triphos", "dppp", "dppe", "dppm", "chiraphos", "biphep", "segphos", "synphos", "mandyphos", "chiral ligand", "atrop", "ferrocene",
)
PAPER_SUBSTRATES = ("ketone", "imine", "alkene", "olefin", "aldehyde", "ester", "acid", "amide", "lactone", "enamine", "enamide", "dehydroamino", "acetophenone", "aryl ketone")

# Texts that full-text screening looks for.
FULL_ASYMMETRIC = r"\b(?:asymmetric|enantioselective|enantioenriched|enantioselectivity|chiral)\b"
FULL_H2 = r"\b(?:molecular\s+hydrogen|hydrogen\s+gas|h(?:2|₂))\b"
FULL_SCOPE = r"\b(?:substrate\s+scope|scope\s+of\s+substrates|various\s+substrates|substrates?\s+were|examples?\s+were|table\s+\d+)\b"
FULL_TABLE = r"\b(?:table|scheme|figure|entry)\s+[A-Za-z0-9.-]+\b"
FULL_REVIEW = r"\b(?:review|overview|perspective|chapter)\b"
FULL_NON_PRIMARY = r"\b(?:machine\s+learning|high\s+throughput\s+experimentation|review|overview|perspective|chapter)\b"
FULL_HYDROGENATION = r"\bhydrogenation\b"
FULL_EE = (r"\b\d{1,3}(?:\.\d+)?\s*%\s*ee\b", r"\bee\s*(?:of|=|:|up\s+to)?\s*>?\s*\d{1,3}(?:\.\d+)?\s*%", r"\b\d{1,3}(?:\.\d+)?\s*%\s*(?:enantioselectivity|enantiomeric\s+excess)\b")
FULL_EXCLUSIONS = (
    ("transfer hydrogenation", r"\b(?:asymmetric\s+)?transfer\s+hydrogenation\b"),
    ("ATH", r"\bath\b"),
    ("hydrosilylation", r"\bhydrosilylation\b"),
    ("silane reagent", r"\b(?:silane|hsir3|phsih3|pmhs|tmds)\b"),
    ("hydroboration", r"\bhydroboration\b"),
    ("borane reagent", r"\b(?:ammonia\s+borane|borane|hbpin|hbcat|9[-\s]?bbn|catecholborane|bh3)\b"),
    ("NaBH4/KBH4/LiAlH4", r"\b(?:nabh4|kbh4|lialh4)\b"),
    ("formic acid", r"\b(?:formic\s+acid|hcooh)\b"),
    ("isopropanol", r"\b(?:isopropanol|i[-\s]?proh)\b"),
    ("Hantzsch ester", r"\bhantzsch\s+ester\b"),
    ("photocatalysis", r"\bphotocatal"),
    ("electrocatalysis", r"\belectrocatal"),
    ("borrowing hydrogen", r"\bborrowing\s+hydrogen\b"),
    ("DFT-only", r"\b(?:density\s+functional\s+theory|dft|first[-\s]principles?|computational\s+study)\b"),
)

# What landing pages say.
CHALLENGES = (
    ("anubis", ("anubis", "techaro", "proof of work", "拒绝访问", "哎呀糟糕了", "bot protection")),
    ("cloudflare", ("cloudflare", "ray id:", "请稍候", "just a moment", "checking your browser", "正在进行安全验证")),
    ("captcha", ("captcha", "i am not a robot", "recaptcha", "hcaptcha", "verify you are human")),
)
PAYWALL = (
    "purchase access", "buy this article", "buy article", "subscribe to read", "subscribe for access", "you do not have access", "full text is not available", "content is not available", "access denied", "full access required", "rent or buy", "get full access",
)
SUPPLEMENTARY = (
    "suppl_file", "suppl/", "supplementary", "_si_", "_si.", "-si.", "-si_", "supporting_information", "supporting-information", "supp_", "/supp.", "esm", "/esm.", "s1.pdf", "s2.pdf", "s3.pdf",
)

# Words that make a primary record a seed of the citation chase.
SEED_WORDS = ("iron", " fe ", "cobalt", " co ", "manganese", " mn ", "nickel", " ni ", "enantioselective", "asymmetric")


def words(vocabulary: tuple[str, ...]) -> str:
    """A pattern of whole words, the earliest in the text first, in the order of the list at one place."""
    import re

    return r"\b(?:" + "|".join(re.escape(w) for w in vocabulary) + r")\b"


def led_words(vocabulary: tuple[str, ...]) -> str:
    """The matches of words(), found faster: a letter that begins no word is passed over, and words are tried by their first letter.

    Only words with one first letter can match at one place, and these keep their order.
    """
    import re

    led: dict[str, list[str]] = {}
    for w in vocabulary:
        led.setdefault(w[:1].lower(), []).append(w[1:])
    if not all(c.isascii() and c.isalnum() for c in led) or not led:
        return words(vocabulary)
    return rf"(?=[{''.join(led)}])\b(?:" + "|".join(f"{c}(?:{'|'.join(map(re.escape, rest))})" for c, rest in led.items()) + r")\b"


@dataclass(frozen=True)
class ScreenPack:
    """Weighted signals, review words and exclusion terms of title and abstract screening. The default values are fixed."""

    name: str = "Iron"
    symbol: str = "Fe"
    metal: str = r"\b(?:iron(?:\(ii\)|\(iii\))?|fe(?:\(ii\)|\(iii\))?)\b"
    other_metal: str = r"\b(?:nickel|ni[-\s]?catalyzed|ruthenium|ru[-\s]?catalyzed|iridium| ir[-\s]?catalyzed|rhodium|rh[-\s]?catalyzed|cobalt|co[-\s]?catalyzed| manganese|mn[-\s]?catalyzed|palladium|pd[-\s]?catalyzed)\b"
    signals: tuple[tuple[str, int, str], ...] = (
        (r"\b(?:asymmetric|enantioselective|enantioenriched|chiral|\bee\b)\b", 20, "asymmetric or enantioselective wording"),
        (r"\bhydrogenation\b", 20, "hydrogenation"),
        (r"\b(?:molecular hydrogen|hydrogen gas|h2)\b", 20, "molecular H2 wording"),
        (r"\b(?:catalyst|ligand|yield|substrate|scope|pressure|\bee\b|synthesis|complex)\b", 15, "experimental detail wording"),
    )
    metal_points: int = 25
    h2: str = r"\b(?:molecular hydrogen|hydrogen gas|h2)\b"
    review: str = r"\b(?:review|perspective|overview|progress|advances?)\b"
    exclusions: tuple[str, ...] = ("transfer hydrogenation", "hydrosilylation", "hydroboration", "borrowing hydrogen", "photocatal", "electrocatal", "density functional theory")
    extra: dict = field(default_factory=dict)

    def all_signals(self) -> tuple[tuple[str, int, str], ...]:
        return ((self.metal, self.metal_points, f"{self.name.lower().capitalize()} / {self.symbol.upper()} catalyst"), *self.signals)


IRON = ScreenPack()
