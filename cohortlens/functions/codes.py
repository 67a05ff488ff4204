"""Diagnosis-code and drug-name predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Target diagnosis (dots removed, upper case).
TARGET_ICD10_PREFIX = "F431"
TARGET_ICD9_CODE = "30981"

# Codes that rule a subject out of the drug-defined group.
EXCLUSION_PREFIXES = ["I10", "N40", "I7300", "S06"]

# Comorbidity prefixes, ICD-10 then ICD-9.
COMORBIDITY_PREFIXES = {
    "dx_MDD": ["F32", "F33", "296"],
    "dx_anxiety": ["F41", "300"],
    "dx_SUD": [
        "F10", "F11", "F12", "F13", "F14", "F15", "F16", "F17", "F18", "F19",
        "303", "304", "305",
    ],
    "dx_TBI": [
        "S06", "800", "801", "802", "803", "804", "850", "851", "852", "853", "854",
    ],
    "dx_pain": ["G89", "338"],
    "dx_suicidal": ["R458", "V6284", "E95"],
}

# Lower-case drug-name substrings.
DRUG_SUBSTRINGS = {
    "rx_ssri_snri": [
        "sertraline", "fluoxetine", "paroxetine", "escitalopram", "citalopram",
        "fluvoxamine", "venlafaxine", "duloxetine", "desvenlafaxine",
        "levomilnacipran", "milnacipran",
    ],
    "rx_prazosin": ["prazosin"],
    "rx_SGA": [
        "quetiapine", "olanzapine", "risperidone", "aripiprazole", "ziprasidone",
        "clozapine", "lurasidone", "asenapine", "paliperidone", "iloperidone",
        "brexpiprazole", "cariprazine",
    ],
}

# Codes that define the psychiatric control group.
CONTROL_PREFIXES = COMORBIDITY_PREFIXES["dx_MDD"] + COMORBIDITY_PREFIXES["dx_anxiety"]


def normalise_code(code: Column) -> Column:
    """Trimmed, dot-free, upper-case diagnosis code."""
    return F.upper(F.replace(F.trim(code), F.lit("."), F.lit("")))


def is_target_code(code: Column, version: Column) -> Column:
    """Version-aware target-diagnosis predicate over a normalised code."""
    version = F.trim(version)
    return ((version == "10") & code.startswith(TARGET_ICD10_PREFIX)) | (
        (version == "9") & (code == TARGET_ICD9_CODE)
    )


def is_target_code_any_version(code: Column) -> Column:
    """Target diagnosis when the coding version is not known."""
    return code.startswith(TARGET_ICD10_PREFIX) | (code == TARGET_ICD9_CODE)


def has_prefix(code: Column, prefixes: Sequence[str]) -> Column:
    """True when a normalised code starts with any of ``prefixes``."""
    return code.rlike("^(" + "|".join(re.escape(p) for p in prefixes) + ")")


def is_code(code: Column, *exact: str) -> Column:
    """True when a normalised code equals one of ``exact``."""
    return code.isin(list(exact))


def drug_matches(drug: Column, substrings: Sequence[str]) -> Column:
    """Case-insensitive substring match; a missing drug name never matches."""
    pattern = "|".join(re.escape(s) for s in substrings)
    return F.lower(F.coalesce(drug, F.lit(""))).rlike(pattern)


def not_blank(text: Column) -> Column:
    """False for null and for whitespace-only text."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) > 0
