"""Keyword lists for the multilingual sample texts of the driver tables."""

from __future__ import annotations

from dataclasses import replace

from promolens.vocabulary import Vocabulary

SAMPLE = replace(
    Vocabulary(),
    section_rules=(
        ("benefit", ("tion", "ment", "eau", "lich")),
        ("how", ("ing", "ich", "que", "aci")),
        ("notice", ("the ", "der ", "les ", "los ")),
        ("limit", ("and", "und", "et ", "con")),
        ("partner", ("able", "sch", "oi")),
        ("message", ("over", "über", "pour")),
        ("target", ("for", "für", "dans", "para")),
    ),
    section_hints=(
        ("notice", 2, ("thth", "derder")),
        ("limit", 2, ("inin", "auau")),
        ("how", 2, ("anan",)),
        ("target", 1, ("on",)),
    ),
    benefit_section="benefit",
    condition_sections=("how", "notice", "limit"),
    target_section="target",
    partner_section="partner",
    header_words=("The", "La", "Der"),
    notification_prefixes=("Er", "Re"),
    noise_words=("ouen", "queeau", "schei"),
    noise_rescue_words=("tion", "ment"),
    noise_always_words=("erer",),
    menu_words=("ble", "aux"),
    line_markers=("·", "•", "※", "|", ","),
)
