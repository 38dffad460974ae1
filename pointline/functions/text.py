"""Keyword rules over free text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CategoryRules = Sequence[tuple[str, Sequence[str]]]

# The keyword lists of the two categories, in test order.
SPORT_KEYWORDS = (
    "🏀", "hardworker", "entrainement", "basket", "victoire", "défaite", "weekend", "tournoi",
    "sélection", "arbitrage", "table de marque", "bonus sport", "pénalité sport",
)
ACADEMIC_KEYWORDS = (
    "📚", "scolaire", "classe", "observation", "félicitations", "compliments", "encouragements",
    "exclusion", "travail", "retard", "absence", "délégué", "sentinelle", "devoirs",
    "bonus scolaire", "pénalité scolaire",
)
# Keywords and texts used by awards, counters and audit rows.
PRAISE_KEYWORD = "Félicitations"
HARD_WORK_KEYWORD = "Hardworker"
REFEREE_KEYWORDS = ("table de marque", "arbitrage")
LATENESS_KEYWORDS = ("retard", "absence non justifiée")
VOLUNTEER_KEYWORDS = ("sentinelle", "atelier", "délégué", "conseil")
DEFAULT_ACTOR = "Anonyme"
SYSTEM_ACTOR = "Système"
BONUS_ACTION = "Badge débloqué: "
UNDO_ACTION = "Annulation: "
SENT_BACK = "Renvoyé"
TO_POOL = " vers la réserve"
DRAFTED_TO = "Drafté vers "
RENAMED = ('Nom changé de "', '" vers "', '"')

DEFAULT_RULES: CategoryRules = (("sport", SPORT_KEYWORDS), ("academic", ACADEMIC_KEYWORDS))


def contains_any(text: Column, keywords: Sequence[str], case_sensitive: bool = False) -> Column:
    """True where any keyword occurs; case folding is Unicode-aware and NULL text is False."""
    if not keywords:
        return F.lit(False)
    if not case_sensitive:
        text, keywords = F.lower(text), [k.lower() for k in keywords]
    return F.coalesce(reduce(lambda a, b: a | b, [text.contains(k) for k in keywords]), F.lit(False))


def classify(text: Column, rules: CategoryRules = DEFAULT_RULES, default: str = "unknown") -> Column:
    """Category of the first rule with a keyword in the text."""
    category = F
    for name, keywords in rules:
        category = category.when(contains_any(text, keywords), name)
    return category.otherwise(default)


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


def pseudonym_key(name: Column, salt: str) -> Column:
    """Six hex digits of a salted digest, written ``XXX-XXX``."""
    digest = F.upper(F.substring(F.md5(F.concat(F.lit(salt), F.lower(name))), 1, 6))
    return F.concat_ws("-", F.substring(digest, 1, 3), F.substring(digest, 4, 3))


def signed_label(points: Column) -> Column:
    """Default action text of a team-direct entry."""
    sign = F.when(points > 0, "+").otherwise("")
    return F.concat(F.lit("Points franchise ("), sign, points.cast("string"), F.lit(")"))


def one_decimal(value: Column) -> Column:
    """Whole numbers as they are, others with one decimal."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(
        F.format_string("%.1f", F.round(value, 1))
    )


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; 0 for a zero denominator."""
    return F.round(F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole), 1)


def renamed(old: Column, new: Column) -> Column:
    """What the ledger says of a rename."""
    before, between, after = map(F.lit, RENAMED)
    return F.concat(before, old, between, new, after)
