"""Who may get a library card or pick up a pass, read from policy text with its verbatim evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline import fixed_values as fx
from weftline.functions.core import col, contains_any, grab, has, match_window, squeeze
from weftline.functions.text import is_bad_page

# broadest access first
_RULES = [(fx.MA_RESIDENT, "ma_resident"), (fx.OPEN_TO_ANYONE, "ma_resident"), (fx.TOWN_OR_WORKS, "town_or_works"),
          (fx.TOWN_RESIDENT, "town_resident"), (fx.NETWORK_CARD, "network")]


def classify_card_eligibility(c) -> Column:
    out = F.lit(None).cast("string")
    for pattern, value in _RULES:
        out = F.coalesce(out, F.when(has(c, pattern), F.lit(value)))
    return F.coalesce(out, F.lit("unknown"))


def eligibility_phrase(c) -> Column:
    """Verbatim statement behind the classification (30 characters before, 60 after); NULL for 'unknown'."""
    return F.coalesce(*[squeeze(match_window(c, pattern, 30, 60)) for pattern, _ in _RULES])


def classify_pass_pickup(c) -> Column:
    """Pickup policy; residency wording counts only in a sentence that also speaks of passes or reservations."""
    sentence = grab(c, fx.PASS_RESIDENCY_SENTENCE, 0)
    return (F.when(has(c, fx.WALK_IN), "walkin_for_nonresidents")
            .when(has(c, fx.TOWN_CARDHOLDER), "town_cardholder_only")
            .when(has(sentence, fx.MA_RESIDENT), "ma_resident")
            .when(has(sentence, fx.TOWN_RESIDENT) | has(sentence, fx.RESIDENTS_ONLY), "town_resident")
            .when(has(c, fx.NETWORK_CARD), "network").otherwise("unknown"))


def has_eligibility_cue(html, text) -> Column:
    """A real content page that states card eligibility."""
    cue = contains_any(F.lower(col(html)), fx.ELIGIBILITY_CUES)
    return ~is_bad_page(html) & (cue | (classify_card_eligibility(text) != "unknown"))
