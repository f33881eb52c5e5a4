"""Languages, their codes and scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short code, model code, two-letter code.
LANGUAGES = (
    ("es", "spa_Latn", "es"), ("pt-BR", "por_Latn", "pt"), ("nl", "nld_Latn", "nl"), ("de", "deu_Latn", "de"), ("id", "ind_Latn", "id"),
    ("fr", "fra_Latn", "fr"), ("ar", "arb_Arab", "ar"), ("th", "tha_Thai", "th"), ("ja", "jpn_Jpan", "ja"), ("vi", "vie_Latn", "vi"),
    ("hi", "hin_Deva", "hi"), ("bn", "ben_Beng", "bn"), ("te", "tel_Telu", "te"), ("mr", "mar_Deva", "mr"), ("ta", "tam_Taml", "ta"),
    ("gu", "guj_Gujr", "gu"), ("ur", "urd_Arab", "ur"), ("kn", "kan_Knda", "kn"), ("ml", "mal_Mlym", "ml"), ("pa", "pan_Guru", "pa"),
)
# The character ranges of a script, by the script part of the model code.
SCRIPTS = {
    "Taml": r"\u0B80-\u0BFF", "Arab": r"\u0600-\u06FF\u0750-\u077F", "Thai": r"\u0E00-\u0E7F", "Jpan": r"\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FFF",
    "Deva": r"\u0900-\u097F", "Beng": r"\u0980-\u09FF", "Telu": r"\u0C00-\u0C7F", "Gujr": r"\u0A80-\u0AFF", "Knda": r"\u0C80-\u0CFF",
    "Mlym": r"\u0D00-\u0D7F", "Guru": r"\u0A00-\u0A7F",
}


def _lookup(pairs, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def model_code(value: Column) -> Column:
    """Model code of a short code; anything else, and whatever has an underscore, passes through."""
    known = _lookup([(code, model) for code, model, _ in LANGUAGES], value)
    return F.when(value.contains("_"), value).otherwise(F.coalesce(known, value))


def two_letter_code(model: Column) -> Column:
    head = F.substring(F.split(model, "_")[0], 1, 2)
    known = _lookup([(m, iso) for _, m, iso in LANGUAGES], model)
    return F.coalesce(known, F.nullif(head, F.lit("")), F.lit("es"))


def in_target_script(value: Column, model: str) -> Column:
    """A value that needs no translation: empty, or with a character of the target's script (Latin scripts have none)."""
    ranges = SCRIPTS.get(model.partition("_")[2]) if model in {m for _, m, _ in LANGUAGES} else None
    empty = F.coalesce(value, F.lit("")) == ""
    return empty | value.rlike(f"[{ranges}]") if ranges else empty
