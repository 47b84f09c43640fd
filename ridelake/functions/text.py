"""Text normalisation as Spark column expressions.

Everything here stays on the JVM. Missing text is NULL; the one exception is
``fold_text``, whose contract is the empty string.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters dropped before labels are compared or blanks detected.
ZERO_WIDTH = "\u200b\ufeff"

# Known corruptions in which an accented letter arrived as a question mark.
QUESTION_MARK_REPAIRS = {
    "regularizaci?n": "regularizacion",
    "m?smetro": "masmetro",
    "t?tulo": "titulo",
}

# Folded ticket-validation text -> canonical validation type.
VALIDATION_TYPES = {
    "primera entrada": "primera_entrada",
    "primera salida": "primera_salida",
    "entrada multiviaje": "entrada_multiviaje",
    "salida multiviaje": "salida_multiviaje",
    "transbordo sencillo": "transbordo_sencillo",
    "regularizacion en salida": "regularizacion_en_salida",
    "regularizacion sencilla": "regularizacion_sencilla",
    "regularizacion sencilla transbordo": "regularizacion_sencilla",
    "regularizacion multiviaje": "regularizacion_multiviaje",
    "regularizacion multiviaje en salida": "regularizacion_multiviaje",
    "transbordo multiviaje": "transbordo_multiviaje",
    "regularizacion multiviaje transbordo": "regularizacion_multiviaje_transbordo",
}
UNKNOWN_VALIDATION_TYPE = "desconocida"

# Ticket titles that count as demand.
TICKET_TITLES = [
    "Monedero Consorcio",
    "Monedero Metro Malaga",
    "Monedero Metro Malaga PVC",
    "Billete ocasional",
    "Monedero Consorcio para Familia Numerosa",
    "Monedero Consorcio FN",
    "Monedero EMV",
    "MásMetro",
    "Monedero ABT",
    "Título Promocional",
]

# Parts of a canonical type that make a validation a trip.
TRIP_MARKERS = ["entrada", "regularizacion", "transbordo"]

# Station code aliases and the codes always treated as shared.
STATION_ALIASES = {"PBI": "PBL"}
ALWAYS_SHARED_CODES = ["GDL", "PCH"]


#: Compatibility ligatures of Latin letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn"}


def _accent_pairs() -> tuple[str, str]:
    """Letters of the basic multilingual plane that decompose to one base letter."""
    accented, plain = [], []
    for point in range(0x00A0, 0xFFFE):
        char = chr(point)
        if 0xD800 <= point <= 0xDFFF or not unicodedata.decomposition(char):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if base != char and len(base) == 1:
            accented.append(char)
            plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accent_pairs()


def plain_fold(text: str) -> str:
    """Driver-side twin of ``fold_text`` for the keys of the small dictionaries above."""
    decomposed = unicodedata.normalize("NFKD", text)
    bare = "".join(c for c in decomposed if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[_-]", " ", bare).split())


def lookup(keys: Column, table: dict[str, str]) -> Column:
    """Value of ``table`` for each key, NULL when absent, as a literal map."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), keys)


def strip_accents(text: Column) -> Column:
    """Letters without their accents, whether composed or combining; ligatures are spelled out.

    Plain ASCII, the usual case, is left alone.
    """
    spelled = F.translate(text, ACCENTED, PLAIN)
    for ligature, letters in LIGATURES.items():
        spelled = F.replace(spelled, F.lit(ligature), F.lit(letters))
    bare = F.regexp_replace(spelled, "\\p{Mn}", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), bare).otherwise(text)


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 bytes that were read as Latin-1; other text passes unchanged.

    Only text that fits Latin-1 and whose bytes form valid UTF-8 is changed. Characters
    outside Latin-1 are masked before encoding so that no row can raise.
    """
    as_bytes = F.encode(F.regexp_replace(text, "[^\\x00-\\xFF]", "?"), "ISO-8859-1")
    repaired = F.try_validate_utf8(as_bytes.cast("string"))
    candidate = text.rlike("[\\x80-\\xFF]") & ~text.rlike("[^\\x00-\\xFF]")
    return F.when(candidate, F.coalesce(repaired, text)).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def fold_text(text: Column) -> Column:
    """Lower-case, accent-free, single-spaced text; NULL becomes the empty string."""
    folded = F.lower(strip_accents(repair_mojibake(text)))
    for broken, repaired in QUESTION_MARK_REPAIRS.items():
        folded = F.replace(folded, F.lit(broken), F.lit(repaired))
    # Underscores and hyphens become spaces before runs of white space collapse.
    return F.coalesce(collapse_spaces(F.translate(folded, "_-", "  ")), F.lit(""))


def match_label(text: Column) -> Column:
    """Alphanumeric lower-case label used as a join key; NULL stays NULL."""
    bare = F.translate(strip_accents(text), ZERO_WIDTH, "")
    return F.trim(F.lower(F.regexp_replace(bare, "[^0-9A-Za-z]+", " ")))


def snake_name(name: str) -> str:
    """Column name in snake case (driver side: works on metadata only)."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    bare = bare.translate({ord(c): None for c in ZERO_WIDTH})
    return "_".join(re.sub(r"[^0-9A-Za-z]+", " ", bare).lower().split())


def snake_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_name(c) for c in df.columns])


def clean_blank(text: Column) -> Column:
    """Trimmed text without zero-width characters; blank becomes NULL."""
    bare = F.translate(text, ZERO_WIDTH, "")
    return F.nullif(F.regexp_replace(bare, "^\\s+|\\s+$", ""), F.lit(""))


def blank_to_null(df: DataFrame) -> DataFrame:
    """``clean_blank`` on every string column of the frame, in one projection."""
    text_columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: clean_blank(F.col(c)) for c in text_columns})


def canonical_validation_type(text: Column) -> Column:
    return F.coalesce(lookup(fold_text(text), VALIDATION_TYPES), F.lit(UNKNOWN_VALIDATION_TYPE))


def canonical_title(text: Column) -> Column:
    """Allowed ticket title, NULL for any other text."""
    return lookup(fold_text(text), {plain_fold(t): t for t in TICKET_TITLES})


def canonical_station_code(code: Column, aliases: dict[str, str] | None = None) -> Column:
    """Struct ``(code, kind)`` with kind ``alias``, ``exact`` or ``missing``."""
    upper = F.upper(clean_blank(code))
    aliased = lookup(upper, {k.upper(): v.upper() for k, v in (aliases or STATION_ALIASES).items()})
    kind = F.when(upper.isNull(), "missing").when(aliased.isNotNull(), "alias").otherwise("exact")
    return F.struct(F.coalesce(aliased, upper).alias("code"), kind.alias("kind"))


def fix_station_codes(
    df: DataFrame, corrections: dict[str, str], column: str = "station_abbrev"
) -> DataFrame:
    """Keep the raw code next to its upper-cased, corrected form."""
    upper = F.upper(F.col(column))
    table = {k.upper(): v.upper() for k, v in corrections.items()}
    corrected = F.coalesce(lookup(upper, table), upper) if table else upper
    return df.withColumns({f"{column}_master_raw": F.col(column), column: corrected})


def station_code(text: Column, aliases: dict[str, str] | None = None) -> Column:
    upper = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    table = {**STATION_ALIASES, **{k.upper(): v.upper() for k, v in (aliases or {}).items()}}
    return F.coalesce(lookup(upper, table), upper)


def fallback_station_code(name: Column) -> Column:
    """Code for a station without one: four letters of one word, else initials of four."""
    upper = collapse_spaces(F.translate(F.upper(F.coalesce(name, F.lit(""))), "-", " "))
    words = F.split(upper, " ")
    initials = F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.substring(w, 1, 1)), "")
    return (
        F.when(upper == "", "UNK").when(F.size(words) == 1, F.substring(upper, 1, 4)).otherwise(initials)
    )


def series_label(line: Column, code: Column, is_shared: Column) -> Column:
    """Station code, with the digits of the line appended when lines share the station."""
    return F.when(is_shared, F.concat(code, F.regexp_replace(line, "\\D", ""))).otherwise(code)


def clean_service_name(text: Column) -> Column:
    return clean_blank(text)


def service_code(xml_name: Column) -> Column:
    """Lower-case text before the first underscore."""
    return F.lower(F.substring_index(clean_blank(xml_name), "_", 1))


def join_list(values: Column) -> Column:
    """Non-empty values joined by ``|`` in their order; NULL when none is left."""
    kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, "|"))


def unique_join(values: Column, separator: str = "|") -> Column:
    """Aggregate: sorted distinct non-blank values joined; NULL when none.

    The set per group is as large as the number of distinct labels, not of rows.
    """
    distinct = F.array_sort(F.collect_set(F.when(F.trim(values) != "", values)))
    return F.when(F.size(distinct) > 0, F.array_join(distinct, separator))
