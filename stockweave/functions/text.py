"""Text keys.

Every matching rule has its own named key; they differ on purpose:

``normalize_text``   NFKC, whitespace runs to one space, trimmed, '' -> NULL
``sku_fallback_key`` NFKC, edges trimmed, inner whitespace kept
``fold_key``         ``normalize_text`` + full case folding
``collated``         case- and accent-insensitive collation of the raw value

NFKC and full case folding have no Spark built-in. Only values holding a
character that either could change are sent to Python (Arrow batches); all
others stay in generated code. Compute such a key on distinct values and join
it back with a left join: an inner join lets the optimizer push "key is not
null", and with it the normaliser, down onto every raw row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Whitespace as Unicode defines it, plus the four ASCII separators.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# ASCII and the common CJK ideographs are their own NFKC form.
UNSTABLE = r"[^\x00-\x7F\u4e00-\u9fff]"

# One short word of visible ASCII: its own normalised text.
WORD = r"^[!-~]{1,200}\z"

# Words accepted as booleans.
TRUE_WORDS = ("是", "yes", "y", "1", "true", "☑")
FALSE_WORDS = ("否", "no", "n", "0", "false", "☐")


def _text_udfs():
    # Nested functions travel to the executors by value, so workers do not need
    # this package on their path.
    def nfkc(values: pd.Series) -> pd.Series:
        return values.str.normalize("NFKC")

    def fold(values: pd.Series) -> pd.Series:
        return values.str.casefold()

    return F.pandas_udf(nfkc, StringType()), F.pandas_udf(fold, StringType())


_nfkc_values, _casefold_values = _text_udfs()


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nfkc(value: Column | str) -> Column:
    value = col(value).cast("string")
    wide = value.rlike(UNSTABLE)
    return F.when(wide, _nfkc_values(F.when(wide, value))).otherwise(value)


def casefold(value: Column | str) -> Column:
    value = col(value)
    wide = value.rlike(UNSTABLE)
    return F.when(wide, _casefold_values(F.when(wide, value))).otherwise(F.lower(value))


def strip(value: Column | str) -> Column:
    return F.trim(col(value), F.lit(SPACES))


def blank_to_null(value: Column | str) -> Column:
    """Edges trimmed, empty -> NULL."""
    text = strip(value)
    return F.when(text != "", text)


def squeeze(value: Column | str) -> Column:
    """Whitespace runs to one space, trimmed, empty -> NULL (no NFKC)."""
    text = F.trim(F.regexp_replace(F.translate(col(value), SPACES, " " * len(SPACES)), " {2,}", " "))
    return F.when(text != "", text)


def normalize_text(value: Column | str) -> Column:
    value = col(value).cast("string")
    return F.when(value.rlike(WORD), value).otherwise(squeeze(nfkc(value)))


def sku_fallback_key(value: Column | str) -> Column:
    return strip(nfkc(value))


def fold_key(value: Column | str) -> Column:
    return casefold(normalize_text(value))


def collated(value: Column | str) -> Column:
    """Equality, grouping and joins on the result ignore case and accents."""
    return F.collate(col(value), "UNICODE_CI_AI")


def too_long(value: Column | str, limit: int) -> Column:
    """Error flag of a bounded text: longer than ``limit`` once trimmed."""
    return F.coalesce(F.length(strip(value)) > limit, F.lit(False))


def bounded_text(value: Column | str, limit: int) -> Column:
    value = col(value)
    return F.when(value.rlike(rf"^[!-~]{{1,{limit}}}\z"), value).otherwise(F.when(~too_long(value, limit), blank_to_null(value)))


def line_number(value: Column | str) -> Column:
    """Canonical signed integer text; NULL when the text is no integer."""
    text = strip(value)
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"^[+-]?0*", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    signed = F.when(text.startswith("-") & (digits != "0"), F.concat(F.lit("-"), digits)).otherwise(digits)
    valid = text.rlike(r"^[+-]?[0-9]+(\.0+)?$") & (F.length(signed) <= 64)
    # Up to 18 digits without sign and leading zeros are canonical as they are.
    return F.when(col(value).rlike(r"^(0|[1-9][0-9]{0,17})\z"), col(value)).otherwise(F.when(valid, signed))


def code_text(value: Column | str, kind: Column | str | None = None, number_format: Column | str | None = None) -> Column:
    """Code of a cell.

    ``kind`` is the cell type of a typed export ('number', 'boolean' or 'text';
    NULL means text). A number loses its zero decimals and is zero-padded when
    its display format is a run of zeros. A boolean gives NULL; test it with
    :func:`code_invalid`.
    """
    text = normalize_text(value)
    if kind is None:
        return text
    kind = col(kind)
    plain = F.regexp_replace(F.regexp_replace(text, r"^([+-]?\d+)\.0+$", "$1"), r"^([+-]?\d+\.\d*?[1-9])0+$", "$1")
    if number_format is not None:
        shape = strip(nfkc(number_format))
        width = F.when(shape.rlike("^0+$"), F.length(shape)).otherwise(0)
        negative = plain.startswith("-")
        body = F.when(negative, F.substr(plain, F.lit(2))).otherwise(plain)
        room = width - F.when(negative, 1).otherwise(0)
        padded = F.when(F.length(body) < room, F.lpad(body, room, F.lit("0"))).otherwise(body)
        plain = F.when(negative, F.concat(F.lit("-"), padded)).otherwise(padded)
    return F.when(kind == "boolean", F.lit(None).cast("string")).when(kind == "number", plain).otherwise(text)


def code_invalid(kind: Column | str) -> Column:
    return F.coalesce(col(kind) == "boolean", F.lit(False))


def boolean_word(value: Column | str) -> Column:
    """TRUE, FALSE or NULL; a non-blank word outside the lists is also NULL."""
    word = fold_key(value)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def boolean_invalid(value: Column | str) -> Column:
    return normalize_text(value).isNotNull() & boolean_word(value).isNull()


def name_as_code(value: Column | str) -> Column:
    """Code stand-in for an extract that carries names only."""
    return F.concat(F.lit("NAME:"), col(value))
