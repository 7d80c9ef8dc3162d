"""Exact decimals: parsing without silent rounding, shares, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.functions.text import col, normalize_text, strip

#: An exponent has 17 significant digits at most, so sums with text lengths stay in BIGINT.
_NUMBER_SHAPE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?0*[0-9]{1,17})?$"

FEED_QTY, STORED_QTY = "decimal(36,18)", "decimal(18,3)"
#: Numbers whose plain text would need more zeros than this keep an exponent.
_LONGEST = 10_000
_LIMB = 9
#: A number already without marks, leading zeros and exponent, short enough for FEED_QTY.
_PLAIN = r"^-?(0|[1-9][0-9]{0,17})([.][0-9]{1,18})?\z"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often use mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parsed(text: Column, use) -> Column:
    """use(parts) for a text in number shape, else NULL.

    ``parts``: negative, significant digits (none for zero) and the power of ten
    of the last one; nothing is rounded and every part is computed once.
    """

    def of(t: Column) -> Column:
        lower = F.lower(t)
        body = F.substring_index(lower, "e", 1)
        power = F.when(lower.contains("e"), F.substring_index(lower, "e", -1).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        plain = F.ltrim(body, F.lit("+-"))
        fraction = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
        raw = F.struct(body.startswith("-").alias("negative"), F.concat(F.substring_index(plain, ".", 1), fraction).alias("digits"), (power - F.length(fraction)).alias("power"))

        def reduced(r: Column) -> Column:
            head = F.rtrim(r["digits"], F.lit("0"))
            parts = lambda h: F.struct(r["negative"].alias("negative"), F.ltrim(h, F.lit("0")).alias("significant"), (r["power"] + F.length(r["digits"]) - F.length(h)).alias("exponent"))
            return _let(_let(head, parts), use)

        return F.when(t.rlike(_NUMBER_SHAPE), _let(raw, reduced))

    return _let(text, of)


def exact_decimal(value: Column | str, whole_digits: int, scale: int) -> Column:
    """Number held exactly by DECIMAL(whole_digits + scale, scale), else NULL.

    A cast would round ``1.23456`` to four places; here the text is reduced to
    ``significant digits x 10^e`` and accepted only when nothing is lost.
    """
    target = f"decimal({whole_digits + scale},{scale})"

    def held(n: Column) -> Column:
        fits = (n["exponent"] >= -scale) & (F.length(n["significant"]) + n["exponent"] <= whole_digits)
        sign = F.when(n["negative"], "-").otherwise("")
        number = F.concat(sign, n["significant"], F.lit("e"), n["exponent"].cast("string")).try_cast(target)
        return F.when(n["significant"] == "", F.lit(0).cast(target)).when(fits, number)

    # Plain digits within both lengths need no reduction.
    raw = col(value).cast("string")
    plain = raw.rlike(rf"^-?[0-9]{{1,{whole_digits}}}([.][0-9]{{1,{scale}}})?\z")
    return F.when(plain, raw.try_cast(target)).otherwise(_parsed(strip(raw), held))


def sales_quantity(value: Column | str) -> Column:
    """Signed DECIMAL(18,4), blank or inexact -> NULL (an error for sales)."""
    return exact_decimal(value, 14, 4)


def order_quantity(value: Column | str) -> Column:
    """Non-negative DECIMAL(18,3) without rounding, else NULL."""
    number = exact_decimal(col(value).cast("string"), 15, 3)
    return F.when(number >= 0, number)


def number_invalid(value: Column | str) -> Column:
    """A non-blank text without the shape of a number; how many digits it has does not matter."""
    return feed_cell(value)["invalid"]


def feed_cell(value: Column | str) -> Column:
    """What a feed cell with thousands marks says, parsed once: blank, invalid, quantity and text.

    ``invalid``: not blank and without the shape of a number. ``quantity``: see
    `feed_quantity`. ``text``: see `decimal_text`. Make it a column of its own
    and read the fields from that column, or each field is a parse again.
    """
    raw = col(value).cast("string")
    cell = lambda blank, invalid, quantity, text: F.struct(blank.alias("blank"), invalid.alias("invalid"), quantity.alias("quantity"), text.alias("text"))
    no, nothing = F.lit(False), F.lit(None)
    short = F.when(raw.contains("."), F.rtrim(F.rtrim(raw, F.lit("0")), F.lit("."))).otherwise(raw)
    plain = cell(no, no, raw.try_cast(FEED_QTY), F.when(short == "-0", "0").otherwise(short))

    def held(n: Column) -> Column:
        point = F.length(n["significant"]) + n["exponent"]
        number = F.concat(F.when(n["negative"], "-").otherwise(""), n["significant"], F.lit("e"), n["exponent"].cast("string")).try_cast(FEED_QTY)
        return F.when((n["significant"] == "") | (point < -18), F.lit(0).cast(FEED_QTY)).when(point <= 18, number)

    def parsed(clean: Column) -> Column:
        bare = strip(clean)
        # The text is of the cell as it stands: a mark set off by a space leaves none.
        found = _parsed(bare, lambda n: cell(no, no, held(n), F.when(clean == bare, _shown(n))))
        return F.coalesce(found, cell(no, F.lit(True), nothing.cast(FEED_QTY), nothing.cast("string")))

    blank = cell(F.lit(True), no, nothing.cast(FEED_QTY), nothing.cast("string"))
    other = _let(normalize_text(raw), lambda t: F.when(t.isNull(), blank).otherwise(_let(F.regexp_replace(t, "[,_]", ""), parsed)))
    return F.when(raw.rlike(_PLAIN), plain).otherwise(other)


def feed_quantity(value: Column | str) -> Column:
    """Quantity of a feed cell with thousands marks, to 18 decimals; blank, no number or 10^18 and more -> NULL. For sums; signs and balances are decided on `decimal_text`, which keeps all digits."""
    return feed_cell(value)["quantity"]


def cell_not_storable(cell: Column) -> Column:
    """A number that DECIMAL(18,3) cannot hold: 10^15 or more after rounding to its places; of a `feed_cell`."""
    return ~cell["invalid"] & ~cell["blank"] & cell["quantity"].try_cast(STORED_QTY).isNull()


def not_storable(value: Column | str) -> Column:
    return cell_not_storable(feed_cell(value))


def cell_or_zero(cell: Column) -> Column:
    """Quantity of a `feed_cell`, but a blank cell is zero."""
    return F.when(cell["blank"], F.lit(0).cast(FEED_QTY)).otherwise(cell["quantity"])


def feed_quantity_or_zero(value: Column | str) -> Column:
    return cell_or_zero(feed_cell(value))


def forecast_valid(value: Column | str) -> Column:
    """Whether a value is a number and not negative, however many digits it has."""
    number = _parsed(strip(col(value).cast("string")), lambda n: ~n["negative"] | (n["significant"] == ""))
    return F.coalesce(number, F.lit(False))


def _shown(n: Column) -> Column:
    """Canonical text of parsed parts."""
    digits, exponent = n["significant"], n["exponent"]
    point = F.length(digits) + exponent
    few = lambda n: n.cast("int")
    body = (
        F.when((exponent > _LONGEST) | (point < -_LONGEST), F.concat(digits, F.lit("e"), exponent.cast("string")))
        .when(exponent >= 0, F.concat(digits, F.repeat(F.lit("0"), few(exponent))))
        .when(point > 0, F.concat(F.substr(digits, F.lit(1), few(point)), F.lit("."), F.substr(digits, few(point + 1))))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), few(-point)), digits))
    )
    signed = F.when(n["negative"], F.concat(F.lit("-"), body)).otherwise(body)
    return F.when(digits == "", F.lit("0")).otherwise(signed)


def decimal_text(value: Column | str) -> Column:
    """Canonical text of all digits: no exponent, no trailing zeros; NULL when no number.

    Beyond 10,000 zeros to fill in, the text is ``digits e power``: still exact and one text per number.
    """
    return feed_cell(value)["text"]


def is_negative(text: Column | str) -> Column:
    """Whether a canonical text (`decimal_text`) is below zero, by its sign and so however small."""
    return col(text).startswith("-")


def balanced(plus: list[Column], minus: list[Column]) -> Column:
    """Whether canonical texts (`decimal_text`) add up to the same on both sides, digit by digit; NULL with a NULL text.

    Up to 18 decimals and 18 whole digits the sums are decimals. Longer numbers
    are cut into limbs of nine digits, added limb by limb and carried from the
    last to the first: the sides agree when nothing is left anywhere. Numbers
    kept with an exponent agree only where both sides have the same of them.
    """
    many = len(plus)

    def by_limbs(numbers: Column) -> Column:
        width = lambda part: F.array_max(F.transform(numbers, lambda n: F.length(n[part])))

        def carried(size: Column) -> Column:
            def limb(k: Column) -> Column:
                def digits(n: Column) -> Column:
                    whole = F.lpad(n["whole"], size["whole"], F.lit("0"))
                    return n["sign"] * F.substr(F.concat(whole, F.rpad(n["fraction"], size["fraction"], F.lit("0"))), k * _LIMB + 1, F.lit(_LIMB)).cast("bigint")

                return F.aggregate(F.transform(numbers, digits), F.lit(0).cast("bigint"), lambda x, y: x + y)

            limbs = F.transform(F.sequence(((size["whole"] + size["fraction"]) / _LIMB).cast("int") - 1, F.lit(0), F.lit(-1)), limb)
            base = F.lit(10**_LIMB)
            step = lambda state, x: _let(state["carry"] + x, lambda t: F.struct((F.floor(t / base)).cast("bigint").alias("carry"), (state["even"] & (t % base == 0)).alias("even")))
            start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit(True).alias("even"))
            return F.aggregate(limbs, start, step, lambda state: state["even"] & (state["carry"] == 0))

        full = lambda n: (F.ceil(n / _LIMB) * _LIMB).cast("int")
        return _let(F.struct(full(width("whole")).alias("whole"), full(width("fraction")).alias("fraction")), carried)

    def parts(text: Column, i: Column) -> Column:
        sign = F.when(text.startswith("-") == (i < many), -1).otherwise(1).cast("bigint").alias("sign")
        plain = F.when(text.contains("e"), F.lit("0")).otherwise(F.ltrim(text, F.lit("-")))
        fraction = F.when(plain.contains("."), F.substring_index(plain, ".", -1)).otherwise("")
        return F.struct(sign, F.substring_index(plain, ".", 1).alias("whole"), fraction.alias("fraction"))

    def compared(texts: Column) -> Column:
        far = lambda start, n: F.array_sort(F.filter(F.slice(texts, start, n), lambda t: t.contains("e")))
        exact = _let(F.transform(texts, parts), by_limbs) & (far(1, many) == far(many + 1, len(minus)))
        return F.when(F.forall(texts, lambda t: t.isNotNull()), exact)

    short, zero = F.lit(True), F.lit(0).cast("decimal(38,18)")
    for number, text in enumerate([*plus, *minus]):
        value = text.try_cast("decimal(36,18)")
        short = short & F.coalesce(text.rlike(r"^-?[0-9]{1,18}([.][0-9]{1,18})?$"), F.lit(False))
        zero = (zero + (value if number < many else -value)).cast("decimal(38,18)")
    return F.when(short, zero == 0).otherwise(_let(F.array(*plus, *minus), compared))


def share(part: Column | str, total: Column | str) -> Column:
    """Part of total, six places half-even, 0 when the total is 0 or missing.

    Operands of 22 digits leave the quotient 16 decimals; with 28 digits it
    would keep ten, too few to tell a tie from a value just above it.
    """
    part, total = F.coalesce(col(part), F.lit(0)), F.coalesce(col(total), F.lit(0))
    quotient = part.cast("decimal(22,4)") / F.when(total != 0, total).cast("decimal(22,4)")
    return F.coalesce(F.bround(quotient, 6), F.lit(0)).cast("decimal(18,6)")


def display_quantity(value: Column | str) -> Column:
    """Grouped thousands, at most four decimals (cut, not rounded)."""
    text = F.regexp_replace(F.trim(col(value).cast("string")), ",", "")
    shape = r"^(-?)(\d+)(?:\.(\d+))?$"
    whole = F.regexp_replace(F.regexp_extract(text, shape, 2), r"^0+(?=\d)", "")
    grouped = F.regexp_replace(whole, r"\B(?=(\d{3})+(?!\d))", ",")
    fraction = F.regexp_replace(F.substring(F.regexp_extract(text, shape, 3), 1, 4), "0+$", "")
    tail = F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(F.lit(""))
    shown = F.concat(F.regexp_extract(text, shape, 1), grouped, tail)
    return F.when(text.rlike(shape), shown).otherwise(F.lit("—"))


def display_percent(value: Column | str) -> Column:
    """Ratio as a percentage with one decimal, half up; negatives have none."""
    text = F.regexp_replace(F.trim(col(value).cast("string")), ",", "")
    number = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.substring_index(text, ".", 1))
    fraction = F.rpad(F.regexp_extract(text, r"^\d+\.(\d+)$", 1), 4, "0")
    # Four decimals decide: three are shown as tenths, the fourth rounds.
    tenths = F.concat(number, F.substring(fraction, 1, 3)).try_cast("decimal(38,0)") + F.when(
        F.substring(fraction, 4, 1) >= "5", 1
    ).otherwise(0)
    percent = (tenths / 10).cast("decimal(38,1)").cast("string")
    return F.coalesce(F.concat(percent, F.lit("%")), F.lit("—"))
