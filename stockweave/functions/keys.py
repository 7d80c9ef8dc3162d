"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.functions.text import col, strip

# Identifier alphabet, scheme label and prefix by entity type.
ID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
ID_SCHEME = "MDM_ID_V1"
ID_PREFIX = {
    "CUSTOMER": "CUS_",
    "SKU": "SKU_",
    "PRODUCT": "PRD_",
    "CHANNEL": "CHN_",
    "SALESREP": "REP_",
    "REGION": "REG_",
    "PROVINCE": "PRV_",
}


def stable_id(entity_type: str, identity_key: Column | str) -> Column:
    """Prefix + base-32 text of the first 80 bits of a SHA-256 digest.

    NULL when the key is blank.
    """
    kind = entity_type.strip().upper()
    key = strip(identity_key)
    digest = F.sha2(F.concat(F.lit(f"{ID_SCHEME}|{kind}|"), key), 256)
    # Two halves of 40 bits; conv() writes base 32 with the digits 0-9 and A-V.
    halves = [F.lpad(F.conv(F.substring(digest, start, 10), 16, 32), 8, "0") for start in (1, 11)]
    symbols = F.translate(F.concat(*halves), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ID_ALPHABET)
    return F.when(key != "", F.concat(F.lit(ID_PREFIX[kind]), symbols))


def identity_key(kind: str, *parts: Column | str) -> Column:
    """Key text of an entity, ready for :func:`stable_id`."""
    # Identity key layouts.
    layouts = {
        "channel": "CHANNEL:BOOTSTRAP:INDEX:",
        "historical_channel": "CHANNEL:HIST:",
        "salesrep": "SALESREP:BOOTSTRAP:R",
        "customer": "CUSTOMER:BOOTSTRAP:R",
        "product": "PRODUCT:SOURCE_CODE:",
        "sku": "SKU:SOURCE_CODE:",
        "customer_code_name": "CUSTOMER:CODE_NAME:",
    }
    values = [col(p).cast("string") for p in parts]
    if kind == "historical_channel":
        values = [F.lpad(values[0], F.greatest(F.length(values[0]), F.lit(3)), F.lit("0"))]
    return F.concat(F.lit(layouts[kind]), F.concat_ws("|", *values))


def last_sequence(ids: DataFrame, id_column: str, prefix: str) -> DataFrame:
    """One row: highest number used in identifiers ``PREFIX000001``."""
    number = F.when(
        F.col(id_column).rlike(f"^{prefix}[0-9]+$"), F.substr(F.col(id_column), F.lit(len(prefix) + 1)).try_cast("decimal(38,0)")
    )
    return ids.agg(F.coalesce(F.max(number), F.lit(0).cast("decimal(38,0)")).alias("last_number"))


def sequence_text(prefix: str, number: Column | str) -> Column:
    text = col(number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0")))
