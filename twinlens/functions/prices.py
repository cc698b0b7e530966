"""Price columns: amount, currency and the parsed struct."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlens.functions.base import let

# Currency symbols and the code each stands for.
CURRENCY_SYMBOLS = {
    "$": "USD",
    "£": "GBP",
    "€": "EUR",
    "¥": "JPY",
    "₹": "INR",
    "₩": "KRW",
    "₽": "RUB",
    "₺": "TRY",
    "R$": "BRL",
    "CHF": "CHF",
}
# Words of three letters that are not currency codes.
NOT_CODES = ("AND", "THE")
# Preference between the places one price may be found in.
SOURCE_PRIORITY = {"jsonld": 0, "microdata": 1, "selector": 2, "text": 3}
# What counts as a price in running text.
_CODES = "USD|EUR|GBP|JPY|CHF|CAD|AUD|NZD|SEK|NOK|DKK|PLN|INR"
_SYM = "[$£€¥₹₩]"
_NUM = r"\d[\d.,\s\x{a0}]*"
CURRENCY_TEXT = (
    f"(?:{_SYM}\\s?{_NUM}|{_NUM}\\s?{_SYM}|(?<![A-Za-z0-9_])(?:{_CODES})\\s?{_NUM}"
    f"|{_NUM}\\s?(?<![A-Za-z0-9_])(?:{_CODES})(?![A-Za-z0-9_]))"
)

_WORD3 = r"(?<![A-Za-z0-9_])([A-Za-z]{3})(?![A-Za-z0-9_])"


def _symbol_code(symbol: Column) -> Column:
    pairs = [F.lit(x) for kv in CURRENCY_SYMBOLS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), symbol)


def detect_currency(raw: Column, hint: Column | None = None) -> Column:
    """Code from the hint, else a three-letter code in the text, else a symbol; NULL when none."""
    text = F.trim(raw)
    symbol = F.regexp_extract(text, "[$£€¥₹₩₽₺]", 0)
    found = let(
        F.regexp_extract(F.upper(text), _WORD3, 1),
        lambda code: F.when((code != "") & ~code.isin(*NOT_CODES), code).otherwise(_symbol_code(symbol)),
    )
    if hint is None:
        return found
    upper = F.upper(F.trim(hint))
    return F.coalesce(F.when(upper.rlike("^[A-Z]{3}$"), upper), _symbol_code(F.trim(hint)), found)


def parse_amount(raw: Column) -> Column:
    """Number in a displayed price. Decimal comma or point is decided by position and digits."""
    number = F.regexp_extract(F.regexp_replace(raw, _WORD3, " "), r"-?\d[\d., \x{a0}\x{202f}]*", 0)

    def value(n: Column) -> Column:
        digits = F.regexp_replace(n, r"[ \x{a0}\x{202f}\-]", "")
        sign = F.when(n.startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
        return F.when(n != "", let(digits, _plain_number).try_cast("double") * sign)

    return let(number, value)


def _plain_number(digits: Column) -> Column:
    """The separator that ends the integer part becomes a point, every other one goes.

    With both kinds it is the last one; a lone one counts when it occurs once and one or
    two digits follow it.
    """
    lone = r"^[^.,]*{}\d{{1,2}}$"
    comma = digits.rlike(r"\..*,[^.]*$|" + lone.format(","))
    point = digits.rlike(r",.*\.[^,]*$|" + lone.format(r"\."))
    by_comma = F.translate(F.regexp_replace(F.translate(digits, ".", ""), ",(?=.*,)", ""), ",", ".")
    by_point = F.regexp_replace(F.translate(digits, ",", ""), r"\.(?=.*\.)", "")
    return F.when(comma, by_comma).when(point, by_point).otherwise(F.translate(digits, ".,", ""))


def parse_price(raw: Column, hint: Column | None = None) -> Column:
    """STRUCT<amount, currency, raw>, NULL when the text holds no number."""
    text = F.trim(raw)
    currency = detect_currency(text, hint)
    return let(
        parse_amount(text),
        lambda amount: F.when(
            amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency"), text.alias("raw"))
        ),
    )


def source_rank(source: Column) -> Column:
    pairs = [F.lit(x) for kv in SOURCE_PRIORITY.items() for x in kv]
    return F.element_at(F.create_map(*pairs), source)


def scan_currency(text: Column) -> Column:
    """Every price-looking run in a text, trimmed, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(CURRENCY_TEXT), F.lit(0)), lambda m: F.trim(m))
