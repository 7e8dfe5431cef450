"""Checksums and shape checks as native expressions over strings; false (not null) for whatever doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country lengths of bank account numbers, letter codes and weights of identity numbers, domain suffixes.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
CN_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
CN_CHECK = "10X98765432"
TW_LETTERS = (10, 11, 12, 13, 14, 15, 16, 17, 34, 18, 19, 20, 21, 22, 35, 23, 24, 25, 26, 27, 28, 29, 32, 30, 31, 33)
TW_WEIGHTS = (1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1)
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_LETTERS = {"ST": "JZIHGFEDCBA", "FG": "XWUTRQPNMLK", "M": "XWUTRQPNJLK"}
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
VIN_LETTERS = "ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
PLATE_WEIGHTS = (9, 4, 5, 4, 3, 2)
PLATE_LETTERS = "AZYXUTSRPMLKJHGEDCB"
KNOWN_TLDS = (
    "com org net edu gov mil int info biz name pro app dev io ai co me tv cc xyz site online store tech cloud email blog shop live news media digital "
    "agency studio design software systems network solutions company group team world life today space website page link click fun wiki top vip one art inc ltd llc"
).split()

_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shape(value: Column, pattern: str, check: Column) -> Column:
    """check where the shape fits; only there is it worked out."""
    return F.coalesce(F.when(value.rlike(pattern), check), F.lit(False))


def _char(value: Column, i: int) -> Column:
    return F.substring(value, i + 1, 1)


def _digit(value: Column, i: int) -> Column:
    return F.instr(F.lit("0123456789"), _char(value, i)) - 1


def _weighted(value: Column, weights, first: int = 0) -> Column:
    return sum((_digit(value, first + i) * w for i, w in enumerate(weights)), F.lit(0))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits, not all zero, that pass the Luhn check."""
    return _shape(value, "^(?=[0-9]*[1-9])[0-9]{13,19}$", F.call_function("luhn_check", value))


def iban(value: Column) -> Column:
    """Length of the country and remainder 1 by 97; spaces and hyphens don't count."""
    plain = F.upper(F.regexp_replace(value, "[ -]", ""))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    number = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.instr(F.lit(_ALNUM), c) - 1)
    rest = F.aggregate(number, F.lit(0), lambda acc, v: F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97)
    return _shape(plain, "^[A-Z]{2}[0-9]{2}[A-Z0-9]+$", (F.try_element_at(lengths, F.substring(plain, 1, 2)) == F.length(plain)) & (rest == 1))


def ssn(value: Column) -> Column:
    return F.coalesce(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), F.lit(False))


def cn_id(value: Column) -> Column:
    rest = _weighted(value, CN_WEIGHTS) % 11
    return _shape(value, "^[0-9]{17}[0-9Xx]$", F.substring(F.lit(CN_CHECK), rest + 1, F.lit(1)) == F.upper(_char(value, 17)))


def hkid(value: Column) -> Column:
    """One or two letters, six digits and the check in brackets: A123456(3)."""
    body = F.lpad(F.regexp_extract(value, "^([A-Z]{1,2}[0-9]{6})", 1), 8, " ")
    letter = lambda i: F.when(_char(body, i) == " ", 36).otherwise(F.instr(F.lit(_ALNUM), _char(body, i)) - 1)
    rest = (11 - (letter(0) * 9 + letter(1) * 8 + sum((F.instr(F.lit(_ALNUM), _char(body, i)) - 1) * (9 - i) for i in range(2, 8))) % 11) % 11
    check = F.when(rest == 10, "A").otherwise(rest.cast("string"))
    return _shape(value, r"^[A-Z]{1,2}[0-9]{6}\([0-9A]\)$", F.regexp_extract(value, r"\((.)\)$", 1) == check)


def tw_id(value: Column) -> Column:
    code = lambda c: F.get(F.array(*map(F.lit, TW_LETTERS)), F.instr(F.lit(_ALNUM[10:]), c) - 1)
    first, second = code(_char(value, 0)), F.when(_char(value, 1).rlike("[0-9]"), _digit(value, 1)).otherwise(code(_char(value, 1)) % 10)
    total = F.floor(first / 10) * TW_WEIGHTS[0] + first % 10 * TW_WEIGHTS[1] + second * TW_WEIGHTS[2] + _weighted(value, TW_WEIGHTS[3:], 2)
    return _shape(value, "^[A-Z][0-9A-D][0-9]{8}$", total % 10 == 0)


def nric(value: Column) -> Column:
    total = _weighted(value, NRIC_WEIGHTS, 1) + F.when(_char(value, 0).isin("T", "G"), 4).when(_char(value, 0) == "M", 3).otherwise(0)
    letter = lambda s: F.substring(F.lit(s), total % 11 + 1, F.lit(1))
    wanted = F.when(_char(value, 0).isin("S", "T"), letter(NRIC_LETTERS["ST"])).when(_char(value, 0).isin("F", "G"), letter(NRIC_LETTERS["FG"])).otherwise(letter(NRIC_LETTERS["M"]))
    return _shape(value, "^[STFGM][0-9]{7}[A-Z]$", wanted == _char(value, 8))


def rrn(value: Column) -> Column:
    plain = digits_of(value)
    return _shape(plain, "^[0-9]{13}$", (11 - _weighted(plain, RRN_WEIGHTS) % 11) % 10 == _digit(plain, 12))


def cpf(value: Column) -> Column:
    plain = digits_of(value)

    def check(n):
        rest = _weighted(plain, range(n + 1, 1, -1)) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    return _shape(plain, r"^(?!([0-9])\1{10}$)[0-9]{11}$", (check(9) == _digit(plain, 9)) & (check(10) == _digit(plain, 10)))


def vin(value: Column) -> Column:
    plain = F.translate(value, VIN_LETTERS, VIN_VALUES)
    rest = _weighted(plain, VIN_WEIGHTS) % 11
    return _shape(value, "^[A-HJ-NPR-Z0-9]{17}$", _char(value, 8) == F.when(rest == 10, "X").otherwise(rest.cast("string")))


def mrz_check(value: Column) -> Column:
    """The check digit of a machine-readable field; null for characters that such a field can't have."""
    numbers = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.when(c == "<", 0).otherwise(F.instr(F.lit(_ALNUM), c) - 1))
    weights = F.array(F.lit(7), F.lit(3), F.lit(1))
    total = F.aggregate(F.transform(numbers, lambda v, i: v * F.get(weights, i % 3)), F.lit(0), lambda acc, v: acc + v)
    return F.when(value.rlike("^[0-9A-Z<]+$"), total % 10)


def entropy(value: Column) -> Column:
    """Bits per character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    part = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.coalesce(F.when(F.length(value) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - part(c) * F.log2(part(c)))), F.lit(0.0))


def mac(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\\1){4}[0-9A-Fa-f]{2}$"), F.lit(False))


def known_tld(value: Column) -> Column:
    low = F.lower(value)
    return F.coalesce(low.rlike("^[a-z]{2}$") | low.isin(KNOWN_TLDS), F.lit(False))


def ipv4(value: Column) -> Column:
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return F.coalesce(value.rlike(rf"^{byte}(?:\.{byte}){{3}}$"), F.lit(False))


def sg_plate(value: Column) -> Column:
    """Check letter of a plate such as SBA1234G: the last two prefix letters and four digits, by 19."""
    prefix = F.lpad(F.regexp_extract(value, "^[A-Z]?([A-Z]{1,2})[0-9]", 1), 2, "@")
    number = F.lpad(F.regexp_extract(value, "([0-9]{1,4})", 1), 4, "0")
    letter = lambda i: F.instr(F.lit(_ALNUM[10:]), _char(prefix, i))
    total = letter(0) * PLATE_WEIGHTS[0] + letter(1) * PLATE_WEIGHTS[1] + _weighted(number, PLATE_WEIGHTS[2:])
    return _shape(value, "^[A-Z]{1,3}[0-9]{1,4}[A-Z]$", F.substring(F.lit(PLATE_LETTERS), total % 19 + 1, F.lit(1)) == F.right(value, F.lit(1)))


#: Names under which tables of (family, value) are validated.
FAMILIES = {"luhn": luhn, "iban": iban, "ssn": ssn, "cn_id": cn_id, "hkid": hkid, "tw_id": tw_id, "nric": nric, "rrn": rrn, "cpf": cpf, "vin": vin, "mac": mac, "tld": known_tld, "ipv4": ipv4, "sg_plate": sg_plate}


def valid(family: Column, value: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for name, check in FAMILIES.items():
        out = F.when(family == name, check(value)).otherwise(out)
    return out
