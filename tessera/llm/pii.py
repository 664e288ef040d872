"""Format-preserving pseudonyms for personal values, with Spark SQL functions only.

A found value is a list of symbols, each with a radix: digits, letters, octets
of an address, the day of a date. A keyed Feistel network over the two halves
of the list permutes all values of the same format, so that equal values get
equal pseudonyms in every document and different values different ones. What
is validated stays valid: card numbers keep a right check digit, addresses
their octets up to 255, dates remain dates of the calendar, and social
security numbers keep to the ranges in use. A number whose check digit is wrong
is no such value and stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A domain has at most 127 labels of 63 characters; a local part is only tried from its beginning.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,125}\.[A-Za-z]{2,63}"
SECRET = r"\bAKIA[0-9A-Z]{16}\b"
#: The value after the sign is permuted, in letters and digits.
ASSIGNED = r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)[0-9A-Za-z]{8,}"
ADDRESS = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9])(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9])|(?<![0-9/])(?:0[1-9]|[12][0-9]|3[01])[/.](?:0[1-9]|1[0-2])[/.](?:1[89]|2[01])[0-9]{2}(?![0-9/])"
SOCIAL = r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9][ \-]?){12,18}[0-9](?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "key": SECRET, "secret": ASSIGNED, "ip": ADDRESS, "date": DATE, "ssn": SOCIAL, "phone": PHONE, "card": CARD}
#: Days of the 400 years from 1800 on; its factors are the radices of a date.
DAYS, DAY_RADICES, FIRST_DAY = 146097, (189, 773), "1800-01-01"
ROUNDS = 8


def _text(value: str) -> str:
    """A string as a SQL literal."""
    return "r'" + value.replace("'", r"\x27") + "'"


def permuted(symbols: str, radices: str, key: str, kind: str) -> str:
    """SQL: the array of symbols, permuted among all arrays of these radices.

    Each round adds a keyed digest of one half to the other, symbol by symbol,
    modulo the symbol's radix, and swaps the halves.
    """
    salt = key.replace("\\", "\\\\").replace("'", "\\'")
    return f"""transform(array(named_struct('s', transform({symbols}, q -> cast(q as bigint)), 'r', transform({radices}, q -> cast(q as bigint)))), t ->
      aggregate(sequence(0, {ROUNDS - 1}),
        named_struct('x', slice(t.s, 1, size(t.s) div 2), 'xr', slice(t.r, 1, size(t.s) div 2),
                     'y', slice(t.s, size(t.s) div 2 + 1, size(t.s)), 'yr', slice(t.r, size(t.s) div 2 + 1, size(t.s))),
        (s, k) -> named_struct('x', s.y, 'xr', s.yr, 'y',
          transform(array(sha2(concat('{salt}|{kind}|', k, '|', size(t.s), '|', array_join(transform(s.y, v -> cast(v as string)), ',')), 512)), d ->
            transform(s.x, (v, i) -> (v + cast(conv(substr(d, 1 + 4 * (i % 32), 4), 16, 10) as bigint)) % s.xr[i]))[0], 'yr', s.xr),
        s -> concat(s.x, s.y)))[0]"""


def _digits_of(value: str) -> str:
    return f"filter(split({value}, ''), c -> c rlike '[0-9]')"


def _refilled(value: str, symbols: str, pattern: str, render: str) -> str:
    """SQL: the value with its n-th character of the pattern replaced by the n-th symbol."""
    new = f"zip_with(regexp_extract_all({value}, '{pattern}', 0), {symbols}, (c, w) -> {render})"
    return f"array_join(zip_with(split({value}, '{pattern}', -1), concat({new}, array('')), (a, b) -> concat(a, b)), '')"


def pseudonym(value: str, key: str) -> str:
    """SQL: the pseudonym of a found value, whatever its kind; the value itself if its check digit or date is wrong."""

    def alphanumeric(text: str, kind: str) -> str:
        # letters keep their case and place, digits theirs; upper and lower case are one symbol
        symbols = f"transform(filter(split({text}, ''), c -> c rlike '[0-9A-Za-z]'), c -> IF(c rlike '[0-9]', ascii(c) - 48, ascii(lower(c)) - 97))"
        radices = f"transform(filter(split({text}, ''), c -> c rlike '[0-9A-Za-z]'), c -> IF(c rlike '[0-9]', 10, 26))"
        return _refilled(text, permuted(symbols, radices, key, kind), "[0-9A-Za-z]", "CASE WHEN c rlike '[0-9]' THEN cast(w as string) WHEN c rlike '[A-Z]' THEN chr(65 + w) ELSE chr(97 + w) END")

    def digits(text: str, kind: str) -> str:
        symbols = f"transform({_digits_of(text)}, c -> cast(c as bigint))"
        return _refilled(text, permuted(symbols, f"transform({_digits_of(text)}, c -> 10L)", key, kind), "[0-9]", "cast(w as string)")

    # weights of a check digit: every second digit from the right, the check digit's left neighbour first
    doubled = "IF((size(g) - i) % 2 = 0, x, IF(x > 4, 2 * x - 9, 2 * x))"
    luhn = f"transform(array(transform({_digits_of(value)}, c -> cast(c as bigint))), g -> aggregate(transform(g, (x, i) -> {doubled.replace('(size(g) - i) % 2 = 0', '(size(g) - i) % 2 = 1')}), 0L, (a, x) -> a + x) % 10)[0]"
    body = f"transform(slice({_digits_of(value)}, 1, size({_digits_of(value)}) - 1), c -> cast(c as bigint))"
    checked = f"""transform(array({permuted(body, f"transform({body}, c -> 10L)", key, "card")}), g ->
      concat(g, array((10 - aggregate(transform(g, (x, i) -> IF((size(g) - i) % 2 = 0, x, IF(x > 4, 2 * x - 9, 2 * x))), 0L, (a, x) -> a + x) % 10) % 10)))[0]"""
    card = f"IF({luhn} = 0, {_refilled(value, checked, '[0-9]', 'cast(w as string)')}, {value})"
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area = f"cast(substr({value}, 1, 3) as bigint)"
    parts = f"array({area} - IF({area} > 666, 2, 1), cast(substr({value}, 5, 2) as bigint) - 1, cast(substr({value}, 8, 4) as bigint) - 1)"
    social = f"""transform(array({permuted(parts, "array(898L, 99L, 9999L)", key, "ssn")}), p ->
      concat_ws('-', lpad(cast(p[0] + IF(p[0] >= 665, 2, 1) as string), 3, '0'), lpad(cast(p[1] + 1 as string), 2, '0'), lpad(cast(p[2] + 1 as string), 4, '0')))[0]"""
    octets = permuted(f"transform(split({value}, '[.]'), c -> cast(c as bigint))", "array(256L, 256L, 256L, 256L)", key, "ip")
    a, b = DAY_RADICES
    spelt = f"IF({value} like '____-%', 'yyyy-MM-dd', concat('dd', substr({value}, 3, 1), 'MM', substr({value}, 6, 1), 'yyyy'))"
    day = f"IF({value} like '____-%', try_to_date({value}, 'yyyy-MM-dd'), try_to_date(concat(substr({value}, 7, 4), '-', substr({value}, 4, 2), '-', substr({value}, 1, 2)), 'yyyy-MM-dd'))"
    date = f"""transform(array({day}), y -> coalesce(IF(y is null, null, transform(array({permuted(f"array(datediff(y, date'{FIRST_DAY}') div {b}, datediff(y, date'{FIRST_DAY}') % {b})", f"array({a}L, {b}L)", key, "date")}), p ->
      date_format(date_add(date'{FIRST_DAY}', cast(p[0] * {b} + p[1] as int)), {spelt}))[0]), {value}))[0]"""
    local, domain = f"substring_index({value}, '@', 1)", f"substr({value}, instr({value}, '@'))"
    secret = f"regexp_extract({value}, '[0-9A-Za-z]+$', 0)"
    country = f"regexp_extract({value}, '^[+][0-9]+[ .-]?(?=[(0-9])', 0)"
    return f"""CASE
      WHEN {value} like '%@%' THEN concat({alphanumeric(local, "email")}, {domain})
      WHEN {value} rlike '^AKIA[0-9A-Z]+$' THEN concat('AKIA', {alphanumeric(f"substr({value}, 5)", "key")})
      WHEN {value} rlike '[=:]' THEN concat(substr({value}, 1, length({value}) - length({secret})), {alphanumeric(secret, "secret")})
      WHEN {value} rlike '^([0-9]+[.]){{3}}[0-9]+$' THEN array_join(transform({octets}, o -> cast(o as string)), '.')
      WHEN {value} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}})$' THEN {date}
      WHEN {value} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {social}
      WHEN length(regexp_replace({value}, '[^0-9]', '')) >= 13 AND {value} not like '+%' AND {value} not like '(%' THEN {card}
      ELSE concat({country}, {digits(f"substr({value}, length({country}) + 1)", "phone")}) END"""


def pseudonymise(documents: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, n_values): each document with its values replaced, and how many were.

    Emails keep their domain, phone numbers their country code, assigned
    secrets their name. A text without such values comes back unchanged, null
    as null with 0. Ids may be null or repeat; other columns are left out.
    ``key`` is the secret of the permutation.
    """
    pattern = F.lit("|".join(KINDS.values()))
    value = F.col("t")
    found = F.when(value.rlike("[0-9@]|(?i:password|passwd|pwd|secret|token|api_?key)"), F.regexp_extract_all(value, pattern, F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = documents.select(F.col(id).alias("i"), F.col(text).alias("t")).withColumn("found", F.coalesce(found, F.array().cast("array<string>")))
    rows = rows.withColumn("other", F.when(F.size("found") > 0, F.split("t", "|".join(KINDS.values()), -1)))
    rows = rows.withColumn("new", F.expr(f"transform(found, m -> {pseudonym('m', key)})"))
    joined: Column = F.array_join(F.zip_with("other", F.concat("new", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    return rows.select(F.col("i").alias(id), F.when(F.size("found") > 0, joined).otherwise(value).alias(text), changed.alias("n_values"))
