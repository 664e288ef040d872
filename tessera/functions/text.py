"""Scalar text functions as columns: normalisation, tokens, token estimates, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: CJK ideographs of the context tokenisers, and the characters of a term.
CJK = r"[㐀-鿿]"
TERM = r"[A-Za-z0-9_./+-]{2,}"
DOI = r"10\.\d{4,9}/\S+"


def normalised(x: Column) -> Column:
    """White space collapsed, ends trimmed, lower case (not full case folding: ß and İ stay as ``lower`` has them)."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def normalised_doi(x: Column) -> Column:
    """A DOI without its resolver or scheme, lower case; blank is null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(F.trim(x), r"^(?i)(https?://(dx\.)?doi\.org/|doi:)", ""))), F.lit(""))


def year_of(x: Column) -> Column:
    """A number from 1800 to 2200, else the first year of the 20th or 21st century in the text."""
    n = x.try_cast("int")
    return F.when(n.between(1800, 2200), n).otherwise(F.nullif(F.regexp_extract(x, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).try_cast("int"))


def safe_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or January 1 of the year where the month or day isn't one."""
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", year, F.coalesce(month, F.lit(1)), F.coalesce(day, F.lit(1))), "yyyy-MM-dd")
    return F.coalesce(made, F.make_date(year, F.lit(1), F.lit(1)))


def identifier_kind(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike(r"(?i)\bPMC\d+\b"), "pmcid").when(t.rlike(r"(?i)^(pmid:?\s*)?\d{5,9}$"), "pmid").when(t.rlike(DOI), "doi")


def language_tag(x: Column) -> Column:
    """zh, en or mixed, by ideographs and Latin terms."""
    zh, en = x.rlike(CJK), x.rlike("[A-Za-z]{2,}")
    return F.when(zh & en, "mixed").when(zh, "zh").otherwise("en")


def terms(x: Column) -> Column:
    """Latin terms in lower case and bigrams of ideograph runs, distinct; a lone ideograph gives none."""
    latin = F.regexp_extract_all(F.lower(x), F.lit(TERM), F.lit(0))
    runs = F.regexp_extract_all(x, F.lit(CJK + "{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(latin, pairs))


def memory_terms(x: Column) -> Column:
    """Latin terms and whole ideograph runs of two or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"[a-z0-9_./+-]{2,}|" + CJK + "{2,}"), F.lit(0)))


#: Fixed value: a token of the chunker: words of Latin letters and digits, joined by single marks; ideographs; any other mark.
CHUNK_TOKEN = r"[A-Za-z0-9]+(?:[-_./][A-Za-z0-9]+)*|" + CJK + r"|\S"


def chunk_tokens(x: Column) -> Column:
    """How many tokens the chunker counts."""
    return F.regexp_count(x, F.lit(CHUNK_TOKEN))


def budget_tokens(x: Column) -> Column:
    """ceil(ideographs + 1.35 words + 0.25 other marks); an empty text 0, any other 1 at least."""
    cjk = F.regexp_count(x, F.lit(CJK))
    word = F.regexp_count(x, F.lit("[A-Za-z0-9]+"))
    rest = F.regexp_count(x, F.lit(r"[^\sA-Za-z0-9㐀-鿿]"))
    return F.when(F.length(x) == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(cjk + 1.35 * word + 0.25 * rest))).cast("bigint")


def provider_tokens(x: Column) -> Column:
    """Ideographs and a quarter of the other characters, rounded up."""
    cjk = F.regexp_count(x, F.lit(CJK))
    return (cjk + F.ceil((F.length(x) - cjk) / 4)).cast("bigint")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def recency(now: Column, at: Column) -> Column:
    """1 / (1 + age in days / 30); what lies ahead has no age."""
    return 1 / (1 + F.greatest((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0, F.lit(0.0)) / 30)


def bounded_text(x: Column, limit: int) -> Column:
    """The text up to the limit: cut after the last sentence end in the second half, else with an ellipsis."""
    head = F.left(x, F.lit(limit))
    back = F.greatest(*[F.when(F.instr(F.reverse(head), end[::-1]) > 0, F.length(head) - F.instr(F.reverse(head), end[::-1]) - len(end) + 2).otherwise(0) for end in (". ", "。", "; ")])
    return F.when(F.length(x) <= limit, x).when(back > limit // 2, F.left(head, back)).otherwise(F.concat(F.rtrim(F.left(x, F.lit(limit - 1))), F.lit("…")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text under a constant key, as binary."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256))


def evidence_token(key: bytes, workflow: Column, chunk: Column) -> Column:
    """ev1.<workflow>.<chunk>.<first 16 bytes of the HMAC in URL-safe base 64>."""
    mac = F.substring(hmac_sha256(key, F.concat_ws(":", workflow, chunk)), 1, 16)
    return F.concat_ws(".", F.lit("ev1"), workflow, chunk, F.rtrim(F.translate(F.base64(mac), "+/", "-_"), F.lit("=")))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "utf-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
