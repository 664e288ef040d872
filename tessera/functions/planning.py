"""Column functions for planning, clean-up and policy: what a question asks for, what a failure means, what may be used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of an error message that say whether trying again makes sense.
RETRYABLE = ["timeout", "timed out", "429", "500", "502", "503", "504", "connection", "network", "temporar", "rate limit", "database is locked"]
NOT_RETRYABLE = ["not configured", "not_configured", "unauthorized", "forbidden", "401", "403", "unsupported", "invalid", "not allowed", "not_authorized", "rejected"]
#: Rounds, sources, external sources, branches, refinements, counter-evidence, by depth.
DEPTHS = {"quick": (0, 2, 0, 1, 0, False), "balanced": (1, 6, 2, 2, 1, False), "deep": (2, 10, 4, 4, 2, True), "max": (2, 10, 4, 4, 2, True)}


def ascii_terms(text: Column, ignored: list[str]) -> Column:
    """The ASCII terms of two characters or more that aren't ignored, each once, in their order."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_./+-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.lower(w).isin(ignored)))


def long_tokens(text: Column) -> Column:
    """The distinct blank-separated words of four characters or more, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) >= 4))


def prefix_overlap(a: Column, b: Column) -> Column:
    """How many pairs of words of both texts begin with the same four characters.

    Counted by prefix on each side, not pair by pair.
    """
    left, right = (F.transform(long_tokens(x), lambda w: F.substring(w, 1, 4)) for x in (a, b))
    return F.aggregate(left, F.lit(0), lambda s, p: s + F.size(F.filter(right, lambda q: q == p)))


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether one of the markers stands in the text, in lower case; null counts as empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for m in markers:
        found = found | low.contains(m.lower())
    return found


def marker_hits(text: Column, markers: list[str]) -> Column:
    """The markers that stand in the text."""
    return F.filter(F.array(*[F.when(contains_any(text, [m]), m) for m in markers]), lambda x: x.isNotNull())


def retry_advice(reason: Column, status: Column) -> Column:
    """(retryable, advice) of a failed or empty route; the four pieces of advice are fixed values."""

    def answer(yes: bool, advice: str) -> Column:
        return F.struct(F.lit(yes).alias("retryable"), F.lit(advice).alias("advice"))

    refused = (status == "rejected") | contains_any(reason, NOT_RETRYABLE)
    return (
        F.when(refused, answer(False, "change_permissions_configuration_or_action"))
        .when(contains_any(reason, RETRYABLE), answer(True, "transient_failure_retry_with_backoff"))
        .when(status == "empty", answer(False, "reformulate_query_or_change_scope"))
        .otherwise(answer(False, "inspect_failure_before_retry"))
    )


def lines_repaired(text: Column) -> Column:
    """Soft hyphens dropped, words joined that a line break splits, white space collapsed within lines, blank lines dropped."""
    joined = F.regexp_replace(F.replace(text, F.lit("\u00ad"), F.lit("")), r"(?<=[A-Za-z])-\s*\n\s*(?=[a-z])", "")
    lines = F.transform(F.split(joined, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def clean_title(text: Column, fallback: Column, marks: str = r"[*_`#]+") -> Column:
    """A heading without Markdown ``marks``, list number and end marks, of 300 characters at most; the fallback where nothing is left."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), marks, "")
    bare = F.regexp_replace(bare, r"^\s*(?:\d+[.)\u3001]|[-+])\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[\uff1a:\u3002.\- ]+|[\uff1a:\u3002.\- ]+$", "")
    return F.left(F.when(bare != "", bare).otherwise(fallback), F.lit(300))


def context_characters(tokens: Column, share: float, cap: int) -> Column:
    """Characters of context for a window of tokens: the share of it, 12,000 at least, before that the cap."""
    return F.greatest(F.lit(12_000), F.least(F.lit(cap), (tokens * share).cast("int")))


def output_tokens(tokens: Column, cap: int) -> Column:
    return F.least(F.lit(cap), F.greatest(F.lit(4096), F.floor(tokens / 4).cast("int")))


def says_retracted(types: Column) -> Column:
    """Whether one of the publication types says that the work is retracted."""
    return F.coalesce(F.exists(types, lambda t: F.lower(t).contains("retracted publication")), F.lit(False))


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON, keys sorted, no blanks; null fields stand as null."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(F.substring(F.to_json(F.struct(fields[k].alias("v"))), 6, 1 << 30), F.lit("null}"))) for k in sorted(fields)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *[F.regexp_replace(p, r"\}$", "") for p in parts]), F.lit("}")), 256)


def chunks_expected(tokens: Column, size: int = 384) -> Column:
    return F.greatest(F.lit(1), F.ceil(tokens / size)).cast("bigint")


def vector_problem(vector: Column, dimensions: int) -> Column:
    """Null for a usable vector, else what is wrong with it."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dimensions, "dimensions").when(bad, "not finite")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where sizes differ or one has no length."""

    def product(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(product(a, a)) * F.sqrt(product(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), product(a, b) / norm)


def may_be_evidence(kind: Column, cell_range: Column, parent: Column, chunk: Column, page: Column, box: Column, text: Column) -> Column:
    """Whether an object of a page may support a statement: cells and tables or equations with a place, nothing else."""
    given = lambda c: F.coalesce(c != "", F.lit(False))
    place = page.isNotNull() & F.coalesce(F.size(box) > 0, F.lit(False)) & given(text)
    return F.when(kind == "table_cell", given(cell_range) & given(parent) & place).when(kind.isin("table", "equation"), given(chunk) & place).otherwise(F.lit(False))


def term_share(asked: Column, planned: Column) -> Column:
    """The share of the asked terms that are planned ones; 0 without terms."""
    return F.when(F.size(asked) > 0, F.least(F.lit(1.0), F.size(F.array_intersect(asked, planned)) / F.size(asked))).otherwise(0.0)


def budget_of(depth: Column) -> Column:
    """The budget of a research depth; unknown depths are balanced."""
    names = ("rounds", "sources", "external", "branches", "refinements", "counter_evidence")
    row = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(names, v)])
    out = row(DEPTHS["balanced"])
    for name, values in DEPTHS.items():
        out = F.when(depth == name, row(values)).otherwise(out)
    return out


def completeness(**fields: Column) -> Column:
    """(share of fields that are filled, names of the others in the given order); null and blank count as missing."""
    missing = F.filter(F.array(*[F.when(c.isNull() | (F.trim(c.cast("string")) == ""), n) for n, c in fields.items()]), lambda x: x.isNotNull())
    return F.struct(((len(fields) - F.size(missing)) / len(fields)).alias("share"), missing.alias("missing"))


def clean_list(items: Column, limit: int) -> Column:
    """Trimmed items without bullets, each once, in order, ``limit`` at most."""
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[-\u2022]+", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != ""))), 1, limit)


def followups(question: Column, gaps: Column, existing: Column, limit: int = 2) -> Column:
    """Up to two new queries, one for each gap of three characters or more that isn't asked yet."""
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    asked = F.transform(existing, lambda x: F.lower(squeezed(x)))
    new = F.transform(F.filter(F.transform(gaps, squeezed), lambda g: F.length(g) >= 3), lambda g: F.concat(question, F.lit(" evidence gap "), F.substring(g, 1, 240)))
    fresh = F.filter(new, lambda q: ~F.array_contains(asked, F.lower(q)))
    once = F.filter(fresh, lambda q, i: (i == 0) | ~F.array_contains(F.transform(F.slice(fresh, F.lit(1), i), F.lower), F.lower(q)))
    return F.slice(once, 1, max(0, min(limit, 2)))


def retrieval_mode(routes: Column, identifier: Column) -> Column:
    """How candidates with these routes were found."""
    return F.when(identifier, "identifier").when(F.exists(routes, lambda r: r.startswith("dense_")), "hybrid-dense").otherwise("hybrid-sparse")


def planned_routes(identifier: Column, english: Column, simple: Column, vectors: Column) -> Column:
    """The routes that answer a question: an identifier alone is looked up; else the routes of each form of the question that there is."""
    some = lambda c, *names: F.when(c, F.array(*map(F.lit, names))).otherwise(F.array().cast("array<string>"))
    found = F.concat(some(english, "fts_english", "metadata", "mesh"), some(simple, "simple"), F.transform(F.coalesce(vectors, F.array().cast("array<string>")), lambda v: F.concat(F.lit("dense_"), v)))
    return F.when(F.coalesce(identifier != "", F.lit(False)), F.array(F.lit("exact"))).otherwise(found)


def joined_text(*parts: Column, most: int) -> Column:
    """The parts that aren't blank, a line each, cut to ``most`` characters."""
    return F.left(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n"), F.lit(most))


def importance(evidence: Column, base: float = 0.45, step: float = 0.08) -> Column:
    """How much a step with so many pieces of evidence counts, 1 at most."""
    return F.least(F.lit(1.0), base + step * evidence)


def compaction_tier(occupancy: Column) -> Column:
    """0 to 3: how far a context that is filled to this share has to be shortened."""
    return F.when(occupancy < 0.5, 0).when(occupancy < 0.7, 1).when(occupancy < 0.85, 2).otherwise(3)


def last_characters(text: Column, most: int) -> Column:
    return F.right(text, F.lit(most))
