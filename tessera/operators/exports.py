"""Records rendered as text: RIS, BibTeX, citations, reports, audit packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def citation_key(pmid: Column, doi: Column, title: Column) -> Column:
    """sb_<pmid>, else a slug of up to 24 characters of DOI or title."""
    slug = F.trim(F.regexp_replace(F.lower(F.coalesce(doi, title, F.lit("record"))), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(pmid.isNotNull(), F.concat(F.lit("sb_"), pmid)).otherwise(F.left(slug, F.lit(24)))


def ris(title: Column, authors: Column, journal: Column, year: Column, doi: Column) -> Column:
    """One RIS entry; what is null is left out."""
    line = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f"{tag}  - "), c.cast("string")))
    people = F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a))
    lines = F.flatten(F.array(F.array(F.lit("TY  - JOUR"), line("TI", title)), people, F.array(line("JO", journal), line("PY", year), line("DO", doi), F.lit("ER  - "))))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def bibtex(key: Column, title: Column, authors: Column, journal: Column, year: Column, doi: Column) -> Column:
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("}")))
    fields = F.filter(F.array(field("title", title), field("author", F.nullif(F.array_join(authors, " and "), F.lit(""))), field("journal", journal), field("year", year), field("doi", doi)), lambda x: x.isNotNull())
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("\n}"))


def cited(author: Column, title: Column, year: Column) -> Column:
    """Up to six authors, then et al., with title and year."""
    people = F.concat(F.array_join(F.slice(author, 1, 6), ", "), F.when(F.size(author) > 6, ", et al.").otherwise(""))
    return F.concat_ws(". ", F.nullif(people, F.lit("")), title, year.cast("string"))


def reference_list(answers: DataFrame, references: DataFrame) -> DataFrame:
    """(answer_id, number, text): cited ids in first order, once each, numbered from 1; unknown ids are dropped."""
    used = answers.select("answer_id", F.posexplode(F.array_distinct("ids")).alias("pos", "id")).join(references, "id")
    from pyspark.sql import Window

    return used.withColumn("number", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).select("answer_id", "number", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), "text").alias("text"))


def without_unknown(answers: DataFrame, allowed: Column) -> DataFrame:
    """Text and id list without the ids that aren't allowed, and which went: marks like [E12]."""
    marks = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(E\d+)\]"), F.lit(1)))
    unknown = F.array_distinct(F.array_except(F.concat(marks, "ids"), allowed))
    clean = F.aggregate(unknown, F.col("text"), lambda t, u: F.replace(t, F.concat(F.lit("["), u, F.lit("]")), F.lit("")))
    return answers.select("answer_id", clean.alias("text"), F.array_intersect("ids", allowed).alias("ids"), unknown.alias("removed"))


def ablation_table(runs: DataFrame, base: str) -> DataFrame:
    """Markdown rows of mean recall and its change against the base configuration."""
    means = runs.groupBy("config").agg(F.avg("recall").alias("recall"))
    ground = means.where(F.col("config") == base).select(F.col("recall").alias("ground"))
    change = F.coalesce(F.try_divide(F.col("recall") - F.col("ground"), "ground") * 100, F.lit(0.0))
    return means.crossJoin(F.broadcast(ground)).select("config", F.format_string("| %s | %.4f | %+.1f%% |", "config", "recall", change).alias("line"))  # one row


def audit_package(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """(run_id, package): each run with its steps in order as one JSON document."""
    trail = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("step", "kind", "detail"))).alias("steps"))
    return runs.join(trail, "run_id", "left").select("run_id", F.to_json(F.struct("run_id", "question", "steps")).alias("package"))
