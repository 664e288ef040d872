"""Literature records from providers' XML and JSON, one document a row, to one record schema.

Records: provider, source_id, pmid, pmcid, doi, title, abstract, journal,
publication_year, authors, publication_types, mesh, is_open_access.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalised_doi, year_of

AUTHORS = "array<struct<full_name:string,family_name:string,given_name:string,collective_name:string>>"
MESH = "array<struct<descriptor_ui:string,label:string,is_major_topic:boolean>>"

_TEXT = "struct<_VALUE:string,_Label:string>"
PUBMED_SCHEMA = f"""MedlineCitation struct<PMID:string,
  Article:struct<ArticleTitle:string,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,
    Abstract:struct<AbstractText:array<{_TEXT}>>,
    AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,CollectiveName:string>>>,
    PublicationTypeList:struct<PublicationType:array<string>>,
    ArticleDate:array<struct<Year:string>>>,
  MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_UI:string,_MajorTopicYN:string>>>>>,
  PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"""


def _blank(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Records of PubMed XML files; Spark splits a file at its articles."""
    return pubmed(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path))


def pubmed_from(rows: DataFrame, xml: str) -> DataFrame:
    """Records of rows that hold one PubmedArticle each."""
    return pubmed(rows.select(F.from_xml(xml, PUBMED_SCHEMA).alias("r")).select("r.*"))


def pubmed(parsed: DataFrame) -> DataFrame:
    article, ids = "MedlineCitation.Article", F.col("PubmedData.ArticleIdList.ArticleId")
    of = lambda kind: F.get(F.filter(ids, lambda i: i["_IdType"] == kind), F.lit(0))["_VALUE"]
    parts = F.filter(F.col(f"{article}.Abstract.AbstractText"), lambda p: F.trim(p["_VALUE"]) != "")
    spoken = F.transform(parts, lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), F.trim(p["_VALUE"]))).otherwise(F.trim(p["_VALUE"])))
    date = F.col(f"{article}.Journal.JournalIssue.PubDate")
    author = F.transform(F.col(f"{article}.AuthorList.Author"), lambda a: F.struct(F.coalesce(a["CollectiveName"], F.concat_ws(" ", a["ForeName"], a["LastName"])).alias("full_name"), a["LastName"].alias("family_name"), a["ForeName"].alias("given_name"), a["CollectiveName"].alias("collective_name")))
    mesh = F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda h: F.struct(h["DescriptorName"]["_UI"].alias("descriptor_ui"), h["DescriptorName"]["_VALUE"].alias("label"), (h["DescriptorName"]["_MajorTopicYN"] == "Y").alias("is_major_topic")))
    return parsed.select(
        F.lit("pubmed").alias("provider"),
        F.col("MedlineCitation.PMID").alias("source_id"),
        F.col("MedlineCitation.PMID").alias("pmid"),
        of("pmc").alias("pmcid"),
        normalised_doi(of("doi")).alias("doi"),
        F.trim(F.col(f"{article}.ArticleTitle")).alias("title"),
        _blank(F.array_join(spoken, "\n\n")).alias("abstract"),
        F.col(f"{article}.Journal.Title").alias("journal"),
        F.coalesce(year_of(F.get(F.col(f"{article}.ArticleDate"), F.lit(0))["Year"]), year_of(date["Year"]), year_of(date["MedlineDate"])).alias("publication_year"),
        F.coalesce(author.cast(AUTHORS), _empty(AUTHORS)).alias("authors"),
        F.coalesce(F.col(f"{article}.PublicationTypeList.PublicationType"), _empty("array<string>")).alias("publication_types"),
        F.coalesce(mesh.cast(MESH), _empty(MESH)).alias("mesh"),
        F.lit(None).cast("boolean").alias("is_open_access"),
    )


EUROPE_PMC_SCHEMA = """id string, source string, pmid string, pmcid string, doi string, title string, abstractText string, pubYear string, isOpenAccess string,
  journalInfo struct<journal:struct<title:string>>, authorList struct<author:array<struct<fullName:string,firstName:string,lastName:string,collectiveName:string>>>,
  pubTypeList struct<pubType:array<string>>, meshHeadingList struct<meshHeading:array<struct<descriptorName:string,majorTopic_YN:string>>>"""


def europe_pmc(rows: DataFrame, json: str) -> DataFrame:
    """Records of rows with one search result each; the source id is <source>:<id>."""
    r = rows.select(F.from_json(json, EUROPE_PMC_SCHEMA).alias("r")).select("r.*")
    author = F.transform("authorList.author", lambda a: F.struct(F.coalesce(a["collectiveName"], a["fullName"]), a["lastName"], a["firstName"], a["collectiveName"]))
    mesh = F.transform("meshHeadingList.meshHeading", lambda h: F.struct(F.lit(None).cast("string"), h["descriptorName"], h["majorTopic_YN"] == "Y"))
    return r.select(
        F.lit("europe_pmc").alias("provider"),
        F.concat_ws(":", "source", "id").alias("source_id"),
        "pmid",
        "pmcid",
        normalised_doi(F.col("doi")).alias("doi"),
        F.trim("title").alias("title"),
        _blank(F.col("abstractText")).alias("abstract"),
        F.col("journalInfo.journal.title").alias("journal"),
        year_of(F.col("pubYear")).alias("publication_year"),
        F.coalesce(author.cast(AUTHORS), _empty(AUTHORS)).alias("authors"),
        F.coalesce("pubTypeList.pubType", _empty("array<string>")).alias("publication_types"),
        F.coalesce(mesh.cast(MESH), _empty(MESH)).alias("mesh"),
        (F.col("isOpenAccess") == "Y").alias("is_open_access"),
    )


def text_of_index(index: Column) -> Column:
    """A text from its inverted index, a map of words to places."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


OPENALEX_SCHEMA = """id string, doi string, title string, publication_year string, type string, is_retracted boolean, ids struct<pmid:string,pmcid:string>, open_access struct<is_oa:boolean>,
  primary_location struct<source:struct<display_name:string>>, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>"""


def openalex(rows: DataFrame, json: str) -> DataFrame:
    """Records of rows with one work each; the abstract comes from its inverted index."""
    r = rows.select(F.from_json(json, OPENALEX_SCHEMA).alias("r")).select("r.*")
    last = lambda c: _blank(F.regexp_extract(c, r"([^/]+)/?$", 1))
    author = F.transform("authorships", lambda a: F.struct(a["author"]["display_name"], F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return r.select(
        F.lit("openalex").alias("provider"),
        last("id").alias("source_id"),
        last("ids.pmid").alias("pmid"),
        last("ids.pmcid").alias("pmcid"),
        normalised_doi(F.col("doi")).alias("doi"),
        F.trim("title").alias("title"),
        _blank(text_of_index(F.col("abstract_inverted_index"))).alias("abstract"),
        F.col("primary_location.source.display_name").alias("journal"),
        year_of(F.col("publication_year")).alias("publication_year"),
        F.coalesce(author.cast(AUTHORS), _empty(AUTHORS)).alias("authors"),
        F.when(F.col("type").isNotNull(), F.array("type")).otherwise(_empty("array<string>")).alias("publication_types"),
        _empty(MESH).alias("mesh"),
        F.col("open_access.is_oa").alias("is_open_access"),
    )


CROSSREF_SCHEMA = """DOI string, title array<string>, abstract string, type string, `container-title` array<string>, author array<struct<given:string,family:string,name:string>>, issued struct<`date-parts`:array<array<int>>>"""


def crossref(rows: DataFrame, json: str) -> DataFrame:
    """Records of rows with one work each: first title, year of the first date part, abstract without its markup."""
    r = rows.select(F.from_json(json, CROSSREF_SCHEMA).alias("r")).select("r.*")
    author = F.transform("author", lambda a: F.struct(F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])), a["family"], a["given"], a["name"]))
    return r.select(
        F.lit("crossref").alias("provider"),
        normalised_doi(F.col("DOI")).alias("source_id"),
        F.lit(None).cast("string").alias("pmid"),
        F.lit(None).cast("string").alias("pmcid"),
        normalised_doi(F.col("DOI")).alias("doi"),
        F.trim(F.get("title", F.lit(0))).alias("title"),
        _blank(F.regexp_replace("abstract", "<[^>]+>", "")).alias("abstract"),
        F.get("container-title", F.lit(0)).alias("journal"),
        F.get(F.get(F.col("issued.date-parts"), F.lit(0)), F.lit(0)).alias("publication_year"),
        F.coalesce(author.cast(AUTHORS), _empty(AUTHORS)).alias("authors"),
        F.when(F.col("type").isNotNull(), F.array("type")).otherwise(_empty("array<string>")).alias("publication_types"),
        _empty(MESH).alias("mesh"),
        F.lit(None).cast("boolean").alias("is_open_access"),
    )


def interleaved(batches: list[DataFrame], order: str) -> DataFrame:
    """Rows of several sources in turn: the first of each, then the second of each; adds place."""
    from functools import reduce

    from tessera.operators import ordering

    both = reduce(lambda a, b: a.unionByName(b), [b.withColumn("_source", F.lit(i)) for i, b in enumerate(batches)])
    return ordering.interleaved(both, "_source", [order]).drop("_source")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON as rows, blank lines left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def pdf_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """Files with status: ok, too large or not a PDF; one bad file doesn't stop the others."""
    files = spark.read.format("binaryFile").load(path)
    status = F.when(F.col("length") > most, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF").otherwise("ok")
    return files.select("path", "length", status.alias("status"), F.when(status == "ok", F.sha2("content", 256)).alias("content_hash"))
