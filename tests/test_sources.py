"""Sources, exports and budgets on small documents."""

import json

from pyspark.sql import functions as F

from tessera.operators import budgets, exports
from tessera.sources import literature as L

PUBMED = """<PubmedArticle><MedlineCitation><PMID Version="1">123</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue><Title>J</Title></Journal>
<ArticleTitle> A title </ArticleTitle><Abstract><AbstractText Label="AIM">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><ForeName>A</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
<PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList></Article>
<MeshHeadingList><MeshHeading><DescriptorName UI="D9" MajorTopicYN="Y">Neoplasms</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">123</ArticleId><ArticleId IdType="doi">10.1/AB</ArticleId><ArticleId IdType="pmc">PMC7</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""


def test_pubmed(spark, tmp_path):
    r = L.pubmed_from(spark.createDataFrame([(PUBMED,)], "x string"), "x").first()
    assert (r["pmid"], r["doi"], r["pmcid"], r["title"], r["journal"], r["publication_year"]) == ("123", "10.1/ab", "PMC7", "A title", "J", 1999)
    assert r["abstract"] == "AIM: First.\n\nSecond." and [a["full_name"] for a in r["authors"]] == ["A Li", "The Group"]
    assert r["mesh"][0]["is_major_topic"] and r["publication_types"] == ["Review"]
    (tmp_path / "a.xml").write_text(f"<PubmedArticleSet>{PUBMED}{PUBMED.replace('123', '124')}</PubmedArticleSet>")
    assert sorted(x["pmid"] for x in L.read_pubmed(spark, str(tmp_path / "a.xml")).collect()) == ["123", "124"]


def test_json_providers(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),)], "j string")
    e = L.europe_pmc(one({"id": "5", "source": "MED", "pmid": "5", "doi": "https://doi.org/10.2/X", "title": "T", "pubYear": "2020", "isOpenAccess": "Y", "authorList": {"author": [{"fullName": "Li A"}]}, "meshHeadingList": {"meshHeading": [{"descriptorName": "M", "majorTopic_YN": "N"}]}}), "j").first()
    assert (e["source_id"], e["doi"], e["publication_year"], e["is_open_access"], e["mesh"][0]["label"]) == ("MED:5", "10.2/x", 2020, True, "M")
    o = L.openalex(one({"id": "https://openalex.org/W1", "doi": None, "title": "T", "publication_year": 2021, "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/77"}, "abstract_inverted_index": {"a": [0, 2], "b": [1]}, "open_access": {"is_oa": False}}), "j").first()
    assert (o["source_id"], o["pmid"], o["abstract"], o["publication_year"], o["authors"]) == ("W1", "77", "a b a", 2021, [])
    c = L.crossref(one({"DOI": "10.3/Y", "title": ["First", "Second"], "abstract": "<p>x</p>", "issued": {"date-parts": [[2018, 5]]}, "author": [{"given": "A", "family": "Li"}]}), "j").first()
    assert (c["doi"], c["title"], c["abstract"], c["publication_year"], c["authors"][0]["full_name"]) == ("10.3/y", "First", "x", 2018, "A Li")


def test_interleave_and_files(spark, tmp_path):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k string") for ks in (["ash"], ["birch", "cedar", "dogwood", "elm"]))
    assert [r["k"] for r in L.interleaved([a, b], "k").orderBy("place").collect()] == ["ash", "birch", "cedar", "dogwood", "elm"]
    for name, data in (("ok.pdf", b"%PDF-1.7"), ("bad.pdf", b"hello"), ("big.pdf", b"%PDF-" + b"0" * 99)):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r["status"] for r in L.pdf_files(spark, str(tmp_path), 50).collect()}
    assert got == {"ok.pdf": "ok", "bad.pdf": "not a PDF", "big.pdf": "too large"}
    (tmp_path / "g.jsonl").write_text('{"q": "a"}\n\n{"q": "b"}\n')
    assert sorted(r["q"] for r in L.jsonl(spark, str(tmp_path / "g.jsonl"), "q string").collect()) == ["a", "b"]


def test_exports(spark):
    df = spark.sql("select '9' pmid, '10.1/x' doi, 'A title' title, array('Li A', 'Wu B') au, 'J' journal, 2020 year")
    r = df.select(exports.ris(F.col("title"), F.col("au"), F.col("journal"), F.col("year"), F.col("doi")), exports.bibtex(exports.citation_key(F.col("pmid"), F.col("doi"), F.col("title")), F.col("title"), F.col("au"), F.lit(None).cast("string"), F.col("year"), F.col("doi")), exports.citation_key(F.lit(None).cast("string"), F.col("doi"), F.col("title")), exports.cited(F.col("au"), F.col("title"), F.col("year"))).first()
    assert r[0] == "TY  - JOUR\nTI  - A title\nAU  - Li A\nAU  - Wu B\nJO  - J\nPY  - 2020\nDO  - 10.1/x\nER  - "
    assert r[1] == "@article{sb_9,\n  title = {A title},\n  author = {Li A and Wu B},\n  year = {2020},\n  doi = {10.1/x}\n}" and r[2] == "10_1_x" and r[3] == "Li A, Wu B. A title. 2020"
    answers = spark.createDataFrame([(1, "See [E1] and [E9].", ["E2", "E1", "E2", "E7"])], "answer_id int, text string, ids array<string>")
    refs = spark.createDataFrame([("E1", "one"), ("E2", "two")], "id string, text string")
    assert [x["text"] for x in exports.reference_list(answers, refs).orderBy("number").collect()] == ["[1] two", "[2] one"]
    c = exports.without_unknown(answers, F.array(F.lit("E1"), F.lit("E2"))).first()
    assert (c["text"], c["ids"], sorted(c["removed"])) == ("See [E1] and .", ["E2", "E1"], ["E7", "E9"])
    runs = spark.createDataFrame([("G0", 0.5), ("G1", 0.75)], "config string, recall double")
    assert sorted(x["line"] for x in exports.ablation_table(runs, "G0").collect()) == ["| G0 | 0.5000 | +0.0% |", "| G1 | 0.7500 | +50.0% |"]
    p = exports.audit_package(spark.sql("select 1 run_id, 'q' question"), spark.sql("select 1 run_id, 2 step, 'b' kind, 'y' detail union all select 1, 1, 'a', 'x'")).first()["package"]
    assert json.loads(p)["steps"][0]["kind"] == "a"


def test_budgets(spark):
    r = spark.sql("select repeat('a', 100) x, 'short' y").select(budgets.head_and_tail(F.col("x"), 47), budgets.head_and_tail(F.col("y"), 47)).first()
    assert len(r[0]) == 47 and r[0].startswith("a" * 30) and r[0].endswith("a" * 10) and r[1] == "short"
    t = spark.sql("select 'one two three four' x, 3 b union all select '', 3 union all select '癌症', 1").select(budgets.token_prefix(F.col("x"), F.col("b"))).collect()
    assert [x[0] for x in t] == ["one two…", "", "癌…"]
    s = spark.sql("select 1 g, 'a' k, 10 n union all select 1, 'b', 500 union all select 1, 'c', 600")
    assert {x["k"]: x["share"] for x in budgets.fitted_shares(s, "g", "k", "n", 700).collect()} == {"a": 10, "b": 345, "c": 345}
    a = spark.createDataFrame([(1, "a", 0.9, ["x", "y"], True), (1, "b", 0.8, ["x", "y"], False), (1, "c", 0.7, ["z"], True), (1, "d", 0.6, ["w"], False), (1, "e", 0.5, ["v"], False)], "g int, action string, score double, terms array<string>, is_external boolean")
    got = {x["action"]: x["reason"] for x in budgets.diverse_actions(a, "g", 2, 1).collect()}
    assert got == {"a": "chosen", "b": "too similar", "c": "external budget", "d": "chosen", "e": "action budget"}
