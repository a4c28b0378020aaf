import json

from quillmill.sources import files

SCOPUS = """﻿Scopus
EXPORT DATE: 1

@ARTICLE{Adams2020,
\tauthor = {Adams, A. and Baker, B.},
\ttitle = {A {Title} with p = 0.05},
\tyear = {2020},
\tnote = {Cited by: 5},
\taffiliations = {Uni X, France},
\tdoi = {10.1/a}
}

@CONFERENCE{Cole2021,
\tauthor = {Cole, C.},
\ttitle = {Other},
\tyear = {2021}
}
"""

WOS = """
@article{ WOS:1,
Author = {Adams, A. and
   Baker, B.},
Title = {A long
   title},
Year = {2001},
Cited-References = {Doe J, 1999, X; Y, V1.
   Roe R, 2000, Z.},
Times-Cited = {7},
Unique-ID = {WOS:1},
}
"""

PUBMED = """
PMID- 1
TI  - A title that
      goes on
AU  - Adams A
AU  - Baker B
MH  - One
MH  - Two
LA  - eng
DP  - 2001 May
LID - 10.1/x [doi]

PMID- 2
TI  - Second
"""


def test_bibtex(spark, tmp_path):
    (tmp_path / "s.bib").write_text(SCOPUS)
    got = {r["title"]: r for r in files.bibtex(spark, str(tmp_path / "s.bib")).collect()}
    r = got["A Title with p = 0.05"]
    assert (r["author"], r["year"], r["affiliation"], r["doi"], r["abstract"]) == ("Adams, A. and Baker, B.", "2020", "Uni X, France", "10.1/a", "UNKNOWN")
    assert "Other" in got and len(got) == 2
    assert {r["title"] for r in files.bibtex(spark, str(tmp_path / "s.bib"), literal=True).collect()} == {"A Title with p", "Other"}


def test_wos(spark, tmp_path):
    (tmp_path / "w.bib").write_text(WOS)
    (r,) = files.bibtex(spark, str(tmp_path / "w.bib"), wos=True).collect()
    assert (r["author"], r["title"], r["note"], r["references"]) == ("Adams, A. and Baker, B.", "A long title", "7", "Doe J, 1999, X, Y, V1.;Roe R, 2000, Z.")


def test_pubmed(spark, tmp_path):
    (tmp_path / "p.txt").write_text(PUBMED)
    r = {x["pubmed_id"]: x for x in files.pubmed(spark, str(tmp_path / "p.txt")).collect()}
    assert (r["1"]["title"], r["1"]["author"], r["1"]["keywords"], r["1"]["language"], r["1"]["year"], r["1"]["doi"], r["1"]["note"]) == ("A title that goes on", "Adams A and Baker B", "One; Two", "English", "2001", "10.1/x", "0")
    assert r["2"]["title"] == "Second"


def test_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Authors,Title,Year,Cited by,References\n"Adams, A.; Baker, B.","A ""b""",2001,3,"X; Y"\n')
    (r,) = files.scopus_csv(spark, str(tmp_path / "s.csv")).collect()
    assert (r["author"], r["title"], r["note"], r["references"]) == ("Adams, A. and Baker, B.", 'A "b"', "3", "X; Y")
    (tmp_path / "o.csv").write_text("id,display_name,publication_year,authorships.author.display_name,referenced_works\nW1,T,2001,A B|C D,W2|W3\n")
    (r,) = files.openalex_csv(spark, str(tmp_path / "o.csv")).collect()
    assert (r["author"], r["references"], r["openalex_id"]) == ("A B and C D", "W2; W3", "W1")


def test_openalex_json(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "doi": "https://doi.org/10.1/x", "display_name": "T", "publication_year": 2001, "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "A"}, "institutions": [{"display_name": "U", "country_code": "FR"}]}, {"author": {"display_name": "B"}, "institutions": []}], "referenced_works": ["W2"]}
    (tmp_path / "o.json").write_text(json.dumps({"results": [work]}))
    (r,) = files.openalex_json(spark, str(tmp_path / "o.json")).collect()
    assert (r["openalex_id"], r["doi"], r["abstract"], r["author"], r["institution"], r["country"], r["references"], r["year"]) == ("W1", "10.1/x", "a b", "A and B", "U; UNKNOWN", "FR; UNKNOWN", "W2", "2001")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n, m", "c")], "normalized string, candidate string")
    files.write_mapping(df, str(tmp_path / "m"))
    assert [tuple(r) for r in files.mapping_csv(spark, str(tmp_path / "m")).collect()] == [(None, "n, m", "c")]
    files.write_papers(df, str(tmp_path / "p"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).first()["normalized"] == "n, m"


def test_pubmed_line_ends(spark, tmp_path):
    (tmp_path / "p.txt").write_bytes(("\ufeff" + PUBMED.replace("\n", "\r\n")).encode())
    (tmp_path / "q.txt").write_text(PUBMED.strip())
    for name in ("p.txt", "q.txt"):
        got = {r["pubmed_id"]: r for r in files.pubmed(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"1", "2"} and got["1"]["title"] == "A title that goes on" and got["2"]["title"] == "Second"


def test_western_bytes_and_sniffed_tables(spark, tmp_path):
    (tmp_path / "w.bib").write_bytes(SCOPUS.replace("Other", "Café – “naïve”").encode("cp1252", "ignore"))
    assert "Café – “naïve”" in {r["title"] for r in files.bibtex(spark, str(tmp_path / "w.bib")).collect()}
    (tmp_path / "t.csv").write_bytes("Author;Title;Year\nAdams;\"Café; une étude\";2001\n".encode("cp1252"))
    r = files.corpus(spark, str(tmp_path / "t.csv"), "table").first()
    assert (r["author"], r["title"], r["year"], r["doi"]) == ("Adams", "Café; une étude", "2001", "UNKNOWN")


def test_one_loading_entry(spark, tmp_path):
    (tmp_path / "s.bib").write_text(SCOPUS + SCOPUS.replace("10.1/a", "10.1/other").replace("Other", "A title p"))
    got = {r["title"]: r for r in files.corpus(spark, str(tmp_path / "s.bib"), "scopus").collect()}
    # the cleaned title of a later record is that of an earlier one
    assert set(got) == {"A Title with p = 0.05", "Other", "A title p"}
    assert got["A Title with p = 0.05"]["affiliation"] == "Adams, A. Uni X, France"
    (tmp_path / "w.bib").write_text(WOS)
    assert files.corpus(spark, str(tmp_path / "w.bib"), "wos").first()["references"] == "Doe J, 1999, X, Y, V1.;Roe R, 2000, Z."
    (tmp_path / "p.txt").write_text(PUBMED)
    assert files.corpus(spark, str(tmp_path / "p.txt"), "pubmed").count() == 2


def test_affiliations_with_authors(spark):
    from pyspark.sql import functions as F

    from quillmill.operators import ingest

    df = spark.createDataFrame([("Adams, A. and Baker, B. and Cole, C.", "Uni X, France; Uni Y, Spain; Uni Z, Italy", "Baker, B.; Uni Y, Spain; email: b@y", "Adams, A (Corresponding Author), Uni X, Dept. Optics, France. Baker, B, Uni Y, Spain.")], "a string, f string, c string, w string")
    r = df.select(
        ingest.scopus_affiliations(F.col("a"), F.col("f"), F.col("c")).alias("s"), ingest.author_affiliations(F.lit("A and B"), F.col("f")).alias("p"),
        ingest.wos_affiliations(F.lit("Adams, A. B.; Uni Rome. Cole, C., Uni Oslo.")).alias("w"), ingest.wos_backfilled(F.lit("UNKNOWN"), F.lit("Adams, A (Corresponding Author), Uni X, France. Baker, B, Uni Y, Spain.")).alias("b"),
    ).first()
    assert r["s"] == "Baker, B. Uni Y, Spain; Adams, A. Uni X, France; Cole, C. Uni Z, Italy"
    assert r["p"] == "A Uni X, France; B Uni Y, Spain; Uni Z, Italy"
    assert r["w"] == "Adams, A. B., Uni Rome; Cole, C., Uni Oslo"
    assert r["b"] == "Uni X, France. B, Uni Y, Spain"


def test_words_of_other_languages(spark):
    import pytest

    from quillmill.operators import text

    assert "und" in text.stop_words("German") and text.stop_words("polish", {"polish": ["i", "w"]}) == ("i", "w")
    with pytest.raises(ValueError, match="Polish"):
        text.stop_words("Polish")
    docs = spark.createDataFrame([("kot i pies",), ("i dom",), (None,)], "t string")
    assert [tuple(r) for r in text.frequent_words(docs, "t", 0.6).collect()] == [("i", 2)]
