"""The stages one after the other over a few saved payloads, and the command line."""

from __future__ import annotations

import json

import pytest

from lodestone import __main__ as command
from lodestone import stages
from lodestone.operators import papers
from lodestone.sources import config as configs
from lodestone.sources import files, versioned

GOOD = "Iron with H2 gave a chiral product in asymmetric hydrogenation. It had 95% ee and 90% yield. Table 1 shows the substrate scope. BINAP in THF at 20 C for 5 h."


STANDARD = "DOI Title Authors Year Journal Metal_catalyst Ligand Substrate_class Substrate_example Product ee_percent yield_percent H2_pressure_bar Temperature_C Solvent Reaction_time_h TON TOF Notes Evidence_sentence Page_number PDF_path".split()


@pytest.fixture
def project(spark, tmp_path):
    at = "https://openalex.org/W"
    works = [
        {"id": f"{at}1", "title": "Iron catalyst asymmetric hydrogenation with H2", "doi": "10.1/a", "type": "article", "publication_year": 2020, "cited_by_count": 5, "abstract_inverted_index": {"h2": [0]}, "referenced_works": [f"{at}2", "https://doi.org/10.1/x"], "query": "q1"},
        {"id": f"{at}1b", "title": "Iron catalyst asymmetric hydrogenation with H2", "doi": "https://doi.org/10.1/A", "type": "article", "query": "q2"},
        {"id": f"{at}2", "title": "A review of iron", "doi": "10.1/b", "type": "review", "cited_by_count": 9, "referenced_works": [f"{at}8", f"{at}1", f"{at}404", f"{at}8"], "query": "q1"},
        {"id": f"{at}3", "title": "Hydrosilylation", "doi": "10.1/c", "type": "article", "query": "q1"},
    ]
    more = [
        {"id": f"{at}8", "title": "Cobalt hydrogenation of olefins", "doi": "10.1/h", "type": "preprint", "publication_year": 2021},
        {"id": f"{at}9", "title": "Later work on iron", "doi": "10.1/i", "type": "article", "referenced_works": [f"{at}1"]},
    ]
    (tmp_path / "works.json").write_text("\n".join(map(json.dumps, [*works, *more])))
    refused = [{"source_database": "OpenAlex", "search_query": "q2", "error": "timeout"}]
    (tmp_path / "errors.json").write_text("\n".join(map(json.dumps, refused)))
    (tmp_path / "openalex.json").write_text("\n".join(map(json.dumps, works)))
    (tmp_path / "base.yaml").write_text("search: {per_query: 12, sources: [openalex, crossref]}\npdf_download: {min_pdf_bytes: 100}\noutput: {outputs_dir: out, logs_dir: logs, data_subdir: data, prefix: T}\n")
    (tmp_path / "own.yaml").write_text(f"project: {{name: Fe run/1}}\nsearch:\n  query_groups: {{g: [q1, q2]}}\n  payloads: {{openalex: {tmp_path}/openalex.json, crossref: {tmp_path}/absent.json}}\n  works: {tmp_path}/works.json\n  errors: {tmp_path}/errors.json\npdf_download: {{attempts: {tmp_path}/attempts}}\nfulltext: {{pages: {tmp_path}/pages}}\nextraction: {{columns: [{", ".join(STANDARD)}]}}\n")
    attempts = [(1, 1, "Unpaywall", "http://x/1", bytearray(b"<html>"), "text/html"), (1, 2, "OpenAlex", "http://x/2", bytearray(b"%PDF-1.7" + b"0" * 200), "application/pdf")]
    spark.createDataFrame(attempts, "row long, ordinal int, source string, url string, content binary, content_type string").write.parquet(f"{tmp_path}/attempts")
    spark.createDataFrame([(1, 1, GOOD), (1, 2, "Under 50 bar of hydrogen. End.")], "row long, page_no int, text string").write.parquet(f"{tmp_path}/pages")
    return stages.load_config(str(tmp_path / "own.yaml"), str(tmp_path / "base.yaml"))


def test_stages(spark, project, tmp_path):
    assert project["output"]["data_subdir"] == f"{tmp_path}/data" and project["search"]["per_query"] == 12
    with pytest.raises(FileNotFoundError):
        stages.run(spark, "title_abstract_screening", project)
    with pytest.raises(ValueError):
        stages.run(spark, "nonsense", project)
    s = stages.run(spark, "literature_search", project)
    # the review cites W8 (new) and W1; W1 cites the review and is cited by it and by W9 (new)
    assert (s["raw_records"], s["citation_records"], s["deduplicated_records"]) == (4, 5, 5)
    master = {r.openalex_id[-2:]: r for r in spark.read.parquet(f"{tmp_path}/data/master_records").collect()}
    assert set(master) == {"W1", "W2", "W3", "W8", "W9"} and master["W8"].source_database == "OpenAlex review reference list" and master["W8"].record_type == "primary"
    assert master["W9"].source_database == "OpenAlex forward citations" and master["W1"].source_database == "OpenAlex; OpenAlex review reference list"
    calls = {(r.search_group, r.search_query): (r.results_returned, r.status) for r in spark.read.parquet(f"{tmp_path}/data/search_log").where("search_mode = 'citation chasing'").collect()}
    first = "Iron catalyst asymmetric hydrogenation with H2"
    assert calls == {("review reference list", "A review of iron"): ("2", "OK"), ("backward citations", first): ("1", "OK"), ("forward citations", first): ("2", "OK")}
    assert spark.read.json(f"{tmp_path}/logs/pipeline").where("event = 'search_source_error'").count() == 1
    log = {r.search_query: r for r in spark.read.parquet(f"{tmp_path}/data/search_log").collect()}
    assert (log["q1"].results_returned, log["q2"].results_returned, log["q1"].status, log["q2"].status, log["q2"].notes, log["q1"].search_group) == ("3", "0", "OK", "ERROR", "timeout", "g")
    s = stages.run(spark, "title_abstract_screening", project)
    assert (s["total"], s["excluded"], s["strict_h2"]) == (5, 1, 1)
    with pytest.raises(IndexError):
        stages.run(spark, "pdf_download", project, row=2)
    assert stages.run(spark, "pdf_download", project) == {"success": 1, "failed": 0, "reused": 0}
    assert stages.run(spark, "pdf_download", project, row=1) == {"success": 0, "failed": 0, "reused": 1}
    lines = versioned.read(spark, f"{tmp_path}/logs/downloads", stages._DOWNLOADS).collect()
    assert versioned.version(spark, f"{tmp_path}/logs/downloads") == 2
    assert [(r.row, r.status, r.pdf_path) for r in lines] == [(1, "REUSED", "10.1_a.pdf")]
    s = stages.run(spark, "fulltext_screening", project)
    assert (s["screened"], s["confirmed"]) == (1, 1)
    assert stages.run(spark, "reaction_data_extraction", project)["records_extracted"] == 1
    r = spark.read.parquet(f"{tmp_path}/data/reaction_data").first()
    got = r.asDict()
    assert list(got) == STANDARD and got.pop("Evidence_sentence") and got.pop("Notes")
    want = {"DOI": "10.1/a", "Title": "Iron catalyst asymmetric hydrogenation with H2", "Year": "2020", "Metal_catalyst": "Iron", "Ligand": "BINAP", "ee_percent": "95.0", "yield_percent": "90.0", "H2_pressure_bar": "50", "Temperature_C": "20", "Solvent": "THF", "Reaction_time_h": "5", "PDF_path": "10.1_a.pdf"}
    assert {k: v for k, v in got.items() if v} == want
    with pytest.raises(ValueError):
        papers.with_columns(spark.read.parquet(f"{tmp_path}/data/reaction_data"), ["DOI", "H2_presure_bar"])
    states = files.RunLog(spark, f"{tmp_path}/logs/states").states().collect()
    assert {x.stage for x in states if x.status == "done"} == set(stages.RUN) and all(x.run_id.startswith("Fe_run_1_") for x in states)


def test_command_line(spark, project, tmp_path, capsys):
    args = ["--config", str(tmp_path / "own.yaml"), "--base", str(tmp_path / "base.yaml")]
    assert command.main(["literature-search", *args, "--per-query", "2"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["raw_records"] == 3
    (tmp_path / "paper.txt").write_text(GOOD)
    assert command.main(["extract-text", "--input", str(tmp_path / "paper.txt"), "--context", "0"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["ee_percent"] == 95.0
    (tmp_path / "gold.jsonl").write_text(json.dumps({"text": GOOD, "expected": [{"ee_percent": "95", "solvent": "thf"}]}) + "\n")
    assert command.main(["benchmark", str(tmp_path / "gold.jsonl"), "--json"]) == 0
    scored = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert scored["examples"] == 1 and scored["field_accuracy"]["ee_percent"] == 1.0
    assert command.main(["benchmark", "--dataset", str(tmp_path / "gold.jsonl")]) == 0
    assert "examples: 1" in capsys.readouterr().out
    near = "First line. It gave 95% ee. Then 90% yield of it. Last."
    rows = [{"text": near, "expected": [{"ee_percent": 95, "comment": "none", "yield_percent": None}, {"yield_percent": 90}]}, {"text": near, "context_sentences": 2, "expected": [{"ee_percent": 95, "yield_percent": 90}]}, {"text": near, "expected": [{"ee_percent": 1}]}]
    (tmp_path / "gold2.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert command.main(["benchmark", str(tmp_path / "gold2.jsonl"), "--json"]) == 0
    scored = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert (scored["examples"], round(scored["candidate_count_accuracy"], 4)) == (3, 0.6667)
    assert {k: round(v, 4) for k, v in scored["field_accuracy"].items() if v is not None} == {"ee_percent": 0.6667, "yield_percent": 1.0} and round(scored["macro_field_accuracy"], 4) == 0.8333
    with pytest.raises(SystemExit):
        command.main(["benchmark"])


def test_settings():
    cfg = {"search": {"openalex_email": "own@x", "semantic_scholar_api_key": "k"}}
    assert configs.settings(cfg, {"OPENALEX_EMAIL": "env@x"}) == {"openalex_email": "env@x", "semantic_scholar_api_key": "k", "unpaywall_email": ""}
    assert configs.with_limits(cfg, per_query=3, max_reviews=None)["search"]["per_query"] == 3


def test_files(spark, tmp_path):
    assert files.read_log(spark, str(tmp_path / "none"), "row long").count() == 0
    files.write_json(spark.createDataFrame([(1, "a"), (2, "é")], "n int, t string").coalesce(1), str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text(encoding="utf-8")) == [{"n": 1, "t": "a"}, {"n": 2, "t": "é"}]
    files.write_json(spark.createDataFrame([], "n int"), str(tmp_path / "y.json"))
    assert json.loads((tmp_path / "y.json").read_text()) == []
    d = spark.createDataFrame([(1, None)], "a int, b string")
    for library, call in (("pypdf", lambda: files.read_pdf_pages(spark, str(tmp_path))), ("openpyxl", lambda: files.write_workbook({"s": d}, str(tmp_path / "x.xlsx")))):
        try:
            __import__(library)
        except ImportError:
            with pytest.raises(RuntimeError, match=library):
                call()


def test_refused_calls(spark):
    from lodestone.operators import search

    log = spark.createDataFrame([(s, q, "1", "OK", "") for s in ("OpenAlex", "Semantic Scholar") for q in ("a", "b", "c", "d")], "source_database string, search_query string, results_returned string, status string, notes string")
    calls = [(s, q, i, 429 if (s, q) in (("Semantic Scholar", "b"), ("Semantic Scholar", "d"), ("OpenAlex", "a")) else None) for s in ("OpenAlex", "Semantic Scholar") for i, q in enumerate("abcd")]
    got = {(r.source_database, r.search_query): (r.results_returned, r.status) for r in search.with_refusals(log, spark.createDataFrame(calls, "source_database string, search_query string, ord long, http_status int")).collect()}
    assert {k: v for k, v in got.items() if k[0] == "Semantic Scholar"} == {("Semantic Scholar", "a"): ("1", "OK"), ("Semantic Scholar", "b"): ("0", "RATE LIMITED")}
    assert sum(k[0] == "OpenAlex" for k in got) == 4 and {v for k, v in got.items() if k[0] == "OpenAlex"} == {("1", "OK")}
