from __future__ import annotations

import json

import pytest

from lodestone.__main__ import score
from lodestone.functions.sentences import sentence_spans
from lodestone.operators.candidates import extract_candidates
from lodestone.operators.papers import extract_papers
from pyspark.sql import functions as F

PAPER = "The Co catalyst used (R)-BINAP and a ketone. Under 2 MPa H2 at 25 °C for 12 h in toluene the product formed. It had 97.5% ee and 93% yield."
LINES = "Run A: 10 bar, 82% ee.\nRun B: 50 bar, 96% ee."


def one(spark, text, context):
    return [r.asDict() for r in extract_candidates(spark.createDataFrame([("d", text)], "doc_id string, text string"), context=context).orderBy("candidate_id").collect()]


def test_values_of_a_window(spark):
    (c,) = one(spark, PAPER, 2)
    assert (c["ee_percent"], c["yield_percent"], c["h2_pressure_bar"], c["temperature_c"], c["reaction_time_h"]) == (97.5, 93.0, 20.0, 25.0, 12.0)
    assert (c["ligand"], c["solvent"], c["substrate_class"], c["confidence"]) == ("BINAP", "toluene", "ketone", 1.0)
    assert c["evidence_text"] == PAPER and (c["evidence_start"], c["evidence_end"]) == (0, len(PAPER))


def test_context_decides_the_number_of_windows(spark):
    assert [(c["ee_percent"], c["h2_pressure_bar"]) for c in one(spark, LINES, 0)] == [(82.0, 10.0), (96.0, 50.0)]
    (c,) = one(spark, LINES, 2)
    assert c["candidate_id"] == "rxn-0001" and c["ee_percent"] == 82.0
    with pytest.raises(ValueError):
        one(spark, LINES, -1)


@pytest.mark.parametrize(
    ("text", "context", "ids"),
    [
        ("1% ee. 2% ee. Other. 3% ee.", 2, ["rxn-0001", "rxn-0002", "rxn-0003"]),
        ("1% ee. 2% ee. 3% ee.", 2, ["rxn-0001"]),
        ("No. 1% ee. 2% ee. No. No. 3% ee.", 4, ["rxn-0001", "rxn-0003"]),
        ("", 0, []),
        ("   ", 2, []),
        (None, 2, []),
        ("Nothing here. At all.", 1, []),
    ],
)
def test_numbers_are_given_before_equal_windows_go(spark, text, context, ids):
    assert [c["candidate_id"] for c in one(spark, text, context)] == ids


@pytest.mark.parametrize(
    ("text", "field", "value"),
    [
        ("only 95% ee.", "confidence", 0.40),
        ("only 80% yield.", "confidence", 0.35),
        ("20-25 °C gave 90% ee.", "temperature_c", -25.0),
        ("13C NMR, 1H NMR, 90% ee.", "temperature_c", 13.0),
        ("1 atm, 9% ee.", "h2_pressure_bar", 1.0132),
        ("100 psi, 9% ee.", "h2_pressure_bar", 6.8948),
        ("500 kPa, 9% ee.", "h2_pressure_bar", 5.0),
        ("Xyl-BINAP, 9% ee.", "ligand", "Xyl-BINAP"),
        ("H₂ was used, 9% ee.", "confidence", 0.43),
    ],
)
def test_single_values(spark, text, field, value):
    assert one(spark, text, 0)[0][field] == value


def test_spans_are_exact_in_code_points(spark):
    text = "Ä 😀 one.  Two!\n\nThree four? five"
    spans = spark.createDataFrame([(text,)], "t string").select(F.explode(sentence_spans(F.col("t"))).alias("s")).select("s.*").collect()
    assert [s.text for s in spans] == ["Ä 😀 one.", "Two!", "Three four?", "five"]
    assert all(text[s.start : s.end] == s.text for s in spans)


def test_long_text_takes_more_than_one_step(spark):
    text = " ".join(f"s{i}." for i in range(700))
    spans = spark.createDataFrame([(text,)], "t string").select(F.explode(sentence_spans(F.col("t"))).alias("s")).select("s.*").collect()
    assert len(spans) == 700 and all(text[s.start : s.end] == s.text for s in spans)


def test_papers(spark):
    text = "Iron and H2 gave 81% ee, 94.5% ee and 90% ee; 62% yield, 91.5% yield under 1.5 MPa hydrogen at 25 °C for 18 h. TON = 1200 and TOF: 66.7 h-1. Trost ligand, KETONE, Toluene."
    rows = [("a", text, True), ("b", text, False), ("c", " \n", True), ("d", None, True)]
    got = {r.doc_id: r for r in extract_papers(spark.createDataFrame(rows, "doc_id string, text string, pdf boolean"), has_pdf="pdf").collect()}
    a = got["a"]
    assert (a.ee_percent, a.yield_percent, a.h2_pressure, a.temperature_c, a.reaction_time_h, a.ton, a.tof) == ("94.5", "91.5", "1.5", "25", "18", "1200", "66.7")
    assert (a.metal_catalyst, a.ligand, a.substrate_class, a.solvent) == ("Iron", "Trost", "KETONE", "Toluene")
    assert a.evidence_sentence.startswith("Iron and H2 gave 81% ee")
    assert got["b"].notes.startswith("No PDF") and got["c"].notes.startswith("PDF text") and got["d"].ee_percent == ""


def test_score(spark):
    rows = [("1", LINES, [{"ee_percent": "82", "ligand": None}, {"ee_percent": "96.0"}]), ("2", "5% ee.", [{"ee_percent": "6"}]), ("3", "x.", [])]
    r = score(spark.createDataFrame(rows, "doc_id string, text string, expected array<map<string,string>>")).first()
    assert r.examples == 3 and r.candidate_count_accuracy == 1.0
    assert r.field_accuracy["ee_percent"] == pytest.approx(2 / 3) and r.field_accuracy["ligand"] == 1.0 and r.field_accuracy["solvent"] is None
    empty = score(spark.createDataFrame([], "doc_id string, text string, expected array<map<string,string>>")).first()
    assert (empty.examples, empty.candidate_count_accuracy, empty.macro_field_accuracy) == (0, 0.0, 0.0)
    assert json.dumps(empty.asDict(recursive=True))


def test_evidence_is_the_text_between_its_places(spark):
    from lodestone.operators.candidates import windows

    gaps = ["  ", "\n\n ", " \t", "\u00a0 ", "\n", " \u2003\n"]
    text = "".join(f"{'é' if i % 3 else 'e'} number {i} gave {i % 90}% ee.{gaps[i % 6]}{gaps[i % 4] if i % 5 == 0 else ''}" for i in range(400)) + "tail"
    d = spark.createDataFrame([("d", "  \n" + text, 3), ("e", text, 0)], "doc_id string, text string, around int")
    texts = {"d": "  \n" + text, "e": text}
    rows = windows(d, context="around").collect()
    assert len(rows) > 700 and all(r.evidence == texts[r.doc_id][r.start : r.end] for r in rows)


def test_places_beyond_four_digits_stay_in_order(spark):
    found = one(spark, " ".join(f"Run {i} gave {i % 90 + 1}% ee." for i in range(12_000)), 0)
    assert len(found) == 12_000 and {c["evidence_text"] for c in found[:3]} <= {f"Run {i} gave {i % 90 + 1}% ee." for i in range(12_000)}
