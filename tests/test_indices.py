"""Golden values, edge cases and orientation of the 47 indices."""

import csv
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glucoframe.operators.calculate import calculate_long, calculate_wide
from glucoframe.operators.catalog import (
    DEFERRED,
    INDEX_IDS,
    INDICES,
    METHODS,
    NEGATED,
    SOURCES,
    VERIFICATION,
    describe_selection,
    display_order,
    index,
    resolve_selection,
)
from glucoframe.operators.weight import cohort_weight
from glucoframe.settings import AvignonWeight, BelfioreMeans, ConversionSettings, UnitChoice
from glucoframe.sources.cohort_files import canonical, read_cohort

GOLDEN = Path(__file__).parent / "golden"
NGT_M = dict(
    age=45.0, sex="male", weight=78.0, bmi=24.1, waist=86.0, tg=1.1, hdl=1.45, ffa0=0.45,
    g0=5.1, g30=7.8, g60=7.2, g90=6.4, g120=5.9, i0=42.0, i30=310.0, i60=365.0, i90=290.0, i120=210.0,
    fat_mass=17.5, rate_glycerol=2.6, rate_palmitate=1.9, gl0=8.0, gl30=5.9, gl60=4.6, gl120=4.9,
)
SCHEMA = "participant_id string, sex string, " + ", ".join(f"{k} double" for k in NGT_M if k != "sex")


def person(spark, changes=(), only=None):
    values = {**(NGT_M if only is None else dict.fromkeys(NGT_M)), **dict(changes)}
    names = ["participant_id", "sex"] + [k for k in NGT_M if k != "sex"]
    return spark.createDataFrame([tuple(values.get(n, "x") for n in names)], SCHEMA)


def results(df, **more):
    return {r.method_id: r for r in calculate_long(df, **more).collect()}


@pytest.fixture(scope="module")
def golden(spark):
    cohort = read_cohort(spark, str(GOLDEN / "inputs.csv")).require_usable()
    return cohort.rows


def golden_values():
    with open(GOLDEN / "values.csv") as f:
        return {(row["index"], p): v for row in csv.DictReader(f) for p, v in row.items() if p != "index"}


def test_golden_values(golden):
    wide = {r.participant_id: r.asDict() for r in calculate_wide(golden).collect()}
    expected = golden_values()
    assert len(expected) == 47 * 8
    for (id_, who), text in expected.items():
        got = wide[who][id_]
        if text == "":
            assert got is None, (id_, who)
        else:
            assert got == pytest.approx(float(text), rel=1e-9), (id_, who)


def test_golden_cohort_weight(golden):
    weight = cohort_weight(golden)
    assert weight.source == "sample" and weight.pairs == 8
    assert weight.value == pytest.approx(0.12729115933281188, rel=1e-12)
    row = results(golden.where("participant_id = 'EX1'"), weight=weight)["avignon_sim"]
    assert row.value == pytest.approx((weight.value * 90.7029478458 + 8.14000814001) / 2, rel=1e-9)
    assert row.warnings == list(weight.warnings)


def test_one_row_per_method_and_deferred_ones(spark):
    rows = calculate_long(person(spark)).collect()
    assert [r.method_id for r in rows] == [m.id for m in METHODS] and len(rows) == 50
    by_id = {r.method_id: r for r in rows}
    for d in DEFERRED:
        assert by_id[d.id].status == "unavailable" and by_id[d.id].reasons[0].startswith("not included in this version: ")
    assert all(by_id[i].status == "ok" for i in INDEX_IDS)


def test_empty_input(spark):
    rows = results(person(spark, only=()))
    assert all(r.status == "unavailable" and r.reasons and r.value is None for r in rows.values())
    assert rows["homa_ir"].reasons == ["requires fasting glucose", "requires fasting insulin"]
    assert rows["quicki"].reasons == ["requires fasting insulin", "requires fasting glucose"]
    assert rows["avignon_sim"].reasons == [
        "requires fasting glucose", "requires fasting insulin", "requires body weight", "requires 120-min glucose",
        "requires 120-min insulin",
    ]


@pytest.mark.parametrize(
    "changes, id_, status, reason",
    [
        ({"g0": 0.0}, "quicki", "error", "Fasting glucose must be a finite value > 0 (log10 is undefined otherwise)."),
        ({"g0": 0.0}, "homa_ir", "error", "Fasting glucose must be a finite value > 0 (got 0)."),
        ({"i0": -5.0}, "homa_ir", "error", "Fasting insulin must be a finite value > 0 (got -5)."),
        ({"i0": -5.5}, "firi", "error", "Fasting insulin must be a finite value > 0."),
        ({"i0": None}, "homa_ir", "unavailable", "requires fasting insulin"),
        ({"i0": None, "g0": 0.0}, "homa_ir", "unavailable", "requires fasting insulin"),
        ({"g0": float("nan")}, "homa_ir", "error", "Fasting glucose must be a finite value > 0 (got NaN)."),
        ({"g0": float("inf")}, "isi_basal", "error", "Fasting glucose must be a finite value > 0 (got Infinity)."),
        ({"sex": None}, "vai", "unavailable", "requires sex (male/female)"),
        ({"sex": None}, "bigtt_si", "unavailable", "requires sex (male/female)"),
        ({"sex": "other"}, "lap", "error", "Sex must be male or female."),
        ({"weight": None}, "gutt", "unavailable", "requires body weight"),
        ({"g0": 3.5}, "homa_beta", "unavailable", "not defined when fasting glucose is 3.5 mmol/L or lower"),
        ({"g30": 70 / 18}, "cir30", "unavailable", "not defined when 30-min glucose is 70 mg/dL or lower"),
        ({"g30": 5.1}, "insulinogenic_dg30", "unavailable", "not defined when 30-min glucose equals fasting glucose"),
        ({"gl60": None}, "glucagon_suppression_pct_60", "unavailable", "requires 60-min glucagon"),
        ({"gl60": None}, "glucagon_auc", "ok", None),
        ({"gl0": 0.0}, "glucagon_fasting", "error", "Fasting glucagon must be a finite value > 0 (got 0)."),
        ({"g0": 1 / 18, "i0": 6.0}, "quicki", "error", "log10(I0) + log10(G0) is zero; QUICKI is undefined."),
        ({"i0": 6.0, "i120": 6.0}, "gutt", "error",
         "Result is not finite for these inputs (division by zero or log of a non-positive value)."),
    ],
)
def test_edge_cases(spark, changes, id_, status, reason):
    row = results(person(spark, changes))[id_]
    assert row.status == status
    assert (row.value is not None) == (status == "ok")
    assert row.reasons == ([] if reason is None else [reason])


def test_one_microunit_of_insulin_stays_finite(spark):
    rows = results(person(spark, {"i0": 6.0}))
    assert rows["quicki"].status == "ok" and rows["mcauley"].status == "ok"


def test_sim_error_beats_missing_and_merges_reasons(spark):
    row = results(person(spark, {"g0": None, "i120": -1.0}))["avignon_sim"]
    assert row.status == "error"
    assert row.reasons == ["requires fasting glucose", "120-min insulin must be a finite value > 0 (got -1)."]


def test_belfiore_forms(spark):
    both = results(with_ffa(spark), details=True)
    assert both["belfiore_isi_ffa"].details["form"] == "area" and both["belfiore_isi_ffa"].details["variant"] == "0_1_2h"
    assert both["belfiore_isi_ffa"].warnings == []
    one = results(person(spark, {"i60": None}), details=True)
    assert one["belfiore_isi_gly"].warnings[0].startswith("60-min value present for only one")
    assert one["belfiore_isi_gly"].details["variant"] == "0_2h"
    assert one["belfiore_isi_gly"].value == pytest.approx(2 / ((252 / 363.04) * (11.0 / 10.26) + 1), rel=1e-12)
    assert one["belfiore_isi_ffa"].warnings[0].startswith("Basal form used")
    bad = results(person(spark, {"g60": 0.0}))["belfiore_isi_gly"]
    assert bad.status == "error" and bad.reasons == ["glucose at 60 min must be a finite value > 0 (got 0)."]
    unused = results(person(spark, {"g60": 0.0, "i60": None}))["belfiore_isi_gly"]
    assert unused.status == "ok"


def with_ffa(spark):
    return person(spark).withColumn("ffa60", F.lit(0.2)).withColumn("ffa120", F.lit(0.1))


def test_belfiore_means(spark):
    rows = results(person(spark), means=BelfioreMeans(insulin_0=60.0, glucose_0=-1.0))
    assert rows["belfiore_basal"].status == "error"
    assert rows["belfiore_basal"].reasons == ["Reference glucose_0 must be a finite value > 0 (got -1)."]
    assert rows["belfiore_isi_gly"].status == "unavailable"
    assert rows["belfiore_isi_gly"].reasons == [
        "requires normal-population reference means (0_1_2h area for insulin and glucose)"
    ]


def test_orientation(spark):
    published = results(person(spark, {"waist": 65.0}))
    turned = {r.method_id: r for r in calculate_long(person(spark, {"waist": 65.0}), orientation="sensitivity").collect()}
    assert len(NEGATED) == 14 and "firi" in NEGATED
    for id_ in INDEX_IDS:
        if id_ in NEGATED:
            row = turned[f"{id_}_inv"]
            assert row.value == -published[id_].value and row.orientation == "sensitivity"
            assert row.direction == "higher_more_sensitive"
        else:
            assert turned[id_].value == published[id_].value
    zero = turned["lap_inv"].value
    assert zero == 0 and str(zero) == "0.0"


def test_settings_change_results(spark):
    default, other = results(person(spark)), results(person(spark), settings=ConversionSettings(insulin_pmol_per_uu=6.945))
    assert other["homa_ir"].value == pytest.approx(default["homa_ir"].value * 6 / 6.945, rel=1e-12)
    given = results(person(spark), weight=AvignonWeight.given(0.5), details=True)["avignon_sim"]
    assert given.details["weight_source"] == "user" and float(given.details["weight"]) == 0.5
    with pytest.raises(ValueError):
        AvignonWeight.given(0)


def test_selection():
    assert resolve_selection() == INDEX_IDS
    picked = resolve_selection(groups=["glucagon"], ids=["lap", "homa_ir"])
    assert picked[:2] == ["homa_ir", "lap"] and len(picked) == 7
    assert describe_selection(picked) == {"groups": ["glucagon"], "ids": ["homa_ir", "lap"]}
    assert resolve_selection(groups=["all"]) == INDEX_IDS
    for wrong in ({"groups": ["nope"]}, {"ids": ["nope"]}, {"ids": []}):
        with pytest.raises(ValueError):
            resolve_selection(**wrong)


def test_catalog_facts():
    assert len(INDICES) == 47 and set(VERIFICATION) == {m.id for m in METHODS}
    assert set(SOURCES) == set(INDEX_IDS)
    assert len(display_order()) == 47 and index(display_order()[0]).category == "fasting"


def test_partitions_do_not_matter(golden):
    one = sorted(map(tuple, calculate_wide(golden.repartition(1)).collect()))
    many = sorted(map(tuple, calculate_wide(golden.repartition(8)).collect()))
    assert one == many


def test_file_units(spark, golden):
    cohort = read_cohort(spark, str(GOLDEN / "inputs.csv"))
    in_mg = golden.withColumn("g0", F.col("g0") * 18).withColumn("i0", F.col("i0") / 6)
    names = ["participant_id", "g0", "i0"]
    columns = [c for c in cohort.columns if c.column in ("g0", "i0")]
    back = canonical(in_mg.select(names), columns, UnitChoice(glucose="mg/dL", insulin="uU/mL"), ConversionSettings())
    expected = golden_values()
    for r in calculate_wide(back, ids=["homa_ir"]).collect():
        assert r.homa_ir == pytest.approx(float(expected["homa_ir", r.participant_id]), rel=1e-9)
