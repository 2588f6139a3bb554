"""Reading dirty files."""

import pytest
from pyspark.sql import functions as F

from glucoframe.functions import cells
from glucoframe.functions.units import parse_unit
from glucoframe.operators.catalog import resolve_selection
from glucoframe.sources.cohort_files import (
    CohortError,
    derive_bmi,
    detect_delimiter,
    duplicate_ids,
    parse_table,
    problem_rows,
    read_cohort,
    read_text_table,
    wide_from_long,
)
from glucoframe.sources.columns import classify, classify_all, conflicts
from glucoframe.sources.file_check import check_cohort


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_headers():
    names = {
        "fasting_glucose": "g0", "glucose_30": "g30", "G0": "g0", "g": "g0", "Insulin_120": "i120", "I90": "i90",
        "glucagon": "gl0", "Glucagon_30": "gl30", "glucagon60": "gl60", "fasting_glucagon": "gl0", "FFA": "ffa0",
        "ffa120": "ffa120", "HDL": "hdl", "HDL_c": "hdl", " TG ": "tg", "id": "participant_id", "G45": "g45",
    }
    for name, column in names.items():
        assert classify(name).column == column, name
    assert classify("﻿participant_id").kind == "id"
    for name in ("glucose", "insulin", "comment", "g-30", "fasting_ffa"):
        assert classify(name).kind == "ignored", name
    assert conflicts(classify_all(["G0", "fasting_glucose"])) == [
        "Columns G0 and fasting_glucose both give fasting glucose; keep only one"
    ]


def test_delimiters():
    assert detect_delimiter("a;b;c") == "semicolon"
    assert detect_delimiter("a\tb") == "tab"
    assert detect_delimiter('"a;b;c",d') == "comma"
    assert detect_delimiter("a") == "comma"


def test_dirty_file(spark, tmp_path):
    text = (
        "﻿participant_id,G0,I0,sex,note\r\n"
        '"A, 1",5.1,42,1,x\r\n'
        "\r\n"
        ',"5,1",NA,3,x\r\n'
        "B,abc, 42 ,F,x\r\n"
        "B,nan,null,male,x\r\n"
        '"two\nlines",1e1,+.5,2,"say ""hi"""\r\n'
        "C,1d,Infinity,m\r\n"
    )
    cohort = read_cohort(spark, write(tmp_path, "dirty.csv", text)).require_usable()
    rows = {r.row: r for r in cohort.rows.collect()}
    assert [rows[n].participant_id for n in range(1, 7)] == ["A, 1", "row_2", "B", "B", "two\nlines", "C"]
    assert rows[1].g0 == 5.1 and rows[1].sex == "male" and rows[1].input_problems == ""
    assert rows[2].g0 is None and rows[2].i0 is None and rows[2].sex is None
    assert rows[2].input_problems == (
        'participant ID is empty; generated row_2 | G0: use a decimal point ("5,1") | sex: unrecognised value "3"'
    )
    assert rows[3].i0 == 42 and rows[3].input_problems == 'G0: not a number ("abc")'
    assert rows[4].g0 is None and rows[4].input_problems == ""
    assert rows[5].g0 == 10 and rows[5].i0 == 0.5 and rows[5].sex == "female"
    assert rows[6].input_problems == 'G0: not a number ("1d") | I0: not a number ("Infinity")'
    assert [r.participant_id for r in duplicate_ids(cohort.rows).collect()] == ["B"]
    assert [r.row for r in problem_rows(cohort.rows, 20).collect()] == [2, 3, 6]
    assert [(r.row, r.total) for r in problem_rows(cohort.rows, 1).collect()] == [(2, 3)]


def test_semicolon_and_generated_ids(spark, tmp_path):
    text = "G0;I0\n5.1;42\n6,2;40\n"
    cohort = read_cohort(spark, write(tmp_path, "s.csv", text))
    assert cohort.generated_ids
    rows = sorted(cohort.rows.collect(), key=lambda r: r.row)
    assert [r.participant_id for r in rows] == ["row_1", "row_2"]
    assert rows[1].input_problems == 'G0: use a decimal point ("6,2")'


def test_row_numbers_follow_files_and_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    n = 0
    for k, size in enumerate((5, 4000, 300)):
        lines = ["G0"] + [f"{n + i + 1}" for i in range(size)]
        (folder / f"part-{k}.csv").write_text("\n".join(lines) + "\n")
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read_cohort(spark, str(folder), multi_line=False).rows
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where("g0 <> row").count() == 0 and rows.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_conflicts_and_empty_headers(spark, tmp_path):
    with pytest.raises(CohortError, match="both give fasting glucose"):
        read_cohort(spark, write(tmp_path, "c.csv", "id,G0,fasting_glucose\na,1,2\n"))
    with pytest.raises(CohortError, match="no recognised data columns"):
        read_cohort(spark, write(tmp_path, "n.csv", "id,comment\na,b\n")).require_usable()
    with pytest.raises(CohortError, match="ids must be generated"):
        parse_table(spark.createDataFrame([("1",)], "G0 string"))


def test_units():
    assert parse_unit("insulin", "µU/mL") == "uU/mL" and parse_unit("insulin", "mu/l") == "mU/L"
    with pytest.raises(ValueError):
        parse_unit("glucose", "pmol/L")


def test_quoted_line_breaks_are_noticed(spark, tmp_path):
    """By default files are split, but not where a quoted cell goes on in the next line; files keep the order given."""
    last = write(tmp_path, "a.csv", 'id,G0,note\np9,9,"one\ntwo, three"\n')
    first = write(tmp_path, "b.csv", "id,G0,note\np1,1,x\np2,2,y\n")
    rows = read_cohort(spark, [first, last]).rows.orderBy("row").collect()
    assert [(r.row, r.participant_id, r.g0) for r in rows] == [(1, "p1", 1.0), (2, "p2", 2.0), (3, "p9", 9.0)]
    assert read_cohort(spark, first).rows.count() == 2


def test_scratch_goes(spark, tmp_path):
    from pathlib import Path

    from glucoframe import session

    before = set(session._scratch)
    path = session.scratch_path(spark, "thing")
    spark.range(5).write.parquet(path)
    assert session.cut_lineage(spark.range(3)).count() == 3
    made = [Path(p.removeprefix("file:")) for p in session._scratch if p not in before]
    assert len(made) == 2 and all(p.exists() for p in made)
    kept, session._scratch[:] = [p for p in session._scratch if p in before], [p for p in session._scratch if p not in before]
    session.discard_scratch(spark)
    session._scratch[:] = kept
    assert not any(p.exists() for p in made)


def test_cell_numbers(spark):
    texts = ["5", " 5.5 ", "5.", ".5", "-1e-3", "+2", "0x10", "1d", "1f", "Infinity", "5,1", "", "NA", "1e999", "5 5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(cells.number(F.col("t")).alias("v")).collect()]
    assert got == [5, 5.5, 5, 0.5, -0.001, 2] + [None] * 9


def test_bmi(spark):
    df = spark.createDataFrame([(None, 80.0, 200.0), (22.0, 80.0, 200.0), (None, 80.0, 0.0)], "bmi double, weight double, height double")
    assert [r.bmi for r in derive_bmi(df).collect()] == [20.0, 22.0, None]


def test_long_to_wide(spark):
    rows = [("a", "glucose", 0, 5.0), ("a", "glucose", 0, 6.0), ("a", "insulin", 120, 9.0), ("b", "ffa", 0, 0.4)]
    wide = {r.id: r for r in wide_from_long(spark.createDataFrame(rows, "id string, analyte string, minute int, value double"), "id").collect()}
    more = spark.createDataFrame([("a", "glucose", 45, 7.0), ("a", "glucose", 180, 8.0), ("c", "other", 0, 1.0), ("d", "ffa", 7, None)], "id string, analyte string, minute int, value double")
    long = spark.createDataFrame(rows, more.schema).union(more)
    series = {r.id: r.g_series for r in wide_from_long(long, "id").collect()}
    assert series == {"a": {0: 5.5, 45: 7.0, 180: 8.0}, "b": {}, "c": None, "d": None}
    assert wide["a"].g0 == 5.5 and wide["a"].i120 == 9 and wide["a"].g30 is None and wide["b"].ffa0 == 0.4


def test_file_check(spark, tmp_path):
    lines = ["id,G0,I0,weight,G120,I120,odd"] + [f"p{i},{90 + i},{50 + i},70,{100 + i},{80 + i},z" for i in range(8)]
    cohort = read_cohort(spark, write(tmp_path, "u.csv", "\n".join(lines) + "\n"))
    items = {(r.item, r.detail): r.number for r in check_cohort(cohort).collect()}
    assert items["rows", ""] == 8 and items["duplicate_ids", ""] == 0
    assert items["unit_warning", "G0 mg/dL"] == 93.5
    assert ("ignored_column", "odd") in items and ("recognised_column", "G120") in items
    assert ("avignon_weight", "sample") in items and not any(item in ("selection", "problem_row", "duplicate_id") for item, _ in items)


def test_file_check_names_examples(spark, tmp_path):
    lines = ["id,G0,I0,sex"] + [f"p{k % 40},{'x' if k % 3 == 0 else 5.5},40,{'9' if k == 4 else 'm'}" for k in range(90)]
    cohort = read_cohort(spark, write(tmp_path, "u.csv", "\n".join(lines) + "\n"))
    chosen = resolve_selection(groups=["glucagon"], ids=["homa_ir", "tyg"])
    rows = check_cohort(cohort, selection=chosen).collect()
    assert [(r.detail, r.number) for r in rows if r.item == "duplicate_id"] == [(f"p{k}", k + 1) for k in range(5)]
    shown = [r.detail for r in rows if r.item == "problem_row"]
    assert len(shown) == 20 and shown[:3] == ['row 1 (p0): G0: not a number ("x")', 'row 4 (p3): G0: not a number ("x")', 'row 5 (p4): sex: unrecognised value "9"']
    items = {r.item: (r.detail, r.number) for r in rows}
    assert items["rows_with_problems"][1] == 31 and items["duplicate_ids"][1] == 40
    assert items["selection"] == ("7 of 47 (groups: glucagon; other indices: homa_ir, tyg)", 7)
    everything = {r.item: r.detail for r in check_cohort(cohort, selection=resolve_selection()).collect()}
    assert everything["selection"] == "47 of 47 (all)"


def test_files_keep_the_order_of_the_list(spark, tmp_path):
    """Names that begin alike, need escaping, hold pattern characters, or lie in a folder of the list."""
    names = ["x.csv", "x2.csv", "b c.csv", "100%25.csv", "a[1].csv", "ä.csv"]
    for k, name in enumerate(names):
        write(tmp_path, name, f"G0,I0\n{k}.5,40\n{k}.25,41\n")
    (tmp_path / "x").mkdir()
    for k, name in enumerate(["2.csv", "1.csv"]):
        write(tmp_path / "x", name, f"G0,I0\n{10 + k}.5,40\n")
    for order in (names, names[::-1], ["ä.csv", "x", "x2.csv", "b c.csv"], ["x2.csv", "x"]):
        paths = [str(tmp_path / name).replace("[", "\\[").replace("]", "\\]") for name in order]
        rows = read_cohort(spark, paths).rows.orderBy("row").collect()
        wanted = [v for name in order for v in ([11.5, 10.5] if name == "x" else [names.index(name) + 0.5, names.index(name) + 0.25])]
        assert [r.row for r in rows] == list(range(1, len(wanted) + 1)) and [r.g0 for r in rows] == wanted
        assert [r.participant_id for r in rows] == [f"row_{k}" for k in range(1, len(wanted) + 1)]


def test_one_odd_quote_makes_only_its_file_whole(spark, tmp_path):
    """Clean files of a mixed folder are still split; rows keep their order."""
    for k in range(3):
        text = "id,G0,note\n" + "".join(f"p{k}-{n},{n}.5,some words to fill the line\n" for n in range(1, 2000))
        write(tmp_path, f"{k}.csv", text + ('q,7.5,"two\nlines"\n' if k == 1 else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = read_text_table(spark, str(tmp_path))
        starts = table.select(F.input_file_name().alias("f"), F.input_file_block_start().alias("s")).distinct().groupBy("f").count().collect()
        counts = {r.f.rsplit("/")[-1]: r["count"] for r in starts}
        rows = read_cohort(spark, [str(tmp_path / f"{k}.csv") for k in (2, 1, 0)]).rows.orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert counts["1.csv"] == 1 and counts["0.csv"] > 2 and counts["2.csv"] > 2
    wanted = [f"p2-{n}" for n in range(1, 2000)] + [f"p1-{n}" for n in range(1, 2000)] + ["q"] + [f"p0-{n}" for n in range(1, 2000)]
    assert [r.participant_id for r in rows] == wanted


def test_mixed_files_need_one_header(spark, tmp_path):
    write(tmp_path, "a.csv", "id,G0\nx,5.5\n")
    write(tmp_path, "b.csv", 'id,I0\n"y\nz",40\n')
    with pytest.raises(CohortError, match="different headers"):
        read_cohort(spark, str(tmp_path))
