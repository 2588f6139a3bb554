"""Parts, manifests, sinks, streaming, reconciliation, and what the plans look like."""

import random
import threading
import types
import uuid

import pytest
from pyspark.sql import functions as F

from glucoframe.operators import tally
from glucoframe.operators.calculate import calculate_long, calculate_wide
from glucoframe.operators.catalog import INDEX_IDS, INDICES, METHODS, _ALL, catalog, register
from glucoframe.operators.index_model import Index
from glucoframe.operators.parts import Run, manifest, merge_parts, part_of, part_problems, part_rows, parts_frame, take_part
from glucoframe.operators.reconcile import (
    EARLIER_COLUMNS,
    ISLET_COLUMNS,
    Counterpart,
    compare_results,
)
from glucoframe.operators.weight import cohort_weight, weight_from_sums, weight_sums
from glucoframe.settings import AvignonWeight
from glucoframe.operators.transforms import Transform
from glucoframe.plans import batch_queries
from glucoframe.sources.results import (
    merge_folder,
    merge_part_files,
    read_manifest,
    read_results,
    settings_path,
    write_csv,
    write_manifest,
    write_parts,
    write_results,
    write_transformed,
)
from glucoframe.settings import ConversionSettings, UnitChoice
from glucoframe.sources.cohort_files import canonical, read_cohort
from glucoframe.streaming.scorer import (
    COUNT_KEYS,
    REASON_KEYS,
    SUM_KEYS,
    add_to_ledger,
    compact_ledger,
    count_delta,
    read_ledger,
    reason_delta,
    scored_cells,
    stream_cells,
    stream_cohort,
    stream_score,
    write_cells,
    write_ledger,
    write_scores,
)


@pytest.fixture(scope="module")
def cohort(spark, tmp_path_factory):
    rng = random.Random(11)

    def maybe(v):
        return None if rng.random() < 0.15 else v

    names = ["g0", "g30", "g120", "i0", "i30", "i120", "weight", "bmi", "tg", "hdl", "waist", "gl0", "gl30", "gl120"]
    rows = [
        (k, f"p{k:04d}", rng.choice(["male", "female", None]), "bad cell" if k % 50 == 0 else "",
         *[maybe(0.0 if rng.random() < 0.02 else rng.uniform(3, 90)) for _ in names])
        for k in range(1, 601)
    ]
    schema = "row bigint, participant_id string, sex string, input_problems string, " + ", ".join(f"{n} double" for n in names)
    path = str(tmp_path_factory.mktemp("cohort") / "cohort.parquet")
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_part_rows_cover_everything(spark):
    for total in (0, 1, 7, 100, 101):
        for parts in (1, 3, 7, 12):
            ranges = [part_rows(i, parts, total) for i in range(1, parts + 1)]
            covered = [r for first, last in ranges for r in range(first, last + 1)]
            assert covered == list(range(1, total + 1))
    for total, parts in ((100, 7), (101, 3), (5, 12)):
        df = spark.range(1, total + 1).select(F.col("id").alias("row"))
        for r in df.select("row", part_of("row", parts, total).alias("part")).collect():
            first, last = part_rows(r.part, parts, total)
            assert first <= r.row <= last
    with pytest.raises(ValueError):
        part_rows(4, 3, 10)


def make_parts(cohort, n=4, **changes):
    total = cohort.count()
    parts = []
    for i in range(1, n + 1):
        first, last = part_rows(i, n, total)
        doc = manifest(
            Run("c.csv"), version="1", timestamp="", rows=last - first + 1, rows_with_problems=i, header=cohort.columns,
            part=(i, n, total),
        )
        doc.update(changes.get(f"part{i}", {}))
        parts.append((f"part{i}", doc, calculate_wide(take_part(cohort, i, n, total))))
    return parts


def test_parts_join_to_the_whole(spark, cohort):
    parts = make_parts(cohort)
    merged, doc = merge_parts(spark, parts[::-1])
    assert rows_of(merged.na.fill(-1.0)) == rows_of(calculate_wide(cohort).na.fill(-1.0))
    assert doc["merged_from"] == ["part1", "part2", "part3", "part4"] and "chunk" not in doc
    assert doc["row_counts"] == {"total": 600, "with_problems": 10, "calculated": 600}


def test_misfitting_parts_are_refused(spark, cohort):
    parts = make_parts(cohort, part2={"orientation": "sensitivity"})
    with pytest.raises(ValueError, match="part2: differs from part 1 in orientation"):
        merge_parts(spark, parts)
    good = make_parts(cohort)
    with pytest.raises(ValueError, match="missing part 2"):
        merge_parts(spark, [good[0], good[2], good[3]])
    with pytest.raises(ValueError, match="missing part 4"):
        merge_parts(spark, good[:3])
    with pytest.raises(ValueError, match="given twice"):
        merge_parts(spark, good + good[:1])
    with pytest.raises(ValueError, match="settings promise"):
        merge_parts(spark, good[:3] + [("part4", good[3][1], good[3][2].limit(3))])
    listed = [(n, d, df.columns + (["x"] if n == "part3" else [])) for n, d, df in good]
    assert [r.problem for r in part_problems(parts_frame(spark, listed)).collect()] == ["header differs from part 1"]
    with pytest.raises(ValueError, match="no part information"):
        parts_frame(spark, [("whole", manifest(Run("x"), version="1", timestamp="", rows=1, rows_with_problems=0), [])])


def jobs_of(spark, work):
    """The result of `work` and how many jobs it started."""
    group = f"counted-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        found = work()
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_parts_in_one_folder(spark, cohort, tmp_path):
    """Many parts, some without rows, are one write and one read; the number of jobs is that of a few parts."""
    rows = cohort.withColumn("input_problems", F.when(F.col("row") % 50 == 0, "odd").otherwise(""))
    jobs = {}
    for n in (4, 300):
        folder = str(tmp_path / f"parts-{n}")
        write_parts(rows, folder, Run("c.csv"), n, version="1", timestamp="", header=cohort.columns)
        (merged, doc), jobs[n] = jobs_of(spark, lambda: merge_folder(spark, folder))
        assert rows_of(merged.select("participant_id", *INDEX_IDS).na.fill(-1.0)) == rows_of(calculate_wide(cohort, keep=["participant_id"]).na.fill(-1.0))
        assert doc["row_counts"] == {"total": 600, "with_problems": 12, "calculated": 600} and "chunk" not in doc
        assert doc["merged_from"] == [f"part {k}" for k in range(1, n + 1)] and doc["results_columns"] == merged.columns
    assert jobs[300] <= jobs[4] + 4  # long lists of files are listed by jobs of their own


def test_misfitting_files_are_refused(spark, cohort, tmp_path):
    rows, total, n, paths = cohort.withColumn("input_problems", F.lit("")), 600, 4, []
    for i in range(1, n + 1):
        paths.append(str(tmp_path / f"part-{i}.csv"))
        run = Run("c.csv", orientation="sensitivity" if i == 3 else "published", selection=["homa_ir"] if i == 4 else INDEX_IDS)
        write_results(take_part(rows, i, n, total), paths[-1], run, version="1", timestamp="", header=cohort.columns, part=(i, n, total))
    with pytest.raises(ValueError, match="part-3.csv: differs from part 1 in orientation"):
        merge_part_files(spark, paths[:3])
    with pytest.raises(ValueError, match="part-4.csv: (differs from part 1 in index selection|header differs)"):
        merge_part_files(spark, [*paths[:2], paths[3]])
    with pytest.raises(ValueError, match="missing part 2"):
        merge_part_files(spark, paths[:1])
    write_csv(take_part(calculate_wide(rows, keep=["participant_id", "input_problems", "row"]), 2, n, total).drop("row").limit(7), paths[1], overwrite=True)
    with pytest.raises(ValueError, match="part-2.csv: 7 rows were found where its settings promise 150"):
        merge_part_files(spark, paths[:2])
    whole = str(tmp_path / "whole.csv")
    write_results(rows, whole, Run("c.csv"), version="1", timestamp="")
    with pytest.raises(ValueError, match="whole.csv: settings have no part information"):
        merge_part_files(spark, [whole])


def test_results_are_one_job(spark, cohort, tmp_path):
    """Rows are counted while they are written: one job for the results, those of the settings aside."""
    rows = cohort.withColumn("input_problems", F.lit(""))
    run = Run("c.csv", status_columns=True)
    wide = calculate_wide(rows, keep=["participant_id", "input_problems"], status_columns=True)
    _, alone = jobs_of(spark, lambda: (write_csv(wide, str(tmp_path / "a.csv")), write_manifest(spark, {}, str(tmp_path / "a.json"))))
    doc, both = jobs_of(spark, lambda: write_results(rows, str(tmp_path / "b.csv"), run, version="1", timestamp=""))
    assert doc["row_counts"]["total"] == 600 and both == alone


def test_counts_and_reasons(cohort):
    wide = calculate_wide(cohort, status_columns=True)
    counts = {r.method_id: r for r in tally.status_counts(tally.status_long(wide)).collect()}
    assert all(r.ok + r.unavailable + r.error == 600 for r in counts.values()) and len(counts) == 47
    halves = [cohort.where("row <= 250"), cohort.where("row > 250")]
    parts = [tally.status_counts(tally.status_long(calculate_wide(h, status_columns=True))) for h in halves]
    assert rows_of(tally.merge_counts(*parts)) == rows_of(tally.status_counts(tally.status_long(wide)))
    reasons = tally.reason_counts(cohort)
    top = tally.top_reasons(reasons).where("method_id = 'homa_ir' AND status = 'unavailable'").orderBy("place").collect()
    assert [r.place for r in top] == [1, 2, 3] and top[0].rows >= top[1].rows >= top[2].rows
    available = tally.availability(calculate_wide(cohort), "participant_id").collect()
    assert all(r.available == r.fasting + r.ogtt + r.lipid + r.tracer_dxa + r.secretion + r.glucagon for r in available)


def test_weight(spark, cohort):
    weight = cohort_weight(cohort)
    pairs = [
        (r.avignon_si0, r.avignon_si120)
        for r in calculate_wide(cohort, ids=["avignon_si0", "avignon_si120"]).collect()
        if r.avignon_si0 is not None and r.avignon_si120 is not None
    ]
    assert weight.pairs == len(pairs)
    assert weight.value == pytest.approx(sum(p[1] for p in pairs) / sum(p[0] for p in pairs), rel=1e-12)
    few = cohort_weight(cohort.where("g0 > 0 AND g120 > 0 AND i0 > 0 AND i120 > 0 AND weight > 0").limit(1))
    assert few.value == 0.137 and few.source == "avignon_1999" and few.warnings[0].startswith("Fewer than 2 rows")
    assert weight_from_sums(weight_sums(cohort.limit(0))).head().weight == 0.137


def test_results_files(spark, cohort, tmp_path):
    path = str(tmp_path / "results.csv")
    doc = write_results(cohort, path, Run("c.csv", status_columns=True), version="1", timestamp="now")
    assert doc["row_counts"] == {"total": 600, "with_problems": 12, "calculated": 600}
    assert read_manifest(spark, settings_path(path)) == doc and len(doc["methods"]) == 47
    back = read_results(spark, path)
    assert back.columns[:2] == ["participant_id", "input_problems"] and back.columns[-1] == "glucagon_insulin_ratio_status"
    fresh = {r.participant_id: r for r in calculate_wide(cohort).collect()}
    for r in back.collect():
        assert all(r[i] == fresh[r.participant_id][i] for i in INDEX_IDS)
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(back, path)
    with pytest.raises(ValueError, match="output is the input"):
        write_results(cohort, path, Run("c.csv"), version="1", timestamp="", source=path)
    partial = manifest(Run("x", selection=["homa_ir"]), version="1", timestamp="", rows=1, rows_with_problems=0)
    assert partial["selection"] == {"groups": [], "ids": ["homa_ir"], "methods": ["homa_ir"]}


def test_parts_from_disk(spark, cohort, tmp_path):
    total, n, paths = cohort.count(), 3, []
    rows = cohort.withColumn("input_problems", F.lit(""))
    for i in range(1, n + 1):
        paths.append(str(tmp_path / f"part-{i}.csv"))
        write_results(
            take_part(rows, i, n, total), paths[-1], Run("c.csv"), version="1", timestamp="", header=cohort.columns, size_bytes=10,
            part=(i, n, total), unit_check=[{"quantity": "glucose", "suggested": None}],
        )
    merged, doc = merge_part_files(spark, paths[::-1])
    assert merged.count() == total and doc["row_counts"]["total"] == total
    assert doc["input_fingerprint"]["total_rows"] == total and doc["input_fingerprint"]["size_bytes"] == 10
    with pytest.raises(ValueError, match="merge the parts first"):
        write_transformed(spark, paths[0], str(tmp_path / "t.csv"), Transform("rint"), version="1", timestamp="")
    whole = str(tmp_path / "whole.csv")
    write_results(rows, whole, Run("c.csv"), version="1", timestamp="", header=cohort.columns)
    doc = write_transformed(spark, whole, str(tmp_path / "t.csv"), Transform("log"), version="1", timestamp="")
    assert doc["transform"]["kind"] == "log" and len(doc["transform_report"]) > 30 and doc["source_results"] == whole
    assert "homa_ir_log" in read_results(spark, str(tmp_path / "t.csv")).columns


def test_stream_equals_batch(spark, cohort, tmp_path):
    arriving = str(tmp_path / "arriving")
    cohort.repartition(6).write.parquet(arriving)
    stream = stream_cohort(spark, arriving, cohort.schema, files_per_batch=2)
    out = str(tmp_path / "scored")
    write_scores(stream_score(stream, keep=["participant_id"]), out).awaitTermination()
    batch = calculate_wide(cohort, status_columns=True)
    assert rows_of(spark.read.parquet(out).na.fill(-1.0)) == rows_of(batch.na.fill(-1.0))

    counts, wanted = str(tmp_path / "counts"), rows_of(tally.status_counts(tally.status_long(batch)))
    write_ledger(stream, count_delta(), counts).awaitTermination()
    assert rows_of(read_ledger(spark, counts, COUNT_KEYS)) == wanted

    sums = str(tmp_path / "sums")
    write_ledger(stream, weight_sums, sums).awaitTermination()
    row = weight_from_sums(read_ledger(spark, sums, SUM_KEYS)).head()
    assert row.weight == pytest.approx(cohort_weight(cohort).value, rel=1e-12)

    reasons = str(tmp_path / "reasons")
    write_ledger(stream, reason_delta(), reasons).awaitTermination()
    assert rows_of(read_ledger(spark, reasons, REASON_KEYS)) == rows_of(tally.reason_counts(cohort))
    with pytest.raises(ValueError, match="whole cohort"):
        stream_score(stream, keep=[], weight=cohort_weight(cohort))


def test_every_batch_counts_once(spark, cohort, tmp_path):
    """Batches that are repeated, before or after a compaction, and entries that were never finished leave the counts as they are."""
    path = str(tmp_path / "ledger")
    batches = [cohort.where(F.col("row") % 7 == k) for k in range(7)]
    delta, wanted = count_delta(["homa_ir", "vai"]), rows_of(count_delta(["homa_ir", "vai"])(cohort))
    with pytest.raises(ValueError, match="nothing was written"):
        read_ledger(spark, path, COUNT_KEYS)
    for number, batch in enumerate(batches):
        add_to_ledger(delta(batch), number, path)
        add_to_ledger(delta(batch), number, path)
    assert rows_of(read_ledger(spark, path, COUNT_KEYS)) == wanted
    assert compact_ledger(spark, path, COUNT_KEYS, keep=3) == 3 and compact_ledger(spark, path, COUNT_KEYS, keep=3) == 3
    add_to_ledger(delta(batches[2]), 2, path)
    add_to_ledger(delta(batches[5]), 5, path)
    (tmp_path / "ledger" / "deltas" / "batch=9").mkdir()
    assert rows_of(read_ledger(spark, path, COUNT_KEYS)) == wanted
    assert compact_ledger(spark, path, COUNT_KEYS, keep=0) == 6 and rows_of(read_ledger(spark, path, COUNT_KEYS)) == wanted
    assert sorted(p.name for p in (tmp_path / "ledger" / "base").iterdir()) == ["upto=6"]


def test_cells_as_they_arrive(spark, tmp_path):
    """Text files with problems give the rows of a batch over the same files; a stream that starts again adds only new files."""
    folder, out, state = tmp_path / "cells", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    header = ["id", "G0", "I0", "sex", "note"]
    for k in range(3):
        (folder / f"{k}.csv").write_text(",".join(header) + "\n" + f'a{k},5.{k},42,m,"x, y"\n,"5,1",40,f,\nb{k},abc,NA,9,z\nc{k},4.5,0,2,\n')
    rows, columns = stream_cells(spark, str(folder), header, files_per_batch=1)
    scored = stream_score(canonical(rows, columns, UnitChoice(), ConversionSettings()), keep=["participant_id", "input_problems"], ids=["homa_ir"])
    for extra in (0, 1):
        if extra:
            (folder / "3.csv").write_text(",".join(header) + "\nlate,6.5,30,1,\n")
        write_cells(scored, out, state).awaitTermination()
        found, totals = scored_cells(spark, out)
        assert (totals.head()["rows"], totals.head().rows_with_problems) == (12 + extra, 6)
    batch = read_cohort(spark, str(folder)).rows.where("participant_id NOT LIKE 'row%'")
    wanted = calculate_wide(batch.drop("row"), ids=["homa_ir"], keep=["participant_id", "input_problems"], status_columns=True)
    assert rows_of(found.where("participant_id IS NOT NULL").na.fill(-1.0)) == rows_of(wanted.na.fill(-1.0))
    empty = found.where("participant_id IS NULL").collect()
    assert len(empty) == 3 and all(r.input_problems == 'participant ID is empty | G0: use a decimal point ("5,1")' for r in empty)


def test_reconcile(spark):
    assert len(EARLIER_COLUMNS) == 32 and len(ISLET_COLUMNS) == 12
    counterparts = (
        Counterpart("homa_ir", "negated", "H"), Counterpart("gutt", "different", "G", scale=10.0),
        Counterpart("quicki", "different", "Q"), Counterpart("lap", "equal", column_male="LM", column_female="LF"),
        Counterpart("tyg", "equal", "absent"),
    )
    other = spark.createDataFrame(
        [(1, "male", -2.0, 5.0, 1.0, 7.0, 8.0), (2, "female", 2.0, 6.0, 0.5, 7.0, 8.0), (3, None, None, None, None, 7.0, 8.0)],
        "k int, sex string, H double, G double, Q double, LM double, LF double",
    )
    cells = {1: (2.0, 50.0, 2.0, 7.0), 2: (2.0, 50.0, 0.5, 8.0), 3: (None, 1.0, None, None), 4: (1.0, 1.0, 1.0, 1.0)}
    names = ["homa_ir", "gutt", "quicki", "lap"]
    rows = [(k, *v, *["ok" if x is not None else "unavailable" for x in v]) for k, v in cells.items()]
    wide = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names) + ", " + ", ".join(f"{n}_status string" for n in names))
    other = other.union(spark.createDataFrame([(5, None, 1.0, 1.0, 1.0, 1.0, 1.0)], other.schema))
    got = {(r.k, r.index_id): r.verdict for r in compare_results(wide, other, counterparts, "k").collect()}
    assert {k: v for k, v in got.items() if k[0] < 4} == {
        (1, "homa_ir"): "match", (2, "homa_ir"): "mismatch", (3, "homa_ir"): "unavailable_both",
        (1, "gutt"): "known_scale", (2, "gutt"): "mismatch", (3, "gutt"): "missing_there",
        (1, "quicki"): "known_difference", (2, "quicki"): "mismatch", (3, "quicki"): "unavailable_both",
        (1, "lap"): "match", (2, "lap"): "match", (3, "lap"): "unavailable_both",
    }
    assert {v for k, v in got.items() if k[0] == 4} == {"missing_there"} and {v for k, v in got.items() if k[0] == 5} == {"missing_here"}
    with pytest.raises(ValueError, match="several rows"):
        compare_results(wide.union(wide), other, counterparts, "k")


def test_own_index(spark, cohort):
    register(Index("glucose_rise", "Glucose rise", "ogtt", "descriptive", ("g0", "g30"), "g30 - g0"))
    try:
        rows = calculate_long(cohort, ids=["glucose_rise"]).collect()
        assert {r.status for r in rows} == {"ok", "unavailable", "error"}
        assert rows[0].warnings == ["Source verification (unresolved)"]
        with pytest.raises(ValueError, match="exists already"):
            register(Index("homa_ir", "x", "ogtt", "descriptive", ("g0",), "g0"))
    finally:
        for registry in (METHODS, INDICES):
            registry.pop()
        INDEX_IDS.pop()
        _ALL.pop("glucose_rise")


def test_catalog_search(spark):
    assert catalog(spark).count() == 50
    assert {r.method_id for r in catalog(spark, "MATSUDA").collect()} >= {"matsuda_3pt", "matsuda_5pt", "di_xinsg30_matsuda"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_calculation_moves_no_rows(cohort):
    for df in (calculate_wide(cohort, status_columns=True), calculate_long(cohort)):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text


def test_selection_prunes_the_scan(cohort):
    text = plan(calculate_wide(cohort, ids=["homa_ir"]))
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<participant_id:string,g0:double,i0:double"


def test_library_uses_no_forbidden_shortcuts():
    from pathlib import Path

    import glucoframe

    files = list(Path(glucoframe.__file__).parent.rglob("*.py"))
    assert len(files) > 20
    source = "\n".join(p.read_text() for p in files)
    for word in ("localCheckpoint", "crossJoin", "toPandas("):
        assert word not in source


def test_parts_are_written_side_by_side(spark, monkeypatch):
    """Every part waits until all of them are being written."""
    all_at_once = threading.Barrier(batch_queries.PARTS, timeout=60)
    monkeypatch.setattr(batch_queries, "_numbered", lambda src: spark.range(1, 15).toDF("row"))
    monkeypatch.setattr(batch_queries, "write_results", lambda *args, **more: all_at_once.wait())
    paths = batch_queries._written_parts(types.SimpleNamespace(spark=spark))
    assert [p.rsplit("/", 1)[1] for p in paths] == [f"part-{i}.csv" for i in range(1, batch_queries.PARTS + 1)]
