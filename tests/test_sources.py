"""Readers and writers on hand-written files."""

import pytest

from cohortlens.sources import landing, readers, writers


@pytest.fixture()
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("io")


def test_csv_with_quotes_blank_and_invalid_times(spark, folder):
    path = folder / "rx.csv"
    path.write_text('subject_id,hadm_id,drug,starttime,extra\n1,10,"Prazosin, oral",2001-02-03 04:05:06,x\n2,20,Sertraline,,y\n3,30,Saline,not a time,z\n')
    rows = {r.subject_id: r for r in readers.read_table(spark, "prescriptions", str(path)).collect()}
    assert rows[1].drug == "Prazosin, oral" and rows[1].starttime is not None
    assert rows[2].starttime is None and rows[3].starttime is None and rows[1].stoptime is None
    good, bad = readers.split_rejects(spark, "prescriptions", str(path), ["starttime"], str(folder / "landed"))
    assert [(r.subject_id, r.drug) for r in good.collect()] == [(1, "Prazosin, oral")]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("2,20,Sertraline,,y", "blank starttime"), ("3,30,Saline,not a time,z", "invalid starttime")]


def test_every_kind_of_broken_line_is_written_aside(spark, folder):
    path = folder / "dx.csv"
    lines = ["1,10,F43", '2,20,"a, ""b"""', "3,30", "4,40,x,y", "", "  ", '5,50,"open', " ,60,I10", "x,70,I10", "8,80,"]
    path.write_text("\n".join(["subject_id,hadm_id,icd_code", *lines]) + "\n")
    good, bad = readers.split_rejects(spark, "diagnoses_icd", str(path), ["subject_id"], str(folder / "dx"))
    assert sorted((r.subject_id, r.icd_code) for r in good.collect()) == [(1, "F43"), (2, 'a, "b"'), (8, None)]
    reasons = {r.line: r.reason for r in bad.collect()}
    assert reasons == {
        "3,30": "too few fields", "4,40,x,y": "too many fields", "": "blank line", "  ": "blank line", '5,50,"open': "open quote",
        " ,60,I10": "blank subject_id", "x,70,I10": "invalid subject_id",
    }
    assert {r.file for r in bad.collect()} == {"dx.csv"}
    with pytest.raises(ValueError, match="icd_version"):
        readers.split_rejects(spark, "diagnoses_icd", str(path), ["icd_version"], str(folder / "none"))


def test_landing_parses_new_and_changed_files_only(spark, folder):
    source, target = folder / "in", str(folder / "notes")
    source.mkdir()
    (source / "a.csv").write_text('hadm_id,text\n1,"two\nlines"\n2,plain\n')
    assert landing.land_notes(spark, str(source), target) == 1
    assert landing.land_notes(spark, str(source), target) == 0
    (source / "b.csv").write_text("hadm_id,text\n3,more\n")
    assert landing.land_notes(spark, str(source), target) == 1
    read = lambda: sorted((r.hadm_id, r.text) for r in landing.landed_notes(spark, target).collect())
    assert read() == [(1, "two\nlines"), (2, "plain"), (3, "more")]
    (source / "a.csv").write_text("hadm_id,text\n1,changed and longer than before\n")
    assert landing.land_notes(spark, str(source), target) == 1
    assert read() == [(1, "changed and longer than before"), (3, "more")]
    # A run that failed before its manifest was written leaves rows that nobody sees.
    spark.createDataFrame([(9, "lost", "x", "dead")], landing.NOTES).write.parquet(f"{target}/batches/dead")
    assert read() == [(1, "changed and longer than before"), (3, "more")]
    (source / "a.csv").unlink()
    (source / "b.csv").unlink()
    keep = spark.createDataFrame([(3,)], "hadm_id long")
    assert [r.text for r in landing.landed_notes(spark, target, keep).collect()] == ["more"]
    assert landing.landed_notes(spark, str(folder / "nothing")).count() == 0


def test_multiline_notes(spark, folder):
    path = folder / "notes.csv"
    path.write_text('hadm_id,text\n1,"Social History:\n said ""fine"", ok\n"\n2,plain\n')
    keep = spark.createDataFrame([(1,)], "hadm_id long")
    rows = readers.read_notes(spark, str(path), keep).collect()
    assert [(r.hadm_id, r.text) for r in rows] == [(1, 'Social History:\n said "fine", ok\n')]


def test_id_list_is_sorted_and_skips_blanks(spark, folder):
    out = str(folder / "ids")
    writers.write_ids(spark.range(500).withColumnRenamed("id", "subject_id").repartition(5), out)
    lines = [r.value for r in spark.read.text(out).collect()]
    assert sorted(int(v) for v in lines) == list(range(500))
    path = folder / "ids.txt"
    path.write_text("12\n\n  7 \n")
    assert sorted(r.subject_id for r in readers.read_ids(spark, str(path)).collect()) == [7, 12]


def test_thresholds_with_fallback(spark, folder):
    path = folder / "m.json"
    path.write_text('{"val_thresholds": {"a": 0.25, "b": null}, "b": {"threshold": 0.75}}')
    got = readers.read_thresholds(spark, str(path), {"a": "val_thresholds.a", "b": "val_thresholds.b"}, {"b": "b.threshold"})
    assert {r.model: r.threshold for r in got.collect()} == {"a": 0.25, "b": 0.75}


def test_reuse_or_compute_runs_once(spark, folder):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert writers.reuse_or_compute(spark, str(folder / "p"), compute).count() == 3
    assert len(calls) == 1


def test_review_form(spark):
    df = spark.createDataFrame([(i, i * 10, i / 100) for i in range(80)], "subject_id long, hadm_id long, score double")
    rows = writers.review_form(df).orderBy("patient_number").collect()
    assert len(rows) == 50 and rows[0].subject_id == 79 and rows[0].reviewer_rating is None


def test_review_form_per_group(spark):
    """Each group has its own form, ties go by key, and rows are limited before they are shuffled."""
    df = spark.createDataFrame([("a" if i % 3 else None, i, i, 0.5) for i in range(30)], "model string, subject_id long, hadm_id long, score double")
    form = writers.review_form(df, 4, by=["model"])
    assert "WindowGroupLimit" in form._jdf.queryExecution().toString()
    got = sorted((str(r.model), r.patient_number, r.subject_id) for r in form.collect())
    assert got == [("None", 1, 0), ("None", 2, 3), ("None", 3, 6), ("None", 4, 9), ("a", 1, 1), ("a", 2, 2), ("a", 3, 4), ("a", 4, 5)]


def test_reuse_repairs_a_broken_write_and_keys_by_model_and_input(spark, folder):
    path = str(folder / "broken")
    (folder / "broken").mkdir()
    (folder / "broken" / "part-0.parquet").write_text("half")
    assert writers.reuse_or_compute(spark, path, lambda: spark.range(4)).count() == 4
    assert writers.is_complete(spark, path)
    paths = {writers.stored_path("/r", m, i) for m in ("a", "b") for i in ("x", "y")}
    assert len(paths) == 4


def test_a_file_with_breaks_in_values_is_parsed_in_splits(spark, folder):
    """Any split size gives the rows of Spark's whole-file parser, for regular and irregular files."""
    long = "".join(f"line {i} with ""quotes"" and, commas\n" for i in range(40)).replace('"', '""')
    files = {
        "a": 'hadm_id,text\n1,"two\nlines, ""quoted"" \n\n"\n\n2,plain\n3,\n4,""\n5,"x",extra\n6\n' + f'7,"{long}"\n8,"\r\nreturn"\n9,"ünï\n""\n"\n',
        "b": 'hadm_id,text\n' + "".join(f'{i},"note {i}\n""{i}"""\n' for i in range(100, 140)),
        "mid": 'hadm_id,text\n11,5" pipe\n12,"a\nb"\n13,6" pipe\n', "windows": 'hadm_id,text\r\n21,"a\r\nb"\r\n22,c\r\n', "open": 'hadm_id,text\n31,a\n32,"never\nclosed\n',
        "blank": 'hadm_id,text\n41,a\n  \n42,"b\n"', "bom": '﻿hadm_id,text\n51,"a\nb"\n',
    }
    source = folder / "splits"
    source.mkdir()
    for name, text in files.items():
        (source / f"{name}.csv").write_bytes(text.encode())
    (source / "bytes.csv").write_bytes(b'hadm_id,text\n61,"a\xff\nb"\n62,c\n')
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size, groups in (("23", [["a", "b"], ["mid"], ["windows"], ["open"], ["blank"], ["bom"], ["bytes"]]), ("300", [["a", "b"]])):
        for names in groups:
            paths = [str(source / f"{n}.csv") for n in names]
            whole = readers.raw_csv(spark, paths, multiline=True)
            want = sorted(map(str, whole.collect()))
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                got = readers.split_csv(spark, paths)
                assert sorted(map(str, got.drop("path").collect())) == want, (names, size)
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    target = str(folder / "splits-landed")
    for n in ("a", "mid", "windows", "open", "blank", "bom", "bytes"):
        (source / f"{n}.csv").unlink()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert landing.land_notes(spark, str(source), target) == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    rows = spark.read.parquet(f"{target}/batches/*")
    assert rows.count() == 40 and rows.select("_metadata.file_name").distinct().count() > 1
