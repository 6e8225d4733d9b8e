import json

from cargoline.operators import knowledge, match
from cargoline.sources import files, tables


def write(path, lines, encoding="utf-8"):
    path.write_bytes("\n".join(lines).encode(encoding))
    return str(path)


def test_preamble_encoding_and_bad_lines(spark, tmp_path):
    title = [f"title {i}" for i in range(9)]
    a = write(tmp_path / "a.csv", [*title, "HS_Code,Detailed_Product", '94051000,"đèn, led"', "85390000,x,too,many", "70200000"])
    b = write(tmp_path / "b.csv", ["﻿HS_Code,Detailed_Product", "11110000,bóng", "HS_Code,Detailed_Product2"])
    c = write(tmp_path / "c.csv", ["HS_Code,Extra", "22220000,caf\xe9"], "latin1")
    df = files.scan(spark, [a, b, c])
    got = {(r.HS_Code, r.Detailed_Product, r.Extra, r.source_file) for r in df.collect()}
    assert got == {("94051000", "đèn, led", None, "a.csv"), ("70200000", None, None, "a.csv"), ("11110000", "bóng", None, "b.csv"),
                   ("HS_Code", "Detailed_Product2", None, "b.csv"), ("22220000", None, "café", "c.csv")}
    assert files.scan_lines(spark, [a, b, c]).where("malformed").count() == 1


def test_quoted_line_breaks_in_both_encodings(spark, tmp_path):
    """Records before and after the head, equal to the head's lines or not, in several files that one read takes."""
    title = ["note, one", ""] + [f"title {i}" for i in range(7)]
    a = write(tmp_path / "a.csv", [*title, "HS_Code,Name", '1,"two', 'lines"', "HS_Code,Name", '2,"caf\u00e9 ""x"""', "3,a,b"])
    b = write(tmp_path / "b.csv", ["HS_Code,Name", '4,"\u00e9', '', '\u00e8"', "5,plain"], "latin1")
    c = write(tmp_path / "c.csv", ["HS_Code,Name", '6,"x', 'y"'])
    empty = write(tmp_path / "empty.csv", [])
    got = sorted((r.HS_Code, r.Name, r.malformed, r.source_file) for r in files.scan_lines(spark, [a, b, c, empty]).collect())
    assert got == [("1", "two\nlines", False, "a.csv"), ("2", 'caf\u00e9 "x"', False, "a.csv"), ("3", "a", True, "a.csv"), ("4", "\u00e9\n\n\u00e8", False, "b.csv"),
                   ("5", "plain", False, "b.csv"), ("6", "x\ny", False, "c.csv"), ("HS_Code", "Name", False, "a.csv")]


def test_driver_work_goes_by_headers_not_files(spark, tmp_path):
    def jobs(folder, n):
        folder.mkdir()
        paths = [write(folder / f"{k}.csv", ["HS_Code,Name", f'{k},"a', 'b"' if k % 2 else 'b",']) for k in range(n)]
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("heads"))
        spark.sparkContext.setJobGroup("heads", "heads")
        assert files.scan_lines(spark, paths).count() == n
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("heads")) - before

    assert jobs(tmp_path / "few", 4) == jobs(tmp_path / "many", 30)  # from 33 paths on, Spark lists them in jobs of its own


def test_labelled_folder_passes_over_other_files(spark, tmp_path):
    write(tmp_path / "ok.csv", ["Mã HS,Tên hàng", "1,a"])
    write(tmp_path / "no.csv", ["Mã HS,Other", "2,b"])
    df = files.scan_labelled(spark, str(tmp_path), ["Mã HS", "Tên hàng"], markers=["Mã HS"], preamble=0)
    assert [(r["Mã HS"], r["source_file"]) for r in df.collect()] == [("1", "ok.csv")]


def test_dictionary_entries_keep_file_and_line_order(spark, tmp_path):
    a = write(tmp_path / "a.csv", ["Keyword,Dòng SP,Loại,Lớp 1", '"Đèn Pha, led",SP,NC,0', "bulb,SP,LK,x"])
    b = write(tmp_path / "b.csv", ["Keyword,Dòng SP,Loại,Lớp 1,Lớp 2,Mã HS", "uv,,NC,y,z,9405"])
    got = tables.load_dictionary(spark, [a, b]).orderBy("entry_id").collect()
    assert [(r.entry_id, r.keywords, r.product_line, r.class1, r.hs_code) for r in got] == [
        (0, ["đèn pha", "led"], "SP", "không_có", "không_có"), (1, ["bulb"], "SP", "x", "không_có"),
        (2, ["uv"], "không_có", "y", "9405")]


def test_ground_truth_table_is_bucketed_and_replaced(spark):
    rows = [("9405", "A", "a", "L", "NC", "c", "x")]
    columns = "hs_code string, product_name string, clean_text string, product_line string, kind string, class1 string, class2 string"
    spark.sql("DROP TABLE IF EXISTS truth_check")
    for n in (1, 2):
        tables.save_ground_truth(spark.createDataFrame(rows * n, columns), "truth_check", buckets=2)
        assert spark.table("truth_check").count() == n
    spark.sql("DROP TABLE truth_check")


def test_history_table_is_not_shuffled(spark, tmp_path):
    """The join with the saved history moves the declarations alone, in the matcher and in the cascade's first stage."""
    truth = spark.createDataFrame([(f"94{k % 7}", "A", f"text {k}", "L", "NC", "c", f"x{k}") for k in range(300)],
                                  "hs_code string, product_name string, clean_text string, product_line string, kind string, class1 string, class2 string")
    rows = spark.createDataFrame([(k, f"94{k % 7}", f"text {k}") for k in range(0, 600, 3)] + [(999, None, None)], "row_id bigint, hs_code string, clean_text string")
    tables.save_ground_truth(truth, "history_check", buckets=4, path=str(tmp_path / "history"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matched = match.match_history(rows, tables.load_ground_truth(spark, "history_check"))
        plan = matched._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        got = {r.row_id: r.history_label and r.history_label.class2 for r in matched.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: f"x{k}" if k < 300 else None for k in range(0, 600, 3)} | {999: None}
    assert len(list((tmp_path / "history").glob("*.parquet"))) == 4
    spark.sql("DROP TABLE history_check")


def test_mapping_as_json(spark):
    rows = [("94051000", "SP A", "NC", "a", "b"), ("94052000", "SP A", "LK", "a", "c")]
    df = spark.createDataFrame(rows, "hs_code string, product_line string, kind string, class1 string, class2 string")
    got = {(r.grain, r.key): json.loads(r.json) for r in tables.mapping_json(knowledge.label_mapping(df)).collect()}
    prefix = got["prefix", "9405"]
    assert prefix["total"] == 2 and prefix["levels"]["kind"] == {"top": "LK", "confidence": 0.5, "alt": "NC", "alt_confidence": 0.5}
    assert "alt" not in got["code", "94051000"]["levels"]["kind"]
