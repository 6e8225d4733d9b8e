from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.plans import refresh
from cargoline.streaming import incremental


def test_new_files_are_classified_once(spark, tmp_path):
    l4 = "product_line string, kind string, class1 string, class2 string"
    history = [(1, "9405", "bulb a", "bulb a", "L", "NC", "c", "x"), (2, "9405", "cable b", "cable b", "L", "LK", "c", "y")]
    known = refresh.refresh(spark.createDataFrame(
        history, f"row_id bigint, hs_code string, product_name string, clean_text string, {l4}"))
    schema = "row_id bigint, HS_Code string, Detailed_Product string, VN_Importer string"
    folder, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(folder)
        query = incremental.watch(spark, folder, schema, known, out, check)
        query.awaitTermination(120)

    arrive([(1, "9405.0", "Bulb A", "co"), (2, "9405", None, "co")])
    arrive([(3, "1111", "thing 5w", "co")])
    got = {r.row_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].status, got[1].class2, got[1].trade_direction) == (K.STATUS_HISTORY, "x", "import")
    assert got[3].status == K.STATUS_REVIEW and got[3].power == "5w"
    assert spark.read.parquet(out).groupBy("batch").agg(F.count("*")).count() == 2
