import re

from pyspark.sql import functions as F

from cargoline import constants as K
from cargoline.functions import codes, labels, text

# the edge rows every text operator has to pass
EDGES = [
    "", None, "!!!@@@###$$$%%%^^^&&&***()()", "đèn led panel " * 200, "sản phẩm không xác định", "đèn led 10w philips",
    "123456789", "LED BULB 9W 电灯泡 bóng đèn ランプ", "rác#&đèn led panel 40w rạng đông#&thêm rác", "ab#&cd", "#& #&", "one",
    "  A\tB　C ", "CODE-12B#&Bình giữ nhiệt 1.2m RS-378B, dung tích 500 ml#&VN", "đ10w x.1 .b..1đ 1,5 2.5.3", "İstanbul",
    "Đèn Philips 60 W/220V", "a;b c,d e/f g",
]
LETTERS = K.VIETNAMESE_LETTERS


def longest(t):
    parts = [p.strip() for p in t.split("#&") if p.strip()]
    return max(parts, key=len) if "#&" in t and parts else t


def basic(t):
    return " ".join(re.sub(f"[^a-z0-9{LETTERS}]", " ", longest((t or "").lower())).split())


def deep(t):
    t = re.sub(r"^[^#]*#\s*&?\s*", "", (t or "").lower())
    t = re.sub(r"#\s*&?\s*vn\s*$", "", t)
    t = re.sub(r"\b(?=[a-z0-9.-]*\d)(?=[a-z0-9.-]*[a-z])[a-z0-9.-]+\b", " ", t)
    t = re.sub(r"\b\d+(?:[.,]\d+)?\b", " ", t)
    return " ".join(re.sub(f"[^a-z{LETTERS}\\s]+", " ", t).split())


def run(spark, column, values=EDGES):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_clean_basic_and_segments(spark):
    assert run(spark, text.clean_basic(F.col("t"))) == [basic(t) for t in EDGES]
    assert run(spark, text.longest_segment(F.col("t"))) == [None if t is None else longest(t) for t in EDGES]


def test_clean_deep(spark):
    assert run(spark, text.clean_deep(F.col("t"))) == [deep(t) for t in EDGES]


def test_ngrams_of_short_and_empty_arrays(spark):
    def grams(t, n_max=3):
        w = basic(t).split()
        return [" ".join(w[i:i + n]) for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    assert run(spark, text.ngrams(text.words(text.clean_basic(F.col("t"))))) == [grams(t) for t in EDGES]
    positioned = run(spark, text.positioned_ngrams(text.words(text.clean_basic(F.col("t"))), F.lit(4)))
    assert [[g.gram for g in r or []] for r in positioned] == [grams(t, 4) for t in EDGES]


def test_specs(spark):
    values = ["Đèn 10.5 W Philips lg", "100KVA", "không", "rác#&bóng SINO 9w#&x", "LG 220v panasonic"]
    assert run(spark, text.power_rating(F.col("t")), values) == ["10.5 w", "100kva", "", "9w", "220v"]
    assert run(spark, text.brand(F.col("t")), values) == ["Philips", "", "", "Sino", "Panasonic"]


def test_names_and_kinds(spark):
    values = ["Bóng đèn (Other LED lamps), loại khác", "(x)", "- Thiết bị hoặc bộ phận", ""]
    assert run(spark, text.line_name(F.col("t")), values) == ["SP BÓNG ĐÈN", "SP (X)", "SP THIẾT BỊ", ""]
    assert run(spark, text.industry_name(F.col("t")), values)[0] == "Bóng đèn , loại khác"
    assert run(spark, text.infer_kind(F.col("t")), ["Vỏ đèn", "Đèn bàn"]) == ["LK", "NC"]


def test_variants_keep_order_and_limit(spark):
    got = run(spark, text.text_variants(F.col("t")), ["a b c d", "a b", "x y, z w; a b / c d", "one"])
    assert got == [["a b c", "a b d", "b c d"], [], ["x y, z", "x y, d", "y, z w; a b / c d"], []]


def test_numbers_dates_codes(spark):
    numbers = ["1,234", "$12.50", "3 USD", "n/a", "1e5", "", None, "-4"]
    assert run(spark, codes.parse_number(F.col("t")), numbers) == [1234.0, 12.5, 3.0, None, 15.0, None, None, -4.0]
    dates = ["2025-03-04", "04/03/2025", "bad", None]
    assert [str(d) if d else d for d in run(spark, codes.parse_date(F.col("t")), dates)] == ["2025-03-04", "2025-03-04", None, None]
    assert run(spark, codes.month_name(F.month(codes.parse_date(F.col("t")))), dates) == ["Tháng 3", "Tháng 3", "", ""]
    hs = ["9405.00", "94051000.0", " 8539 ", "12", None, "85.39.10"]
    assert run(spark, codes.hs_plain(F.col("t")), hs) == ["9405.00", "94051000", "8539", "12", "", "85.39.10"]
    assert run(spark, codes.hs_valid(F.col("t")), hs) == ["940500", "940510000", "8539", None, None, "853910"]


def test_labels(spark):
    values = [" sp led ", "Đèn UV", None, "0", "SP LED"]
    assert run(spark, labels.normalize_part(F.col("t"), "product_line"), values) == [
        "SP LED", "đèn uv", K.NO_LABEL, K.NO_LABEL, "SP LED"]
    combined = ["a | b | c | d", "a | b", "", None, "A | nc | Highbay | 0"]
    assert run(spark, labels.normalize_combined(F.col("t")), combined) == [
        "a | b | c | d", f"a | b | {K.NO_LABEL} | {K.NO_LABEL}", " | ".join([K.NO_LABEL] * 4), " | ".join([K.NO_LABEL] * 4),
        f"A | NC | highbay | {K.NO_LABEL}"]
    assert run(spark, labels.signature(F.col("t")), [f"a | {K.NO_LABEL} | c"]) == ["a|c"]
