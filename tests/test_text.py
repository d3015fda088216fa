from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions import values as V
from lexloom.functions.repair import fix_mojibake, highlight, merge_spans, repair


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "s string").select(column.alias("x")).first()["x"]


def test_strip_accents(spark):
    assert one(spark, X.strip_accents("s"), "bóng đá") == "bong da"
    assert one(spark, X.strip_accents("s"), "đại úy công an Đ") == "dai uy cong an D"
    assert one(spark, X.strip_accents("s"), "công") == "cong"


def test_repair(spark):
    assert repair("CÃ´ng an") == "Công an"
    assert repair("cÆ°á»›p") == "cướp"
    assert repair("Ärzte über Äpfel") == "Ärzte über Äpfel"
    assert repair(None) == "" and repair("") == ""
    assert one(spark, fix_mojibake("s"), "CÃ´ng an Huáº¿") == "Công an Huế"


def test_tokens(spark):
    assert one(spark, X.tokens("s"), "Cướp tiệm_vàng Huế") == ["cuop", "tiem_vang", "tiem", "vang", "hue"]
    found = one(spark, X.tokens("s"), "Bóng_đá Liverpool dự_đoán a 7")
    assert found == ["bong_da", "bong", "da", "liverpool", "du_doan", "du", "doan", "7"]
    assert {"cong", "an", "cuop", "tiem", "vang"} <= set(one(spark, X.tokens("s"), "CÃ´ng an cÆ°á»›p tiá»‡m vÃ\u00a0ng"))
    assert one(spark, X.tokens("s"), "") == []


def test_boilerplate(spark):
    found = one(spark, X.normalize_text("s"), "Tin chính adsbygoogle window adsbygoogle push")
    assert "tin" in found and "adsbygoogle" not in found
    assert one(spark, X.normalize_text("s"), "Giá vàng Trang thông tin điện tử tổng hợp\nhết bài") == "gia vang"
    assert one(spark, X.normalize_text("s"), "xem https://a.vn/b?c RSS nhé") == "xem nhe"


def test_display(spark):
    assert one(spark, X.clean_display("s", 7), "CÃ´ng   an Huáº¿") == "Công an..."
    assert one(spark, X.clean_display("s"), " a  b\n") == "a b"
    assert one(spark, X.chunk_title("s"), None) == ""


def test_dates(spark):
    assert one(spark, X.date_marks("s"), "1/2/24").strip() == "DATE20240201"
    assert one(spark, X.date_marks("s"), "01-02-2024").strip() == "DATE20240201"
    assert one(spark, X.date_marks("s"), "3.5 31.12").split() == ["DATE0503", "DATE1231"]


def test_clean_keep_case(spark):
    assert one(spark, X.clean_keep_case("s"), "<b>Ngày</b> 1/2/24, http://a.b x@y.com: tin_tức-mới!") == "Ngày DATE20240201 tin_tức-mới"


def test_urls_and_names(spark):
    for url, host in (("https://www.a.vn:80/x", "a.vn:80"), ("", ""), ("nothing", ""), ("http://www.www.b.vn", "b.vn"), (None, "")):
        assert one(spark, X.source_from_url("s"), url) == host
    assert one(spark, X.canonical_topic("s"), "PHÁP LUẬT") == "Pháp luật"
    assert one(spark, X.canonical_topic("s"), " thế GIỚI mới") == "Thế giới mới"
    assert one(spark, X.canonical_topic("s"), None) == X.NO_TOPIC
    assert one(spark, X.canonical_source("s"), " DocBao.VN ") == "docbao.vn"


def test_times(spark):
    def both(number, text):
        row = spark.createDataFrame([(number, text)], "n double, t string").select(V.timestamp_text("n", "t").alias("a"), V.date_text("n", "t").alias("b")).first()
        return row["a"], row["b"]

    assert both(1659344927355.0, None) == ("2022-08-01T09:08:47Z", "2022-08-01")
    assert both(1659344927.0, None) == ("2022-08-01T09:08:47Z", "2022-08-01")
    assert both(0.0, None) == ("1970-01-01T00:00:00Z", "1970-01-01")
    assert both(None, None) == ("", "") and both(None, "") == ("", "")
    assert both(None, "2024-05-06T00:00") == ("2024-05-06T00:00", "2024-05-06")
    assert both(None, "2024") == ("2024", "")
    assert both(None, "1659344927355") == ("1659344927355", "1659344927")


def test_highlight():
    assert highlight("Nguyễn Quốc Bảo, nguyen_quoc", ["nguyen", "quoc"]) == "<em>Nguyễn</em> <em>Quốc</em> Bảo, nguyen_quoc"
    assert highlight("", ["a1"]) == "" and highlight("abc", []) == "abc" and highlight(None, ["ab"]) == ""
    assert merge_spans([(3, 5), (0, 2), (2, 3), (7, 9), (8, 8)]) == [(0, 5), (7, 9)]


def test_numbers(spark):
    row = spark.range(1).select(*(V.min_matched(F.lit(n)).cast("int").alias(str(n)) for n in range(1, 11))).first()
    assert list(row) == [1, 2, 3, 3, 4, 5, 5, 6, 7, 7]
    assert V.total_pages(0, 10) == 1 and V.total_pages(21, 10) == 3
    assert one(spark, V.none_if_nan("s"), "nan") is None and one(spark, V.none_if_nan("s"), "nano") == "nano"
