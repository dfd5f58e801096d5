from pyspark.sql import functions as F

from docweave.layout import images as im


def test_images(spark):
    df = spark.createDataFrame([(120, 120, None, 100.0, 100.0), (400, 3, None, 100.0, 3.0), (None, None, 2000, None, None), (None, None, 10, None, None), (100, 100, None, 5.0, 5.0)], "w int, h int, b int, pw double, ph double")
    assert [r[0] for r in df.select(im.is_content_image(*map(F.col, ("w", "h", "b", "pw", "ph")))).collect()] == [True, False, True, False, False]
    rep = spark.createDataFrame([(1, p, "logo", 10.0, 40.0, 842.0) for p in range(1, 5)] + [(1, 1, "foto", 300.0, 500.0, 842.0)], "doc_id int, page_num int, digest string, y0 double, y1 double, height double")
    assert [r.digest for r in im.repeated_images(rep).collect()] == ["logo"]


def test_rules_and_tables(spark):
    d = spark.createDataFrame([(1, 1, 50.0, 740.0, 250.0, 741.0, 595.0, 842.0), (1, 1, 50.0, 300.0, 250.0, 301.0, 595.0, 842.0)], "doc_id int, page_num int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    assert im.note_rules(d).first().rule_y == 740.0
    lines = spark.createDataFrame([(1, 1, 10.0, 10.0, 50.0, 20.0, "in"), (1, 1, 10.0, 300.0, 50.0, 320.0, "out"), (2, 1, 10.0, 10.0, 50.0, 20.0, "other")], "doc_id int, page_num int, x0 double, y0 double, x1 double, y1 double, t string")
    boxes = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "doc_id int, page_num int, x0 double, y0 double, x1 double, y1 double")
    assert {r.t for r in im.outside_tables(lines, boxes).collect()} == {"out", "other"}


def test_recognition(spark):
    p = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (2, 1, 900), (2, 1, 900), (2, 2, 0)], "doc_id int, page_num int, char_count int")
    assert {r.doc_id: r.forced for r in im.forced_recognition(p).collect()} == {1: True, 2: False}
    x = spark.createDataFrame([("spa+eng",), ("jpn",)], "w string")
    assert [r[0] for r in x.select(im.installed_languages(F.col("w"), ["deu", "spa"])).collect()] == ["spa", "deu"]
    notes = spark.createDataFrame([(1, 1, 1, "1", True, "Una"), (1, 2, 2, "2", False, "Otra")], "doc_id int, page_num int, number int, marker string, anchored boolean, text string")
    assert im.notes_markdown(notes).first().markdown == "[^1]: Una\n\n## Notes without a call\n\n- (2) Otra"
