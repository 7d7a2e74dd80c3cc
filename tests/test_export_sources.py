from dossier.operators import export


def test_source_rows(spark):
    refs = spark.createDataFrame([("a", 1, "PO 1", 0.9, True), ("b", 2, "PO 2", None, False)], "tag string, v int, source_short string, confidence double, verified boolean")
    place = "struct<page: long, table_index: string, row_label: string, column_label: string, cell: string>"
    rows = [
        ("a", 1, "f.pdf", (3, "0", "ROW", None, " "), " x\ny ", None, "m", None, None), ("a", 1, "g.pdf", (None, None, "", "COL", "B2"), "z" * 800, "译", "m", 0.2, False),
        ("b", 2, "h.pdf", None, None, "", "m", None, None), ("c", 3, "lost.pdf", None, None, "", "m", None, None),
    ]
    supporting = spark.createDataFrame(rows, f"tag string, v int, file_name string, location {place}, original string, translated string, method string, confidence double, verified boolean")
    got = {r.file_name: r for r in export.source_rows(refs, supporting, ["tag", "v"]).collect()}
    assert set(got) == {"f.pdf", "g.pdf", "h.pdf"}
    f, g, h = got["f.pdf"], got["g.pdf"], got["h.pdf"]
    assert (f.table_location, f.page, f.original, f.translated, f.confidence, f.evidence_verified) == ("table 0 / ROW", "3", "x y", "", 0.9, "yes")
    assert (g.table_location, g.page, len(g.original), g.original[-1], g.translated, g.confidence, g.evidence_verified) == ("COL / B2", "", 700, "…", "译", 0.2, "no")
    assert (h.table_location, h.page, h.original, h.confidence, h.evidence_verified, h.remark, h.confirmed_source) == ("", "", "", None, "no", "", "")
