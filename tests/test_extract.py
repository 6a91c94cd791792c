"""Links in every way of quoting, published tables by the union of their headers, fingerprints of parts."""

import pytest

from ledgerline.operators import extract, quality

PAGE = """<!-- <a href="hidden.pdf">no</a> --><A HREF='/one.pdf' title="a > b">First
  <b>List</b></A><a class=x href=two.PDF>Second</a><a href="http://h.in/three.pdf?v=1&amp;w=2">T &amp; R</a><a name="top">no address</a>
<a href = "four.pdf" >Fourth<a href="four.pdf">again</a><script>var s = '<a href="js.pdf">no</a>';</script><a href="five.html">no list</a><a href='six.pdf'>never closed"""


def test_links_however_they_are_quoted(spark):
    pages = spark.createDataFrame([(1, "https://bank.in/lists/index.html", PAGE), (2, "https://x.in/", None), (None, "https://x.in/a", "<a href=z.pdf>z</a>")], "page_id long, url string, html string")
    got = {(r["page_id"], r["href"], r["text"], r["quarter"]) for r in extract.extract_links(pages).collect()}
    assert got == {
        (1, "https://bank.in/one.pdf", "first list", "one"), (1, "https://bank.in/lists/two.PDF", "second", "two"), (1, "http://h.in/three.pdf?v=1&w=2", "t & r", "three"),
        (1, "https://bank.in/lists/four.pdf", "fourth", "four"), (1, "https://bank.in/lists/six.pdf", "never closed", "six"), (None, "https://x.in/z.pdf", "z", "z"),
    }


def cells(tables):
    return [(t, r, c, v) for t, rows in tables.items() for r, row in enumerate(rows) for c, v in enumerate(row)]


def test_tables_of_all_headers(spark):
    tables = {
        1: [["Borrower list", "", ""], ["Name of the Borrower", "PAN", "Amount"], ["Alpha ", "P1", "1,000.5"], ["", " ", None]],
        2: [["Bank", "Row_pos", "Bank Name"], ["", "x", "Second"], ["First", "y", "Other"]],
        3: [["Chapter", "Page"], ["One", "7"]],
    }
    df = spark.createDataFrame(cells(tables), "table_id long, row_pos long, col_pos int, value string")
    origin = spark.createDataFrame([(1, "a.pdf", "t1"), (2, "b.pdf", None)], "table_id long, source_pdf string, template_hint string")
    got = extract.union_published_tables(df, origin)
    assert got.columns == ["table_id", "row_pos", "company_name", "bank_name", "amount", "pan", "row_pos_", "source_pdf", "template_hint"]
    assert sorted(map(tuple, got.collect())) == [(1, 2, "Alpha", None, 1000.5, "P1", None, "a.pdf", "t1"), (2, 1, None, "Second", None, None, "x", "b.pdf", None), (2, 2, None, "First", None, None, "y", "b.pdf", None)]
    with pytest.raises(ValueError, match="more than 3"):
        extract.union_published_tables(df, most=3)


def test_fingerprints_of_parts_add_up(spark):
    df = spark.createDataFrame([(i % 50, None if i % 7 == 0 else f"v{i % 13}") for i in range(600)], "a int, b string")
    whole = quality.fingerprint_lanes(df).first()
    parts = quality.fingerprint_lanes(df.filter("a < 20")).union(quality.fingerprint_lanes(df.filter("a >= 20").repartition(3)))
    assert quality.merged_lanes(parts).first() == whole and whole["n"] == 600
    assert quality.dataset_fingerprint(df.repartition(5)).first() == quality.dataset_fingerprint(df.orderBy("b")).first()
    one, other = (spark.createDataFrame([r], "a string, b string") for r in (("x", "yz"), ("xy", "z")))
    assert quality.dataset_fingerprint(one).first() != quality.dataset_fingerprint(other).first()
    assert quality.dataset_fingerprint(df.limit(0)).first()["n_rows"] == 0
