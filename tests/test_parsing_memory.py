import pyarrow as pa

from orgatlas.sources import html


def test_few_pages_are_objects_at_once():
    pages = pa.RecordBatch.from_arrays([pa.array(range(205)), pa.array([f"https://h/{i}" for i in range(205)]), pa.array(["<p>a</p>"] * 204 + [None])], ["page_id", "url", "html"])
    out = list(html._parse(iter([pages])))
    assert max(b.num_rows for b in out) <= html.PAGES_AT_ONCE < 205
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(205))
