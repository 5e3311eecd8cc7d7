import hashlib
import re

import duckdb
import pyarrow as pa
from tests.conftest import MEDIUM
from tests.llm.samples import crowded, odd_documents

from netstrata.llm import fim


def plain(doc_id, text):
    """(n, form, prefix chars, middle chars, output) by the definition."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_python_and_sql(spark):
    found = fim.op12_fill_in_middle(spark, MEDIUM).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    assert len(found) == len(texts)
    for r in found:
        *facts, output = plain(r.doc_id, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, *facts, sha(output), sha(texts[r.doc_id]))
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{MEDIUM}/documents.parquet'")
    cur = con.execute(fim.OP12_SQL)
    names = [c[0] for c in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in found)


def test_odd_rows(spark):
    more = [(100 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x<M>", "<", "<S", "P><S", "\0é\r\n", "<p><s>", "a" * 70, "世界 <M", "  b"])]
    docs = odd_documents(spark).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for salted in range(20):  # cuts at many places, next to signs that look like markers
        many = docs.selectExpr(f"doc_id + {salted * 1000} doc_id", "text")
        found = fim.restore(fim.transform(crowded(many, "units", "form", "batch", "output", "restored"))).collect()
        want = [(None if i is None else i + salted * 1000, t) for i, t in rows]
        assert sorted((repr(r.doc_id), r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.restored) for r in found) == sorted((repr(i), n, f, p or 0, m or 0, o, t or "") for i, t in want for n, f, p, m, o in [plain(i, t)])


def test_settings(spark):
    docs = odd_documents(spark)
    assert {r.form for r in fim.transform(docs, plain_percent=100).collect()} == {"plain"}
    assert "psm" not in {r.form for r in fim.transform(docs, plain_percent=0, spm_percent=100).collect()}
    assert [r.output for r in fim.transform(docs, salt="2").collect()] != [r.output for r in fim.transform(docs).collect()]


def test_empty_table(spark):
    assert fim.restore(fim.transform(odd_documents(spark).limit(0))).collect() == []


def test_batches_are_cut_by_bytes():
    texts = pa.RecordBatch.from_arrays([pa.array(["a" * 1000] * 100 + ["b" * 100_000] * 3)], ["text"])
    parts = list(fim._cut(iter([texts]), "text", 20_000))
    assert sum(p.num_rows for p in parts) == 103 and all(p.num_rows == 1 or p.column("text").nbytes <= 4 * 20_000 + 1000 for p in parts)
