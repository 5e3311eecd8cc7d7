import re
from collections import Counter, defaultdict

import duckdb
from tests.conftest import MEDIUM
from tests.llm.samples import SCHEMA, crowded, odd_documents

from netstrata.llm import lines, quality

GAP = re.compile(r"[\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = [w for w in GAP.split(text) if w]
    kept = [x for x in text.split("\n") if GAP.sub("", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(kept) - len(set(kept)), len(covered)


def sql_rows(sql, path):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    cur = con.execute(sql)
    return [c[0] for c in cur.description], cur.fetchall()


def same(df, sql, path):
    names, rows = sql_rows(sql, path)
    return sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(rows, key=repr)


def test_quality_query_against_sql_and_python(spark):
    found = quality.op3_quality_rules(spark, MEDIUM)
    assert same(found, quality.OP3_SQL, MEDIUM)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    for r in found.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_quality_plan_has_no_python(spark):
    plan = quality.measures(spark.read.parquet(f"{MEDIUM}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    plan = quality.op3_quality_rules(spark, MEDIUM)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|hashpartitioning", plan)  # a small file is dealt over the cores


def test_quality_odd_rows(spark):
    docs = crowded(odd_documents(spark), "words", "lines", "windows", "n_words")
    rows = quality.measures(docs).collect()
    assert len(rows) == docs.count()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(plain_measures(r.text))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in texts[r.doc_id]
    assert quality.measures(spark.createDataFrame([], SCHEMA)).collect() == []


def test_line_query_against_sql(spark):
    assert same(lines.op9_line_dedup(spark, MEDIUM), lines.OP9_SQL, MEDIUM)


def test_lines_on_many_sites(spark):
    rows = [(i, f"own line {i}\n  Menu  \nshared {i % 2}\n\nMenu", "en", f"site{i % 6}", 0) for i in range(12)]
    rows += [(50, "Menu\nleft", "en", None, 0), (51, None, "en", "site1", 0), (52, "", "en", "site1", 0)]
    docs = crowded(spark.createDataFrame(rows, SCHEMA), "_at", "pos", "line")
    for most, gone in ((6, {"Menu"}), (3, {"Menu", "shared 0", "shared 1"}), (7, set())):
        out = {r.doc_id: r for r in lines.dedup_lines(docs.drop("_at"), most).collect()}
        seen = set()
        for doc_id, text, *_ in rows:
            if text is None:
                assert out[doc_id].text is None and out[doc_id]._n_lines == 0
                continue
            kept = []
            for line in text.split("\n"):
                if line.strip() not in gone or line.strip() not in seen:
                    kept.append(line)
                seen.add(line.strip())
            assert out[doc_id].text == "\n".join(kept)
            assert out[doc_id]._n_removed == len(text.split("\n")) - len(kept)


def test_near_and_clear_lines_agree_with_exact_counts(spark, monkeypatch):
    rows = [(i * 100 + j, f"line of {i}", "en", f"site{j}", 0) for i in range(1, 40) for j in range(i)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for limit in (0, 10**6):
        monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
        out = lines.dedup_lines(docs, 10).collect()
        assert {r.doc_id // 100 for r in out if r._n_removed} == set(range(10, 40))
        assert sum(r._n_removed for r in out) == sum(i - 1 for i in range(10, 40))


def test_line_plan_has_no_python(spark):
    plan = lines.dedup_lines(spark.read.parquet(f"{MEDIUM}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas", plan)


def test_sketches_come_before_pairs(spark):
    """No distinct pairs of all lines and sites: the one shuffle of whole lines carries sketches."""
    plan = lines.line_spread(spark.read.parquet(f"{MEDIUM}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_hll_sketch_agg" in plan and plan.count("Exchange hashpartitioning") == 1
    assert not re.search(r"keys=\[[^\]]*_site", plan)


def test_texts_of_many_lines(spark):
    text = "\n".join(["Menu", *(f"line {i}" for i in range(100_000)), "Menu"])
    rows = [(i, f"Menu\nown {i}", "en", f"site{i}", 0) for i in range(12)] + [(50, text, "en", "site1", 0)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert out[50].text == text.removeprefix("Menu\n").removesuffix("\nMenu") and (out[50]._n_lines, out[50]._n_removed) == (100_002, 2)
    assert out[0].text == "Menu\nown 0" and out[1].text == "own 1"


def test_line_odd_rows(spark):
    docs = odd_documents(spark)
    assert lines.dedup_lines(docs, 2).count() == docs.count()
    assert lines.dedup_lines(crowded(docs, "_lines", "_removed", "_id", "_h1", "_clear", "lines", "pos"), 2).count() == docs.count()
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
