"""Extra columns with the names of helpers and results, for every function that keeps the input's columns."""

import pytest
from tests.llm.samples import crowded, odd_documents

from netstrata.llm import langid, lines, pieces, simhash, suffix

HELPERS = ["_d", "_t", "_n_bytes", "_th", "__id", "_N_LINES", "_lang", "_ids", "_id", "_spans", "aside0", "_letters", "_text_hash"]


@pytest.mark.parametrize(
    ("function", "results"),
    [
        (lines.dedup_lines, ["_n_lines", "_n_removed"]),
        (suffix.dedup, ["_n_bytes", "_n_removed", "_n_spans", "_kept_sha256"]),
        (simhash.near_duplicates, []),
        (pieces.encode, ["_ids"]),
        (lambda docs: pieces.decode(pieces.encode(docs)), ["_ids", "_decoded"]),
        (lambda docs: langid.predict(docs, None), ["_lang", "_score", "_entropy", "_letters"]),
    ],
)
def test_clashing_columns_are_kept_or_replaced(spark, function, results):
    docs = odd_documents(spark)
    plain, found = function(docs), function(crowded(docs, *HELPERS))
    kept = [c for c in HELPERS if c.lower() not in results]
    assert sorted(found.columns) == sorted([*docs.columns, *kept, *results])
    names = plain.columns
    assert sorted(map(repr, found.select(*names).collect())) == sorted(map(repr, plain.collect()))
    assert {tuple(r) for r in found.select(*kept).collect()} == {("z",) * len(kept)}
