import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import SMALL
from tests.llm.samples import ROWS, SCHEMA, TEXTS, crowded, odd_documents
from tokenizers import Tokenizer

from netstrata.llm.common import new_path
from netstrata.llm.packing import first_fit, op5_packing, pack, tokenised_pieces
from netstrata.llm.tokens import default_tokenizer, encoder, ids_crc32, op2_token_output, read_metadata, read_tokens, write_tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_words_give_the_ids_of_whole_texts(library):
    got = encoder(default_tokenizer()).encode([None if t is None else t.encode() for t in TEXTS])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t)[:-1] for t in TEXTS]


def test_encoder_forgets_when_full(library):
    from netstrata.llm.tokens import WordEncoder

    small = WordEncoder(default_tokenizer(), limit=3)
    for chunk in (1 << 16, 2):
        small.CHUNK = chunk
        got = small.encode([None if t is None else t.encode() for t in TEXTS])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t)[:-1] for t in TEXTS]


def test_columns_give_the_ids_of_whole_texts(library):
    import pyarrow as pa
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from netstrata.llm.tokens import ColumnEncoder

    want = [ids_of(library, t) for t in TEXTS]
    whole = ColumnEncoder(default_tokenizer())
    forgetful = ColumnEncoder(default_tokenizer(), limit=3, longest=4)
    for own in (whole, forgetful, forgetful, whole):
        assert own.encode(pa.array(TEXTS, pa.string()), 2).to_pylist() == want
    assert len(forgetful.known) <= 3 and max(map(len, forgetful.known.to_pylist()), default=0) <= 4
    assert whole.encode(pa.array([], pa.string()), 2).to_pylist() == []
    assert whole.encode(pa.array(["x", None, *TEXTS], pa.string()).slice(2), 2).to_pylist() == want
    small = ColumnEncoder(default_tokenizer())
    small.PIECE = 16
    for text, ids in zip(TEXTS, want, strict=True):
        assert small.encode(pa.array([text], pa.string()), 2).to_pylist() == [ids]

    words = st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["Déjà", "the,", "the", "...", "İ", "A#b|", "9.", "\n", "\u00a0x"])), max_size=12)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(words.map(" ".join), min_size=1, max_size=4))
    def agree(texts):
        assert forgetful.encode(pa.array(texts, pa.string()), 2).to_pylist() == [ids_of(library, t) for t in texts]

    agree()


def test_batches_are_cut_by_bytes():
    import pyarrow as pa

    from netstrata.llm.tokens import of_bytes

    texts = ["ab", None, "abcd", "", "abcdefghijkl", "a", "b"]
    batches = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], ["text"]) for t in (texts, [], texts[3:])]
    cut = [b.column("text").to_pylist() for b in of_bytes(batches, 5)]
    assert cut == [["ab", None], ["abcd", ""], ["abcdefghijkl"], ["a", "b"], [""], ["abcdefghijkl"], ["a", "b"]]


def test_token_files_round_trip(spark, library):
    docs = crowded(odd_documents(spark), "part", "ids", "n_tokens", "start")
    path = new_path(spark, "t")
    write_tokens(docs, path)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in rows] == [w[0] for w in want]
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted(tuple(ids_of(library, w[1])) for w in want)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert {(r.doc_id, r.start, r.n_tokens) for r in read_metadata(spark, path).collect()} == {(r.doc_id, r.start, r.n_tokens) for r in rows}
    assert sorted(r.ids_crc32 for r in ids_crc32(read_tokens(spark, path)).collect()) == sorted(zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)


def test_token_files_use_dictionary_delta_and_indexes(spark):
    import glob

    import pyarrow.parquet as pq

    path = new_path(spark, "t")
    write_tokens(odd_documents(spark), path)
    seen = defaultdict(set)
    for name in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_column_index or col.physical_type == "INT32"
                assert col.has_offset_index
                seen[col.path_in_schema] |= set(col.encodings)
    assert "RLE_DICTIONARY" in seen["ids.list.element"]
    assert "DELTA_BINARY_PACKED" in seen["n_tokens"]


def test_token_query_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    at, want = 0, []
    for d in sorted(docs):
        ids = ids_of(library, docs[d])
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op2_token_output(spark, SMALL).collect())) == want


def first_fit_plainly(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        k = next((k for k, used in enumerate(bins) if used + n <= capacity), len(bins))
        bins += [0] * (k == len(bins))
        out.append((k, bins[k]))
        bins[k] += n
    return out


def test_tree_gives_first_fit():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        lengths = sorted(rng.integers(1, 101, n).tolist(), reverse=True)
        assert list(zip(*first_fit(lengths, 100), strict=True)) == first_fit_plainly(lengths, 100)


def check_packed(rows, docs, library, capacity):
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, text in docs.items():
        ids, at = ids_of(library, text), 0
        for r in sorted(pieces.pop(d), key=lambda r: r.start):
            assert r.start == at
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    check_packed(op5_packing(spark, SMALL).collect(), docs, library, 4096)


def test_packing_odd_rows(spark, library):
    docs = crowded(spark.createDataFrame(ROWS, SCHEMA), "length", "start", "pack_group", "offset")
    for group in (3, 1000):
        rows = pack(tokenised_pieces(docs, 64), docs.count(), 64, group).collect()
        check_packed(rows, {r[0]: r[1] for r in ROWS}, library, 64)
    odd = odd_documents(spark)
    assert pack(tokenised_pieces(odd), odd.count()).select("doc_id").distinct().count() == len(ROWS) + 1


def test_large_ids_beside_null_ids_stay_whole(spark, library):
    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "one text", "en", "s", 0), (None, "another", "en", "s", 0), (-(2**63), None, "en", "s", 0), (2**63 - 1, "x" * 900, "en", "s", 0)], SCHEMA)
    for group in (1, 1000):
        rows = pack(tokenised_pieces(docs, 64), docs.count(), 64, group).collect()
        assert {r.doc_id for r in rows} == {big, None, -(2**63), 2**63 - 1}
        check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, library, 64)


def test_rows_without_ids_spread_over_groups(spark):
    docs = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'same text' as text", "'en' as lang", "'s' as source", "0L as n_chars")
    rows = pack(tokenised_pieces(docs), 4000, group_pieces=200).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
    assert len(rows) == 20 and max(r["count"] for r in rows) < 300


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pack(tokenised_pieces(none), 0).collect() == []
    path = new_path(spark, "t")
    write_tokens(none, path)
    assert read_tokens(spark, path).collect() == []
