"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in the order a model is trained to complete.

``transform`` gives every whole text's output and how it was made, ``restore`` the text from output and form alone. Both
run SQL of an embedded DuckDB on Arrow batches inside mapInArrow: a batch of about ``BATCH_BYTES`` of text is registered as
a view, cut into tokens, sliced and joined by list functions, and goes back as Arrow; no row is a Python object. Cuts
follow from the sha256 of ``salt:doc_id``, so that a lost task gives the same rows again.

Nulls and odd input: a null text is an empty one, and empty ones are plain. A null doc_id is hashed as nothing after the
colon. Repeated rows give repeated, equal rows. Texts that hold a marker stay plain, so a marker in an output always is
one. A very long text is one list of its tokens: about 8 bytes of memory for each of its bytes, in the task that reads it.
Empty tables give no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, table

#: Fixed values of the format: tokens, markers, the percentage of texts left plain and of suffix-first ones among the rest.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT, SPM_PERCENT, SALT = 10, 20, "1"
#: Bytes of text that a task holds as tokens at once, beyond which a batch is cut.
BATCH_BYTES = 4 << 20
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform_sql(source: str, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT) -> str:
    """DuckDB SQL for the columns of MADE from a relation with doc_id and text."""
    part = lambda i: f"cast('0x' || substr(hashed, {8 * i + 1}, 8) as ubigint)"
    return f"""
        with texts as (
            select doc_id, coalesce(text, '') as text, sha256('{salt}:' || coalesce(cast(doc_id as varchar), '')) as hashed from {source}
        ), tokens as (
            select *, regexp_extract_all(text, '{TOKEN}') as units from texts
        ), points as (
            select *, cast(len(units) as bigint) as n, {part(0)} % (len(units) + 1) as one, {part(1)} % (len(units) + 1) as two,
                case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or {part(2)} % 100 >= {100 - plain_percent} then 'plain'
                     when {part(3)} % 100 < {spm_percent} then 'spm' else 'psm' end as form
            from tokens
        ), pieces as (
            select doc_id, n, form, text,
                case when form <> 'plain' then array_to_string(list_slice(units, 1, cast(least(one, two) as bigint)), '') end as prefix,
                case when form <> 'plain' then array_to_string(list_slice(units, cast(least(one, two) as bigint) + 1, cast(greatest(one, two) as bigint)), '') end as middle,
                case when form <> 'plain' then array_to_string(list_slice(units, cast(greatest(one, two) as bigint) + 1, n), '') end as suffix
            from points
        )
        select doc_id, n, form, cast(length(prefix) as bigint) as prefix_chars, cast(length(middle) as bigint) as middle_chars,
            case form when 'plain' then text
                      when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                      else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end as output
        from pieces"""


def restore_sql(source: str, keep: str) -> str:
    """DuckDB SQL for the columns ``keep`` and restored, the text, from a relation with form and output: pieces lie between markers."""
    return f"""
        with opened as (
            select *, string_split(substr(output, {len(PREFIX) + 1}), case form when 'psm' then '{SUFFIX}' else '{PREFIX}' end) as first from {source}
        ), parted as (
            select *, first[1] as front, string_split(first[2], '{MIDDLE}') as second from opened
        )
        select {keep}, case form when 'plain' then output
                                 when 'psm' then front || second[2] || second[1]
                                 else second[1] || second[2] || front end as restored
        from parted"""


def _cut(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text, a row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = max(1, batch.column(column).nbytes // batch.num_rows)
        step = max(1, most // size)
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            if part.num_rows > 1 and part.column(column).nbytes > 4 * most:  # long texts among short ones: halve
                yield from _cut(iter([part.slice(0, part.num_rows // 2), part.slice(part.num_rows // 2)]), column, most)
            else:
                yield part


def _in_duckdb(df: DataFrame, column: str, sql: str, schema: str) -> DataFrame:
    """The result of DuckDB SQL over each batch of df, seen there as ``batch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in _cut(batches, column, BATCH_BYTES):
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().to_batches()
                con.unregister("batch")

    return df.mapInArrow(run, schema)


def transform(docs: DataFrame, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, salt: str = SALT) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every whole text."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _in_duckdb(narrow, "text", transform_sql("batch", plain_percent, spm_percent, salt), MADE)


def restore(made: DataFrame) -> DataFrame:
    """The columns of ``transform`` and restored, the exact text, from output and form."""
    names = [x.split()[0] for x in MADE.split(", ")]
    return _in_duckdb(made.select(*names), "output", restore_sql("batch", ", ".join(names)), f"{MADE}, restored string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = restore(transform(table(spark, sf_dir, "documents")))
    return whole.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP12_SQL = f"""
    with made as ({transform_sql("documents")})
    select made.doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(coalesce(d.text, '')) as restored_sha256
    from made join documents d on made.doc_id = d.doc_id"""
