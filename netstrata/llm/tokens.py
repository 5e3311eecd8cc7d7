"""Token-ID output: tokenised documents as Parquet list columns.

``write_tokens`` orders documents by id, encodes each whole text and writes one row per document with its ids as an
``array<int>``. Ids are dictionary encoded (the vocabulary fits one dictionary page), counts and positions are delta
encoded (version-2 pages); row groups and pages have set sizes, and the writer adds column and offset indexes, so a
reader can take metadata without ids, or the ids of a range of documents, without reading the rest. ``read_tokens`` adds
each document's global start from per-file totals.

Nulls and odd input: a null or empty text has only the end id. Null doc_ids come first. Rows with equal doc_id are
ordered by the text's hash, then text; equal rows keep one row each. A very long text is one row, and takes memory in
proportion in the task that writes it. An empty table writes no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, new_path, single_threaded, table

WORD_BPE = "word_bpe_49k.json"
END_ID = 2
#: Layout of the token files: bytes of a row group and of a page, and the largest dictionary page.
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 32 << 20, 256 << 10, 1 << 20
TOKEN_SCHEMA = "doc_id long, n_tokens long, part int, part_start long, ids array<int>"


class WordEncoder(dict):
    """Encodes texts with the tokenizers library, one white-space separated word at a time, and remembers words.

    The tokenizer drops white space and makes letters small before it makes tokens, so the ids of a text are those of its
    words in turn; only plain spaces and line feeds are cut at, and only A-Z made small, here. A word of plain letters is
    one piece for the tokenizer's model and goes straight to it. The tokenizer never joins a letter with a sign after it,
    so a word that ends in signs is its letters and then its signs. All other words go through the whole tokenizer. The
    memory holds about ``limit`` words and is emptied when full; words longer than ``longest`` bytes aren't kept. A text is
    encoded ``CHUNK`` words at a time, so one very long text can't fill it beyond that.
    """

    #: a-z and the small letters of Latin-1, in code order.
    SMALL = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    PLAIN = re.compile(f"[{SMALL}]+").fullmatch
    SIGNS = b".,*%$&#|;:!?"
    CHUNK = 1 << 16

    def __init__(self, path: str, limit: int = 250_000, longest: int = 48):
        super().__init__({b"": b""})
        single_threaded()
        from tokenizers import Tokenizer

        self.library, self.limit, self.longest = Tokenizer.from_file(path), limit, longest
        self.letters = self._letters()
        self.model = self.library.model

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        return [self._encode(text.lower().replace(b"\n", b" ").split(b" ")) if text else b"" for text in texts]

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some words."""
        if len(self) > self.limit:
            self.clear()
            self[b""] = b""
        return list(map(self.__getitem__, words))

    def _encode(self, words: list[bytes]) -> bytes:
        ids = []
        for at in range(0, len(words), self.CHUNK):
            if len(self) > self.limit:
                self.clear()
                self[b""] = b""
            ids.append(b"".join(map(self.__getitem__, words[at : at + self.CHUNK] if len(words) > self.CHUNK else words)))
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(self.SIGNS)
        if not self.letters or not core:
            ids = self._whole(word)
        elif core.isalpha():  # of ASCII
            ids = self._letters_only(word.decode()) if len(core) == len(word) else self[core] + self[word[len(core) :]]
        elif self.PLAIN(text := core.decode()):
            ids = self._letters_only(text.translate(self.letters)) if len(core) == len(word) else self[core] + self[word[len(core) :]]
        else:
            ids = self._whole(word)
        if len(word) <= self.longest:
            self[word] = ids
        return ids

    def _letters_only(self, spelt: str) -> bytes:
        return array("I", [token.id for token in self.model.tokenize(spelt)]).tobytes()

    def _whole(self, word: bytes) -> bytes:
        return array("I", self.library.encode(word.decode(), add_special_tokens=False).ids).tobytes()

    def _letters(self) -> dict[int, str] | None:
        """How the tokenizer spells each small Latin letter to its model, if it leaves runs of them whole; else None."""
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        if cut is None or normal is not None and normal.normalize_str(self.SMALL) != self.SMALL:
            return None
        spelt = {letter: cut.pre_tokenize_str(letter) for letter in self.SMALL}
        whole = cut.pre_tokenize_str(self.SMALL)
        if any(len(x) != 1 for x in spelt.values()) or len(whole) != 1 or whole[0][0] != "".join(x[0][0] for x in spelt.values()):
            return None
        if any(spelt[letter][0][0] != letter for letter in self.SMALL[:26]):
            return None
        return {ord(letter): x[0][0] for letter, x in spelt.items()}


class ColumnEncoder:
    """Encodes whole columns of texts, word by word as ``WordEncoder`` does, but with the words it remembers in Arrow.

    Arrow cuts a column into words and numbers the different ones, one hash lookup places those among the known, and only
    new ones are Python objects; ids are laid out by the words' numbers. A known word takes about 45 bytes. When there are
    over ``limit``, or over ``most`` bytes of them, the half of ``limit`` that stood in most columns stays, without words over
    ``longest`` bytes. Texts over ``PIECE`` bytes are cut at blanks and encoded a piece at a time.
    """

    PIECE = 4 << 20
    BLANK = re.compile(rb"[ \n]").search
    #: Words of which Python objects are at hand, for words that are others with signs after them.
    FRESH = 50_000

    def __init__(self, path: str, limit: int = 500_000, most: int = 32 << 20, longest: int = 48):
        self.words, self.limit, self.most, self.longest = WordEncoder(path, self.FRESH), limit, most, longest
        self.known, self.seen = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and the end id."""
        if len(texts) == 1 and texts.nbytes > self.PIECE:
            whole, pieces, at = utf8(texts)[0] or b"", [], 0
            while at < len(whole):
                blank = self.BLANK(whole, at + self.PIECE)
                stop = blank.end() if blank else len(whole)
                pieces.append(self._ids(pa.array([whole[at:stop]], pa.binary()).cast(pa.string()))[0])
                at = stop
            ids, ends = np.concatenate([np.zeros(0, np.int32), *pieces]), np.array([sum(map(len, pieces))])
        else:
            ids, ends = self._ids(texts)
        offsets = np.r_[0, ends + np.arange(1, len(ends) + 1)].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.insert(ids, ends, np.int32(end_id))))

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where those of each end."""
        words = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts.fill_null("")), "\n", " "), " ")
        coded = words.flatten().dictionary_encode()
        order = self._places(coded.dictionary)[coded.indices.to_numpy()]
        taken = self.sizes[order]
        stops = np.r_[0, np.cumsum(taken)]
        places = np.repeat((np.cumsum(self.sizes) - self.sizes)[order] - stops[:-1], taken) + np.arange(stops[-1])
        out = self.ids[places]
        if len(self.known) > self.limit or self.known.nbytes + self.ids.nbytes > self.most:
            self._thin()
        return out, stops[np.cumsum(words.value_lengths().to_numpy())]

    def _places(self, different: pa.Array) -> np.ndarray:
        """Where different words are among the known ones, to which new ones are added."""
        found, n = pc.index_in(different, value_set=self.known), len(self.known)
        new = different.filter(found.is_null())
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        places[places < 0] = np.arange(n, n + len(new))
        ids = self.words.each(utf8(new))
        self.known = pa.concat_arrays([self.known, new])
        self.sizes = np.r_[self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 4]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<i4")])
        self.seen = np.r_[self.seen, np.zeros(len(new), np.int32)]
        self.seen[places] += 1
        return places

    def _thin(self) -> None:
        short = np.flatnonzero(pc.binary_length(self.known).to_numpy() <= self.longest)
        kept = np.sort(short[np.argsort(-self.seen[short], kind="stable")[: self.limit // 2]])
        stays = np.zeros(len(self.known), bool)
        stays[kept] = True
        self.ids = self.ids[np.repeat(stays, self.sizes)]
        self.known, self.sizes, self.seen = self.known.filter(pa.array(stays)), self.sizes[kept], self.seen[kept] // 2


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    return kept(("words", path), lambda: WordEncoder(path))


def column_encoder(path: str) -> ColumnEncoder:
    return kept(("columns", path), lambda: ColumnEncoder(path))


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def of_bytes(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most so many bytes of text, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def default_tokenizer() -> str:
    return public_tokenizers.path(WORD_BPE)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of every document, in ascending doc_id order, each file a contiguous range."""
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in of_bytes(batches, ColumnEncoder.PIECE):
            lists = column_encoder(tokenizer).encode(batch.column("text"), end_id)
            ends = lists.offsets.to_numpy()[1:].astype(np.int64)
            sizes = np.diff(ends, prepend=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(np.full(len(ends), part, np.int32)), pa.array(at + ends - sizes), lists],
                ["doc_id", "n_tokens", "part", "part_start", "ids"],
            )
            at += int(ends[-1])

    order = ["doc_id", F.xxhash64("text"), "text"]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(*order[:2])
        .sortWithinPartitions(*order)
        .mapInArrow(encode, TOKEN_SCHEMA)
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.enable.dictionary#part_start", "false")
        .option("parquet.writer.version", "v2")
        .option("compression", "zstd")
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and global start of every document, without reading ids."""
    return with_start(spark.read.schema(TOKEN_SCHEMA).parquet(path).drop("ids"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Every document with its global start and its ids."""
    return with_start(spark.read.schema(TOKEN_SCHEMA).parquet(path))


def with_start(files: DataFrame) -> DataFrame:
    """start: tokens of all documents before; from one total for each file, so the broadcast has a row for each file."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return files.join(F.broadcast(offsets), "part").withColumn("start", F.col("offset") + F.col("part_start")).drop("offset", "part", "part_start")


def ids_crc32(tokens: DataFrame) -> DataFrame:
    """Replace ids by the unsigned CRC32 of their little-endian 32-bit form."""
    keep = [c for c in tokens.columns if c != "ids"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crcs, pa.int64())], [*keep, "ids_crc32"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema if f.name != "ids")
    return tokens.mapInArrow(check, f"{fields}, ids_crc32 long")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return ids_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
