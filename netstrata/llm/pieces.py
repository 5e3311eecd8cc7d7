"""SentencePiece encoding and decoding by shared-prefix dynamic programming.

Texts are cut into marked words, where no piece of the vocabulary can cross. The distinct new words of a batch are sorted,
which puts them in the order of a depth-first walk through their trie, and the forward table of a word starts from what
its common prefix with the word before has left; each trie node is thus scored once.

For unigram models the forward score of a prefix is the best sum of piece scores (Viterbi). For BPE models such sums give
other pieces than the model's own merges, so the forward state is the last piece of the prefix's one valid encoding: the
piece that ends here, and that merging would leave next to the last piece before it. Both read the model file through the
sentencepiece library; results equal its own encoder's, which tests hold them against. Characters out of the vocabulary
become byte pieces, or the unknown piece where a model has none.

Nulls and odd input: null and empty texts have no ids and decode to an empty text. Very long words take time in
proportion to their length and aren't remembered. Repeated rows get equal results. An empty table gives no rows. Other
columns of the input are kept.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keeps_columns, kept, slices, table

PIECE_BPE = "piece_bpe_32k.model"
MARK = "▁"
NEVER = 1 << 60


class Vocabulary:
    """Pieces, ids and ranks of a model file; how to cut texts where no piece crosses."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, self.size, self.unknown = kind, model.vocab_size(), model.unk_id()
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[3:-1], 16): i for i in range(self.size) if model.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.scores.values(), default=0.0)
        merged = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-self.scores[p], self.ids[p]))
        self.rank = {piece: i for i, piece in enumerate(merged)}
        self.suffixes = {piece[i:] for piece in merged for i in range(len(piece))}
        self.cut = self._cutter(merged)
        self.text = [b""] * self.size
        for piece, i in self.ids.items():
            self.text[i] = piece.replace(MARK, " ").encode()
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])

    @staticmethod
    def _cutter(merged: list[str]):
        """Cuts a marked text before marks and signs, where no piece has such a character after another kind."""
        pairs = {(a, b) for piece in merged for a, b in zip(piece, piece[1:], strict=False)}
        if any(b == MARK != a for a, b in pairs):
            return re.compile("(?s).+").findall
        signs = set("\n\t\r.,;:!?%*#$&|()[]{}<>=+/\"'")
        plain = lambda a: a.isascii() and a.isalnum() or a.isalpha()
        while crossed := {b for a, b in pairs if b in signs and a not in signs and plain(a)}:
            signs -= crossed
        own = re.escape("".join(sorted(signs)))
        if not own:
            return re.compile(rf"(?s){MARK}+[^{MARK}]*|[^{MARK}]+").findall
        glue = re.escape("".join(sorted({a for a, b in pairs if b in signs and a not in signs and a != MARK})))
        rest = rf"[^{MARK}{own}]*" + (rf"(?:(?<=[{glue}])[{own}]+[^{MARK}{own}]*)*" if glue else "")
        return re.compile(rf"(?s){MARK}+[{own}]*{rest}|[{own}]+{rest}|[^{MARK}{own}]{rest}").findall

    def spelled(self, piece: str) -> list[int]:
        """Ids of a piece, or of a character that is none."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def decode(self, ids: array) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode(errors="replace").removeprefix(" ")


class BestSums:
    """Forward table of a unigram model: score and last piece's length of every prefix of the current word."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.score, self.length = vocabulary, [0.0], [0]

    def back(self, n: int) -> None:
        del self.score[n + 1 :], self.length[n + 1 :]

    def forward(self, word: str) -> None:
        """Score the prefixes of a word beyond those that are scored."""
        scores, unknown = self.vocabulary.scores, self.vocabulary.least - 10
        for end in range(len(self.score), len(word) + 1):
            best, size = self.score[end - 1] + scores.get(word[end - 1 : end], unknown), 1
            for start in range(max(0, end - self.vocabulary.longest), end - 1):
                own = scores.get(word[start:end])
                if own is not None and self.score[start] + own > best:
                    best, size = self.score[start] + own, end - start
            self.score.append(best)
            self.length.append(size)


class ValidLasts:
    """Forward table of a BPE model: length of the last piece of every prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.length = vocabulary, [0]
        self.halves = {piece: halves for piece in vocabulary.rank if (halves := self._halves(piece))}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last into the piece; None if merging never makes it."""
        rank, parts = self.vocabulary.rank, list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: (rank.get(parts[i] + parts[i + 1], NEVER), i))
            if parts[best] + parts[best + 1] not in rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def beside(self, left: str, right: str) -> bool:
        """Whether merging leaves two pieces apart: undo merges from the last and look for an earlier one across."""
        rank, halves, limit = self.vocabulary.rank, self.halves, NEVER
        while True:
            if rank.get(left + right, NEVER) < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a > b:
                limit, left = a, halves[left][1]
            elif b >= 0:
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def back(self, n: int) -> None:
        del self.length[n + 1 :]

    def forward(self, word: str) -> None:
        halves, pairs, length, suffixes = self.halves, self.pairs, self.length, self.vocabulary.suffixes
        for end in range(len(length), len(word) + 1):
            start = end - 1
            fits = [start]
            while start and word[start - 1 : end] in suffixes:
                start -= 1
                if word[start:end] in halves:
                    fits.append(start)
            for start in reversed(fits):  # one of them fits
                if not start:
                    break
                pair = (word[start - length[start] : start], word[start:end])
                beside = pairs.get(pair)
                if beside is None:
                    if len(pairs) > 2_000_000:
                        pairs.clear()
                    beside = pairs[pair] = self.beside(*pair)
                if beside:
                    break
            length.append(end - start)


class TrieEncoder(dict):
    """Ids of marked words as little-endian unsigned 32-bit integers, and of texts made of them."""

    def __init__(self, path: str, kind: str = "bpe", limit: int = 400_000, longest: int = 64):
        super().__init__()
        self.vocabulary, self.limit, self.longest = Vocabulary(path, kind), limit, longest
        self.forward = BestSums(self.vocabulary) if kind == "unigram" else ValidLasts(self.vocabulary)
        self.spelled: dict[str, list[int]] = {}

    def walk(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Sorted words with their ids."""
        before, table = "", self.forward
        for word in words:
            common = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            table.back(common)
            table.forward(word)
            before, ids, end = word, [], len(word)
            while end:
                start = end - table.length[end]
                piece = word[start:end]
                if (own := self.spelled.get(piece)) is None:
                    own = self.spelled[piece] = self.vocabulary.spelled(piece)[::-1]
                ids += own
                end = start
            yield word, array("I", ids[::-1]).tobytes()
        table.back(0)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = self.vocabulary.cut
        split = [cut(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        if len(self) > self.limit:
            self.clear()
        if len(self.spelled) > self.limit:
            self.spelled.clear()
        new = sorted({word for words in split for word in words if word not in self})
        self.update(self.walk(new))
        out = [b"".join(map(self.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > self.longest:
                del self[word]
        return out


def encoder(path: str, kind: str = "bpe") -> TrieEncoder:
    """One for each Python worker, kept between tasks."""
    return kept(("pieces", path, kind), lambda: TrieEncoder(path, kind))


def default_model() -> str:
    return public_tokenizers.path(PIECE_BPE)


@keeps_columns("_ids")
def encode(docs: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """The input's columns and _ids (array<int>)."""
    model, names = model or default_model(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = encoder(model, kind).encode(batch.column("text").to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in got)])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _ids array<int>")


@keeps_columns("_decoded", reads=("_ids",))
def decode(encoded: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """The input's columns, _ids among them, and _decoded."""
    model, names = model or default_model(), encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vocabulary, lists = encoder(model, kind).vocabulary, batch.column("_ids")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            texts = [vocabulary.decode(values[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "_decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, _decoded string")


def round_trips(docs: DataFrame, model: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, and whether the text decoded from the ids is the text, in one pass."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["n_tokens", "ids_crc32", "decoded_sha256", "lossless"], [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        coder = encoder(model, kind)
        for batch in slices(batches):
            texts, rows = batch.column("text").to_pylist(), []
            for text, ids in zip(texts, coder.encode(texts), strict=True):
                decoded = coder.vocabulary.decode(array("I", ids))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (text or "")))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
