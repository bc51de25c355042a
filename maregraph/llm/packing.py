"""Packing by power-of-two decomposition.

A document's token ids are cut into full sequences and then into pieces whose
lengths are the powers of two in what remains. Every piece is a sequence of its own
length bucket: no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maregraph.llm.common import parts_of, row_chunks

#: Bytes that words (and, apart, runs) kept with their ids may take while a task runs; a full memo starts again before the next chunk.
MEMO_BYTES = 48 << 20
#: Bytes a key takes besides its own and its ids'.
KEY_BYTES = 200
#: Bytes of text that are encoded at once, and of new words.
CHUNK_BYTES, NEW_BYTES = 2 << 20, 1 << 19


class IdMemo:
    """Keys, numbered as they come, with the ids of each in one array."""

    def __init__(self) -> None:
        self.number: dict = {}
        self.flat = np.empty(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)  # of key k, at k + 1
        self.size = 0

    def numbers(self, keys: list) -> np.ndarray:
        """-1 for unknown keys."""
        return np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))

    def add(self, keys: list, ids: np.ndarray, lens: np.ndarray) -> None:
        """New distinct keys, with their ids one after the other."""
        have, end = len(self.number), int(self.ends[len(self.number)])
        while have + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ends[have + 1 : have + 1 + len(keys)] = end + np.cumsum(lens)
        while end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[end : end + len(ids)] = ids
        self.number.update(zip(keys, range(have, have + len(keys)), strict=True))
        self.size += sum(map(len, keys)) + KEY_BYTES * len(keys) + 4 * len(ids)

    @property
    def full(self) -> bool:
        return self.size > MEMO_BYTES

    def read(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys of these numbers, and where each key's end."""
        begin, n = self.ends[k], self.ends[k + 1] - self.ends[k]
        to = np.cumsum(n)
        return self.flat[np.repeat(begin - to + n, n) + np.arange(int(n.sum()))], to


class WordEncoder:
    """Token ids of texts, for a byte-level BPE tokenizer whose pre-tokens never hold white space.

    Each distinct word is encoded once. Words of Latin characters are first cut as the
    pre-tokenizer cuts them, many at a time, and each run is given to the tokenizer's
    BPE model once for all its capitalisations and punctuations; all other words go
    through the whole tokenizer.
    """

    #: What the pre-tokenizer finds in lower-cased PLAIN words: contractions, letter runs, single digits, other runs; and the line end between words.
    PRE_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ž]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ž0-9²³¹¼-¾\n]+|\n")
    #: Latin letters in composed form, without those whose lower case is longer, and no white space or special-token brackets.
    PLAIN = re.compile("[!-;=-~¡-įĲ-ž]+")
    PLAIN_LINES = re.compile("[!-;=-~¡-įĲ-ž\n]+")

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # byte-level models name bytes that print by their character and all others by those from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.forget()

    def _run(self, run: str) -> list[int]:
        text = run if run.isascii() else run.encode().decode("latin-1").translate(self.names)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are all PLAIN, and how many each has."""
        runs = self.PRE_TOKENS.findall("\n".join(words).lower())
        k = self.runs.numbers(runs)
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            unseen = [runs[i] for i in unknown.tolist()]
            new = list(dict.fromkeys(unseen))
            ids = [self._run(r) if r != "\n" else [] for r in new]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            self.runs.add(new, np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum())), lens)
            k[unknown] = self.runs.numbers(unseen)
        ids, to = self.runs.read(k)
        breaks = np.flatnonzero(k == self.runs.number["\n"]) if len(words) > 1 else np.zeros(0, np.int64)
        return ids, np.diff(np.append(to[breaks], len(ids)), prepend=0)

    def _learn(self, new: list[bytes]) -> None:
        if self.runs.full:
            self.runs = IdMemo()
        words = b"\n".join(new).decode().split("\n")
        if self.PLAIN_LINES.fullmatch("\n".join(words)):
            self.words.add(new, *self._plain(words))
            return
        plain = [self.PLAIN.fullmatch(w) is not None for w in words]
        easy = [k for k, p in enumerate(plain) if p]
        if easy:
            self.words.add([new[k] for k in easy], *self._plain([words[k] for k in easy]))
        odd = [k for k, p in enumerate(plain) if not p]
        ids = [self.tokenizer.encode(words[k], add_special_tokens=False).ids for k in odd]
        self.words.add([new[k] for k in odd], np.fromiter(chain.from_iterable(ids), np.uint32, sum(map(len, ids))), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _numbers(self, distinct: pa.Array) -> np.ndarray:
        """The numbers of distinct words, after learning those that are new."""
        if self.words.full:
            self.words = IdMemo()
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.scalar(b"\n"))
        words = joined[0].as_py().split(b"\n")
        k = self.words.numbers(words)
        unknown = np.flatnonzero(k < 0)
        if len(unknown):
            unseen = [words[i] for i in unknown.tolist()]
            sizes = np.cumsum(np.fromiter(map(len, unseen), np.int64, len(unseen)))
            cuts = [0, *np.searchsorted(sizes, np.arange(NEW_BYTES, int(sizes[-1]), NEW_BYTES)).tolist(), len(unseen)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    self._learn(unseen[lo:hi])
            k[unknown] = self.words.numbers(unseen)
        return k

    def forget(self) -> None:
        """Empty memos: a worker that other tasks use next holds the tokenizer alone."""
        self.words, self.runs = IdMemo(), IdMemo()
        pa.default_memory_pool().release_unused()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts (string, nulls as empty) in one array, and where each text's ids end. A long text is read in parts that end at white space."""
        if texts.nbytes > 2 * CHUNK_BYTES:
            ids, ends = [np.zeros(0, np.uint32)], []
            for text in texts:
                for part in parts_of(text.as_buffer(), CHUNK_BYTES) if text.is_valid else ():
                    ids.append(self.encode(pa.array([part], pa.binary()).cast(pa.string()))[0])
                ends.append(len(ids))
            return np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))[ends]
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        per_text = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        numbers = self._numbers(coded.dictionary.cast(pa.binary()))  # before words is read: a full memo is replaced in there
        ids, to = self.words.read(numbers[coded.indices.to_numpy()])
        return ids, np.append(0, to)[np.cumsum(per_text)]


def cut_pieces(totals: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the pieces of documents of these lengths: full pieces of `longest` (a power of two), then the powers of two in the rest, falling."""
    full, powers = totals // longest, 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    in_rest, which = np.nonzero((totals % longest)[:, None] & powers)
    rows = np.concatenate([np.repeat(np.arange(len(totals)), full), in_rest])
    lengths = np.concatenate([np.full(int(full.sum()), longest), powers[which]])
    order = np.argsort(rows, kind="stable")
    rows, lengths = rows[order], lengths[order]
    starts = np.cumsum(lengths) - lengths
    return rows, starts - (np.cumsum(totals) - totals)[rows], lengths


_encoders: dict[str, WordEncoder] = {}


def pack(docs: DataFrame, tokenizer_file: str, end_id: int = 2, longest: int = 4096, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: `id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket[, ids]`.

    Each text (null: empty) is its token ids and `end_id`. A piece is one sequence:
    `length` is a power of two up to `longest`, `offset` is 0, `bucket` its length, by
    which writers partition. An empty text gives one piece that holds `end_id`.
    An empty table gives no rows. Texts of any length are read whole, long ones in parts that end at white space, and
    memos are bounded in bytes, so a worker holds little more than one text and its ids. Repeated rows, and rows with null ids, are packed
    each; of other columns those named in `carry` go along. No shuffle: sequence ids follow from partition and order, which a recomputed scan repeats. The
    tokenizer file must lie at the same path on all machines.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer_file not in _encoders:
            _encoders[tokenizer_file] = WordEncoder(tokenizer_file)
        encoder = _encoders[tokenizer_file]
        for part in chain.from_iterable(row_chunks(batch, 1, CHUNK_BYTES) for batch in batches):
            found, ends = encoder.encode(part.column(1))
            ids = np.insert(found, ends, end_id).astype("<u4")
            totals = np.diff(ends, prepend=0) + 1
            rows, starts, lengths = cut_pieces(totals, longest)
            to, raw = np.cumsum(lengths), memoryview(ids).cast("B")
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(to.tolist(), lengths.tolist(), strict=True)]
            at = pa.array(rows)
            columns = [part.column(0).take(at), *(pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals[rows]))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(ids.view("<i4"))))
                names.append("ids")
            columns += [part.column(2 + k).take(at) for k in range(len(carry))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *carry])
        encoder.forget()

    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []), *(docs.schema[c] for c in carry)])
    out = docs.select(id_col, text_col, *carry).mapInArrow(pieces, schema)
    columns = [id_col, "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket")]
    return out.select(*columns, *(["ids"] if with_ids else []), *carry)


def write_buckets(packed: DataFrame, path: str) -> None:
    """The pieces as Parquet, a folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
