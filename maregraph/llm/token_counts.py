"""Token counts: greedy longest-match word pieces counted by a linear-time automaton.

The vocabulary is a trie. Every node keeps a failure link and how many pieces are
complete when the link is taken (its popped pieces), so one pass over a word gives
the number of pieces and no piece is ever built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from maregraph.llm.common import parts_of, row_chunks

#: Words of at most KEPT bytes are kept with their counts in each Python worker, some 50 MB of them; the memo starts again when full.
MEMO_WORDS, KEPT = 300_000, 48
#: Bytes of a text that are counted at once.
PART_BYTES = 1 << 20


class Automaton:
    """Longest-match counting over `pieces`; a word is read after `start` (the mark of a word's first piece)."""

    def __init__(self, pieces: Iterable[str], start: str = "") -> None:
        self.start = start
        self.child: list[dict[str, int]] = [{}]
        ends: set[int] = set()
        for piece in pieces:
            at = 0
            for c in piece:
                to = self.child[at].get(c)
                if to is None:
                    to = self.child[at][c] = len(self.child)
                    self.child.append({})
                at = to
            if at:
                ends.add(at)
        self.fail = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        level = [(0, c, v) for c, v in self.child[0].items()]
        while level:
            for u, c, v in level:
                if v in ends:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[u], self.popped[u]
                    while z >= 0 and c not in self.child[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.child[z][c], n
            level = [(v, c, w) for _, _, v in level for c, w in self.child[v].items()]

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if longest match comes to a character that begins no piece."""
        child, fail, popped = self.child, self.fail, self.popped
        u = n = 0
        for c in self.start + word:
            while (v := child[u].get(c)) is None:
                if fail[u] < 0:
                    return -1
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            if fail[u] < 0:
                return -1
            n += popped[u]
            u = fail[u]
        return n


def sentencepiece_pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model (no control, unknown or byte pieces)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_built: dict[tuple[str, int], tuple[Automaton, dict[bytes, int]]] = {}


def token_counts(docs: DataFrame, pieces: list[str], start: str = "▁", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows `id, n_words, n_tokens, n_unknown` (long), one for each row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`. A word that longest match can't cover is one
    unknown token, counted in both columns. Null and empty texts have zeros; an empty
    table gives no rows; texts are read whole, in parts that end at white space, a long
    word in time in proportion to its length. Other columns of docs are ignored; repeated rows, and rows with null ids, are
    each counted. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = (start, hash(tuple(pieces)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shared.value, start), {}
        automaton, memo = _built[key]
        for batch in batches:
            for part in row_chunks(batch, 1):
                rows = []
                for text in part.column(1):
                    n_words = n_tokens = n_unknown = 0
                    for piece in parts_of(text.as_buffer(), PART_BYTES) if text.is_valid else ():
                        words = piece.split()
                        got = list(map(memo.get, words))
                        if None in got:
                            found = {w: automaton.count(w.decode()) for w in {w for w, n in zip(words, got, strict=True) if n is None}}
                            got = [found[w] if n is None else n for w, n in zip(words, got, strict=True)]
                            memo.update((w, n) for w, n in found.items() if len(w) <= KEPT)
                            if len(memo) > MEMO_WORDS:
                                memo.clear()
                        bad = got.count(-1)
                        n_words, n_tokens, n_unknown = n_words + len(words), n_tokens + sum(got) + 2 * bad, n_unknown + bad
                    rows.append((n_words, n_tokens, n_unknown))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], [id_col, "n_words", "n_tokens", "n_unknown"])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown"))])
    return docs.select(id_col, text_col).mapInArrow(counts, schema)
