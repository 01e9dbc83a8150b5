"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become token ids inside scan tasks; only (id, piece, start, length, checksum) rows
travel on. Those are dealt evenly to packing tasks whose number follows the tokens and the
pieces counted, so a task's memory is bounded at any input size. Each task packs its pieces by
large-item matching: a piece above a third of the capacity can share a sequence with one other
such piece at most, so large pieces are paired greedily (each with the largest partner that
fits) and the smaller ones, longest first, go to the tightest gap. Sequences that stay too
empty are opened again and packed together in a second, smaller round.

Defined results: a null or empty text is a document of the end token alone; only documents
longer than the capacity are cut; repeated rows are packed as often as they come; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import materialise, named, slices, word_parts

CAPACITY = 4096
END_ID = 1
#: What one packing task gets, of tokens and of pieces.
TASK_TOKENS, TASK_PIECES = 1 << 20, 1 << 17
#: A sequence with more free places than this is opened again for the second round.
OPEN_GAP = 64
#: Second-round tasks: one for so many of the first round.
MERGE = 32
#: Words and parts of words whose ids a Python worker remembers, of each kind.
REMEMBERED = 800_000
#: Parts encoded in one call: short enough for the tokenizer's own cost to stay linear.
TOGETHER = 2000

# Between an ASCII letter and ASCII punctuation (but the apostrophe) this tokenizer always parts.
_PARTS = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[a-z])")


class WordIds:
    """Token ids of texts by way of their words, which repeat far more often than texts.

    Holds for tokenizers that lower-case and part at white space and between letters and
    punctuation, as word_bpe_49k does: ids of a text are then the ids of its words in order.
    Added tokens part a text before all else, as they are written (case included).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # added tokens are found in whole texts, not in lower-cased words
        added = {token.content.encode(): i for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile(b"(" + b"|".join(map(re.escape, sorted(added, key=len, reverse=True))) + b")") if added else None
        # A word never begins with a space, so these cannot be taken for words.
        self.added_ids = {b" " + token: struct.pack("<I", i) for token, i in added.items()}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = dict(self.added_ids)
        self.parts: dict[bytes, bytes] = {}

    def _learn(self, words: list[bytes]) -> None:
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        parted = [(w,) if w.isalpha() else _PARTS.split(w) for w in words]
        fresh = {p for parts in parted for p in parts if p not in self.parts}
        letters = {p for p in fresh if p.decode().isalpha()}
        for group in (list(letters), list(fresh - letters)):
            for at in range(0, len(group), TOGETHER):
                self._encode_parts(group[at : at + TOGETHER])
        of = self.parts.__getitem__
        for word, parts in zip(words, parted, strict=True):
            self.words[word] = of(word) if parts == (word,) else b"".join(map(of, parts))

    def _encode_parts(self, parts: list[bytes]) -> None:
        """One call for many parts, a space between them.

        Parts of letters only are one word to the tokenizer, whose last token has the word-end
        mark; of other parts a token belongs to the part in which it starts.
        """
        shown = [p.decode() for p in parts]
        got = self.tokenizer.encode(" ".join(shown), add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        if len(cuts) != len(parts) or not all(map(str.isalpha, shown)):
            cuts = np.searchsorted(np.array([a for a, _ in got.offsets]), np.cumsum([len(p) + 1 for p in shown]))
        cuts, raw = cuts.tolist(), ids.tobytes()
        for part, a, b in zip(parts, [0, *cuts], cuts, strict=False):
            self.parts[part] = raw[4 * a : 4 * b]

    def _words(self, text: bytes) -> list[bytes]:
        """Words of a text in lower case, and between them its added tokens, each after a space."""
        parts = self.added.split(text) if self.added else [text]
        if len(parts) == 1:
            return text.lower().split()  # ASCII only: letters A-Z, the six white-space characters
        words: list[bytes] = []
        for n, part in enumerate(parts):
            words += [b" " + part] if n % 2 else part.lower().split()
        return words

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text; what is remembered grows by the words of these texts at most."""
        if len(self.words) > REMEMBERED:
            self.words = dict(self.added_ids)
        lists = list(map(self._words, texts))
        fresh = [w for w in set().union(*lists) if w not in self.words]
        for at in range(0, len(fresh), REMEMBERED):
            self._learn(fresh[at : at + REMEMBERED])
        of = self.words.__getitem__
        return [b"".join(map(of, words)) for words in lists]


def ids_in(ids_of: WordIds, texts: list[bytes]) -> list[bytes]:
    """The ids of each text; a long text goes part by part."""
    if sum(map(len, texts)) <= 4 << 20:
        return ids_of.encode(texts)
    return [b"".join([ids_of.encode([b" ".join(words)])[0] for _, words in word_parts(t)]) for t in texts]


@lru_cache(2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    kind = df.schema[id_col].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _word_ids(tokenizer)
        for batch in slices(batches, "text", 1 << 20):
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys, rows = part.column(0).to_pylist(), []
                for key, ids in zip(keys, ids_in(ids_of, [t or b"" for t in part.column(1).to_pylist()]), strict=True):
                    ids += end
                    step = capacity * 4
                    for piece, begin in enumerate(range(0, len(ids), step)):
                        own = ids[begin : begin + step]
                        rows.append((key, piece, begin // 4, len(own) // 4, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None))
                columns = list(zip(*rows, strict=True))
                types = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 5 + with_ids
                yield pa.record_batch([pa.array(c, t) for c, t in list(zip(columns, types, strict=True))[:n]], names=names[:n])

    source = df.select(named(id_col).alias("id"), named(text_col).cast("binary").alias("text"))
    return source.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the tokens in each bin, by large-item matching and best fit."""
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    filled: list[int] = []
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free places
    open_gaps = 0  # bit g is set if a bin has g free places

    def put(item: int, bin_: int) -> None:
        bins[item], offsets[item] = bin_, filled[bin_]
        filled[bin_] += sizes[item]

    large: list[list[int]] = [[] for _ in range(capacity + 1)]  # unpaired large items by size
    waiting = 0
    n_large = 0
    for item in order:
        if sizes[item] * 3 <= capacity:
            break
        large[sizes[item]].append(item)
        waiting |= 1 << sizes[item]
        n_large += 1
    while waiting:
        bin_ = len(filled)
        filled.append(0)
        for _ in range(2):
            fits = waiting & (1 << capacity - filled[bin_] + 1) - 1
            if not fits:
                break
            size = fits.bit_length() - 1
            put(large[size].pop(), bin_)
            if not large[size]:
                waiting ^= 1 << size
        gaps[capacity - filled[bin_]].append(bin_)
        open_gaps |= 1 << capacity - filled[bin_]
    for item in order[n_large:]:
        size = sizes[item]
        fits = open_gaps >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps ^= 1 << gap
        else:
            bin_ = len(filled)
            filled.append(0)
        put(item, bin_)
        gap = capacity - filled[bin_]
        gaps[gap].append(bin_)
        open_gaps |= 1 << gap
    return bins, offsets, np.array(filled, np.int64)


def _packer(capacity: int, round_: int, open_gap: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        rows = pa.Table.from_batches(got).combine_chunks()
        bins, offsets, filled = pack_lengths(rows.column("length").to_numpy(), capacity)
        sequence = (round_ << 62) + (TaskContext.get().partitionId() << 32) + bins
        still_open = (capacity - filled > open_gap)[bins]
        for name, values in (("sequence_id", sequence), ("offset", offsets), ("still_open", still_open)):
            rows = rows.append_column(name, pa.array(values))
        yield from rows.to_batches(10_000)

    return pack


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    kind = df.schema[id_col].dataType.simpleString()
    pieces = materialise(token_pieces(df, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    packed_ddl = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, still_open boolean"

    def tasks(rows: DataFrame) -> int:
        tokens, n = rows.agg(F.sum("length"), F.count("*")).first()
        return max(1, -(-(tokens or 0) // TASK_TOKENS), -(-n // TASK_PIECES))

    n = tasks(pieces)
    first = materialise(pieces.repartition(n).mapInArrow(_packer(capacity, 0, OPEN_GAP), packed_ddl), "packed")
    again = first.where("still_open").select("id", "piece", "start", "length", "ids_crc32")
    second = again.repartition(-(-n // MERGE)).mapInArrow(_packer(capacity, 1, capacity), packed_ddl)
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return first.where(~F.col("still_open")).unionByName(second).select(*columns)
