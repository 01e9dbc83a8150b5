"""Exact dedup with Patricia-trie owners.

Every text, without its white space, goes as a full byte string into a compressed radix trie.
Each scan task first folds its own copies in a trie of its own, so a group of copies sends one
string per task whatever its size. The strings then meet in partitions by length and content
hash, where a second trie finds the owner of each class. Members reach their owner through the
string their own task sent, so no join key holds more rows than one task reads.

Defined results: a null text counts as empty; all empty texts are equal; null ids come last
among equals; of rows that agree in id and length one is kept; an empty table gives no rows;
only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import all_of, fresh, materialise, named, row_marks
from sievegrid.llm.radix import PatriciaTrie

#: Bytes of distinct text a task holds before it spills or hands on what it has folded.
TRIE_BYTES = 64 << 20
#: What a row counts besides its text, so that many empty or short texts are bounded as well.
ROW_BYTES = 400
_FOLDED = [("id", None), ("row", "long"), ("stand", "long"), ("mark", "long"), ("mark2", "long"), ("body", "binary"), ("best_chars", "long"), ("best_id", None), ("best_row", "long"), ("n", "long")]
_DROP = b" \t\n\x0b\x0c\r"


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (n_chars, doc_id, row): more code points, then the smaller id, nulls last, then the earlier row."""
    rank = lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0, x[2])
    return a if rank(a) <= rank(b) else b


def _merge(a: list, b: list) -> list:
    a[0] = _better(a[0], b[0])
    a[1] += b[1]
    a[2].extend(b[2])
    return a


def _folder(budget: int):
    """Rows (id, text, n_chars, mark, mark2) to rows that name the row standing for them; that row also carries the string."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        names = [n for n, _ in _FOLDED]
        trie, rows, held, schema = PatriciaTrie(_merge, 1 << 62), [], 0, None

        def emit() -> Iterator[pa.RecordBatch]:
            stands, full = {}, {}
            for key, (best, count, members) in trie.drain():
                lead = min(members)
                for m in members:
                    stands[m] = lead
                full[lead] = (key, best, count)
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                got = [full.get(x[1], (None, (None, None, None), None)) for x in part]
                yield pa.record_batch(
                    [
                        pa.array([x[0] for x in part], schema.field(0).type),
                        pa.array([x[1] for x in part], pa.int64()),
                        pa.array([stands[x[1]] for x in part], pa.int64()),
                        pa.array([x[2] for x in part], pa.int64()),
                        pa.array([x[3] for x in part], pa.int64()),
                        pa.array([g[0] for g in got], pa.binary()),
                        pa.array([g[1][0] for g in got], pa.int64()),
                        pa.array([g[1][1] for g in got], schema.field(0).type),
                        pa.array([g[1][2] for g in got], pa.int64()),
                        pa.array([g[2] for g in got], pa.int64()),
                    ],
                    names=names,
                )

        for batch in batches:
            schema = batch.schema
            for id_, text, chars, mark, mark2 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (text or b"").translate(None, _DROP)
                trie.put(body, [(chars, id_, row), 1, [row]])
                rows.append((id_, row, mark, mark2))
                held += len(body) + ROW_BYTES
                row += 1
                if held > budget:
                    yield from emit()
                    trie, rows, held = PatriciaTrie(_merge, 1 << 62), [], 0
        if rows:
            yield from emit()

    return fold


def _owners(budget: int):
    """Strings that tasks sent to the owner of each: (stand, keep_id, keep_row, group_size, text_sha256)."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, id_type = PatriciaTrie(_merge, budget), None
        for batch in batches:
            id_type = batch.schema.field("best_id").type
            for stand, body, chars, id_, row, n in zip(*(batch.column(c).to_pylist() for c in ("stand", "body", "best_chars", "best_id", "best_row", "n")), strict=True):
                trie.put(body, [(chars, id_, row), n, [stand]])
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.string()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["stand", "keep_id", "keep_row", "group_size", "text_sha256"])

        for key, (best, count, members) in trie.drain():
            sha = hashlib.sha256(key).hexdigest()
            out.extend((m, best[1], best[2], count, sha) for m in members)
            if len(out) >= 5000:
                yield pack()
                out = []
        if out:
            yield pack()

    return own


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256, and the marks that tell the row again."""
    kind = df.schema[id_col].dataType.simpleString()
    mark, mark2 = row_marks(id_col, text_col)
    rows = df.select(
        named(id_col).alias("id"),
        F.encode(named(text_col), "UTF-8").alias("text"),
        F.coalesce(F.length(named(text_col)), F.lit(0)).cast("long").alias("n_chars"),
        mark.alias("mark"),
        mark2.alias("mark2"),
    )
    folded = materialise(rows.mapInArrow(_folder(trie_bytes), ", ".join(f"{n} {t or kind}" for n, t in _FOLDED)), "exact-folded")
    sent = folded.where(F.col("body").isNotNull()).select("stand", "body", "best_chars", "best_id", "best_row", "n")
    dealt = sent.repartition(F.octet_length("body"), F.xxhash64("body"))
    owners = dealt.mapInArrow(_owners(trie_bytes), f"stand long, keep_id {kind}, keep_row long, group_size long, text_sha256 string")
    return (
        folded.select("id", "row", "stand", "mark", "mark2")
        .join(owners, "stand")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "mark", "mark2")
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that own their text, with all columns of df."""
    mark, mark2 = row_marks(id_col, text_col)
    a, b = fresh(df, "mark"), fresh(df, "mark2")
    kept = exact_classes(df, id_col, text_col).where("kept").select(F.col("mark").alias(a), F.col("mark2").alias(b))
    stays = df.withColumns({a: mark, b: mark2}).join(kept, [a, b], "left_semi")
    # Rows that repeat whole (same id, same text) match alike: one of them stays.
    return stays.dropDuplicates([a, b]).select(*all_of(df))
