"""Substring dedup by super-k-mer partitioning.

A window is a fixed number of consecutive words. Its minimiser is the five-word run in it with
the smallest hash, the leftmost of equals. Consecutive windows with the same minimiser travel as
one packed string (a super-k-mer) to the bucket of that minimiser, where sorting counts the
windows exactly. Equal windows have equal minimisers at the same place, so they always meet in
one bucket, and never lie in the same super-k-mer.

Each scan task first folds equal super-k-mers. One that comes twice in a task is decided there:
all its windows repeat, its places are marked at once, and one string without a place goes on to
tell the others. So a passage that millions of documents share sends one string per task. Strings
travel in compressed chunks, one per scan task and bucket; a bucket task that gets more than it
may hold parts them by minimiser into temporary files.

A minimiser may be hot: a run of five words that very many different passages hold. Its strings
would all go to one task, so they are cut into single windows, which are dealt by their own hash
instead. Which minimisers are hot is estimated from a hash sample of the rows; that decides only
where windows meet. Every window of every row is counted whatever the sample says.

Defined results: a null text has no words and becomes an empty kept text; a text shorter than the
window keeps all its words; rows that repeat whole count as often as they come; an empty table
gives no rows; other columns pass through, and an output replaces a column that has its name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievegrid.llm.common import all_of, fresh, named, row_marks, slices, word_parts

WINDOW = 35
#: Words in a minimiser.
MINIMISER = 5
#: Bytes of packed strings that a scan task folds before it hands them on.
FOLD_BYTES = 48 << 20
#: Bytes of packed strings that a bucket task holds before it parts them.
BUCKET_BYTES = 192 << 20
#: Parts into which it then parts them.
PARTS = 32
#: One row of so many is sampled for hot minimisers.
HOT_SAMPLE = 64
#: Bytes of packed strings, estimated, from which a minimiser is hot; at least this share of a task's fair part is asked too.
HOT_BYTES, HOT_SHARE = 48 << 20, 0.25
#: Words looked at together; places in such a block fit 20 bits.
BLOCK = 1 << 18

_STRINGS = pa.schema([("minimiser", pa.uint64()), ("m1", pa.int64()), ("m2", pa.int64()), ("start", pa.int64()), ("decided", pa.bool_()), ("words", pa.binary())])
_SPANS = pa.schema([("m1", pa.int64()), ("m2", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def super_kmers(units: list[list[bytes]], window: int = WINDOW, k: int = MINIMISER) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(unit, first word, words, minimiser, packed string) of every run of windows that share a minimiser."""
    words = [w for unit in units for w in unit]
    n, grams = len(words), window - k + 1
    if n < window:
        return
    h = _hashes(words)
    g = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        g = g * _ODD + h[j : n - k + 1 + j]
    # 44 bits of hash above 20 bits of place: the least is the leftmost of equals.
    g = (_mixed(g) & ~np.uint64((1 << 20) - 1)) | np.arange(len(g), dtype=np.uint64)
    low, have = g, 1
    while have * 2 <= grams:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < grams:
        low = np.minimum(low[: n - window + 1], low[grams - have : grams - have + n - window + 1])
    ends = np.cumsum([len(u) for u in units])
    unit_of = np.repeat(np.arange(len(units)), [len(u) for u in units])[: n - window + 1]
    whole = np.arange(n - window + 1) + window <= ends[unit_of]
    first = whole.copy()
    first[1:] &= ~whole[:-1] | (low[1:] != low[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return
    inside = np.cumsum(whole)
    last = np.append(starts[1:], n - window + 1) - 1
    runs = inside[last] - inside[starts] + 1
    places = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=places[1:])
    text = b" ".join(words)
    stops = starts + runs + window - 1
    begins = ends - [len(u) for u in units]
    own = unit_of[starts]
    columns = (own, starts - begins[own], stops - starts, low[starts] >> np.uint64(20), places[starts], places[stops] - 1)
    for unit, at, size, minimiser, a, b in zip(*(c.tolist() for c in columns), strict=True):
        yield unit, at, size, minimiser, text[a:b]


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of the same row that touch or overlap become one."""
    out: list[tuple[int, int, int, int]] = []
    for m1, m2, a, b in sorted(spans):
        if out and out[-1][0] == m1 and out[-1][1] == m2 and a <= out[-1][3]:
            if b > out[-1][3]:
                out[-1] = (m1, m2, out[-1][2], b)
        else:
            out.append((m1, m2, a, b))
    return out


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def _units(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[list[tuple[int, int, int]], list[list[bytes]]]]:
    """Runs of words of rows (m1, m2, text) and their marks, for about BLOCK words at a time."""
    marks, units, words = [], [], 0
    for part in slices(batches, "text"):
        for m1, m2, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            for first, run in word_parts(text or b"", window - 1):
                if len(run) < window:
                    continue
                marks.append((m1, m2, first))
                units.append(run)
                words += len(run)
                if words >= BLOCK:
                    yield marks, units
                    marks, units, words = [], [], 0
    yield marks, units


def hot_minimisers(rows: DataFrame, window: int, buckets: int, sample: int = HOT_SAMPLE, least: int = HOT_BYTES) -> frozenset[int]:
    """Minimisers with more bytes of strings than that and than HOT_SHARE of a bucket's fair part: 4 * buckets at most."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, units in _units(batches, window):
            sizes: dict[int, int] = {}
            for _, _, _, minimiser, packed in super_kmers(units, window):
                sizes[minimiser] = sizes.get(minimiser, 0) + len(packed)
            yield pa.record_batch([pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())], names=["minimiser", "bytes"])

    some = rows.where(F.pmod("m2", F.lit(sample)) == 0).mapInArrow(weigh, "minimiser long, bytes long")
    sized = some.groupBy("minimiser").agg((F.sum("bytes") * sample).alias("bytes")).where(F.col("bytes") >= least)
    if sized.isEmpty():
        return frozenset()
    whole = some.agg(F.sum("bytes") * sample).first()[0]
    return frozenset(r.minimiser for r in sized.where(F.col("bytes") >= HOT_SHARE * whole / buckets).collect())


def _scanner(window: int, buckets: int, fold_bytes: int, hot: frozenset[int]):
    """Rows (m1, m2, text) to rows (bucket, decided spans?, chunk)."""

    def cut(found: Iterator[tuple[int, int, int, int, bytes]]) -> Iterator[tuple[int, int, int, int, bytes]]:
        """The same windows, those of hot minimisers one by one under a hash of their own."""
        for unit, at, size, minimiser, packed in found:
            if minimiser not in hot:
                yield unit, at, size, minimiser, packed
                continue
            words = packed.split(b" ")
            for i in range(len(words) - window + 1):
                one = b" ".join(words[i : i + window])
                yield unit, at + i, window, xxhash.xxh3_64_intdigest(one) >> 1 | 1 << 63, one

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        seen: dict[bytes, int] = {}
        rows: list[list] = []  # minimiser, m1, m2, start, decided
        spans: list[tuple[int, int, int, int]] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            out: list[tuple[int, bool, bytes]] = []
            if rows:
                columns = list(zip(*rows, strict=True))
                whole = pa.record_batch([pa.array(c, f.type) for c, f in zip([*columns, list(seen)], _STRINGS, strict=True)], schema=_STRINGS)
                bucket = whole.column("minimiser").to_numpy() % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                whole, bucket = whole.take(pa.array(order)), bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                out = [(int(bucket[a]), False, _packed(whole.slice(a, b - a))) for a, b in zip(cuts, cuts[1:], strict=False)]
            merged = _merged(spans)
            for i in range(0, len(merged), 100_000):
                part = list(zip(*merged[i : i + 100_000], strict=True))
                out.append(((turn + i) % buckets, True, _packed(pa.record_batch([pa.array(c, pa.int64()) for c in part], schema=_SPANS))))
            for i in range(0, len(out), 200):
                part = list(zip(*out[i : i + 200], strict=True))
                yield pa.record_batch([pa.array(part[0], pa.int32()), pa.array(part[1]), pa.array(part[2], pa.binary())], names=["bucket", "spans", "chunk"])
            seen.clear(), rows.clear(), spans.clear()
            held = 0

        def fold(marks: list[tuple[int, int, int]], units: list[list[bytes]]) -> None:
            nonlocal held
            for unit, at, size, minimiser, packed in cut(super_kmers(units, window)) if hot else super_kmers(units, window):
                m1, m2, first = marks[unit]
                known = seen.get(packed)
                if known is None:
                    seen[packed] = len(rows)
                    rows.append([minimiser, m1, m2, first + at, False])
                    held += len(packed) + 200
                    continue
                row = rows[known]
                if not row[4]:
                    row[4] = True
                    spans.append((row[1], row[2], row[3], row[3] + size))
                spans.append((m1, m2, first + at, first + at + size))
                held += 100

        for marks, units in _units(batches, window):
            fold(marks, units)
            if held > fold_bytes:
                yield from flush()
        yield from flush()

    return scan


def repeated_in(strings: pa.Table, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Spans of windows that also start elsewhere, of super-k-mers that hold all with their minimisers."""
    minimiser = strings.column("minimiser").to_numpy()
    order = np.argsort(minimiser, kind="stable")
    same = minimiser[order][1:] == minimiser[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    if not shared.any():
        return []
    strings = strings.take(pa.array(order[shared]))
    lists = [s.split(b" ") for s in strings.column("words").to_pylist()]
    sizes = np.array([len(x) for x in lists])
    coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
    codes = coded.indices.to_numpy()
    h = _hashes(coded.dictionary.to_pylist())[codes]
    # Hash of words i..i+window-1: a difference of sums of h * odd^i, brought to the same power.
    powers = np.full(len(h) + 1, _ODD)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    back = np.full(len(h) + 1, pow(int(_ODD), -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.cumprod(back, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:-1], out=sums[1:])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    runs = sizes - window + 1
    owner = np.repeat(np.arange(len(sizes)), runs)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + begins[owner]
    hashed = (sums[starts + window] - sums[starts]) * back[starts]
    order = np.argsort(hashed, kind="stable")
    alike = np.flatnonzero(hashed[order][1:] == hashed[order][:-1])
    if not len(alike) and not pc.any(strings.column("decided")).as_py():
        return []
    repeats = np.zeros(len(order), bool)
    odd_one: set[int] = set()
    for i in range(0, len(alike), 50_000):  # hashes only propose: the words decide
        at = alike[i : i + 50_000]
        a, b = starts[order[at]], starts[order[at + 1]]
        equal = np.ones(len(at), bool)
        for j in range(window):
            equal &= codes[a + j] == codes[b + j]
        repeats[order[at[equal]]] = True
        repeats[order[at[equal] + 1]] = True
        odd_one.update(hashed[order[at[~equal]]].tolist())
    for value in odd_one:  # different windows of one hash: compare all of them
        seen: dict[tuple, list[int]] = {}
        for w in np.flatnonzero(hashed == np.uint64(value)).tolist():
            seen.setdefault(tuple(codes[starts[w] : starts[w] + window].tolist()), []).append(w)
        for places in seen.values():
            repeats[places] = len(places) > 1
    decided = strings.column("decided").to_numpy()
    repeats &= ~decided[owner]  # their places are marked already
    hits = np.flatnonzero(repeats)
    if not len(hits):
        return []
    own = owner[hits]
    at = starts[hits] - begins[own] + strings.column("start").to_numpy()[own]
    cut = np.flatnonzero((np.diff(hits) != 1) | (np.diff(own) != 0)) + 1
    heads, tails = np.append(0, cut), np.append(cut, len(hits)) - 1
    m1, m2 = (strings.column(c).to_numpy()[own[heads]].tolist() for c in ("m1", "m2"))
    return list(zip(m1, m2, at[heads].tolist(), (at[tails] + window).tolist(), strict=True))


class _Held:
    """Super-k-mers of one bucket task; beyond a number of bytes they part into temporary files by minimiser."""

    def __init__(self, most: int):
        self.most, self.bytes, self.tables, self.files = most, 0, [], []

    def add(self, strings: pa.Table) -> None:
        self.tables.append(strings)
        self.bytes += strings.nbytes
        if self.bytes > self.most:
            self._part()

    def _part(self) -> None:
        if not self.files:
            self.files = [tempfile.TemporaryFile() for _ in range(PARTS)]
            self.writers = [pa.ipc.new_stream(f, _STRINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) for f in self.files]
        whole = pa.concat_tables(self.tables)
        part = ((whole.column("minimiser").to_numpy() * _ODD) >> np.uint64(32)) % np.uint64(PARTS)
        for i, writer in enumerate(self.writers):
            writer.write_table(whole.filter(pa.array(part == i)))
        self.tables, self.bytes = [], 0

    def __iter__(self) -> Iterator[pa.Table]:
        if not self.files:
            if self.tables:
                yield pa.concat_tables(self.tables)
            return
        if self.tables:
            self._part()
        for writer, file in zip(self.writers, self.files, strict=True):
            writer.close()
            file.seek(0)
            yield pa.ipc.open_stream(file).read_all()
            file.close()


def _counter(window: int, most: int):
    """Chunks of a bucket to spans (m1, m2, start, stop)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(most)
        for batch in batches:
            for is_spans, chunk in zip(batch.column("spans").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if is_spans:
                    yield from _unpacked(chunk).to_batches()
                else:
                    held.add(_unpacked(chunk))
        for strings in held:
            spans = _merged(repeated_in(strings, window))
            for i in range(0, len(spans), 50_000):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*spans[i : i + 50_000], strict=True)], schema=_SPANS)

    return count


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None, fold_bytes: int = FOLD_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_sample: int = HOT_SAMPLE, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """(m1, m2, spans): for rows by their marks, spans of words covered by windows that also start elsewhere.

    buckets: tasks that count, by default as many as Spark's shuffle partitions.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m1, m2 = row_marks(id_col, text_col)
    rows = df.select(m1.alias("m1"), m2.alias("m2"), named(text_col).cast("binary").alias("text"))
    hot = hot_minimisers(rows, window, buckets, hot_sample, hot_bytes)
    chunks = rows.mapInArrow(_scanner(window, buckets, fold_bytes, hot), "bucket int, spans boolean, chunk binary")
    spans = chunks.repartitionById(buckets, "bucket").mapInArrow(_counter(window, bucket_bytes), "m1 long, m2 long, start long, stop long")
    return spans.distinct().groupBy("m1", "m2").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _cut(text: bytes, spans: list[dict]) -> tuple[int, bytes, list[tuple[int, int]]]:
    """Words of a text, what is left of it without the spans, and the merged spans."""
    merged = [(a, b) for _, _, a, b in _merged([(0, 0, s["start"], s["stop"]) for s in spans])]
    n, kept, at = 0, [], 0
    for first, words in word_parts(text):
        end = first + len(words)
        begin = first
        while at < len(merged) and merged[at][0] < end:
            a, b = merged[at]
            if a > begin:
                kept.append(b" ".join(words[begin - first : a - first]))
            begin = max(begin, min(b, end))
            if b > end:
                break
            at += 1
        if begin < end:
            kept.append(b" ".join(words[begin - first :]))
        n = end
    return n, b" ".join(kept), merged


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, kept_col: str = "kept_text", spans_col: str = "removed_spans", words_col: str = "n_words", **sizes: int) -> DataFrame:
    """df with its texts' kept words, the spans of words removed, and the words there were."""
    found = repeated_spans(df, id_col, text_col, window, **sizes)
    df = df.drop(*({kept_col, spans_col, words_col} - {text_col, id_col}))
    a, b, s, t = (fresh(df, x) for x in ("m1", "m2", "spans", "words_in"))
    m1, m2 = row_marks(id_col, text_col)
    found = found.select(F.col("m1").alias(a), F.col("m2").alias(b), F.col("spans").alias(s))
    joined = df.withColumns({a: m1, b: m2}).join(found, [a, b], "left").select(*all_of(df), F.col(s), named(text_col).cast("binary").alias(t))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, t):
            got = [_cut(text or b"", spans or []) for text, spans in zip(part.column(t).to_pylist(), part.column(s).to_pylist(), strict=True)]
            more = [
                pa.array([g[0] for g in got], pa.int64()),
                pa.array([g[1].decode() for g in got], pa.string()),
                pa.array([[{"start": x, "stop": y} for x, y in g[2]] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], *more], names=[*part.schema.names[:-2], words_col, kept_col, spans_col])

    out = [T.StructField(words_col, T.LongType()), T.StructField(kept_col, T.StringType()), T.StructField(spans_col, T._parse_datatype_string("array<struct<start:bigint,stop:bigint>>"))]
    return joined.mapInArrow(cut, T.StructType([*df.schema.fields, *out]))
