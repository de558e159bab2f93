"""Best-fit packing by patterns and non-negative least squares.

Documents are tokenized and cut into pieces of at most ``capacity`` ids.  Packing then works on the histogram of piece lengths alone, which has at
most ``capacity`` bins whatever the corpus: all patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares (coordinate descent), rounded and held to the counts; the residual histogram is packed by
best fit, longest first, on counts too.  The plan, a bounded list of slot ranges per length, is broadcast; a piece finds its slot by its rank
among the pieces of its length.  Ranks come from counts per (length, chunk), so a length that a third of all pieces share is still ranked in many tasks.

Texts are tokenized in slices: each distinct white-space-delimited chunk of a slice is looked at once, as the tokenizer's pre-tokens never cross white
space and its normalizers act the same on a chunk as on the text around it.  Chunks are cut on into pre-tokens, and the distinct ones of a slice are merged
side by side in numpy; what is unusual (other scripts, very long words) goes to the library.  Nothing is remembered between slices, so a worker's memory is bounded.  Texts with the four separators U+001C-U+001F, which are white space to Arrow and Python but not to the tokenizer, go to the tokenizer whole.

Defined results: a null or empty text is the single id 0 that ends every document; repeated rows are packed as often as they occur; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialize, partitions, require, slices, trim

CAPACITY = 2048
#: Bytes of text that are cut at once; word lengths in bytes that are merged side by side (longer ones go to the tokenizer), and so many at a time.
SLICE = 4_000_000
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 48)
LONGEST = WIDTHS[-1]
BLOCK = 16_384
NO_RANK = 1 << 30
#: Rounds of new patterns, and sweeps of coordinate descent in each.
ROUNDS = 12
SWEEPS = 8
ODD_SPACE = "[\x1c-\x1f]"
MARKS = ".,;:!?"
#: Below U+0250 without U+0130, lower case and composition change no other character.
PLAIN = "^[\x01-\u012f\u0131-\u024f]+$"
#: The tokenizer's pre-tokens.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[first : first + size]``, one after another."""
    after = np.cumsum(size)
    return flat[np.repeat(first - (after - size), size) + np.arange(after[-1] if len(after) else 0)]


class Merges:
    """Ranked merges of many short words at once: each round joins the best pair of every word that still has one."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level BPE writes these bytes as themselves, the others from U+0100 on
        hidden = [b for b in range(256) if b not in shown]
        chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([vocab.get(chars[b], -1) for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab.get(chars[b] + suffix, -1) for b in range(256)], dtype=np.int64)
        pairs = [(vocab[x] << 16 | vocab[y], rank, vocab[x + y]) for rank, (x, y) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
        self.by_rank = self.made[np.argsort(self.ranks)]

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 16 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK).astype(np.int32)

    def block(self, s: np.ndarray) -> np.ndarray:
        """The merged symbols of rows of symbols, each padded with -1 on the right."""
        out, rows = s.copy(), np.arange(len(s))
        r = self.rank(s[:, :-1], s[:, 1:])
        place = np.arange(s.shape[1])
        while len(rows):
            j = r.argmin(axis=1)
            best = r[np.arange(len(rows)), j]
            on = best < NO_RANK
            if not on.all():
                out[rows[~on]] = s[~on]
                rows, s, r, j, best = rows[on], s[on], r[on], j[on], best[on]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            shift = np.minimum(place + (place > j[:, None]), s.shape[1] - 1)
            s, r = np.take_along_axis(s, shift, 1), np.take_along_axis(r, np.minimum(shift, r.shape[1] - 1)[:, :-1], 1)
            s[:, -1], r[:, -1] = -1, NO_RANK
            s[each, j] = self.by_rank[best]
            left, right = np.maximum(j - 1, 0), np.minimum(j + 1, s.shape[1] - 1)
            now = self.rank(s[each, j], np.where(right > j, s[each, right], -1))
            ok = j < r.shape[1]
            r[each[ok], j[ok]] = now[ok]
            before = j > 0
            r[each[before], left[before]] = self.rank(s[each[before], left[before]], s[each[before], j[before]])
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of at most ``LONGEST`` bytes, one word's after another's, and how many each has."""
        length = np.diff(offsets)
        sizes, first, flats, total, low = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64), [], 0, 0
        for width in WIDTHS:
            own = np.flatnonzero((length > low) & (length <= width))
            low = width
            for at in range(0, len(own), BLOCK):
                rows = own[at : at + BLOCK]
                n = length[rows][:, None]
                place = np.arange(width)
                bytes_ = data[np.minimum(offsets[rows][:, None] + place, len(data) - 1)]
                s = np.where(place < n - 1, self.inner[bytes_], np.where(place == n - 1, self.final[bytes_], -1))
                s = self.block(np.hstack([s, np.full((len(rows), 1), -1)]))
                sizes[rows] = k = (s >= 0).sum(axis=1)
                first[rows] = total + np.cumsum(k) - k
                flats.append(s[s >= 0])
                total += len(flats[-1])
        return gathered(np.concatenate(flats) if flats else np.zeros(0, dtype=np.int64), first, sizes).astype("<u4"), sizes


class Encoder:
    """Ids of texts; nothing is kept between slices."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.merges = Merges(path)

    def library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for at in range(0, len(chunks), 4096):  # the library's encodings are large, so few are held at once
            out += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch(chunks[at : at + 4096], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *out]), np.fromiter(map(len, out), dtype=np.int64, count=len(out))

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of pre-tokens in lower case, each distinct one merged once."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary
        long = pc.fill_null(pc.greater(pc.binary_length(distinct), LONGEST), False).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2] or b"", dtype=np.uint8)
        flat, sizes = self.merges.ids(data, offsets)
        if long.any():
            other, n = self.library(distinct.filter(pa.array(long)).to_pylist())
            first = np.cumsum(sizes) - sizes
            sizes[long], first[long] = n, len(flat) + np.cumsum(n) - n
            flat = np.concatenate([flat, other])
            flat = gathered(flat, first, sizes)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return gathered(flat, (np.cumsum(sizes) - sizes)[index], sizes[index]), sizes[index]

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of chunks without white space.  Chunks in plain Latin letters are cut into the tokenizer's own pre-tokens, in lower case;
        most are one word, with or without a mark after it."""
        plain = pc.match_substring_regex(chunks, PLAIN)
        low = pc.if_else(plain, pc.utf8_lower(chunks), "")
        stem = pc.utf8_rtrim(low, MARKS)
        cut = pc.subtract(pc.utf8_length(low), pc.utf8_length(stem))
        simple = pc.and_(pc.match_substring_regex(stem, r"^\pL+$"), pc.less_equal(cut, 1)).to_numpy(zero_copy_only=False)
        plain = plain.to_numpy(zero_copy_only=False) & ~simple
        marked = simple & (cut.to_numpy(zero_copy_only=False) == 1)
        # pre-tokens: a chunk's place in the order, then its own parts
        parts = [PRE_TOKEN.findall(c) for c in low.filter(pa.array(plain)).to_pylist()]
        words = pa.concat_arrays([stem.filter(pa.array(simple)), pc.utf8_slice_codeunits(low.filter(pa.array(marked)), -1), pa.array([x for p in parts for x in p], pa.string())])
        odd = ~simple & ~plain
        where = np.concatenate([np.flatnonzero(simple), np.flatnonzero(marked), np.repeat(np.flatnonzero(plain), [len(p) for p in parts]), np.flatnonzero(odd)])
        flat, sizes = self.words(words)
        other, n = self.library(chunks.filter(pa.array(odd)).to_pylist())
        flat, sizes = np.concatenate([flat, other]), np.concatenate([sizes, n])
        order = np.argsort(where, kind="stable")
        flat = gathered(flat, (np.cumsum(sizes) - sizes)[order], sizes[order])
        return flat, np.bincount(where, weights=sizes, minlength=len(chunks)).astype(np.int64)

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for start, end in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist(), SLICE):
            part = texts.slice(start, end - start)
            if pc.any(pc.match_substring_regex(part, ODD_SPACE)).as_py():
                cut = pa.array([[t] if any("\x1c" <= c <= "\x1f" for c in t) else t.split() for t in part.to_pylist()], type=pa.list_(pa.string()))
            else:
                cut = pc.utf8_split_whitespace(part)
            coded = cut.flatten().dictionary_encode()
            ids, sizes = self.chunks(coded.dictionary)
            index = coded.indices.to_numpy(zero_copy_only=False)
            size = sizes[index]
            ends = np.r_[0, np.cumsum(size)][cut.offsets.to_numpy() - cut.offsets[0].as_py()]
            out = gathered(ids, (np.cumsum(sizes) - sizes)[index], size)
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                yield out[s:e]


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    require(docs, "doc_id", "text")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, rows = [], []
            for at, ids in enumerate(encoder(path).texts(b.column("text"))):
                n = len(ids) + 1
                for p in range(0, n, capacity):
                    x = ids[p : p + capacity]
                    crc = zlib.crc32(x)
                    last = p + capacity >= n
                    who.append(at)
                    rows.append((p // capacity, p, len(x) + last, zlib.crc32(end, crc) if last else crc))
            columns = zip(*rows, strict=True) if rows else [[], [], [], []]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(who, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])
            trim()

    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kinds = StructType([t.schema["doc_id"], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids_crc32", LongType())])
    return t.mapInArrow(run, kinds)


def short_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Patterns of one or two lengths that fill a sequence exactly."""
    out = [(capacity,)] if capacity in counts else []
    return out + [(a, capacity - a) for a in sorted(counts, reverse=True) if a * 2 >= capacity and a < capacity and capacity - a in counts]


def triples(counts: dict[int, int], capacity: int) -> np.ndarray:
    """All patterns of three lengths that fill a sequence exactly, as rows a >= b >= c; at most ``capacity`` squared by 12."""
    known = np.zeros(capacity + 1, dtype=bool)
    known[[k for k in counts if k <= capacity]] = True
    lengths, out = np.flatnonzero(known), [np.zeros((0, 3), dtype=np.int64)]
    for a in lengths[::-1]:
        b = lengths[(lengths <= min(a, capacity - a - 1)) & (2 * lengths >= capacity - a)]
        b = b[known[capacity - a - b]]
        out.append(np.column_stack([np.full(len(b), a), b, capacity - a - b]))
    return np.concatenate(out)


def fitted(counts: dict[int, int], capacity: int) -> dict[tuple[int, ...], float]:
    """Repeat counts x >= 0 that minimize |A x - counts| over all patterns, by coordinate descent.  Columns of A are taken up as they are needed: in every
    round, for each largest length, the triple with the steepest gradient."""
    left = [0.0] * (capacity + 1)
    for k, v in counts.items():
        left[k] = float(v)
    x = dict.fromkeys(short_patterns(counts, capacity), 0.0)
    t = triples(counts, capacity)
    starts = np.flatnonzero(np.r_[True, t[1:, 0] != t[:-1, 0]]) if len(t) else np.zeros(0, dtype=np.int64)
    for _ in range(ROUNDS):
        for _ in range(SWEEPS):
            moved = 0.0
            for q, now in x.items():
                step = max(-now, sum([left[k] for k in q]) / sum([q.count(k) for k in q]))
                if step:
                    x[q] = now + step
                    moved = max(moved, abs(step))
                    for k in q:
                        left[k] -= step
            if moved < 0.25:
                break
        if not len(t):
            break
        g = np.array(left)[t].sum(axis=1)
        steepest = np.maximum.reduceat(g, starts)
        at = np.flatnonzero((g == np.repeat(steepest, np.diff(np.r_[starts, len(g)]))) & (g > 1.5))
        new = [q for q in map(tuple, t[at].tolist()) if q not in x]
        if not new:
            break
        x |= dict.fromkeys(new, 0.0)
    return x


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths): best fit, longest first, for whole groups of equal sequences at once."""
    groups: dict[int, list[list]] = {}  # by free space: [repeats, lengths]
    spaces: list[int] = []
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(space: int, repeats: int, lengths: tuple[int, ...]) -> None:
        if not space:
            done.append((repeats, lengths))
            return
        if space not in groups:
            groups[space] = []
            insort(spaces, space)
        groups[space].append([repeats, lengths])

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                full, rest = divmod(n, fit)
                if full:
                    put(capacity - fit * length, full, (length,) * fit)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                break
            space = spaces[at]
            group = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(at)
            fit = space // length
            full = min(group[0], n // fit)
            n -= full * fit
            rest = min(n, fit) if full < group[0] else 0
            n -= rest
            if full:
                put(space - fit * length, full, group[1] + (length,) * fit)
            if rest:
                put(space - rest * length, 1, group[1] + (length,) * rest)
            if (over := group[0] - full - bool(rest)) > 0:
                put(space, over, group[1])
    return done + [(r, p) for g in groups.values() for r, p in g]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of all sequences: the patterns' counts, rounded to the nearest whole number that the histogram can still serve; then, as a repair, once
    more each pattern that was rounded down and can be served; the residual by best fit."""
    left = {k: v for k, v in counts.items() if v}
    x = fitted(left, capacity)
    out: dict[tuple[int, ...], int] = {}
    for repair in (False, True):
        for q in sorted(x, key=lambda q: -x[q]):
            want = int(x[q] > out.get(q, 0)) if repair else int(x[q] + 0.5)
            n = min(want, *(left[k] // q.count(k) for k in q))
            if n > 0:
                out[q] = out.get(q, 0) + n
                for k in q:
                    left[k] -= n
    return [(n, q) for q, n in out.items()] + best_fit({k: v for k, v in left.items() if v}, capacity)


def slots(planned: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each range of slots, the range's first sequence, and the place in the sequence."""
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for repeats, lengths in planned:
        offset = 0
        for k in lengths:
            ranges.setdefault(k, []).append((used.get(k, 0), sequence, offset))
            used[k] = used.get(k, 0) + repeats
            offset += k
        sequence += repeats
    return {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v, strict=True)) for k, v in ranges.items()}


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    chunks = max(64, partitions(spark))
    cut = pieces(docs, path or tokenizer_path(), capacity).withColumn("chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks)).cast("int"))
    cut = materialize(cut, "pieces")
    per_chunk = cut.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = per_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece")
    ranked = cut.withColumn("place", F.row_number().over(inside) - 1).join(first, ["length", "chunk"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("place")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by_length = table.value
        for b in batches:
            length, rank = b["length"].to_numpy(), b.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(b) else []:
                start, seq, off = by_length[int(length[own[0]])]
                at = np.searchsorted(start, rank[own], side="right") - 1
                sequence[own], offset[own] = seq[at] + rank[own] - start[at], off[at]
            yield b.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, StructType([*ranked.drop("rank").schema, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
