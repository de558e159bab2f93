"""Byte-level BPE encoding and decoding with Spark higher-order functions.

A text is cut into words by the tokenizer's pattern; each distinct word is merged on its own.  A word starts as the array of its bytes' ids; a fold
(``aggregate``) repeats the ranked merge: look up the rank of every neighbouring pair in a literal map, take the least (leftmost on ties), and join that pair,
until no pair has a rank.  The literal map is a perfect hash in two flat arrays, so a lookup costs a few array reads.  Decoding maps
ids to the tokens' bytes and concatenates the pieces.

Words repeat: the most frequent ones (at most ``MAX_KNOWN``, by counts over the whole corpus) are folded and decoded once and broadcast as a table of
bounded size.  Texts are cut where they lie and never shuffled (Arrow batches, the tokenizer's own pattern): runs of known words become their codes,
any other word (nearly all of these occur once) stays a word between them and is folded by the same expression.

Defined results: a null text counts as empty; an empty text has no ids, and both digests are those of no bytes; repeated rows are encoded alike;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

from .common import discard, materialize, require, slices, text_or_empty, trim

#: The tokenizer's pattern for characters below U+0250: letters, numbers, and white space written out.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN_WORD = rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
#: Words known beforehand (some 50 bytes each, in Arrow's layout), and bytes of text that are cut at once.
MAX_KNOWN = 1 << 20
SLICE = 4_000_000
NONE = 1 << 62


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def read_ranks(path: str) -> list[bytes]:
    """Tokens by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


def pair_ranks(tokens: list[bytes]) -> dict[int, int]:
    """left * 65536 + right -> the id of their concatenation."""
    ids = {t: i for i, t in enumerate(tokens) if t}
    return {ids[t[:k]] << 16 | ids[t[k:]]: i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}


def perfect_hash(pairs: dict[int, int]) -> tuple[list[int], list[int], int, int]:
    """(slots, shifts, step, size): the pair ``key`` is at slots[(key % step + shifts[key % len(shifts)]) % size] as key << 16 | rank."""
    size = 1 << max(4, (len(pairs) * 4 // 3).bit_length())
    groups = max(7, len(pairs) // 3) | 1
    for step in (1_000_003, 2_000_003, 3_000_017, 4_000_037, 5_000_011, 6_000_011, 7_000_003, 8_000_009):
        by_group: dict[int, list[int]] = {}
        for key in pairs:
            by_group.setdefault(key % groups, []).append(key)
        slots, shifts = [NONE] * size, [0] * groups
        for g in sorted(by_group, key=lambda g: -len(by_group[g])):
            own = [k % step for k in by_group[g]]
            if len({x % size for x in own}) < len(own):
                break
            shift = next((s for s in range(size) if all(slots[(x + s) % size] == NONE for x in own)), None)
            if shift is None:
                break
            shifts[g] = shift
            for k, x in zip(by_group[g], own, strict=True):
                slots[(x + shift) % size] = k << 16 | pairs[k]
        else:
            return slots, shifts, step, size
    raise ValueError("no perfect hash was found")


class Merger:
    """The expressions of one vocabulary."""

    def __init__(self, path: str | None = None):
        self.tokens = read_ranks(path or ranks_path())
        self.slots, self.shifts, self.step, self.size = perfect_hash(pair_ranks(self.tokens))
        self.byte_ids = [self.tokens.index(bytes([b])) for b in range(256)]

    @staticmethod
    def literal(values, kind: str) -> Column:
        """A flat literal array; the optimizer folds the parsing away."""
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    def ids(self, word: Column) -> Column:
        """The ids of one word: a fold of ranked merges over its bytes' ids."""
        slots, shifts, first = self.literal(self.slots, "bigint"), self.literal(self.shifts, "bigint"), self.literal(self.byte_ids, "bigint")
        chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        start = F.transform(chars, lambda c: F.get(first, F.ascii(c)))

        def rank(a: Column, b: Column) -> Column:
            """Below 65536: the pair's rank; else it has none."""
            key = a * 65536 + b
            at = (key % self.step + F.get(shifts, (key % len(self.shifts)).cast("int"))) % self.size
            return F.get(slots, at.cast("int")).bitwiseXOR(F.shiftleft(key, 16))

        def let(value: Column, body) -> Column:
            return F.get(F.transform(F.array(value), body), F.lit(0))

        def joined(a: Column, p: Column, m: Column) -> Column:
            return let(F.array_position(p, m).cast("int"), lambda k: F.concat(F.slice(a, F.lit(1), k - 1), F.array(m), F.slice(a, k + 2, F.size(a))))

        def step(a: Column, _: Column) -> Column:
            neighbours = F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a)), rank)
            merged = let(neighbours, lambda p: let(F.array_min(p), lambda m: F.when(m >= 65536, a).otherwise(joined(a, p, m))))
            return F.when(F.size(a) < 2, a).otherwise(merged)

        return F.when(F.octet_length(word) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step))

    def coded(self, word: Column) -> Column:
        """i: the word's ids, each as 8 hexadecimal digits, little-endian; d: the hexadecimal bytes that the ids decode to."""
        id_hex = self.literal([i.to_bytes(4, "little").hex() for i in range(len(self.tokens))], "string")
        return F.get(
            F.transform(
                F.array(self.ids(word)),
                lambda ids: F.struct(F.array_join(F.transform(ids, lambda i: F.get(id_hex, i.cast("int"))), "").alias("i"), self.decoded(ids).alias("d")),
            ),
            F.lit(0),
        )

    def decoded(self, ids: Column) -> Column:
        """Hexadecimal bytes of ids: the tokens' pieces, concatenated."""
        pieces = self.literal([t.hex() for t in self.tokens], "string")
        return F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), "")


def cutter(pattern: str):
    """text -> its words.  The tokenizer's own pattern has a quicker twin for texts of characters below U+0250."""
    import public_tokenizers

    general = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return general
    other, plain = re.compile(f"[^\t-\r -~\x85\xa0-\u024f]").search, re.compile(PLAIN_WORD).findall
    return lambda text: general(text) if other(text) else plain(text)


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """w, n: how often each word occurs; counted by slices of texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = cutter(pattern)
        for b in batches:
            for start, end in slices(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).tolist(), SLICE):
                found = pc.value_counts(pa.array([w for t in b.column("text").slice(start, end - start).to_pylist() for w in cut(t)], pa.string()))
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["w", "n"])
            trim()

    return texts.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def known_words(texts: DataFrame, merger: Merger, pattern: str, most: int = MAX_KNOWN) -> pa.Table:
    """At most ``most`` words, the most frequent, with their ids (little-endian, four bytes each) and the bytes that these decode to; all three by Spark expressions."""
    counts = materialize(word_counts(texts, pattern).where("n > 1 and octet_length(w) <= 64").select("w", F.floor(8 * F.log2("n")).cast("int").alias("level")), "words")
    kept, least = 0, None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):  # a few hundred levels at most
        kept += r["count"]
        if kept > most:
            break
        least = r["level"]
    chosen = counts.where(F.lit(False) if least is None else F.col("level") >= least)
    out = chosen.select("w", merger.coded(F.col("w")).alias("c")).select("w", F.unhex("c.i").alias("i"), F.unhex("c.d").alias("d")).toArrow()  # ``most`` rows at most
    discard(counts)
    return out.combine_chunks()


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def column(table: pa.Table, name: str, kind: pa.DataType) -> pa.Array:
    chunks = table.column(name).cast(kind).chunks
    return pa.concat_arrays(chunks) if chunks else pa.array([], kind)


def segmented(texts: pa.Array, cut, known: pa.Table) -> pa.Array:
    """For each text an array of structs: the codes (i) and bytes (d) of a run of known words and the word (w) after it that isn't known; null after the last."""
    found = [cut(t) for t in texts.to_pylist()]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    coded = pa.array([w for ws in found for w in ws], pa.string()).dictionary_encode()
    del found
    place = pc.fill_null(pc.index_in(coded.dictionary, value_set=column(known, "w", pa.string())), -1).to_numpy(zero_copy_only=False)
    place = place[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype=np.int64)
    doc_ends, unknown = np.cumsum(sizes), np.flatnonzero(place < 0)
    # a segment ends at each unknown word and after each text's last word
    order = np.argsort(np.r_[2 * unknown + 1, 2 * doc_ends], kind="stable")
    ends = np.r_[unknown, doc_ends][order]

    def runs(name: str) -> pa.Array:
        c = column(known, name, pa.binary())
        offsets = np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64) if len(c) else np.zeros(1, dtype=np.int64)
        own = place[place >= 0]
        size = np.zeros(len(place), dtype=np.int64)
        size[place >= 0] = k = np.diff(offsets)[own]
        after = np.cumsum(k)
        data = np.frombuffer(c.buffers()[2] or b"", dtype=np.uint8) if len(c) else np.zeros(0, dtype=np.uint8)
        flat = data[np.repeat(offsets[:-1][own] - (after - k), k) + np.arange(after[-1] if len(after) else 0)]
        at = np.r_[0, np.r_[0, np.cumsum(size)][ends]].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(flat)])

    rank = np.where(order < len(unknown), order, -1)
    rest = coded.take(pa.array(unknown)).dictionary_decode() if len(unknown) else pa.array([], pa.string())
    w = rest.take(pa.array(np.maximum(rank, 0), mask=rank < 0))
    each = pa.StructArray.from_arrays([runs("i"), runs("d"), w], ["i", "d", "w"])
    doc = np.searchsorted(doc_ends, unknown, side="right")
    lists = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(sizes)) + 1)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), each)


def segments(texts: DataFrame, known: pa.Table, pattern: str) -> DataFrame:
    """doc_id, s (see :func:`segmented`)."""
    shared = texts.sparkSession.sparkContext.broadcast(packed(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cut = pa.ipc.open_stream(shared.value).read_all(), cutter(pattern)
        for b in batches:
            for start, end in slices(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).tolist(), SLICE):
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), segmented(part.column("text"), cut, table)], ["doc_id", "s"])
            trim()

    each = StructType([StructField("i", BinaryType()), StructField("d", BinaryType()), StructField("w", StringType())])
    return texts.mapInArrow(run, StructType([texts.schema["doc_id"], StructField("s", ArrayType(each))]))


def encode(docs: DataFrame, path: str | None = None, most: int = MAX_KNOWN, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    require(docs, "doc_id", "text")
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    merger = Merger(path)
    t = docs.select("doc_id", text_or_empty().alias("text"))
    t = segments(t, known_words(t, merger, pattern, most), pattern)
    rest = F.transform("s", lambda x: F.struct(x["i"].alias("i"), x["d"].alias("d"), F.when(x["w"].isNotNull(), merger.coded(x["w"])).alias("c")))
    t = t.select("doc_id", rest.alias("s"))
    whole = lambda k: F.array_join(F.transform("s", lambda x: F.concat(F.hex(x[k]), F.coalesce(x["c"][k], F.lit("")))), "")
    t = t.select("doc_id", F.unhex(whole("i")).alias("ids"), F.unhex(whole("d")).alias("decoded"))
    return t.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
