"""Alignment of two tokenizers over the same bytes by sparse token-byte incidence matrices.

A token's row holds the bytes it covers. With A and B in compressed rows (CSR, made here from token lengths), the product
A Bᵀ has an entry for every pair of tokens that share bytes, and its value says how many: the overlap links. Byte offsets where
both sides end a token cut the text into groups; the product of the token-group incidence matrices links all tokens of a
group. Products go row by row as Gustavson has it: row i of the result adds up the rows of Bᵀ that row i of A names.

No token of either side crosses from a non-blank to a space (``CUT``), so texts are cut there, equal pieces of a slice of
documents are encoded and multiplied once (their matrices stacked into one block diagonal) and documents are sums over their pieces.
How often two ids are linked is counted over the whole corpus and brought back to the documents: the commonest pairs
are broadcast, a bounded number, the others are joined.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from marginalia.llm.counts import TOKENIZERS
from marginalia.llm.shared import heavy_threshold
from marginalia.session import Scratch, materialize

BYTE_PAIRS = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "\u2581"
# Before a space after a character that is neither blank for any of the libraries nor the marker.
CUT = re.compile(r"(?= )(?<=[^\s\u180e\u200b\ufeff\u2581])")
# Characters of the documents worked on at a time; one longer document is a slice of its own.
SLICE_CHARS = 3 << 19
# Pieces a tokenizer encodes in one call.
ENCODE = 5_000
# How a pair number ``a * B + b`` is written.
CODE = "<u4"
# Rows whose links are counted or summed together.
ROWS = 1000
# Pairs that are sent to every executor, 24 bytes each.
HEAD_PAIRS = 1_000_000
# Pairs a task counts before it passes the counts on.
TASK_PAIRS = 2_000_000


class Csr(NamedTuple):
    """Rows ``indptr[i]:indptr[i + 1]`` of ``indices`` (columns) and ``values``."""
    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def csr(indptr: np.ndarray, indices: np.ndarray, columns: int) -> Csr:
    return Csr(indptr, indices, np.ones(len(indices), dtype=np.int64), columns)


def covering(lengths: np.ndarray) -> Csr:
    """Token-byte incidence of tokens that lie end to end."""
    indptr = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    return csr(indptr, np.arange(indptr[-1]), int(indptr[-1]))


def belonging(groups: np.ndarray, columns: int) -> Csr:
    """Token-group incidence of tokens that lie in one group each."""
    return csr(np.arange(len(groups) + 1), groups.astype(np.int64), columns)


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    indptr = np.concatenate(([0], np.cumsum(np.bincount(m.indices, minlength=m.columns))))
    return Csr(indptr, m.rows[order], m.values[order], len(m.indptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """A times B: each row's entries are the rows of B it names, scaled and added up by column."""
    width = np.diff(b.indptr)[a.indices]
    before = np.cumsum(width) - width
    at = np.arange(width.sum()) + np.repeat(b.indptr[a.indices] - before, width)
    key = np.repeat(a.rows, width) * b.columns + b.indices[at]
    value = np.repeat(a.values, width) * b.values[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.nonzero(np.diff(key, prepend=-1))[0]
    summed = np.add.reduceat(value, first) if len(first) else value
    key = key[first]
    indptr = np.searchsorted(key, np.arange(len(a.indptr)) * b.columns)
    return Csr(indptr, key % b.columns if b.columns else key, summed, b.columns)


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(c): b for c, b in [*zip(plain, plain), *zip(range(256, 512), rest)]}


class BytePairs:
    """Byte-level BPE. Strings of special tokens in a text are plain text."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(file.decode("utf-8"))
        self.library.encode_special_tokens = True
        byte_of = byte_characters()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


class MarkedPieces:
    """SentencePiece, which puts a marker for a space before a text. The pieces given begin with that space."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_proto=file)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.space = [self.library.piece_to_id(MARK)]

    def encode(self, pieces: list[str]) -> list[list[int]]:
        # The library makes nothing of an empty text, also no marker.
        found = self.library.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if ids else self.space for ids in found]


class Aligned(NamedTuple):
    """What the distinct pieces of a slice come to, an entry a piece; ``links`` has a row per piece of pair numbers ``a * B + b``."""
    right: np.ndarray
    a: np.ndarray
    b: np.ndarray
    groups: np.ndarray
    group_links: np.ndarray
    links: Csr
    written: list[bytes]


class Aligner:
    def __init__(self, a: BytePairs, b: MarkedPieces):
        self.a, self.b = a, b
        self.lengths = [np.array([len(x) for x in side.bytes], dtype=np.int64) for side in (a, b)]
        # An id followed by what may follow it in the written form: another of its side, or the end of its side's list.
        self.more = [np.array([b"%d," % i for i in range(len(side.bytes))], dtype=object) for side in (a, b)]
        self.last = [np.array([b"%d%s" % (i, end) for i in range(len(side.bytes))], dtype=object) for side, end in ((a, b"|"), (b, b";"))]

    def incidences(self, ids: list[np.ndarray]) -> tuple[Csr, Csr, np.ndarray, np.ndarray, int]:
        """The two token-byte matrices of equal byte sequences, the group of each token on both sides, and how many groups there are."""
        cover = [covering(length[i]) for length, i in zip(self.lengths, ids)]
        cut = np.zeros(cover[0].columns + 1, dtype=bool)
        cut[cover[0].indptr] = True
        other = np.zeros(len(cut), dtype=bool)
        other[cover[1].indptr] = True
        group = np.cumsum(cut & other) - 1  # of the byte at each offset
        of = [group[m.indptr[:-1]] for m in cover]
        return cover[0], cover[1], of[0], of[1], int(group[-1]) if len(ids[0]) else 0

    def align(self, pieces: list[str]) -> Aligned:
        found = [[], []]
        for at in range(0, len(pieces), ENCODE):
            part = pieces[at:at + ENCODE]
            for side, encoder in zip(found, (self.a, self.b)):
                side += encoder.encode(part)
        right = self._right(pieces, found)
        if not right.all():
            found = [[x if r else [] for x, r in zip(side, right.tolist())] for side in found]
        n = [np.fromiter(map(len, side), dtype=np.int64, count=len(side)) for side in found]
        ids = [np.fromiter(chain.from_iterable(side), dtype=np.int64, count=int(k.sum())) for side, k in zip(found, n)]
        cover_a, cover_b, of_a, of_b, groups = self.incidences(ids)
        piece_a = np.repeat(np.arange(len(pieces)), n[0])
        linked = product(cover_a, transposed(cover_b))
        per_piece = np.bincount(piece_a[linked.rows], minlength=len(pieces))
        code = ids[0][linked.rows] * len(self.b.bytes) + ids[1][linked.indices]
        links = csr(np.concatenate(([0], np.cumsum(per_piece))), code, len(self.a.bytes) * len(self.b.bytes))
        # Row sizes of the product of the group matrices: as many as the other side has tokens in the group.
        in_group = np.diff(transposed(belonging(of_b, groups)).indptr)
        group_links = np.bincount(piece_a, weights=in_group[of_a], minlength=len(pieces)).astype(np.int64)
        ends_a = np.diff(of_a, append=groups) > 0
        n_groups = np.bincount(piece_a[ends_a], minlength=len(pieces))
        return Aligned(right, n[0], n[1], n_groups, group_links, links, self._written(ids, n, of_a, of_b, groups))

    def _right(self, pieces: list[str], found: list[list[list[int]]]) -> np.ndarray:
        """Whether both sides' tokens spell each piece: all at once, piece by piece only if some do not."""
        held = [p.encode("utf-8", "surrogatepass") for p in pieces]
        right = np.ones(len(pieces), dtype=bool)
        for side, ids in zip((self.a, self.b), found):
            spelt = side.bytes.__getitem__
            size = [sum(map(len, map(spelt, x))) for x in ids]
            if size == list(map(len, held)) and b"".join(map(spelt, chain.from_iterable(ids))) == b"".join(held):
                continue
            right &= np.array([b"".join(map(spelt, x)) == h for x, h in zip(ids, held)], dtype=bool)
        return right

    def _written(self, ids, n, of_a, of_b, groups) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each piece."""
        sides = []
        for s, of in enumerate((of_a, of_b)):
            sides.append(np.where(np.diff(of, append=groups) > 0, self.last[s][ids[s]], self.more[s][ids[s]]))
        order = np.argsort(np.concatenate((2 * of_a, 2 * of_b + 1)), kind="stable")
        flat = np.concatenate(sides)[order].tolist()
        ends = np.cumsum(n[0] + n[1]).tolist()
        return [b"".join(flat[i:j])[:-1] for i, j in zip([0, *ends], ends)]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of the documents of about SLICE_CHARS characters."""
    start = held = 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        held += size
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def dealt(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces, the piece at each place of all texts, and where each text begins. Null and empty texts have none."""
    known: dict[str, int] = {}
    places, ends = [], [0]
    for text in texts:
        if text:
            places += [known.setdefault(p, len(known)) for p in CUT.split(" " + text)]
        ends.append(len(places))
    return list(known), np.array(places, dtype=np.int64), np.array(ends, dtype=np.int64)


def _sums(values: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text the sum of the values of its pieces."""
    run = np.concatenate(([0], np.cumsum(values[at])))
    return run[ends[1:]] - run[ends[:-1]]


def _whole(found: Aligned, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The texts that have tokens: every piece's tokens spell it."""
    return (_sums(~found.right, at, ends) == 0) & (np.diff(ends) > 0)


class Files:
    """The two vocabularies, read on the driver and sent to the executors (some MB, whatever the corpus)."""

    def __init__(self, docs: DataFrame, a: str = BYTE_PAIRS, b: str = PIECES):
        held = []
        for path in (a, b):
            with open(path, "rb") as file:
                held.append(file.read())
        self.held: Broadcast = docs.sparkSession.sparkContext.broadcast(tuple(held))
        sizes = [len(side.bytes) for side in (BytePairs(held[0]), MarkedPieces(held[1]))]
        self.b_ids = sizes[1]
        if sizes[0] * sizes[1] > 1 << 32:
            raise ValueError("pairs of ids do not fit 32 bits")

    def aligner(self) -> Aligner:
        a, b = self.held.value
        return Aligner(BytePairs(a), MarkedPieces(b))


def encoded(docs: DataFrame, files, key: str, kind: str) -> DataFrame:
    """Per row: key, row (its number), sums over the text's pieces, groups_sha256, and links: the pair number of every overlap link, in order."""
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_group_links"]
    schema = f"key {kind}, row bigint, {' bigint, '.join(sums)} bigint, groups binary, links binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = files.aligner()
        for batch in batches:
            for i, j in slices(batch.column(2)):
                pieces, at, ends = dealt(batch.column(2).slice(i, j - i).to_pylist())
                found = aligner.align(pieces)
                whole = _whole(found, at, ends)
                held, spans = at.tolist(), list(zip(ends[:-1].tolist(), ends[1:].tolist(), whole.tolist()))
                groups = [b";".join([found.written[p] for p in held[s:e]]) if w else b"" for s, e, w in spans]
                size = np.diff(found.links.indptr)
                code = found.links.indices.astype(CODE)
                stop = np.cumsum(np.where(np.repeat(whole, np.diff(ends)), size[at], 0))
                used = at[np.repeat(whole, np.diff(ends))]
                links = code[_places(found.links.indptr[used], size[used])]
                cuts = np.concatenate(([0], stop))[ends].tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)]
                    + [pa.array(np.where(whole, _sums(c, at, ends), 0)) for c in (found.a, found.b, found.groups, size, found.group_links)]
                    + [pa.array(groups, pa.binary()), pa.array([links[s:e].tobytes() for s, e in zip(cuts, cuts[1:])], pa.binary())],
                    names=["key", "row", *sums, "groups", "links"])

    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit("")).alias("groups_sha256")
    rows = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(each, schema)
    return rows.select("key", "row", *sums, digest, "links")


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges ``start:start + size``, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def pair_counts(rows: DataFrame, files) -> DataFrame:
    """pair, b, n: how many links of all rows of :func:`encoded` hold each pair of ids."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_b = files.b_ids
        code, n = np.zeros(0, dtype=CODE), np.zeros(0, dtype=np.int64)

        def emitted():
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array((code % n_b).astype(np.int64)), pa.array(n)], names=["pair", "b", "n"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                fresh, times = np.unique(_codes(batch.column(0).slice(start, ROWS))[0], return_counts=True)
                code, at = np.unique(np.concatenate((code, fresh)), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate((n, times)), minlength=len(code)).astype(np.int64)
                if len(code) > TASK_PAIRS:
                    yield emitted()
                    code, n = code[:0], n[:0]
        yield emitted()

    return rows.select("links").mapInArrow(each, "pair bigint, b bigint, n bigint").groupBy("pair", "b").agg(F.sum("n").alias("n"))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pair numbers of some rows, and how many each row has."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), dtype=CODE), np.fromiter(map(len, held), dtype=np.int64, count=len(held)) // np.dtype(CODE).itemsize


def marked_counts(counts: DataFrame) -> DataFrame:
    """``counts`` with best: whether the pair's count is its B id's highest. There are no more B ids than the vocabulary has."""
    highest = counts.groupBy(F.col("b").alias("of_b")).agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), F.col("b") == F.col("of_b")).select("pair", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, key: str = "doc_id", head_pairs: int = HEAD_PAIRS, a: str = BYTE_PAIRS, b: str = PIECES) -> DataFrame:
    """Per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, n_group_links, groups_sha256.

    Texts that are null, empty, or not spelt by the tokens of both sides have no tokens: zeros and an empty digest. Repeated rows count
    each, in the pairs too. Other columns of ``docs`` are not looked at.
    """
    files = Files(docs, a, b)
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)[key]
    spark = docs.sparkSession
    plain = ["n_a", "n_b", "n_groups", "n_links"]
    with Scratch(spark) as scratch:
        # Written once, so a row keeps its number and a text is encoded once.
        rows = scratch.write(encoded(docs, files, key, kind), "links", row_group=16 << 20)
        counts = scratch.write(marked_counts(scratch.write(pair_counts(rows, files), "pairs")), "counts")
        least = heavy_threshold(counts, "n", head_pairs)
        head = counts.filter(F.col("n") >= least).select("pair", "n", "best").toPandas().sort_values("pair")  # at most head_pairs rows
        shared = spark.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("pair", "n", "best")))
        passed = [*plain, "n_group_links", "groups_sha256"]
        types = dict(rows.dtypes)
        schema = f"key {kind}, row bigint, {', '.join(f'{c} {types[c]}' for c in passed)}, n_best bigint, count_sum bigint, rare array<struct<pair: bigint, n: bigint>>"

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, count, best = shared.value
            pair = pair.astype(CODE)
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    code, size = _codes(part.column(part.num_columns - 1))
                    row = np.repeat(np.arange(len(size)), size)
                    at = np.minimum(np.searchsorted(pair, code), max(len(pair) - 1, 0))
                    known = pair[at] == code if len(pair) else np.zeros(len(code), dtype=bool)
                    sums = [np.bincount(row[known], weights=v[at[known]], minlength=len(size)).astype(np.int64) if len(pair) else np.zeros(len(size), np.int64) for v in (best, count)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, sums), _rare(row[~known], code[~known], len(size))],
                                                     names=["key", "row", *passed, "n_best", "count_sum", "rare"])

        summed = rows.select("key", "row", *passed, "links").mapInArrow(each, schema)
        out = summed
        if counts.filter(F.col("n") < least).isEmpty():
            out = materialize(summed.drop("rare"), "aligned")
        else:
            summed = scratch.write(summed, "summed")
            rare = summed.select("row", F.explode("rare").alias("r")).select("row", "r.pair", F.col("r.n").alias("times"))
            added = rare.join(counts.filter(F.col("n") < least).select("pair", "n", "best"), "pair").groupBy("row").agg(
                F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
            total = summed.drop("rare").join(added, "row", "left")
            out = materialize(total.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0)))
                              .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))), "aligned")
    return out.select(F.col("key").alias(key), *plain, "n_best", "count_sum", "groups_sha256", "n_group_links")


def _rare(row: np.ndarray, code: np.ndarray, rows: int) -> pa.Array:
    """Per row its pairs that are not among the broadcast ones, and how often it has each."""
    both, n = np.unique(np.stack([row, code.astype(np.int64)]), axis=1, return_counts=True) if len(row) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    ends = np.concatenate(([0], np.cumsum(np.bincount(both[0], minlength=rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(both[1]), pa.array(n.astype(np.int64))], names=["pair", "n"]))


def token_links(docs: DataFrame, key: str = "doc_id", by_group: bool = False, a: str = BYTE_PAIRS, b: str = PIECES) -> DataFrame:
    """key, a_index, b_index, a_id, b_id, shared: one row per pair of tokens of a row that share bytes, and how many.

    ``by_group`` gives the pairs of the same group instead, with ``shared`` 1. A product is made of some rows at a time.
    """
    files = Files(docs, a, b)
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = files.aligner()
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist()):
                pieces, at, ends = dealt([text])
                if not len(at):
                    continue
                ids = [[x for p in at for x in encoded[p]] for encoded in (aligner.a.encode(pieces), aligner.b.encode(pieces))]
                spelt = [b"".join([side.bytes[x] for x in i]) for side, i in zip((aligner.a, aligner.b), ids)]
                if not spelt[0] == spelt[1] == (" " + text).encode("utf-8", "surrogatepass"):
                    continue
                ids = [np.array(i, dtype=np.int64) for i in ids]
                cover_a, cover_b, of_a, of_b, groups = aligner.incidences(ids)
                left, right = (belonging(of_a, groups), belonging(of_b, groups)) if by_group else (cover_a, cover_b)
                across = transposed(right)
                work = np.cumsum(np.diff(across.indptr)[left.indices])[left.indptr[1:] - 1]
                cuts = [0, *(np.nonzero(np.diff(work // TASK_PAIRS))[0] + 1).tolist(), len(work)]
                for i, j in zip(cuts, cuts[1:]):
                    lo, hi = left.indptr[i], left.indptr[j]
                    found = product(Csr(left.indptr[i:j + 1] - lo, left.indices[lo:hi], left.values[lo:hi], left.columns), across)
                    rows, columns = found.rows + i, found.indices
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(rows), name.type), *map(pa.array, (
                        rows, columns, ids[0][rows], ids[1][columns], found.values))], names=["key", "a_index", "b_index", "a_id", "b_id", "shared"])

    out = docs.select(F.col(key).alias("key"), "text").mapInArrow(each, f"key {kind}, a_index bigint, b_index bigint, a_id bigint, b_id bigint, shared bigint")
    return out.withColumnRenamed("key", key)
