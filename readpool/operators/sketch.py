"""Grams, MinHash sketches and gram sets of reads."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from readpool.config import ClusterConfig
from readpool.functions.sequences import LETTERS, qgrams

cloudpickle.register_pickle_by_value(sys.modules["readpool"])  # executors need no installed copy
CHUNK_LETTERS, CHUNK_CELLS = 1 << 20, 1 << 23  # letters, and reads times gram codes, that a task holds at once
FIRST = 64  # places of a permutation that are looked through for all reads alike


def with_grams(reads: DataFrame, config: ClusterConfig) -> DataFrame:
    """`reads` with grams array<int>, dealt by read_id: reads are small, what follows is not, and a few input files would else
    be a few tasks. Grouping and joining by read_id need no further shuffle."""
    return dealt(reads).withColumn("grams", qgrams("seq", config.q))


def dealt(reads: DataFrame) -> DataFrame:
    return reads.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read_id")


class Sketcher:
    """Sketches of many reads at once, in arrays."""

    def __init__(self, config: ClusterConfig):
        self.q, self.n = config.q, 1 << config.code_bits
        code, mask, bits = np.arange(self.n, dtype=np.int64), self.n - 1, config.code_bits
        self.value, self.order = [], []
        for a, b, c in config.permutations():  # as `permuted`
            x = (code * a + b) & mask
            x = (x ^ (x >> bits // 2)) * c & mask
            x ^= x >> max(1, bits // 2 - 1)
            self.value.append(x.astype(np.int32))
            self.order.append(np.argsort(x)[:FIRST])  # a bijection, so the code at place i has the value i
        self.letter = np.full(256, -1, np.int64)
        self.letter[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))

    def least(self, present: np.ndarray) -> np.ndarray:
        """For each read, of which `present` tells the codes that it has, the least value of each permutation."""
        out = np.empty((len(present), len(self.order)), np.int32)
        for p, (value, order) in enumerate(zip(self.value, self.order, strict=True)):
            first = present[:, order]
            out[:, p] = first.argmax(axis=1)
            late = np.flatnonzero(~first.any(axis=1))
            if len(late):
                read, code = np.nonzero(present[late])
                out[late, p] = np.minimum.reduceat(value[code], np.searchsorted(read, np.arange(len(late))))
        return out

    def sketch(self, letters: np.ndarray, starts: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sig, n_bag, bits) of n reads. The letters of a row go from its place in `starts` to the next; a read, which has one
        gram at least, has one row or several."""
        value, size = self.letter[letters], np.diff(starts)
        total = len(value) - self.q + 1
        code = sum((value[p : p + total] * 4**p for p in range(self.q)), np.zeros(max(total, 0), np.int64))
        row = np.repeat(np.arange(len(size)), size)
        inside = row[: len(code)] == row[self.q - 1 :]  # not across rows
        code, read = code[inside], owner[row[: len(inside)][inside]]
        present = np.zeros((n, self.n), bool)
        other = code < 0  # of letters not among LETTERS
        present[read[~other], code[~other]] = True
        packed = np.zeros((n, max(8, self.n // 8)), np.uint8)
        packed[:, : -(-self.n // 8)] = np.packbits(present, axis=1, bitorder="little")
        present[read[other], code[other] & (self.n - 1)] = True
        return self.least(present), np.bincount(read, minlength=n).astype(np.int32), packed.view("<i8")


def sketches(reads: DataFrame, config: ClusterConfig) -> DataFrame:
    """(read_id, sig array<int>, n_bag int, bits array<bigint>): for each of m permutations the least permuted gram code; the
    number of grams; and the set of their codes, 64 to a number, which is far smaller than the grams themselves. Rows of one
    id are one read; reads without a gram are left out.

    Made in numpy on executors: as rows of grams they took about a hundred times the CPU time.
    """
    names = ["read_id", "sig", "n_bag", "bits"]

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def run(batches):
        sketcher = Sketcher(config)

        def made(ids: pa.Array, seqs: pa.Array, same: np.ndarray) -> pa.RecordBatch:
            """Of rows of whole reads; same: whether a row's id is that of the row before."""
            text = b"".join(s.encode() for s in seqs.to_pylist())
            size = np.asarray(pc.binary_length(seqs))
            owner = np.cumsum(~same) - 1
            sig, bag, bits = sketcher.sketch(np.frombuffer(text, np.uint8), np.append(0, np.cumsum(size)), owner, int(owner[-1]) + 1)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.flatnonzero(~same))), lists(sig), pa.array(bag), lists(bits)], names)

        def stretches(table: pa.Table, last: bool):
            """Batches of what `table` holds, and its last read, which may go on, unless it is the last of all."""
            ids, seqs = table.column(0).combine_chunks(), table.column(1).combine_chunks()
            code = ids.dictionary_encode("encode").indices.to_numpy()
            same = np.append(False, code[1:] == code[:-1])
            begins = np.append(np.flatnonzero(~same), len(ids))
            letters, a, most = np.append(0, np.cumsum(np.asarray(pc.binary_length(seqs), np.int64))), 0, max(1, CHUNK_CELLS // sketcher.n)
            reads_ = len(begins) - 1 if last else len(begins) - 2
            while a < reads_:
                b = min(reads_, a + most, max(a + 1, int(np.searchsorted(letters[begins], letters[begins[a]] + CHUNK_LETTERS, side="right")) - 1))
                at, to = int(begins[a]), int(begins[b])
                own = same[at:to].copy()
                yield made(ids.slice(at, to - at), seqs.slice(at, to - at), own)
                a = b
            return table.slice(int(begins[reads_]))

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            if table.num_rows:
                held = yield from stretches(table, False)
        if held is not None and held.num_rows:
            yield from stretches(held, True)

    kind = reads.schema["read_id"].dataType
    schema = T.StructType([T.StructField("read_id", kind), T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("n_bag", T.IntegerType()), T.StructField("bits", T.ArrayType(T.LongType()))])
    grams = reads.select("read_id", "seq").filter(f"length(seq) >= {config.q}")
    return dealt(grams).sortWithinPartitions("read_id").mapInArrow(run, schema)
