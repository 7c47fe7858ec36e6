"""N-gram Jaccard self-join with set-relation skipping; the result is components, not pairs.

Sets are the distinct shingles of a text, of `words` words each (op 9: 3); a shorter text is one shingle. A word is known by
128 bits of xxh3, and so is a shingle (two lanes of 64). Texts with the same words are one node from the start.

The index lists that a set enters come from a pigeonhole scheme: sets a <= b with Jaccard similarity `percent` / 100 or more
(op 9: 90) differ in at most K * (a + b) shingles, where K = (100 - percent) / (100 + percent), so of m = H + 1 + r parts of
the hash space (H = 2 * u * K, u: the largest size of the size class) r + 1 at least hold the same shingles in both. A list
is a part with its exact content; a set enters the lists of its own class and of the next, as a partner may be one class
larger. The r spare parts pay for lists
that a set may leave: parts of few shingles (SMALL), and then its longest lists, up to r together, such as those of a passage
that many texts share. As lists have one order by length, the shortest of r + 1 common lists is one that both sets stay in, and
sets with no more than r lists that others enter have no partner. If a part is empty and r do not suffice, lists by prefix
filter come in. Keys and labels in lists are cut short; what meets by chance is compared and found unlike.

Answers from similar sets: the pivot of a list is its set that enters most lists of several, which is the least edited of
a group of copies and so the pivot of all lists of the group. It is compared with the other sets of its lists, from their
texts. Sets linked to one pivot have one component. Two sets x, y of a pivot p that are not known as one component differ in
|D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, where D(x) is what x and p do not share; so unless both are linked to p they can
link only if their differences overlap enough. Lists of differences, rarest shingles first, hold only the first positions
that such an overlap must touch, and two sets are skipped if too few positions are left after a common one (`across`). So a
group of copies costs one comparison for each member, no pair of sets that could link is left out, and all links are decided
by intersection of whole sets.

How it is dealt: entries go by buckets of the hash space, whose number comes from the size of the input, and a task holds one
bucket at a time. Lists and pivots with many sets are split (SPLIT), and the pivot's text goes once to each split.

Defined results: null, empty and blank texts have no shingle and link with nothing; repeated rows are documents with equal
sets; rows without an id are left out of components of others (their component is null); ids are 64-bit integers; a text of
any length is one set and is held whole by one task; columns other than the two named play no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readpool.llm import common
from readpool.llm.common import give_back_memory
from readpool.plans.components import connected_components

NO_ID = -(1 << 63)
CHUNK_BYTES = 4_000_000
FLUSH = 1_000_000  # entries that a task holds before it sends them, or 16 a bucket
WORDS, PERCENT = 3, 90
SMALL = {90: (3, 8)}  # by percent: shingles of a part that says little, and spare parts in percent
SMALL_ELSE = (0, 15)
HELD = 4_000_000  # differences that a task holds
SPLIT = 256  # sets of a list or pivot that one task takes

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Shingler:
    """Shingles of many texts at once."""

    TURNS, FACTORS = (0, 17, 39, 8, 51, 29, 60, 21), (3, 5, 7, 11, 13, 17, 19, 23)  # by a word's place in a shingle

    def __init__(self, words: int = WORDS):
        if not 1 <= words <= len(self.TURNS):
            raise ValueError(f"shingles have 1 to {len(self.TURNS)} words")
        self.words = words

    def _hashed(self, words: list[bytes], step: int = 1 << 20) -> np.ndarray:
        """128 bits of each word, as two lanes."""
        some = [np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words[a : a + step])), "<u8") for a in range(0, len(words), step)]
        return np.concatenate([np.zeros(0, np.uint64), *some]).reshape(-1, 2)

    def _joined(self, w: np.ndarray, words: int) -> np.ndarray:
        """One number for each stretch of `words` words, which depends on their order and number."""
        n = len(w) - words + 1
        total = w[:n] * U(self.FACTORS[0]) + U(words)
        for j in range(1, words):
            x, turn = w[j : j + n], self.TURNS[j]
            total = total + (x << U(turn) | x >> U(64 - turn)) * U(self.FACTORS[j])
        return mix(total)

    def sets(self, docs: list[list[bytes]], both: bool = False) -> list:
        """The sorted distinct shingles of each text's words: the first lanes, and with `both` the second ones beside them."""
        flat = [w for d in docs for w in d]
        out, k = [], self.words
        hashed = self._hashed(flat)
        with np.errstate(over="ignore"):
            lanes = [np.ascontiguousarray(hashed[:, i]) for i in range(1 + both)]
            whole = [self._joined(x, k) if len(x) >= k else x[:0] for x in lanes]
            at = 0
            for d in docs:
                n = len(d)
                if n >= k:
                    x = [s[at : at + n - k + 1] for s in whole]
                else:
                    x = [self._joined(s[at : at + n], n) if n else s[:0] for s in lanes]
                at += n
                if both:
                    order = np.lexsort((x[1], x[0]))
                    a, b = x[0][order], x[1][order]
                    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
                    out.append((a[new], b[new]))
                else:
                    a = np.sort(x[0])
                    out.append(a[np.append(True, a[1:] != a[:-1])] if len(a) else a)
        return out


def common_shingles(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray]:
    """(size of the intersection, first lanes of the shingles that only one has)."""
    a, b = np.concatenate((x[0], y[0])), np.concatenate((x[1], y[1]))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])  # distinct within a set, so at most two are equal
    alone = ~(np.append(same, False) | np.append(False, same))
    return int(same.sum()), a[alone]


def size_classes(most: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest size of each class, up to the one after that of `most`."""
    low, high = [1], [1]
    while low[-1] <= most:
        low.append(high[-1] + 1)
        high.append(low[-1] * 100 // percent)
    low.append(high[-1] + 1)
    return np.array(low), np.array([*high, low[-1] * 100 // percent])


def list_keys(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the lists that each set enters, index of the set of each key, which of its two schemes, and for each set and
    scheme how many lists more it may leave, -1 where none). Empty sets enter none."""
    sizes = np.array([len(s) for s in sets], np.int64)
    may_leave = np.full((len(sets), 2), -1, np.int32)
    some = np.flatnonzero(sizes)
    if not len(some):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), may_leave
    tokens = np.concatenate([sets[i] for i in some])
    n = sizes[some]
    low, high = size_classes(int(n.max()), percent)
    small, extra = SMALL.get(percent, SMALL_ELSE)
    own = np.searchsorted(low, n, side="right") - 1
    keys, owner, which = [], [], []
    offsets = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        content = mix(tokens + U(0x1234567))
        for second, scheme in enumerate((own, own + 1)):
            differ = 2 * high[scheme] * (100 - percent) // (100 + percent)
            spare = -(-extra * differ // 100)
            parts = differ + spare + 1
            base = np.cumsum(parts) - parts
            place = mix(tokens ^ np.repeat(mix(scheme.astype(np.uint64)), n)) >> U(33)
            part = (place * np.repeat(parts, n).astype(np.uint64)) >> U(31)
            cell = np.repeat(base, n) + part.astype(np.int64)
            sums = np.zeros(int(parts.sum()), np.uint64)
            np.add.at(sums, cell, content)
            held = np.bincount(cell, minlength=len(sums))
            of = np.repeat(np.arange(len(some)), parts)
            number = np.arange(len(sums)) - base[of]
            key = mix(sums + mix(scheme.astype(np.uint64) * U(1 << 32))[of] + number.astype(np.uint64) * U(0x9E3779B97F4A7C15))
            few = np.bincount(of[held <= small], minlength=len(some))
            poor = few > spare
            may_leave[some, second] = np.where(poor, -1, spare - few)
            enters = (held > small) | (held > 0) & poor[of]
            keys.append(key[enters])
            owner.append(some[of[enters]])
            for i in np.unique(of[(held == 0) & poor[of]]).tolist():
                prefix = tokens[offsets[i] : offsets[i] + n[i] - -(-percent * n[i] // 100) + 1]  # of the sorted hashes
                keys.append(mix(mix(prefix) + U(int(scheme[i]) * 2 + 1)))
                owner.append(np.full(len(prefix), some[i]))
            which.append(np.full(sum(map(len, keys)) - sum(map(len, which)), second))
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(which), may_leave


def word_chunks(texts: pa.Array, size: int = CHUNK_BYTES):
    """(first index, words of each text) of stretches of about `size` bytes; only A-Z are lower-cased."""
    a, n, out = 0, 0, []
    for i in range(len(texts)):
        raw = (texts[i].as_py() or "").encode()
        out.append(raw.lower().split())
        n += len(raw)
        if n >= size or i + 1 == len(texts):
            yield a, out
            a, n, out = i + 1, 0, []


def names_of(docs: list[list[bytes]]) -> np.ndarray:
    """128 bits for the words of each text, 0 for none."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(b" ".join(d)) if d else bytes(16) for d in docs), "<i8").reshape(-1, 2)


ENTRY = 6  # bytes of an entry's set: 47 bits of its name, and which scheme
OWNER = "id long, s long, s2 long, n int, leave0 int, leave1 int"


def indexed(docs: DataFrame, buckets: int, words: int, percent: int) -> DataFrame:
    """(bucket, k, e, owner): packed list entries of a bucket (low 32 bits of keys, sets), or packed documents (OWNER)."""
    names = ["bucket", "k", "e", "owner"]
    bits = buckets.bit_length() - 1

    def run(batches):
        shingler, held, count = Shingler(words), [], 0

        def flush():
            keys, entries = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((entries, keys))
            keys, entries = keys[order], entries[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (entries[1:] != entries[:-1]))
            keys, entries = keys[new], entries[new]
            cuts = np.searchsorted(keys >> U(64 - bits), np.arange(buckets + 1).astype(np.uint64))
            short, packed = (keys << U(bits) >> U(32)).astype("<u4"), np.ascontiguousarray(entries.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ENTRY]
            rows = [(b, short[i:j].tobytes(), packed[i:j].tobytes()) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if i < j]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.nulls(len(rows), pa.binary())], names)

        turn = 0
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            for a, chunk in word_chunks(b.column(1)):
                sets, name = shingler.sets(chunk), names_of(chunk)
                keys, owner, second, leave = list_keys(sets, percent)
                rows = np.empty(len(chunk), [("id", "<i8"), ("s", "<i8"), ("s2", "<i8"), ("n", "<i4"), ("l0", "<i4"), ("l1", "<i4")])
                rows["id"], rows["s"], rows["s2"], rows["n"], rows["l0"], rows["l1"] = ids[a : a + len(chunk)], name[:, 0], name[:, 1], [len(s) for s in sets], leave[:, 0], leave[:, 1]
                turn = (turn * 31 + 17 + len(keys)) % buckets
                yield pa.RecordBatch.from_arrays([pa.array([turn], pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([rows.tobytes()], pa.binary())], names)
                if len(keys):
                    held.append((keys, (name[owner, 0].view(np.uint64) >> U(17) << U(1)) | second.astype(np.uint64)))
                    count += len(keys)
                if count >= max(FLUSH, 16 * buckets):
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()
        give_back_memory()

    return docs.mapInArrow(run, "bucket int, k binary, e binary, owner binary")


def merged(index: DataFrame) -> DataFrame:
    """(k, e, c) of the lists with several sets, c being their number, or the columns OWNER of documents.

    The rows of a bucket come together, and a task holds one bucket."""
    names = ["k", "e", "c", "id", "s", "s2", "n", "leave0", "leave1"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def out(columns: dict, n: int):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def lists(bucket: int, held: list):
        keys = np.concatenate([np.frombuffer(k, "<u4") for k, _ in held])
        packed = np.zeros((len(keys), 8), np.uint8)
        packed[:, :ENTRY] = np.concatenate([np.frombuffer(e, np.uint8).reshape(-1, ENTRY) for _, e in held])
        entries = packed.view("<i8").ravel()
        order = np.lexsort((entries, keys))
        keys, entries = keys[order], entries[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (entries[1:] != entries[:-1]))
        keys, entries = keys[new], entries[new]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(start, len(keys)))
        size = np.repeat(size, size)
        on = size > 1
        return out({"k": keys[on].astype(np.int64) | bucket << 32, "e": entries[on], "c": size[on]}, int(on.sum()))

    def run(batches):
        now, held = -1, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, k, e, owner = (batch.column(j)[i].as_py() for j in range(4))
                if owner is not None:
                    rows = np.frombuffer(owner, [("id", "<i8"), ("s", "<i8"), ("s2", "<i8"), ("n", "<i4"), ("leave0", "<i4"), ("leave1", "<i4")])
                    yield out({c: np.ascontiguousarray(rows[c]) for c in rows.dtype.names}, len(rows))
                    continue
                if bucket != now and held:
                    yield lists(now, held)
                    held = []
                now = bucket
                held.append((k, e))
        if held:
            yield lists(now, held)
        give_back_memory()

    return index.mapInArrow(run, f"k long, e long, c int, {OWNER}")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap over hashed ids that lets all of `ids` pass: some 16 bits an id, up to 16 MiB. Beyond that more rows pass, which
    costs time but changes nothing."""
    n = ids.count()
    bits = min(27, max(16, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    words = ids.select(place.alias("b")).groupBy(F.expr("b >> 6").cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out.view(np.uint64)


def wanted_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, size, z): the compressed words of each node in `wanted` (v, s, s2, id: a document that has them), from the texts."""
    bitmap = id_filter(wanted.select("id"))
    bits = (len(bitmap) * 64).bit_length() - 1
    filter_ = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = docs.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("b"))

    def run(batches):
        for batch in batches:
            b = batch.column(2).to_numpy()
            on = np.flatnonzero((filter_.value[b >> 6] >> (b & 63).astype(np.uint64)) & U(1))
            for _, chunk in word_chunks(batch.column(1).take(pa.array(on))):
                name = names_of(chunk)
                raw = [b" ".join(d) for d in chunk]
                z = [pa.compress(x, "zstd", asbytes=True) if x else b"" for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array(name[:, 0]), pa.array(name[:, 1]), pa.array(map(len, raw), pa.int32()), pa.array(z, pa.binary())], ["s", "s2", "size", "z"])
        give_back_memory()

    found = rows.filter("id IS NOT NULL").mapInArrow(run, "s long, s2 long, size int, z binary")
    nodes = wanted.select("v", F.col("s").alias("s_"), F.col("s2").alias("s2_"))
    return found.join(nodes, (F.col("s") == F.col("s_")) & (F.col("s2") == F.col("s2_"))).select("v", "size", "z").dropDuplicates(["v"])


def compared(pairs: DataFrame, texts: DataFrame, words: int, parts: int, diffs: bool = False) -> DataFrame:
    """(a, b, na, nb, inter) for pairs of nodes: sizes of their sets and of the intersection. With `diffs` also d, how many shingles
    they do not share, diff, those of them that other pairs of a may have too, and ordered: diff has just those, rarest first, in an
    order common to all pairs of a. The pairs of an a come together, in splits of about SPLIT, and its text goes once to each."""
    large = pairs.groupBy(F.col("a").alias("a_")).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > SPLIT).select("a_", F.ceil(F.col("m") / SPLIT).alias("splits"))
    split = F.coalesce(F.pmod(F.xxhash64("b"), F.col("splits")), F.lit(0)).alias("split")
    pairs = pairs.join(large, F.col("a") == F.col("a_"), "left").select("a", "b", split, F.col("splits").isNull().alias("whole"))
    member = pairs.join(texts, F.col("b") == F.col("v")).select("a", "split", "whole", F.lit(1).alias("kind"), "b", "size", "z")
    pivot = pairs.select("a", "split", "whole").distinct().join(texts, F.col("a") == F.col("v")).select("a", "split", "whole", F.lit(0).alias("kind"), F.col("a").alias("b"), "size", "z")
    rows = pivot.unionByName(member).repartition(parts, "a", "split").sortWithinPartitions("a", "split", "kind")
    names = ["a", "b", "na", "nb", "inter"] + ["d", "diff", "ordered"] * diffs
    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 3] + [pa.int32(), pa.list_(pa.int64()), pa.bool_()] * diffs

    def batch_of(out: list):
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    def met(group: list) -> list:
        """The rows of all sets of one pivot, with differences that two of them have, rarest first."""
        token, times = np.unique(np.concatenate([r[-2] for r in group]), return_counts=True)
        out = []
        for r in group:
            n = times[np.searchsorted(token, r[-2])]
            kept, n = r[-2][n > 1], n[n > 1]
            out.append((*r[:-2], kept[np.lexsort((kept, n))], True))
        return out

    def run(batches):
        shingler, pivot, of, group, held = Shingler(words), None, None, [], 0
        for batch in batches:
            size, at = batch.column(5).to_numpy(), 0
            cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // CHUNK_BYTES)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                some = batch.slice(at, to - at)
                docs = [pa.decompress(z.as_py(), n, "zstd", asbytes=True).split(b" ") if n else [] for z, n in zip(some.column(6), size[at:to].tolist(), strict=True)]
                out = []
                for a, whole, kind, b, x in zip(*(some.column(i).to_pylist() for i in (0, 2, 3, 4)), shingler.sets(docs, both=True), strict=True):
                    if kind == 0:
                        if group:
                            out += met(group) if of else group
                        pivot, of, group, held = x, whole, [], 0
                        continue
                    inter, alone = common_shingles(pivot, x)
                    row = (a, b, len(pivot[0]), len(x[0]), inter)
                    if not diffs:
                        out.append(row)
                        continue
                    group.append((*row, len(alone), alone.view(np.int64), False))
                    held += len(alone)
                    if held > HELD:  # too much to hold: all differences of this pivot go out
                        of, out, group, held = False, out + group, [], 0
                yield batch_of(out)
        if group:
            yield batch_of(met(group) if of else group)
        give_back_memory()

    return rows.mapInArrow(run, "a long, b long, na int, nb int, inter int" + ", d int, diff array<long>, ordered boolean" * diffs)


def linked_at(percent: int) -> str:
    return f"100L * inter >= {percent}L * (na + nb - inter)"


def unsettled(known: DataFrame, lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `known` (p, s: labels of a and b) with cb, the component of b, that stand in a list whose sets, but for the
    pivot, are of several components: only there a link may be missing. lists: (k, p, s) of those with two such sets or more."""
    component = groups.select(F.col("node").alias("n_"), "component")
    members = known.join(component, F.col("b") == F.col("n_"), "left").withColumn("cb", F.coalesce("component", "b")).drop("n_", "component")
    of = members.select(F.col("p").alias("p_"), F.col("s").alias("s_"), "cb")
    spread = lists.join(of, (F.col("p") == F.col("p_")) & (F.col("s") == F.col("s_"))).groupBy(F.col("k").alias("k_")).agg(F.min("cb").alias("lo"), F.max("cb").alias("hi")).filter("lo <> hi")
    open_ = lists.join(spread, F.col("k") == F.col("k_"), "left_semi").select(F.col("p").alias("p_"), F.col("s").alias("s_")).distinct()
    return members.join(open_, (F.col("p") == F.col("p_")) & (F.col("s") == F.col("s_")), "left_semi").drop("p", "s")


def across(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Distinct pairs (a, b) of sets with one pivot and different components that may link. members: (a, b, na, nb, inter, d,
    diff, cb), and `ordered` where differences were put in order already, as `compared` does for all sets of a pivot that meet in one task.

    Let T = K * (|x| + |y|) be what linked sets may differ in, d = |D|, and e = K * max(0, |x| - |p|), rounded up. A link
    asks for an overlap c >= (d(x) + d(y) - T) / 2 of the differences, so it touches the first d(x) - c + 1 positions of D(x),
    in any order common to all. If y is not linked to p, that is the first (d(x) - 1 + e) / 2 + 1; and whatever y is, it is
    the first T + 1 at most, as d(x) and d(y) differ by T at most.
    """
    linked, k = linked_at(percent), f"{100 - percent}L / {100 + percent}L"
    half = f"floor((d - 1 + ceil(greatest(0, nb - na) * {k})) / 2) + 1"
    reach = F.expr(f"IF({linked}, {half}, least(d, floor((nb + floor(100L * nb / {percent})) * {k}) + 1))").cast("int")
    ordered = F.col("ordered") if "ordered" in members.columns else F.lit(False).alias("ordered")
    members = members.select("a", "b", "nb", "cb", F.expr(linked).alias("linked"), F.expr(half).cast("int").alias("half"), reach.alias("reach"), "d", "diff", ordered)
    members = common.stored(members)  # else the texts would be compared once for the shingles and once for the sizes
    # Differences in order need no shuffle: the shingles of one set alone, which are left out of diff, stand before them.
    sizes, own = ["nb", "cb", "linked", "half", "d"], F.expr("d - size(diff)")
    placed = members.filter("ordered").select("a", "b", *sizes, own.alias("own"), F.posexplode(F.slice("diff", F.lit(1), F.greatest(F.lit(0), F.col("reach") - own))).alias("at", "token"))
    placed = placed.select("a", "b", "token", (F.col("at") + F.col("own")).cast("int").alias("place"), *sizes)
    members_, members = members, members.filter("NOT ordered").drop("ordered")
    tokens = members.select("a", "b", F.explode("diff").alias("token"))
    often = tokens.groupBy("a", "token").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(F.col("a").alias("a_"), F.col("token").alias("t_"), "times")
    shared = tokens.join(often, (F.col("a") == F.col("a_")) & (F.col("token") == F.col("t_"))).select("a", "b", "token", "times")
    # Shingles that one set alone has stand first and meet nothing: only their number is needed.
    own = Window.partitionBy("a", "b")
    shared = shared.withColumn("place", F.row_number().over(own.orderBy("times", "token")) - 1).withColumn("held", F.count(F.lit(1)).over(own))
    of = members.drop("diff").withColumnsRenamed({"a": "a_", "b": "b_"})
    shared = shared.join(of, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).drop("a_", "b_", "times")
    shared = shared.withColumn("place", (F.col("place") + F.col("d") - F.col("held")).cast("int")).filter("place < reach").select(*placed.columns)
    shared = common.stored(placed.unionByName(shared))
    # What overlap a link needs, and what is left of either difference from the common shingle on.
    may = f"x.a = y.a AND x.token = y.token AND x.cb <> y.cb AND 100L * least(x.nb, y.nb) >= {percent}L * greatest(x.nb, y.nb) AND least(x.d - x.place, y.d - y.place) * 2 >= x.d + y.d - floor((x.nb + y.nb) * {k})"
    ends = lambda x, y: x.alias("x").join(y.alias("y"), F.expr(may)).select(F.least("x.b", "y.b").alias("a"), F.greatest("x.b", "y.b").alias("b"))
    free = shared.filter("NOT linked")
    short = free.filter("place < half")
    out = common.stored(ends(short, short).unionByName(ends(free, shared.filter("linked"))).filter("a < b").distinct())
    common.dropped(members_, shared)
    return out


def label():
    """What lists know a set by: 47 bits of its name."""
    return F.shiftrightunsigned("s", 17)


def pivots_of(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k, p, s, m): the lists of several sets with their pivot p, another of their sets, and the number of sets; sets are known
    by labels. Each set leaves the longest lists that it may leave first."""
    leave = nodes.select(label().alias("s_"), "leave0", "leave1").groupBy("s_").agg(F.min("leave0").alias("leave0"), F.min("leave1").alias("leave1"))
    sets = entries.select("k", F.shiftright("e", 1).alias("s"), F.col("e").bitwiseAND(F.lit(1)).alias("scheme"), "c").repartition("s")
    rank = F.row_number().over(Window.partitionBy("s", "scheme").orderBy(F.col("c").desc(), "k"))
    may = F.when(F.col("scheme") == 0, F.col("leave0")).otherwise(F.col("leave1"))
    kept = sets.withColumn("rank", rank).join(leave, F.col("s") == F.col("s_"), "left").filter(F.col("rank") > F.coalesce(may, F.lit(0)))
    kept = kept.withColumn("w", F.count(F.lit(1)).over(Window.partitionBy("s"))).select("k", "s", "c", "w")
    # A list of few sets finds its pivot where its sets meet: they are dealt by list once, and not once to find it and once to join it.
    few = kept.filter(F.col("c") <= SPLIT)
    own = Window.partitionBy("k")
    few = few.withColumn("p", F.max(F.struct("w", "s")).over(own)["s"]).withColumn("m", F.count(F.lit(1)).over(own)).filter("m > 1 AND s <> p").select("k", "p", "s", "m")
    kept = kept.filter(F.col("c") > SPLIT)
    pivots = kept.groupBy(F.col("k").alias("k_")).agg(F.max(F.struct("w", "s"))["s"].alias("p"), F.max("c").alias("c_"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    splits = lambda c: F.ceil(F.col(c) / SPLIT)
    pivots = pivots.select("k_", "p", "m", F.explode(F.sequence(F.lit(0).cast("long"), splits("c_") - 1)).alias("split_"))
    kept = kept.withColumn("split", F.pmod(F.xxhash64("s"), splits("c")))
    many = kept.join(pivots, (F.col("k") == F.col("k_")) & (F.col("split") == F.col("split_"))).filter("s <> p").select("k", "p", "s", "m")
    return few.unionByName(many)


def numbered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(p, s, a, b): pairs of labels with their nodes."""
    at = lambda c: nodes.select(label().alias(f"l{c}"), F.col("v").alias(c))
    return pairs.join(at("b"), F.col("s") == F.col("lb")).join(at("a"), F.col("p") == F.col("la")).select("p", "s", "a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, n_links_found, component_id): component_id is the smallest id of the component. n_links_found counts
    links that were found on the way to it: one at least where the document has any, but not all of them in large groups."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = common.parts_for(docs)
    buckets = 1 << min(18, max(6, math.ceil(math.log2(8 * parts))))
    index = indexed(rows, buckets, words, percent).repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = common.stored(merged(index))
    owners = found.filter("s IS NOT NULL").select("id", "s", "s2", "n", "leave0", "leave1")
    entries = found.filter("k IS NOT NULL").select("k", "e", "c")

    real = owners.filter((F.col("id") != NO_ID) & (F.col("n") > 0))
    nodes = real.groupBy("s", "s2").agg(F.min("id").alias("id"), F.first("leave0").alias("leave0"), F.first("leave1").alias("leave1"))
    first = F.min("s2").over(Window.partitionBy("s"))
    nodes = common.stored(nodes.withColumn("v", F.when(F.col("s2") == first, F.col("s")).otherwise(F.xxhash64("s", "s2"))))
    lists = common.stored(pivots_of(entries, nodes))
    labelled = common.stored(numbered(lists.select("p", "s").distinct(), nodes))
    pairs = labelled.select("a", "b").distinct()
    ends = pairs.select(F.col("a").alias("e_")).union(pairs.select(F.col("b").alias("e_"))).distinct()
    wanted = common.stored(nodes.join(ends, F.col("v") == F.col("e_")).select("v", "s", "s2", "id"))
    texts = common.stored(wanted_texts(rows, wanted))
    known = common.stored(compared(pairs, texts, words, parts))
    linked = linked_at(percent)
    links = known.filter(linked).select("a", "b")
    groups = common.stored(connected_components(links))
    with_labels = known.join(labelled.withColumnsRenamed({"a": "a_", "b": "b_"}), (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).drop("a_", "b_")
    open_ = common.stored(unsettled(with_labels, lists.filter("m > 2"), groups))
    common.dropped(lists)
    links = common.stored(links)
    if not open_.isEmpty():
        with_diff = compared(open_.select("a", "b").distinct(), texts, words, parts, diffs=True)
        of = open_.select(F.col("a").alias("a_"), F.col("b").alias("b_"), "cb").distinct()
        more = across(with_diff.join(of, (F.col("a") == F.col("a_")) & (F.col("b") == F.col("b_"))).drop("a_", "b_"), percent)
        if not more.isEmpty():
            links = common.stored(links.unionByName(compared(more, texts, words, parts).filter(linked).select("a", "b")))
            groups = common.stored(connected_components(links))
        common.dropped(more)
    common.dropped(labelled, wanted, texts, known, open_)
    degree = links.select(F.col("a").alias("v_")).unionAll(links.select(F.col("b").alias("v_"))).groupBy("v_").agg(F.count(F.lit(1)).alias("degree"))

    of = nodes.join(groups, F.col("v") == F.col("node"), "left").withColumn("c", F.coalesce("component", "v"))
    lowest = of.groupBy(F.col("c").alias("c_")).agg(F.min("id").alias("component_id"))
    of = of.join(lowest, F.col("c") == F.col("c_")).join(degree, F.col("v") == F.col("v_"), "left")
    of = of.select(F.col("s").alias("s_"), F.col("s2").alias("s2_"), "component_id", F.coalesce("degree", F.lit(0)).alias("n_links_found"))
    joined = real.join(of, (F.col("s") == F.col("s_")) & (F.col("s2") == F.col("s2_"))).select("id", "n", "n_links_found", "component_id")
    alone = owners.filter((F.col("n") == 0) | (F.col("id") == NO_ID)).select("id", "n", F.lit(0).cast("long").alias("n_links_found"), F.col("id").alias("component_id"))
    out = joined.unionByName(alone)
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(given("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "n_links_found", given("component_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_components(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`rows` without those whose `key`, never null, is in `gone` (gone__), a table. A bitmap, some 16 bits a key up to 2 MiB,
    tells most rows that stay, so that their texts are not shuffled; what passes it meets the keys themselves."""
    bits = min(24, max(10, (16 * gone.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word = gone.select(place(F.col("gone__")).alias("p")).groupBy(F.shiftright("p", 6).alias("w__")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("m__"))
    at = place(F.col(key).cast("long"))
    met = rows.join(F.broadcast(word), F.shiftright(at, 6) == F.col("w__"), "left")
    met = met.withColumn("met__", F.coalesce(F.col("m__").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0, F.lit(False)))
    stay = met.filter("NOT met__").select(*rows.columns)
    return stay.unionByName(met.filter("met__").select(*rows.columns).join(gone, F.col(key).cast("long") == F.col("gone__"), "left_anti"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component (null ids last): near copies share 0.8 of their 5-word shingles.

    Where every row has an id of its own, ids tell rows apart; else rows get numbers, and are stored first, so that these last.
    """
    plain, name = common.renamed(docs)
    id_, text = name["doc_id"], name["text"]
    ids = plain.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | F.col(id_).isNull())
    if ids.isEmpty():
        groups = jaccard_components(plain, id_, text, words=5, percent=80)
        gone = groups.filter(F.col("component_id") != F.col(id_)).select(F.col(id_).cast("long").alias("gone__"))
        return without(plain, id_, common.stored(gone)).toDF(*docs.columns)
    rows = common.stored(plain.withColumn("row__", F.monotonically_increasing_id()))
    groups = jaccard_components(rows, "row__", text, words=5, percent=80).select(F.col("row__").alias("r_"), "component_id")
    placed = rows.select("row__", F.col(id_).isNull().alias("last"), F.col(id_).alias("id")).join(groups, F.col("row__") == F.col("r_"))
    first = placed.groupBy(F.col("component_id").alias("c_")).agg(F.min(F.struct("last", "id", "row__"))["row__"].alias("kept__"))
    gone = placed.join(first, F.col("component_id") == F.col("c_")).filter("row__ <> kept__").select(F.col("row__").alias("gone__"))
    return without(rows, "row__", common.stored(gone)).drop("row__").toDF(*docs.columns)
