"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a label. Emissions are sums of learned weights of its character n-grams (1 to MAX_GRAM, with
marks at both ends of the word, so that they hold its affixes) and of the word itself (the lexicon); transitions and the weights
of the first label are learned too, so that the labels of code-switched text run in stretches. Training maximises the conditional
likelihood of all three by its gradient, from forward-backward over the whole chains of a bounded sample; its first epochs take
a document's label for all its words, the later ones relabel words that the field itself assigns surely to another language.
`labelled` gives the labels of the words, `predicted` those of documents: a document's prediction is the label with
the highest sum of posterior marginals over all its words, and its score is that label's share.

Forward-backward runs in step over blocks of words: each block's transfer matrix comes first, blocks of a document are
chained by these, and the marginals inside blocks follow. So a batch costs a few array operations a word, however long
its documents are, and the result is that of the whole chain.

Defined results: `und` and score 0 for a null text, a text without a letter, or where no training row exists; languages
are those of the sample; ties go to the label first in code point order; repeated rows have equal results; texts of any length are
one chain; an empty table gives an empty one; columns that are named as new ones are replaced, all others stay, whatever their
names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from readpool.llm import common

UNDETERMINED = "und"
MAX_ROWS = 2400  # training rows, over all languages
MAX_CHARS = 6_000_000  # and their characters: a row that does not fit is left out
BITS = 16
MAX_GRAM = 4
BLOCK = 48
BLOCK_LABELS = 12  # above this a matrix for each block costs more than steps over words
EPOCHS = 4
WORDS = re.compile(r"[^\W\d_]+")

MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, offset of each word's first): n-grams of the marked words, then the words themselves."""
    joined = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + 2 for w in words])
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    at = np.arange(len(codes))
    owner, found = [], []
    h = np.zeros(len(codes), np.uint64)
    whole = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, MAX_GRAM + 1):
            h = h[: len(codes) - n + 1] * np.uint64(1000003) + codes[n - 1 :]
            fits = at[: len(h)] + n <= ends[: len(h)]
            found.append(mixed(h[fits] + np.uint64(n << 40), bits))
            owner.append(at[: len(h)][fits])
        weights = np.power(np.uint64(6364136223846793005), (at - np.repeat(starts, lengths)).astype(np.uint64))
        whole = np.add.reduceat(codes * weights, starts) if len(words) else whole
        found.append(mixed(whole + np.uint64(99 << 40), bits))
        owner.append(starts)
    owner_all = np.searchsorted(starts, np.concatenate(owner), side="right") - 1
    order = np.argsort(owner_all, kind="stable")
    counts = np.bincount(owner_all, minlength=len(words))
    return np.concatenate(found)[order], np.cumsum(counts) - counts


def mixed(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def emissions(words: list[str], weights: np.ndarray, step: int = 50_000) -> np.ndarray:
    """Mean feature weight of each word, scaled by the root of the number of features."""
    out = [np.zeros((0, weights.shape[1]), np.float32)]
    for a in range(0, len(words), step):
        f, starts = gram_hashes(words[a : a + step])
        n = np.diff(np.append(starts, len(f)))
        out.append(np.add.reduceat(weights[f], starts, axis=0) / np.sqrt(n)[:, None].astype(np.float32))
    return np.concatenate(out)


def posteriors(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK, pairs: bool = False):
    """Marginals of each word, for sequences laid end to end; with `pairs` also the expected transition counts.

    For up to BLOCK_LABELS labels in step over blocks of words, else in step over the words of all sequences, whose memory is
    linear in the labels."""
    lengths = lengths[lengths > 0]
    A, pi = np.exp(transitions - transitions.max()), np.exp(start - start.max())
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64) + 1e-30
    return (by_blocks if scores.shape[1] <= BLOCK_LABELS else by_words)(e, lengths, A, pi, block, pairs)


def norm(x: np.ndarray, axes) -> np.ndarray:
    return x / x.sum(axes, keepdims=True)


def by_words(e: np.ndarray, lengths: np.ndarray, A: np.ndarray, pi: np.ndarray, block: int, pairs: bool):
    order = np.argsort(-lengths, kind="stable")
    begin, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
    alive = [int(n) for n in np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")]  # sequences with a word t
    out = np.zeros(e.shape)
    message = np.zeros((len(size), len(pi)))
    for t, n in enumerate(alive):
        at = begin[:n] + t
        message = norm((message[:n] @ A if t else pi[None]) * e[at], 1)
        out[at] = message
    expected = np.zeros(A.shape)
    beta = np.ones((len(size), len(pi)))
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        at = begin[:n] + t
        ahead = e[at] * beta[:n]
        if pairs and t:
            left = out[at - 1]
            total = ((left @ A) * ahead).sum(1, keepdims=True)
            expected += A * (left.T @ (ahead / total))
        out[at] = norm(out[at] * beta[:n] + 1e-300, 1)
        beta[:n] = norm(ahead @ A.T, 1)
    return (out, expected) if pairs else out


def by_blocks(e: np.ndarray, lengths: np.ndarray, A: np.ndarray, pi: np.ndarray, block: int, pairs: bool):
    k = len(pi)
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    seq = np.repeat(np.arange(len(lengths)), blocks)
    first = np.cumsum(blocks) - blocks
    nth = np.arange(total) - first[seq]
    begin = (np.cumsum(lengths) - lengths)[seq] + nth * block
    size = np.minimum(block, lengths[seq] - nth * block)
    width = int(size.max()) if total else 0
    grid = begin[:, None] + np.arange(width)
    inside = np.arange(width) < size[:, None]
    E = e[np.minimum(grid, len(e) - 1)]

    # Transfer matrix of each block: row i is the message that leaves it if label i came before it.
    P = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(width):
        on = np.flatnonzero(inside[:, t]) if not inside[:, t].all() else slice(None)
        P[on] = norm((P[on].reshape(-1, k) @ A).reshape(-1, k, k) * E[on, t][:, None, :], (1, 2))
    # Messages into each block from the left and from the right. The first block begins with pi instead of a transition.
    left, right = np.ones((total, k)), np.ones((total, k))
    chained = [np.flatnonzero(nth == j) for j in range(int(blocks.max()) if total else 0)]
    begins = nth == 0

    def step(message: np.ndarray, t: int) -> np.ndarray:
        moved = message @ A
        if t == 0:
            moved[begins] = pi
        return norm(moved * E[:, t], 1)

    for j, now in enumerate(chained[1:]):
        # A first block's transfer matrix begins with a transition too, so its message is stepped from pi.
        if j == 0:
            message = norm(pi * E[now - 1, 0], 1)
            for t in range(1, width):
                message = norm((message @ A) * E[now - 1, t], 1)
            left[now] = message
        else:
            left[now] = norm((left[now - 1][:, None, :] @ P[now - 1])[:, 0], 1)
    for now in reversed(chained):
        inner = now[size[now] + nth[now] * block < lengths[seq[now]]]
        if len(inner):
            right[inner] = norm((P[inner + 1] @ right[inner + 1][:, :, None])[:, :, 0], 1)
    # Inside blocks.
    alpha = np.zeros((total, width, k))
    message = left
    for t in range(width):
        message = step(message, t)
        alpha[:, t] = message
    beta = np.zeros((total, width, k))
    message = right.copy()
    for t in range(width - 1, -1, -1):
        on = inside[:, t]
        beta[on, t] = message[on]
        message = np.where(on[:, None], norm((message * E[:, t]) @ A.T, 1), message)
    gamma = norm(alpha * beta + 1e-300, 2)
    out = np.zeros(e.shape)
    out[grid[inside]] = gamma[inside]
    if not pairs:
        return out
    expected = np.zeros((k, k))
    for t in range(width):
        on = inside[:, t] & (~begins if t == 0 else True)
        before = left[on] if t == 0 else alpha[on, t - 1]
        ahead = E[on, t] * beta[on, t]
        expected += A * (before.T @ (ahead / ((before @ A) * ahead).sum(1, keepdims=True)))
    return out, expected


def train(sample: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = 0.6, steps: int = 16) -> dict | None:
    """The model from (text, language) pairs, or None where none has a word."""
    labels = sorted({y for _, y in sample})
    rows = [(w, labels.index(y)) for x, y in sample if (w := WORDS.findall(x.lower()))]
    if not rows:
        return None
    k = len(labels)
    weights = np.zeros((1 << BITS, k), np.float32)
    squares = np.full((1 << BITS, k), 1e-3, np.float32)
    transitions, start = 2.0 * np.eye(k), np.zeros(k)
    moved, begun = np.full((k, k), 1e-3), np.full(k, 1e-3)
    order = np.random.default_rng(0)
    for epoch in range(epochs if k > 1 else 0):
        for ids in np.array_split(order.permutation(len(rows)), min(steps, len(rows))):
            lengths = np.array([len(rows[i][0]) for i in ids])
            y = np.repeat([rows[i][1] for i in ids], lengths)
            code, unique = pd.factorize(np.array([w for i in ids for w in rows[i][0]], object))
            f, starts = gram_hashes(list(unique))
            n = np.diff(np.append(starts, len(f)))
            e = np.add.reduceat(weights[f], starts, axis=0) / np.sqrt(n)[:, None]
            p, expected = posteriors(e[code], lengths, transitions, start, pairs=True)
            firsts = np.cumsum(lengths) - lengths
            gold = y
            if epoch >= 2:
                # Words of a document that the field gives to its own label for the most part may be of another language.
                kept = np.add.reduceat(p[np.arange(len(y)), y], firsts) / lengths > 0.5
                sure = (p.max(1) > 0.9) & np.repeat(kept, lengths)
                gold = np.where(sure, p.argmax(1), y)
            inner = np.ones(len(gold), bool)
            inner[firsts] = False
            at = np.flatnonzero(inner)
            observed = np.zeros((k, k))
            np.add.at(observed, (gold[at - 1], gold[at]), 1)
            g = 100 * (expected - observed) / max(1, len(at)) + 1e-3 * transitions
            moved += g**2
            transitions -= 0.5 * rate * g / np.sqrt(moved)
            g = (p[firsts] - np.eye(k)[gold[firsts]]).mean(0) + 1e-3 * start
            begun += g**2
            start -= 0.5 * rate * g / np.sqrt(begun)
            # A document weighs as 200 words at most, so that a long one does not outweigh all others of a step.
            weight = np.repeat(np.minimum(1.0, 200 / lengths), lengths)
            d = (p - np.eye(k)[gold]) * (100 * weight / weight.sum())[:, None]
            grad = np.stack([np.bincount(code, d[:, j], len(unique)) for j in range(k)], 1)
            by_gram = np.repeat(grad / np.sqrt(n)[:, None], n, axis=0)
            used, place = np.unique(f, return_inverse=True)
            g = np.stack([np.bincount(place, by_gram[:, j], len(used)) for j in range(k)], 1) + 1e-4 * weights[used]
            squares[used] += g**2
            weights[used] -= rate * g / np.sqrt(squares[used])
    return {"labels": labels, "weights": weights, "transitions": transitions, "start": start}


def fitted(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", *, max_rows=MAX_ROWS, max_chars=MAX_CHARS) -> dict | None:
    """The model from about `max_rows` rows of folds other than 1 (crc32 of the id, mod 3): as many of each language, one at least."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("x"), F.col(lang_col).alias("y"))
    rows = rows.filter(F.col("y").isNotNull() & F.col("x").isNotNull() & F.col("id").isNotNull() & ~common.held_out("id", 3, 1))
    k = rows.agg(F.count_distinct("y")).first()[0]
    if not k:
        return None
    each = max(1, max_rows // k)
    rows = rows.withColumn("h", F.xxhash64(F.lit(3), "id"))
    # Per language, the hash below which about `each` rows lie (partitions keep that many before the shuffle); then one scan
    # takes the rows themselves.
    place = F.row_number().over(Window.partitionBy("y").orderBy("h"))
    bounds = rows.select("y", "h", place.alias("place")).filter(F.col("place") <= each).groupBy(F.col("y").alias("y_")).agg(F.max("h").alias("top"))
    wanted = rows.join(F.broadcast(bounds), F.col("y") == F.col("y_")).filter("h <= top")
    chosen = wanted.select("y", "x", "h", F.length("x").alias("n")).orderBy("h", "x")
    out, chars = [], 0
    for r in chosen.toLocalIterator():
        if chars + r["n"] > max_chars:
            continue
        chars += r["n"]
        out.append((r["x"], r["y"]))
    return train(out)


def word_posteriors(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(posteriors of all words, number of words of each text, the words); those of words without a letter are 0."""
    words, lengths = [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        if x:
            found = WORDS.findall(x.lower())
            lengths[i] = len(found)
            words += found
    if not words:
        return np.zeros((0, len(model["labels"]))), lengths, words
    code, unique = pd.factorize(np.array(words, object))
    unique = list(unique)
    letters = np.array([any(map(str.isalpha, w)) for w in unique])
    e = emissions(unique, model["weights"])
    return posteriors(e[code].astype(np.float32), lengths, model["transitions"], model["start"]) * letters[code][:, None], lengths, words


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray, list]:
    """(label, score, share of each language) of every text."""
    p, lengths, _ = word_posteriors(texts, model)
    total = np.zeros((len(texts), len(model["labels"])))
    has = lengths > 0
    if has.any():
        total[has] = np.add.reduceat(p, (np.cumsum(lengths) - lengths)[has], axis=0)
    mass = total.sum(1)
    share = total / np.maximum(mass, 1e-300)[:, None]
    best = share.argmax(1)
    labels = [model["labels"][b] if m > 0 else UNDETERMINED for b, m in zip(best, mass, strict=True)]
    return labels, np.where(mass > 0, np.minimum(share.max(1), 1.0), 0.0), share.tolist()


def word_runs(texts: list[str | None], model: dict) -> list[list[dict]]:
    """For each text its runs of words with one label: label, number of the first word, and how many."""
    p, lengths, _ = word_posteriors(texts, model)
    out, at = [], 0
    for n in lengths.tolist():
        best = np.where(p[at : at + n].sum(1) > 0, p[at : at + n].argmax(1), -1)
        cut = np.flatnonzero(np.diff(best, prepend=-2))
        out.append([{"lang": model["labels"][best[i]] if best[i] >= 0 else UNDETERMINED, "first": int(i), "words": int(j - i)} for i, j in zip(cut, np.append(cut[1:], n), strict=True)] if n else [])
        at += n
    return out


def batches_of(texts: list[str | None], model: dict, batch_chars: int):
    """(from, to) of texts that are labelled at once, fewer where there are many labels."""
    most, a, n = batch_chars * 4 // max(4, len(model["labels"])), 0, 0
    for i, x in enumerate(texts):
        n += len(x or "")
        if n >= most or i + 1 == len(texts):
            yield a, i + 1
            a, n = i + 1, 0


def predicted(docs: DataFrame, model: dict | None, text_col="text", keep: list[str] | None = None, batch_chars: int = 4_000_000) -> DataFrame:
    """Columns `keep` (default: all) with lang_pred string and score double."""
    new = ["lang_pred", "score"]
    kept = [c for c in (keep or docs.columns) if c not in new]
    if model is None:
        return docs.select(*kept, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("text_to_label__"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: 2**BITS weights a language

    def run(batches):
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            labels, scores = [], [np.zeros(0)]
            for i, j in batches_of(texts, shared.value, batch_chars):
                y, s, _ = predict(texts[i:j], shared.value)
                labels += y
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(labels, pa.string()), pa.array(np.concatenate(scores), pa.float64())], [*kept, *new])

    return rows.mapInArrow(run, schema)


def labelled(docs: DataFrame, model: dict, text_col="text", out_col="runs", batch_chars: int = 4_000_000) -> DataFrame:
    """`docs` with `out_col`: the runs of words of one language, array<struct<lang, first, words>>; empty without a word."""
    kept = [c for c in docs.columns if c != out_col]
    run_kind = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])
    kind = ArrayType(StructType([StructField("lang", StringType()), StructField("first", IntegerType()), StructField("words", IntegerType())]))
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("text_to_label__"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            runs = [r for i, j in batches_of(texts, shared.value, batch_chars) for r in word_runs(texts[i:j], shared.value)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(runs, pa.list_(run_kind))], [*kept, out_col])

    return rows.mapInArrow(run, docs.select(*kept).schema.add(out_col, kind))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = predicted(docs.select("doc_id", "text"), fitted(docs), keep=["doc_id"])
    return out.select("doc_id", common.held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
