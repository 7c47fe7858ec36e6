"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The distinct words of a batch are laid end to end and their suffixes sorted to the length of the longest piece. Binary
search of every piece gives its range of occurrences; each occurrence is an edge from its start to its end. Edges are
sorted by end and relaxed in that order. For BPE, relaxing keeps the one edge into each position that merging would have
made: a piece may follow the last piece of the encoded prefix if merging the two pieces' strings leaves both whole
(`compatible`), and the encoding of a text is that of its prefix up to any token's start, then that token.

Merges never cross the start of a word (no piece has a space mark after another character) nor a character without a piece,
so words, cut at such characters, are encoded alone and each distinct one once a batch. Runs of spaces merge last, since
their pieces score lowest, and leftmost first.

Defined results: null and empty texts have no token; characters without a piece become their UTF-8 bytes; U+2581 in a text
is a space, as the model has no other mark for it; decoding gives the text back, but for that. Repeated rows are encoded each; a
text of any length is encoded whole by one task; an empty table gives an empty one; a null token list decodes to null, and a
null or a number that is no token inside one to U+FFFD; columns that are named as new ones are replaced, all others stay. A model
that is not BPE is refused with an error. "Batch text" are the distinct words of a batch that the task has not met before.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from readpool.llm import common
from readpool.llm.common import give_back_memory

MODEL = os.environ.get("READPOOL_PIECES", "/opt/tokenizers/piece_bpe_32k.model")  # the default of the parameter `model`
SPACE = "▁"
CHUNK_CHARS = 1_000_000
MATCH_CHARS = 300_000  # of distinct words that are matched at once
MOST_WORDS = 500_000  # that a task remembers
NEVER = np.int64(1) << 40


class Vocabulary:
    """The tables that encoding needs, of fixed size for a model."""

    def __init__(self, pieces: list[str], scores: list[float], special: set[int], byte_ids: list[int]):
        self.pieces, self.special, self.byte_ids = pieces, special, byte_ids
        rank = np.empty(len(pieces), np.int64)
        rank[np.lexsort((np.arange(len(pieces)), -np.array(scores)))] = np.arange(len(pieces))
        self.by_text = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(SPACE in p.lstrip(SPACE) for p in self.by_text):
            raise ValueError("a piece of this model has a space mark after another character, so words cannot be encoded alone")
        if any(scores[i] != round(scores[i]) for i in self.by_text.values()):
            raise ValueError("the scores of this model are no merge ranks: only BPE models are encoded here, not unigram ones")
        self.rank = np.where([len(p) == 1 for p in pieces], -1, rank)
        words = {p: i for p, i in self.by_text.items() if p == SPACE or p.strip(SPACE)}
        self.space = self.by_text[SPACE]
        self.runs = {len(p): i for p, i in self.by_text.items() if not p.strip(SPACE)}
        chars = sorted(p for p in words if len(p) == 1)
        self.code = {c: i + 1 for i, c in enumerate(chars)}
        self.bits = len(chars).bit_length()
        self.at_once = 62 // self.bits  # characters that one number holds
        self.known = re.compile("[" + "".join(map(re.escape, chars)) + "]+|.", re.DOTALL)
        self.other = re.compile("[^" + "".join(re.escape(c) for c in chars if c != SPACE) + "]")
        left, right, merged = [], [], []
        for p, i in words.items():
            for k in range(1, len(p)):
                a, b = words.get(p[:k]), words.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = key[order], self.rank[np.array(merged, np.int64)[order]]
        pair = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self.left, self.right = np.full(len(pieces), -1), np.full(len(pieces), -1)
        self.usable = np.zeros(len(pieces), bool)
        for p, i in words.items():
            last = self._last_merge([words.get(c) for c in p], pair)
            if last:
                self.usable[i] = True
                self.left[i], self.right[i] = last
        # Pieces to search for, as codes: 0 after the end.
        use = np.flatnonzero(self.usable)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.longest = int(self.size[use].max())
        self.ids = use
        self.width = -(-self.longest // self.at_once) * self.at_once
        grid = np.zeros((len(use), self.width), np.int64)
        for r, i in enumerate(use.tolist()):
            grid[r, : len(pieces[i])] = [self.code[c] for c in pieces[i]]
        self.grid = grid

    def _last_merge(self, symbols: list, pair: dict) -> tuple | None:
        """The last merge of a piece's own characters; (-1, -1) for one character, None if merging does not give the piece."""
        last = (-1, -1)
        if None in symbols:
            return None
        while len(symbols) > 1:
            best = min(((self.rank[pair[a, b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (a, b) in pair), default=None)
            if best is None:
                return None
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [pair[last]]
        return last

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the strings of pieces a and b ends with a, b.

        The symbols on both sides of the border are followed back in time: the one made later is taken apart, until both
        are characters. A merge across the border would have happened if the pair has a piece of earlier rank than the
        merge that used one of the two; of merges with equal rank the left one comes first.
        """
        out = np.ones(len(a), bool)
        at, x, y, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), NEVER)
        while len(at):
            key = x << 32 | y
            place = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            crossed = (self.pair_key[place] == key) & (self.pair_rank[place] < limit)
            out[at[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry = at[go], x[go], y[go], rx[go], ry[go]
            left_later = rx > ry
            limit = np.where(left_later, rx, ry + 1)
            x, y = np.where(left_later, self.right[x], x), np.where(left_later, y, self.left[y])
        return out

    def space_run(self, n: int) -> list[int]:
        """Tokens of n spaces: equal scores, so the leftmost pair that makes a piece merges, again and again."""
        k, sizes = 0, [1] * n
        while k + 1 < len(sizes):
            if sizes[k] + sizes[k + 1] in self.runs:
                sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
                k = max(0, k - 1)
            else:
                k += 1
        return [self.runs[s] for s in sizes]


def shared_tables(df: DataFrame, model: str):
    """A broadcast of the vocabulary's tables: plain values, which executors read without this package."""
    return df.sparkSession.sparkContext.broadcast(dict(vars(load(model))))


def from_tables(tables: dict) -> Vocabulary:
    out = Vocabulary.__new__(Vocabulary)
    vars(out).update(tables)
    return out


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file on the driver; executors get its tables by broadcast."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    byte_ids = sorted((i for i in ids if model.is_byte(i)), key=lambda i: int(model.id_to_piece(i)[3:5], 16))
    return Vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], special, byte_ids)


# --- matching and relaxing -------------------------------------------------------------------------------


def packed(codes: np.ndarray, inside: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """As many codes from each place on as one number holds; 0 beyond the end of the place's word."""
    key = np.zeros(len(codes), np.int64)
    for t in range(vocab.at_once):
        c = np.append(codes[t:], np.zeros(min(t, len(codes)), codes.dtype))
        key = key << vocab.bits | np.where(inside > t, c, 0)
    return key


def matches(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """(start, end, piece) of every occurrence of a piece in the words laid end to end, and the words' starts."""
    sizes = np.array([len(w) for w in words], np.int64)
    joined = "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    table = np.zeros(int(points.max()) + 1, np.int64)
    for c, i in vocab.code.items():
        if ord(c) < len(table):
            table[ord(c)] = i
    codes = table[points]
    begins = np.cumsum(sizes) - sizes
    inside = np.repeat(begins + sizes, sizes) - np.arange(len(codes))  # characters left in the word
    key, step = packed(codes, inside, vocab), vocab.at_once
    # Suffix array to the depth of the longest piece, a number's characters at a time.
    order = np.arange(len(codes))
    ahead = lambda at, k: np.where(inside[at] > k, key[np.minimum(at + k, len(key) - 1)], 0)
    order = np.argsort(key, kind="stable")
    head = np.append(True, key[order][1:] != key[order][:-1])
    for k in range(step, vocab.width, step):
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))
        if not len(slots):
            break
        group = np.cumsum(head)[slots]
        rows = order[slots]
        second = ahead(rows, k)
        by = np.lexsort((second, group))
        order[slots], group, second = rows[by], group[by], second[by]
        head[slots] = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
    # Every piece's range, likewise.
    grid, size = vocab.grid, vocab.size[vocab.ids]
    low, high = np.zeros(len(grid), np.int64), np.full(len(grid), len(order), np.int64)
    for k in range(0, vocab.width, step):
        on = np.flatnonzero((size > k) & (low < high))
        if not len(on):
            break
        value = np.zeros(len(on), np.int64)
        for t in range(step):
            value = value << vocab.bits | grid[on, k + t]
        free = (1 << (vocab.bits * np.maximum(0, k + step - size[on]))) - 1  # what may follow the piece
        low[on], high[on] = (bound(order, ahead, k, low[on], high[on], value), bound(order, ahead, k, low[on], high[on], value + free + 1))
    n = np.maximum(high - low, 0)
    piece = np.repeat(np.arange(len(grid)), n)
    start = order[np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n) + low[piece]]
    return start, start + size[piece], vocab.ids[piece], begins, sizes


def bound(order, ahead, k: int, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
    """First row in [low, high) whose characters after k are not below value."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = np.zeros(len(low), bool)
        less[open_] = ahead(order[mid[open_]], k) < value[open_]
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def encode_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all words, number of tokens of each), for distinct non-empty words of known characters."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    start, end, piece, begins, sizes = matches(words, vocab)
    total = int(sizes.sum())
    first = np.repeat(begins, sizes)  # of the word that holds a place
    offset = end - first[start]
    longest = int(sizes.max())
    order = np.argsort(offset.astype(np.uint16 if longest < 1 << 16 else np.int64), kind="stable")
    start, end, piece, offset = start[order], end[order], piece[order], offset[order]
    last = np.full(total + 1, -1)  # piece that ends before a place; index by end - 1
    came = np.zeros(total + 1, np.int64)
    cuts = np.searchsorted(offset, np.arange(1, longest + 2))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s, e, p = start[a:b], end[a:b], piece[a:b]
        fine = s == first[s]
        inner = np.flatnonzero(~fine)
        if len(inner):
            key, back = np.unique(last[s[inner] - 1] << 32 | p[inner], return_inverse=True)
            fine[inner] = vocab.compatible(key >> 32, key & 0xFFFFFFFF)[back]
        last[e[fine] - 1], came[e[fine] - 1] = p[fine], s[fine]
    # Back from the ends, all words in step.
    at, word = begins + sizes - 1, np.arange(len(words))
    steps, counts = [], np.zeros(len(words), np.int64)
    while len(at):
        steps.append((word, last[at]))
        counts[word] += 1
        s = came[at]
        on = s > begins[word]
        at, word = s[on] - 1, word[on]
    tokens, ends = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts)
    for i, (w, p) in enumerate(steps):
        tokens[ends[w] - 1 - i] = p
    return tokens, counts


class Encoder:
    """Encodes texts batch by batch; words of earlier batches are remembered, up to MOST_WORDS."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.tokens = np.zeros(0, np.int32)
        self.begin = self.count = np.zeros(0, np.int64)

    def _learn(self, keys: list[str]) -> None:
        """Keys are words without the space before them; leading spaces are further ones."""
        v = self.vocab
        odd = [k for k in keys if not k or v.other.search(k)]  # with characters without a piece, or only spaces
        plain = list(set(keys).difference(odd))
        split = [v.known.findall(SPACE + w) if (w := k.lstrip(SPACE)) else [] for k in odd]
        words = [SPACE + k for k in plain]
        parts = list({s for x in split for s in x if s[0] in v.code} - set(words))
        words += parts
        tokens, counts = [], []
        a = size = 0
        for i, s in enumerate(words):
            size += len(s)
            if size >= MATCH_CHARS or i + 1 == len(words):
                t, c = encode_words(words[a : i + 1], v)
                tokens.append(t)
                counts.append(c)
                a, size = i + 1, 0
        flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        begin = np.cumsum(count) - count
        place = {s: i for i, s in enumerate(words)} if odd else {}
        joined: list[int] = []
        sizes = []
        for k, x in zip(odd, split, strict=True):
            before = len(joined)
            if not x:
                joined += v.space_run(len(k) + 1)
            for j, s in enumerate(x):
                i = place.get(s, -1)
                ids = flat[begin[i] : begin[i] + count[i]].tolist() if i >= 0 else [v.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")]
                if j == 0 and (run := len(k) - len(k.lstrip(SPACE))):
                    alone = ids[0] == v.space
                    joined += v.space_run(run + alone)
                    ids = ids[alone:]
                joined += ids
            sizes.append(len(joined) - before)
        known = len(self.number)
        self.number.update((k, known + i) for i, k in enumerate(plain + odd))
        n = np.concatenate((count[: len(plain)], np.array(sizes, np.int64)))
        at = np.concatenate((begin[: len(plain)], len(flat) + np.cumsum(sizes, dtype=np.int64) - np.array(sizes, np.int64)))
        self.begin, self.count = np.concatenate((self.begin, len(self.tokens) + at)), np.concatenate((self.count, n))
        self.tokens = np.concatenate((self.tokens, flat, np.array(joined, np.int32)))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, number of tokens of each)."""
        keys: list[str] = []
        counts = []
        for x in texts:
            words = words_of(x) if x else []
            keys += words
            counts.append(len(words))
        if len(self.number) > MOST_WORDS:
            self._forget()
        new = set(keys).difference(self.number)
        if new:
            self._learn(list(new))
        which = np.array(list(map(self.number.__getitem__, keys)), np.int64)
        n = self.count[which]
        begin = np.cumsum(n) - n
        tokens = self.tokens[np.arange(int(n.sum())) + np.repeat(self.begin[which] - begin, n)]
        ends = np.append(0, np.cumsum(n))
        at = np.append(0, np.cumsum(counts))
        return tokens, np.diff(ends[at])


SPACES = re.compile(f"{SPACE}{SPACE}*[^{SPACE}]+|{SPACE}+", re.DOTALL)


def words_of(text: str) -> list[str]:
    """Words of a text, each without the space before it; a word's further leading spaces stay."""
    text = text.replace(" ", SPACE)
    if text[0] != SPACE and text[-1] != SPACE and SPACE * 2 not in text:
        return text.split(SPACE)
    return [w[1:] for w in SPACES.findall(SPACE + text)]


def decode(tokens: list[int | None], table: list[bytes]) -> str:
    """The text of a token list; bytes that are no UTF-8, nulls and numbers that are no token become U+FFFD."""
    lost = "\ufffd".encode()
    raw = b"".join([table[t] if t is not None and 0 <= t < len(table) else lost for t in tokens])
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def byte_table(vocab: Vocabulary) -> list[bytes]:
    table = [b"" if i in vocab.special else p.replace(SPACE, " ").encode() for i, p in enumerate(vocab.pieces)]
    for b, i in enumerate(vocab.byte_ids):
        table[i] = bytes([b])
    return table


# --- operators -------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """Columns `keep` (default: all) with token_ids array<int> and n_tokens int."""
    new = ["token_ids", "n_tokens"]
    kept = [c for c in (keep or docs.columns) if c not in new]
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("text_to_encode__"))
    schema = docs.select(*kept).schema.add("token_ids", ArrayType(IntegerType())).add("n_tokens", "integer")
    shared = shared_tables(docs, model)

    def run(batches):
        encoder = Encoder(from_tables(shared.value))
        for b in batches:
            for a, texts in text_chunks(b.column(len(kept))):
                tokens, counts = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, len(texts)) for c in b.columns[: len(kept)]), lists(tokens, counts), pa.array(counts, pa.int32())], [*kept, *new])
        encoder = b = texts = tokens = counts = None
        give_back_memory()

    return rows.mapInArrow(run, schema)


def text_chunks(texts: pa.Array, chars: int = CHUNK_CHARS):
    """(first index, texts) of stretches of about `chars` characters."""
    a, n, out = 0, 0, []
    for i in range(len(texts)):
        out.append(texts[i].as_py())
        n += len(out[-1] or "")
        if n >= chars or i + 1 == len(texts):
            yield a, out
            a, n, out = i + 1, 0, []


def lists(tokens: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(tokens, pa.int32()))


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_tokens, token_ids, decoded_sha256, round_trip): the tokens of every whole text, and what decoding them gives."""
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    schema = rows.select(id_col).schema.add("n_tokens", "integer").add("token_ids", ArrayType(IntegerType())).add("decoded_sha256", "string").add("round_trip", "boolean")
    names = schema.fieldNames()
    shared = shared_tables(docs, model)

    def run(batches):
        vocab = from_tables(shared.value)
        encoder, table = Encoder(vocab), byte_table(vocab)
        for b in batches:
            for a, texts in text_chunks(b.column(1)):
                tokens, counts = encoder.encode(texts)
                back = [decode(t.tolist(), table) for t in np.split(tokens, np.cumsum(counts)[:-1])]
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in back]
                same = [x == (t or "").replace(SPACE, " ") for x, t in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(texts)), pa.array(counts, pa.int32()), lists(tokens, counts), pa.array(digests), pa.array(same)], names)
        encoder = b = texts = tokens = counts = back = None
        give_back_memory()

    return rows.mapInArrow(run, schema)


def decoded(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """`df` with `out_col`, the text of its token lists; a null list gives null."""
    kept = [c for c in df.columns if c != out_col]
    shared = df.sparkSession.sparkContext.broadcast(byte_table(load(model)))

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index(ids_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array([None if x is None else decode(x, shared.value) for x in lists], pa.string())], [*kept, out_col])

    return df.mapInArrow(run, df.select(*kept).schema.add(out_col, "string"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(common.table(spark, sf_dir, "documents"))
