"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses at sentence punctuation and line ends. Each word of a clause maps to a class (insult, threat,
target, negation, reported speech, other) by a lexicon. Three transducers over classes are composed into one machine: negation
marks an insult or threat within SCOPE words after it, reported speech marks all that follow in the clause, and a target
marks those of its clause, before or after it. What a match weighs is its entry's weight times the factors of its marks.

A fourth machine reads the matches of a text, clause by clause, and accepts texts in which abuse is borne out: an insult or
threat with a target, outside negation and reported speech; or two such matches without a target. An accepted text has the
logit BIAS plus the weights of its entries times the mean factors of their matches (an entry has one weight for one match in a
text, one for several). A text that is not accepted, such as one with a single insult at nobody, has at most the entry's `lone`
weight: LONE, which stays below THRESHOLD, unless labels say that texts with that one match are toxic. A text without a match
scores 0.

What is learned, from a bounded sample of at most `max_toxic` and `max_clean` labelled rows: words and word beginnings that mark
toxic training texts, or do so where they come up repeatedly, with their log-odds as weights, as threats if targets mostly
follow them, else as insults; words that near such matches go with clean texts, as negations (within SCOPE before) or reported
speech, and those that go with toxic ones more than the match alone, as targets; and the three factors, by likelihood with a
penalty on leaving their defaults. The lexicon starts from short general lists.

Defined results: a null or empty text scores 0; score >= THRESHOLD is predicted 1; rows without a label are scored like
any other; a null label, or a label row without its document, is not learned from; of several label rows for one id the
highest label counts; repeated rows score alike; texts of any length are scored whole; ties between entries that explain
equally many texts go to the longer, then to the first in code point order; columns that are named as new ones are replaced, all
others stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readpool.llm import common
from readpool.llm.common import give_back_memory

THRESHOLD = 0.3
MAX_TOXIC = 1500
MAX_CLEAN = 4000
MAX_CHARS = 40_000_000  # of both: a row that does not fit is left out
RANGES = 8  # of the rows to learn from, which come to the driver one after another
SCOPE = 3
BIAS = -2.0
LONE = 1.0  # weight at most of a match that nothing else bears out: BIAS + LONE is below the logit of THRESHOLD
FACTORS = (0.45, 0.6, 1.2)  # of negation, reported speech and a target, before any training
SEED_WEIGHT = 4.0
MAX_WEIGHT = 8.0
MIN_LOG_ODDS = 3.5
MIN_STEM = 3
MAX_STEM = 8

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "ITGNRO"

# General word lists: the grammar's terminals before any training.
SEEDS = {
    INSULT: "idiot idiots stupid moron morons loser losers scum trash pathetic worthless disgusting clown imbecile dumbass jerk idiota estúpido estúpida imbécil basura asqueroso crétin débile abruti connard ordure nul dumm idiotisch abschaum dreckig versager".split(),
    THREAT: "kill murder destroy hurt matar matarte golpear tuer frapper détruire töten umbringen schlagen".split(),
    TARGET: "you your yours yourself tu te toi vous tú usted ustedes ti du dich dir ihr euch".split(),
    NEGATION: "not never no nor neither without isn't don't pas jamais ne ni sans nunca sin tampoco nicht kein keine nie niemals ohne".split(),
    REPORT: "said says wrote writes called quoted claimed reported dijo dice escribió llamó dit écrit appelé sagte sagt schrieb nannte".split(),
}

CONTEXT_ODDS = 1.5  # by how much a word near a match must change the log-odds of a text
GRIDS = ((0.0, 0.15, 0.3, 0.6, 0.8, 1.0), (0.0, 0.2, 0.4, 0.8, 1.0), (1.0, 1.1, 1.4, 1.7, 2.0))  # values that factors may take

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:,\n]")


class Transducer:
    """Deterministic transducer: step(state, symbol) -> (state, symbol, marks). Marks are tuples that add up."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one puts out, the other takes in."""

        def step(state, symbol):
            a, middle, x = self.step(state[0], symbol)
            b, out, y = other.step(state[1], middle)
            return (a, b), out, tuple(map(sum, zip(x, y, strict=True)))

        return Transducer((self.start, other.start), step)

    def table(self, alphabet: str) -> dict:
        """All reachable transitions, by (state number, symbol)."""
        number, todo, out = {self.start: 0}, [self.start], {}
        while todo:
            state = todo.pop()
            for symbol in alphabet:
                to, emitted, x = self.step(state, symbol)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                out[number[state], symbol] = (number[to], emitted, x)
        return out


HIT = (INSULT, THREAT)
NONE = (0, 0, 0)


def grammar(scope: int = SCOPE) -> dict:
    """The machine over the classes of a clause's words; marks: negated, reported, targeted."""
    negation = Transducer(0, lambda left, s: (scope if s == NEGATION else max(0, left - 1), s, (1, 0, 0) if left and s in HIT else NONE))
    report = Transducer(False, lambda on, s: (on or s == REPORT, s, (0, 1, 0) if on and s in HIT else NONE))
    target = Transducer(False, lambda on, s: (on or s == TARGET, s, (0, 0, 1) if on and s in HIT else NONE))
    return negation.then(report).then(target).table(INSULT + THREAT + TARGET + NEGATION + REPORT + OTHER)


AIMED, FREE, WEAK = "AFW"  # a match with a target, one without, and a negated or reported one


def evidence() -> dict:
    """The machine over the matches of a text: the state says how far abuse is borne out, and 2 accepts."""
    return {(seen, s): 2 if s == AIMED else min(2, seen + (s == FREE)) for seen in range(3) for s in AIMED + FREE + WEAK}


Marks = tuple[int, int, int]


def kind_of(marks: Marks) -> str:
    return WEAK if marks[0] or marks[1] else AIMED if marks[2] else FREE


# Class, weight of one match in a document, weight of several, and of one that nothing else bears out.
Entry = tuple[str, float, float, float]
Lexicon = tuple[dict[str, Entry], dict[str, Entry], tuple[float, float, float]]  # whole words, word beginnings, factors


def seeds() -> Lexicon:
    return {w: (kind, *[SEED_WEIGHT if kind in HIT else 0.0] * 2, LONE) for kind, words in SEEDS.items() for w in words}, {}, FACTORS


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def fit(sample: list[tuple[str | None, int]], min_docs: int = 4) -> Lexicon:
    """The lexicon from (text, label) pairs. Copies of one text teach once: a text most of whose lowest shingle hashes
    came up in its class before is left out, so that the words of a copied text do not pass for toxic ones."""
    seen: set[tuple[int, int]] = set()
    number: dict[str, int] = {}
    kept: list[tuple[str, int]] = []
    texts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}  # distinct words of each text, and 2 for repeated ones
    for text, label in sample:
        words = tokens(text or "")
        sketch = sorted(map(hash_text, map(" ".join, zip(words, words[1:], words[2:], strict=False))))[:6]
        if sketch and sum((label, h) in seen for h in sketch) * 2 > len(sketch):
            continue
        seen.update((label, h) for h in sketch)
        ids, n = np.unique(np.array([number.setdefault(w, len(number)) for w in words], np.int32), return_counts=True)
        texts[min(1, max(0, label))].append((ids, np.minimum(n, 2).astype(np.int8)))
        kept.append(((text or "").lower(), min(1, max(0, label))))
    n1, n0 = len(texts[1]), len(texts[0])
    if not n1 or not n0:
        return seeds()

    def odds(t: float, c: float) -> float:
        return max(-MAX_WEIGHT, min(MAX_WEIGHT, math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))))

    vocabulary = list(number)
    length = np.array([len(w) for w in vocabulary])
    in_toxic = np.zeros(len(vocabulary), bool)
    for ids, _ in texts[1]:
        in_toxic[ids] = True

    whole, stems, _ = seeds()
    need = max(3, n1 // 300)
    good: dict[tuple[str, bool], Entry] = {}
    marked: dict[tuple[str, bool], set[int]] = defaultdict(set)
    endings: dict[str, set[str]] = {}
    # Keys are words, then all words that begin alike, one length after the other.
    for k in range(MIN_STEM - 1, MAX_STEM + 1):
        is_stem, index = k >= MIN_STEM, {}
        if is_stem:
            key_of = np.array([index.setdefault(w[:k], len(index)) if len(w) > k else -1 for w in vocabulary], np.int32)
        else:
            index, key_of = number, np.where((length >= MIN_STEM) | np.array([w in whole for w in vocabulary]), np.arange(len(vocabulary)), -1)

        def matches(ids, weights, key_of=key_of):
            """Keys of a text, and how many matches each has (2 for more)."""
            keys = key_of[ids]
            found, place = np.unique(keys[keys >= 0], return_inverse=True)
            return found, np.bincount(place, weights[keys >= 0], len(found))

        once, more = np.zeros((2, len(index)), np.int64), np.zeros((2, len(index)), np.int64)
        for label in (0, 1):
            for text in texts[label]:
                found, n = matches(*text)
                once[label, found] += 1
                more[label, found[n > 1]] += 1
        if not is_stem:
            for w, (kind, *_) in list(whole.items()):
                t, c = (int(once[y, number[w]]) if w in number else 0 for y in (1, 0))
                if kind in (INSULT, THREAT) and t + c >= min_docs:
                    if odds(t, c) <= 0:
                        del whole[w]  # the labels say that this word does no harm here
                    else:
                        whole[w] = (kind, odds(t, c), odds(t, c), LONE)
        # Keys that mark toxic texts by any match, or by several; and the texts that they mark.
        names, own = list(index), {}
        for i in np.flatnonzero(once[1] >= 3).tolist():
            c, t, c2, t2 = (int(x) for x in (*once[:, i], *more[:, i]))
            if c <= t / 20 and odds(t, c) >= MIN_LOG_ODDS:
                own[i] = (INSULT, odds(t, c), odds(t, c), LONE)
            elif t2 >= 2 * need and c2 <= t2 / 4 and odds(t2, c2) >= MIN_LOG_ODDS - 0.5:
                own[i] = (INSULT, min(odds(t - t2, c - c2), 0.5), odds(t2, c2), LONE)
        if is_stem:
            for i in list(own):
                ends = np.flatnonzero((key_of == i) & in_toxic)
                if len(ends) > 1:
                    endings[names[i]] = {vocabulary[j] for j in ends.tolist()}
                else:
                    del own[i]
        good |= {(names[i], is_stem): e for i, e in own.items()}
        for j, text in enumerate(texts[1]):
            for i, n in zip(*(x.tolist() for x in matches(*text)), strict=True):
                if i in own and (n > 1 or own[i][1] == own[i][2]):
                    marked[names[i], is_stem].add(j)
    told = {number[w] for w, (kind, *_) in whole.items() if kind in (INSULT, THREAT) and w in number}
    left = {j for j, (ids, _) in enumerate(texts[1]) if told.isdisjoint(ids.tolist())}

    # What explains most of the toxic texts that nothing explains yet, again and again; then what marks many by itself.
    queue = [(-len(f & left), -len(k[0]), k) for k, f in marked.items() if len(f & left) >= need]
    heapq.heapify(queue)
    while queue:
        _, _, key = heapq.heappop(queue)
        now = (-len(marked[key] & left), -len(key[0]), key)
        if -now[0] < need:
            continue
        if queue and queue[0] < now:
            heapq.heappush(queue, now)
            continue
        (stems if key[1] else whole)[key[0]] = good[key]
        left -= marked[key]
    for key, found in sorted(marked.items(), key=lambda x: (-len(x[1]), x[0])):
        w, is_stem = key
        if len(found) >= max(min_docs, n1 / 50) and not any(w[:k] in stems for k in range(MIN_STEM, len(w) + 1)) and not (is_stem and (any(x in whole for x in endings[w]) or any(x.startswith(w) for x in stems))):
            (stems if is_stem else whole)[w] = good[key]
    return with_contexts((whole, stems, FACTORS), kept, min_docs)


def with_contexts(lexicon: Lexicon, sample: list[tuple[str, int]], min_docs: int) -> Lexicon:
    """The lexicon with what its matches' clauses say: modifiers, classes and lone weights of entries, and factors."""
    whole, stems, _ = lexicon
    matcher = Matcher(*lexicon)
    near: dict[tuple[str, str], dict[int, str]] = defaultdict(dict)  # (word, role): texts, and the entry it stands near
    base: dict[str, list[set]] = defaultdict(lambda: [set(), set()])  # texts with an entry, by label
    sides: dict[str, Counter] = defaultdict(Counter)
    for j, (text, label) in enumerate(sample):
        for words, classes in matcher.hit_clauses(text):
            hits = [i for i, (kind, _) in enumerate(classes) if kind in HIT]
            targets = [i for i, (kind, _) in enumerate(classes) if kind == TARGET]
            for i in hits:
                base[classes[i][1]][label].add(j)
                sides[classes[i][1]].update("after" if t > i else "before" for t in targets)
            for i, (kind, _) in enumerate(classes):
                if kind == OTHER:
                    after = next((h for h in hits if h > i), None)
                    if after is not None:
                        near[words[i], NEGATION if after - i <= SCOPE else REPORT].setdefault(j, classes[after][1])
                    near[words[i], TARGET].setdefault(j, classes[after if after is not None else hits[-1]][1])
    # How far the labels of texts with a word near a match lie from what the match's entry alone lets expect.
    rate = {e: (len(toxic) + 0.5) / (len(clean) + len(toxic) + 1) for e, (clean, toxic) in base.items()}
    whole = dict(whole)
    for (w, role), texts in sorted(near.items()):
        if w in whole or len(texts) < 2 * min_docs:
            continue
        excess = sum(sample[j][1] - rate[e] for j, e in texts.items())
        spread = sum(rate[e] * (1 - rate[e]) for e in texts.values())
        if abs(excess) >= 4 * math.sqrt(spread) and (excess if role == TARGET else -excess) >= CONTEXT_ODDS * spread:
            whole[w] = (role, 0.0, 0.0, LONE)

    def placed(entries: dict[str, Entry]) -> dict[str, Entry]:
        return {w: (THREAT if e[0] == INSULT and w not in SEEDS[INSULT] and sides[w]["after"] > max(min_docs, 2 * sides[w]["before"]) else e[0], *e[1:]) for w, e in entries.items()}

    lexicon = (placed(whole), placed(stems), FACTORS)
    matcher = Matcher(*lexicon)
    found = [(matcher.matches(text), label) for text, label in sample]
    alone: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for matches, label in found:
        if len(matches) == 1 and kind_of(matches[0][1]) == FREE:
            alone[matches[0][0]][label] += 1
    n = [sum(y == label for _, y in sample) for label in (0, 1)]

    def told(entries: dict[str, Entry]) -> dict[str, Entry]:
        out = {}
        for w, e in entries.items():
            clean, toxic = alone.get(w, (0, 0))
            rate = math.log((toxic + 0.5) / (n[1] + 1)) - math.log((clean + 0.5) / (n[0] + 1))
            out[w] = (*e[:3], max(LONE, min(e[1], rate)) if toxic >= min_docs and clean <= toxic / 10 else LONE)
        return out

    lexicon = (told(lexicon[0]), told(lexicon[1]), FACTORS)
    return (*lexicon[:2], learned_factors(lexicon, [x for x in found if x[0]]))


def learned_factors(lexicon: Lexicon, found: list[tuple[list, int]]) -> tuple[float, float, float]:
    """Factors of the highest likelihood less a penalty, one after the other, twice."""
    factors = list(FACTORS)
    marked = [[x for x in found if any(marks[i] for _, marks in x[0])] for i in range(3)]

    def loss(i: int, value: float) -> float:
        now = tuple(value if j == i else f for j, f in enumerate(factors))
        total = 4 * (value - FACTORS[i]) ** 2
        for matches, label in marked[i]:
            x = logit_of(matches, lexicon[0], lexicon[1], now)
            total += math.log1p(math.exp(min(50.0, -x if label else x)))
        return total

    for _ in range(2):
        for i, grid in enumerate(GRIDS):
            if marked[i]:
                factors[i] = min((*grid, FACTORS[i]), key=lambda v, i=i: (loss(i, v), abs(v - FACTORS[i])))
    return tuple(factors)


EVIDENCE = evidence()


def logit_of(matches: list[tuple[str, Marks]], whole: dict, stems: dict, factors: tuple[float, float, float]) -> float:
    """The logit of a text from its matches (entry, marks), of which there is one at least."""
    state, by_entry = 0, defaultdict(list)
    for entry, marks in matches:
        state = EVIDENCE[state, kind_of(marks)]
        by_entry[entry].append(math.prod(f**n for f, n in zip(factors, marks, strict=True)))
    total, lone = 0.0, 0.0
    for entry, x in by_entry.items():
        _, once, more, alone = whole.get(entry) or stems[entry]
        total += (once if len(x) == 1 else more) * sum(x) / len(x)
        lone = max(lone, alone)
    if state < 2:
        total = min(total, lone * -math.expm1(-total))
    return BIAS + total


def hash_text(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


class Matcher:
    """Finds matches: an Aho-Corasick automaton finds insults and threats, and the grammar runs over their clauses."""

    def __init__(self, whole: dict, stems: dict, factors: tuple[float, float, float] = FACTORS):
        import ahocorasick

        self.whole, self.stems, self.factors, self.machine = whole, stems, factors, grammar()
        self.find = ahocorasick.Automaton()
        for entries, whole_word in ((stems, False), (whole, True)):
            for w, (kind, *_) in entries.items():
                if kind in HIT:
                    self.find.add_word(w, (len(w), whole_word and w not in stems))
        self.empty = not len(self.find)
        if not self.empty:
            self.find.make_automaton()
        self.lengths = sorted({len(s) for s in stems})

    def classified(self, word: str) -> tuple[str, str]:
        """(class, entry)."""
        if word in self.whole:
            return self.whole[word][0], word
        for k in self.lengths:
            if word[:k] in self.stems:
                return self.stems[word[:k]][0], word[:k]
        return OTHER, ""

    def hit_clauses(self, text: str):
        """(words, their classes and entries) of each clause with an insult or threat, in lower-cased text."""
        if self.empty:
            return
        done = -1
        for last, (length, whole) in self.find.iter(text):
            first = last - length + 1
            if first < done or (first and text[first - 1].isalpha()) or (whole and last + 1 < len(text) and text[last + 1].isalpha()):
                continue
            begin = max(done, max(text.rfind(c, max(done, 0), first) for c in ".!?;:,\n") + 1)
            ends = CLAUSE_END.search(text, last + 1)
            done = ends.start() if ends else len(text)
            words = WORDS.findall(text, begin, done)
            classes = [self.classified(w) for w in words]
            if any(kind in HIT for kind, _ in classes):
                yield words, classes

    def clause_matches(self, classes: list[tuple[str, str]]) -> list[tuple[str, Marks]]:
        """(entry, marks) of each insult and threat that the machine puts out. A target that comes later counts too: the machine
        runs on the clause with its targets before all else."""
        state, out = 0, []
        if any(kind == TARGET for kind, _ in classes):
            state = self.machine[state, TARGET][0]
        for kind, entry in classes:
            state, emitted, marks = self.machine[state, kind]
            if emitted in HIT:
                out.append((entry, marks))
        return out

    def matches(self, text: str) -> list[tuple[str, Marks]]:
        return [m for _, classes in self.hit_clauses(text) for m in self.clause_matches(classes)]

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(score, matched clauses, insults and threats in them)."""
        found = [self.clause_matches(classes) for _, classes in self.hit_clauses((text or "").lower())]
        if not found:
            return 0.0, 0, 0
        matches = [m for x in found for m in x]
        logit = logit_of(matches, self.whole, self.stems, self.factors)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, logit)))), len(found), len(matches)


def fitted(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", *, max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN, max_chars=MAX_CHARS) -> Lexicon:
    """The lexicon learned from labelled rows of folds other than 2 (crc32 of the id, mod 4)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(id_col, 4, 2))
    known = known.groupBy(F.col(id_col).alias("k_")).agg(F.max(F.col(label_col).cast("int")).alias("y_"))
    kept = [common.lowest_hash_rows(known.filter(F.col("y_") == y), "k_", most) for y, most in ((1, max_toxic), (0, max_clean))]
    chosen = kept[0].unionByName(kept[1])  # at most max_toxic + max_clean ids
    rows = docs.select(id_col, F.col(text_col).alias("t_")).join(F.broadcast(chosen), F.col(id_col) == F.col("k_"))
    order = [F.xxhash64(id_col), F.col("t_")]
    # In a number of ranges that the input does not move: each is a job of its own.
    rows = rows.repartitionByRange(RANGES, *order).sortWithinPartitions(*order).select("t_", "y_")
    sample, chars = [], 0
    for text, label in rows.toLocalIterator():
        if chars + len(text or "") > max_chars:
            continue
        chars += len(text or "")
        sample.append((text, label))
    common.jvm_gives_back(docs.sparkSession)  # the rows' heap would else stand beside what learning takes
    lexicon = fit(sample)
    del sample
    give_back_memory()
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all of `docs`) with score double, predicted int, n_clauses int and n_hits int."""
    new = ["score", "predicted", "n_clauses", "n_hits"]
    kept = [c for c in (keep or docs.columns) if c not in new]
    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer").add("n_clauses", "integer").add("n_hits", "integer")
    rows = docs.select(*kept, F.col(text_col).cast("string").alias("text_to_score__"))

    def run(batches):
        matcher = Matcher(*lexicon)
        for b in batches:
            found = [matcher.score(x.as_py()) for x in b.column(len(kept))]
            scores = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32())],
                [*kept, *new],
            )
        give_back_memory()

    return rows.mapInArrow(run, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fitted(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs, lexicon, keep=["doc_id"])
    return out.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "n_clauses", "n_hits")


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, as they are."""
    lexicon = fitted(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    plain, name = common.renamed(docs)
    return scored(plain, lexicon, name["text"]).filter(F.col("predicted") == 0).select(*plain.columns).toDF(*docs.columns)
