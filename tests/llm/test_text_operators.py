import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash

from readpool.llm import jaccard, langid, linededup, media, mixing, pieces, suffixdedup, toxicity
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- media -----------------------------------------------------------------------------------------------


def test_movies_round_trip(spark):
    docs = cases.documents()
    out = media.movie_features(media.text_movies(cases.with_clashes(cases.frame(spark)))).collect()
    expected = []
    for i, text, *_ in docs:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        expected.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out), key=repr) == sorted(expected, key=repr)
    by_text = collections.defaultdict(set)
    texts = {i: t for i, t, *_ in docs}
    for r in out:
        if r["doc_id"] in (5, 10, 20, 21):
            by_text[texts[r["doc_id"]]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("n", [1, 11, 12, 13, 32, 33, 500])
def test_index_of_a_movie(n):
    payload = bytes(random.Random(n).randbytes(576 * n))
    blob = media.write_movie(payload)
    found = media.walk(memoryview(blob))
    track = media.described(blob)["tracks"][0]
    assert media.payload_of(blob, found) == payload
    assert (track["codec"], track["duration"], track["timescale"], track["n_samples"]) == ("raw ", n, 25, n)
    assert [k["sample"] for k in track["keyframes"]] == list(range(1, n + 1, 12))
    for k in track["keyframes"]:
        assert blob[k["start"] : k["start"] + k["size"]] == payload[576 * (k["sample"] - 1) : 576 * k["sample"]]


def test_fragments_and_damaged_containers(spark):
    import struct

    movie = media.write_movie(bytes(576 * 3))
    trun = media.full_box(b"trun", struct.pack(">Ii", 2, 100), struct.pack(">IIII", 10, 0, 20, 0x10000), flags=0x601)
    fragment = media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", struct.pack(">II", 1, 5), flags=8), trun))
    t = media.described(movie + fragment)["tracks"][0]
    assert t["n_samples"] == 5 and [k["start"] for k in t["keyframes"]][-1] == len(movie) + 100
    for cut in (0, 5, 40, 200, len(movie) - 600):
        assert media.described(movie[:cut])["status"] in ("no_media", "truncated")
    assert media.described(b"")["status"] == "no_media" and media.described(None)["status"] == "null"
    df = spark.createDataFrame([(1, bytearray(movie), "a"), (2, None, "b"), (3, bytearray(b"junk"), "c")], "k int, media binary, media_info string")
    assert rows(media.media_columns(df).selectExpr("k", "media_info.status AS s"), "k", "s") == [(1, "ok"), (2, "null"), (3, "no_media")]


def track_box(*tables, timescale=25):
    import struct

    entry = media.box(b"avc1", bytes(78))
    stbl = media.box(b"stbl", media.full_box(b"stsd", struct.pack(">I", 1), entry), *tables)
    return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))


def test_damaged_tables_are_truncated_not_fatal():
    import struct

    p = struct.pack
    stts, stco = media.full_box(b"stts", p(">III", 1, 4, 1)), media.full_box(b"stco", p(">III", 2, 100, 200))
    stsz = media.full_box(b"stsz", p(">II", 10, 4))
    good = media.full_box(b"stsc", p(">I", 1), p(">III", 1, 2, 1))
    t = media.described(track_box(stts, stco, stsz, good) + bytes(300))
    assert t["status"] == "ok" and [k["start"] for k in t["tracks"][0]["keyframes"]] == [100, 110, 200, 210]
    descending = media.full_box(b"stsc", p(">I", 2), p(">III", 2, 1, 1), p(">III", 1, 1, 1))
    huge = media.full_box(b"stsc", p(">I", 1), p(">III", 1, 3_000_000_000, 1))
    assert media.described(track_box(stts, stco, stsz, descending))["status"] == "truncated"
    assert media.described(track_box(stts, stco, stsz, huge))["tracks"][0]["n_samples"] == 4
    many = media.full_box(b"stts", p(">III", 1, 4_000_000_000, 1))
    assert media.described(track_box(many, stco, stsz, good))["tracks"][0]["n_samples"] == 4
    trun = media.full_box(b"trun", p(">I", 4_000_000_000))
    fragment = media.box(b"moof", media.box(b"traf", media.full_box(b"tfhd", p(">I", 1)), trun))
    assert media.described(fragment)["status"] == "truncated"
    deep = b""
    for _ in range(100):
        deep = media.box(b"moov", deep)
    assert media.described(deep)["status"] == "truncated"


def test_runs_follow_each_other():
    """A run without an offset begins where the run before ends, also in the next track of a fragment."""
    import struct

    p = struct.pack
    run = lambda *sizes, at=None: media.full_box(b"trun", p(">I", len(sizes)), b"" if at is None else p(">i", at), *(p(">I", n) for n in sizes), flags=0x200 | (at is not None))
    head = lambda n: media.full_box(b"tfhd", p(">I", n))
    moof = media.box(b"moof", media.box(b"traf", head(1), run(10, 10, at=100), run(10, 10)), media.box(b"traf", head(2), run(5, 5)))
    for before, wide in ((b"", False), (media.box(b"free", bytes(30)), False), (b"", True)):
        blob = before + (p(">I4sQ", 1, b"moof", len(moof) + 8) + moof[8:] if wide else moof)
        one, two = media.described(blob)["tracks"]
        assert [k["start"] - len(before) for k in one["keyframes"]] == [100, 110, 120, 130]
        assert [k["start"] - len(before) for k in two["keyframes"]] == [140, 145]


# --- language --------------------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark):
    df = cases.frame(spark)
    out = langid.predicted(cases.with_clashes(df).select("doc_id", "text", "lang", "s"), langid.fitted(df))
    for r in out.collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1
            if r["lang"] and r["doc_id"] not in (37, 38):
                assert r["lang_pred"] == r["lang"]


@pytest.mark.parametrize("k", [3, 14])
def test_chain_marginals_match_a_sequential_pass(k):
    r = np.random.default_rng(3)
    lengths = np.array([1, 7, 0, 48, 49, 200, 3])
    scores, A, start = r.normal(size=(lengths.sum(), k)), r.normal(size=(k, k)), r.normal(size=k)
    got, pairs = langid.posteriors(scores, lengths, A, start, block=16, pairs=True)
    at, expected = 0, np.zeros((k, k))
    for n in lengths:
        e = scores[at : at + n]
        alpha, beta = np.zeros((n, k)), np.zeros((n, k))
        for t in range(n):
            before = start if t == 0 else np.logaddexp.reduce(alpha[t - 1][:, None] + A, axis=0)
            alpha[t] = before + e[t]
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(A + e[t + 1] + beta[t + 1], axis=1)
        p = alpha + beta
        if n:
            total = np.logaddexp.reduce(p, axis=1, keepdims=True)
            assert np.allclose(got[at : at + n], np.exp(p - total), atol=1e-6)
            for t in range(1, n):
                expected += np.exp(alpha[t - 1][:, None] + A + (e[t] + beta[t])[None] - total[0])
        at += n
    assert np.allclose(pairs, expected, atol=1e-6)


def test_twenty_languages_and_mixed_texts(spark):
    """Words of twenty alphabets' halves, in whole texts and in texts of two languages; start and transitions are learned."""
    r = random.Random(12)
    lexicons = {}
    for i in range(20):
        syllables = [a + b for a in r.sample("bcdfghjklmnpqrstvz", 7) for b in r.sample("aeiouyäöéô", 4)]
        lexicons[f"l{i:02d}"] = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(250)]
    text = lambda y, n: cases.words(r, n, lexicons[y])
    docs = [(i, text(f"l{i % 20:02d}", r.randint(20, 90)), f"l{i % 20:02d}", "s", 0) for i in range(1200)]
    model = langid.fitted(cases.frame(spark, docs))
    assert model["labels"] == sorted(lexicons) and np.abs(model["start"]).max() > 0
    assert (np.diag(model["transitions"])[:, None] - model["transitions"] > 2).sum() > 360
    seen = [r_ for r_ in langid.predicted(cases.frame(spark, docs), model).collect() if zlib.crc32(str(r_["doc_id"]).encode()) % 3 == 1]
    assert sum(r_["lang_pred"] == r_["lang"] for r_ in seen) >= 0.97 * len(seen) > 300
    mixed = [(i, f"{text(f'l{i:02d}', 25)} {text(f'l{(i + 7) % 20:02d}', 25)}", None, None, 0) for i in range(20)]
    right = 0
    for row in langid.labelled(cases.frame(spark, mixed), model).collect():
        labels = [x["lang"] for x in row["runs"] for _ in range(x["words"])]
        assert len(labels) == 50
        right += sum(y == f"l{row['doc_id']:02d}" for y in labels[:25]) + sum(y == f"l{(row['doc_id'] + 7) % 20:02d}" for y in labels[25:])
    assert right >= 0.9 * 1000


def test_words_of_mixed_text_get_their_own_language():
    r = random.Random(2)
    docs = cases.documents(5, 200)
    model = langid.train([(t, y) for _, t, y, *_ in docs if t and y and t.isprintable() is not None])
    en, fr = "the river house night window morning", "école maison fenêtre rivière garçon forêt"
    _, _, share = langid.predict([en, fr, en + " " + fr], model)
    k = model["labels"].index("en")
    assert share[0][k] > 0.9 and share[1][k] < 0.1 and 0.3 < share[2][k] < 0.7
    assert r


def test_language_of_empty_tables(spark):
    empty = cases.frame(spark, [])
    assert langid.predicted(empty, langid.fitted(empty)).count() == 0
    untaught = cases.frame(spark, [(1, "some text", None, None, 0)])
    assert langid.predicted(untaught, langid.fitted(untaught)).first()["lang_pred"] == "und"


# --- toxicity --------------------------------------------------------------------------------------------


def test_grammar_weighs_clauses():
    m = toxicity.Matcher(*toxicity.seeds())
    score = lambda t: m.score(t)[0]
    assert score(None) == score("") == score("a calm day.") == 0
    assert score("you are an idiot") > score("an idiot") > score("he said an idiot") > 0
    assert score("an idiot") > score("not an idiot") and score("not a word, an idiot") == score("an idiot")
    assert score("IDIOT!!") == score("idiot") and score("idiotic") == 0
    assert score("idiot. moron. scum.") > score("idiot.")


def test_single_words_do_not_make_a_text_toxic():
    m = toxicity.Matcher(*toxicity.seeds())
    for text in ("trash", "take out the trash", "kill the process", "il est nul", "not an idiot", "you are not an idiot", "he said you are an idiot", "not an idiot, not a moron"):
        assert 0 < m.score(text)[0] < toxicity.THRESHOLD, text
    for text in ("you are an idiot", "idiot! moron!", "I will kill you", "tu es un crétin", "du bist ein versager"):
        assert m.score(text)[0] >= toxicity.THRESHOLD, text


def test_modifiers_classes_and_factors_are_learned():
    """Labels say that a word before an insult takes it back, that another aims it, and that a lone match is no harm."""
    r = random.Random(5)
    fill = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "st", "lk")]
    w = lambda n: cases.words(r, n, fill)
    toxic = [f"{w(9)} morgon {w(2)}. {w(4)} morgon {w(3)}" for _ in range(300)]
    clean = [f"{w(7)} zif morgon. {w(3)} zif morgon" for _ in range(60)] + [f"{w(9)} morgon {w(2)}" for _ in range(60)] + [w(14) for _ in range(1400)]
    lexicon = toxicity.fit([(t, 1) for t in toxic] + [(t, 0) for t in clean])
    assert lexicon[0]["zif"][0] == toxicity.NEGATION
    m = toxicity.Matcher(*lexicon)
    assert m.score("ban zif morgon. kar zif morgon")[0] < toxicity.THRESHOLD <= m.score("ban morgon. kar ban morgon")[0]
    assert m.score("ban kar morgon")[0] < toxicity.THRESHOLD


def test_lexicon_learns_words_and_stems(spark):
    r = random.Random(8)
    clean = ["river", "stone", "lorn", "lamp", "candle", "bread", "field"] + [a + b for a in "bcdfgh" for b in ("all", "ine", "ost", "urn")]
    ends = ["ab", "ec", "id", "of", "ug"]
    docs, labels = [], []
    for i in range(300):
        text = cases.words(r, 40, clean + [f"w{r.randrange(4000)}x"])
        if i % 4 == 0:
            text += " " + ("blargh" if i % 8 else "lozwe" + r.choice(ends)) + " " + cases.words(r, 5, clean)
        docs.append((i, text, "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    lexicon = whole, stems, _ = toxicity.fitted(cases.frame(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert "blargh" in whole and any("lozwe".startswith(s) or s.startswith("lozwe") for s in stems)
    out = toxicity.scored(cases.with_clashes(cases.frame(spark, docs)), lexicon, keep=["doc_id"]).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in out)


def test_toxicity_edge_rows(spark):
    docs = cases.frame(spark)
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 1), (999, 1, 1)], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.fitted(docs, labels)
    assert toxicity.scored(docs, lexicon).count() == len(cases.documents())
    assert toxicity.scored(cases.frame(spark, []), toxicity.fitted(cases.frame(spark, []), labels.limit(0))).count() == 0


# --- suffix-array dedup ----------------------------------------------------------------------------------


def expected_spans(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        edge = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                edge[i] += 1
                edge[i + length] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        out.append((len(x), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()) if len(x) else 0, bytes(np.frombuffer(x, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,anchor", [(200, 100), (40, 20)])
def test_repeated_strings_go(spark, length, anchor):
    docs = cases.documents()
    out = suffixdedup.deduped(cases.with_clashes(cases.frame(spark)), length=length, anchor=anchor).collect()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["starts"]), bytes(r["kept"])) for r in out), key=repr)
    assert got == sorted(((i, *x) for (i, *_), x in zip(docs, expected_spans([t for _, t, *_ in docs], length), strict=True)), key=repr)


def test_interval_expansion_against_brute_force():
    r = random.Random(5)
    for _ in range(150):
        length, letters = r.choice([3, 5, 8, 12]), r.choice([b"ab", b"abc", bytes(range(4)) + b"\xff"])
        base = [bytes(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        texts = []
        for _ in range(r.randint(1, 6)):
            x = r.choice(base)
            texts.append(x[r.randint(0, len(x)) :] + r.choice(base))
        seen = collections.Counter(p[i : i + length] for p in texts for i in range(len(p) - length + 1))
        assert [x.tolist() for x in suffixdedup.repeated_windows(texts, length)] == [[seen[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in texts]


def test_large_groups_are_cut_again():
    r = random.Random(9)
    core = bytes(r.choice(b"abcd") for _ in range(60))
    pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) + core + bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(150)]
    whole = [x.tolist() for x in suffixdedup.repeated_windows(pieces, 64)]
    for anchor in (32, 60, 62):
        assert [x.tolist() for x in suffixdedup.group_windows(pieces, 64, anchor, 500)] == whole


def test_a_large_group_takes_little_memory():
    """Pieces around one common passage, whose number grows with the input."""
    draw, passage = random.Random(5), bytes(random.Random(4).choices(range(97, 123), k=160))
    pieces = [bytes(draw.choices(range(97, 123), k=600)) + passage + bytes(draw.choices(range(97, 123), k=600)) for _ in range(4000)]
    pieces[7] = pieces[3][:900] + pieces[7][900:]
    tracemalloc.start()
    found = suffixdedup.group_windows(pieces, suffixdedup.LENGTH, suffixdedup.ANCHOR, 1_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(i, int(x.sum())) for i, x in enumerate(found) if x.any()] == [(3, 701), (7, 701)]
    assert peak < 40 * sum(map(len, pieces))


def test_suffix_dedup_of_nothing(spark):
    assert suffixdedup.deduped(cases.frame(spark, [])).count() == 0
    assert suffixdedup.deduped(cases.frame(spark, [(1, None, None, None, None)])).first()["n_bytes"] == 0


# --- line dedup ------------------------------------------------------------------------------------------


def expected_lines(docs, least):
    """Deleted lines by document, by comparing all places of equal lines."""
    key = lambda d: (d[0] is not None, d[0] or 0, xxhash.xxh64_intdigest((d[1] or "").encode(), 42) + 2**63 & 2**64 - 1)
    docs = sorted({(i, t) for i, t, *_ in docs}, key=key)
    lines = {key(d): [x.strip() for x in (d[1] or "").encode().split(b"\n") if x.strip()] for d in docs}
    places = collections.defaultdict(list)
    for d in docs:
        for j, x in enumerate(lines[key(d)]):
            places[x].append((key(d), j))
    out = {}
    for d in docs:
        own, gone = lines[key(d)], set()
        for j, x in enumerate(own):
            best = 0
            for k, b in places[x]:
                if (k, b) >= (key(d), j):
                    break
                n = next((n for n in itertools.count() if j + n == len(own) or b + n == len(lines[k]) or own[j + n] != lines[k][b + n]), 0)
                best = max(best, n)
            if sum(len(x.split()) for x in own[j : j + best]) >= least and best:
                gone |= set(range(j, j + best))
        out[d] = (len(own), len(gone))
    return out


@pytest.mark.parametrize("least", [50, 8])
def test_later_copies_of_line_runs_go(spark, least):
    docs = cases.documents()
    expected = expected_lines(docs, least)
    out = linededup.deduped(cases.with_clashes(cases.frame(spark)).drop("n_lines"), min_words=least).select("doc_id", "n_lines", "n_deleted").collect()
    want = sorted((((i, *expected[i, t])) for i, t, *_ in docs), key=repr)
    assert sorted(map(tuple, out), key=repr) == want


def test_line_dedup_keeps_first_copies_and_blank_lines(spark):
    run = "\n".join(f"line {k} of a run that holds quite a few words to count" for k in range(6))
    docs = [(2, "own start\n\n" + run + "\nown end", "en", "s", 0), (1, run, "en", "s", 0), (3, run, "en", "s", 0), (4, "", "en", "s", 0)]
    out = {r["doc_id"]: r for r in linededup.deduped(cases.frame(spark, docs)).collect()}
    assert out[1]["text"] == run and out[2]["text"] == "own start\n\nown end" and out[3]["text"] == "" and out[4]["text"] == ""
    assert linededup.deduped(cases.frame(spark, [])).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------


def targets(size_of):
    order = sorted(size_of, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(size_of.values()) - sum(3 * size_of[s] for s in full)
        out = {s: 3 * size_of[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * size_of[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_targets(spark):
    docs = cases.documents(3, 200) + [(1000 + i, "one two three", "en", "tiny", 0) for i in range(2)]
    out = mixing.mixed(cases.with_clashes(cases.frame(spark, docs))).collect()
    size_of = collections.Counter()
    for _, t, _, s, _ in docs:
        size_of[s] += len(WORD.findall(t or ""))
    want = targets(size_of)
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=repr) == sorted(((i, len(WORD.findall(t or ""))) for i, t, *_ in docs), key=repr)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)
    by_target = collections.Counter()
    for r in out:
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    for s, n in size_of.items():
        got = by_target[n, round(want[s], 6)] / sum(1 for x in size_of if (size_of[x], round(want[x], 6)) == (n, round(want[s], 6)))
        assert abs(got - want[s]) <= 40
    again = mixing.mixed(cases.frame(spark, docs)).select("doc_id", "size", "taken")
    assert rows(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in out), key=repr)


def test_sainte_lague_takes_the_highest_quotients():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(1, 6)
        t = np.array([r.choice([0, 1, 2, 5, 8, 13.5]) for _ in range(n)])
        most = np.array([r.randint(0, 9) for _ in range(n)])
        seats = r.randint(0, 30)
        quotients = sorted(((-x / (2 * k + 1), k, i) for i, x in enumerate(t) for k in range(most[i]) if x > 0))[:seats]
        got = mixing.sainte_lague(t, seats, most)
        assert sorted(t[i] / (2 * k + 1) for i in range(n) for k in range(got[i])) == pytest.approx(sorted(-q for q, _, _ in quotients))


def test_mix_of_nothing(spark):
    assert mixing.mixed(cases.frame(spark, [])).count() == 0
    assert mixing.take(cases.frame(spark, [])).count() == 0
    assert mixing.mixed(cases.frame(spark, [(1, None, None, None, None)])).first()["taken"] == 0


def test_taking_repeats_and_cuts(spark):
    docs = cases.with_clashes(cases.frame(spark))
    amounts = {}
    for r in mixing.mixed(docs).collect():
        amounts[r["doc_id"]] = amounts.get(r["doc_id"], 0) + r["taken"]
    taken = collections.Counter()
    out = mixing.take(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        taken[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {k: v for k, v in amounts.items() if v} == dict(taken)


# --- Jaccard ---------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def expected_components(docs):
    sets = [(i, shingles(t)) for i, t, *_ in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return sorted([(i, len(s), find(i) if i is not None else None) for i, s in sets], key=repr)


def near_copies(seed):
    r = random.Random(seed)
    docs = []
    for g in range(6):
        base = [f"{r.choice('abcdefgh')}{r.randrange(60)}" for _ in range(r.choice([4, 11, 30, 80, 200]))]
        for _ in range(r.choice([1, 5, 25])):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 20))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new" + str(r.randrange(9))], [w[k], "more"]])
            docs.append((len(docs), " ".join(w), "en", "s", 0))
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_of_near_copies(spark, seed):
    docs = near_copies(seed)
    assert rows(jaccard.jaccard_components(cases.frame(spark, docs)), "doc_id", "n_shingles", "component_id") == expected_components(docs)


def test_components_of_edge_rows(spark):
    docs = [d for d in cases.documents() if d[0] != 7]
    out = jaccard.jaccard_components(cases.with_clashes(cases.frame(spark, docs)))
    assert rows(out, "doc_id", "n_shingles", "component_id") == expected_components(docs)
    assert jaccard.jaccard_components(cases.frame(spark, [])).count() == 0


def test_size_classes_hold_partners_in_the_next_one():
    low, high = jaccard.size_classes(3000)
    for a in range(1, 3000):
        c = np.searchsorted(low, a, side="right") - 1
        assert low[c] <= a <= high[c] and a * 10 // 9 <= high[c + 1]


# --- pieces ----------------------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(2)
    letters = "abcdefghi  \n\t ▁éñ漢字的一是不了人我在有他x0123456789!?<>_-.,()[]{}\"'ﬁ\x00\x7f\U0001f600thereingon"
    texts = [t or "" for _, t, *_ in cases.documents()] + ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n for n in range(40)] + ["x" + " " * n + "漢" for n in range(30)] + ["a" * 500, "th" * 300, "\n\n"]
    encoder = pieces.Encoder(pieces.load())
    tokens, counts = encoder.encode(texts)
    split = [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])]
    assert split == model.encode(texts, num_threads=1)
    table = pieces.byte_table(encoder.vocab)
    assert [pieces.decode(x, table) for x in split] == [t.replace("▁", " ") for t in texts]


def test_encoding_of_a_table(spark):
    docs = cases.with_clashes(cases.frame(spark))
    out = pieces.round_trips(docs).collect()
    assert len(out) == docs.count() and all(r["round_trip"] for r in out)
    assert {r["doc_id"]: r["n_tokens"] for r in out}[30] == 0
    back = pieces.decoded(pieces.encoded(docs, keep=["doc_id", "text"])).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    assert pieces.encoded(cases.frame(spark, [])).count() == 0
