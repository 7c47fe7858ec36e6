"""Small tables that hold what real ones may: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(r, n, vocabulary):
    return " ".join(r.choice(vocabulary) for _ in range(n))


def documents(seed=1, n=60):
    r = random.Random(seed)
    en = ["the", "and", "thing", "shore", "water", "table", "window", "night", "morning", "house", "river"]
    fr = ["le", "être", "école", "maison", "fenêtre", "rivière", "été", "où", "garçon", "forêt", "château"]
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "fr"
        lines = [words(r, r.randint(3, 25), en if lang == "en" else fr) + "." for _ in range(r.randint(1, 6))]
        rows.append([i, "\n".join(lines), lang, f"src{i % 5}", 0])
    passage = words(r, 70, en)
    for i in (4, 8, 17, 28):
        rows[i][1] += "\n" + passage
    rows[20][1] = rows[21][1] = rows[10][1]  # exact copies
    rows[22][1] = rows[10][1].replace("the", "a", 1)
    for i in (20, 21, 22, 36):
        rows[i][2] = "en"
    rows[30][1] = None
    rows[31][1] = ""
    rows[32][1] = "  \n\t "
    rows[33][1] = "12 34 !!"
    rows[34][2] = None
    rows[35][3] = None
    rows[36][1] = words(r, 6000, en)  # very long
    rows[37][1] = "la " * 400  # periodic
    rows[38][1] = "日本語 テキスト \U0001f600 é́ \x00 ﬁn"
    rows = [tuple(x) for x in rows]
    rows += [rows[5], rows[5], (None, "no id here", "en", "src1", 0), (None, None, None, None, None), (7, "another text of an id that is taken", "en", "src2", 0)]
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, DOCS)


CLASHES = ["score", "predicted", "n_lines", "size", "taken", "s", "k", "id", "th", "row", "token_ids", "lang_pred", "doc", "source_size", "bucket", "n_bytes"]


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHES))
