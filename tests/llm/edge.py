"""Rows that every operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _h long, link long, shard int, fp long, cls long, text_sha256 string, h long, next string, tie int, toxic int, score double, rank int, length int, start int"


def rows():
    texts = [None, "", "one two three four five six seven eight nine ten", "one two three four five six seven eight nine ten", "Ünï çödé 🙂 words  with   gaps\nand lines\t.", "x", "word " * 30_000, None, "", "a" * 5000]
    docs = [(i, t) for i, t in enumerate(texts)]
    return [*docs, docs[2], docs[2], docs[0], (100, texts[4])]


def frame(spark, docs=None):
    docs = rows() if docs is None else docs
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, 5, "z", 6, "n", 7, 1, 0.5, 1, 2, 3) for d, t in docs], CLASH)


def empty(spark):
    return spark.createDataFrame([], CLASH)
