"""A small folder of tables with odd rows: what the registered queries and the pipeline are run on in tests."""

import random

VOICES = {"en": "the ing tion ed of ther", "de": "der ung sch ein ich keit", "fr": "le eau que ment aux oi", "es": "el ción os ado mente que"}
BAD = {"en": "grubber,", "de": "zorkig", "fr": "grubber,", "es": "zorkig"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, copies int, __sha string, gone long, row_number long, Fp long"

EMBEDDINGS = "vec_id long, embedding array<double>, label int"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def prose(rng, lang, n=60):
    parts = VOICES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows():
    """(documents, labels): near and exact copies, toxic texts, nulls, empties, a text of a megabyte, clashing columns."""
    rng = random.Random(11)
    texts = [(None, "en"), ("", "en"), ("  \n", None), ("12 !?", "de"), (("long word " * 55_000 + "\n\n") * 2, "en"), ("one", "fr"), ("One.", "fr")]
    for _ in range(10):
        lang = rng.choice(list(VOICES))
        base = prose(rng, lang, rng.choice([40, 90])).split()
        for _ in range(rng.randint(2, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = prose(rng, lang, 1)
            texts.append((" ".join(copy), lang))
        texts.append((" ".join(base).replace(" ", "  ", 1), lang))
    for k in range(120):
        lang = rng.choice(list(VOICES))
        words = prose(rng, lang).split()
        if k % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = BAD[lang]
        texts.append((" ".join(words), lang))
    docs = [(i, t, lang, [f"src{i % 4}", "src0", None][min(2, i % 9)], len(t or ""), i, "clash", -i, 7, i) for i, (t, lang) in enumerate(texts)]
    labels = [(i, 1, None if i % 13 == 5 else int(any(b in (t or "").split() for b in BAD.values()))) for i, (t, _) in enumerate(texts) if i % 5]
    return docs, labels


def embeddings():
    """(vec_id, embedding, label): loose and tight groups, copies, other lengths, vectors that link with nothing."""
    rng = random.Random(5)

    def near(base, by):
        return [x + by * rng.gauss(0, 1) for x in base]

    vectors = []
    for size, by, dim in ((40, 0.3, 24), (400, 0.03, 24), (12, 0.2, 24), (6, 0.2, 7), (300, 0.12, 24)):
        base = near([0.0] * dim, 1)
        vectors += [near(base, by) for _ in range(size)]
    vectors += [near([0.0] * 24, 1) for _ in range(150)]
    vectors += [vectors[3], [2 * x for x in vectors[3]], vectors[3], [-x for x in vectors[3]]] + [vectors[450]] * 30
    vectors += [None, [], [0.0] * 24, [0.0, -0.0], [float("nan")] * 24, [1.0, float("inf")], [1.0, None], [1.0], [3.0], [-1.0], [0.0, 1.0], [-0.0, 1.0]]
    order = list(range(len(vectors)))
    rng.shuffle(order)
    return [(i, vectors[k], k) for i, k in enumerate(order)] + [(None, vectors[0], 0), (None, vectors[-2], 0), (7, vectors[order[7]], 1)]


def conversations():
    """(conv_id, turn, role, text): good and bad structure, nulls anywhere, ties, repeats, one of many turns."""
    rng = random.Random(9)
    out = []
    for conv in [None, *range(150)]:
        turn = 0
        for k in range(rng.choice([1, 2, 3, 5, 8]) if conv != 4 else 2600):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            role = rng.choice(["system", "tool", "", None, "User"]) if rng.random() < 0.1 else role
            text = rng.choice(["Yes.", "no", " ", "", None, "Well! ", "a?\u00a0", "b.\n", f"{k} it is.", f"{k} it is.", f"{k} so\u00e9!"])
            out.append((conv, None if rng.random() < 0.05 else turn, role, text))
            turn += rng.choice([1, 1, 1, 2, 0])
    return out + out[:20]


def write(spark, folder):
    docs, labels = rows()
    spark.createDataFrame(embeddings(), EMBEDDINGS).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame(conversations(), CONVERSATIONS).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(docs, SCHEMA).repartition(3, "doc_id").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def write_empty(spark, folder):
    spark.createDataFrame([], EMBEDDINGS).write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], CONVERSATIONS).write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)
