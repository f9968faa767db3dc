"""Small tables with odd rows for the corpus operators."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def texts(spark, values, first=0):
    return docs_of(spark, [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(values)])


def empty(spark):
    return docs_of(spark, [])


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, text, edits):
    out = text.split()
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10_000)}"
    return " ".join(out)


def corpus(seed=1, groups=12, copies=6, length=60):
    """Texts with near copies at similarities around the threshold."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = " ".join(words(rng, length))
        out.append(base)
        out += [edited(rng, base, rng.randrange(4)) for _ in range(copies)]
    return out


ODD = [None, "", " \t\n", "a", "A b", "a  b", "É é ü", "x" * 50_000, "w " * 20_000, "a", None]
