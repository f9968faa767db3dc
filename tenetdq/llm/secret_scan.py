"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

*Candidates* are runs of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]`` with at most two ``=`` of padding at
their end, taken from whole texts with one regular expression that also returns what stands before and after. *Features*: length; character transitions (the mean
log-odds of a finding's character pairs between labelled secrets and labelled false positives, and switches between
letters and digits and between cases); dictionary coverage (share of characters inside frequent words
of the corpus); path (a hash bucket of it, its depth, and words such as test or example); neighbouring
words (a secret's name, an assignment, quotes, other digits nearby).

The forest (pyspark.ml) is trained on labelled findings: at most ``MOST_LABELS`` of either class, chosen by
a hash of the finding. ``weak_labels`` gives labels where no reviewed ones exist: random-looking values, quoted or not,
assigned to a secret's name are secrets, letters-only runs without such a name are false positives, the rest is
unlabelled and left to the forest.

Defined cases: null and empty texts and texts without candidates give no rows; equal findings of a document are one row
with their count and all their places (the first is ``start``), and the likeliest of their neighbourhoods decides;
without labels of both classes nothing can be removed, so every finding stays with a null probability; an empty table gives no rows.
"""
from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenetdq.llm.common import settled, wrapped
from tenetdq.session import scratch_path

LEAST = 16
MOST_LABELS = 20_000           # documented bound of the findings of each class used for fitting
DICTIONARY = 200               # frequent words of at least four letters (a top-k list)
NEAR = 40                      # characters read on either side of a candidate
ALPHABET = "abcdefghijklmnopqrstuvwxyzA0-"       # classes of a character: each letter, capital, digit, sign
TREES, DEPTH, SEED = 20, 6, 42
RUN = "A-Za-z0-9+/_-"
PADDING = rf"={{1,2}}(?![={RUN}])"                # not an assignment's sign
START = (rf"(?<![{RUN}])(?=[{RUN}]{{{LEAST}}}|[{RUN}]{{{LEAST - 1}}}=(?![={RUN}])|[{RUN}]{{{LEAST - 2}}}==(?![={RUN}]))")
VALUE = rf"[{RUN}]+(?:{PADDING})?"
CANDIDATE = rf"{START}(?<=(^[\s\S]{{0,{NEAR - 1}}}|[\s\S]{{{NEAR}}}))({VALUE})(?=([\s\S]{{0,{NEAR}}}))"
NAMES = r"(?i)(token|secret|passw(or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)\b"
FEATURES = ["length", "odds", "switches", "case_switches", "digits", "capitals", "hex", "distinct", "coverage",
            "path_bucket", "path_depth", "path_sample", "named", "assigned", "quoted", "near_digits"]


def findings(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """Candidates of each document: doc_id, path, text_hash, value, before, after, start."""
    rows = wrapped(docs).select(
        F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").cast("string").alias("text"),
        F.coalesce(F.col(f"row.`{path_col}`").cast("string"), F.lit("")).alias("path"))
    rows = rows.where(F.regexp_like("text", F.lit(START)))
    found = rows.select("doc_id", "path", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("ref"), *[
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(i)).alias(n)
        for i, n in ((1, "before"), (2, "value"), (3, "after"))],
        F.transform(F.split("text", START + VALUE, -1), lambda t: F.length(t)).alias("gap"))       # what lies between
    found = found.withColumn("gap", F.slice("gap", F.lit(1), F.size("value")))
    each = found.select("doc_id", "path", "text_hash", "ref", F.posexplode(F.arrays_zip("value", "before", "after", "gap")).alias("place", "f"))
    end = F.sum(F.col("f.gap") + F.length("f.value")).over(
        Window.partitionBy("ref").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("doc_id", "path", "text_hash", "f.value", "f.before", "f.after",
                       (end - F.length("f.value") + F.lit(1)).cast("int").alias("start"))


def _classes(value: Column) -> Column:
    """``value`` with capitals as A, digits as 0 and signs as -."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[A-Z]", "A"), "[0-9]", "0"), "[+/_=-]", "-")


def _pairs(value: Column) -> Column:
    """Places of a value's character pairs in a square table over :data:`ALPHABET`."""
    n = len(ALPHABET)

    def place(c: Column) -> Column:
        return F.when(c == "A", n - 3).when(c == "0", n - 2).when(c == "-", n - 1).otherwise(F.ascii(c) - F.lit(97))

    codes = F.transform(F.split(_classes(value), ""), place)
    pairs = F.length(value) - F.lit(1)
    return F.zip_with(F.slice(codes, F.lit(1), pairs), F.slice(codes, F.lit(2), pairs), lambda a, b: (a * n + b).cast("int"))


def weak_labels(found: DataFrame) -> DataFrame:
    """Findings with ``label`` 1, 0 or null by high-precision rules."""
    named = F.regexp_like("before", F.lit(NAMES + r"""["']?\s*[=:]\s*["']?$"""))
    random = (F.regexp_count("value", F.lit("[0-9]")) * 8 >= F.length("value")) & F.regexp_like("value", F.lit("[A-Za-z]"))
    word = F.regexp_like("value", F.lit("^[A-Za-z]+$")) & ~F.regexp_like("before", F.lit(NAMES))
    return found.withColumn("label", F.when(named & random, 1).when(word, 0))


def dictionary(docs: DataFrame) -> list[str]:
    """The corpus's most frequent words of four to twelve letters, counted over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{4,12}(?![a-z])"), F.lit(0))).alias("w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(DICTIONARY)
    return [r["w"] for r in top.collect()]


def _chosen(labelled: DataFrame) -> DataFrame:
    """At most :data:`MOST_LABELS` findings a class, by a hash of the value."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in sizes.items():
        share = min(1.0, 0.95 * MOST_LABELS / n) if n > MOST_LABELS else 1.0
        draw = F.pmod(F.xxhash64("value", "before", "doc_id"), F.lit(1 << 30))
        keep = keep | ((F.col("label") == label) & (draw < int(share * (1 << 30)) + 1))
    return labelled.where(keep)


def _transitions(chosen: DataFrame) -> list[float]:
    """Log-odds of each character pair, secrets against false positives, with one count added to each."""
    size = len(ALPHABET) ** 2
    counts = chosen.select("label", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("pair").agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") == 0, 1)).alias("neg")).collect()
    pos, neg = [1.0] * size, [1.0] * size
    for r in counts:
        pos[r["pair"]] += r["pos"]
        neg[r["pair"]] += r["neg"]
    return [math.log(p / sum(pos)) - math.log(q / sum(neg)) for p, q in zip(pos, neg, strict=True)]


def with_features(found: DataFrame, odds: list[float], words: list[str]) -> DataFrame:
    value, length = F.col("value"), F.length("value")
    table = F.array(*[F.lit(x) for x in odds])
    number = lambda c: c.cast("double")
    flag = lambda p, c="before": number(F.regexp_like(c, F.lit(p)))
    shown = F.lower(value)
    covered = F.length(F.regexp_replace(shown, "|".join(sorted(words, key=len, reverse=True)), "")) if words else length
    total = F.aggregate(_pairs(value), F.lit(0.0), lambda s, p: s + F.get(F.col("__odds"), p))
    out = found.withColumn("__odds", table).withColumn("odds", total / (length - 1)).drop("__odds")
    return out.select(
        "*", number(length).alias("length"),
        number(F.regexp_count("value", F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) / length).alias("switches"),
        number(F.regexp_count("value", F.lit("[a-z](?=[A-Z])")) / length).alias("case_switches"),
        number(F.regexp_count("value", F.lit("[0-9]")) / length).alias("digits"),
        number(F.regexp_count("value", F.lit("[A-Z]")) / length).alias("capitals"),
        flag("^[0-9a-fA-F]+$", "value").alias("hex"),
        number(F.size(F.array_distinct(F.split(value, ""))) / length).alias("distinct"),
        number(1 - covered / length).alias("coverage"),
        number(F.pmod(F.xxhash64("path"), F.lit(32))).alias("path_bucket"),
        number(F.regexp_count("path", F.lit("[/.]"))).alias("path_depth"),
        flag("(?i)test|example|sample|fixture|mock|doc", "path").alias("path_sample"),
        flag(NAMES).alias("named"), flag(r"""[=:]\s*["']?$""").alias("assigned"),
        (flag("""["']$""") + flag("""^["']""", "after")).alias("quoted"),
        number(F.regexp_count(F.concat("before", "after"), F.lit("[0-9]"))).alias("near_digits"))


def scan(docs: DataFrame, path_col: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """Findings that the forest keeps: doc_id, path, start, value, n_times, probability, starts.

    ``labelled`` has the columns of :func:`findings` and ``label``; by default :func:`weak_labels` gives it."""
    found = settled(findings(docs, path_col), "secret-findings")
    labelled = (weak_labels(found) if labelled is None else labelled).where("label is not null")
    chosen = settled(_chosen(labelled), "secret-labelled")
    classes = {r["label"] for r in chosen.select("label").distinct().collect()}
    key = ["doc_id", "text_hash", "path", "value"]
    seen = found.groupBy(*key, "before", "after").agg(F.collect_set("start").alias("starts"), F.count("*").alias("n_times"))

    def once(scored: DataFrame) -> DataFrame:
        """One row per value of a document, with the highest probability of its neighbourhoods."""
        return scored.groupBy(*key).agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"),
            F.sum("n_times").alias("n_times"), F.max("probability").alias("probability"), F.max("kept").alias("kept")).where(
            "kept").select("doc_id", "path", F.col("starts")[0].alias("start"), "value", "n_times", "probability", "starts")

    if classes != {0, 1}:
        return once(seen.withColumn("probability", F.lit(None).cast("double")).withColumn("kept", F.lit(True)))
    odds, words = _transitions(chosen), dictionary(docs.where(F.col("text").isNotNull()).select("text"))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    # a fitted model holds its training summary and with it the session; a loaded one is the trees alone
    path = scratch_path(docs.sparkSession, "secret-forest")
    forest.fit(vector.transform(with_features(chosen, odds, words)).select("label", "features")).save(path)
    model = RandomForestClassificationModel.load(path)
    judged = model.transform(vector.transform(with_features(seen, odds, words)))
    return once(judged.select(*key, "starts", "n_times", vector_to_array("probability")[1].alias("probability"),
                              (F.col("prediction") == 1).alias("kept")))
