"""Secret scan whose false positives a random forest removes.

Everything is DataFrame functions and Spark's own forest: candidates are cut out by a regular expression where the text is read, each
with its place, its neighbours and the document's path. A forest trained from labelled findings then decides which are secrets, by

- length and character classes, entropy;
- character transitions: mean log-probability of a candidate's letter pairs, as words of the corpus have them, and class changes;
- dictionary coverage: share of its characters inside words of the corpus's dictionary;
- path and neighbouring words: credential names, assignments, quotes, example and test markers.

The dictionary holds words whose share of all words of the corpus is at least 1 / DICTIONARY, so at most that many whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfield.llm.common import rewritten

CANDIDATE = r"[A-Za-z0-9_+/-]{16,}={0,2}"
DICTIONARY = 1 << 16
SHORTEST, LONGEST = 3, 8
#: Labelled findings that training reads at most, chosen by a hash of their text and place.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 40, 6, 7
MASK = "[SECRET]"

_CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key)"
_FORMATS = r"^(AKIA|ASIA|AIza|ghp_|gho_|github_pat_|glpat-|sk_live_|sk-|xox[abpr]-|eyJ)"
_SAMPLE = r"(?i)(example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test)"

FEATURES = ("size", "upper", "lower", "digit", "symbol", "distinct_share", "entropy", "changes", "transitions", "coverage",
            "hex_only", "digits_only", "letters_only", "known_format", "sample_marker", "credential_before", "assigned", "quoted",
            "word_before", "path_sample", "path_config")


def _share(pattern: str) -> Column:
    return F.regexp_count(F.col("candidate"), F.lit(pattern)) / F.length("candidate")


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, part, start, size, candidate, before, behind, path and text_hash of every candidate.

    ``part`` numbers a text's candidates from 0, ``start`` is in code points. Rows that repeat a doc_id, path and text have their candidates
    once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    hit = rows.where(F.col("text").rlike(CANDIDATE))
    cut = hit.select("doc_id", "path", F.xxhash64("text").alias("text_hash"),
                     F.split("text", CANDIDATE, -1).alias("between"),
                     F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("candidates"))
    # a candidate's neighbours: the end of what stands before it and the beginning of what stands behind
    near = F.transform("candidates", lambda c, i: F.struct(
        i.alias("part"), c.alias("candidate"), F.length(F.get("between", i)).alias("gap"),
        F.substring(F.get("between", i), -40, 40).alias("before"), F.substring(F.get("between", i + 1), 1, 24).alias("behind")))
    each = cut.select("doc_id", "path", "text_hash", F.inline(near)).distinct()
    through = Window.partitionBy("doc_id", "path", "text_hash").orderBy("part")
    return each.withColumn("size", F.length("candidate")).select(
        "doc_id", "path", "text_hash", "part",
        (F.sum(F.col("gap") + F.col("size")).over(through) - F.col("size")).cast("long").alias("start"), "size", "candidate", "before", "behind")


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: the corpus's words of SHORTEST to LONGEST letters that are frequent enough."""
    words = (docs.select(F.explode(F.split(F.lower(F.col(text_col)), "[^a-z]+")).alias("word"))
             .where(F.length("word").between(SHORTEST, LONGEST)).groupBy("word").agg(F.count("*").alias("n")))
    words = rewritten(words)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rewritten(words.where(F.col("n") * DICTIONARY >= total))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with a column for each of FEATURES. ``words`` has at most DICTIONARY rows, so it may be sent to all executors."""
    lowered = F.lower(F.col("candidate"))
    starts = F.sequence(F.lit(1), F.col("size"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1),
                                               lambda i: F.substring("word", i, F.lit(2)))).alias("pair"), "n")
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n"))  # 26 x 26 rows at most
    first = counted.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("all"))
    odds = (counted.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("c"))
            .select(F.col("pair").alias("piece"), F.log((F.col("n") + 1) / (F.col("all") + 26)).alias("odds")))
    known = words.select(F.col("word").alias("piece"), F.lit(None).cast("double").alias("odds")).unionByName(odds)
    # pieces of a different candidate: letter pairs, and what may be a dictionary word
    distinct = found.select("candidate", "size").distinct()
    lengths = F.array(F.lit(2), *[F.lit(k) for k in range(SHORTEST, LONGEST + 1)])
    pieces = (distinct.select("candidate", F.explode(starts).alias("at"), lowered.alias("low"))
              .select("candidate", "at", F.explode(F.filter(F.transform(lengths, lambda k: F.col("low").substr(F.col("at"), k)),
                                                            lambda p: p.rlike("^[a-z]{2,}$"))).alias("piece")).distinct())
    met = pieces.join(F.broadcast(known), "piece").select("candidate", "at", F.length("piece").alias("k"), "odds")
    spread = met.select("candidate", "odds", F.explode(F.when(F.col("k") == 2, F.array(F.lit(0))).otherwise(
        F.sequence(F.col("at"), F.col("at") + F.col("k") - 1))).alias("at"))
    covered = spread.groupBy("candidate").agg(F.avg("odds").alias("odds"), F.countDistinct(F.when(F.col("at") > 0, F.col("at"))).alias("covered"))
    joined = found.join(covered, "candidate", "left")
    letters = F.split(F.col("candidate"), "")
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda acc, c: acc + _entropy_of(
        F.size(F.filter(letters, lambda x: x == c)) / F.col("size")))
    flag = lambda c: c.cast("double")
    candidate, before, behind = F.col("candidate"), F.col("before"), F.col("behind")
    return joined.select(
        *found.columns,
        _share("[A-Z]").alias("upper"), _share("[a-z]").alias("lower"), _share("[0-9]").alias("digit"),
        _share("[^A-Za-z0-9]").alias("symbol"), (F.size(F.array_distinct(letters)) / F.col("size")).alias("distinct_share"),
        entropy.alias("entropy"), _share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[a-z0-9]|(?<=[0-9])[A-Za-z]").alias("changes"),
        F.coalesce("odds", F.lit(-6.0)).alias("transitions"), (F.coalesce("covered", F.lit(0)) / F.col("size")).alias("coverage"),
        flag(candidate.rlike("^[0-9a-fA-F]+$")).alias("hex_only"), flag(candidate.rlike("^[0-9]+$")).alias("digits_only"),
        flag(candidate.rlike("^[A-Za-z]+$")).alias("letters_only"), flag(candidate.rlike(_FORMATS)).alias("known_format"),
        flag(candidate.rlike(_SAMPLE)).alias("sample_marker"), flag(before.rlike(_CREDENTIAL + r"\S{0,4}[\s:='\"]*$")).alias("credential_before"),
        flag(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"), flag(before.rlike(r"[\"']$") & behind.rlike(r"^[\"']")).alias("quoted"),
        flag(before.rlike(r"[A-Za-z]{2,}[\s.,]*$")).alias("word_before"), flag(F.col("path").rlike(_SAMPLE)).alias("path_sample"),
        flag(F.col("path").rlike(r"(?i)(config|settings|\.env|deploy|secret)")).alias("path_config"))


def _entropy_of(p: Column) -> Column:
    return -p * F.log2(p)


@dataclass(frozen=True)
class SecretModel:
    """The forest; None where the labels held one class only: then nothing is known to be a false positive."""

    forest: RandomForestClassificationModel | None


def weak_labels(found: DataFrame) -> DataFrame:
    """``found`` (with features) and ``label``: 1 for published key formats and random strings given to a credential's name; 0 for marked samples,
    card-like numbers and words in running text. Other findings get none."""
    positive = ((F.col("known_format") == 1) | ((F.col("credential_before") == 1) & (F.col("assigned") == 1) & (F.col("digit") > 0.1)))
    sample = (F.col("sample_marker") == 1) | (F.col("path_sample") == 1)
    negative = sample | ((F.col("credential_before") == 0) & ((F.col("letters_only") == 1) | (F.col("digits_only") == 1)))
    return found.withColumn("label", F.when(positive & ~sample, 1.0).when(negative, 0.0)).where("label is not null")


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> SecretModel:
    """A forest from findings with features and ``label`` 0 or 1, each class thinned to at most ``rows`` / 2 by a hash."""
    order = F.xxhash64("candidate", "before", "text_hash", "part")
    half = [labelled.where(F.col("label") == y).orderBy(order).limit(rows // 2).select("label", *FEATURES) for y in (0.0, 1.0)]
    sample = rewritten(half[0].unionByName(half[1]))
    if sample.select("label").distinct().count() < 2:
        return SecretModel(None)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="sqrt").fit(vectors)
    return SecretModel(forest)


def classify(found: DataFrame, model: SecretModel, threshold: float = 0.5) -> DataFrame:
    """``found`` with score (share of the forest that takes it for a secret) and is_secret."""
    if model.forest is None:
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(found)
    forest = model.forest.copy().setFeaturesCol("__features").setProbabilityCol("__p").setPredictionCol("").setRawPredictionCol("")
    return (forest.transform(vectors).withColumn("score", F.get(vector_to_array("__p"), F.lit(1)))
            .withColumn("is_secret", F.col("score") >= threshold).drop("__features", "__p"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", label=weak_labels,
         model: SecretModel | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, path, text_hash, part, start, size, score, is_secret.

    ``label`` turns findings with features into labelled ones for training; a given ``model`` is used as it is. Null and empty texts have
    no candidates, an empty table gives no rows, a null path counts as an empty one, other columns are not read.
    """
    found = rewritten(with_features(rewritten(findings(docs, id_col, text_col, path_col)), dictionary(docs, text_col)))
    model = model or train(label(found))
    return classify(found, model, threshold).select("doc_id", "path", "text_hash", "part", "start", "size", "score", "is_secret")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", mask: str = MASK, **options) -> DataFrame:
    """``docs`` with every secret of ``scan`` replaced by ``mask``; all rows and other columns stay."""
    hits = (scan(docs, id_col, text_col, path_col, **options).where("is_secret")
            .groupBy(F.col("doc_id").alias("__id"), F.col("path").alias("__path"), F.col("text_hash").alias("__hash"))
            .agg(F.collect_set("part").alias("__parts")))
    text = F.col(text_col)
    joined = docs.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
                       & (F.coalesce(F.col(path_col).cast("string"), F.lit("")) == F.col("__path")), "left")
    candidates = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    pieces = F.zip_with(F.split(text, CANDIDATE, -1), F.transform(candidates, lambda c, i: F.when(
        F.array_contains("__parts", i), F.lit(mask)).otherwise(c)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return joined.withColumn(text_col, F.when(F.col("__parts").isNull(), text).otherwise(F.array_join(pieces, ""))).select(*docs.columns)
