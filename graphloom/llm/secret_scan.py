"""Secret scans with a random forest that removes false positives.

Tokens that may be secrets (8 or more characters of key alphabets with a digit,
or 20 or more without one) are found in whole texts. A random forest judges them
by their length, the transitions between their characters (kinds that follow each
other, and how usual their letter pairs are in words), how much of them a
dictionary covers, whether they stand in a path, and the words on both sides. It
is trained on labelled findings, a table of any source with the columns match,
before, after (the text next to it) and label; ``labelled_findings`` makes some by
rule, the same shapes of tokens under both labels, so that no shape alone decides.
That training set is bounded (``FINDINGS`` rows of each class).

All of it is DataFrame code: the features are column expressions, and the trees
are grown and applied by the JVM.

Defined results: a null text is empty. Positions count code points, ends are
exclusive. A document without a candidate has no row. Very long texts and
candidates are taken whole, in time that grows with their length. Repeated rows give
repeated results; empty tables give none. Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import documents, settle
from .spans import matches

#: Runs of a key alphabet; entered at their start, given back nothing. Most words are too short and fail at the first look.
_SIGNS = r"A-Za-z0-9_/+=\-."
CANDIDATE = rf"(?<![{_SIGNS}])(?=[{_SIGNS}]{{8}})(?:(?=[A-Za-z_/+=\-.]*+[0-9])[{_SIGNS}]++|[{_SIGNS}]{{20,}}+)"
LONG_RUN = rf"(?<![{_SIGNS}])[{_SIGNS}]{{20}}"
#: Words that stand next to secrets, and next to what looks like them.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "authorization", "bearer", "credential", "credentials", "private_key", "key", "webhook", "login", "session")
PLAIN_WORDS = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "hash", "uuid", "guid", "id", "version", "build", "example", "order", "invoice", "card", "phone", "figure", "see", "file", "index", "isbn", "date", "server", "release", "image", "url", "line")
#: Words of which identifiers are made.
DICTIONARY = ("access", "account", "address", "and", "array", "bank", "base", "block", "book", "build", "call", "change", "class", "client", "code", "color", "column", "config", "content", "count", "data", "date", "default", "document", "error", "event", "example", "field", "file", "filter", "format", "frame", "function", "group", "handler", "hash", "header", "image", "index", "input", "item", "java", "key", "label", "length", "line", "list", "local", "manager", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "page", "param", "parser", "password", "path", "place", "point", "port", "process", "project", "proper", "query", "record", "request", "response", "result", "sample", "score", "server", "service", "session", "size", "source", "start", "state", "status", "string", "table", "test", "text", "the", "time", "token", "type", "update", "user", "value", "version", "view", "week", "with", "word", "your")
#: Formats of providers: a match is a secret in the labelled findings.
PROVIDERS = ("AKIA", "ghp_", "gho_", "xoxb-", "sk_live_", "AIzaSy", "glpat-", "npm_")
#: Kinds of characters in a shape: lower case, upper case, digits, signs.
KINDS, PAIRS = "aB9~", ("aB", "Ba", "a9", "9a", "B9", "9B")
FEATURES = ("length", "pairs", "switches", *(f"to_{p}" for p in ("aB", "Ba", "a9", "9a", "B9", "9B")), "digit_share", "upper_share", "hex", "distinct_share", "covered", "separators", "in_path", "secret_before", "plain_before", "secret_after", "plain_after", "quoted", "assigned", "provider", "repeats")
#: Rows of each class, trees and their depth, and the least probability of a secret.
FINDINGS, TREES, DEPTH, LEAST = 3000, 32, 10, 0.5


def pair_logs() -> list[float]:
    """Log probabilities of the letter pairs of the dictionary, each counted once more than it occurs, by 26 x first + second."""
    pairs, firsts = Counter(), Counter()
    for word in DICTIONARY:
        for a, b in zip(word, word[1:], strict=False):
            pairs[a, b] += 1
            firsts[a] += 1
    letters = string.ascii_lowercase
    return [math.log((pairs[a, b] + 1) / (firsts[a] + len(letters))) for a in letters for b in letters]


def features() -> list[Column]:
    """The features of a finding, from its columns match, before and after."""
    m, n = F.col("match"), F.length("match").cast("double")
    before, after = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("after", F.lit("")))
    shape = F.translate(m, string.ascii_lowercase + string.ascii_uppercase + string.digits + "_/+=-.", "a" * 26 + "B" * 26 + "9" * 10 + "~" * 6)
    moves = F.greatest(n - 1, F.lit(1.0))
    low, logs = F.lower(m), F.array(*map(F.lit, pair_logs()))
    # Letters as an array, once: neighbours are it and its shift, so a long token costs what its length does.
    codes = F.transform(F.split(low, ""), lambda c: F.ascii(c) - ord("a"))
    letter = lambda c: c.between(0, 25)
    places = F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(F.length(m), F.lit(1))), lambda a, b: F.when(letter(a) & letter(b), a * 26 + b)), lambda p: p.isNotNull())
    sums = F.aggregate(places, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, p: F.struct((acc["s"] + F.get(logs, p)).alias("s"), (acc["n"] + 1).alias("n")))
    share = lambda p: F.length(F.regexp_replace(m, p, "")) / n
    word = lambda side, words: side.rlike(r"(?<![a-z])(?:" + "|".join(words) + r")(?![a-z])").cast("double")
    covered = 1 - F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")) / n
    return [
        n.alias("length"), (sums["s"] / F.greatest(sums["n"], F.lit(1))).alias("pairs"), (F.regexp_count(shape, F.lit(r"(.)(?!\1)(?=.)")) / moves).alias("switches"),
        *((F.regexp_count(shape, F.lit(f"{p[0]}(?={p[1]})")) / moves).alias(f"to_{p}") for p in PAIRS), share("[^0-9]").alias("digit_share"), share("[^A-Z]").alias("upper_share"), m.rlike(r"\A[0-9a-f]+\z").cast("double").alias("hex"),
        (F.size(F.array_distinct(F.split(m, ""))) / F.least(n, F.lit(64.0))).alias("distinct_share"), covered.alias("covered"), share("[^_/.-]").alias("separators"),
        (m.rlike("/.*/") | before.rlike(r"://|/\s*\z|\\\s*\z")).cast("double").alias("in_path"), word(before, SECRET_WORDS).alias("secret_before"), word(before, PLAIN_WORDS).alias("plain_before"), word(after, SECRET_WORDS).alias("secret_after"), word(after, PLAIN_WORDS).alias("plain_after"),
        before.rlike(r"[\"'`]\s*\z").cast("double").alias("quoted"), before.rlike(r"[=:]\s*[\"'`]?\s*\z").cast("double").alias("assigned"),
        m.rlike(r"\A(?:" + "|".join(PROVIDERS) + ")").cast("double").alias("provider"), m.rlike(r"(.)\1{4}|12345|abcdef").cast("double").alias("repeats"),
    ]


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """Findings made by rule: match, before, after, label; the same on every run."""
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))) + 1).cast("int"))
    mixed = lambda salt: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws("-", "id", F.lit(salt)), 512))), r"[\s=]", "")
    hexed = lambda salt: F.sha2(F.concat_ws("-", "id", F.lit(salt)), 256)
    size = lambda salt, low, high: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(high - low)) + low).cast("int")
    digits = lambda salt, n: F.substring(F.concat(*(F.lpad(F.abs(F.xxhash64("id", F.lit(salt), F.lit(i))).cast("string"), 19, "7") for i in range(2))), F.lit(1), n)
    uuid = lambda salt: F.concat_ws("-", *(F.substring(hexed(salt), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    words = lambda salt, between="_": F.concat_ws(between, *(pick(DICTIONARY, 100 * salt + i) for i in range(4)))
    filler = ("the", "of", "and", "le", "der", "para", "then", "with", "une")
    some, kind = spark.range(0, rows, 1, 4), F.col("id") % 10
    random = F.when(kind == 2, F.substring(hexed(6), 1, 32)).when(kind == 3, hexed(7)).when(kind == 4, F.substring(hexed(8), 1, 40)).when(kind == 5, uuid(9)).when(kind == 6, F.substring(mixed(10), F.lit(1), size(11, 8, 16)))
    provider = F.concat(pick(PROVIDERS, 1), F.substring(F.regexp_replace(mixed(2), "[+/]", "x"), F.lit(1), size(3, 24, 40)))
    secret = F.when(kind <= 1, provider).when(kind == 7, F.concat_ws(".", F.substring(mixed(12), 1, 20), F.substring(mixed(13), F.lit(1), size(14, 20, 50)))).when(kind == 8, F.concat(pick(DICTIONARY, 15), pick(("!", "-", "_", "."), 16), size(17, 1000, 99999).cast("string"), F.substring(mixed(18), 1, 3)))
    good = some.select(
        random.alias("random"), F.coalesce(random, secret, F.substring(mixed(4), F.lit(1), size(5, 20, 64))).alias("match"),
        F.concat(pick(filler, 20), F.lit(" "), pick(SECRET_WORDS, 21), pick((' = "', ": ", "=", " ", "='", ': "', " is ", ' => "'), 22)).alias("before"),
        F.concat(pick(('"', "'", "", ";", '",'), 23), F.lit(" "), pick(filler, 24), F.lit(" "), pick(filler, 25)).alias("after"), F.lit(1.0).alias("label"), kind.alias("kind"),
    )
    plain = F.when(kind == 0, digits(30, size(31, 8, 20))).when(kind == 1, F.concat(words(32), F.lit("_"), size(33, 1, 99).cast("string"))).when(kind == 7, F.concat(F.lit("src/"), words(34, "/"), F.lit("/"), size(35, 1, 9).cast("string"), F.lit(".java")))
    plain = plain.when(kind == 8, F.concat_ws(".", *(size(36 + i, 0, 256).cast("string") for i in range(4)))).when((kind == 9) & (F.col("id") % 20 == 9), F.concat(F.repeat(F.lit("x"), size(41, 12, 30)), F.lit("12345")))
    plain = plain.when(kind == 9, F.concat_ws("-", size(42, 1990, 2030).cast("string"), F.lpad(size(43, 1, 13).cast("string"), 2, "0"), F.lpad(size(44, 1, 29).cast("string"), 2, "0")))
    bad = some.select(
        # The random shapes again, where their neighbours say that they are no secrets.
        F.coalesce(random, plain).alias("match"),
        F.concat(pick(filler, 50), F.lit(" "), F.when(kind.between(2, 6), pick(PLAIN_WORDS, 51)).when(kind == 9, pick((*SECRET_WORDS, *filler), 52)).otherwise(pick((*filler, *PLAIN_WORDS), 53)), pick((" ", " ", " ", ": ", " = ", ' = "', "-"), 54)).alias("before"),
        F.concat(pick(('"', "", "", ";", "."), 55), F.lit(" "), pick((*filler, *PLAIN_WORDS), 56), F.lit(" "), pick(filler, 57)).alias("after"), F.lit(0.0).alias("label"), kind.alias("kind"),
    )
    return good.drop("random", "kind").unionByName(bad.drop("kind")).filter(F.length("match") >= 8)


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 6) -> RandomForestClassificationModel:
    """A forest from labelled findings: match, before, after, label (1 for a secret). For a bounded number of rows."""
    held = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.select("label", *features()))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(held.select("label", "features"))


def judge(found: DataFrame, forest: RandomForestClassificationModel, least: float = LEAST) -> DataFrame:
    """Adds score and secret to findings (match, before, after and any other columns but those)."""
    carried = [c for c in found.columns if c not in ("before", "after")]
    judged = VectorAssembler(inputCols=list(FEATURES), outputCol="the features").transform(found.select(*carried, *features()))
    forest = forest.copy().setFeaturesCol("the features")
    score = F.round(vector_to_array(F.col(forest.getProbabilityCol()))[1], 6)
    return forest.transform(judged).select(*carried, score.alias("score"), (score >= least).alias("secret"))


def scan(docs: DataFrame, forest: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per candidate: doc_id, start, end, match, score, secret."""
    found = matches(docs, id_col, text_col, {"secret": (CANDIDATE, lambda t: t.rlike("[0-9]") | t.rlike(LONG_RUN))}, "secrets", letters=True).filter("kind is not null")
    return judge(found.select("doc_id", "start", "end", "match", "before", "after"), forest, least)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = train(settle(labelled_findings(spark), "findings"))
    return scan(documents(spark, sf_dir), forest)
