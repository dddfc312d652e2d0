"""Secret scanning with a random forest against false positives, in DataFrame, SQL and ML functions of the engine only.

A pattern finds candidates in whole texts. A forest trained on labelled findings looks at a candidate's length, its characters and
their transitions, how much of it dictionary words cover, the document's path and the neighbouring words, and keeps the secrets.
The dictionary and the usual letter transitions are counted from the whole corpus.
"""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, materialize, table

#: A named assignment, up to its value.
ASSIGNMENT = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|auth[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: Signed web tokens; runs of 16 or more key characters with a digit among them; what is assigned to a name.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{{8,}}+(?:\.[A-Za-z0-9_-]{{8,}}+){{1,2}}|(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{16,}}+={{0,2}}+)|{ASSIGNMENT}[^\s\"']{{8,}}+"
#: Marks behind an assigned value that belong to the sentence; the characters that an assigned value has at least without them.
TRAILING, LEAST = ".,;:)]}>", 8
#: Whole words, or parts of names joined by marks.
CUES = r"(?i)(?<![a-z])(pass(word|wd|phrase)?|pwd|secret|token|api_?key|api|key|auth|bearer|credentials?|private|access|(api|auth|access|secret)_?(key|token))(?![a-z])"
HARMLESS = r"(?i)(?<![a-z])(sha(1|256|384)?|md5|hash|commit|digest|checksum|etag|integrity|uuid|guid|request|order|invoice|card|phone|isbn|version|build|file|image|asset|example|sample|dummy|placeholder)(?![a-z])"
#: What is an address and not a word beside the candidate.
ADDRESS = r"[^\s\"'<>]+@[^\s\"'<>]+|[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+|www\.[^\s\"'<>]+"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|specs?|examples?|samples?|mocks?|fixtures?|docs?|demos?)([/_.-]|$)"
CONFIG_PATH = r"(?i)(\.env|\.ya?ml|\.properties|\.ini|\.toml|\.tfvars|config|settings|deploy|secrets?|credentials)"
#: English words of identifiers, known beside the corpus's own.
WORDS = ("the", "and", "for", "with", "this", "that", "user", "name", "file", "path", "data", "test", "example", "sample", "value", "index", "page", "home", "http", "https", "www", "com", "org", "html", "image", "photo", "list", "item", "version", "build", "release", "config", "default", "number", "order", "invoice", "report", "chapter", "section", "article", "product", "customer", "address", "street", "project", "module", "class", "method", "function", "variable", "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december", "monday", "friday", "north", "south", "update", "create", "delete", "select", "table", "column", "row", "field", "string", "type", "size", "width", "height", "long", "short", "first", "last", "next")
#: The corpus's words that the dictionary takes at most, by falling count, and how often one is found at least.
MOST_WORDS, LEAST_COUNT = 20_000, 5
TREES, DEPTH, SEED, KEEP_FROM, TRAINING_ROWS = 40, 9, 11, 0.5, 6000
#: Of labelled findings: the words that their names are made of at most, and the random numbers of each.
NAME_WORDS, DRAWS = 300, 61
#: Candidates of a text whose ends are added up at a time.
RUN = 256

#: What the forest looks at, by family.
FAMILIES = {
    "length": ("length",),
    "characters": ("digits", "uppers", "marks", "distinct", "slashes", "prefix"),
    "transitions": ("changes", "pairs", "likelihood"),
    "dictionary": ("words",),
    "path": ("testing", "configured", "depth"),
    "neighbours": ("cue", "assigned", "quoted", "harmless"),
}
FEATURES = tuple(f for family in FAMILIES.values() for f in family)


@dataclass(frozen=True)
class Lexicon:
    """A dictionary of words, as a table (word), too, and the base-10 logarithms of its letter transitions' chances (26 x 26)."""

    words: tuple[str, ...]
    steps: tuple[float, ...]
    known: DataFrame

    @staticmethod
    def of(spark: SparkSession, counts: dict[str, int]) -> Lexicon:
        """Letter transitions are those of the words, as often as `counts` says, each seen once more than it is."""
        pairs = [1.0] * 676
        for w, n in counts.items():
            for a, b in zip(w, w[1:], strict=False):
                pairs[(ord(a) - 97) * 26 + ord(b) - 97] += n
        sums = [sum(pairs[26 * a : 26 * a + 26]) for a in range(26)]
        words = tuple(sorted(counts))
        known = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(words)), "array<string>")).alias("word"))
        return Lexicon(words, tuple(round(math.log10(n / sums[i // 26]), 3) for i, n in enumerate(pairs)), materialize(known))

    def letter_steps(self) -> Column:
        return F.from_json(F.lit(json.dumps(self.steps)), "array<double>")

    def cover(self, rows: DataFrame) -> DataFrame:
        """`rows` with covered: the letters of `token` in parts of four or more that are words; known words are broadcast, as they are few."""
        rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()))
        part = F.explode(F.split(F.lower(F.regexp_replace("token", "([a-z])([A-Z])", "$1 $2")), "[^a-z]+"))
        found = rows.select("place", part.alias("word")).where(F.length("word") >= 4).join(F.broadcast(self.known), "word")
        covered = found.groupBy("place").agg(F.sum(F.length("word")).alias("covered"))
        return rows.join(covered, "place", "left").drop("place").withColumn("covered", F.coalesce("covered", F.lit(0)))


def dictionary(docs: DataFrame, text: str = "text", most: int = MOST_WORDS, least: int = LEAST_COUNT) -> Lexicon:
    """At most `most` of the most frequent words a-z of three letters or more that all of `docs` holds `least` times, and WORDS.

    A-Z count as a-z; words whose counts are nearly alike are taken together or not at all. Null texts have none; an empty table
    leaves WORDS.
    """
    each = docs.select(F.explode(F.split(F.translate(text, LOWER.upper(), LOWER), "[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    counts = materialize(each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))
    # From a histogram of a few hundred buckets: the least count of which no more than `most` words are. No task sorts them all.
    bucket = F.floor(F.log2("n") * 16).cast("int")
    total, lowest = 0, None
    for b, n in sorted(((r["b"], r["count"]) for r in counts.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if total + n > most:
            break
        total, lowest = total + n, b
    top = [] if lowest is None else counts.where(bucket >= lowest).collect()
    return Lexicon.of(docs.sparkSession, dict.fromkeys(WORDS, 1) | {r["word"]: r["n"] for r in top})


def _bound(value: Column, use) -> Column:
    """use(value) with `value` computed once: a lambda would compute it again for each entry it looks at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def features(lexicon: Lexicon) -> dict[str, Column]:
    """FEATURES of rows (token, before, after, path, covered); before, after: the words around the candidate."""
    token = F.col("token")
    before, after, path = (F.coalesce(c, F.lit("")) for c in ("before", "after", "path"))
    beside = F.regexp_replace(before, ADDRESS, " ")
    n = F.greatest(F.length(token), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(token, pattern, "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a")
    syllables = F.regexp_count(F.lower(token), F.lit("[bcdfghjklmnpqrstvwxyz][aeiou]"))
    codes = F.transform(F.regexp_extract_all(F.lower(token), F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c) - 97)  # never inside a lambda
    letter = lambda c: (c >= 0) & (c < 26)
    steps = lexicon.letter_steps()
    chances = F.filter(F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: F.when(letter(a) & letter(b), F.get(steps, a * 26 + b))), lambda x: x.isNotNull())
    usual = _bound(chances, lambda c: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)).otherwise(F.lit(-math.log10(26))))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": F.log2(n),
        "digits": share("[^0-9]"),
        "uppers": share("[^A-Z]"),
        "marks": share("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(codes)) / F.least(n, F.lit(40)),
        "slashes": F.length(F.regexp_replace(token, "[^/]", "")) / n,
        "prefix": flag(token.rlike("^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ)")),
        "changes": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "pairs": syllables / n,
        "likelihood": usual,
        "words": F.col("covered") / n,
        "testing": flag(path.rlike(TEST_PATH)),
        "configured": flag(path.rlike(CONFIG_PATH)),
        "depth": F.least(F.regexp_count(path, F.lit("/")), F.lit(8)).cast("double"),
        "cue": flag(beside.rlike(CUES)),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "harmless": flag(beside.rlike(HARMLESS)),
    }




def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS, words: tuple[str, ...] = WORDS) -> DataFrame:
    """(token, before, after, path, label): findings whose labels come from what they are, not from how they look.

    What a finding is, its form, its neighbours and its path are drawn apart from each other by hashes of the row's number. Half are
    secrets: provider keys, random hexadecimal and base-62 or base-64 strings of 16 to 1,000 characters, passwords made of words and
    of random characters. Half are not: digests, identifiers, numbers, dates, paths and names made of `words`, constants in capitals
    that speak of keys, contents of files, placeholders, and strings in every form of a secret in tests and documentation. Many of
    both stand in the same forms, beside the same words and in the same paths, so no single feature tells them apart.
    """
    i = F.col("id")
    words = tuple(sorted(words, key=lambda w: (zlib.crc32(w.encode()), w))[:NAME_WORDS])
    listed = F.from_json(F.lit(json.dumps(words)), "array<string>")
    long = lambda k: F.concat(*[F.sha2(F.concat_ws(":", i, F.lit(k + j)), 512) for j in range(10)])
    mixed, base64 = (F.regexp_replace(F.base64(F.unhex(long(k))), marks, "") for k, marks in ((100, r"[+/=\s]"), (200, r"[=\s]")))
    # What is random is drawn once for each row, so that later expressions stay small.
    draws = lambda n: F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda j: F.pmod(F.xxhash64(i, j), F.lit(n)).cast("int"))
    numbers = spark.range(0, rows, 1, 4).select("id", long(0).alias("hexa"), mixed.alias("mixed"), base64.alias("base64"), draws(1 << 30).alias("draws"), F.transform(draws(len(words)), lambda j: F.get(listed, j)).alias("words"))
    numbers = materialize(numbers.withColumn("digits", F.translate("hexa", "abcdef", "012345")).withColumn("upper", F.translate(F.upper("mixed"), "0189", "ABCD")))
    pick = lambda k, n: F.get("draws", F.lit(k)) % n
    of = lambda k, *c: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c]), pick(k, len(c)))
    word = lambda k: F.get("words", F.lit(k))
    hexa, mixed, base64, digits, upper = (F.col(c) for c in ("hexa", "mixed", "base64", "digits", "upper"))
    cut = lambda s, k, *n: F.left(s, of(k, *n))
    title = lambda k: F.initcap(word(k))
    provider = of(10, F.concat(F.lit("AKIA"), F.left(upper, F.lit(16))), F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), F.concat(F.lit("sk_live_"), F.left(mixed, F.lit(24))), F.concat(F.lit("xoxb-"), F.left(digits, F.lit(11)), F.lit("-"), F.left(mixed, F.lit(24))), F.concat(F.lit("AIza"), F.left(mixed, F.lit(35))))
    hex_key = cut(hexa, 11, 18, 20, 24, 32, 40, 48, 64)
    base_key = cut(mixed, 12, 16, 20, 24, 32, 40, 64, 88, 120, 516, 850)
    base64_key = F.concat(cut(base64, 13, 22, 43, 64, 86, 342), of(14, "", "", "=", "=="))
    password = of(15, F.concat(title(16), title(17), F.left(digits, F.lit(3)), of(18, "!", "?", "#", "")), F.concat(F.left(mixed, F.lit(5)), of(19, "$", "!", "%", "&"), F.substring(mixed, 8, 6)), cut(mixed, 20, 10, 12, 14), F.concat(word(21), of(22, "-", "_", "."), word(23), of(24, "-", "_", "."), word(25), F.left(digits, F.lit(2))))
    name = of(27, F.concat_ws("_", word(28), word(29), word(30), F.left(digits, F.lit(2))), F.concat_ws("-", word(28), word(29), word(30), F.left(digits, F.lit(4))), F.concat(word(28), title(29), title(30), title(31), F.left(digits, F.lit(1))), F.concat(word(28), word(29), word(30), word(31), F.left(digits, F.lit(4))))
    forms = materialize(numbers.select("*", provider.alias("provider"), hex_key.alias("hex_key"), base_key.alias("base_key"), base64_key.alias("base64_key"), password.alias("password"), name.alias("name")))
    provider, hex_key, base_key, base64_key, password, name = (F.col(c) for c in ("provider", "hex_key", "base_key", "base64_key", "password", "name"))
    secret_form = of(26, provider, hex_key, base_key, base64_key)
    kinds = {
        1: [secret_form, secret_form, hex_key, base_key, base64_key, password, password, provider],
        0: [
            cut(hexa, 32, 32, 40, 64),
            F.concat_ws("-", F.left(hexa, F.lit(8)), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12)),
            cut(digits, 33, 16, 17, 18, 19),
            F.concat_ws("/", word(34), word(35), word(36), F.left(digits, F.lit(3))),
            name,
            of(37, F.concat(F.lit("20"), F.left(digits, F.lit(2)), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("-"), F.substring(digits, 5, 6)), F.concat(F.lit("v1-"), F.left(digits, F.lit(2)), F.lit("-"), F.substring(digits, 3, 2), F.lit("-"), word(38), F.left(hexa, F.lit(7)))),
            F.upper(F.concat_ws("_", of(39, "api", "max", "default", word(40)), of(41, "token", "secret", "key", word(42)), of(43, "header", "length", "name", word(44)), F.left(digits, F.lit(1)))),
            of(45, cut(base64, 46, 43, 64, 342, 850), F.concat(F.lit("sha384-"), F.left(base64, F.lit(64)))),
            of(47, F.concat(F.lit("your_"), word(48), F.lit("_key_here1")), F.concat(F.repeat(of(49, "x", "X", "0", "a"), 16), F.left(digits, F.lit(2))), F.lit("changeme123"), F.concat(F.lit("AKIA"), F.left(upper, F.lit(9)), F.lit("EXAMPLE")), F.lit("1234567890abcdef")),
            secret_form,
        ],
    }
    label = pick(1, 2)
    fits = {y: pick(2, len(c)) for y, c in kinds.items()}
    tokens = {y: reduce(lambda rest, k, c=c, y=y: F.when(fits[y] == k, c[k]).otherwise(rest), range(1, len(c)), c[0]) for y, c in kinds.items()}
    told = of(3, "token = \"", "password=", "api_key: ", "secret: '", "Authorization: Bearer ", "access key ", "passwd: ", "auth_key=", "credentials ", "private key: ")
    plain = of(4, "", F.concat(word(50), F.lit(" ")), F.concat(word(50), F.lit(" "), word(51), F.lit(", ")), "value = \"", "id=", "data: ")
    harmless = of(5, "commit ", "sha256: ", "md5=", "etag: \"", "integrity=\"", "uuid ", "request id=", "order ", "build ", "file=", "image ", "sample key: ", "checksum ", "version ", "token hash: ")
    draw = pick(6, 100)
    before_secret = F.when(draw < 45, told).when(draw < 93, plain).otherwise(harmless)
    before_other = F.when(draw < 12, told).when(draw < 55, plain).otherwise(harmless)
    before = F.when(label == 1, F.when(fits[1].isin(5, 6), told).otherwise(before_secret)).otherwise(F.when(fits[0] == 9, F.when(draw < 60, told).otherwise(plain)).otherwise(before_other))
    filler = F.when(pick(7, 5) > 0, F.concat(word(52), F.lit(" "), word(53), F.lit(" "))).otherwise(F.lit(""))
    token = F.when(label == 1, tokens[1]).otherwise(tokens[0])
    made = materialize(forms.select("draws", "words", label.alias("label"), token.alias("token"), F.when(label == 0, fits[0]).alias("other"), F.concat(filler, before).alias("before")))
    neutral = F.concat(F.lit("src"), pick(54, 40).cast("string"))
    folder = F.concat(word(55), F.lit("/"), word(56))
    configured = of(57, F.concat(F.lit("config/"), word(58), F.lit(".yaml")), F.concat(word(58), F.lit("/.env")), F.concat(F.lit("deploy/"), word(58), F.lit("/settings.ini")))
    tested = of(59, F.concat(F.lit("tests/"), folder, F.lit(".py")), F.concat(F.lit("docs/"), word(58), F.lit(".md")), F.concat(folder, F.lit("/fixtures/"), word(58), F.lit(".json")), F.concat(F.lit("examples/"), word(58)))
    place = pick(8, 100)
    path_secret = F.when(place < 45, neutral).when(place < 70, F.concat(folder, F.lit(".py"))).when(place < 95, configured).otherwise(tested)
    path_other = F.when(place < 45, neutral).when(place < 75, F.concat(folder, F.lit(".py"))).when(place < 82, configured).otherwise(tested)
    path = F.when(F.col("label") == 1, path_secret).when(F.col("other") == 9, tested).otherwise(path_other)
    after = F.when(F.col("before").rlike("[\"']$"), F.concat(F.right("before", F.lit(1)), F.lit(" "), word(60))).otherwise(F.concat(F.lit(" "), word(60)))
    return made.select("token", "before", after.alias("after"), path.alias("path"), "label")


@dataclass(frozen=True)
class Forest:
    """What keeps the secrets among candidates."""

    model: RandomForestClassificationModel
    lexicon: Lexicon
    features: tuple[str, ...]

    def importances(self) -> dict[str, float]:
        """How much each family of features decides; the sum is 1."""
        by = dict(zip(self.features, self.model.featureImportances.toArray().tolist(), strict=True))
        return {family: sum(by.get(f, 0.0) for f in names) for family, names in FAMILIES.items()}

    def scored(self, rows: DataFrame) -> DataFrame:
        """`rows` (token, before, after, path and others) with score: the share of the forest for a secret."""
        f = features(self.lexicon)
        taken = self.lexicon.cover(rows).select("*", *[f[k].alias(f"f_{k}") for k in self.features])
        ready = VectorAssembler(inputCols=[f"f_{k}" for k in self.features], outputCol="features").transform(taken)
        return self.model.transform(ready).withColumn("score", vector_to_array("probability")[1]).select(*rows.columns, "score")


def train(findings: DataFrame, lexicon: Lexicon, use: tuple[str, ...] = FEATURES) -> Forest:
    """A forest fitted to (token, before, after, path, label 0 or 1); rows without a token or label teach nothing.

    Both labels have to be there. Fit on findings that people labelled, or on `labelled_findings`; at most some ten thousands.
    """
    rows = lexicon.cover(findings.where("token is not null and label in (0, 1)"))
    f = features(lexicon)
    data = rows.select(*[f[k].alias(k) for k in use], F.col("label").cast("double").alias("label"))
    data = materialize(VectorAssembler(inputCols=list(use), outputCol="features").transform(data).select("features", "label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", subsamplingRate=0.8, minInstancesPerNode=2)
    return Forest(forest.fit(data), lexicon, tuple(use))


def _running(lengths: Column) -> Column:
    """Running sums of an array, in runs of RUN, so that no long array is copied for each of its entries."""

    def summed(a):
        return F.aggregate(a, F.array().cast("array<long>"), lambda acc, x: F.array_append(acc, x + F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0))))

    def in_runs(whole):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(whole) - 1) / RUN), F.lit(0)).cast("int")), lambda k: summed(F.slice(whole, k * RUN + 1, F.lit(RUN))))

    def joined(runs):
        starts = summed(F.transform(runs, lambda r: F.coalesce(F.element_at(r, -1), F.lit(0).cast("long"))))
        return _bound(starts, lambda at: F.flatten(F.transform(runs, lambda r, k: F.transform(r, lambda x: x + F.when(k > 0, F.get(at, k - 1)).otherwise(F.lit(0))))))

    return _bound(lengths, lambda whole: _bound(in_runs(whole), joined))


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, path, token, start, end, before, after) for each candidate of each row; code points, end exclusive.

    `before` and `after`: the up to four words that stand between it and the candidates around it. Null and empty texts have none;
    texts and candidates of any length are whole. Rows with null or repeated ids have their own candidates.
    """
    inside = docs.where(F.col(text).rlike(CANDIDATE)).select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")).alias("path"),
        F.split(F.col(text), CANDIDATE, -1).alias("gaps"),
        F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)).alias("tokens"),
    )
    # The end of candidate i: the lengths of the gaps and candidates so far.
    n = F.size("tokens")
    left, right = F.slice("gaps", F.lit(1), n), F.slice("gaps", F.lit(2), n)
    ends = _running(F.zip_with(F.col("tokens"), left, lambda t, g: (F.length(t) + F.length(g)).cast("long")))
    zipped = F.arrays_zip(F.col("tokens").alias("match"), left.alias("left"), right.alias("right"), ends.alias("stop"))
    each = inside.select("doc_id", "path", F.explode(zipped).alias("c")).select("doc_id", "path", "c.*")
    value = F.regexp_replace("match", f"^{ASSIGNMENT}", "")
    each = each.withColumn("value", value).withColumn("token", F.when(F.length("value") < F.length("match"), F.rtrim(F.col("value"), F.lit(TRAILING))).otherwise(F.col("value")))
    named = F.left("match", F.length("match") - F.length("value"))
    start = F.col("stop") - F.length("value")
    # The words next to the candidate, from the gaps' near ends: possessive, so long gaps cost no more than their length.
    near = r"^(?:\s*+\S++){0,4}+\s*+"
    before = F.concat(F.reverse(F.regexp_extract(F.reverse("left"), near, 0)), named)
    return each.where(F.length("token") >= LEAST).select("doc_id", "path", "token", start.alias("start"), (start + F.length("token")).alias("end"), before.alias("before"), F.regexp_extract("right", near, 0).alias("after"))


def find_secrets(docs: DataFrame, forest: Forest, text: str = "text", doc_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """(doc_id, start, end, kind, token, score): the candidates that the forest holds to be secrets, score from KEEP_FROM to 1.

    Null and empty texts have none. Repeated rows repeat; empty tables give empty ones; other columns are not looked at.
    """
    kind = (
        F.when(F.col("token").rlike("^A[KS]IA[A-Z0-9]{16}$"), "cloud_key")
        .when(F.col("token").rlike("^(gh[pos]_|glpat-)"), "forge_token")
        .when(F.col("before").rlike(r"(?i)pass(word|wd|phrase)?\W{0,4}$"), "password")
        .when(F.col("before").rlike(r"(?i)token\W{0,4}$"), "token")
        .otherwise("generic")
    )
    found = forest.scored(candidates(docs, text, doc_id, path)).where(F.col("score") >= KEEP_FROM)
    return found.select("doc_id", "start", "end", kind.alias("kind"), "token", "score")


def default_forest(spark: SparkSession, docs: DataFrame, text: str = "text") -> Forest:
    """The forest of `labelled_findings`, with the dictionary of `docs`; names in the findings use words of both kinds."""
    lexicon = dictionary(docs, text)
    return train(labelled_findings(spark, words=lexicon.words), lexicon)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each secret found in documents; the document's source is its path. Edge cases as in `find_secrets`."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, default_forest(spark, docs), path="source")
    return found.select("doc_id", "start", "end", "kind", F.sha2("token", 256).alias("secret_sha256"), F.round("score", 6).alias("score"))
