"""Secret scans: candidates by pattern, false positives removed by a random forest. SQL functions and Spark ML only.

Candidates are of two kinds, long words of prose included: runs of twelve or more of
``A-Z a-z 0-9 + / _ -`` (with the dots of a JSON web token), unless they are a name that
something is assigned to; and values of six or more characters that are assigned to a word
such as *password*, or stand for one in a URL. The forest tells secrets from others by

* length, and shares of digits, upper case, lower case and other characters;
* character transitions: the mean log probability of one letter after another, as the words
  of all documents have it; runs of one kind, changes between letters and digits, vowels
  beside consonants, distinct characters;
* dictionary coverage: the share of the characters in words of a dictionary, which are the
  most frequent words of all documents, ``WORDS`` at most;
* path: slashes before or within, a scheme before;
* neighbouring words: an assignment, a quote, a word such as *password* before it, and
  whether the words on both sides are in the dictionary.

It is trained from labelled findings (doc_id, ordinal, label). Where nobody has labelled any,
``planted`` makes some: in the surroundings of ``SAMPLE`` candidates of the corpus (those of
least hash, a bound on the fit alone) it puts keys made from hashes, labelled 1, and
look-alikes (hashes in prose, UUIDs, numbers, paths, plain words after *password*), labelled 0
as are the corpus's own candidates unless they have a known key format.

Defined cases: null and empty texts have no candidates. Without labelled findings of both
kinds every score is 1 or 0 as all labels are, and 0 without any. Repeated rows give
repeated findings. A null doc_id is kept, and has no labels. Columns beside doc_id and text
don't matter; an empty table gives no rows. In a secret, U+0001 counts as a space.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_literal, least_hashed, written

#: Words of the dictionary at most; candidates that findings are planted around.
WORDS, SAMPLE = 20_000, 2_500
#: Labelled findings of each label that the fit takes at most.
MOST_LABELLED = 20_000
TREES, DEPTH, SEED = 32, 8, 17
CONTEXT = 48
MARK = "[SECRET]"

_NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|key|auth|credentials?|private)"
# A name is a run that something is assigned to and that has no digit near its end. What is looked for is what is rare,
# so that most places of a text fail at their first character.
_RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{12,}+(?:(?!\s{0,2}[=:]\s{0,2}[\"']?[^\s\"']{6})|(?<=[0-9][A-Za-z+/_\-]{0,40}))(?:\.[A-Za-z0-9_\-]{12,}+){0,2}(?:={1,2}(?![A-Za-z0-9=]))?"
_ASSIGNMENT = rf"[=:](?:(?<=(?i:{_NAMES})[\"']?\s{{0,2}}[=:])\s{{0,2}}[\"']?(?=[^\s\"']{{6}})|(?<=://[^\s:/@]{{1,64}}:)(?=[^\s@/]{{6,64}}@))"
_VALUE = r"[^\s\"'@]{6,}+"
_CANDIDATE = rf"({_ASSIGNMENT})({_VALUE})|({_RUN})"
_KEYWORD = rf"(?i){_NAMES}[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?$"
_ASSIGNED = r"[=:]\s{0,2}[\"']?$"
_FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{10,}|eyJ[A-Za-z0-9_\-.]{10,})$"


def parts_of(text: str) -> Column:
    """The text cut around its candidates: they are the parts of odd index, counted from 0."""
    return F.split(F.regexp_replace(F.translate(text, "\x01", " "), _CANDIDATE, "$1\x01$2$3\x01"), "\x01")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, candidate, before and after (its context) of all candidates of docs (doc_id, text)."""
    parts = docs.where(F.col("text").rlike(_CANDIDATE)).select("doc_id", parts_of("text").alias("parts"))
    part = lambda i: F.coalesce(F.when(i >= 0, F.get("parts", i)), F.lit(""))
    last = lambda c: F.right(c, F.lit(CONTEXT))
    first = lambda c: F.left(c, F.lit(CONTEXT))
    found = F.transform(
        F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2)),
        lambda i: F.struct(
            i.alias("ordinal"),
            F.get("parts", i).alias("candidate"),
            last(F.concat(*(last(part(i - k)) for k in (3, 2, 1)))).alias("before"),
            first(F.concat(*(first(part(i + k)) for k in (1, 2, 3)))).alias("after"),
        ),
    )
    return parts.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def word_counts(docs: DataFrame) -> DataFrame:
    """w and count of all words of three to forty letters a-z of all documents, written once."""
    words = docs.where("text is not null").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w").between(3, 40))
    return written(words.groupBy("w").count(), "words")


def dictionary(counts: DataFrame, most: int = WORDS) -> list[str]:
    """The most frequent words: all that occur so often that no more than ``most`` do."""
    step = F.floor(F.log2(F.col("count")) * 16).cast("int")
    left, least = most, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).orderBy(F.desc("step")).collect():
        if r["n"] > left:
            break
        left, least = left - r["n"], r["step"]
    return [] if least is None else sorted(r["w"] for r in counts.where(step >= least).select("w").collect())


def transitions(counts: DataFrame) -> list[float]:
    """log2 of the probability of the second letter after the first, for aa, ab .. zz, in all words."""
    pairs = counts.select("count", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("pair"))
    seen = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("count").alias("n")).collect()}
    letters = [chr(97 + i) for i in range(26)]
    totals = {a: sum(seen.get(a + b, 0) for b in letters) for a in letters}
    return [math.log2((seen.get(a + b, 0) + 1) / (totals[a] + 26)) for a in letters for b in letters]


def _among(words: list[str]):
    """A function of a Column: whether it is one of words; they are dealt over short arrays by hash."""
    shelves: list[list[str]] = [[] for _ in range(max(1, len(words) // 4))]
    at = lambda w: sum(ord(c) * 31**i for i, c in enumerate(reversed(w))) % 2**31 % len(shelves)
    for w in words:
        shelves[at(w)].append(w)
    held = array_literal(shelves, "array<array<string>>")

    def code(c):
        return F.aggregate(F.transform(F.split(c, ""), F.ascii), F.lit(0).cast("long"), lambda n, x: (n * 31 + x) % 2**31)

    return lambda c: F.coalesce(F.array_contains(F.get(held, (code(c) % len(shelves)).cast("int")), c), F.lit(False))


def _share(c: Column, pattern: str) -> Column:
    return F.lit(1.0) - F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


def _likelihood(c: Column, table: list[float]) -> Column:
    """The mean of table over neighbouring letters a-z of c; that of letters at random without any."""
    held = array_literal(table, "array<double>")
    letter = lambda x: (x >= 0) & (x < 26)

    def add(acc, x):
        both = letter(acc["last"]) & letter(x)
        return F.struct(x.alias("last"), (acc["sum"] + F.when(both, F.get(held, acc["last"] * 26 + x)).otherwise(0.0)).alias("sum"), (acc["n"] + both.cast("int")).alias("n"))

    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    codes = F.transform(F.split(F.lower(c), ""), lambda x: F.ascii(x) - 97)
    return F.aggregate(codes, start, add, lambda acc: F.when(acc["n"] > 0, acc["sum"] / acc["n"]).otherwise(-math.log2(26)))


def with_features(found: DataFrame, words: list[str], table: list[float]) -> tuple[DataFrame, list[str]]:
    """found with the forest's inputs, and their names. words: a dictionary; table: as of transitions()."""
    c, n, known = F.col("candidate"), F.length("candidate"), _among(words)
    kinds = c
    for kind, to in (("[0-9]+", "9"), ("[A-Z]+", "A"), ("[a-z]+", "a"), (r"[^0-9A-Za-z]+", "-")):
        kinds = F.regexp_replace(kinds, kind, to)
    pieces = F.filter(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0)), lambda p: F.length(p) >= 3)
    covered = F.aggregate(pieces, F.lit(0), lambda acc, p: acc + F.when(known(F.lower(p)), F.length(p)).otherwise(0))
    last_word, next_word = F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1)), F.lower(F.regexp_extract("after", r"^[^A-Za-z]*([A-Za-z]+)", 1))
    features = {
        "f_length": n.cast("double"),
        "f_digits": _share(c, "[0-9]"),
        "f_upper": _share(c, "[A-Z]"),
        "f_lower": _share(c, "[a-z]"),
        "f_other": _share(c, "[^0-9A-Za-z]"),
        "f_transitions": _likelihood(c, table),
        "f_runs": F.length(kinds) / n,
        "f_letter_digit": (F.length(kinds) - F.length(F.regexp_replace(kinds, "[Aa]9|9[Aa]", "x"))) / n,
        "f_vowel_turns": (n - F.length(F.regexp_replace(F.lower(c), "[aeiou][bcdfghjklmnpqrstvwxyz]", "x"))) / n,
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "f_dictionary": covered / n,
        "f_path": (F.col("before").rlike(r"(?:[/\\]|://[^\s]*)$") | c.rlike("/[^/]*/")).cast("double"),
        "f_assigned": F.col("before").rlike(_ASSIGNED).cast("double"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_keyword": F.col("before").rlike(_KEYWORD).cast("double"),
        "f_last_known": known(last_word).cast("double"),
        "f_next_known": known(next_word).cast("double"),
    }
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in features.items()}), list(features)


def planted(found: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Labelled findings (candidate, before, after, label) in the surroundings of ``most`` candidates of found."""
    own = F.xxhash64("doc_id", "ordinal", "candidate", "before", "after")
    rows = least_hashed(found, own, most).select("candidate", "before", "after", own.alias("h"))
    seed = lambda k: F.concat(F.hex("h"), F.lit(f"-{k}"))
    hexed = lambda k, n: F.substring(F.sha2(seed(k), 256), 1, n)
    based = lambda k, n: F.substring(F.translate(F.base64(F.unhex(F.sha2(seed(k), 256))), "=", "A"), 1, n)
    plain = lambda k, n: F.substring(F.regexp_replace(F.concat(F.base64(F.unhex(F.sha2(seed(k), 256))), F.base64(F.unhex(F.sha2(seed(k), 512)))), "[+/=]", ""), 1, n)
    one_of = lambda k, *c: F.get(F.array(*(F.lit(x) for x in c)), F.pmod(F.xxhash64(seed(k)), F.lit(len(c))).cast("int"))
    word = F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1)
    password = F.concat(word, one_of(40, "7", "92", "2031", "x4k1"), one_of(41, "!", "#", "_", ""), hexed(42, 4))
    assign = lambda k: F.concat(
        F.left("before", F.lit(24)), F.lit(" "), one_of(k, "token", "password", "api_key", "AWS_SECRET_ACCESS_KEY", "secret", "auth_token", "client_secret", "PRIVATE_KEY"), one_of(k + 1, " = ", "=", ": ", " = \"", "=\"", ": '")
    )
    closing = lambda k: F.concat(F.when(F.endswith(assign(k), F.lit('"')), '"').when(F.endswith(assign(k), F.lit("'")), "'").otherwise(""), F.lit(" "), F.ltrim("after"))
    prose = lambda *more: F.concat("before", *(F.lit(m) for m in more))
    keys = [hexed(1, 40), hexed(2, 32), based(3, 40), plain(4, 24), plain(5, 64), password]
    made = [(key, assign(50 + 2 * k), closing(50 + 2 * k), 1.0) for k, key in enumerate(keys)]
    formats = [F.concat(F.lit("AKIA"), F.upper(plain(10, 16))), F.concat(F.lit("ghp_"), plain(11, 36)), F.concat(F.lit("sk_live_"), plain(12, 24)), F.concat(F.lit("eyJ"), plain(13, 30), F.lit("."), plain(14, 40), F.lit("."), plain(15, 43))]
    made += [(key, F.col("before"), F.col("after"), 1.0) for key in formats]
    uuid = F.concat_ws("-", *(F.substring(F.sha2(seed(20), 256), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    number = F.substring(F.translate(F.sha2(seed(21), 256), "abcdef", "012345"), 1, 16)
    path = F.concat(F.lower(word), F.lit("/lib/"), F.lower(word), F.lit("-2_1/"), one_of(22, "index", "main", "module", "readme"))
    alike = [(hexed(23, 40), prose("commit "), F.col("after"), 0.0), (hexed(24, 32), F.col("before"), F.col("after"), 0.0), (uuid, F.col("before"), F.col("after"), 0.0), (number, F.col("before"), F.col("after"), 0.0), (path, prose("/"), F.col("after"), 0.0)]
    alike += [(F.concat(word, word), assign(70), closing(70), 0.0), (number, prose("id: "), F.col("after"), 0.0)]
    kinds = [F.struct(c.alias("candidate"), b.alias("before"), a.alias("after"), F.lit(label).alias("label")) for c, b, a, label in made + alike]
    secret = F.col("candidate").rlike(_FORMATS) | F.col("before").rlike(_KEYWORD)
    rows = written(rows, "planted")
    both = rows.select(F.explode(F.array(*kinds)).alias("f")).select("f.*").where(F.length("candidate") >= 6)
    return both.unionByName(rows.where(~secret).select("candidate", "before", "after", F.lit(0.0).alias("label")))


def train(labelled: DataFrame, names: list[str], most: int = MOST_LABELLED) -> RandomForestClassificationModel | float:
    """A forest from rows with features and label, ``most`` of each label; the one label (0 without any) where there is no other."""
    order = F.xxhash64("candidate", "before", "after", *names)
    some = [least_hashed(labelled.where(F.col("label") == k), order, most) for k in (1, 0)]
    sample = written(some[0].unionByName(some[1]).select("label", *names), "findings")
    kinds = [r["label"] for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        return float(kinds[0]) if kinds else 0.0
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8, featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=names, outputCol="features").transform(sample))


def scored(found: DataFrame, names: list[str], model: RandomForestClassificationModel | float) -> DataFrame:
    """found with score, the forest's probability that a candidate is a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    rows = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(found))
    return rows.withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal (odd: the place among the text's parts), secret, score of all secrets in docs (doc_id, text).

    labels: labelled findings (doc_id, ordinal, label 0 or 1; of several of one finding the largest); planted ones by default.
    """
    counts = word_counts(docs)
    words, table = dictionary(counts), transitions(counts)
    found, names = with_features(candidates(docs), words, table)
    found = written(found, "candidates")
    if labels is None:
        labelled = written(with_features(planted(found), words, table)[0], "labelled")
    else:
        known = labels.groupBy("doc_id", "ordinal").agg(F.max(F.col("label").cast("double")).alias("label"))
        labelled = found.join(known, ["doc_id", "ordinal"])
    rows = scored(found, names, train(labelled, names))
    return rows.where(F.col("score") >= threshold).select("doc_id", "ordinal", F.col("candidate").alias("secret"), "score")


def redacted(docs: DataFrame, secrets: DataFrame, key: str = "doc_id", mark: str = MARK) -> DataFrame:
    """docs with each secret of ``secrets`` (as of scan(), of the column ``key``) replaced by mark, and n_chars as it is then.

    Other texts, and all characters around a secret (U+0001 too), stay as they are. Rows that share a key (or have none) share secrets:
    they are replaced where the same stands at the same place. Give rows a key of their own where many share one.
    """
    held = secrets.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("ordinal", "secret")).alias("__secrets"))
    rows = docs.join(held, docs[key].eqNullSafe(held["__doc"]), "left").withColumn("__parts", F.when(F.col("__secrets").isNotNull(), parts_of("text")))
    of = lambda p, i: F.struct(p.alias("part"), F.array_contains(F.col("__secrets"), F.struct(i.alias("ordinal"), p.alias("secret"))).alias("secret"))
    put = lambda acc, p: F.struct(F.concat(acc["text"], F.when(p["secret"], F.lit(mark)).otherwise(F.substring(F.col("text"), acc["at"], F.length(p["part"])))).alias("text"), (acc["at"] + F.length(p["part"])).alias("at"))
    text = F.aggregate(F.transform("__parts", of), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), put, lambda acc: acc["text"])
    # Parts have a space for U+0001: only texts with one are put together from the text itself.
    joined = F.array_join(F.transform("__parts", lambda p, i: F.when(of(p, i)["secret"], F.lit(mark)).otherwise(p)), "")
    text = F.when(F.contains("text", F.lit("\x01")), text).otherwise(joined)
    changed = F.when(F.col("__secrets").isNotNull() & F.col("text").isNotNull(), text).otherwise(F.col("text"))
    rows = rows.withColumn("text", changed)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__secrets").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
