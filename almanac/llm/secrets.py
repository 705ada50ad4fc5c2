"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and ML functions only.

A candidate is a value in a text that could be a key, token or password: a long run of key characters with letters and
digits mixed, a value that is assigned to a name like ``password``, or one with a well-known prefix. It stands in a
word, and the two words before and the word after are its neighbours.

Features: length; transitions between kinds of characters and between vowels and consonants; the share of letters
covered by dictionary words (those of a ``dictionary``, such as the whole words of a tokenizer's vocabulary; training
and scan must have the same); what the path says (tests, documentation, examples) and whether the value itself is part
of a path or address; and what the neighbouring words say (credential names, or names of harmless values such as
checksums). The forest is trained from labelled findings, at most ``max_findings`` of them, those of the smallest
hash; without any, from findings drawn by a seeded generator of common formats (``example_findings``).

All patterns are matched in time that is linear in the text: a run is looked at from its beginning only.

Defined results: a null or empty text has no candidate. A word may hold several candidates, all of which count. A value
that stands in a text several times is one candidate each time. Rows are scanned one by one, repeated or not. A null path says nothing. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import random
import re
import string
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that go with credentials, and names of values that look like them and are harmless. Fixed values.
CREDENTIAL = r"(?i)pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|client[_-]?key"
HARMLESS = r"(?i)commit|sha-?(?:1|256|512)?\b|md5|checksum|digest|etag|uuid|guid|isbn|doi|phone|tel\b|order|invoice|version|build|serial|tracking|hash"
#: Frequent words and syllable groups of ordinary writing, for dictionary coverage. Fixed values.
DICTIONARY = "the and tion ing ment ent for with that this from have was not are all can has new data file test user name value key example system report version page index image list item number group order state open close read write time date year house world water light".split()
#: Prefixes that providers give to keys. Fixed values.
PREFIXES = r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[0-9a-zA-Z]{24}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"
# one that is no part of a longer word
_PREFIXED = rf"(?<![A-Za-z0-9])(?:{PREFIXES})(?![A-Za-z0-9])"
# a whole run (or what a match before it left of it) of at least 14 key characters with a digit and a letter
_RUN = r"(?:(?<![A-Za-z0-9+/_=.-])|\G)(?=[A-Za-z0-9+/_=.-]{14})(?=[A-Za-z+/_=.-]*+[0-9])(?=[0-9+/_=.-]*+[A-Za-z])[A-Za-z0-9+/_=.-]++"
# an & ends an assigned value where a further ``name=`` follows; elsewhere it may be part of a password
_AND = r"&(?!(?:amp;)?[\w.\[\]-]{1,64}=)"
_PART = r"[^\s\"'=:,;&]"
_VALUE = rf"(?=(?:{_PART}|{_AND}){{6}}){_PART}*+(?:{_AND}{_PART}*+)*+"
#: The name with its sign, and the value.
_ASSIGNED = rf"((?:{CREDENTIAL})[\"']?[=:])[\"']?({_VALUE})"
_ASSIGNS = rf"(?:{CREDENTIAL})[\"']?\s*[=:]+\s*[\"']?$"
_SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("length", "kinds", "transitions", "digit_share", "upper_share", "consonant_runs", "vowel_turns", "distinct_share", "dictionary", "separators", "in_path", "path_harmless", "path_config", "credential_near", "harmless_near", "assigned", "prefixed", "hex_only")


def candidates(docs: DataFrame, path_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` but text and clashing ones as ``row``, and value, before, after and path of each candidate."""
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    # which texts hold any at all is asked first, over the text as it stands
    hopeful = docs.where(F.col("text").rlike(rf"{_RUN}|{_PREFIXED}|{_ASSIGNED}|(?:{CREDENTIAL})[\"']?\s*[=:]"))
    words = F.split("text", _SPACE)
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    near = lambda i: F.trim(F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1)))

    split = hopeful.select(F.col("doc_id"), path.alias("path"), words.alias("words"), numbered.alias("numbered"))
    # a word counts for itself, or as what follows ``name =``
    is_one = lambda s: s["w"].rlike(rf"{_RUN}|{_PREFIXED}|{_ASSIGNED}") | (F.length(s["w"]) >= 6) & near(s["i"]).rlike(_ASSIGNS)
    found = split.select("doc_id", "path", "words", F.explode(F.filter("numbered", is_one)).alias("hit"))
    every = lambda c, pattern, group=0: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    i, w = F.col("hit.i"), F.col("hit.w")
    # a word can hold several: all that are assigned in it, then all that stand alone in what is left, prefixed ones first
    found = found.withColumns({"names": every(w, _ASSIGNED, 1), "assigned": every(w, _ASSIGNED, 2), "rest": F.regexp_replace(w, _ASSIGNED, " "), "near": near(i)})
    runs = F.transform(every(F.regexp_replace("rest", _PREFIXED, " "), rf"{PREFIXES}|{_RUN}"), lambda r: F.regexp_replace(r, r"[.]+$", ""))
    found = found.withColumn("alone", F.concat(every("rest", _PREFIXED), runs))
    # what follows ``name =`` is the whole word, or in a word with others what it begins with
    plain = F.regexp_replace(w, r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")
    lead = F.regexp_extract("rest", rf"^[\"'(\[{{<]*({_VALUE})", 1)
    known = F.exists("alone", lambda r: F.contains(lead, r) | F.contains(r, lead))
    follows = F.when((F.size("assigned") == 0) & (F.size("alone") == 0), F.array(plain)).when(F.col("near").rlike(_ASSIGNS) & (lead != "") & ~known, F.array(lead)).otherwise(F.array().cast("array<string>"))
    near_ones = F.transform(F.concat(follows, "alone"), lambda v: F.struct(F.col("near").alias("before"), v.alias("value")))
    assigned = F.zip_with("names", "assigned", lambda n, v: F.struct(F.concat_ws(" ", F.get("words", i - 1), n).alias("before"), v.alias("value")))
    found = found.select("doc_id", "path", F.explode(F.concat(assigned, near_ones)).alias("one"), F.coalesce(F.get("words", i + 1), F.lit("")).alias("after"), i.alias("place"))
    return found.select("doc_id", "path", "one.before", "one.value", "after", "place").where(F.length("value") >= 6)


def vocabulary_words(rank_file: str, n: int = 4096) -> tuple[str, ...]:
    """The first ``n`` entries of a tokenizer's rank file that are whole words: a space and 4 to 12 letters a-z."""
    found = []
    with open(rank_file, "rb") as lines:
        for token, _ in sorted(map(bytes.split, lines), key=lambda x: int(x[1])):
            word = base64.b64decode(token)
            if re.fullmatch(rb" [a-z]{4,12}", word):
                found.append(word[1:].decode())
                if len(found) == n:
                    break
    return tuple(found)


def any_of(words: Sequence[str]) -> str:
    """A pattern for the longest of the words at a place, branching letter by letter."""
    tree: dict = {}
    for word in words:
        at = tree
        for letter in word:
            at = at.setdefault(letter, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [re.escape(letter) + pattern(rest) for letter, rest in sorted(at.items()) if letter]
        inner = f"(?:{'|'.join(ways)})" if len(ways) > 1 else "".join(ways)
        return f"(?:{inner})?" if "" in at and ways else inner

    return pattern(tree)


def with_features(found: DataFrame, dictionary: Sequence[str] = DICTIONARY) -> DataFrame:
    """``found`` (value, before, after, path) with the columns of FEATURES, all doubles."""
    v = F.col("value")
    n = F.length(v).cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    says = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False)).cast("double")
    letters = F.greatest(count("[A-Za-z]"), F.lit(1.0))
    uncovered = F.length(F.regexp_replace(F.lower(v), any_of(dictionary) + "|[^a-z]", "")).cast("double")
    turns = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    kinds = sum((says("value", k) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")), F.lit(0.0))
    made = {
        "length": n, "kinds": kinds, "transitions": count(turns) / n, "digit_share": count("[0-9]") / n, "upper_share": count("[A-Z]") / n,
        "consonant_runs": count("(?i)[bcdfghjklmnpqrstvwxz]{4,}") / n, "vowel_turns": count("(?i)(?<=[aeiouy])(?=[bcdfghjklmnpqrstvwxz])") / letters,
        "distinct_share": F.size(F.array_distinct(F.split(v, ""))) / n, "dictionary": 1 - uncovered / letters, "separators": count("[-_./+=]") / n,
        "in_path": says("value", r"/[^/]+/|\.(?:[a-z]{2,4})(?:/|$)|^\.{0,2}/|://"), "path_harmless": says("path", r"(?i)test|example|sample|docs?/|\.md$|fixture|mock"),
        "path_config": says("path", r"(?i)\.env|config|settings|\.ya?ml$|\.ini$|secret|credential"), "credential_near": says("before", CREDENTIAL), "harmless_near": F.greatest(says("before", HARMLESS), says("after", HARMLESS)),
        "assigned": says("before", _ASSIGNS), "prefixed": says("value", rf"^(?:{PREFIXES})$"), "hex_only": says("value", "^(?:[0-9a-f]+|[0-9A-F]+)$"),
    }
    return found.withColumns({f: made[f] for f in FEATURES})


def example_findings(n: int = 3000, seed: int = 5, formats: Callable[[int], bool] = lambda f: True) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, path, label) in common formats: keys, tokens and passwords, and what is taken for them.

    ``formats`` says by their numbers which formats to draw from, secrets and others alike, so that some can be held out.
    """
    rng = random.Random(seed)
    some = lambda chars, a, b=None: "".join(rng.choices(chars, k=rng.randint(a, b or a)))
    hex_, base, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits
    word = lambda: "".join(rng.choices(DICTIONARY + ["er", "on", "re", "ti", "an", "es", "or", "le", "en", "al"], k=rng.randint(1, 4)))
    names = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_key", "private_key"]
    harmless = ["commit", "sha256", "sha1", "md5", "checksum", "digest", "etag", "uuid", "build", "version", "order", "invoice", "serial", "tracking", "isbn"]
    bad_paths, good_paths = ["config/app.env", "settings.yaml", "deploy/config.ini", "src/main", ""], ["docs/readme.md", "tests/fixture", "example/sample", "src/main", ""]
    positive = [
        lambda: ("AKIA" + some(string.ascii_uppercase + string.digits, 16), word()), lambda: ("ghp_" + some(alnum, 36), word()), lambda: ("sk_live_" + some(alnum, 24), word()),
        lambda: (some(hex_, 16, 64), f"{rng.choice(names)} {rng.choice(['=', ':', ''])}".strip()), lambda: (some(alnum, 12, 40), f"{rng.choice(names)}{rng.choice(['=', ':', ' ='])}"),
        lambda: (some(base, 24, 64), f"{rng.choice(names)} ="), lambda: (some(alnum + "!@#$%&*", 8, 20), f"{rng.choice(names)}="), lambda: (some(hex_, 18), "password="), lambda: (some(hex_, 40), "token ="),
    ]
    negative = [
        lambda: (some(hex_, 40), rng.choice(harmless)), lambda: (some(hex_, 64), f"{rng.choice(harmless)}:"), lambda: (str(uuid.UUID(int=rng.getrandbits(128))), f"{word()} {rng.choice(['uuid', 'id', word()])}"),
        lambda: ("-".join(word() for _ in range(4)) + str(rng.randint(1, 2030)), word()), lambda: ("/" + "/".join(word() for _ in range(4)) + f"/{rng.randint(1, 999)}.html", word()),
        lambda: (f"www.{word()}.com/{word()}/{rng.randint(1, 99999)}", word()), lambda: (f"{word()}.{word()}{rng.randint(1, 99)}@{word()}.com", word()), lambda: (f"{rng.randint(1, 12)}-{rng.randint(1, 28)}-{rng.randint(1990, 2030)}T{rng.randint(0, 23)}:00:00", word()),
        lambda: ("".join(word() for _ in range(4)) + rng.choice(["", "1", "2"]), word()), lambda: ("_".join(word() for _ in range(4)) + str(rng.randint(0, 9)), f"{word()} ="), lambda: (word() + word(), f"{rng.choice(names)}"),
        lambda: ("your_" + rng.choice(names) + "_here", f"{rng.choice(names)} ="), lambda: ("x" * rng.randint(6, 24), f"{rng.choice(names)}="), lambda: (f"+{rng.randint(1, 99)}-{rng.randint(100, 999)}-{rng.randint(1000000, 9999999)}x{rng.randint(1, 9)}", "phone"),
    ]
    positive, negative = ([f for i, f in enumerate(x) if formats(i)] for x in (positive, negative))
    found = []
    for i in range(n):
        label = i % 2
        value, before = rng.choice(positive if label else negative)()
        found.append((value, f"{word()} {before}" if " " not in before else before, word(), rng.choice(bad_paths if label else good_paths), label))
    return found


def train(spark: SparkSession, findings: DataFrame | None = None, max_findings: int = 20_000, trees: int = 24, depth: int = 7, seed: int = 5, dictionary: Sequence[str] = DICTIONARY) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, path, label 1 or 0)."""
    if findings is None:
        findings = spark.createDataFrame(example_findings(), "value string, before string, after string, path string, label int")
    usable = findings.where("value is not null and value <> '' and label in (0, 1)").dropDuplicates(["value", "before", "after", "path", "label"])
    order = [F.xxhash64("value", "before", "after", "path"), "value", "before", "after", "path", "label"]
    bounded = with_features(usable.orderBy(*order).limit(max_findings), dictionary).withColumn("label", F.col("label").cast("double"))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(bounded)
    # the findings are bounded: in one partition and order, the forest is the same each time
    ready = assembled.select("features", "label", *(x for x in order if isinstance(x, str) and x != "label")).repartition(1).sortWithinPartitions("value", "before", "after", "path", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(ready.select("features", "label"))


def scan(docs: DataFrame, model: RandomForestClassificationModel, path_col: str | None = None, threshold: float = 0.5, dictionary: Sequence[str] = DICTIONARY) -> DataFrame:
    """doc_id, place (number of the word), value, before, score and is_secret of every candidate."""
    found = with_features(candidates(docs, path_col), dictionary)
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "place", "value", "before", "score", (F.col("score") >= threshold).alias("is_secret"))


MASK = "[SECRET]"


def masked(docs: DataFrame, model: RandomForestClassificationModel, path_col: str | None = None, threshold: float = 0.5, dictionary: Sequence[str] = DICTIONARY) -> DataFrame:
    """``docs``, all columns, with every secret value in a text replaced by MASK and n_chars (if there) counted anew.

    Only documents with secrets are joined to them, by a hash of id and text.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))
    tagged = docs.select(F.to_json(key).alias("doc_id"), "text", *([F.col(path_col)] if path_col and path_col not in ("doc_id", "text") else []))
    secrets = scan(tagged, model, path_col, threshold, dictionary).where("is_secret").groupBy("doc_id").agg(F.collect_set("value").alias("__almanac_values"))
    longest_first = F.transform(F.array_sort(F.transform("__almanac_values", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    secrets = secrets.select(F.col("doc_id").alias("__almanac_key"), longest_first.alias("__almanac_values"))
    joined = docs.withColumn("__almanac_key", F.to_json(key)).join(secrets, "__almanac_key", "left")
    text = F.aggregate("__almanac_values", F.col("text"), lambda t, v: F.replace(t, v, F.lit(MASK)))
    out = joined.withColumn("text", F.when(F.col("__almanac_values").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__almanac_values").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
