"""Secret scans with a random forest against false positives, in DataFrame functions only.

Candidates are private key blocks of several lines, runs of 12 and more key characters with a digit
among them or a known prefix, and values of 6 and more characters that are assigned to a secret's name,
in any case, with blanks and quotes between both, or that stand behind "Bearer" and are no plain word.
Each has features of its length, of the transitions between its characters, of how much of it a
dictionary covers (fixed technical words and the corpus' own most frequent ones), of the path it stands
in and of its neighbouring words. A random forest, trained on labelled findings, gives the probability
that it is a secret.

Labelled findings are a table (before, value, after, secret); `labelled_findings` makes one by rule
where none is given, from families of public forms: keys, tokens and passwords against digests,
identifiers, numbers, paths, placeholders and plain words in like surroundings. `family_recall` tells how
a forest fares on a family that it has never seen. The fitted trees become one SQL expression, so
scanning and redacting are a single pass over the texts without a shuffle.

Defined results: null text counts as empty and has no findings, `redact` leaves it null; ids may be
null and rows repeat; extra columns stay in `redact` and are ignored elsewhere; n_chars, where
`redact` finds it, follows the new text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideglass.llm.spans import matches_where

NAMES = r"(?:password|passwd|pwd|secret[_-]?key|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|private|credential|auth|bearer)"
PREFIXES = r"(?:-----BEGIN|AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|glpat-|eyJ)"
KEY = "[A-Za-z0-9_+/-]"
#: Between a name and its value; blanks have a bound, as Java looks behind over bounded lengths only.
GIVES = r"[^\s=:]{0,3}\s{0,16}[=:]{1,2}>?"
ASSIGNED = rf"(?i){NAMES}(?:{GIVES}|\s)"
#: The values behind a name: up to the closing quote, or up to what ends a word, a sentence or a URL's parameter.
QUOTED = r"(?:(?<=\")[^\s\"]{6,}+(?=\")|(?<=')[^\s']{6,}+(?='))"
BARE = r"(?:(?![.)\]}>]++(?:[\s\"',;]|$))[^\s\"'&,;]|&(?![A-Za-z0-9_.%-]*+=)(?!\s|$)){6,}+"
#: The short look behind comes first, as it fails at most places.
BEHIND_NAME = rf"(?<=[=:>\s\"'])(?:(?<=[=:]>?\s{{0,16}}[\"']?)(?<=(?i:{NAMES}){GIVES}\s{{0,16}}[\"']?)|(?<=(?i:bearer)\s{{1,16}}[\"']?)(?=\S*?(?:[0-9_/+=-]|[a-z][A-Z])))"
PEM = r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,8}+-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----"
CANDIDATE = rf"(?:{PEM}|{BEHIND_NAME}(?:{QUOTED}|{BARE})|(?<!{KEY})(?:(?=[A-Za-z_+/-]*+[0-9])|(?={PREFIXES})){KEY}{{12,}}+={{0,2}})"
AROUND = 48
LEAST = 0.5
MARK = "[SECRET]"
TREES, DEPTH, FINDINGS = 20, 6, 6000
CORPUS_WORDS = 2000  # frequent words of the corpus that the dictionary has besides its own

# Words that stand beside secrets, and beside things that look like them.
SECRET_WORDS = rf"(?i){NAMES}"
OTHER_WORDS = r"(?i)(?:commit|sha\d*|md5|digest|checksum|uuid|guid|isbn|version|release|hash|revision|build|card|phone|order|invoice)"
# Common words by which a value's letters are covered.
DICTIONARY = (
    "access account address admin application archive article author backup build cache category change channel check class client code color "
    "command comment common config content control copy count create data database date default delete demo description device document "
    "download driver element email engine error event example export feature field file filter first folder format frame function general "
    "group handler header history home host html image import index info input install item label language level library license line "
    "link list local lock login main manager master media member memory message method model module name network node note number object "
    "office option order output package page parent part password path pattern period placeholder player plugin point policy port post price "
    "process product profile program project property public query question range record reference region release report request resource "
    "response result role root sample schema script search section secret select sender series server service session setting shared simple "
    "source stage start state static status storage store stream string style support system table target task template test text theme thread "
    "title token tool topic type update upload user value variable version video view window word work"
).split()


def char_classes(value: Column) -> Column:
    """Each character's class: a letter for lower, upper, digit and rest."""
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "l"), "[A-Z]", "U"), "[0-9]", "9")
    return F.regexp_replace(kinds, "[^lU9]", "-")


def share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The most frequent words of four and more letters, counted over all texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where(F.length("word") >= 4)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def features(before: Column, value: Column, after: Column, words: list[str] | None = None) -> list[Column]:
    """Doubles in the order of FEATURES. Letters are compared without case where a word is looked for."""
    n = F.length(value)
    kinds = char_classes(value)
    runs = F.length(F.regexp_replace(kinds, r"(.)\1+", "$1"))
    distinct = F.size(F.array_distinct(F.split(value, "")))
    lower = F.lower(value)
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(value, r"(\p{Ll})(\p{Lu})", "$1 $2"), r"[^\p{L}]+", " "), " "), lambda w: F.length(w) >= 4)
    known = F.split(F.lit(" ".join(sorted({*DICTIONARY, *(words or [])}))), " ")
    covered = F.aggregate(F.filter(parts, lambda w: F.array_contains(known, F.lower(w))), F.lit(0), lambda s, w: s + F.length(w))
    vowels = F.length(F.regexp_replace(lower, "[^aeiou]", ""))
    letters = F.length(F.regexp_replace(lower, "[^a-z]", ""))
    near = F.right(before, F.lit(24))
    return [
        n.cast("double"),
        share(F.length(F.regexp_replace(value, "[^0-9]", "")), n),
        share(F.length(F.regexp_replace(value, "[^A-Z]", "")), n),
        share(runs - 1, n),
        share(distinct, n),
        share(vowels, letters),
        F.rlike(lower, F.lit("^[0-9a-f]+$")).cast("double"),
        share(covered, n),
        share(n - F.length(F.replace(value, F.lit("-"), F.lit(""))), n),
        share(n - F.length(F.replace(value, F.lit("/"), F.lit(""))), n),
        F.rlike(before, F.lit(r"(?:://|/|\.)\S*$")).cast("double"),
        F.rlike(near, F.lit(SECRET_WORDS + r"\S{0,3}\s*[=:]?\s*[\"']?$")).cast("double"),
        F.rlike(near, F.lit(OTHER_WORDS)).cast("double"),
        F.rlike(before, F.lit(r"[=:]\s*[\"']?$")).cast("double"),
        F.rlike(value, F.lit(f"^{PREFIXES}")).cast("double"),
        F.rlike(lower, F.lit(r"(?:example|sample|placeholder|changeme|xxxx|0000|1234|test)")).cast("double"),
        F.rlike(after, F.lit(r"^(?:\.[A-Za-z]{2,4}\b|/|@)")).cast("double"),
    ]


FEATURES = ("length", "digits", "upper", "transitions", "distinct", "vowels", "hex", "dictionary", "hyphens", "slashes", "in_path", "secret_word", "other_word", "assigned", "prefix", "placeholder", "goes_on")


def labelled_findings(spark: SparkSession, rows: int = FINDINGS, without: tuple[str, ...] = ()) -> DataFrame:
    """(family, before, value, after, secret): findings made by rule from hashes of the row number."""
    h = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(h)), "[=\r\n]", "")
    plain = F.regexp_replace(b64, "[+/]", "x")
    base32 = F.translate(F.upper(F.conv(F.substring(h, 1, 15), 16, 32)), "01", "AB")
    base32 = F.concat(base32, F.translate(F.upper(F.conv(F.substring(h, 20, 15), 16, 32)), "01", "AB"))
    numbers = F.regexp_replace(h, "[a-f]", "")

    def pick(*choices) -> Column:
        return F.element_at(F.array(*(F.lit(c) for c in choices)), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(len(choices))) + 1).cast("int"))

    words = pick("configManager", "release_notes", "imageServer", "template-index", "userProfile", "document_list", "networkSession", "dataTable")
    prose = pick("and the ", "of in to. ", "see also, ", "mit und der ", "les que de ", "con la para ", "")
    letters = F.regexp_replace(plain, "[0-9]", "")
    assigned = pick("password: ", "secret = ", "PASSWORD=", "pwd='", "token: ", "private: ", 'access_key="')
    keyed = pick("api_key=", "secret: ", "ACCESS_KEY = ", 'apiKey: "', "private_key='", "auth = ", "credential: ", "secret-key=")
    said = pick("required", "nobody", "please", "members", "something", "loaded", "string", "optional", "another", "Johannes", "forgotten", "niemand", "personne", "siempre", "usuario", "Anmeldung", "between", "function")
    pem = pick("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY")
    cases = [
        # (family, before, value, secret)
        ("vendor id", prose, F.concat(pick("AKIA", "ASIA"), F.substring(base32, 1, 16)), 1),
        ("hex key", F.concat(prose, keyed), F.left(h, pick(20, 24, 32, 48, 64)), 1),
        ("mixed key", F.concat(prose, keyed), F.left(plain, pick(16, 22, 32, 43)), 1),
        ("mixed password", F.concat(prose, pick("passwd: ", "pwd=", "password: ", "Password = ")), F.concat(F.left(plain, pick(6, 8, 10, 13)), F.lit("9")), 1),
        ("vendor token", prose, F.concat(pick("ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"), F.substring(plain, 1, 36)), 1),
        ("web token", F.concat(prose, F.lit("Bearer ")), F.concat(F.lit("eyJ"), F.substring(plain, 1, 60)), 1),
        ("bare key", prose, F.left(b64, pick(40, 64, 86)), 1),
        ("letter password", F.concat(prose, assigned), F.concat(F.left(letters, pick(6, 7, 9)), pick("!", "#x", "", "$", "%K")), 1),
        ("word password", F.concat(prose, assigned), F.concat(pick("hunter", "Dragon", "summer", "monkey", "Shadow", "football", "letmein", "Winter"), F.substring(numbers, 1, 2)), 1),
        ("key block", prose, F.concat(F.lit("-----BEGIN "), pem, F.lit("-----\n"), b64, F.lit("\n"), F.substring(plain, 3, 40), F.lit("==\n-----END "), pem, F.lit("-----")), 1),
        ("commit", F.concat(prose, pick("commit ", "sha1: ", "revision ", "build ")), F.substring(h, 1, 40), 0),
        ("digest", F.concat(prose, pick("md5 ", "checksum: ", "digest ", "hash = ")), F.left(h, pick(32, 64)), 0),
        ("uuid", F.concat(prose, pick("uuid ", "", "id=")), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), 0),
        ("number", F.concat(prose, pick("card ", "", "order ", "phone: ", "invoice ")), F.left(numbers, pick(12, 14, 16)), 0),
        ("versioned name", prose, F.concat(words, F.lit("Version"), F.substring(numbers, 1, 2)), 0),
        ("path", F.concat(prose, pick("https://www.host.org/", "/usr/local/", "src/main/")), F.concat(words, F.lit("/"), words, F.substring(numbers, 1, 3)), 0),
        ("placeholder", F.concat(prose, pick("password=", "token=", "secret: ")), F.concat(pick("example_", "placeholder", "changeme_", "sampleValue"), F.substring(numbers, 1, 4)), 0),
        ("dated name", prose, F.concat(F.substring(numbers, 1, 4), F.lit("-"), F.substring(numbers, 5, 2), F.lit("-"), F.substring(numbers, 7, 2), F.lit("-"), words), 0),
        ("letters and number", prose, F.concat(F.substring(F.regexp_replace(h, "[0-9]", "a"), 1, 8), F.lit("er"), F.substring(numbers, 1, 4)), 0),
        ("assigned word", F.concat(prose, assigned), said, 0),
        ("spoken word", F.concat(prose, pick("Bearer ", "credentials = ", "bearer ", "auth: ", "secret: ")), F.initcap(said), 0),
    ]
    cases = [c for c in cases if c[0] not in without]
    kind = F.pmod(F.col("id"), F.lit(len(cases))).cast("int")
    made = F.element_at(F.array(*(F.struct(F.lit(n).alias("family"), b.alias("before"), v.alias("value"), F.lit(y).alias("secret")) for n, b, v, y in cases)), kind + 1)
    return spark.range(0, rows, 1, 2).select(made.alias("m"), pick(" the", '" and', ".", "\n", " ").alias("after")).select("m.family", "m.before", "m.value", "after", "m.secret")


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, words: list[str] | None = None) -> list:
    """Trees as nested (feature, threshold, left, right) with probabilities as leaves."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("before", "value", "after")]
    rows = findings.where(F.col("secret").isNotNull()).select(*(f.alias(name) for f, name in zip(features(*texts, words), FEATURES, strict=True)), F.col("secret").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("x", "label")
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, maxBins=32).fit(rows)

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return float(stats[1] / max(sum(stats), 1e-9)) if len(stats) > 1 else 0.0
        split = node.split()
        return (int(split.featureIndex()), float(split.threshold()), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(tree._call_java("rootNode")) for tree in model.trees]


def forest_score(trees: list, values: list[Column]) -> Column:
    def of(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        feature, threshold, low, high = node
        return F.when(values[feature] <= threshold, of(low)).otherwise(of(high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return total / max(1, len(trees))


def family_recall(spark: SparkSession, family: str, rows: int = FINDINGS, least: float = LEAST) -> float:
    """Share of a family that a forest trained without it judges rightly."""
    trees = train(labelled_findings(spark, rows, (family,)))
    texts = [F.col(c) for c in ("before", "value", "after")]
    own = labelled_findings(spark, rows).where(F.col("family") == family).withColumn("x", F.array(*features(*texts)))
    right = (forest_score(trees, [F.col("x")[j] for j in range(len(FEATURES))]) >= least).cast("int") == F.col("secret")
    return float(own.agg(F.avg(right.cast("int"))).first()[0])


def may_have_candidates(text: str) -> Column:
    """A cheap test that every text with a candidate passes."""
    return F.rlike(text, F.lit("[0-9]")) | F.rlike(text, F.lit(PREFIXES)) | F.rlike(text, F.lit(ASSIGNED))


def add_findings(df: DataFrame, text: str, trees: list, out: str = "findings", words: list[str] | None = None) -> DataFrame:
    """Adds array<struct<start,end,value,score>> of all candidates of the column `text`."""
    df = df.withColumn("__hits", matches_where(may_have_candidates(text), F.col(text), CANDIDATE, AROUND))
    df = df.withColumn("__features", F.transform("__hits", lambda m: F.array(*features(m["before"], m["value"], m["after"], words))))

    def scored(m: Column, i: Column) -> Column:
        x = F.get("__features", i)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), forest_score(trees, [x[j] for j in range(len(FEATURES))]).alias("score"))

    return df.withColumn(out, F.transform("__hits", scored)).drop("__features", "__hits")


def fitted(docs: DataFrame, findings: DataFrame | None, text_col: str) -> tuple[list, list[str]]:
    """The trees, and the corpus' words that their features use."""
    words = corpus_words(docs, text_col)
    return train(findings if findings is not None else labelled_findings(docs.sparkSession), words=words), words


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, start, end (code points), value_sha256, score, is_secret of every candidate."""
    trees, words = fitted(docs, findings, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # explode_outer: the filter that explode brings would compute the findings a second time
    rows = add_findings(source.where(may_have_candidates("text")), "text", trees, words=words).select("doc_id", F.explode_outer("findings").alias("f")).where("f is not null")
    return rows.select("doc_id", F.col("f.start").cast("bigint").alias("start"), F.col("f.end").cast("bigint").alias("end"), F.sha2(F.encode("f.value", "UTF-8"), 256).alias("value_sha256"), F.round("f.score", 6).alias("score"), (F.col("f.score") >= least).alias("is_secret"))


def redact(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text", least: float = LEAST, mark: str = MARK) -> DataFrame:
    """The rows of `docs` with each secret in their texts replaced by `mark`."""
    trees, words = fitted(docs, findings, text_col)
    columns = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = add_findings(rows, "__text", trees, words=words)
    # between the candidates the text stays, so the new one is put together in one go
    said = F.transform("findings", lambda f: F.when(f["score"] >= least, F.lit(mark)).otherwise(f["value"]))
    pieces = F.zip_with(F.split("__text", CANDIDATE, -1), said, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    rows = rows.withColumn("__new", F.when(F.exists("findings", lambda f: f["score"] >= least), F.array_join(pieces, "")))
    kept = []
    for c in columns:
        old = F.col("__row").getField(c)
        if c == text_col:
            old = F.coalesce(F.col("__new"), old.cast("string"))
        elif c == "n_chars":
            old = F.when(F.col("__new").isNotNull(), F.length("__new").cast(docs.schema[c].dataType)).otherwise(old)
        kept.append(old.alias(c))
    return rows.select(*kept)
