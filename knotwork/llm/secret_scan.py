"""Secret scans [native]: a random forest removes the false positives of a candidate pattern.

Candidates are runs of LEAST characters or more of the alphabet of keys, found in the words of a text. Their features are length, changes
between kinds of characters, distinct characters, shares of digits and of characters that dictionary words cover, words of the path
and of the neighbourhood. A forest trained from labelled findings decides.

Training uses the DataFrame learner on at most MOST_FINDINGS labelled rows (drawn by hash). The trees are then written out as literal
arrays, which one SQL expression walks, so scoring happens in the scan's stage: no shuffle, no Python, one pass over the texts, any
group sizes, and generated code of one size for any forest.

Without findings of their own, users get ``synthetic_findings``: labelled rows made from numbered hashes. Values (keys, digests,
identifiers, words, paths, numbers) and contexts (announced as a key, as something else, not at all; quoted or not; example paths or
not) are drawn apart from each other, so no single feature gives the label away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_unit, table

LEAST = 16
MOST_FINDINGS = 20_000
TREES, DEPTH, SEED = 20, 7, 7
THRESHOLD = 0.5
SYNTHETIC_ROWS = 12_000

#: Words that keys don't contain, words that announce keys, words that announce other things, what providers begin their
#: keys with, folders of examples.
DICTIONARY = [
    "about", "access", "after", "account", "and", "application", "array", "block", "build", "class", "client", "code", "config", "connection", "content", "context",
    "data", "default", "document", "error", "event", "example", "file", "for", "from", "function", "group", "handler", "have", "header", "http", "image", "index",
    "ing", "ion", "item", "key", "label", "level", "line", "list", "long", "manager", "message", "method", "model", "module", "name", "node", "number", "object",
    "order", "page", "parameter", "password", "path", "process", "property", "query", "request", "response", "result", "secret", "service", "session", "source",
    "string", "table", "test", "that", "the", "this", "tion", "token", "type", "user", "value", "version", "with", "work",
]
DICTIONARY_OF_CONTEXT = ["about", "after", "and", "content", "file", "for", "from", "have", "in", "is", "list", "method", "of", "page", "process", "see", "that", "the", "this", "to", "value", "with", "work"]
ANNOUNCE_KEY = ["api", "auth", "bearer", "credential", "key", "passwd", "password", "pwd", "secret", "token"]
ANNOUNCE_OTHER = ["checksum", "commit", "digest", "etag", "example", "hash", "md5", "revision", "sha", "sha1", "sha256", "uuid", "version"]
PROVIDER_MARKS = ["sk_live_", "ghp_", "xoxb-", "glpat-", "AKIA"]
EXAMPLE_PATHS = ["doc", "example", "fixture", "mock", "sample", "test"]

FEATURES = ["n", "changes", "provider", "familiar", "distinct", "digits", "uppers", "marks", "hexadecimal", "dictionary", "announced", "denied", "assigned", "quoted", "example_path"]


def familiar_pairs() -> str:
    """A pattern for the first of two letters that stand side by side in a word of the dictionary."""
    after: dict[str, set[str]] = {}
    for word in DICTIONARY:
        for a, b in zip(word, word[1:], strict=False):
            after.setdefault(a, set()).add(b)
    return "(?i)(" + "|".join(f"{a}(?=[{''.join(sorted(bs))}])" for a, bs in sorted(after.items())) + ")"


def any_of(words: list[str]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of candidate, word (that holds it), before1, before2 (the words before) and path; nulls count as ''."""
    c = F.col("candidate")
    near = F.lower(F.concat_ws(" ", "before2", "before1", F.expr("substring_index(word, candidate, 1)")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    n = F.length(c)

    def count(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(c, pattern, ""))

    return rows.withColumns(
        {
            "n": n.cast("double"),
            "provider": c.rlike("^(" + "|".join(PROVIDER_MARKS) + ")").cast("double"),
            "changes": (F.length(kinds) - 1).cast("double"),
            "familiar": count(familiar_pairs()) / n,
            "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double"),
            "digits": count("[0-9]") / n,
            "uppers": count("[A-Z]") / n,
            "marks": count("[A-Za-z0-9]") / n,
            "hexadecimal": c.rlike("^(0x)?([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "dictionary": count(any_of(sorted(DICTIONARY, key=len, reverse=True))) / n,
            "announced": near.rlike("(" + "|".join(ANNOUNCE_KEY) + ")").cast("double"),
            "denied": near.rlike(r"\b(" + "|".join(ANNOUNCE_OTHER) + r")\b").cast("double"),
            "assigned": near.rlike("[=:]").cast("double"),
            "quoted": F.col("word").rlike("[\"'`]").cast("double"),
            "example_path": F.coalesce(F.col("path"), F.lit("")).rlike(any_of(EXAMPLE_PATHS)).cast("double"),
        }
    )


def candidates(docs: DataFrame, carry: list[str], text: str = "text", path: str | None = "source") -> DataFrame:
    """The carried columns (in __carry), position (of the word, from 1), candidate, word, before1, before2, path.

    A row per run of key characters, of which a word can hold several. ``word`` is what stands around the run, from the run before it
    to the next one; where no letter or digit does, with the run before it. A value of LEAST characters or more is a run of its own,
    apart from the name and "=" before it.
    """
    run = f"[A-Za-z0-9_+/=.~-]{{{LEAST},}}"
    place = F.col(path).cast("string") if path else F.lit("")
    kept = docs.where(F.col(text).rlike(run)).select(F.struct(*carry).alias("__carry"), F.coalesce(place, F.lit("")).alias("path"), F.split(text, r"\s+").alias("w"))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(run), i)), lambda i: i.isNotNull())
    # words have no white space, so a line break can stand for the place where a value begins
    apart = F.regexp_replace(F.get("w", F.col("i")), f"=(?=[A-Za-z0-9_+/.~-]{{{LEAST}}})", "=\n")
    found = kept.select("__carry", "path", "w", F.explode(hits).alias("i")).withColumn("apart", apart)
    found = found.select("*", F.split("apart", run).alias("around"), F.posexplode(F.regexp_extract_all("apart", F.lit(run), F.lit(0))).alias("k", "candidate"))
    earlier = F.when((F.col("k") > 0) & ~F.get("around", F.col("k")).rlike("[A-Za-z0-9]"), F.get(F.regexp_extract_all("apart", F.lit(run), F.lit(0)), F.col("k") - 1))
    return found.select(
        "__carry",
        (F.col("i") + 1).cast("long").alias("position"),
        "candidate",
        F.regexp_replace(F.concat(F.coalesce(earlier, F.lit("")), F.get("around", F.col("k")), "candidate", F.get("around", F.col("k") + 1)), "\n", "").alias("word"),
        F.coalesce(F.get("w", F.col("i") - 1), F.lit("")).alias("before1"),
        F.coalesce(F.get("w", F.col("i") - 2), F.lit("")).alias("before2"),
        "path",
    )


def synthetic_findings(spark: SparkSession, rows: int = SYNTHETIC_ROWS) -> DataFrame:
    """candidate, word, before1, before2, path, label: half keys, half what is mistaken for them, from hashes of their numbers."""
    i = F.col("id").cast("string")
    h, g = F.sha2(F.concat(F.lit("a"), i), 256), F.sha2(F.concat(F.lit("b"), i), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(g)), "[+/=\r\n]", "")

    def pick(words: list[str], salt: str) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(hash_unit(F.lit(salt), i) * len(words)) + 1).cast("int"))

    def fold(count: int, salt: str) -> Column:
        return F.concat(*[pick(DICTIONARY, f"{salt}{k}") for k in range(count)])

    def size(least: int, most: int, salt: str) -> Column:
        return (F.floor(hash_unit(F.lit(salt), i) * (most - least + 1)) + least).cast("int")

    kind = pick([str(x) for x in range(12)], "kind")
    plain = F.left(h, size(16, 64, "n"))
    letters = F.translate(F.left(g, size(16, 28, "l")), "0123456789abcdef", "etaoinshrdlucmfw")  # words of any language
    joint = pick(["", "_", "-", "."], "j")
    candidate = (
        F.when(kind == "0", plain)
        .when(kind == "1", F.upper(plain))
        .when(kind == "2", b64)
        .when(kind == "3", F.concat(pick(PROVIDER_MARKS[:4], "p"), F.left(b64, size(20, 36, "m"))))
        .when(kind == "10", F.concat(F.lit("AKIA"), F.upper(F.left(b64, F.lit(16)))))
        .when(kind == "11", F.concat(F.when(hash_unit(F.lit("case"), i) < 0.5, letters).otherwise(F.upper(letters)), pick(["", "", ".", "-"], "end")))
        .when(kind == "4", F.left(h, F.when(hash_unit(F.lit("digest"), i) < 0.5, 40).otherwise(64)))
        .when(kind == "5", F.concat(F.left(h, F.lit(8)), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.left(g, F.lit(12))))
        .when(kind == "6", F.concat(fold(1, "w0"), *[F.concat(joint, fold(1, f"w{k}")) for k in range(1, 4)]))
        .when(kind == "7", F.concat(fold(2, "x"), F.lit("/"), fold(2, "y"), F.lit("."), pick(["py", "html", "js", "txt"], "e")))
        .when(kind == "8", F.repeat(pick(["-", "=", "x", "0", "abc"], "r"), size(18, 40, "o")))
        .otherwise(F.concat(F.conv(F.left(h, F.lit(13)), 16, 10), F.lit("."), F.conv(F.left(g, F.lit(6)), 16, 10)))
    )
    context = pick(["key", "key", "other", "none"], "context")
    before2 = F.when(context == "key", pick(ANNOUNCE_KEY, "k")).when(context == "other", pick(ANNOUNCE_OTHER, "o")).otherwise(pick(DICTIONARY_OF_CONTEXT, "d"))
    before1 = F.when(context == "none", pick(DICTIONARY_OF_CONTEXT, "c")).otherwise(pick(["=", ":", "=", "is"], "s"))
    quote = pick(['"', "'", "", ""], "q")
    path = pick([*EXAMPLE_PATHS, *["src", "web", "mail", "news"] * 3], "f")
    # random values are keys where they are announced as such, those with a provider's mark unless they are announced as something else
    marked = kind.isin("3", "10")
    label = (kind.isin("0", "1", "2", "3", "4", "10") & (context == "key")) | (marked & (context == "none"))
    out = spark.range(0, rows, 1, 1).select("id", candidate.alias("candidate"), before1.alias("before1"), before2.alias("before2"), path.alias("path"), label.cast("double").alias("label"), quote.alias("q"))
    return out.withColumn("word", F.concat("q", "candidate", "q")).where(F.length("candidate") >= LEAST).drop("q")


def train(findings: DataFrame) -> str:
    """The forest as SQL over FEATURES: the mean share of keys at the leaves. Both labels must occur.

    findings: id, candidate, word, before1, before2, path, label (0 or 1). Of more than MOST_FINDINGS rows, a sample by hash of id.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.where("label IS NOT NULL AND candidate <> ''")
    n = rows.count()
    if n > MOST_FINDINGS:
        rows = rows.where(hash_unit(F.lit("findings"), F.col("id").cast("string")) < MOST_FINDINGS / n)
    prepared = VectorAssembler(inputCols=FEATURES, outputCol="__x").transform(features(rows)).select("id", "label", "__x")
    # one sorted partition of bounded size: the bootstrap doesn't depend on how the rows lay
    model = RandomForestClassifier(featuresCol="__x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(prepared.coalesce(1).sortWithinPartitions("id"))

    inner = 2**DEPTH - 1
    which, bounds, leaves = [], [], []
    for tree in model.trees:
        # a complete tree: node k has the children 2 k + 1 and 2 k + 2; below a leaf, both ways lead to its value
        feature, bound, leaf = [0] * inner, [0.0] * inner, [0.0] * (inner + 1)

        def place(node, k: int, feature=feature, bound=bound, leaf=leaf) -> None:
            if k >= inner:
                stats = node.impurityStats().stats()
                leaf[k - inner] = float(stats[1]) / (float(stats[0]) + float(stats[1]))
            elif node.subtreeDepth() == 0:
                place(node, 2 * k + 1)
                place(node, 2 * k + 2)
            else:
                split = node.split()
                feature[k], bound[k] = split.featureIndex(), float(split.threshold())
                place(node.leftChild(), 2 * k + 1)
                place(node.rightChild(), 2 * k + 2)

        place(tree._java_obj.rootNode(), 0)
        which.append(feature)
        bounds.append(bound)
        leaves.append(leaf)

    def rows_of(values: list[list], suffix: str) -> str:
        return "array(" + ", ".join("array(" + ", ".join(f"{v!r}{suffix}" for v in row) + ")" for row in values) + ")"

    step = f"2 * k + IF(x[{rows_of(which, '')}[t][k]] <= {rows_of(bounds, 'D')}[t][k], 1, 2)"
    leaf = f"{rows_of(leaves, 'D')}[t][aggregate(sequence(1, {DEPTH}), 0, (k, level) -> {step}) - {inner}]"
    # the features are bound to x, so they are computed once for all trees
    return f"transform(array(array({', '.join(FEATURES)})), x -> aggregate(sequence(0, {len(which) - 1}), 0D, (sum, t) -> sum + {leaf}))[0] / {float(len(which))!r}D"


def scan(docs: DataFrame, carry: list[str], forest: str, text: str = "text", path: str | None = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns plus position, preview, n_chars, sha256 and score of each finding; a word can hold several.

    Secrets aren't repeated: preview is the first four characters. Null and empty texts have no findings; a null path counts as '';
    repeated rows are each scanned. Other columns are left out, so clashing names do no harm. An empty table gives no rows.
    """
    scored = features(candidates(docs, carry, text, path)).withColumn("score", F.round(F.expr(forest), 6))
    return scored.where(F.col("score") >= threshold).select("__carry.*", "position", F.left("candidate", F.lit(4)).alias("preview"), F.length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"], train(synthetic_findings(spark)))
