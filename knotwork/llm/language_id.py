"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of four things: the text's likelihood under a byte-trigram model; the likelihoods of the
declared language (of the markup, or a column) and of the address suffix, given the language; and the host's prior. The prior is smoothed hierarchically:
a host's counts are completed by its domain's, those by the whole corpus's. All of these counts are grouped aggregations of the
languages that the texts alone suggest, over all rows.

The trigram model is fitted on a bounded sample of labelled rows: about SAMPLE_A_LANGUAGE rows of each label, drawn by hash. All else
covers everything. Tables of counts and priors are written to the shared folder before they are joined: Catalyst broadcasts them while
their files are small, and otherwise runs a sort-merge join whose hot host AQE splits, as no aggregation shares its stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_unit, table

SAMPLE_A_LANGUAGE = 1000
#: A label with fewer rows is no language of the model.
LEAST_ROWS = 3
#: Of more labels than these, the most frequent are the model's languages: the model must fit a worker.
MOST_LANGUAGES = 400
BUCKETS = 1 << 14
#: A text counts as much as this many trigrams at most: neighbouring trigrams aren't independent.
EFFECTIVE_TRIGRAMS = 60
#: Rows that a parent's distribution counts for.
PRIOR_ROWS = 20.0
UNKNOWN = "und"
#: Prior probability that a text is in none of the languages; its likelihood is even over all trigrams.
UNKNOWN_PRIOR = 0.001
LEAST_POSTERIOR = 0.5
BATCH_BYTES = 1 << 20

#: ASCII letters stay, other ASCII becomes a space; bytes of other characters stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the texts, -1 for those without a letter; and where each text starts."""
    parts = [b"  " + (t.lower().encode("utf-8", "surrogatepass").translate(LETTERS) if t else b"") + b"  " for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    data = np.frombuffer(b"".join(parts) + b"  ", dtype=np.uint8).astype(np.uint32)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    buckets = ((codes * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    buckets[codes == 0x202020] = -1
    return buckets, np.cumsum(sizes) - sizes


def fit(labelled: DataFrame, key: str, text: str, label: str) -> tuple[list[str], np.ndarray]:
    """The languages, and log P(trigram | language) by bucket and language; the last column is the even distribution's.

    Labels of fewer than LEAST_ROWS rows are no languages, nor those beyond the MOST_LANGUAGES most frequent. About SAMPLE_A_LANGUAGE
    rows of each are fitted, drawn by a hash of key and text, so only rows that are alike in both are drawn together.
    """
    rows = labelled.where(F.col(label).isNotNull() & (F.trim(F.col(text)) != ""))
    frequent = rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "label").limit(MOST_LANGUAGES)
    sizes = {r["label"]: r["n"] for r in frequent.collect()}
    languages = sorted(sizes)
    counts = np.full((BUCKETS, len(languages)), 0.1)
    if languages:
        share = F.element_at(F.create_map(*[c for x in languages for c in (F.lit(x), F.lit(SAMPLE_A_LANGUAGE / sizes[x]))]), F.col(label))
        sample = rows.where(F.col(label).isin(languages)).where(hash_unit(F.lit("train"), F.col(key).cast("string"), F.xxhash64(text).cast("string")) < share)
        index = {x: i for i, x in enumerate(languages)}

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            totals = np.zeros(BUCKETS * len(languages), dtype=np.int64)
            for pdf in batches:
                for name, texts in pdf.groupby("label")["text"]:
                    for i in range(0, len(texts), 64):
                        buckets, _ = trigrams(texts.iloc[i : i + 64].tolist())
                        totals += np.bincount(buckets[buckets >= 0] * len(languages) + index[name], minlength=len(totals))
            seen = np.flatnonzero(totals)
            yield pd.DataFrame({"cell": seen, "n": totals[seen]})

        cells = sample.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        np.add.at(counts.reshape(-1), cells["cell"].to_numpy(), cells["n"].to_numpy())
    logs = np.log(counts / counts.sum(axis=0))
    return languages, np.concatenate([logs, np.full((BUCKETS, 1), -np.log(BUCKETS))], axis=1).astype(np.float32)


def likelihoods(docs: DataFrame, text: str, logs: np.ndarray) -> Column:
    """A column: the tempered log likelihood of the text by language, the last for none of them; null without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        logs = np.concatenate([shared.value, np.zeros((1, shared.value.shape[1]), dtype=np.float32)])  # row -1: no letter
        out: list = []
        some: list[str | None] = []
        size = 0

        def flush() -> None:
            buckets, starts = trigrams(some)
            n = np.add.reduceat((buckets >= 0).astype(np.int64), starts)
            sums = np.stack([np.add.reduceat(logs[:, j][buckets], starts, dtype=np.float64) for j in range(logs.shape[1])], axis=1)
            weight = np.minimum(n, EFFECTIVE_TRIGRAMS) / np.maximum(n, 1)
            out.extend(row.tolist() if k else None for row, k in zip(sums * weight[:, None], n, strict=True))

        for t in texts:
            some.append(t)
            size += len(t) if t else 0
            if size >= BATCH_BYTES:
                flush()
                some, size = [], 0
        if some:
            flush()
        return pd.Series(out, dtype=object)

    return score(F.col(text))


def smoothed(counts: DataFrame, by: str, n_languages: int, parent: Column, least: float) -> DataFrame:
    """by, prior: (rows of each language + least x parent) / (all rows + least). counts: by, best, n, parent."""
    per = counts.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"), F.sum("n").alias("all"), F.first("parent").alias("parent"))
    return per.select(by, F.transform(F.sequence(F.lit(0), F.lit(n_languages - 1)), lambda i: (F.coalesce(F.col("m")[i], F.lit(0)) + least * F.get(parent, i)) / (F.col("all") + least)).alias("prior"))


def evidence(scored: DataFrame, what: str, n: int) -> DataFrame:
    """what, log P(what | language): add-one smoothed counts."""
    per = scored.where(F.col(what).isNotNull() & F.col("best").isNotNull()).groupBy(what, "best").agg(F.count("*").alias("n"))
    totals = per.groupBy("best").agg(F.sum("n").alias("all"))  # a row per language
    sums = {r["best"]: r["all"] for r in totals.collect()}
    kinds = max(1, per.select(what).distinct().count())
    by = per.groupBy(what).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("m"))
    cells = [F.log((F.coalesce(F.col("m")[F.lit(i)], F.lit(0)) + 1.0) / float(sums.get(i, 0) + kinds)) for i in range(n)]
    return by.select(what, F.array(*cells).alias(f"log_{what}"))


def declared_language(markup: Column) -> Column:
    """The primary subtag of the html element's lang attribute, or null."""
    return F.nullif(F.lower(F.regexp_extract(markup, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})\b", 1)), F.lit(""))


def address_suffix(host: Column) -> Column:
    """What follows the host's last dot; null without a dot."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def primary_subtag(tag: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(tag, r"^\s*([a-zA-Z]{2,3})\b", 1)), F.lit(""))


def identify(docs: DataFrame, languages: list[str], logs: np.ndarray, host: Column, declared: Column, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns plus language, posterior and accepted; they replace columns of those names.

    A row is accepted if one of the languages is the likeliest and its posterior is at least LEAST_POSTERIOR. Null and empty texts
    and those without any letter give 'und', posterior null, not accepted. A null host counts as ''. Repeated rows are each judged.
    Ties go to the language first in the alphabet. An empty table gives no rows; no languages at all give 'und' everywhere. A task
    holds about 20 bytes a byte of the text it works on.
    """
    scratch = Scratch(docs.sparkSession, "language-id")
    carry = [c for c in carry if c not in ("language", "posterior", "accepted")]
    n = len(languages)
    inputs = docs.select(
        *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)],
        F.coalesce(F.lower(host.cast("string")), F.lit("")).alias("host"),
        declared.cast("string").alias("declared"),
        likelihoods(docs, text, logs).alias("ll"),
    ).withColumn("suffix", address_suffix(F.col("host")))
    own = F.slice("ll", 1, n)
    best = F.when(F.col("ll").isNotNull() & F.lit(n > 0), F.array_position(own, F.array_max(own)).cast("int") - 1)
    scored = scratch.save(inputs.withColumn("best", best))
    fixed = [F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)]
    if not n:
        return scored.select(*fixed, F.lit(UNKNOWN).alias("language"), F.lit(None).cast("double").alias("posterior"), F.lit(False).alias("accepted"))
    per_host = scratch.save(scored.where("best IS NOT NULL").groupBy("host", "best").agg(F.count("*").alias("n")).withColumn("domain", domain_of(F.col("host"))))
    even = F.array(*[F.lit(1.0 / n)] * n)
    overall = smoothed(per_host.groupBy("best").agg(F.sum("n").alias("n")).select(F.lit("all").alias("every"), "best", "n", even.alias("parent")), "every", n, F.col("parent"), float(n)).first()
    top = F.array(*[F.lit(float(p)) for p in (overall["prior"] if overall else [1.0 / n] * n)])
    by_domain = scratch.save(smoothed(per_host.groupBy("domain", "best").agg(F.sum("n").alias("n")).withColumn("parent", top), "domain", n, F.col("parent"), PRIOR_ROWS))
    of_host = per_host.join(by_domain.withColumnRenamed("prior", "parent"), "domain").select("host", "best", "n", "parent")
    priors = scratch.save(smoothed(of_host, "host", n, F.col("parent"), PRIOR_ROWS))
    declared, suffixes = (scratch.save(evidence(scored, what, n)) for what in ("declared", "suffix"))
    none = F.array(*[F.lit(0.0)] * n)
    fused = (
        scored.join(priors, "host", "left")
        .join(declared, "declared", "left")
        .join(suffixes, "suffix", "left")
        .withColumn("prior", F.coalesce("prior", top))
        .withColumn("d", F.coalesce("log_declared", none))
        .withColumn("s", F.coalesce("log_suffix", none))
    )
    joint = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("ll", i) + F.get("d", i) + F.get("s", i) + F.log(F.get("prior", i) * (1 - UNKNOWN_PRIOR)))
    # a language outside the model says nothing about declarations and suffixes: their mean over the languages
    outside = F.get("ll", F.lit(n)) + sum((F.get("d", F.lit(i)) + F.get("s", F.lit(i)) for i in range(n)), F.lit(0.0)) / n + float(np.log(UNKNOWN_PRIOR))
    fused = fused.withColumn("joint", F.when(F.col("ll").isNotNull(), F.concat(joint, F.array(outside)))).withColumn("top", F.array_max("joint"))
    mass = F.aggregate("joint", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    language = F.coalesce(F.element_at(names, F.array_position("joint", F.col("top")).cast("int")), F.lit(UNKNOWN))
    posterior = F.round(1 / mass, 6)
    return fused.select(*fixed, language.alias("language"), posterior.alias("posterior"), F.coalesce((language != UNKNOWN) & (posterior >= LEAST_POSTERIOR), F.lit(False)).alias("accepted"))


def identify_documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Documents: fitted on a sample of their labels in lang, which is also what each declares; the source stands for the host.

    A declaration is evidence like any other: how far it counts depends on how often texts of a language declare it. Sources that are
    no addresses have no suffix, and are domains of their own.
    """
    languages, logs = fit(docs, "doc_id", "text", "lang")
    return identify(docs, languages, logs, F.col("source"), primary_subtag(F.col("lang")), carry)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"), ["doc_id"])


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on web pages, with all four kinds of evidence; fitted on the documents' labels.

    Null html gives a null text and so 'und'; pages that repeat are each judged; an empty table gives no rows.
    """
    from .url_filter import host_and_path

    languages, logs = fit(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    pages = host_and_path(table(spark, sf_dir, "pages")).withColumn("plain", F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "))
    return identify(pages, languages, logs, F.col("host"), declared_language(F.col("html")), ["page_id"], "plain")
