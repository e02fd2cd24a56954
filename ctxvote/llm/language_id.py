"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a page are combined in one posterior:

- text: multinomial likelihoods of character trigrams, learnt from documents with a known language and tempered, so
  that a long text counts as `EVIDENCE` trigrams at most and its trigrams are not taken for independent;
- the declared markup language (`<html lang=...>`) and the address suffix (a language segment of the path, else the
  top-level domain): P(cue | language) from grouped sums of the text's posteriors on the other pages, smoothed;
- the host: a prior from the posteriors of the host's other pages, smoothed towards that of its domain, and this
  towards that of all pages.

The languages are those of all labelled documents.  The text model is fitted to at most `FIT_ROWS` documents of each
language, chosen by a hash of their ids; a language with few has a smoothed model.  Cue tables and priors are grouped
aggregations over all pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, cut, own_rows, sized_join
from .html_text import host_of, text_by_rules

#: Documents of each language that the text model is fitted to.
FIT_ROWS = 4_000
FEATURES = 20_000
EVIDENCE = 40
#: Pseudo-counts of the smoothing of cue tables and of host and domain priors.
CUE_WEIGHT, HOST_WEIGHT = 2.0, 5.0

_SEGMENT = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//[^/?#]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2,4})?(?:[/?#]|$)")


def trigrams(text: str) -> Counter:
    """Counts of the character trigrams of the words, in lower case, with a space at either end."""
    out: Counter = Counter()
    for word, n in Counter(re.findall(r"[^\W\d_]+", text.lower())).items():
        padded = f" {word} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] += n
    return out


def suffix_of(url: str | None) -> str:
    """The language segment that begins the path, else the top-level domain with a dot, else nothing."""
    m = _SEGMENT.match(url or "")
    if m:
        return m[1].lower()
    host = host_of(url)
    return f".{host.rsplit('.', 1)[1]}" if "." in host and not host[-1].isdigit() else ""


def domain_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def fit_text(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[list[str], dict[str, list[float]], list[float]]:
    """(languages, log-likelihoods by trigram, those of an unknown trigram).  Rows without a language or text do not count."""
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count_distinct("doc_id").alias("n")).collect()}  # one row a language
    langs = sorted(sizes)
    if not langs:
        return [], {}, []
    # A hash bound of about twice the wanted rows for each language, so that the order below meets bounded rows.
    bound = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, (2.0 * fit_rows + 100.0) / max(sizes[k], 1))))])
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ids = known.select("lang", "doc_id").distinct().where(F.coalesce(spread, F.lit(0.0)) < bound[F.col("lang")])
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= fit_rows).select("lang", "doc_id")
    own_rows(docs, id_col, text_col)  # ships the package
    rows = known.join(F.broadcast(chosen), ["lang", "doc_id"]).select("text", "lang")  # FIT_ROWS a language

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(trigrams(text))
            flat = [(lang, gram, n) for lang, c in found.items() for gram, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "gram", "n"])

    counts = cut(rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = dict.fromkeys(langs, 0) | {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    best = counts.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy(F.desc("all"), "gram").limit(FEATURES).collect()
    size = len(best) + 1
    table = {r.gram: [math.log((r.by.get(x, 0) + 0.5) / (totals[x] + 0.5 * size)) for x in langs] for r in best}
    return langs, table, [math.log(0.5 / (totals[x] + 0.5 * size)) for x in langs]


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda p: p / total)


def _cue_table(pages: DataFrame, cue: str, n: int) -> DataFrame:
    """`cue, <cue>_s, <cue>_n`: the sums of the text's posteriors over the pages of each value, and how many these are."""
    return pages.groupBy(cue).agg(F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(f"{cue}_s"), F.count(F.lit(1)).alias(f"{cue}_n"))


def _cue_log(cue: str, i: int, world: float) -> Column:
    """log P(value | language i) up to a constant: P(language | value) over P(language), from the value's other pages.

    Smoothed towards the language's share of all pages, so that a value that no other page has says nothing.
    """
    others = F.greatest(F.col(f"{cue}_s")[i] - F.col("p")[i], F.lit(0.0))
    return F.log((others + CUE_WEIGHT * world) / ((F.col(f"{cue}_n") - 1 + CUE_WEIGHT) * world))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang") -> DataFrame:
    """One row per page: `page_id, lang, probability, text_lang, declared, suffix, host`.

    Null and empty html has no text evidence and no declaration, a null URL the empty host and suffix; what remains
    decides.  Ties go to the first language in alphabetical order.  Without labelled documents the language is null;
    documents without an id, a language or a text are not learnt from.  Very long pages are read whole.  Rows that
    repeat an id are separate rows; an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    langs, table, unknown = fit_text(docs, lang_col)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}"
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("host"))
    shared = spark.sparkContext.broadcast((table, unknown))  # FEATURES rows at most
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))

    def weigh(batches):
        known, other = shared.value
        for batch in batches:
            logs, hosts, domains, suffixes = [], [], [], []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                grams = trigrams(text_by_rules(html))
                n = sum(grams.values())
                sums = [0.0] * len(other)
                for gram, times in grams.items():
                    for i, x in enumerate(known.get(gram, other)):
                        sums[i] += times * x
                logs.append([s * min(1.0, EVIDENCE / n) for s in sums] if n else sums)
                hosts.append(host_of(url))
                domains.append(domain_of(hosts[-1]))
                suffixes.append(suffix_of(url))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("declared"), pa.array(suffixes, pa.string()), pa.array(hosts, pa.string()), pa.array(domains, pa.string()), pa.array(logs, pa.list_(pa.float64()))], ["page_id", "declared", "suffix", "host", "domain", "ll"])

    weighed = rows.withColumn("declared", declared).mapInArrow(weigh, f"{schema}, declared string, suffix string, host string, domain string, ll array<double>")
    weighed = cut(weighed.withColumn("p", _softmax(F.col("ll"))))
    n = len(langs)
    joined = weighed
    for cue in ("declared", "suffix"):
        known_cues = cut(_cue_table(weighed.select(cue, "p"), cue, n))
        small = known_cues.count() * n <= BROADCAST_IDS  # numbers
        joined = joined.join(F.broadcast(known_cues) if small else known_cues, cue)
    sums = lambda name: F.array(*[F.sum(F.col("p")[i]) for i in range(n)]).alias(name)
    all_pages = weighed.agg(sums("s"), F.count(F.lit(1)).alias("n")).first()
    world = [max((x or 0.0) / max(all_pages.n, 1), 1e-9) for x in all_pages.s]
    domains = cut(weighed.groupBy("domain").agg(sums("domain_s"), F.count(F.lit(1)).alias("domain_n")))
    hosts = cut(weighed.groupBy("host").agg(sums("host_s"), F.count(F.lit(1)).alias("host_n")))
    fused = sized_join(sized_join(joined, domains, ["domain"], "inner"), hosts, ["host"], "inner")
    scores = []
    for i in range(n):
        own = F.col("p")[i]  # a page does not vote on itself
        domain = (F.col("domain_s")[i] - own + HOST_WEIGHT * world[i]) / (F.col("domain_n") - 1 + HOST_WEIGHT)
        host = (F.col("host_s")[i] - own + HOST_WEIGHT * domain) / (F.col("host_n") - 1 + HOST_WEIGHT)
        cues = _cue_log("declared", i, world[i]) + _cue_log("suffix", i, world[i])
        scores.append(F.col("ll")[i] + cues + F.log(F.greatest(host, F.lit(1e-12))))
    posterior = fused.withColumn("q", _softmax(F.array(*scores)))
    names = F.array(*map(F.lit, langs))
    first = lambda c: F.get(names, (F.array_position(F.col(c), F.array_max(c)) - 1).cast("int"))
    return posterior.select("page_id", first("q").alias("lang"), F.round(F.array_max("q"), 6).alias("probability"), first("p").alias("text_lang"), "declared", "suffix", "host")
