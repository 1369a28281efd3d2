"""Language identification by Bayesian evidence fusion.

A page's language is inferred from four kinds of evidence: the likelihood of its text under a model of byte trigrams for each language, the
language its markup declares, the language its address suggests (country suffix, else a language code in path or
subdomain), and a prior for its host.  Host priors are grouped counts of what the text alone suggests, smoothed
from the host through its domain and suffix to the whole corpus; a page's own count is left out of its prior.  How far declarations and
addresses are to be trusted is counted over all pages too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.llm.common import Scratch, heavy_light_join, lookup, partitions

BUCKETS = 1 << 14
#: About so many documents, chosen by hash in equal numbers for each language but at least LEAST, teach the trigram model; more
#: than LANGUAGES languages are refused, as the model holds 64 KB for each.
SAMPLE, LEAST, LANGUAGES = 20_000, 200, 1_000
#: Trigrams of one text depend on each other: beyond so many, further ones add nothing, and each counts this much.
ENOUGH, TEMPER = 400, 0.5
#: Pseudo-counts with which each level is drawn to the one above.
SMOOTH = 5.0

#: Country suffixes that suggest a language.
SUFFIX = {
    "ar": "es", "at": "de", "au": "en", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cz": "cs", "de": "de", "dk": "da", "es": "es", "fi": "fi", "fr": "fr",
    "gr": "el", "hu": "hu", "ie": "en", "it": "it", "jp": "ja", "kr": "ko", "mx": "es", "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt",
    "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "tw": "zh", "ua": "uk", "uk": "en", "us": "en",
}
#: Where a tag's name says what it is, and the attributes that declare a language.
_RAW = {"script": re.compile(r"</script\s*>", re.IGNORECASE), "style": re.compile(r"</style\s*>", re.IGNORECASE)}
_NAME = re.compile(r"<(script|style|html|meta)\b", re.IGNORECASE)
_LANG = re.compile(r"""\blang\s*=\s*["']?([a-z]{2,3})\b""", re.IGNORECASE)
_CONTENT = re.compile(r"""\bcontent\s*=\s*["']?([a-z]{2,3})\b""", re.IGNORECASE)
_ENTITY = re.compile(r"&#?\w+;")
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?(?:/([^/?#]*))?", re.IGNORECASE)


def read_page(html: str | None) -> tuple[str, str | None]:
    """A page's visible text, and the language that its markup declares: the first ``lang`` of an html tag, else the first content-language.

    Tags, comments, scripts and styles are passed over once from left to right, whatever is unclosed: an unclosed script or comment
    is a tag, and an unclosed tag is text.
    """
    html = html or ""
    out, at, lang, meta, gone = [], 0, None, None, set()
    while (start := html.find("<", at)) >= 0:
        out.append(html[at:start])
        end, name = -1, None
        if html.startswith("<!--", start) and "-->" not in gone:
            end = html.find("-->", start + 4)
            if end < 0:
                gone.add("-->")  # so that the rest isn't searched again for each opening
            end = end + 3 if end >= 0 else -1
        elif m := _NAME.match(html, start):
            name = m[1].lower()
            if name in _RAW and name not in gone:
                close = _RAW[name].search(html, m.end())
                if close is None:
                    gone.add(name)
                end = close.end() if close else -1
        if end < 0:
            end = html.find(">", start) + 1
            if not end:
                at = start
                break
            if name == "html" and lang is None:
                lang = _LANG.search(html, start, end)
            elif name == "meta" and meta is None and "content-language" in html[start:end].lower():
                meta = _CONTENT.search(html, start, end)
        out.append(" ")
        at = end
    out.append(html[at:])
    told = lang or meta
    return _ENTITY.sub(" ", "".join(out)), told[1].lower() if told else None


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with single spaces."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.int64)
    h = (data[:-2] * np.uint32(65_536) + data[1:-1] * np.uint32(256) + data[2:]) * np.uint32(2_654_435_761)
    return (h >> np.uint32(32 - 14)).astype(np.int64)


def address(url: str | None, known: set[str]) -> tuple[str, str, str, str | None]:
    """Host, domain and suffix of a URL, and the language that the address suggests."""
    m = _URL.match((url or "").strip())
    host = m[1].lower().rstrip(".") if m else ""
    labels = host.split(".")
    suffix, domain = labels[-1], ".".join(labels[-2:])
    told = SUFFIX.get(suffix)
    if told not in known:
        told = next((x for x in ((m[2] or "").lower() if m else "", labels[0] if len(labels) > 2 else "") if x in known), None)
    return host, domain, suffix, told


def learn_language_model(docs: DataFrame, sample: int = SAMPLE, most: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of trigram buckets, from about ``sample`` of ``docs`` (doc_id, lang, text).

    Every language is kept and sampled by itself; one with few documents is taken whole.  More than ``most`` languages are an error.
    """
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lower("lang").alias("lang"), "text").where("lang is not null and text is not null")
    counted = d.groupBy("lang").count().limit(most + 1).collect()
    if len(counted) > most:
        raise ValueError(f"more than {most} languages")
    languages = sorted(r["lang"] for r in counted)
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    quota = max(LEAST, sample // len(languages))
    parts = [(r["lang"], max(1, min(1_000_000, round(1_000_000 * quota / r["count"])))) for r in counted]
    parts = F.broadcast(docs.sparkSession.createDataFrame(parts, "lang string, part long"))
    d = d.join(parts, "lang").where(F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1_000_000)) < F.col("part")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"], strict=True):
                x = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
                sums[lang] = sums[lang] + x if lang in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                x = np.frombuffer(raw, "<i8")
                sums[lang] = sums[lang] + x if lang in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["lang", "counts"])

    rows = d.mapInArrow(count, "lang string, counts binary").repartition(min(len(languages), partitions(docs.sparkSession)), "lang").mapInArrow(add, "lang string, counts binary").collect()
    table = np.zeros((len(languages), BUCKETS))
    for r in rows:
        table[languages.index(r["lang"])] += np.frombuffer(r["counts"], "<i8")
    table += 0.5
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_scores(text: str, table: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of a text in each language."""
    grams = trigrams(text)
    if not len(grams) or not len(table):
        return np.zeros(len(table))
    mean = table @ np.bincount(grams, minlength=BUCKETS).astype(np.float32) / len(grams)
    return (mean - mean.max()).astype(float) * min(len(grams), ENOUGH) * TEMPER


def identify(pages: DataFrame, languages: list[str], table: np.ndarray, smooth: float = SMOOTH) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, lang, confidence, text_lang, declared_lang, address_lang, host.

    A null or empty page has no text evidence and a null or odd url belongs to the host ``''``; what remains decides.  Evidence for a language
    the model doesn't have is no evidence.  Ties go to the first language by code.  Without any language every lang is
    null.  Rows may repeat and keep null identifiers; no rows give no rows; further columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "language")
    sent, known, n = spark.sparkContext.broadcast(table), set(languages), len(languages)
    texts, doubles = pa.string(), pa.list_(pa.float64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("page_id", "host", "domain", "suffix", "address_lang", "declared_lang", "text_lang", "text", "own")}
            for page, url, html in zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["html"], strict=True):
                text, declared = read_page(html.as_py())
                scores, own = text_scores(text, table), None
                if n and scores.max() > scores.min():
                    own = np.exp(scores)
                    own /= own.sum()
                told = languages[int(scores.argmax())] if own is not None else None
                for k, v in zip(out, (page, *address(url, known), declared if declared in known else None, told, scores, own), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k == "page_id" else doubles if k in ("text", "own") else texts) for k, v in out.items()], names=list(out))

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    seen = scratch.table(p.mapInArrow(read, "page_id long, host string, domain string, suffix string, address_lang string, declared_lang string, text_lang string, text array<double>, own array<double>"), "seen")
    if not n:
        return seen.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), "text_lang", "declared_lang", "address_lang", "host")

    # Counts by host and language, then summed upwards; a language counts where a text gives it any share.
    place = ["host", "domain", "suffix"]
    counts = seen.where("own is not null").select(*place, F.posexplode("own").alias("i", "share")).where("share > 0")
    counts = scratch.table(counts.groupBy(*place, "i").agg(F.sum("share").alias("c")), "counts")
    pages_of = scratch.table(seen.groupBy(*place).agg(F.count("own").alias("m"), F.count(F.lit(1)).alias("rows")), "hosts")
    listed = lambda keys, name: counts.groupBy(*keys, "i").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.collect_list(F.struct("i", "c")).alias(f"{name}_c"))
    summed = lambda keys, name: pages_of.groupBy(*keys).agg(F.sum("m").alias(f"{name}_m")).join(listed(keys, name), keys, "left")
    m, rows = (float(x or 0) for x in pages_of.agg(F.sum("m"), F.sum("rows")).first())
    world = np.full(n, smooth / n)
    for r in counts.groupBy("i").agg(F.sum("c").alias("c")).collect():  # one row a language
        world[r["i"]] += r["c"]
    world /= m + smooth

    def dense(pairs: list[dict] | None) -> np.ndarray:
        out = np.zeros(n)
        for x in pairs or ():
            out[x["i"]] = x["c"]
        return out

    def smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, prior = [], []
            for r in batch.to_pylist():
                p_suffix = (dense(r["suffix_c"]) + smooth * world) / (r["suffix_m"] + smooth)
                prior.append(((dense(r["domain_c"]) + smooth * p_suffix) / (r["domain_m"] + smooth)).tobytes())
                held.append(dense(r["host_c"]).tobytes())
            yield pa.RecordBatch.from_arrays([batch["host"], batch["rows"], batch["m"], pa.array(held, pa.binary()), pa.array(prior, pa.binary())], names=["host", "rows", "host_m", "host_c", "p_domain"])

    # A domain or suffix may have any number of hosts.
    hosted = scratch.table(pages_of.join(listed(place, "host"), place, "left"), "hosted")
    hosted = scratch.table(lookup(hosted, summed(["domain"], "domain"), "domain", F.col("host")), "in-domains")
    priors = lookup(hosted, summed(["suffix"], "suffix"), "suffix", F.col("host"))
    priors = scratch.table(priors.mapInArrow(smoothed, "host string, rows long, host_m long, host_c binary, p_domain binary"), "priors")

    # How often a declaration or an address agrees with the text where both speak.
    agree = lambda c: (F.count(F.when(F.col(c) == F.col("text_lang"), 1)), F.count(F.when(F.col(c).isNotNull() & F.col("text_lang").isNotNull(), 1)))
    told = seen.agg(*agree("declared_lang"), *agree("address_lang")).first()
    trust = [min(0.98, max(1.0 / n, (told[k] + 4.0) / (told[k + 1] + 5.0))) for k in (0, 2)]
    at = {x: i for i, x in enumerate(languages)}

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, confidence = [], []
            said = [batch[c].to_pylist() for c in ("declared_lang", "address_lang")]
            for k in range(batch.num_rows):
                total, own = np.array(batch["text"][k].as_py()), batch["own"][k].as_py()
                count, above = (np.frombuffer(batch[c][k].as_py(), np.float64) for c in ("host_c", "p_domain"))
                # A page's own count is left out of its prior.
                count = np.maximum(count - own, 0.0) if own is not None else count
                total += np.log((count + smooth * above) / (batch["host_m"][k].as_py() - (own is not None) + smooth))
                for values, r in zip(said, trust, strict=True):
                    if values[k] is not None:
                        evidence = np.full(n, np.log(max(1e-9, 1 - r) / max(1, n - 1)))
                        evidence[at[values[k]]] = np.log(r)
                        total += evidence
                belief = np.exp(total - total.max())
                lang.append(languages[int(belief.argmax())])
                confidence.append(round(float(belief.max() / belief.sum()), 6))
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(lang, texts), pa.array(confidence, pa.float64()), *(batch[c] for c in ("text_lang", "declared_lang", "address_lang", "host"))], names=["page_id", "lang", "confidence", "text_lang", "declared_lang", "address_lang", "host"])

    met = heavy_light_join(seen, priors, "host", "rows", int(rows), F.col("page_id"))
    return met.mapInArrow(fuse, "page_id long, lang string, confidence double, text_lang string, declared_lang string, address_lang string, host string")
