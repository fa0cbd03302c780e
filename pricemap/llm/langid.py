"""Language identification by Bayesian evidence fusion.

Four sources of evidence meet in one posterior per document: the likelihood of the text under byte-trigram
models, the language that the markup declares, the suffix of the address, and a prior of the host.
The trigram counts come from every labelled text; how far declarations and suffixes agree with the
texts, and the host priors, are grouped aggregates of the text posteriors over every row.  A host with
few rows takes its prior from its domain, a domain from its suffix, a suffix from all rows.  A row's own
posterior is left out of every sum that it meets again, so no text counts twice.
"""

from __future__ import annotations

import html as html_entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pricemap.llm.store import drop, saved

#: Hash buckets of the trigram models, and the languages whose models are counted and broadcast at once (16 MB).
BUCKETS, LANGUAGE_BLOCK = 1 << 15, 128
#: The text counts as at most so many independent trigrams: overlapping ones repeat each other's evidence.
TEXT_WEIGHT = 40.0
#: Rows that the wider level counts for in a host's or domain's prior, and in the agreement tables.
HOST_STRENGTH, DOMAIN_STRENGTH, AGREEMENT_STRENGTH = 20.0, 50.0, 10.0
#: Tables of hosts, declarations and suffixes of up to so many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Everything in ASCII that isn't a letter separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKUP = re.compile(r"<script\b.*?(?:</script>|\Z)|<style\b.*?(?:</style>|\Z)|<!--.*?(?:-->|\Z)|<[^>]*>", re.S | re.I)


def visible_text(markup: str | None) -> str:
    """The text of an HTML page: no scripts, styles, comments or tags; entities resolved."""
    return html_entities.unescape(_MARKUP.sub(" ", markup)) if markup else ""


def trigram_buckets(text: str | None) -> np.ndarray:
    """Bucket of each byte trigram of the letters of a whole text, words apart by one space."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    words = text.encode("utf-8", "replace").translate(_LETTERS).split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    return ((three * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


@dataclass
class TextModel:
    """Log-probabilities of trigram buckets for a block of languages, and how many trigrams each language has."""

    languages: list[str]
    log_p: np.ndarray
    sizes: np.ndarray

    def likelihood(self, text: str | None, label: str | None = None) -> tuple[int, np.ndarray]:
        """Number of trigrams, and the weighted log-likelihood by language (zero without letters).

        A text that was counted under ``label`` is taken out of that language's counts first, unless they have no other.
        """
        own = trigram_buckets(text)
        if not len(own):
            return 0, np.zeros(len(self.languages))
        total = np.zeros(len(self.languages))
        for k in range(0, len(own), 1 << 16):
            total += self.log_p[own[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        k = self.languages.index(label) if label in self.languages else None
        if k is not None and self.sizes[k] > len(own) + 0.5:
            bucket, times = np.unique(own, return_counts=True)
            whole = self.sizes[k] + 0.5 * BUCKETS
            counts = np.exp(self.log_p[bucket, k].astype(np.float64)) * whole
            total[k] = (times * np.log(np.maximum(counts - times, 0.5) / (whole - len(own)))).sum()
        return len(own), total / len(own) * min(len(own), TEXT_WEIGHT)


def _labels(labelled: DataFrame, text: str, label: str) -> DataFrame:
    return labelled.select(F.col(text).cast("string").alias("text"), F.lower(F.trim(F.col(label).cast("string"))).alias("label")).filter("label <> ''")


def language_shares(labelled: DataFrame, text: str = "text", label: str = "lang") -> dict[str, float]:
    """Share of each label among the labelled rows, by name; every label is a language (``und`` where there is none)."""
    found = {r["label"]: r["count"] for r in _labels(labelled, text, label).groupBy("label").count().orderBy("label").collect()}
    total = sum(found.values())
    return {x: n / total for x, n in found.items()} or {"und": 1.0}


def train_text_model(labelled: DataFrame, languages: list[str], text: str = "text", label: str = "lang") -> TextModel:
    """Trigram counts of ``languages`` over every labelled text.  Each task adds up its own rows, so a row per language, bucket and task is shuffled."""
    number = {x: k for k, x in enumerate(languages)}

    def count(batches):
        sums = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            for t, own in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                if own in number:
                    sums[number[own]] += np.bincount(trigram_buckets(t), minlength=BUCKETS)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(sums[lang, bucket])], ["lang", "bucket", "n"])

    counts = _labels(labelled, text, label).mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[counts["bucket"].to_numpy(), counts["lang"].to_numpy()] += counts["n"].to_numpy()
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32), table.sum(axis=0) - 0.5 * BUCKETS)


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema])


def with_likelihood(df: DataFrame, labelled: DataFrame, shares: dict[str, float], text: str, is_markup: bool = False, own_label: str | None = None) -> DataFrame:
    """``df`` written with ``__n`` (trigrams), ``__ll`` (log-likelihood by language) and ``__p`` (posterior, null without letters) of ``text``.

    A text column goes, a field of a struct column stays.  ``own_label`` names the column with the label under
    which a row itself was counted, if it was.  Languages are scored in blocks, so what is
    broadcast has a bound however many there are.
    """
    languages = list(shares)
    out = df.withColumn("__ll", F.array().cast("array<double>"))
    for at in range(0, len(languages), LANGUAGE_BLOCK):
        before, out = out, saved(_scored(out, train_text_model(labelled, languages[at : at + LANGUAGE_BLOCK]), shares, text, is_markup, own_label), "likelihoods")
        if at:
            drop(before)
    return out


def _scored(df: DataFrame, model: TextModel, shares: dict[str, float], text: str, is_markup: bool, own_label: str | None = None) -> DataFrame:
    shared, last = df.sparkSession.sparkContext.broadcast(model), model.languages[-1] == list(shares)[-1]
    share = np.log(np.array(list(shares.values())))
    names = [c for c in df.columns if c not in ("__ll", "__n", "__p") and not (last and c == text)]
    column, *field = text.split(".")

    def score(batches):
        for batch in batches:
            texts = batch.column(column) if not field else pc.struct_field(batch.column(column), field)
            labels = batch.column(own_label).to_pylist() if own_label else [None] * batch.num_rows
            n, ll = [], []
            for t, label, before in zip(texts.cast(pa.string()).to_pylist(), labels, batch.column("__ll").to_pylist()):
                k, own = shared.value.likelihood(visible_text(t) if is_markup else t, label)
                n.append(k)
                ll.append([*before, *own.tolist()])
            p = [x if k else None for k, x in zip(n, _posterior(np.array(ll).reshape(len(ll), -1) + share).tolist())] if last else [None] * len(n)
            arrays = [pa.array(n, pa.int64()), pa.array(ll, pa.list_(pa.float64())), pa.array(p, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *arrays], schema.names)

    schema = df.select(*names, F.lit(0).cast("long").alias("__n"), "__ll", F.col("__ll").alias("__p")).schema
    return df.mapInArrow(score, _nullable(schema))


def host_of(url: Column) -> Column:
    """Lower-case host of an address, without user and port; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", found)


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    found = F.regexp_extract(host, r"([^.]+\.[^.]+)\.?$", 1)
    return F.when(found != "", found)


def suffix_of(host: Column) -> Column:
    """The last label of a host, if it is letters."""
    found = F.regexp_extract(host, r"\.([a-z]{2,24})\.?$", 1)
    return F.when(found != "", found)


def declared_language(markup: Column) -> Column:
    """Primary language that a page's html element or content-language header declares, lower case; null without one."""
    own = F.lower(F.regexp_extract(markup, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    other = F.lower(F.regexp_extract(markup, r"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})\b", 1))
    return F.coalesce(F.when(own != "", own), F.when(other != "", other))


def _smoothed(own: np.ndarray, wider: np.ndarray, strength: float) -> np.ndarray:
    return (own + strength * wider) / (own.sum(axis=1, keepdims=True) + strength)


def fused_posterior(ll: np.ndarray, own: np.ndarray, every: np.ndarray, place: dict[str, np.ndarray], evidence: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Posterior by language of rows, from sums of text posteriors that each row's ``own`` is taken out of.

    ``every``: the sum over all rows.  ``place``: sums of a row's suffix, domain and host.  ``evidence``: for each
    kind of agreement the sum of the rows with the same value (NaN without one) and that of all rows with any.
    """
    rest = np.maximum(every - own, 0.0)
    prior = (rest + 1.0) / (rest + 1.0).sum(axis=1, keepdims=True)
    for level, strength in (("suffix", DOMAIN_STRENGTH), ("domain", DOMAIN_STRENGTH), ("host", HOST_STRENGTH)):
        known = ~np.isnan(place[level][:, :1])
        prior = np.where(known, _smoothed(np.maximum(np.nan_to_num(place[level]) - own, 0.0), prior, strength), prior)
    logs = ll + np.log(prior)
    for same, total in evidence:
        left, among = np.maximum(np.nan_to_num(same) - own, 0.0), np.maximum(total - own, 0.0)
        share = (left.sum(axis=1, keepdims=True) + 1e-9) / (among.sum(axis=1, keepdims=True) + 1e-9)
        logs += np.where(np.isnan(same[:, :1]), 0.0, np.log((left + AGREEMENT_STRENGTH * share) / (among + AGREEMENT_STRENGTH)))
    return _posterior(logs)


def fuse(scored: DataFrame, shares: dict[str, float], declared: Column, host: Column, domain: Column, suffix: Column) -> DataFrame:
    """Add language, probability, text_language, declared, host, suffix, n_trigrams to a written table with __n, __ll and __p.

    Missing evidence (null) says nothing.  A tie goes to the language that comes first by name.
    Columns of those names that ``scored`` has already are replaced.
    """
    langs, size = list(shares), len(shares)
    names = [c for c in scored.columns if c not in ("__n", "__ll", "__p", "language", "probability", "text_language", "declared", "host", "suffix", "n_trigrams")]
    rows = scored.select(*names, "__n", "__ll", "__p", declared.alias("__declared"), host.alias("__host"), domain.alias("__domain"), suffix.alias("__suffix"))
    known = rows.filter("__p is not null")
    soft = [F.sum(F.col("__p")[k]).alias(f"p{k}") for k in range(size)]
    again = [F.sum(F.col("sums")[k]).alias(f"p{k}") for k in range(size)]
    sums = F.array(*[F.coalesce(F.col(f"p{k}"), F.lit(0.0)) for k in range(size)]).alias("sums")

    def total(df: DataFrame, parts: list[Column]) -> list[float]:
        return df.agg(*parts).select(sums).first()[0]

    # the sums of a host, its domain and its suffix: one small row a host
    hosts = saved(known.filter("__host is not null").groupBy("__host", "__domain", "__suffix").agg(*soft).select("__host", "__domain", "__suffix", sums), "host-sums")
    of_suffix = hosts.groupBy(F.col("__suffix").alias("s")).agg(*again).select("s", sums.alias("suffix_sum"))
    of_domain = hosts.groupBy(F.col("__domain").alias("d")).agg(*again).select("d", sums.alias("domain_sum"))
    placed = hosts.join(of_suffix.hint("merge"), F.col("__suffix") == F.col("s"), "left").join(of_domain.hint("merge"), F.col("__domain") == F.col("d"), "left")
    placed = saved(placed.select(F.col("__host").alias("h"), F.col("sums").alias("host_sum"), "domain_sum", "suffix_sum"), "host-places")
    every = total(known, soft)

    out, totals = rows.join(_sized(placed), F.col("__host") == F.col("h"), "left").drop("h"), []
    # how often a declared value or a suffix goes with each language; declarations of no language of the models are one value
    value_of = {"__declared": F.when(F.col("__declared").isin(langs), F.col("__declared")).when(F.col("__declared").isNotNull(), F.lit("other")), "__suffix": F.col("__suffix")}
    for column, value in value_of.items():
        same = saved(known.filter(value.isNotNull()).groupBy(value.alias("v")).agg(*soft).select("v", sums.alias(f"{column}_sum")), "agreement")
        totals.append(total(same.withColumnRenamed(f"{column}_sum", "sums"), again))
        out = out.join(_sized(same), value == F.col("v"), "left").drop("v")

    said = list(value_of)

    def posterior(batches):
        def array(column, n):
            return np.array([x or [np.nan] * size for x in column.to_pylist()], dtype=float).reshape(n, size)

        for batch in batches:
            n = batch.num_rows
            own = array(batch.column("__p"), n)
            place = {level: array(batch.column(f"{level}_sum"), n) for level in ("suffix", "domain", "host")}
            evidence = [(array(batch.column(f"{c}_sum"), n), np.array(t)) for c, t in zip(said, totals)]
            q = fused_posterior(array(batch.column("__ll"), n), np.nan_to_num(own), np.array(every), place, evidence)
            text = [None if np.isnan(x[0]) else langs[int(x.argmax())] for x in own]
            more = {
                "language": [langs[k] for k in q.argmax(axis=1)], "probability": q.max(axis=1), "text_language": text, "declared": batch.column("__declared"),
                "host": batch.column("__host"), "suffix": batch.column("__suffix"), "n_trigrams": batch.column("__n"),
            }
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(more.values(), kinds)]], [*names, *more])

    kinds = [pa.string(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    text = F.lit(None).cast("string")
    added = {"language": text, "probability": F.lit(0.0), "text_language": text, "declared": text, "host": text, "suffix": text, "n_trigrams": F.lit(0).cast("long")}
    schema = rows.select(*names, *[v.alias(c) for c, v in added.items()]).schema
    return out.mapInArrow(posterior, _nullable(schema))


def _sized(table: DataFrame) -> DataFrame:
    """A written table with the join strategy that its number of rows allows."""
    return table.hint("broadcast" if table.count() <= BROADCAST_ROWS else "merge")


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Language of every page (page_id, url, html), with text models from ``labelled`` (text, lang).

    Null html or url give no evidence; a page without any takes the prior.  Repeated rows each give a
    row; an empty table gives none; other columns are not read.
    """
    shares = language_shares(labelled)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("said", declared_language(F.col("html")))
    scored = with_likelihood(rows, labelled, shares, "html", True)
    host = host_of(F.col("url"))
    fused = fuse(scored, shares, F.col("said"), host, domain_of(host), suffix_of(host))
    return fused.select("page_id", "language", F.round("probability", 6).alias("probability"), "text_language", "declared", "host", "suffix", "n_trigrams")


def keep_identified(docs: DataFrame, least_probability: float = 0.5, languages: list[str] | None = None) -> DataFrame:
    """``docs`` (text, lang, source) without the rows whose language can't be told or isn't among ``languages``; all columns stay.

    ``lang`` is taken as the declaration and the label of the text models, which judge a row without its own
    text, ``source`` as the host.  A row goes if its text has no letters, if no language reaches ``least_probability``, or if the fused
    language isn't wanted (None: every language is).  Columns of any name are kept.
    """
    shares = language_shares(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    said, source = F.lower(F.trim(F.col("lang").cast("string"))), F.lower(F.trim(F.col("source").cast("string")))
    scored = with_likelihood(docs.select(row, said.alias("said"), source.alias("place")), docs, shares, "row.text", own_label="said")
    nothing = F.lit(None).cast("string")
    fused = fuse(scored, shares, F.col("said"), F.col("place"), nothing, nothing)
    kept = fused.filter((F.col("n_trigrams") > 0) & (F.col("probability") >= least_probability))
    return (kept if languages is None else kept.filter(F.col("language").isin(languages))).select("row.*")
