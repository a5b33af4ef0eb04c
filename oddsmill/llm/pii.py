"""Information-theoretic sanitisation of personal data.

Identifiers (e-mail and IP addresses, card and phone numbers) are found by pattern: the protected entities. Then the
corpus tells which ordinary terms give an entity away: a term t found beside an entity e reveals log2 of
n(t,e) N / (n(t) n(e)) bits of it (pointwise mutual information over documents), out of log2 of N / n(e) (its
information content). As most identifiers are rare, the same is asked of their parts (an address' name and domain, a
network, an exchange), which gather the evidence of many. A term that reveals at least DISCLOSE of the content is
generalised wherever it stands; from REMOVE on it is removed. What it reveals is estimated with SUPPORT different
contexts beside a whole identifier; with two, or for a part, the share of the term's documents that hold the entity is
taken at its lower confidence bound (Wilson's, Z deviations), so that few sightings tell only of rare entities.
"""
from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddsmill.llm.common import lean, materialise, slices

KINDS = ("email", "ip", "card", "phone")
DISCLOSE, REMOVE, SUPPORT, Z = 0.9, 0.98, 3, 1.645
#: Characters to either side of an entity that count as beside it; letters of a term at least.
BESIDE, TERM_LETTERS = 80, 3
#: Texts with a risky term are sent to every task up to this many bytes, joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

@functools.cache
def _letters(application: str) -> str:
    spark = SparkSession.getActiveSession()
    points = spark.range(0x40000).filter("id not between 55296 and 57343")  # beyond: private use, tags and nothing
    own = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")).filter(F.col("c").rlike(r"^\p{L}$"))
    runs = own.withColumn("run", F.col("id") - F.row_number().over(Window.orderBy("id"))).groupBy("run").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    return "".join(f"\\U{r.a:08x}-\\U{r.b:08x}" for r in runs.orderBy("a").collect())


def letters(spark: SparkSession) -> str:
    """Class of the letters by which SQL splits terms, for Python patterns: one definition, whatever Unicode version either has."""
    return f"[{_letters(spark.sparkContext.applicationId)}]"


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @ back over the local part, so that long texts without one cost nothing."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(t, at + 1)):
            done = m.end()
            yield start, done
        at = t.find("@", max(at + 1, done))


def ips(t: str) -> Iterator[tuple[int, int]]:
    """Four parts of up to 255 from the left of each dotted run of numbers."""
    for m in DOTTED.finditer(t):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at, end
                at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def identifiers(t: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points."""
    found = [("email", *x) for x in emails(t)] + [("ip", *x) for x in ips(t)]
    for m in CARD.finditer(t):
        if len(m[0]) >= 13 and 13 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(t):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def entities(kind: str, value: str) -> list[str]:
    """An identifier and the parts by which it names more than itself; of cards only the whole, as they begin with their issuer."""
    parts = {"email": lambda: zip(("name", "domain"), value.split("@"), strict=True), "ip": lambda: [("net", value.rpartition(".")[0])], "phone": lambda: [("line", value[:-4])]}
    return [f"{k}:{x}" for k, x in [(kind, value), *(parts[kind]() if kind in parts else ())]]


def contexts(t: str, letter: str) -> list[tuple[list[str], str]]:
    """(entities, the text beside them with identifiers and cut terms blanked) of each identifier."""
    spans = identifiers(t)
    out = []
    for kind, start, end in spans:
        value = t[start:end].lower() if kind in ("email", "ip") else NOT_DIGIT.sub("", t[start:end])
        low, high = max(0, start - BESIDE), min(len(t), end + BESIDE)
        near = list(t[low:high])
        for _, s, e in spans:
            if s < high and e > low:
                near[max(s, low) - low : min(e, high) - low] = " " * (min(e, high) - max(s, low))
        text = "".join(near)
        if low and re.match(letter, t[low - 1]):
            text = re.sub(rf"\A{letter}+", " ", text)
        if high < len(t) and re.match(letter, t[high]):
            text = re.sub(rf"{letter}+\Z", " ", text)
        out.append((entities(kind, value), text))
    return out


def terms(text: Column) -> Column:
    """Distinct lower-case letter runs of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda x: F.length(x) >= TERM_LETTERS))


def digest(text: Column) -> Column:
    """A text's key: 16 bytes of its SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def told(n_t: str) -> Column:
    """Bits of an entity that a term in n_t documents reveals: the less, the more documents."""
    share = F.col("n_te") / F.greatest(n_t, "n_te")
    n, zz = F.col("k") / share, F.lit(Z * Z)
    bound = (share + zz / (2 * n) - Z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)
    return F.col("content") + F.log2(F.when(F.col("whole"), share).otherwise(bound))


def prepared(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def disclosing_terms(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, ratio) of terms that give an entity away, and (h, term): their occurrences by digest of the text."""
    rows, letter = prepared(docs, text), letters(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            found = [(k, *x) for k, t in enumerate(b.column(0).to_pylist()) if t for x in contexts(t, letter)]
            if found:
                ids = [hashlib.sha256(b.column(0)[k].as_py().encode("utf-8", "surrogatepass")).digest()[:16] for k, _, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([x[1] for x in found]), pa.array([x[2] for x in found])], names=["h", "entities", "near"])

    beside = materialise(rows.mapInArrow(lean(run), "h binary, entities array<string>, near string"), "pii-contexts")
    n_docs = rows.count()
    n_entity = beside.select("h", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count_distinct("h").alias("n_e"))
    near = materialise(beside.select("entities", "h", F.xxhash64("near").alias("c"), F.explode(terms(F.col("near"))).alias("term")), "pii-near")
    pairs = near.select(F.explode("entities").alias("entity"), "h", "c", "term").groupBy("entity", "term").agg(F.count_distinct("h").alias("n_te"), F.count_distinct("c").alias("support"))
    # A term stands in as many documents, at least, as it has beside any entity: that alone rules common words out.
    least = near.groupBy("term").agg(F.count_distinct("h").alias("n_near"))
    whole = F.substring_index("entity", ":", 1).isin(*KINDS) & (F.col("support") >= SUPPORT)
    pairs = pairs.select("*", whole.alias("whole"), F.least("n_te", "support").alias("k")).filter("whole or k >= 2").join(n_entity, "entity")
    pairs = pairs.withColumn("content", F.log2(F.lit(float(n_docs)) / F.col("n_e"))).filter(told("n_te") >= DISCLOSE * F.col("content") - 1e-9)
    pairs = pairs.join(least, "term").filter(told("n_near") >= DISCLOSE * F.col("content") - 1e-9)
    pairs = materialise(pairs.select("term", "n_te", "whole", "k", "content"), "pii-pairs")
    # Documents of each candidate term, over the whole corpus.
    known = pairs.select("term").distinct()
    seen = rows.select(digest(F.col("t")).alias("h"), F.explode(terms(F.col("t"))).alias("term")).join(known, "term", "left_semi")
    seen = materialise(seen, "pii-terms")
    n_term = seen.groupBy("term").agg(F.count_distinct("h").alias("n_t"))
    risky = pairs.join(n_term, "term").withColumn("told", told("n_t")).filter("told > 0").filter(F.col("told") >= DISCLOSE * F.col("content"))
    risky = risky.groupBy("term").agg(F.max(F.col("told") / F.col("content")).alias("ratio"))
    return risky, seen


def with_terms(docs: DataFrame, text: str, action_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with _pii_text, the text, and _pii_terms, its disclosing terms: `-` before those to remove, `~` before those to generalise."""
    risky, seen = disclosing_terms(docs, text)
    flagged = risky.select("term", F.concat(F.when(F.col("ratio") >= REMOVE, "-").otherwise("~"), "term").alias("flag"))
    hits = materialise(seen.join(flagged, "term").groupBy("h").agg(F.sort_array(F.collect_set("flag")).alias("_pii_terms")), "pii-hits")
    n, size = hits.agg(F.count("*"), F.sum(F.length(F.array_join("_pii_terms", ",")) + 72)).first()
    rows = docs.select("*", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_pii_text"))
    if not n:
        return rows.withColumn("_pii_terms", F.lit(None).cast("array<string>"))
    rows, hits = rows.withColumn("_pii_key", digest(F.col("_pii_text"))), hits.withColumnRenamed("h", "_pii_key")
    return rows.join(F.broadcast(hits) if size <= action_bytes else hits, "_pii_key", "left").drop("_pii_key")


def term_spans(t: str, risky: list[str] | None, taken: list[tuple[str, int, int]], letter: str) -> list[tuple[str, int, int, bool]]:
    """(term, start, end, removed) of disclosing terms outside of the identifiers."""
    if not risky:
        return []
    flags = {x[1:]: x[0] == "-" for x in risky}
    inside = sorted((s, e) for _, s, e in taken)
    out, k = [], 0
    top = 0
    for m in re.finditer(rf"{letter}+", t):
        while k < len(inside) and inside[k][0] < m.end():
            top = max(top, inside[k][1])
            k += 1
        if top <= m.start() and (removed := flags.get(m[0].lower())) is not None:
            out.append(("term", *m.span(), removed))
    return out


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row the number of identifiers of each kind, a digest of their spans, and all spans with those of terms.

    Null texts count as empty. Repeated rows give repeated results; a term counts the different texts it stands in,
    so copies of a text add nothing to what it discloses.
    """

    letter = letters(docs.sparkSession)

    def show(found) -> str:
        return ",".join(f"{k}:{s}:{e}" for k, s, e, *_ in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_pii_text"):
            out = []
            for t, risky in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                own = identifiers(t)
                out.append((*(sum(x[0] == k for x in own) for k in KINDS), hashlib.sha256(show(own).encode()).hexdigest(), show([*own, *term_spans(t, risky, own, letter)])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = with_terms(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "_pii_text", "_pii_terms")
    return rows.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)[doc_id]}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with identifiers replaced by their kind in brackets, disclosing terms by [TERM] or by nothing.

    Null texts stay null, empty ones empty; repeated rows stay and change alike; an empty table gives an empty one. All
    columns are kept, whatever their names.
    """
    names, letter = docs.columns, letters(docs.sparkSession)
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_pii_text"):
            out = []
            for whole, t, risky in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True):
                own = identifiers(t)
                cuts = sorted([(s, e, f"[{k.upper()}]") for k, s, e in own] + [(s, e, "" if gone else "[TERM]") for _, s, e, gone in term_spans(t, risky, own, letter)])
                parts, done = [], 0
                for s, e, new in cuts:
                    if s >= done:
                        parts += [t[done:s], new]
                    done = max(done, e)
                out.append(None if whole is None else "".join([*parts, t[done:]]) if cuts else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else b.column(k) for k in range(len(names))], names=names)

    return with_terms(docs, text).select(*(F.col(f"`{c}`") for c in names), "_pii_text", "_pii_terms").mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: identifiers and disclosing terms of every document."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the text of every document is sanitised (see sanitise for null, empty and repeated rows), n_chars counts it anew."""
    out = sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns) if "n_chars" in docs.columns else out
