"""License scans by MinHash bands over overlapping windows of words, all in DataFrame functions.

A template is a short license notice, known by its shingles of two words. Templates of up to L words (L a power of
two) are looked for in windows of 2L words, one every L words, so each occurrence lies whole in
some window.

**Bands.** Windows and templates get ``BANDS`` minima of independently hashed shingles, each a band of its own. A window that
holds a share c of a template's n shingles has a Jaccard similarity of at least
j = cn / (2L - 1 + n - cn) to it, and misses all bands with probability (1 - j) ** BANDS at most: for the shortest
templates of a class 5e-8, for others less. Where n is so small that the bound is above ``MISS``, the template
is met by filed shingles instead, which miss nothing.

**Filed shingles.** A window that holds the share c holds one at least of any n - cn + 1 shingles of the template; so
many, the longest, are filed. Each text is shingled once, and only texts and windows with a filed shingle of some
template get minima, so the rest costs one pass.

What meets is verified by exact containment of the template's shingles, and by the runs of words that tell it from
templates of other licenses that are nearly the same (version 2 or 3, BY or BY-NC). Texts are not shuffled for
it. Whether the templates are broadcast is left to Spark, which looks at their size.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.decontaminate import digest, words
from basketlens.llm.tables import stored

SHINGLE = 2
CONTAINMENT = 0.8
#: The least class of lengths.
SHORTEST = 8
#: Bands of one minimum each, and the probability of a miss that a template may have.
BANDS = 80
MISS = 1e-6

#: Headers, notices and sentences of bodies by which texts hold their license, as [license, text].
TEMPLATES = Path(__file__).with_name("license_templates.json")


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(json.loads(TEMPLATES.read_text()), "license string, text string")


def _shingles(w: Column) -> Column:
    """Hashes of the runs of two words, in order; of the one word, if there is no more."""
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(w) > 1, pairs).otherwise(F.transform(w, lambda a: F.xxhash64(a)))


def _bands(grams: Column) -> Column:
    """A key for each band: the least of the shingles' hashes under a seed of its own."""
    seeds = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return F.transform(seeds, lambda j: F.xxhash64(j, F.array_min(F.transform(grams, lambda g: F.xxhash64(g, j)))))


def miss(n: int, length: int, containment: float, bands: int = BANDS) -> float:
    """The greatest probability that a window with the asked share of n shingles shares no band with their template."""
    held = math.ceil(n * containment - 1e-6)
    return (1 - held / (2 * length - 1 + n - held)) ** bands


#: Words on each side of a place where two templates differ that must stand there, too.
CONTEXT = 2


def _runs(a: list[str], b: list[str]) -> set[str]:
    """The runs of words of ``a`` around each pair of neighbours that ``b`` does not have."""
    theirs = set(zip(b, b[1:]))
    return {" ".join(a[max(0, i - CONTEXT + 1) : i + 1 + CONTEXT]) for i, pair in enumerate(zip(a, a[1:])) if pair not in theirs}


def _told_apart(rows: list[Row], containment: float) -> list[tuple[str, list[str], list[str]]]:
    """license, w, must: ``must`` has the runs that a text needs beside its shingles not to be of another license."""
    out = []
    for row in rows:
        mine, must = set(zip(row.w, row.w[1:])), set()
        for other in rows:
            near = len(mine & set(zip(other.w, other.w[1:]))) >= containment * len(mine)
            if other.license != row.license and near:
                must |= _runs(row.w, other.w)
        out.append((row.license, row.w, sorted(must)))
    return out


def _filed(w: Column, containment: float) -> Column:
    """Hashes of the longest shingles, as many as a text must hold one of."""
    grams = _shingles(w)
    n = F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.length(F.array_join(F.slice(w, i, SHINGLE), " ")))
    longest = F.sort_array(F.array_distinct(F.arrays_zip(runs.alias("n"), grams.alias("gram"))), asc=False)
    some = (F.size(longest) - F.ceil(F.size(longest) * containment - 1e-6) + 1).cast("int")
    return F.transform(F.slice(longest, F.lit(1), some), lambda r: r["gram"])


def scan(documents: DataFrame, templates: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, licenses (sorted) of every row of ``documents``.

    ``templates`` has license and text. A license is found if a window holds at least ``containment`` of the
    different shingles of one of its templates, and every run of words that tells the template from those of other
    licenses that share as much with it; a template of four shingles must be whole. A template of one word is found
    in texts of that word alone. Templates come to the driver. Null and
    empty texts have no license, and templates without words or name find none. Each row is scanned by itself; repeated rows
    and ids, also null ones, stay. Other columns are not read.
    """
    kept = templates.select("license", words("text").alias("w")).where("license IS NOT NULL AND size(w) > 0").distinct()
    kept = documents.sparkSession.createDataFrame(
        _told_apart(kept.collect(), containment), "license string, w array<string>, must array<string>"
    )
    length = F.greatest(F.lit(SHORTEST), F.pow(2, F.ceil(F.log2(F.size("w")))).cast("int"))
    template = F.array_distinct(_shingles(F.col("w")))
    n = F.size("_template")
    held = F.ceil(n * containment - 1e-6)
    missed = F.pow(1 - held / (2 * F.col("length") - 1 + n - held), F.lit(BANDS))
    known = stored(
        kept.select("license", "must", length.alias("length"), template.alias("_template"), _filed(F.col("w"), containment).alias("filed"))
        .withColumn("short", missed > MISS)
        .withColumn("key", F.explode(F.when(F.col("short"), F.col("filed")).otherwise(_bands(F.col("_template")))))
    )
    # From the templates only: a handful of lengths, and a fifth of the templates' shingles.
    lengths = [r.length for r in known.select("length").distinct().collect()]
    filed = sorted(r.gram for r in known.select(F.explode("filed").alias("gram")).distinct().collect())
    seen = F.array(*map(F.lit, filed)).cast("array<bigint>")
    texts = documents.select(digest("text").alias("digest"), words("text").alias("w")).where("size(w) > 0")
    texts = texts.withColumn("grams", _shingles(F.col("w"))).where(F.arrays_overlap("grams", seen))
    of_length = texts.select("*", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("length"))
    windows = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.col("length")).cast("int")),
        lambda i: F.struct(
            F.slice("grams", i * F.col("length") + 1, 2 * F.col("length") - 1).alias("grams"),
            F.slice("w", i * F.col("length") + 1, 2 * F.col("length")).alias("w"),
        ),
    )
    cut = of_length.select("digest", "length", F.explode(F.filter(windows, lambda x: F.arrays_overlap(x["grams"], seen))).alias("x"))
    each = cut.select("digest", "length", F.array_distinct("x.grams").alias("grams"), F.col("x.w").alias("w"))
    met = each.withColumn("key", F.explode(F.array_distinct(F.concat(_bands(F.col("grams")), F.array_intersect("grams", seen)))))
    met = met.join(known, ["length", "key"])
    held = F.size(F.array_intersect("_template", "grams")) >= containment * F.size("_template")
    said = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    apart = F.forall("must", lambda run: F.instr(said, F.concat(F.lit(" "), run, F.lit(" "))) > 0)
    found = met.where(held).where(apart).select("digest", "license").distinct().groupBy("digest").agg(
        F.array_sort(F.collect_set("license")).alias("licenses")
    )
    rows = documents.select("doc_id", digest("text").alias("digest"))
    return rows.join(found, "digest", "left").select(
        "doc_id", F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses")
    )
